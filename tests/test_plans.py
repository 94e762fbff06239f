"""Shape of the plans: what must stay narrow stays narrow, and extraction runs once."""

import re

import pytest
from pyspark.sql import functions as F

from marklens import (
    audit_pages, audit_stream, filter_pages, issues_table, items_table, links_table, page_counts, quality_gate,
    read_page_stream,
    report_rows, schemas, summary, summary_lines, type_counts,
)
from marklens.operators.extract import jsonld_items
from marklens.plans.audit import read_pages

BLOCK = '<script type="application/ld+json">{"@type": "Product"}</script>'


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Pages in Parquet files, as a scan to plan against."""
    path = str(tmp_path_factory.mktemp("pages"))
    spark.range(40).select(
        F.col("id").alias("page_id"), F.concat(F.lit("http://h/"), F.col("id").cast("string")).alias("url"), F.lit(200).alias("status"),
        F.lit("text/html").alias("content_type"), F.lit(BLOCK).alias("html"), F.lit(None).cast("string").alias("fetch_error"),
    ).repartition(4).write.mode("append").parquet(path)
    return path


@pytest.fixture(scope="module")
def pages(spark, stored):
    return spark.read.schema(schemas.FETCHED_PAGES).parquet(stored)


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def count(kind, frame):
    return len(re.findall(rf"^[\s:+\-*()\d]*{kind}\b", plan(frame), re.M))


NARROW = {
    "results": audit_pages,
    "items": lambda pages: items_table(audit_pages(pages)),
    "issues": lambda pages: issues_table(audit_pages(pages)),
    "some issues": lambda pages: issues_table(audit_pages(pages)).filter("severity = 'error'"),
    "counts": lambda pages: page_counts(audit_pages(pages)),
    "filtered": lambda pages: filter_pages(audit_pages(pages), "error", "Product"),
    "report": lambda pages: report_rows(audit_pages(pages)),
    "links": links_table,
}


@pytest.mark.parametrize("name", NARROW)
def test_no_shuffle_and_one_python_stage(pages, name):
    frame = NARROW[name](pages)
    assert count("Exchange", frame) == 0
    assert count("ArrowEvalPython", frame) == 1
    assert count("(BatchEvalPython|MapInPandas|FlatMapGroupsInPandas)", frame) == 0


COUNTED = {
    "counts": page_counts,
    "summary": summary,
    "filtered": lambda results: page_counts(filter_pages(results, "warning", "Product")),
    "filtered by errors": lambda results: summary(filter_pages(results, "error")),
    "gate": quality_gate,
    "text report": summary_lines,
}


@pytest.mark.parametrize("name", COUNTED)
def test_counting_reports_make_no_messages(pages, name):
    counted = COUNTED[name](audit_pages(pages, messages=False))
    assert "format_string" not in plan(counted) and "should have" not in plan(counted)
    assert sorted(map(str, counted.collect())) == sorted(map(str, COUNTED[name](audit_pages(pages)).collect()))


def test_bounds_of_an_ordered_report_read_ids_alone(pages):
    assert count("ArrowEvalPython", audit_pages(pages).agg(F.percentile_approx("page_id", [0.5], 100))) == 0


@pytest.mark.parametrize("report", [summary, type_counts, summary_lines])
def test_reports_extract_once_and_combine_before_the_shuffle(pages, report):
    frame = report(audit_pages(pages))
    assert count("ArrowEvalPython", frame) == 1
    assert "partial_" in plan(frame)


def test_columns_and_filters_reach_the_scan(pages):
    frame = audit_pages(pages.filter("page_id > 5")).select("page_id", "url")
    text = plan(frame)
    assert "html" not in re.search(r"ReadSchema: (\S+)", text).group(1)
    assert "GreaterThan(page_id,5)" in text
    assert count("ArrowEvalPython", frame) == 0


def test_stream_gives_what_the_batch_gives(spark, stored, pages, tmp_path):
    stream = read_page_stream(spark, stored, max_files_per_trigger=1)
    running = audit_stream(stream, str(tmp_path / "out"), str(tmp_path / "progress"), shape=issues_table, available_now=True)
    running.awaitTermination()
    assert len(running.recentProgress) >= 4
    key = ["page_id", "issue_type", "path"]
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(*key).collect()), key=repr)
    assert got == sorted(map(tuple, issues_table(audit_pages(pages)).select(*key).collect()), key=repr)
    # Taking up the same progress again adds nothing.
    again = audit_stream(stream, str(tmp_path / "out"), str(tmp_path / "progress"), shape=issues_table, available_now=True)
    again.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(got)


def test_reader_needs_no_package_on_executors():
    """The function that goes to executors carries its code along."""
    from pyspark import cloudpickle

    from marklens.operators import elements

    assert b"_raw_end" in cloudpickle.dumps(elements._reader(True, True).func)


def test_no_value_is_bound_as_an_entry_of_an_array(pages):
    """Taking one entry out of a transformed array asks for the type of the whole transformation in each row."""
    for messages in (True, False):
        text = plan(audit_pages(pages, messages=messages))
        assert "lambdafunction" in text and "false))[0]" not in text


def test_pages_with_a_block_are_not_folded(pages):
    """Several tests of the folded page are one common expression, which Spark makes of every page, needed or not."""
    for links in (False, True):
        assert plan(read_pages(pages, links=links)).count("lower(html") == 1


def test_members_of_an_object_are_taken_out_once_for_each_place(pages):
    """An object's members tell that it is one, its type, context, graph and properties."""
    text = plan(pages.select(jsonld_items(F.from_json("html", f"array<{schemas.SCRIPT}>")).alias("items")))
    members = re.findall(r"try_variant_get\((lambda \w+#\d+), \$, MapType", text)
    assert text.count('$["@') == 0 and 2 <= len(set(members))
