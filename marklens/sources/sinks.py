"""Report sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .. import schemas
from ..functions.columns import places_below
from ..plans.report import COUNTERS, counters, document_lines, page_json, report_rows, summary_lines, with_pass_rate
from ..session import cut_lineage


def _by_page(results: DataFrame) -> DataFrame:
    """The results dealt to tasks in ranges of page ids, which are known before any page is read.

    The bounds come from the id column alone; a page's place among them is found by bisection. So the pages are read
    once and shuffled once, without a sample of their results.
    """
    parts = int(results.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = [part / parts for part in range(1, parts)]
    found = results.agg(F.percentile_approx("page_id", shares, 100 * parts)).first()[0] if shares else None
    if not found:  # one partition, or no pages
        return results.coalesce(1)
    bounds = sorted({*found})
    part = places_below(F.array(*map(F.lit, bounds)), len(bounds), F.col("page_id"))
    return results.withColumn("_part", part).repartitionById(parts, F.col("_part")).drop("_part")


def write_csv(results: DataFrame, path: str, ordered: bool = False, mode: str = "errorifexists") -> None:
    """Flat report as CSV with a header per part file, each page's rows together and in report order.

    `ordered` sorts all rows by page: the part files, in name order, are the report.
    """
    rows = report_rows(_by_page(results).sortWithinPartitions("page_id") if ordered else results)
    (
        rows.select(*schemas.REPORT_COLUMNS)
        .write.mode(mode)
        .options(header=True, escape='"', emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False,
                 ignoreTrailingWhiteSpace=False)
        .csv(path)
    )


def write_json_lines(results: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Pages as one JSON object per line under `pages`, the counters under `summary`: the sink for large runs.

    The pages are read once: the counters are observed while the lines are written.
    """
    observed = Observation()
    page_json(results.observe(observed, *counters(results))).select("json").write.mode(mode).text(f"{path}/pages")
    counted = results.sparkSession.createDataFrame(
        [tuple(observed.get[name] for name in COUNTERS)], ", ".join(f"{name} bigint" for name in COUNTERS)
    )
    with_pass_rate(counted).write.mode(mode).json(f"{path}/summary")


def write_json_document(results: DataFrame, path: str, pretty: bool = True, mode: str = "errorifexists") -> None:
    """The report as one JSON document: the part files, joined in name order, are the document.

    Tallies, sampling and output read page results that are computed once.
    """
    document_lines(cut_lineage(results), pretty).select("line").write.mode(mode).text(path)


def write_text(results: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The text summary; the part files, joined in name order, are the text."""
    summary_lines(results).select("line").write.mode(mode).text(path)
