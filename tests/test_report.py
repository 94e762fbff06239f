"""Classification, filters, gate, summary and sinks."""

import csv
import glob
import json

import pytest
from pyspark.sql import functions as F

from marklens import (
    audit_pages, filter_pages, format_counts, issue_listing, page_counts, quality_gate, report_rows, schemas,
    summary, summary_lines, type_counts, write_csv, write_json_document, write_json_lines, write_text,
)
from marklens.functions.columns import places_below

GOOD = '{"@type": "Organization", "name": "Acme, \\"Inc\\"\\u00e9"}'
PRODUCT = '{"@type": "Product", "name": "W", "image": "https://e.com/i"}'
PAGES = [
    (1, "http://h/good/", 200, "text/html; charset=utf-8", [GOOD], None),
    (2, "http://h/bad", 200, "text/html", ["{bad", PRODUCT], None),
    (3, "http://h/plain#x", 200, "text/html", [], None),
    (4, "http://h/gone", 404, "text/html", [GOOD], None),
    (5, "http://h/pdf", 200, "application/pdf", [GOOD], None),
    (6, "http://h/upper", 200, "TEXT/HTML", [GOOD], None),
    (7, "http://h/none", 200, None, [GOOD], None),
    (8, "http://h/timeout", None, None, [], "Timeout"),
    (9, "http://h/silent", None, None, [], ""),
    (10, "http://h/odd-with-a-url-that-is-longer-than-fifty-characters", 200, "text/html", ['{"@type": "Odd, Type"}'], None),
]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [
        (*row[:4], "".join(f'<script type="application/ld+json">{block}</script>' for block in row[4]), row[5]) for row in PAGES
    ]
    return spark.createDataFrame(rows, schemas.FETCHED_PAGES)


@pytest.fixture(scope="module")
def results(pages):
    return audit_pages(pages, with_raw=True).cache()


def ids(frame):
    return sorted(row["page_id"] for row in frame.select("page_id").collect())


def test_crawl_mode(results):
    rows = {r["page_id"]: (r["url"], r["fetch_error"]) for r in results.collect()}
    assert rows == {
        1: ("http://h/good", None), 2: ("http://h/bad", None), 3: ("http://h/plain", None), 8: ("http://h/timeout", "Timeout"),
        9: ("http://h/silent", ""), 10: (PAGES[9][1], None),
    }


def test_sitemap_mode(pages):
    rows = {r["page_id"]: (r["url"], r["fetch_error"]) for r in audit_pages(pages, "sitemap").collect()}
    assert rows[4] == ("http://h/gone", "HTTP 404") and rows[1] == ("http://h/good/", None)
    assert set(rows) == {1, 2, 3, 4, 8, 9, 10}
    with pytest.raises(ValueError, match="mode"):
        audit_pages(pages, "other")


def test_page_counts(results):
    rows = {r["page_id"]: r for r in page_counts(results).collect()}
    assert (rows[2]["n_items"], rows[2]["n_errors"], rows[2]["n_warnings"], rows[2]["total_issues"], rows[2]["has_errors"]) == (2, 1, 1, 2, True)
    assert (rows[1]["total_issues"], rows[1]["has_errors"]) == (0, False)


@pytest.mark.parametrize(
    ("severity", "kinds", "expected"),
    [
        (None, None, [1, 2, 3, 8, 9, 10]),
        ("", "", [1, 2, 3, 8, 9, 10]),
        ("error", None, [2]),
        ("warning", None, [2, 10]),
        ("info", None, [2, 10]),
        (None, "Product", [2]),
        (None, " Organization , Product ", [2]),
        (None, "Odd", []),
        ("error", "Odd, Type", []),
    ],
)
def test_filter(results, severity, kinds, expected):
    assert ids(filter_pages(results, severity, kinds)) == expected


def test_filter_keeps_items_and_drops_lower_issues(results):
    (row,) = filter_pages(results, "error", "Product").collect()
    assert (len(row["items"]), len(row["errors"]), row["warnings"], row["info"]) == (2, 1, [], [])


def test_gate(results):
    def gate(frame, *options):
        return quality_gate(frame, *options).first()["gate"]

    assert gate(results) == 1
    assert gate(results, "error", "Product") == 1
    assert gate(results, None, "Organization") == 0
    assert gate(results.filter("page_id <> 2")) == 0
    assert gate(results.limit(0)) == 2


def test_summary(results):
    row = summary(results).first().asDict()
    assert row == {
        "total_pages": 6, "pages_with_schema": 3, "pages_without_schema": 3, "pages_with_errors": 1, "total_schemas": 4,
        "total_errors": 1, "total_warnings": 2, "total_info": 1, "pass_rate": 83.3,
    }
    assert set(summary(results.limit(0)).first().asDict().values()) == {0}
    # Equal counts follow where they were first seen.
    assert [tuple(r) for r in type_counts(results).collect()] == [
        ("Organization", 1, 1, 0), ("MalformedJSON-LD", 1, 2, 0), ("Product", 1, 2, 1), ("Odd, Type", 1, 10, 0)
    ]
    assert [tuple(r) for r in format_counts(results).collect()] == [("json-ld", 4, 1, 0)]


def test_pass_rate_rounds_ties_to_even(results):
    """1 of 80 pages passes: 1.25 per cent."""
    bad, good = results.filter("page_id = 2"), results.filter("page_id = 1")
    failing = bad.crossJoin(bad.sparkSession.range(79)).drop("id")
    assert summary(failing.unionByName(good)).first()["pass_rate"] == 1.2


def test_report_rows(results):
    rows = [r for r in report_rows(results).orderBy("page_id", "row_ord").collect() if r["page_id"] in (2, 8, 9)]
    assert [(r["page_id"], r["severity"], r["issue_type"], r["message"], r["schema_type"]) for r in rows] == [
        (2, "error", "malformed_json_ld", "JSON-LD block contains invalid JSON", ""),
        (2, "warning", "missing_required_property", "Product should have 'offers' or 'price' for rich results", ""),
        (2, "schema_found", "", "Found MalformedJSON-LD (json-ld)", "MalformedJSON-LD"),
        (2, "schema_found", "", "Found Product (json-ld)", "Product"),
        (8, "error", "fetch_error", "Timeout", ""),
        (9, "error", "fetch_error", "", ""),
    ]


def test_issue_listing(results):
    rows = issue_listing(results).collect()
    assert {r["severity"] for r in rows} == {"ERROR", "WARNING", "INFO"}
    assert max(len(r["url"]) for r in rows) == 50


def test_text(results, tmp_path):
    write_text(results, str(tmp_path / "text"))
    text = "".join(open(f, encoding="utf8").read() for f in sorted(glob.glob(str(tmp_path / "text" / "part-*"))))
    assert text.splitlines() == [
        "═══ Structured Data Validation Report ═══", "", "  Pages crawled:        6", "  Pages with schema:    3",
        "  Pages without schema: 3", "  Pages with errors:    1", "  Pass rate:            83.3%", "", "  Total schemas found:  4",
        "  Total errors:         1", "  Total warnings:       2", "  Total info:           1", "", "  Schema Types:",
        "    Organization: 1", "    MalformedJSON-LD: 1", "    Product: 1", "    Odd, Type: 1", "", "  Formats:", "    json-ld: 4",
    ]
    empty = [r["line"] for r in summary_lines(results.limit(0)).collect()]
    assert len(empty) == 12 and "  Pass rate:            0.0%" in empty


def test_csv(results, tmp_path):
    write_csv(results, str(tmp_path / "csv"), ordered=True)
    rows = []
    for file in sorted(glob.glob(str(tmp_path / "csv" / "part-*"))):
        with open(file, encoding="utf8", newline="") as handle:
            header, *body = list(csv.reader(handle))
            assert header == schemas.REPORT_COLUMNS
            rows += body
    assert len(rows) == report_rows(results).count()
    assert rows[0] == ["http://h/good", "schema_found", "", "Found Organization (json-ld)", "", "", "Organization", "json-ld"]
    assert ["http://h/timeout", "error", "fetch_error", "Timeout", "", "", "", ""] in rows


def test_ordered_csv_is_dealt_by_page_ids(spark, tmp_path):
    """Ids far apart, negative and unevenly spread; the part files in name order hold the pages in order."""
    ids_ = [*range(-50, 0), *range(10, 400, 3), 10**12, 10**15, -(10**14)]
    rows = [(i, f"http://h/{i}", 200, "text/html", f'<script type="application/ld+json">{PRODUCT}</script>', None) for i in reversed(ids_)]
    found = audit_pages(spark.createDataFrame(rows, schemas.FETCHED_PAGES).repartition(5))
    write_csv(found, str(tmp_path / "csv"), ordered=True)
    urls, files = [], sorted(glob.glob(str(tmp_path / "csv" / "part-*")))
    for file in files:
        with open(file, encoding="utf8", newline="") as handle:
            urls += [row[0] for row in list(csv.reader(handle))[1:]]
    assert list(dict.fromkeys(urls)) == [f"http://h/{i}" for i in sorted(ids_)]
    assert len(urls) == report_rows(found).count() and len(files) > 4
    write_csv(found.limit(0), str(tmp_path / "none"), ordered=True)


def test_counters_are_observed_while_lines_are_written(spark, pages, results, tmp_path, monkeypatch):
    """The pages are read by one query, and nothing is kept in between."""
    checkpoints = []
    monkeypatch.setattr(type(results), "checkpoint", lambda df, **_: checkpoints.append(df) or df)
    write_json_lines(audit_pages(pages, with_raw=True), str(tmp_path / "lines"))
    assert not checkpoints
    assert spark.read.json(str(tmp_path / "lines" / "summary")).first().asDict() == summary(results).first().asDict()
    assert spark.read.text(str(tmp_path / "lines" / "pages")).count() == results.count()


def test_places_below_counts_smaller_entries(spark):
    values = [-7, 0, 0, 3, 8, 8, 9]
    rows = spark.range(-10, 12).select("id", places_below(F.array(*map(F.lit, values)), len(values), F.col("id")).alias("n"))
    assert [r["n"] for r in rows.orderBy("id").collect()] == [sum(v < i for v in values) for i in range(-10, 12)]


@pytest.mark.parametrize("pretty", [True, False])
def test_json_document(results, tmp_path, pretty):
    write_json_document(results, str(tmp_path / "json"), pretty)
    document = json.loads("".join(open(f, encoding="utf8").read() for f in sorted(glob.glob(str(tmp_path / "json" / "part-*")))))
    assert list(document) == ["summary", "pages"]
    assert [*document["summary"]["schema_type_counts"].items()] == [
        ("Organization", 1), ("MalformedJSON-LD", 1), ("Product", 1), ("Odd, Type", 1)
    ]
    assert document["summary"]["pass_rate"] == 83.3
    assert [p["url"] for p in document["pages"]] == [r["url"] for r in results.orderBy("page_id").collect()]
    good, bad = document["pages"][:2]
    assert good == {
        "url": "http://h/good",
        "structured_data": [
            {
                "schema_format": "json-ld", "schema_type": "Organization", "properties": {"name": 'Acme, "Inc"é'},
                "raw": {"@type": "Organization", "name": 'Acme, "Inc"é'}, "source_url": "http://h/good", "context": None,
                "is_graph_item": False,
            }
        ],
        "errors": [], "warnings": [], "info": [], "fetch_error": None,
    }
    assert bad["structured_data"][0]["raw"] == "{bad"
    assert bad["errors"] == [
        {
            "issue_type": "malformed_json_ld", "severity": "error", "message": "JSON-LD block contains invalid JSON", "path": None,
            "schema_ref": "MalformedJSON-LD",
        }
    ]


def test_json_document_of_nothing(results, tmp_path):
    write_json_document(results.limit(0), str(tmp_path / "json"))
    document = json.loads("".join(open(f, encoding="utf8").read() for f in sorted(glob.glob(str(tmp_path / "json" / "part-*")))))
    assert document["pages"] == [] and document["summary"]["total_pages"] == 0


def test_json_lines(spark, results, tmp_path):
    write_json_lines(results, str(tmp_path / "lines"))
    assert spark.read.json(str(tmp_path / "lines" / "pages")).count() == 6
    assert spark.read.json(str(tmp_path / "lines" / "summary")).first()["total_pages"] == 6
    nulls = spark.read.text(str(tmp_path / "lines" / "pages")).filter(F.col("value").contains('"fetch_error":null')).count()
    assert nulls == 4
