"""Fetched pages to page results: one narrow pass, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import built_once, entries_of
from ..functions.urls import cut_fragment
from ..operators.elements import read_document
from ..operators.extract import all_items
from ..operators.validate import Form, conflict_issues, page_issues
from ..sources.pages import classify_pages

PAGE_RESULT_COLUMNS = ["page_id", "url", "fetch_error", "items", "errors", "warnings", "info"]


@built_once
def _items(with_raw: bool) -> Column:
    return all_items(F.col("document"), with_raw)


@built_once
def _issues(google_guidelines: bool, messages: bool) -> Column:
    return page_issues(F.col("items"), Form(messages), google_guidelines)


@built_once
def _conflicts(messages: bool) -> Column:
    return conflict_issues(F.col("items"), Form(messages))


def validate_items(pages: DataFrame, google_guidelines: bool = True, messages: bool = True) -> DataFrame:
    """Add `errors`, `warnings` and `info` to a table whose rows hold a page's `items`; without `messages`, as codes."""
    form = Form(messages)

    def of_severity(severity: str) -> Column:
        return F.filter("issues", lambda issue: form.has_severity(issue, severity))

    return (
        pages.withColumn("issues", _issues(google_guidelines, messages))
        .withColumn("errors", of_severity("error"))
        .withColumn("warnings", F.concat(of_severity("warning"), _conflicts(messages)))
        .withColumn("info", of_severity("info"))
        .drop("issues")
    )


def read_pages(pages: DataFrame, mode: str = "crawl", links: bool = False) -> DataFrame:
    """Classified pages with their `document`; with `links`, their `fetched` URL and `hrefs` from the same reading too."""
    if not links:
        return classify_pages(pages, mode).withColumn("document", read_document(F.col("html"))).drop("html")
    known = classify_pages(pages.withColumn("fetched", cut_fragment(F.col("url"))), mode, "fetched")
    read = known.withColumn("document", read_document(F.col("html"), links=True)).drop("html")
    return read.withColumn("hrefs", F.col("document.hrefs"))


def with_items(read: DataFrame, with_raw: bool = False) -> DataFrame:
    """Pages read, with the `items` of their `document` in its place."""
    found = read.withColumn("items", _items(with_raw)).withColumn(
        "fetch_error", F.coalesce("fetch_error", "document.error")
    )
    return found.drop("document")


def extract_pages(pages: DataFrame, mode: str = "crawl", with_raw: bool = False) -> DataFrame:
    """Classified pages with their `items`."""
    return with_items(read_pages(pages, mode), with_raw)


def audit_pages(
    pages: DataFrame,
    mode: str = "crawl",
    google_guidelines: bool = True,
    with_raw: bool = False,
    messages: bool = True,
) -> DataFrame:
    """Page results of fetched pages.

    Reports that only count (page counts, summary, filters, gate) need no messages: with `messages=False` the lists of
    issues hold a code per issue, ten times the check's number and the severity's rank, and no text is made.

    Works on batch and streaming DataFrames alike. Every step stays in the page's row, so the plan is a scan, one
    Arrow stage and projections: it scales with the number of input splits alone.
    """
    extracted = extract_pages(pages, mode, with_raw)
    return validate_items(extracted, google_guidelines, messages).select(*PAGE_RESULT_COLUMNS)


def items_table(results: DataFrame) -> DataFrame:
    """One row per item, numbered within its page."""
    return results.select(
        "page_id", "url", F.posexplode(entries_of("items")).alias("item_ord", "item")
    ).select("page_id", "url", "item_ord", "item.*")


def issues_table(results: DataFrame) -> DataFrame:
    """One row per issue; item_ord is NULL for page-level issues."""
    return results.select("page_id", "url", F.inline(F.concat("errors", "warnings", "info")))


def page_counts(results: DataFrame) -> DataFrame:
    """Issue counts per page."""
    errors, warnings, info = (F.size(c).cast("bigint") for c in ("errors", "warnings", "info"))
    return results.select(
        "page_id",
        "url",
        F.size("items").cast("bigint").alias("n_items"),
        errors.alias("n_errors"),
        warnings.alias("n_warnings"),
        info.alias("n_info"),
        (errors + warnings + info).alias("total_issues"),
        (errors > 0).alias("has_errors"),
    )

