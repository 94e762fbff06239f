"""Report filters and the quality gate over page results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import keep_rows
from ..rules import SEVERITY_RANK


def _wanted_types(schema_types: str) -> list[str]:
    return sorted({name.strip() for name in schema_types.split(",")})


def _kept_lists(results: DataFrame, severity: str | None) -> dict[str, Column]:
    """The issue lists at or above the minimum severity; the others become empty."""
    lowest = SEVERITY_RANK.get(severity, 0) if severity else 0
    lists = {"errors": "error", "warnings": "warning", "info": "info"}
    return {
        column: F.col(column) if SEVERITY_RANK[name] >= lowest else F.array().cast(results.schema[column].dataType)
        for column, name in lists.items()
    }


def _has_type(schema_types: str | None) -> Column:
    if not schema_types:
        return F.lit(True)
    wanted = _wanted_types(schema_types)
    return F.exists("items", lambda item: item["schema_type"].isin(wanted))


def filter_pages(results: DataFrame, severity: str | None = None, schema_types: str | None = None) -> DataFrame:
    """Pages that still have an issue once a minimum severity and a list of item types are applied.

    Without any filter the pages pass unchanged; with one, pages without a remaining issue go, failed fetches
    included. The type filter compares whole type texts and leaves a page's items as they are. Both tests look only
    at the page's own row, so nothing is joined or shuffled.
    """
    if not severity and not schema_types:
        return results
    kept = _kept_lists(results, severity)
    narrowed = results.withColumns(kept)
    remaining = F.size("errors") + F.size("warnings") + F.size("info")
    return keep_rows(narrowed, _has_type(schema_types) & (remaining > 0))


def quality_gate(results: DataFrame, severity: str | None = None, schema_types: str | None = None) -> DataFrame:
    """One row: `gate` is 2 when there are no pages at all, 1 when a filtered page has errors, else 0."""
    failing = (F.size("errors") > 0) & _has_type(schema_types)
    return results.agg(
        F.count(F.lit(1)).alias("pages"), F.count_if(failing).alias("failing_pages")
    ).select(
        "pages",
        "failing_pages",
        F.when(F.col("pages") == 0, 2).when(F.col("failing_pages") > 0, 1).otherwise(0).alias("gate"),
    )
