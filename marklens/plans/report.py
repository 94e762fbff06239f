"""Summary, flat rows, text and JSON lines of page results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.columns import entries_of
from ..functions.overflow import item_json, quoted
from ..rules import JSON_LD
from ..session import cut_lineage

COUNTERS = [
    "total_pages",
    "pages_with_schema",
    "pages_without_schema",
    "pages_with_errors",
    "total_schemas",
    "total_errors",
    "total_warnings",
    "total_info",
]


def _page_measures() -> dict[str, Column]:
    """What one page adds to each counter."""
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")

    def length(column: str) -> Column:
        return F.size(column).cast("bigint")

    return {
        "total_pages": one,
        "pages_with_schema": F.when(F.size("items") > 0, one).otherwise(zero),
        "pages_without_schema": F.when(F.size("items") > 0, zero).otherwise(one),
        "pages_with_errors": F.when(F.size("errors") > 0, one).otherwise(zero),
        "total_schemas": length("items"),
        "total_errors": length("errors"),
        "total_warnings": length("warnings"),
        "total_info": length("info"),
    }


def _pass_rate() -> Column:
    """In per cent, to one decimal; a tie goes to the even digit."""
    passing = F.col("total_pages") - F.col("pages_with_errors")
    return F.coalesce(F.bround(F.lit(100.0) * F.try_divide(passing, F.col("total_pages")), 1), F.lit(0.0))


def counters(results: DataFrame) -> list[Column]:
    """The counters as aggregates of page results."""
    return [F.coalesce(F.sum(column), F.lit(0).cast("bigint")).alias(name) for name, column in _page_measures().items()]


def with_pass_rate(counted: DataFrame) -> DataFrame:
    return counted.withColumn("pass_rate", _pass_rate())


def summary(results: DataFrame) -> DataFrame:
    """One row of counters and the pass rate; all zero for no pages. A failed fetch has no errors, so it passes."""
    return with_pass_rate(results.agg(*counters(results)))


# Where something was seen: page and item as one number, whose minimum is combined on the map side like any other.
_ITEMS_A_PAGE = 1 << 31


def _place(item_ord: Column) -> Column:
    return F.col("page_id").cast("decimal(20,0)") * F.lit(_ITEMS_A_PAGE).cast("decimal(10,0)") + item_ord


def _seen_at(place: str) -> list[Column]:
    """`first_page` and `first_item` of a place."""
    page = F.floor(F.col(place) / F.lit(_ITEMS_A_PAGE).cast("decimal(10,0)")).cast("bigint")
    item = (F.col(place) - page.cast("decimal(20,0)") * F.lit(_ITEMS_A_PAGE).cast("decimal(10,0)")).cast("int")
    return [page.alias("first_page"), item.alias("first_item")]


def _counts(results: DataFrame, field: str) -> DataFrame:
    return (
        results.select("page_id", F.posexplode(entries_of(f"items.{field}")).alias("item_ord", field))
        .select(field, _place(F.col("item_ord")).alias("place"))
        .groupBy(field)
        .agg(F.count(F.lit(1)).alias("n_items"), F.min("place").alias("place"))
        .select(field, "n_items", *_seen_at("place"))
        .orderBy(F.desc("n_items"), "first_page", "first_item")
    )


def type_counts(results: DataFrame) -> DataFrame:
    """Items per full type text, most frequent first, ties in the order they were first seen, by page and item."""
    return _counts(results, "schema_type")


def format_counts(results: DataFrame) -> DataFrame:
    """Items per format, most frequent first, ties in the order they were first seen, by page and item."""
    return _counts(results, "schema_format")


def tallies(results: DataFrame) -> DataFrame:
    """Page counters, type counts and format counts in one pass: `kind`, `name`, the summed counters, and where a type
    or format was first seen, `first_page` and `first_item`.

    Reports that show all three would otherwise extract every page three times. The sums are combined on the map
    side, so a type that most items share is no hot key.
    """
    measures = _page_measures()
    nothing = F.lit(0).cast("bigint")

    def row(kind: str, name: Column, values: dict[str, Column], place: Column | None = None) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"),
            name.alias("name"),
            (F.lit(0) if place is None else place).cast("decimal(32,0)").alias("place"),
            *[values.get(counter, nothing).alias(counter) for counter in COUNTERS],
        )

    one = {"total_schemas": F.lit(1).cast("bigint")}
    rows = F.concat(
        F.array(row("pages", F.lit(""), measures)),
        F.transform("items", lambda item, at: row("type", item["schema_type"], one, _place(at))),
        F.transform("items", lambda item, at: row("format", item["schema_format"], one, _place(at))),
    )
    # Without any page there is still a row of zeros to report.
    none = results.sparkSession.range(1).select(F.inline(F.array(row("pages", F.lit(""), {}))))
    return (
        results.select(F.inline(rows))
        .unionByName(none)
        .groupBy("kind", "name")
        .agg(*[F.sum(name).alias(name) for name in COUNTERS], F.min("place").alias("place"))
        .select("kind", "name", *COUNTERS, *_seen_at("place"))
    )


def report_rows(results: DataFrame) -> DataFrame:
    """Flat report: a failed fetch is one row and replaces all else; else issues by severity, then one row per item.

    `row_ord` numbers the rows of a page in report order.
    """
    blank = F.lit("")

    def row(severity: Column, kind: Column, message: Column, *rest: Column) -> Column:
        values = [severity, kind, message, *rest]
        return F.struct(*[v.alias(name) for v, name in zip(values, schemas.REPORT_COLUMNS[1:], strict=True)])

    def issue_row(issue: Column) -> Column:
        return row(
            issue["severity"],
            issue["issue_type"],
            issue["message"],
            F.coalesce(issue["path"], blank),
            F.coalesce(issue["schema_ref"], blank),
            blank,
            blank,
        )

    def item_row(item: Column) -> Column:
        return row(
            F.lit("schema_found"),
            blank,
            F.concat(F.lit("Found "), item["schema_type"], F.lit(" ("), item["schema_format"], F.lit(")")),
            blank,
            blank,
            item["schema_type"],
            item["schema_format"],
        )

    failure = row(F.lit("error"), F.lit("fetch_error"), F.col("fetch_error"), blank, blank, blank, blank)
    issues = F.concat("errors", "warnings", "info")
    rows = F.when(F.col("fetch_error").isNotNull(), F.array(failure)).otherwise(
        F.concat(F.transform(issues, issue_row), F.transform("items", item_row))
    )
    return results.select("page_id", "url", F.posexplode(rows).alias("row_ord", "row")).select(
        "page_id", "url", "row_ord", "row.*"
    )


def issue_listing(results: DataFrame) -> DataFrame:
    """Rows of the terminal listing: URL cut to 50 characters, upper-case severity, no item rows."""
    rows = report_rows(results).filter("severity <> 'schema_found'")
    return rows.select(
        F.substring("url", 1, 50).alias("url"), F.upper("severity").alias("severity"), "issue_type", "message"
    )


# --- fixed values: lines of the text summary ----------------------------------------------------

TITLE_LINE = "═══ Structured Data Validation Report ═══"
SUMMARY_LINES = [
    ("  Pages crawled:        ", "total_pages", ""),
    ("  Pages with schema:    ", "pages_with_schema", ""),
    ("  Pages without schema: ", "pages_without_schema", ""),
    ("  Pages with errors:    ", "pages_with_errors", ""),
    ("  Pass rate:            ", "pass_rate", "%"),
    ("", None, ""),
    ("  Total schemas found:  ", "total_schemas", ""),
    ("  Total errors:         ", "total_errors", ""),
    ("  Total warnings:       ", "total_warnings", ""),
    ("  Total info:           ", "total_info", ""),
]
COUNT_TITLES = {"type": "  Schema Types:", "format": "  Formats:"}


def summary_lines(results: DataFrame) -> DataFrame:
    """Text summary as rows `section`, `ord`, `first_page`, `first_item`, `name`, `line`, in that order.

    Section 0 holds the counters, 1 the types, 2 the formats, the last two only where there are items. Within a
    section of counts, `ord` is the negated count; equal counts follow where they were first seen.
    """

    def line(section: int | Column, order: int | Column, name: Column, text: Column) -> Column:
        counted = isinstance(order, Column)
        return F.struct(
            (section if isinstance(section, Column) else F.lit(section)).alias("section"),
            (order if counted else F.lit(order).cast("bigint")).alias("ord"),
            (F.col("first_page") if counted else F.lit(0).cast("bigint")).alias("first_page"),
            (F.col("first_item") if counted else F.lit(0)).alias("first_item"),
            name.alias("name"),
            text.alias("line"),
        )

    def shown(label: str, counter: str | None, unit: str) -> Column:
        return F.lit(label) if counter is None else F.concat(F.lit(label), F.col(counter).cast("string"), F.lit(unit))

    unnamed = F.lit("")
    fixed = [line(0, 0, unnamed, F.lit(TITLE_LINE)), line(0, 1, unnamed, F.lit(""))]
    fixed += [line(0, at, unnamed, shown(*entry)) for at, entry in enumerate(SUMMARY_LINES, start=2)]
    # Titles sort before any negated count.
    before_all = -(2**62)
    titles = []
    for section, title in enumerate(COUNT_TITLES.values(), start=1):
        titles += [
            line(section, before_all, unnamed, F.lit("")),
            line(section, before_all + 1, unnamed, F.lit(title)),
        ]
    count = line(
        F.when(F.col("kind") == "type", 1).otherwise(2),
        -F.col("total_schemas"),
        F.col("name"),
        F.concat(F.lit("    "), "name", F.lit(": "), F.col("total_schemas").cast("string")),
    )
    lines = (
        F.when(F.col("kind") != "pages", F.array(count))
        .when(F.col("total_schemas") > 0, F.array(*fixed, *titles))
        .otherwise(F.array(*fixed))
    )
    counted = tallies(results).withColumn("pass_rate", _pass_rate())
    return counted.select(F.inline(lines)).orderBy("section", "ord", "first_page", "first_item")


def page_json(results: DataFrame, pretty: bool = False) -> DataFrame:
    """One JSON object per page: `page_id`, `url`, `json`.

    Values too large for a VARIANT are written whole from their overflow; a page that has some is one line.
    """
    options = {"ignoreNullFields": "false"}

    def issues(column: str) -> Column:
        fields = ["issue_type", "severity", "message", "path", "schema_ref"]
        return F.transform(column, lambda i: F.struct(*[i[name].alias(name) for name in fields])).alias(column)

    def shown(item: Column) -> Column:
        return F.struct(
            item["schema_format"].alias("schema_format"),
            item["schema_type"].alias("schema_type"),
            item["properties"].alias("properties"),
            item["raw"].alias("raw"),
            F.col("url").alias("source_url"),
            item["context"].alias("context"),
            item["is_graph_item"].alias("is_graph_item"),
        )

    def whole_item(item: Column) -> Column:
        return F.when(item["overflow"].isNull(), F.to_json(shown(item), options)).otherwise(
            item_json(item, F.col("url"), JSON_LD)
        )

    rest = [issues("errors"), issues("warnings"), issues("info"), F.col("fetch_error")]
    page = F.struct("url", F.transform("items", shown).alias("structured_data"), *rest)
    whole = F.concat(
        F.lit('{"url":'), quoted(F.col("url")),
        F.lit(',"structured_data":['), F.array_join(F.transform("items", whole_item), ","),
        F.lit("],"), F.substring(F.to_json(F.struct(*rest), options), F.lit(2), F.lit(2**31 - 1)),
    )
    has_overflow = F.exists("items", lambda item: item["overflow"].isNotNull())
    json = F.when(has_overflow, whole).otherwise(F.to_json(page, options | {"pretty": str(pretty).lower()}))
    return results.select("page_id", "url", json.alias("json"))


def document_lines(results: DataFrame, pretty: bool = True) -> DataFrame:
    """The whole JSON report as lines `section`, `ord`, `at`, `line`: read in order, they are one JSON document.

    Types and formats come in the order they were first seen.

    No line holds more than one page, type or format, so the document may be of any size: it is never gathered in
    one row or task.
    """
    # Read three times below; its rows are as few as there are types.
    counted = cut_lineage(tallies(results))
    totals = counted.filter("kind = 'pages'").withColumn("pass_rate", _pass_rate())

    def line(section: int, text: Column) -> Column:
        return F.struct(
            F.lit(section).alias("section"), F.lit(0).cast("bigint").alias("ord"), F.lit(0).alias("at"), text.alias("line"),
        )

    counters = [F.concat(F.lit(f'"{name}": '), F.col(name).cast("string"), F.lit(", ")) for name in COUNTERS]
    frame = totals.select(
        F.inline(
            F.array(
                line(0, F.concat(F.lit('{"summary": {'), *counters, F.lit('"schema_type_counts": {'))),
                line(2, F.lit('}, "format_counts": {')),
                line(4, F.concat(F.lit('}, "pass_rate": '), F.col("pass_rate").cast("string"), F.lit('}, "pages": ['))),
                line(6, F.lit("]}")),
            )
        )
    )

    def comma(is_first: Column) -> Column:
        return F.when(is_first, F.lit("")).otherwise(F.lit(", "))

    named = counted.filter(F.col("kind").isin(list(COUNT_TITLES)))
    # The first entry of each list goes without a comma. Both lookups are one row per list.
    firsts = named.groupBy("kind").agg(F.min(F.struct("first_page", "first_item")).alias("first"))
    counts = named.join(F.broadcast(firsts), "kind").select(
        F.when(F.col("kind") == "type", 1).otherwise(3).alias("section"),
        F.col("first_page").alias("ord"),
        F.col("first_item").alias("at"),
        F.concat(
            comma((F.col("first_page") == F.col("first.first_page")) & (F.col("first_item") == F.col("first.first_item"))),
            F.to_json(F.create_map(F.col("name"), F.col("total_schemas"))).substr(F.lit(2), F.lit(2**31 - 1)),
        ).alias("entry"),
    ).select("section", "ord", "at", F.regexp_replace("entry", r"\}$", "").alias("line"))

    # Reads the page ids alone.
    first_page = results.agg(F.min("page_id").alias("first_page")).first()["first_page"]
    pages = page_json(results, pretty).select(
        F.lit(5).alias("section"),
        F.col("page_id").cast("bigint").alias("ord"),
        F.lit(0).alias("at"),
        F.concat(comma(F.col("page_id") == F.lit(first_page)), "json").alias("line"),
    )
    return frame.unionByName(counts).unionByName(pages).orderBy("section", "ord", "at")
