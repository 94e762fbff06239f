"""Page source: snapshots of fetched pages, and which of them are audited."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import normalise_url

MODES = ("crawl", "sitemap")
# Rows of a task: as few as the first while there are cores to use, and never more than the second.
FEWEST_ROWS, MOST_ROWS = 20_000, 500_000


def fetched_pages(
    source: DataFrame,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    status: str | None = None,
    content_type: str | None = None,
    fetch_error: str | None = None,
) -> DataFrame:
    """Bring any table of pages, batch or streaming, into the `schemas.FETCHED_PAGES` shape.

    Columns that the table lacks are filled as for a successful fetch of an HTML page.
    """

    def column(name: str | None, default: Column) -> Column:
        return default if name is None else F.col(name)

    return source.select(
        F.col(page_id).alias("page_id"),
        F.col(url).alias("url"),
        column(status, F.lit(200)).cast("int").alias("status"),
        column(content_type, F.lit("text/html")).alias("content_type"),
        F.col(html).alias("html"),
        column(fetch_error, F.lit(None)).cast("string").alias("fetch_error"),
    )


def spread(pages: DataFrame, tasks: int | None = None) -> DataFrame:
    """Give a small input with few file splits one partition per core; leave others as they are."""
    tasks = tasks or pages.sparkSession.sparkContext.defaultParallelism
    return pages if pages.rdd.getNumPartitions() >= tasks else pages.repartition(tasks)


def dealt_out(rows: DataFrame) -> DataFrame:
    """Slim rows that much work follows from, in tasks of equal numbers of rows.

    The splits of a file do not tell how its rows lie: all of them may be in one row group, which one task reads.
    """
    count = rows.count()
    most = max(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-count // MOST_ROWS))
    return rows.repartition(max(1, min(-(-count // FEWEST_ROWS), most)))


def is_html_response() -> Column:
    return (
        F.col("fetch_error").isNull()
        & (F.col("status") == 200)
        & F.coalesce(F.col("content_type"), F.lit("")).contains("text/html")
    )


def classify_pages(pages: DataFrame, mode: str = "crawl", *kept: str) -> DataFrame:
    """Pages that are reported on: `page_id`, `url`, `html` (NULL unless it is to be read) and `fetch_error`.

    Transport errors become rows with a `fetch_error`, and responses that are not HTML are dropped. Responses other
    than 200 are dropped in a crawl and become rows with a `fetch_error` in a sitemap run. A crawl knows pages by
    their normalised URL. Columns named in `kept` are passed on.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")
    failed = F.col("fetch_error").isNotNull()
    reported = failed | is_html_response()
    error = F.col("fetch_error")
    url = normalise_url(F.col("url"))
    if mode == "sitemap":
        bad_status = ~failed & (F.col("status") != 200)
        reported = reported | bad_status
        error = F.when(bad_status, F.concat(F.lit("HTTP "), F.col("status").cast("string"))).otherwise(error)
        url = F.col("url")
    return pages.filter(reported).select(
        "page_id",
        url.alias("url"),
        F.when(is_html_response(), F.col("html")).alias("html"),
        error.alias("fetch_error"),
        *kept,
    )
