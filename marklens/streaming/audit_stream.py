"""The audit on a stream of fetched pages.

Up to page results every step looks at one page alone, so the batch plan runs on a stream as it is: no state, no
watermark, and appended output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..plans.audit import audit_pages


def read_page_stream(spark: SparkSession, path: str, max_files_per_trigger: int = 1000) -> DataFrame:
    """Stream of fetched pages from a folder that Parquet files keep arriving in."""
    return (
        spark.readStream.schema(schemas.FETCHED_PAGES).option("maxFilesPerTrigger", max_files_per_trigger).parquet(path)
    )


def audit_stream(
    pages: DataFrame,
    sink: str,
    checkpoint: str,
    mode: str = "crawl",
    google_guidelines: bool = True,
    shape: Callable[[DataFrame], DataFrame] | None = None,
    available_now: bool = False,
) -> StreamingQuery:
    """Append audit results of a page stream to Parquet files, exactly once per page.

    `shape` turns page results into the table to keep, for example `issues_table`.
    """
    results = audit_pages(pages, mode, google_guidelines)
    writer = (shape(results) if shape else results).writeStream.format("parquet").outputMode("append")
    trigger = {"availableNow": True} if available_now else {"processingTime": "1 minute"}
    return writer.option("path", sink).option("checkpointLocation", checkpoint).trigger(**trigger).start()
