import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from marklens import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("marklens-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture(scope="session")
def pages_of(spark):
    """Fetched pages out of `{name: html}`; the page's URL ends in its name."""

    def build(html_by_name):
        rows = [
            (number, f"https://example.com/{name}", 200, "text/html", html, None)
            for number, (name, html) in enumerate(html_by_name.items())
        ]
        from marklens import schemas

        return spark.createDataFrame(rows, schemas.FETCHED_PAGES)

    return build
