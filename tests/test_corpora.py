"""How the pages of a table are dealt to tasks."""

from pyspark.sql import functions as F

from catalogue import corpora as C
from marklens import audit_pages
from marklens.sources import pages


def test_unequal_files_give_equal_tasks(spark, monkeypatch, tmp_path):
    """One large file among as many small ones as there are cores."""
    monkeypatch.setattr(pages, "FEWEST_ROWS", 100, raising=False)
    columns = [F.col("id").alias("o_orderkey"), F.lit("1996-01-02").cast("date").alias("o_orderdate"), F.lit("1-URGENT").alias("o_orderpriority")]
    orders = str(tmp_path / "orders.parquet")
    spark.range(0, 2_000, 1, 1).select(*columns).write.parquet(orders)
    spark.range(2_000, 2_020, 1, 20).select(*columns).write.mode("append").parquet(orders)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # each file is a split of its own, or several
    try:
        _check(spark, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def _check(spark, folder):
    built = C.articles(spark, folder)
    sizes = [r["count"] for r in built.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 2_020 and max(sizes) <= 2_020 / 4
    assert built.select("page_id").distinct().count() == 2_020
    twice = audit_pages(C._together(C.articles, C.articles)(spark, folder), messages=False)
    assert twice._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert twice.count() == 4_040
