"""Exact distributed limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

SMALL_LIMIT = 10_000


def first_rows(df: DataFrame, limit: int, *order: str | Column) -> DataFrame:
    """The first `limit` rows in the given total order.

    A small limit is a top-k. A large one must not pass through a single task: rows are range-partitioned by the
    order, the partitions are counted, and only the partition in which the limit falls is cut.
    """
    if limit <= 0:
        return df.limit(0)
    if limit <= SMALL_LIMIT:
        return df.orderBy(*order).limit(limit)
    ranged = cut_lineage(
        df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    )
    sizes = {row["_part"]: row["count"] for row in ranged.groupBy("_part").count().collect()}
    taken, cut_part = 0, None
    for part in sorted(sizes):
        if taken + sizes[part] > limit:
            cut_part = part
            break
        taken += sizes[part]
    if cut_part is None:
        return ranged.drop("_part")
    whole = ranged.filter(F.col("_part") < cut_part)
    rest = ranged.filter(F.col("_part") == cut_part).orderBy(*order).limit(limit - taken)
    return whole.unionByName(rest).drop("_part")
