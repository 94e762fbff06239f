"""Exact dedup by distributed MSD radix partitioning: groups are split by successive bytes until single or ended.

All texts begin in one group. A level reads the next digit of every open text, a run of bytes, and splits each group by
it. What is then alone in its group has no copy and leaves; what has ended in company has found its copies and leaves
too; the rest goes on, without the bytes read, to the next level. Groups are told apart by the bytes themselves, never
by a digest. Digits grow from level to level, so the number of levels follows the logarithm of the longest repeated
beginning, and a text's bytes are compared once.

Counting a digit combines on the map side, and the join that brings the counts back can be split, so copies that make
up a third of all rows are no hot key. The first level moves every text once; later ones only those still open.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import as_bytes, split_join, table

# Bytes of the first digit, and how many times longer each next one is. Of a corpus few texts share this many bytes
# without being copies; any numbers give the same groups.
FIRST_DIGIT = 256
GROWTH = 8


def _split(texts: DataFrame, level: int, digit: int) -> DataFrame:
    """One level: `row`, `id`, `keep_id`, `group_size`, `group` (level, number) and `rest`, NULL once a text is done."""
    read = texts.select(
        "row", "id", "part",
        F.expr(f"substring(rest, 1, {digit})").alias("digit"),
        (F.length("rest") <= digit).alias("ended"),
        F.expr(f"substring(rest, {digit + 1})").alias("rest"),
    )
    keys = ["part", "digit", "ended"]
    together = cut_lineage(
        read.groupBy(*keys).agg(F.count(F.lit(1)).alias("group_size"), F.max("id").alias("keep_id"))
        .filter("group_size > 1").withColumn("next", F.monotonically_increasing_id())
    )
    alone = F.col("next").isNull()
    return cut_lineage(
        split_join(read, together, keys, "left").select(
            "row", "id",
            F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
            F.when(~alone, F.struct(F.lit(level).alias("level"), F.col("next").alias("number"))).alias("group"),
            F.when(~alone & ~F.col("ended"), F.col("rest")).alias("rest"),
        )
    )


def copies(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", carried: list[str] | None = None,
    first_digit: int = FIRST_DIGIT, growth: int = GROWTH,
) -> DataFrame:
    """One row per input row: `row` (struct of the columns in `carried`, by default all), `id`, and its group.

    `keep_id` is the largest id among the rows of equal text, `group_size` their number, and `group` their key, NULL
    for a text without a copy. NULL texts count as empty and are equal to empty ones. Repeated rows count as often as
    they occur. A NULL id is less than any other; the `keep_id` of NULL ids alone is NULL. Names of other columns do
    not matter. An empty input gives an empty result.
    """
    row = F.struct(*[F.col(f"`{name}`") for name in (docs.columns if carried is None else carried)])
    opened = docs.select(row.alias("row"), F.col(id_column).alias("id"), F.lit(0).cast("bigint").alias("part"), as_bytes(text).alias("rest"))
    done, level, digit = [], 0, first_digit
    while True:
        split = _split(opened, level, digit)
        done.append(split.filter("rest IS NULL").drop("rest"))
        opened = split.filter("rest IS NOT NULL").select("row", "id", F.col("group.number").alias("part"), "rest")
        if opened.isEmpty():
            return reduce(DataFrame.unionByName, done)
        level, digit = level + 1, digit * growth


def without_copies(docs: DataFrame, id_column: str = "doc_id", text: str = "text", **digits: int) -> DataFrame:
    """One row of each group of equal texts, with all its columns: that of the largest id.

    Of rows that are equal in id and text one stays.
    """
    kept = copies(docs, id_column, text, **digits).filter("id <=> keep_id")
    single = kept.filter("group IS NULL").select("row")
    chosen = kept.filter("group IS NOT NULL").groupBy("group").agg(F.first("row").alias("row")).select("row")
    return single.unionByName(chosen).select(*[F.col(f"row.`{name}`") for name in docs.columns])


def op12_radix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("text_sha256", F.sha2(as_bytes("text"), 256))
    found = copies(docs, carried=["doc_id", "text_sha256"])
    return found.select("row.doc_id", "keep_id", "group_size", F.expr("id <=> keep_id").alias("kept"), "row.text_sha256")


OP12_SQL = """
SELECT doc_id, max(doc_id) OVER copies AS keep_id, count(*) OVER copies AS group_size,
  doc_id IS NOT DISTINCT FROM max(doc_id) OVER copies AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW copies AS (PARTITION BY coalesce(text, ''))
"""
