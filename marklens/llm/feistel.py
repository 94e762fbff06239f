"""Sharding by a Feistel permutation of global row numbers, with cycle walking: a shuffle anyone can recompute.

Rows get numbers 0 to n - 1 without meeting in one task: they are dealt to hash buckets, counted per bucket, and
numbered within it from where the buckets before it end. A keyed Feistel network on a grid just large enough for n
numbers permutes them; a number that lands outside is walked on until it is inside again. The permuted number alone
gives the shard (its remainder) and the slot (its quotient), so shard sizes differ by one at most and slots have no
gaps. Everything is Spark SQL functions; only ids, sizes and checksums are shuffled, never texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

SHARDS = 8
SEED = 20_240_229
ROUNDS = 4
# Buckets for numbering; their table is broadcast, and this bounds it.
BUCKETS = 4_096
# Copies of one row that are unfolded at a time.
UNFOLDED = 4_096
# Fewer numbers than the grid has rows lie outside, and a walk meets each once: up to 4,096 rows (64 * 64) no walk is
# longer; beyond, a step stays outside with a chance below 1 / 64, and a walk of 65 steps would be an error, not a loss.
WALK = 64


def _network(number: str, rounds: int, seed: int) -> str:
    """SQL of the permutation of 0 .. high * low - 1; each round adds to one half what the other half hashes to."""
    high = f"((s.h + pmod(xxhash64(s.l, i, {seed}L), high)) % high)"
    low = f"((s.l + pmod(xxhash64({high}, i, {seed + 1}L), low)) % low)"
    return (
        f"aggregate(sequence(1, {rounds}), named_struct('h', {number} div low, 'l', {number} % low), "
        f"(s, i) -> named_struct('h', {high}, 'l', {low}), s -> s.h * low + s.l)"
    )


def permuted(rounds: int = ROUNDS, seed: int = SEED):
    """Column: where row `number` of `total` goes. Needs columns `number`, `total`, `high`, `low` (BIGINT)."""
    start = _network("number", rounds, seed)
    walked = f"aggregate(sequence(1, {WALK}), {start}, (v, k) -> if(v < total, v, {_network('v', rounds, seed)}))"
    return F.expr(
        f"aggregate(array({walked}), 0L, (ignored, v) -> if(v < total, v, raise_error('the walk left the grid')))"
    )


def with_row_numbers(docs: DataFrame, identity: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Add `number`, a row number that depends on the rows' values in `identity` alone, and `total`.

    Equal rows are folded to one with a count before they are dealt, so no value is a hot key.
    """
    folded = docs.groupBy(*identity).agg(F.count(F.lit(1)).alias("copies")).withColumn(
        "bucket", F.pmod(F.xxhash64(*identity), F.lit(buckets)).cast("int")
    )
    sizes = folded.groupBy("bucket").agg(F.sum("copies").alias("held"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # At most `buckets` rows.
    offsets = sizes.select(
        "bucket",
        F.coalesce(F.sum("held").over(before), F.lit(0)).alias("offset"),
        F.sum("held").over(everything).alias("total"),
    )
    within = Window.partitionBy("bucket").orderBy(*identity).rowsBetween(Window.unboundedPreceding, -1)
    placed = folded.withColumn("passed", F.coalesce(F.sum("copies").over(within), F.lit(0)))
    # Copies unfold in two steps, so that no array is long.
    spread = placed.join(F.broadcast(offsets), "bucket").select(
        *identity, "total", (F.col("offset") + F.col("passed") + F.col("copies")).alias("stop"),
        F.explode(F.expr(f"sequence(offset + passed, offset + passed + copies - 1, {UNFOLDED}L)")).alias("first"),
    )
    return spread.select(
        *identity, "total",
        F.explode(F.expr(f"sequence(first, least(stop, first + {UNFOLDED}L) - 1)")).alias("number"),
    )


def sharded(
    docs: DataFrame, shards: int = SHARDS, id_column: str = "doc_id", text: str = "text",
    rounds: int = ROUNDS, seed: int = SEED, buckets: int = BUCKETS,
) -> DataFrame:
    """One row per input row: the id, `size` (UTF-8 bytes plus 1), `text_crc32`, `shard` and `slot`.

    A NULL text has no bytes: size 1 and checksum 0, like an empty one. NULL and repeated ids are rows like any other;
    equal rows are numbered in turn. The result depends on the rows alone, not on their order or partitions. An empty
    input gives an empty result.
    """
    content = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    slim = docs.select(
        F.col(id_column),
        (F.octet_length(content) + 1).cast("bigint").alias("size"),
        F.crc32(content).alias("text_crc32"),
        F.xxhash64(content).alias("digest"),
    )
    numbered = with_row_numbers(slim, [id_column, "size", "text_crc32", "digest"], buckets)
    grid = numbered.withColumn("high", F.ceil(F.sqrt(F.col("total").cast("double"))).cast("bigint")).withColumn(
        "low", F.expr("(total + high - 1) div high")
    )
    return grid.withColumn("place", permuted(rounds, seed)).select(
        id_column, "size", "text_crc32",
        (F.col("place") % shards).cast("int").alias("shard"),
        F.expr(f"place div {shards}").alias("slot"),
    )


def op5_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharded(table(spark, sf_dir, "documents"))
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
