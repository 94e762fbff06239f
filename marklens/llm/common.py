"""What several operators share: per-text functions as columns, sorted groups in tasks, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import cut_lineage

WORD_SEPARATORS = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_bytes(text: str) -> Column:
    """The text's UTF-8 bytes; NULL counts as empty."""
    return F.coalesce(F.col(text).cast("binary"), F.lit(b""))


def per_text(schema: str, rows: Callable[[list], Iterator[tuple]]) -> Callable[[Column], Column]:
    """A column function that maps each text of a batch to one struct of `schema`.

    `rows` gets the texts of one Arrow batch and yields a tuple per text, in order.
    """
    fields = _arrow_fields(schema)

    @F.arrow_udf(schema)
    def mapped(texts: pa.Array) -> pa.Array:
        columns = list(zip(*rows(texts.to_pylist()), strict=True)) or [()] * len(fields)
        return pa.StructArray.from_arrays(
            [pa.array(values, field.type) for values, field in zip(columns, fields, strict=True)], fields=fields
        )

    return mapped


def _arrow_fields(schema: str) -> list[pa.Field]:
    from pyspark.sql.pandas.types import to_arrow_schema

    return list(to_arrow_schema(StructType.fromDDL(schema)))


def packed(text: str) -> Column:
    """The text's bytes, compressed: whole texts that must be shuffled take two thirds of the space that way."""

    def rows(texts: list[bytes]) -> Iterator[tuple]:
        compressor = zstandard.ZstdCompressor(level=1)
        for value in texts:
            yield (compressor.compress(value),)

    return per_text("packed binary", rows)(as_bytes(text))["packed"]


def unpacked(value: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(value)


def split_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys of which one may hold very many rows.

    Spark splits a hot key only between two shuffles of the join's own. A side that was just aggregated by the same
    keys would not be shuffled again; one more key, a bit made of the others, sees to it that it is.
    """
    deal = F.pmod(F.xxhash64(*keys), F.lit(2)).cast("boolean")
    joined = left.withColumn("_deal", deal).join(right.withColumn("_deal", deal), [*keys, "_deal"], how)
    return joined.drop("_deal")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    """The batches in smaller ones, for work that holds several times a batch's size."""
    for batch in batches:
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)


def word_bounds(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Where each word starts and ends when the words are joined by one space."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    return ends - lengths, ends


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str], value: str) -> Iterator[tuple[tuple, list]]:
    """Runs of equal keys in a task's sorted rows, each with the run's values; a run may span batches."""
    pending_key, pending = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        values = batch.column(batch.schema.get_field_index(value)).to_pylist()
        change = np.zeros(batch.num_rows, bool)
        change[0] = True
        for column in columns:
            change[1:] |= column[1:] != column[:-1]
        starts = np.flatnonzero(change)
        for begin, end in zip(starts, np.append(starts[1:], batch.num_rows), strict=True):
            key = tuple(column[begin] for column in columns)
            if key != pending_key:
                if pending:
                    yield pending_key, pending
                pending_key, pending = key, []
            pending += values[begin:end]
    if pending:
        yield pending_key, pending


def connected_components(edges: DataFrame) -> DataFrame:
    """`node` and `root`, the least node reachable from it, out of edges `a`, `b` (of one type that can be ordered).

    Alternates the large-star and small-star steps, which replace a node's links by links to its least neighbour.
    Their minima combine on the map side and their joins can be split where a node is hot. The edge count never
    grows, each round ends in a checkpoint, and the loop ends when a round changes nothing.
    """
    edges = cut_lineage(
        edges.filter("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    before = None
    while True:
        signature = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if signature == before:
            break
        before = signature
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (
            split_join(both.filter("b > a"), least, ["a"]).select(F.col("b").alias("a"), F.col("m").alias("b"))
            .filter("a <> b").distinct()
        )
        below = large.groupBy("a").agg(F.min("b").alias("m"))
        linked = split_join(large, below, ["a"])
        small = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            below.select("a", F.col("m").alias("b"))
        )
        edges = cut_lineage(small.filter("a <> b").distinct())
    roots = edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
