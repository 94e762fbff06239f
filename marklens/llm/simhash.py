"""SimHash near-duplicates: fingerprints linked through BK-trees over shards.

1. A fingerprint per text, in an Arrow stage (no shuffle).
2. Equal fingerprints fold to one row. The distinct ones go to shards: of `radius + c` bit blocks at least `c` agree
   between two fingerprints within the radius, so every choice of `c` blocks makes one shard key, and each link meets
   in at least one shard. `c` grows with the number of fingerprints, which keeps shards small at any size.
3. A shard above `shard_limit` is cut into chunks; every pair of chunks becomes a unit of work of its own, in which
   the first chunk's tree is searched by both. No unit holds more than two chunks, whatever the size of a key.
4. Each unit builds a BK-tree and follows only the child edges within the radius. It yields a spanning forest of the
   links it finds, not all pairs, so a group of n near copies costs n rows.
5. Components come from star contraction on the forest's edges.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import as_bytes, connected_components, per_text, sorted_groups, split_join, table, word_bounds

SEED = 42
BITS = 64
# Shingles whose bits are counted at once, so that a very long text needs no more memory than this many.
COUNTED_AT_ONCE = 65_536
SHARD_LIMIT = 4_096
# Distinct fingerprints a shard key should hold on average.
SHARD_AIM = 64
SHINGLE = 4
RADIUS = 4


def fingerprint(text: bytes, shingle: int = SHINGLE) -> bytes:
    """SimHash of the text's word shingles, 64 bits, big-endian; zero for a text without words."""
    parts = text.lower().split()  # bytes: folds A-Z alone and splits at the six ASCII white-space bytes
    if not parts:
        return bytes(8)
    joined = memoryview(b" ".join(parts))
    starts, ends = word_bounds(parts)
    count = max(1, len(parts) - shingle + 1)
    starts, ends = starts[:count].tolist(), ends[len(parts) - count :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for at in range(0, count, COUNTED_AT_ONCE):
        stop = min(count, at + COUNTED_AT_ONCE)
        hashes = np.fromiter(
            (digest(joined[a:b], SEED) for a, b in zip(starts[at:stop], ends[at:stop], strict=True)), np.uint64, stop - at
        )
        ones += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > count).tobytes()


def with_fingerprints(docs: DataFrame, id_column: str, text: str, shingle: int) -> DataFrame:
    """`row` (struct of all columns), `id`, `fp`, the fingerprint, and `lead`, the same as a signed number."""

    def rows(texts: list[bytes]) -> Iterator[tuple]:
        for value in texts:
            found = fingerprint(value, shingle)
            yield found, int.from_bytes(found, "big", signed=True)

    row = F.struct(*[F.col(f"`{name}`") for name in docs.columns])
    hashed = docs.select(
        row.alias("row"), F.col(id_column).alias("id"), per_text("fp binary, lead bigint", rows)(as_bytes(text)).alias("found")
    )
    return hashed.select("row", "id", "found.fp", "found.lead")


class BkTree:
    """Fingerprints in a tree whose child edges carry the Hamming distance to the parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        self.values.append(value)
        self.children.append({})
        if len(self.values) == 1:
            return
        node = 0
        while True:
            distance = (value ^ self.values[node]).bit_count()
            child = self.children[node].get(distance)
            if child is None:
                self.children[node][distance] = len(self.values) - 1
                return
            node = child

    def within(self, value: int, radius: int) -> Iterator[int]:
        """Positions of the values at most `radius` bits away."""
        values, children = self.values, self.children
        pending = [0] if values else []
        while pending:
            node = pending.pop()
            distance = (value ^ values[node]).bit_count()
            if distance <= radius:
                yield node
            for edge, child in children[node].items():
                if -radius <= edge - distance <= radius:
                    pending.append(child)


def forest(values: list[int], radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within the radius among distinct values."""
    parent = list(range(len(values)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    tree, links = BkTree(), []
    for at, value in enumerate(values):
        for other in tree.within(value, radius):
            a, b = root(at), root(other)
            if a != b:
                parent[a] = b
                links.append((value, values[other]))
        tree.add(value)
    return links


def block_masks(radius: int, spare: int) -> list[int]:
    """Bit masks of all choices of `spare` out of `radius + spare` blocks, as signed numbers."""
    blocks = radius + spare
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    single = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    masks = [sum(chosen) for chosen in combinations(single, spare)]
    return [mask - (1 << BITS) if mask >> (BITS - 1) else mask for mask in masks]


def _spare_blocks(radius: int, distinct: int) -> int:
    """Fewest agreeing blocks that make keys long enough for `distinct` fingerprints; any number gives the same links."""
    spare = 1
    while distinct >> (BITS * spare // (radius + spare)) > SHARD_AIM and spare < 4:
        spare += 1
    return spare


def fingerprint_links(
    fingerprints: DataFrame, radius: int, shard_limit: int = SHARD_LIMIT, spare: int | None = None
) -> DataFrame:
    """Edges `a`, `b` that connect the distinct values of `fp` that chains of links within the radius connect."""
    masks = block_masks(radius, _spare_blocks(radius, fingerprints.count()) if spare is None else spare)
    keyed = fingerprints.select(
        "fp",
        F.explode(
            F.array(
                *[F.struct(F.lit(i).alias("t"), F.col("lead").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks)]
            )
        ).alias("key"),
    ).select("fp", "key.t", "key.k")
    shared = keyed.groupBy("t", "k").count().filter("count > 1")
    chunked = split_join(keyed, shared, ["t", "k"]).select(
        "t", "k", "fp", F.ceil(F.col("count") / shard_limit).cast("int").alias("chunks")
    )
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    units = chunked.select(
        "t", "k", "fp", own.alias("own"),
        F.explode(F.sequence(F.lit(0), F.greatest(F.col("chunks") - 1, F.lit(0)))).alias("other"),
    ).select("t", "k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    keys = ["t", "k", "i", "j"]

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, values in sorted_groups(batches, keys, "fp"):
            size = len(values[0])
            links = forest([int.from_bytes(value, "big") for value in values], radius)
            if links:
                ends = [pa.array([end[side].to_bytes(size, "big") for end in links], pa.binary()) for side in (0, 1)]
                yield pa.RecordBatch.from_arrays(ends, ["a", "b"])

    return units.repartition(*keys).sortWithinPartitions(*keys, "fp").mapInArrow(link, "a binary, b binary").distinct()


def _rooted(hashed: DataFrame, radius: int, shard_limit: int, spare: int | None) -> DataFrame:
    """`fp` and `root` of every distinct fingerprint: the least fingerprint that its links reach."""
    distinct = cut_lineage(hashed.select("fp", "lead").distinct())
    roots = connected_components(fingerprint_links(distinct, radius, shard_limit, spare))
    return cut_lineage(
        distinct.select("fp").join(roots.withColumnRenamed("node", "fp"), "fp", "left")
        .select("fp", F.coalesce("root", "fp").alias("root"))
    )


def _named(rooted: DataFrame, least: DataFrame) -> DataFrame:
    """`fp` and `least`, the least value that its component has in `least` (`fp`, `least`)."""
    components = rooted.join(least, "fp").groupBy("root").agg(F.min("least").alias("least"))
    # A component may hold very many fingerprints.
    return split_join(rooted, components, ["root"]).select("fp", "least")


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS,
    shard_limit: int = SHARD_LIMIT, spare: int | None = None,
) -> DataFrame:
    """One row per input row: the id, `fp`, and `component_id`, the least id its links reach, itself included.

    Texts that are NULL, empty or without words have fingerprint 0 and are linked like any other. Repeated rows stay
    repeated. A NULL id takes part but is never the least; a component of NULL ids alone has a NULL `component_id`.
    An empty input gives an empty result.
    """
    hashed = cut_lineage(with_fingerprints(docs.select(F.col(id_column), F.col(text)), id_column, text, shingle).drop("row"))
    rooted = _rooted(hashed, radius, shard_limit, spare)
    named = _named(rooted, hashed.groupBy("fp").agg(F.min("id").alias("least")))
    return split_join(hashed.select("id", "fp"), named, ["fp"]).select(
        F.col("id").alias(id_column), "fp", F.col("least").alias("component_id")
    )


def without_near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS,
    shard_limit: int = SHARD_LIMIT, spare: int | None = None,
) -> DataFrame:
    """One document of each component, with all its columns: that of the least id, then the least text hash.

    Of rows equal in id and text one stays. A NULL id comes last. Texts without words are one component.
    """
    # A row's key: its id and text. Rows that share it are copies of one row.
    key = F.struct(F.col(id_column).isNull().alias("nameless"), F.col(id_column).alias("id"), F.xxhash64(id_column, text).alias("k1"), F.hash(text).alias("k2"))
    row = F.struct(*[F.col(f"`{name}`") for name in docs.columns])
    keyed = docs.select(row.alias("row"), key.alias("key")).select("row", "key", "key.k1", "key.k2")
    hashed = cut_lineage(with_fingerprints(docs.select(key.alias("key"), F.col(text).alias("text")), "key", "text", shingle).select(F.col("id").alias("key"), "fp", "lead"))
    least = hashed.groupBy("fp").agg(F.min("key").alias("least"))
    kept = _rooted(hashed, radius, shard_limit, spare).join(least, "fp").groupBy("root").agg(F.min("least").alias("least"))
    chosen = kept.select("least.k1", "least.k2").distinct()
    return split_join(keyed, chosen, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]).select(
        *[F.col(f"row.`{name}`") for name in docs.columns]
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
