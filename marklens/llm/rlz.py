"""Substring dedup by pieces and windows counted over the whole corpus.

The name says relative Lempel-Ziv; no greedy parsing is done here, and a factor below is a piece that occurs again whole.
The reference is every document. It is cut into pieces where the text itself says so, which makes equal passages fall
into equal pieces wherever they stand: each window of `window` words has as its anchor the least hash among its
`gram`-word sequences, and a piece is a run of consecutive windows with one anchor. Pieces are the phrases of the
reference, the anchor is the block of the index that holds them, and the index is sharded by anchor, so a document
meets every block in which one of its windows could be found and no other.

1. Anchors that occur once in the corpus have no match; their pieces are literals. One column is shuffled for this.
2. Of the other pieces, one whose whole content occurs again is a factor that needs no further look.
3. Greedy factors end where the text they follow ends, and that is inside a piece. Those pieces, the factor
   boundaries, are read again and checked window by window against all phrases of their block.
4. Per text, factors and boundary windows join into spans, and words that a span covers are removed.

Counting combines on the map side and joins on anchors or texts can be split, so a passage in a third of all
documents, or a text with very many copies, is no hot key. All work on a text is linear in its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import as_bytes, packed, per_text, slices, split_join, table, unpacked

WINDOW = 35
GRAM = 8
# Odd numbers for hashing modulo 2**64: the base of sequences of words and its inverse, and a mixing factor.
BASE = 0x9E3779B97F4A7C15
MIX = 0xFF51AFD7ED558CCD
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and their inverses, at least `count` of them."""
    size = 1 << max(12, count.bit_length())
    if size not in _POWERS:
        inverse = pow(BASE, -1, 1 << 64)
        for_each = [np.full(size, number, np.uint64) for number in (BASE, inverse)]
        for column in for_each:
            column[0] = 1
        _POWERS.clear()
        _POWERS[size] = tuple(np.multiply.accumulate(column) for column in for_each)
    return _POWERS[size]


def _mixed(hashes: np.ndarray) -> np.ndarray:
    hashes = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(MIX)
    return hashes ^ (hashes >> np.uint64(29))


class Pieces:
    """The pieces of one text: anchor, content hash, first window, number of windows, and a hash per window."""

    def __init__(self, text: bytes, window: int = WINDOW, gram: int = GRAM) -> None:
        words = text.split()
        self.count = len(words)
        windows = self.count - window + 1
        if windows < 1:
            self.anchors = self.contents = self.hashes = np.zeros(0, np.uint64)
            self.starts = self.sizes = np.zeros(0, np.int64)
            self.inner = np.zeros(0, bool)
            return
        digest = xxhash.xxh64_intdigest
        hashed = np.fromiter(map(digest, words), np.uint64, self.count)
        powers, inverses = _powers(self.count + 1)
        sums = np.zeros(self.count + 1, np.uint64)
        np.cumsum(hashed * powers[: self.count], out=sums[1:])

        def sequences(length: int) -> np.ndarray:
            begin = self.count - length + 1
            return _mixed((sums[length:] - sums[:begin]) * inverses[:begin])

        self.hashes = sequences(window)
        least = _sliding_least(sequences(gram), window - gram + 1)
        # Runs of one anchor, cut so that none is longer than an anchor can carry by its own place.
        new_run = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
        lengths = np.diff(np.append(new_run, windows))
        longest = window - gram + 1
        parts = -(-lengths // longest)
        first = np.repeat(new_run, parts)
        offset = (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)) * longest
        self.starts = first + offset
        self.sizes = np.diff(np.append(self.starts, windows))
        self.anchors = least[self.starts]
        ends = self.starts + self.sizes + window - 1
        content = (sums[ends] - sums[self.starts]) * inverses[self.starts]
        self.contents = _mixed(content + self.sizes.astype(np.uint64))
        # Pieces that hold a window twice: their own text is a match for it.
        self.inner = np.zeros(len(self.starts), bool)
        order = np.argsort(self.hashes, kind="stable")
        again = np.flatnonzero(self.hashes[order[1:]] == self.hashes[order[:-1]])
        if len(again):
            owner = np.searchsorted(self.starts, order, "right") - 1
            self.inner[owner[again][owner[again] == owner[again + 1]]] = True


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive values, by doubling."""
    reach = 1
    while reach * 2 <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values, np.uint64).view(np.int64))


def with_text_key(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add `t1`, `t2`, which identify a text: 96 bits, made in the JVM."""
    return docs.withColumns({"t1": F.xxhash64(text), "t2": F.hash(text)})


def _pieces(keyed: DataFrame, text: str, window: int, gram: int) -> DataFrame:
    """The pieces of each text; `weight` is 2 where a piece matches itself."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            pieces = [Pieces(value, window, gram) for value in batch.column(2).to_pylist()]
            counts = [len(p.starts) for p in pieces]
            if not sum(counts):
                continue
            owner = pa.array(np.repeat(np.arange(batch.num_rows), counts))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(owner),
                    batch.column(1).take(owner),
                    _signed(np.concatenate([p.anchors for p in pieces])),
                    _signed(np.concatenate([p.contents for p in pieces])),
                    pa.array(np.concatenate([p.starts for p in pieces]).astype(np.int32)),
                    pa.array(np.concatenate([p.sizes for p in pieces]).astype(np.int32)),
                    pa.array(1 + np.concatenate([p.inner for p in pieces]).astype(np.int32)),
                ],
                ["t1", "t2", "anchor", "content", "start", "size", "weight"],
            )

    return keyed.select("t1", "t2", as_bytes(text)).mapInArrow(
        rows, "t1 bigint, t2 int, anchor bigint, content bigint, start int, size int, weight int"
    )


def _window_hashes(chosen: DataFrame, window: int, gram: int) -> DataFrame:
    """A hash per window of the chosen pieces of each text, given as `packed`, `copies` and `pieces` (start, whole)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            owner, anchors, starts, whole, hashes = [], [], [], [], []
            for at, (value, wanted) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                pieces = Pieces(unpacked(value), window, gram)
                signed_anchors, signed_hashes = pieces.anchors.view(np.int64), pieces.hashes.view(np.int64)
                for piece in wanted:
                    index = np.searchsorted(pieces.starts, piece["start"])
                    owner.append(at)
                    anchors.append(signed_anchors[index])
                    starts.append(piece["start"])
                    whole.append(piece["whole"])
                    hashes.append(signed_hashes[piece["start"] : piece["start"] + pieces.sizes[index]])
            if not owner:
                continue
            offsets = pa.array(np.append(0, np.cumsum([len(h) for h in hashes])).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(owner)),
                    batch.column(1).take(pa.array(owner)),
                    batch.column(4).take(pa.array(owner)),
                    pa.array(anchors, pa.int64()),
                    pa.array(starts, pa.int32()),
                    pa.array(whole, pa.bool_()),
                    pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(hashes))),
                ],
                ["t1", "t2", "copies", "anchor", "start", "whole", "hashes"],
            )

    return chosen.select("t1", "t2", "packed", "pieces", "copies").mapInArrow(
        rows, "t1 bigint, t2 int, copies int, anchor bigint, start int, whole boolean, hashes array<bigint>"
    )


def repeated_spans(docs: DataFrame, text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """`t1`, `t2` and `spans`: per text with a repeated window, runs of such windows as (first window, count)."""
    keyed = with_text_key(docs.select(F.col(text)), text)
    pieces = _pieces(keyed, text, window, gram)
    repeated = pieces.groupBy("anchor").agg(F.sum("weight").alias("occurs")).filter("occurs > 1").select("anchor")
    matched = cut_lineage(split_join(pieces, repeated, ["anchor"]))
    # A phrase of the reference: one content of a block, and the first place that has it.
    place = F.struct("t1", "t2", "start")
    phrases = matched.groupBy("anchor", "content").agg(
        F.sum("weight").alias("occurs"), F.max("weight").alias("most"), F.min(place).alias("first")
    )
    # Blocks with a boundary piece: one that stands alone, or whose match is within itself.
    blocks = phrases.filter("occurs = 1 OR most > 1").select("anchor").distinct()
    judged = split_join(matched, phrases, ["anchor", "content"]).withColumn("whole", F.expr("occurs > 1 AND weight = 1"))
    factors = judged.filter("whole").select("t1", "t2", F.struct("start", "size").alias("span"))
    # Boundary pieces, and one place of each whole factor of their blocks, in which they might continue.
    chosen = (
        split_join(judged.filter(~F.col("whole") | (F.col("first") == place)), blocks, ["anchor"])
        .groupBy("t1", "t2").agg(F.collect_set(F.struct("start", "whole")).alias("pieces"))
    )
    # Copies of a text have the same windows; one of them is read, and its windows count for all. Two are enough to repeat.
    copies = F.least(F.count(F.lit(1)), F.lit(2)).cast("int").alias("copies")
    texts = keyed.select("t1", "t2", packed(text).alias("packed")).groupBy("t1", "t2").agg(F.first("packed").alias("packed"), copies)
    windows = cut_lineage(_window_hashes(texts.join(chosen, ["t1", "t2"]), window, gram)).select(
        "t1", "t2", "copies", "anchor", "start", "whole", F.posexplode("hashes").alias("at", "hash")
    )
    found = (
        windows.groupBy("anchor", "hash").agg(F.sum(F.when(F.col("whole"), 2).otherwise(F.col("copies"))).alias("occurs"))
        .filter("occurs > 1").select("anchor", "hash")
    )
    checked = split_join(windows.filter(~F.col("whole")), found, ["anchor", "hash"]).select(
        "t1", "t2", F.struct((F.col("start") + F.col("at")).alias("start"), F.lit(1).alias("size")).alias("span")
    )
    return factors.unionByName(checked).groupBy("t1", "t2").agg(F.collect_set("span").alias("spans"))


def without_repeats(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM
) -> DataFrame:
    """One row per input row: id, `n_words`, `n_removed`, `kept` (the words left, joined by one space).

    A word goes if a window of `window` words that covers it starts anywhere else too, in the same text or another;
    windows are judged on the input. Of copies all go, none is kept. Texts that are NULL, empty or shorter than a
    window lose nothing and match nothing. An empty input gives an empty result.
    """
    keyed = with_text_key(docs.select(F.col(id_column), F.col(text)), text).withColumn("packed", packed(text)).drop(text)
    spans = repeated_spans(docs, text, window, gram)

    def rows(pairs: list[dict]) -> Iterator[tuple]:
        for pair in pairs:
            words = unpacked(pair["packed"]).split()
            covered = np.zeros(len(words) + 1, np.int64)
            if pair["spans"]:
                bounds = np.array([(s["start"], s["start"] + s["size"] + window - 1) for s in pair["spans"]])
                np.add.at(covered, bounds[:, 0], 1)
                np.add.at(covered, bounds[:, 1], -1)
            kept = np.flatnonzero(np.cumsum(covered)[:-1] == 0)
            if len(kept) < len(words):
                left = b" ".join([words[i] for i in kept])
            else:
                left = b" ".join(words)
            yield len(words), len(words) - len(kept), left.decode("utf-8", "replace")

    pair = F.struct("packed", "spans")
    result = per_text("n_words bigint, n_removed bigint, kept string", rows)(pair)
    return split_join(keyed, spans, ["t1", "t2"], "left").select(id_column, result.alias("r")).select(id_column, "r.*")


def op10_rlz(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = without_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


# Windows as texts, counted over all documents; words at the positions that a repeated one covers are left out.
OP10_SQL = r"""
WITH split AS (
  SELECT row_number() OVER () AS r, doc_id,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents
), windows AS (
  SELECT r, i, array_to_string(words[i:i + 34], ' ') AS gram
  FROM (SELECT r, words, unnest(range(1, len(words) - 33)) AS i FROM split)
), repeated AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY gram) AS found FROM windows) WHERE found > 1
), removed AS (
  SELECT r, list(i) AS places
  FROM (SELECT DISTINCT r, i + o AS i FROM repeated, (SELECT unnest(range(0, 35)) AS o)) GROUP BY r
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(len(places), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN places IS NULL THEN words
    ELSE list_filter(words, lambda w, i: NOT list_contains(places, i)) END, ' ')) AS kept_sha256
FROM split LEFT JOIN removed USING (r)
"""
