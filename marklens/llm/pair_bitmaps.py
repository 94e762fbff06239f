"""Cross-tokenizer alignment: an inverted index from token pairs to compressed document bitmaps.

Two tokenizers read each text; where a token of each ends at the same byte, the two are linked. The index has, for each
linked pair of ids, the documents that hold it:

1. Documents are numbered in blocks as tasks read them. Per block and pair there is one container: a bitmap of the
   block's documents, kept as a sorted list of 16-bit numbers or as bits, whichever is shorter, and multiplicity planes
   of the same kind: plane k has the documents in which bit k of (links - 1) is set.
2. The bitmap of a pair over all documents is the OR of its containers. Blocks share no documents, so containers are
   never rewritten, the population count of the OR is the sum of theirs, and no pair, however common, is one large row.
   Documents are counted by the bitmaps, links by bitmaps and planes weighted by powers of two.
3. The counts, and whether a pair is the most frequent of its second id, go back along the postings: joined to the
   containers by pair (the join can be split), then added up per document within each block.

Texts are tokenized once and never shuffled; what is shuffled is the index, a few bytes per document and pair.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain, compress
from operator import not_

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from tokenizers import Tokenizer

from ..session import cut_lineage
from .common import split_join, table

A_FILE = public_tokenizers.path("byte_bpe_50k.json")
B_FILE = public_tokenizers.path("piece_bpe_32k.model")
SPACE = "▁"
# A block closes with the text that brings it to this many different (pair, document) or to this many documents, which
# bounds a task's memory; any numbers give the same results.
BLOCK_POSTINGS = 4_000_000
BLOCK_DOCUMENTS = 65_536
# Characters read at a time. Texts are cut at every single space between two visible ASCII characters: no token of either
# tokenizer reaches from before such a space into it or beyond, so both have a token that ends there.
CHARACTERS_AT_ONCE = 2_000_000
# Parts a worker remembers between texts; only how often parts are tokenized depends on it.
KNOWN_PARTS = 200_000
CUT = re.compile(r"(?<=[!-~]) (?=[!-~])")
# Parts tokenized in one call.
PARTS_TOGETHER = 512


def byte_level_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if visible, else one from U+0100 on."""
    visible = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (byte for byte in range(256) if byte not in visible)
    return {chr(byte): byte for byte in visible} | {chr(256 + n): byte for n, byte in enumerate(others)}


class Aligner:
    """Both tokenizers, the bytes of their tokens, and how a batch of texts is linked."""

    def __init__(self, a_file: str, b_file: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        alphabet = byte_level_alphabet()
        entries = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.a_bytes = [
            bytes(map(alphabet.__getitem__, entry)) if alphabet.keys() >= set(entry) else entry.encode() for entry in entries
        ]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [
            bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(SPACE, " ").encode()
            for i, piece in enumerate(pieces)
        ]
        # Texts may be cut before a space if no piece of the second tokenizer goes on after one.
        self.cuts = not any(SPACE in piece.lstrip(SPACE) for piece in pieces)
        self.a_lengths = np.array([*map(len, self.a_bytes)], np.int64)
        self.b_lengths = np.array([*map(len, self.b_bytes)], np.int64)
        self.quick = self._quick_a(entries)
        self.known: dict[str, tuple[int, int, bytes, bytes] | None] = {}
        # Ids in decimal, one cell each with room for a separator.
        size = max(len(self.a_bytes), len(self.b_bytes))
        decimal = np.array([b"%d" % i for i in range(size)], "S")
        self.cells = np.zeros((size, decimal.dtype.itemsize + 1), np.uint8)
        self.cells[:, :-1] = decimal.view(np.uint8).reshape(size, -1)
        self.digits = np.count_nonzero(self.cells, axis=1)

    def _quick_a(self, entries: list[str]):
        """The first tokenizer's merges as ranks, for a faster encoder that gives the same ids; NULL if it would not.

        It merges whatever neighbours form an entry, least id first. That is the same as the list of merges if that
        list makes the entries in the order of their ids, and merging an entry's own bytes gives the entry.
        """
        whole = json.loads(self.a.to_str())
        model, cut = whole["model"], whole["pre_tokenizer"] or {}
        if whole["normalizer"] or cut.get("type") != "ByteLevel" or not cut.get("use_regex") or cut.get("add_prefix_space"):
            return None
        merges = [tuple(merge.split(" ")) if isinstance(merge, str) else tuple(merge) for merge in model["merges"]]
        made = [model["vocab"].get("".join(merge)) for merge in merges]
        letters = [i for i, entry in enumerate(entries) if len(entry) == 1]
        if made != [*range(len(letters), len(letters) + len(made))] or letters != [*range(len(letters))]:
            return None
        ranks = {self.a_bytes[i]: i for i in [*letters, *made]}
        return tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _a_ids(self, text: str) -> list[int]:
        """Ids of a space and the text; the faster encoder reads what no version of Unicode sees otherwise."""
        if self.quick is not None and max(text) < "\u0250":
            return self.quick.encode_ordinary(" " + text)
        return self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids

    def parts(self, text: str) -> list[str]:
        """The text without the spaces it is cut at; each part is tokenized as a text of its own. Empty: none."""
        if not text:
            return []
        return CUT.split(text) if self.cuts else [text]

    def groups(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Of parts with `n_a` and `n_b` tokens, whose bytes are the same: groups as text, number of links; the links' pairs.

        A pair is A * size of B + B. Parts follow each other at the same bytes on both sides, so one search links all.
        """
        a_ends, b_ends = np.cumsum(self.a_lengths[a]), np.cumsum(self.b_lengths[b])
        at = np.searchsorted(b_ends, a_ends)
        a_last = np.flatnonzero(b_ends[at] == a_ends) if len(a) else np.zeros(0, np.int64)
        b_last = at[a_last]
        # Each group's tokens of A come before its tokens of B.
        a_place = np.arange(len(a)) + np.append(0, b_last + 1)[np.searchsorted(a_last, np.arange(len(a)))]
        b_place = np.arange(len(b)) + (a_last + 1)[np.searchsorted(b_last, np.arange(len(b)))]
        ids, separators = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        ids[a_place], ids[b_place] = a, b
        separators[a_place[a_last]], separators[b_place[b_last]] = ord("|"), ord(";")
        cells = self.cells[ids]
        cells[np.arange(len(ids)), self.digits[ids]] = separators
        written = cells[cells != 0].tobytes()
        ends = np.append(0, np.cumsum(self.digits[ids] + 1))[np.append(0, np.cumsum(n_a + n_b))].tolist()
        n_links = np.bincount(np.repeat(np.arange(len(n_a)), n_a)[a_last], minlength=len(n_a))
        return [written[i:j] for i, j in zip(ends, ends[1:])], n_links, a[a_last] * len(self.b_bytes) + b[b_last]

    def _keep(self, parts: list[str], a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> None:
        written, n_links, pairs = self.groups(a, b, n_a, n_b)
        packed, ends = pairs.tobytes(), (8 * np.append(0, np.cumsum(n_links))).tolist()
        of_parts = (packed[i:j] for i, j in zip(ends, ends[1:]))
        self.known.update(zip(parts, zip(n_a.tolist(), n_b.tolist(), written, of_parts, strict=True), strict=True))

    def _learn_together(self, parts: list[str]) -> bool:
        """Learn parts that may stand in one text, cut at the spaces between them; false if that text is not given back."""
        text = " ".join(parts)
        a, b = self._a_ids(text), self.b.encode(text)
        whole = b" " + text.encode()
        if not b"".join([self.a_bytes[i] for i in a]) == whole == b"".join([self.b_bytes[i] for i in b]):
            return False
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        ends = np.cumsum(np.fromiter((len(part.encode()) + 1 for part in parts), np.int64, len(parts)))
        n_a, n_b = (
            np.diff(np.searchsorted(np.cumsum(lengths[ids]), ends) + 1, prepend=0)
            for lengths, ids in ((self.a_lengths, a), (self.b_lengths, b))
        )
        self._keep(parts, a, b, n_a, n_b)
        return True

    def _learn(self, parts: list[str]) -> None:
        """Put what is found for parts into `known`: tokens of each kind, groups as text, links' pairs as bytes.

        NULL for a part that either tokenizer does not give back: it only ever loses bytes, so no text that has such a
        part is given back either.
        """
        alone, together = [], []
        for part in parts:
            (together if self.cuts and "!" <= part[0] <= "~" and "!" <= part[-1] <= "~" else alone).append(part)
        for begin in range(0, len(together), PARTS_TOGETHER):
            chunk = together[begin : begin + PARTS_TOGETHER]
            if not self._learn_together(chunk):
                alone += chunk
        a_ids = [found.ids for found in self.a.encode_batch_fast([" " + part for part in alone], add_special_tokens=False)]
        b_ids = self.b.encode(alone, num_threads=1) if alone else []
        same = [
            b"".join([self.a_bytes[i] for i in a]) == b" " + part.encode() == b"".join([self.b_bytes[i] for i in b])
            for part, a, b in zip(alone, a_ids, b_ids, strict=True)
        ]
        if not all(same):
            self.known.update(dict.fromkeys(compress(alone, map(not_, same))))
            alone, a_ids, b_ids = ([*compress(values, same)] for values in (alone, a_ids, b_ids))
        n_a, n_b = (np.array([*map(len, lists)], np.int64) for lists in (a_ids, b_ids))
        a = np.fromiter(chain.from_iterable(a_ids), np.int64, n_a.sum())
        b = np.fromiter(chain.from_iterable(b_ids), np.int64, n_b.sum())
        self._keep(alone, a, b, n_a, n_b)

    def linked(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str], np.ndarray, np.ndarray]:
        """Per text the tokens of each kind, the groups and their digest; per link its text and pair.

        A text has no tokens where either tokenizer does not give back a space and the text. Equal parts are read once,
        also those of recent texts.
        """
        number_of: dict[str, int] = {}
        codes = [[number_of.setdefault(part, len(number_of)) for part in self.parts(text)] for text in texts]
        self._learn([part for part in number_of if part not in self.known])
        entries = [self.known[part] for part in number_of]
        if len(self.known) > KNOWN_PARTS:
            self.known = dict(zip(number_of, entries, strict=True))
        lost = {n for n, entry in enumerate(entries) if entry is None}
        if lost:
            codes = [own if lost.isdisjoint(own) else [] for own in codes]
            entries = [(0, 0, b"", b"") if entry is None else entry for entry in entries]
        a_counts, b_counts, written, pairs = zip(*entries, strict=True) if entries else ((), (), (), ())
        digests = [hashlib.sha256(b"".join([written[n] for n in own])[:-1]).hexdigest() if own else "" for own in codes]
        # What was found per part, gathered for the parts of all texts.
        part_of = np.fromiter(chain.from_iterable(codes), np.int64)
        text_of = np.repeat(np.arange(len(texts)), [*map(len, codes)])

        def per_text(numbers) -> np.ndarray:
            return np.bincount(text_of, np.array(numbers, np.int64)[part_of], len(texts)).astype(np.int64)

        n_links = np.fromiter(map(len, pairs), np.int64, len(pairs)) // 8
        flat = np.frombuffer(b"".join(pairs), np.int64)
        counts = n_links[part_of]
        first = np.repeat((np.cumsum(n_links) - n_links)[part_of] - (np.cumsum(counts) - counts), counts)
        return (
            per_text(a_counts), per_text(b_counts), per_text(n_links), digests,
            np.repeat(text_of, counts), flat[first + np.arange(len(first))],
        )


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def _aligner(a_file: str, b_file: str) -> Aligner:
    """The tokenizers of this Python worker, loaded once."""
    if (a_file, b_file) not in _ALIGNERS:
        _ALIGNERS[a_file, b_file] = Aligner(a_file, b_file)
    return _ALIGNERS[a_file, b_file]


def packed_numbers(numbers: np.ndarray) -> bytes:
    """A container of ascending 16-bit numbers: a list of them or bits up to the last, whichever is shorter."""
    if not len(numbers):
        return b""
    if 16 * len(numbers) <= int(numbers[-1]) + 1:
        return b"\0" + numbers.astype("<u2").tobytes()
    bits = np.zeros(int(numbers[-1]) + 1, np.uint8)
    bits[numbers] = 1
    return b"\1" + np.packbits(bits).tobytes()


def unpacked_numbers(container: bytes) -> np.ndarray:
    if not container:
        return np.zeros(0, np.int64)
    if container[0]:
        return np.flatnonzero(np.unpackbits(np.frombuffer(container, np.uint8, offset=1)))
    return np.frombuffer(container, "<u2", offset=1).astype(np.int64)


def population(container: bytes) -> int:
    """How many numbers a container holds."""
    if not container:
        return 0
    return int.from_bytes(container[1:], "big").bit_count() if container[0] else len(container) // 2


POSTINGS = "a int, b int, bitmap binary, planes array<binary>, n_docs bigint, n_links bigint"


class _Block:
    """The documents of a block so far, and a key (pair, document) with its links per posting."""

    def __init__(self) -> None:
        self.documents = 0
        self.postings = 0
        self.keys: list[np.ndarray] = []
        self.links: list[np.ndarray] = []

    def add(self, owner: np.ndarray, pairs: np.ndarray, documents: int) -> None:
        keys, links = np.unique(pairs << 16 | (owner + self.documents), return_counts=True)
        self.keys.append(keys)
        self.links.append(links)
        self.documents += documents
        self.postings += len(keys)

    def rows(self, size_b: int) -> Iterator[tuple]:
        keys = np.concatenate(self.keys)
        order = np.argsort(keys)
        keys, more = keys[order], np.concatenate(self.links)[order] - 1
        pairs, documents = keys >> 16, keys & 0xFFFF
        begins = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])) if len(keys) else []
        for begin, end in zip(begins, np.append(begins[1:], len(keys)), strict=True):
            own, again = documents[begin:end], more[begin:end]
            bitmap = packed_numbers(own)
            planes = [packed_numbers(own[(again >> k & 1).astype(bool)]) for k in range(int(again.max()).bit_length())]
            n_docs = population(bitmap)
            n_links = n_docs + sum(population(plane) << k for k, plane in enumerate(planes))
            pair = int(pairs[begin])
            yield pair // size_b, pair % size_b, bitmap, planes, n_docs, n_links


def indexed(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", a_file: str = A_FILE, b_file: str = B_FILE,
    block_postings: int = BLOCK_POSTINGS, block_documents: int = BLOCK_DOCUMENTS,
) -> tuple[DataFrame, DataFrame]:
    """Documents (`block`, `doc`, `id`, `n_a`, `n_b`, `n_groups`, `groups_sha256`) and the index's postings.

    A posting has `block`, the pair `a`, `b`, its `bitmap` of documents, the multiplicity `planes`, and what they count:
    `n_docs`, `n_links`.
    """
    schema = StructType.fromDDL("block bigint, doc int")
    schema.add(StructField("id", docs.schema[id_column].dataType))
    for field in StructType.fromDDL(f"n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, {POSTINGS}"):
        schema.add(field)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        aligner = _aligner(a_file, b_file)
        gc.disable()  # millions of small lists and no cycles: looking for some would take a quarter of the time
        number = TaskContext.get().partitionId() << 32
        block = _Block()

        def emitted(columns: dict, count: int) -> pa.RecordBatch:
            arrays = [
                pa.array(columns[field.name], field.type) if field.name in columns else pa.nulls(count, field.type)
                for field in arrow
            ]
            return pa.RecordBatch.from_arrays(arrays, schema=arrow)

        def closed() -> Iterator[pa.RecordBatch]:
            postings = [*block.rows(len(aligner.b_bytes))]
            for begin in range(0, len(postings), 10_000):
                part = postings[begin : begin + 10_000]
                names = ("a", "b", "bitmap", "planes", "n_docs", "n_links")
                columns = dict(zip(names, zip(*part, strict=True), strict=True))
                yield emitted(columns | {"block": [number] * len(part)}, len(part))

        for batch in batches:
            texts = batch.column(1).to_pylist()
            begin = 0
            while begin < len(texts):
                end, characters = begin, 0
                while end < len(texts) and characters < CHARACTERS_AT_ONCE and block.documents + end - begin < block_documents:
                    characters += len(texts[end])
                    end += 1
                n_a, n_b, n_groups, digests, owner, pairs = aligner.linked(texts[begin:end])
                count = end - begin
                places = np.arange(block.documents, block.documents + count)
                yield emitted(
                    {"block": [number] * count, "doc": places, "id": batch.column(0).slice(begin, count), "n_a": n_a,
                     "n_b": n_b, "n_groups": n_groups, "groups_sha256": digests}, count,
                )
                block.add(owner, pairs, count)
                begin = end
                if block.postings >= block_postings or block.documents >= block_documents:
                    yield from closed()
                    block, number = _Block(), number + 1
        if block.documents:
            yield from closed()
        gc.enable()

    read = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    both = cut_lineage(read.mapInArrow(rows, schema))
    documents = both.filter("doc IS NOT NULL").select("block", "doc", "id", "n_a", "n_b", "n_groups", "groups_sha256")
    return documents, both.filter("a IS NOT NULL").select("block", "a", "b", "bitmap", "planes", "n_docs", "n_links")


def pair_counts(postings: DataFrame) -> DataFrame:
    """`a`, `b`, `n_docs`, `n_links` of each pair over all documents, and `best`: no pair of this `b` has more links."""
    counts = postings.groupBy("a", "b").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_links").alias("n_links"))
    most = counts.groupBy("b").agg(F.max("n_links").alias("most"))
    return split_join(counts, most, ["b"]).select("a", "b", "n_docs", "n_links", (F.col("n_links") == F.col("most")).alias("best"))


def scored(documents: DataFrame, postings: DataFrame, counts: DataFrame) -> DataFrame:
    """Add to each document `n_best`, its links of best pairs, and `count_sum`, its links' counts, along the postings."""
    carried = ["id", "n_a", "n_b", "n_groups", "groups_sha256"]
    returned = split_join(postings.select("block", "a", "b", "bitmap", "planes"), counts.select("a", "b", F.col("n_links").alias("count"), "best"), ["a", "b"])
    both = documents.select("block", "doc", *carried).unionByName(
        returned.select("block", "bitmap", "planes", "count", "best"), allowMissingColumns=True
    )
    schema = StructType([*(documents.schema[name] for name in carried), *StructType.fromDDL("n_best bigint, count_sum bigint")])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the documents of the block at hand, which come before its postings
        block, size = None, 0
        best = total = np.zeros(0, np.int64)

        def finished() -> Iterator[pa.RecordBatch]:
            for part in held:
                places = part.column("doc").to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(name) for name in carried), pa.array(best[places]), pa.array(total[places])],
                    [*carried, "n_best", "count_sum"],
                )

        for batch in batches:
            blocks = batch.column("block").to_numpy()
            is_document = batch.column("doc").is_valid().to_numpy(zero_copy_only=False)
            change = np.append(True, (blocks[1:] != blocks[:-1]) | (is_document[1:] != is_document[:-1]))
            starts = np.flatnonzero(change) if batch.num_rows else np.zeros(0, np.int64)
            for begin, end in zip(starts, np.append(starts[1:], batch.num_rows)):
                part = batch.slice(begin, end - begin)
                if blocks[begin] != block:
                    yield from finished()
                    held, block, size = [], blocks[begin], 0
                    best, total = np.zeros(0, np.int64), np.zeros(0, np.int64)
                if is_document[begin]:
                    held.append(part)
                    size += part.num_rows
                    best, total = np.zeros(size, np.int64), np.zeros(size, np.int64)
                    continue
                for bitmap, planes, count, is_best in zip(
                    *(part.column(name).to_pylist() for name in ("bitmap", "planes", "count", "best")), strict=True
                ):
                    members = [(unpacked_numbers(bitmap), 1)]
                    members += [(unpacked_numbers(plane), 1 << k) for k, plane in enumerate(planes)]
                    for numbers, weight in members:
                        total[numbers] += weight * count
                        if is_best:
                            best[numbers] += weight
        yield from finished()

    by_block = both.repartition("block").sortWithinPartitions("block", F.col("doc").asc_nulls_last())
    return by_block.mapInArrow(rows, schema)


def aligned(docs: DataFrame, id_column: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per input row: the id, `n_a`, `n_b`, `n_groups`, `n_links`, `n_best`, `count_sum`, `groups_sha256`.

    The first tokenizer reads a space and the text, the second the text (it adds the space itself). Texts that are NULL
    or empty, or that either tokenizer does not give back byte for byte, have no tokens: zeros and an empty
    `groups_sha256`. Repeated rows count as often as they occur; NULL ids are ids like any other; other columns do not
    matter. Very long texts are cut where no token can reach across. An empty input gives an empty result.
    """
    documents, postings = indexed(docs, id_column, text, **options)
    return scored(documents, postings, pair_counts(postings)).select(
        F.col("id").alias(id_column), "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum",
        "groups_sha256",
    )


def op13_pair_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(table(spark, sf_dir, "documents"))
