"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared as lower-case words between single spaces. An item of m characters may differ in
`error_rate * m` edits. Cut into one piece more than it has edits to spend, it leaves at least one piece untouched
wherever it occurs, so exact finds of pieces (one Aho-Corasick pass per text) show every place worth a look; there
Myers' bit-parallel distance decides. No find is skipped, and texts are read whole.

Items travel to the documents in blocks of bounded size, one pass per block, so documents are never shuffled.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import entries_of
from .common import per_text, table

ERROR_RATE = 0.05
# UTF-8 bytes of item texts in a block, on average.
BLOCK_BYTES = 8 << 20
_WORDS = re.compile(r"[^\W_]+")


def normal(text: str) -> str:
    """Lower-case words, each between two spaces, so that what is compared begins and ends with a word; "" without any."""
    words = _WORDS.findall(text.lower())
    return f" {' '.join(words)} " if words else ""


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """`errors + 1` pieces of an item, each with its place, as equal in length as can be."""
    edges = [len(item) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def best_match(item: str, masks: dict[str, int], text: str, errors: int) -> tuple[int, int] | None:
    """Least edit distance of the item to a part of the text, and where that part ends; None above `errors`.

    Myers' column-wise recurrence with one bit per item character; a match may begin anywhere in the text.
    """
    every, top = (1 << len(item)) - 1, 1 << (len(item) - 1)
    plus, minus, distance = every, 0, len(item)
    best: tuple[int, int] | None = None
    for at, character in enumerate(text):
        equal = masks.get(character, 0)
        vertical = equal | minus
        horizontal = (((equal & plus) + plus) ^ plus) | equal
        up, down = minus | ~(horizontal | plus), plus & horizontal
        if up & top:
            distance += 1
        elif down & top:
            distance -= 1
        up, down = up << 1, down << 1
        plus = (down | ~(vertical | up)) & every
        minus = up & vertical & every
        if distance <= errors and (best is None or distance < best[0]):
            best = (distance, at + 1)
            if distance == 0:
                break
    return best


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping spans joined, so that nothing is compared twice."""
    joined: list[tuple[int, int]] = []
    for begin, stop in sorted(spans):
        if joined and begin <= joined[-1][1]:
            joined[-1] = (joined[-1][0], max(stop, joined[-1][1]))
        else:
            joined.append((begin, stop))
    return joined


class Items:
    """A block of benchmark items, ready for search."""

    def __init__(self, items: list[tuple], error_rate: float) -> None:
        """`items` holds (id, text); items without a word match nothing."""
        self.ids, self.texts, self.errors, self.masks = [], [], [], []
        self.automaton = ahocorasick.Automaton()
        places = defaultdict(list)
        for item_id, text in items:
            item = normal(text or "")
            if not item:
                continue
            errors = min(int(error_rate * len(item)), len(item) - 1)
            for offset, piece in pieces(item, errors):
                places[piece].append((len(self.ids), offset))
            masks: dict[str, int] = defaultdict(int)
            for at, character in enumerate(item):
                masks[character] |= 1 << at
            self.ids.append(item_id)
            self.texts.append(item)
            self.errors.append(errors)
            self.masks.append(dict(masks))
        for piece, found in places.items():
            self.automaton.add_word(piece, (len(piece), found))
        if places:
            self.automaton.make_automaton()

    def leaks(self, text: str) -> list[tuple]:
        """(item id, distance, end in the normal text) of each item that the text holds, its best match."""
        if not self.ids:
            return []
        text = normal(text)
        looks: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for end, (length, places) in self.automaton.iter(text):
            for item, offset in places:
                begin = end + 1 - length - offset - self.errors[item]
                looks[item].append((max(0, begin), begin + len(self.texts[item]) + 2 * self.errors[item]))
        found = []
        for item, spans in looks.items():
            best = None
            for begin, stop in _merged(spans):
                match = best_match(self.texts[item], self.masks[item], text[begin:stop], self.errors[item])
                if match and (best is None or match[0] < best[0]):
                    best = (match[0], begin + match[1])
            if best:
                found.append((self.ids[item], *best))
        return sorted(found, key=repr)


def item_blocks(benchmark: DataFrame, id_column: str = "item_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple]]:
    """The benchmark in blocks of about `block_bytes`, dealt by hash."""
    items = benchmark.select(F.col(id_column).alias("id"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(-(-size // block_bytes))
    for block in range(blocks):
        dealt = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block)
        yield [tuple(row) for row in dealt.collect()]


def leaked_items(text: Column, items: list[tuple], id_type: str = "bigint", error_rate: float = ERROR_RATE) -> Column:
    """Array of structs `item_id`, `distance`, `end` for one block of items."""
    sent = SparkSession.active().sparkContext.broadcast({"items": items})

    def rows(texts: list[str]) -> Iterator[tuple]:
        held = sent.value
        if "search" not in held:  # once per Python worker
            held["search"] = Items(held["items"], error_rate)
        for value in texts:
            yield ([{"item_id": i, "distance": d, "end": e} for i, d, e in held["search"].leaks(value)],)

    schema = f"leaks array<struct<item_id:{id_type},distance:int,end:int>>"
    return per_text(schema, rows)(F.coalesce(text, F.lit("")))["leaks"]


def _id_type(benchmark: DataFrame, id_column: str) -> str:
    return benchmark.schema[id_column].dataType.simpleString()


def leaks(
    docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", error_rate: float = ERROR_RATE, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document and benchmark item it holds: the id, `item_id`, `distance`, and `end` of the best match.

    NULL and empty texts hold nothing; NULL items, and items without a letter or digit, are held by nothing. Repeated
    documents and repeated items give repeated rows. Without documents or without items the result is empty.
    """
    kind = _id_type(benchmark, item_id)
    result = None
    for items in item_blocks(benchmark, item_id, item_text, block_bytes):
        found = docs.select(F.col(id_column), leaked_items(F.col(text), items, kind, error_rate).alias("leaks"))
        found = found.select(id_column, F.inline(entries_of("leaks")))
        result = found if result is None else result.unionByName(found)
    if result is None:
        result = docs.limit(0).select(
            id_column, F.lit(None).cast(kind).alias("item_id"), F.lit(0).alias("distance"), F.lit(0).alias("end")
        )
    return result


def without_leaks(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    error_rate: float = ERROR_RATE, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns; see `leaks` for odd inputs."""
    for items in item_blocks(benchmark, item_id, item_text, block_bytes):
        docs = docs.filter(F.size(leaked_items(F.col(text), items, _id_type(benchmark, item_id), error_rate)) == 0)
    return docs


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
