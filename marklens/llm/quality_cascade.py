"""Quality rules as a short-circuit cascade, ordered by rejections per cost.

Each rule rejects on a measure of the text. Cost and selectivity of every rule are estimated on a bounded sample, rules
are ordered by how many texts they reject per second, and a text that one rule rejects meets no further one. The order
changes what is computed, never the verdict: a text is kept if no rule rejects it.

A text's measures share one pass over its words where they can, and all are computed on the whole text.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, per_text, table

SAMPLE_ROWS = 200
REPEAT_WINDOW = 5
SYMBOLS = b"#*$%&|<>"
_CONTINUATION = bytes(range(0x80, 0xC0))
_UPPER = bytes(range(0x41, 0x5B))
_LETTERS = _UPPER + bytes(range(0x61, 0x7B))


class Text:
    """A text and its measures, each computed when first asked for."""

    def __init__(self, value: bytes) -> None:
        self.value = value
        self.words = value.split()
        self._measures: dict[str, int] = {}

    def __getitem__(self, name: str) -> int:
        found = self._measures.get(name)
        if found is None:
            found = self._measures[name] = MEASURES[name](self)
        return found


def _occurrences(value: bytes, of: bytes) -> int:
    return len(value) - len(value.translate(None, of))


def _word_chars(text: Text) -> int:
    joined = b"".join(text.words)
    return len(joined) - _occurrences(joined, _CONTINUATION)


def _dup_lines(text: Text) -> int:
    lines = [line for line in text.value.split(b"\n") if line.split()]
    return len(lines) - len(set(lines))


def _repeat_words(text: Text, width: int = REPEAT_WINDOW) -> int:
    """Words inside a window of `width` words that is found again in the text, the first finding included."""
    windows = len(text.words) - width + 1
    if windows < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in text.words), np.int64, len(text.words))
    if len(numbers) == len(text.words):
        return 0
    # A window's code is made exact step by step: the codes so far are renumbered before another word joins.
    codes, distinct = ids[:windows], len(numbers)
    for offset in range(1, width):
        if distinct * len(numbers) >= 1 << 62:
            _, codes = np.unique(codes, return_inverse=True)
            distinct = int(codes.max()) + 1
        codes = codes * len(numbers) + ids[offset : offset + windows]
        distinct *= len(numbers)
    order = np.argsort(codes, kind="stable")
    same = codes[order[1:]] == codes[order[:-1]]
    if not same.any():
        return 0
    starts = np.zeros(len(text.words) + 1, np.int64)
    again = np.zeros(windows, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    starts[:windows] += again
    starts[width : width + windows] -= again
    return int((np.cumsum(starts) > 0).sum())


MEASURES: dict[str, Callable[[Text], int]] = {
    "n_words": lambda text: len(text.words),
    "word_chars": _word_chars,
    "n_symbols": lambda text: _occurrences(text.value, SYMBOLS),
    "n_dup_lines": _dup_lines,
    "n_repeat_words": _repeat_words,
    "n_upper": lambda text: _occurrences(text.value, _UPPER),
    "n_letters": lambda text: _occurrences(text.value, _LETTERS),
    "n_lines": lambda text: sum(1 for line in text.value.split(b"\n") if line.split()),
}


@dataclass(frozen=True)
class Rule:
    """Rejects a text on its measures."""

    name: str
    rejects: Callable[[Text], bool]


def too_short(least: int = 10) -> Rule:
    return Rule("too_short", lambda t: t["n_words"] < least)


def repetitive(percent: int = 20) -> Rule:
    return Rule("repetitive", lambda t: 100 * t["n_repeat_words"] > percent * t["n_words"])


def symbol_heavy(percent: int = 25) -> Rule:
    """More symbols than this share of the words."""
    return Rule("symbol_heavy", lambda t: 100 * t["n_symbols"] > percent * t["n_words"])


def odd_words(shortest: float = 2.0, longest: float = 15.0) -> Rule:
    """Mean word length, in characters, outside the bounds."""
    return Rule("odd_words", lambda t: not shortest * t["n_words"] <= t["word_chars"] <= longest * t["n_words"])


def repeated_lines(percent: int = 30) -> Rule:
    """Lines equal to an earlier one make up more than this share."""
    return Rule("repeated_lines", lambda t: 100 * t["n_dup_lines"] > percent * max(1, t["n_lines"]))


def shouting(percent: int = 60) -> Rule:
    """More of the ASCII letters are capitals than this share."""
    return Rule("shouting", lambda t: 100 * t["n_upper"] > percent * max(1, t["n_letters"]))


RULES = (too_short(), repetitive(), symbol_heavy(), odd_words(), repeated_lines(), shouting())
BASE_RULES = frozenset(("too_short", "repetitive"))


def ordered_rules(docs: DataFrame, text: str, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> tuple[Rule, ...]:
    """The rules by rejections per second on a sample of at most `sample_rows` texts; free ones that reject none last.

    The sample is whatever rows come first: it sets the order alone, which no result depends on.
    """
    sample = [bytes(row[0]) for row in docs.select(as_bytes(text)).limit(sample_rows).collect()]
    rates = {}
    for rule in rules:
        begin, rejected = time.perf_counter(), 0
        for value in sample:
            rejected += rule.rejects(Text(value))
        rates[rule.name] = rejected / (time.perf_counter() - begin + 1e-9)
    return tuple(sorted(rules, key=lambda rule: -rates[rule.name]))


def first_rejection(text: Column, rules: tuple[Rule, ...]) -> Column:
    """Name of the first rule that rejects a text, NULL for a kept one. `text` holds bytes."""

    def rows(texts: list[bytes]) -> Iterator[tuple]:
        for value in texts:
            held = Text(value)
            yield (next((rule.name for rule in rules if rule.rejects(held)), None),)

    return per_text("rule string", rows)(text)["rule"]


def kept_documents(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows whose text no rule rejects, with all their columns.

    A NULL or empty text has no words and is rejected as too short. Repeated rows are judged alike. An empty input
    gives an empty result.
    """
    ordered = ordered_rules(docs, text, rules)
    return docs.filter(first_rejection(as_bytes(text), ordered).isNull())


REPORTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judged_documents(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """One row per input row: the id, the reported measures, `base_failed`, `kept` and `rejected_by`.

    `base_failed` tells that a rule of `BASE_RULES` rejects the text. The measures are those the cascade has computed
    already, completed where it stopped short.
    """
    ordered = ordered_rules(docs, text, rules)
    base = [rule for rule in rules if rule.name in BASE_RULES]

    def rows(texts: list[bytes]) -> Iterator[tuple]:
        for value in texts:
            held = Text(value)
            rejected_by = next((rule.name for rule in ordered if rule.rejects(held)), None)
            failed = any(rule.rejects(held) for rule in base)
            yield (*(held[name] for name in REPORTED), failed, rejected_by is None, rejected_by)

    schema = ", ".join(f"{name} bigint" for name in REPORTED) + ", base_failed boolean, kept boolean, rejected_by string"
    judged = per_text(schema, rows)(as_bytes(text))
    return docs.select(F.col(id_column), judged.alias("r")).select(id_column, "r.*")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged_documents(table(spark, sf_dir, "documents")).drop("rejected_by")


# Words are counted by splitting on the six white-space characters; repeated windows by joining five neighbours.
OP6_SQL = r"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), split AS (
  SELECT r, doc_id, text,
    list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM texts
), windows AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS found FROM (
    SELECT r, i, array_to_string(words[i:i + 4], ' ') AS gram
    FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM split)
  )
), covered AS (
  SELECT r, count(DISTINCT i + o) AS n FROM windows, (SELECT unnest(range(0, 5)) AS o) WHERE found > 1 GROUP BY r
), measured AS (
  SELECT doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(lines) AS n_lines,
    length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper,
    length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g')) AS n_letters
  FROM split LEFT JOIN covered USING (r)
), judged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM measured
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT (base_failed OR 100 * n_symbols > 25 * n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
    OR 100 * n_dup_lines > 30 * greatest(1, n_lines) OR 100 * n_upper > 60 * greatest(1, n_letters)) AS kept
FROM judged
"""
