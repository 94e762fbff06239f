import hashlib
import random

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marklens.llm import sentencepiece_bpe as B


@pytest.fixture(scope="module")
def own():
    return B.Bpe(B.MODEL)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=B.MODEL)


def agree(own, library, text):
    ids = own.encode(text)
    assert ids == library.encode(text)
    assert own.decode(ids) == library.decode(ids)
    if text:
        found = own.results(text)
        assert ",".join(r[0] for r in found) == ",".join(map(str, ids))
        assert "".join(r[2] for r in found).removeprefix(" ") == library.decode(ids)


PARTS = ["a", "b", "e", "n", "r", "t", " ", "  ", "\n", "\t", "▁", "é", "一", "ﬁ", "<0x0A>", "<s>", "’", "。", "́", "😀", "the", "ing", "\x00", "1", "0"]


@settings(max_examples=1_500, deadline=None, database=None)
@given(st.one_of(st.text(max_size=40), st.lists(st.sampled_from(PARTS), max_size=40).map("".join)))
def test_like_the_library(own, library, text):
    agree(own, library, text)


def test_runs_of_spaces(own, library):
    for count in range(80):
        for after in ("", "a", "the", "\n", " x"):
            agree(own, library, " " * count + after)


def test_long_words_without_a_break(own, library):
    rnd = random.Random(6)
    agree(own, library, "".join(rnd.choices("aeinrst", k=30_000)))
    agree(own, library, "." * 5_000 + "一" * 1_000 + "=" * 3_000)


def test_full_tables_start_anew(own, library, monkeypatch):
    monkeypatch.setattr(B, "WORDS_KEPT", 3)
    monkeypatch.setattr(B, "PAIRS_KEPT", 5)
    rnd = random.Random(7)
    for _ in range(50):
        agree(own, library, " ".join("".join(rnd.choices("abcdefgh", k=rnd.randint(1, 9))) for _ in range(20)))


def test_backtracking_takes_pieces_back(own):
    """Greedy longest matches alone are not what merging gives."""
    taken_back = 0
    rnd = random.Random(8)
    for _ in range(3_000):
        text = "".join(rnd.choices("aeilnorst", k=12))
        longest, at = [], 0
        while at < len(text):
            size = max(n for n in range(1, len(text) - at + 1) if text[at : at + n] in own.ids)
            longest.append(own.ids[text[at : at + size]])
            at += size
        taken_back += own.split(text) != longest
    assert taken_back > 100


def test_odd_rows(library, odd_docs, no_docs):
    rows = odd_docs.select("doc_id", "text", B.digested(F.col("text")).alias("r"), B.encoded(F.col("text")).alias("e")).collect()
    for row in rows:
        ids = library.encode(row["text"] or "")
        digests = [hashlib.sha256(t.encode()).hexdigest() for t in (",".join(map(str, ids)), library.decode(ids))]
        assert list(row["r"]) == [len(ids), *digests]
        assert row["e"]["ids"] == ids and row["e"]["decoded"] == library.decode(ids)
    assert no_docs.select(B.digested(F.col("text"))).count() == 0


def test_pieces_across_the_ends_of_windows(own, library, monkeypatch):
    monkeypatch.setattr(B, "FIRST_WINDOW", 1)
    monkeypatch.setattr(B, "LAST_WINDOW", 40)
    rnd = random.Random(8)
    pieces = [piece.replace("▁", "") for piece in own.ids]
    for count in (1, 10, 100, 1_000):
        agree(own, library, "".join(rnd.choices(pieces, k=count)) or "a")
        agree(own, library, "".join(rnd.choices("aeinrst", k=count)))
        agree(own, library, "ab" * count + "é" * count)


def test_steps_back_cost_what_the_window_does(own, monkeypatch):
    """What is handed to searches in all grows like the text, though every other step is a step back."""
    handed = []

    class Counted:
        def iter_long(self, text):
            handed[-1] += len(text)
            return searcher.iter_long(text)

    searcher = own.automaton
    monkeypatch.setattr(own, "automaton", Counted())
    for count in (20_000, 40_000):
        handed.append(0)
        own.split("ab" * count)
    assert handed[1] < 2.1 * handed[0]


def test_tables_are_bounded_in_characters(library, monkeypatch):
    monkeypatch.setattr(B, "CHARACTERS_KEPT", 100)
    monkeypatch.setattr(B, "LONGEST_KEPT", 30)
    own = B.Bpe(B.MODEL)
    rnd = random.Random(9)
    for _ in range(50):
        agree(own, library, " ".join("".join(rnd.choices("abcdefgh", k=rnd.randint(1, 60))) for _ in range(20)))
        assert max(map(len, own.known), default=0) <= 30
        assert sum(map(len, own.known)) <= 130 and sum(map(len, own.known_before)) <= 130
