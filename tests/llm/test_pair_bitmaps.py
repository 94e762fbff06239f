import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from marklens.llm import pair_bitmaps as P

TEXTS = [
    "The quick brown fox jumps over the lazy dog.",
    "  two  spaces and a tab\t, a line\nend\r\n and more   ",
    "Ärger über größere Zahlen, 東京の天気 and 😀👩‍👩‍👧 emoji",
    "Überraschung 12345 3.14 don't we'll",
    "a mark ▁ that is a space to one side only",
    "specials <|endoftext|> <s> </s> <unk> <0x41>",
    "\0\x01 control \x85   ﻿",
    "x", " ", "\n", "", None,
    "the the the the the the the the",
]


def expected(texts):
    """Rows by plain loops over the two libraries' tokens."""
    a_model, b_model = Tokenizer.from_file(P.A_FILE), sentencepiece.SentencePieceProcessor(model_file=P.B_FILE)
    a_model.encode_special_tokens = True
    alphabet = P.byte_level_alphabet()
    found, counts = [], Counter()
    for text in texts:
        whole = (" " + text).encode() if text else b""
        a = [(i, bytes(alphabet[c] for c in a_model.id_to_token(i))) for i in (a_model.encode(" " + text, add_special_tokens=False).ids if text else [])]
        b = []
        for i in b_model.encode(text or ""):
            piece = b_model.id_to_piece(i)
            b.append((i, bytes([int(piece[3:5], 16)]) if b_model.is_byte(i) else piece.replace("▁", " ").encode()))
        if b"".join(t for _, t in a) != whole or b"".join(t for _, t in b) != whole:
            a, b = [], []
        groups, links, at, left = [], [], 0, [*b]
        group_a, group_b, b_end = [], [], 0
        for i, token in a:
            at += len(token)
            group_a.append(i)
            while left and b_end + len(left[0][1]) <= at:
                j, other = left.pop(0)
                b_end += len(other)
                group_b.append(j)
            if b_end == at:
                links.append((group_a[-1], group_b[-1]))
                groups.append(",".join(map(str, group_a)) + "|" + ",".join(map(str, group_b)))
                group_a, group_b = [], []
        counts.update(links)
        found.append((len(a), len(b), groups, links))
    best = {}
    for (_, j), n in counts.items():
        best[j] = max(best.get(j, 0), n)
    return [
        (n_a, n_b, len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links),
         hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
        for n_a, n_b, groups, links in found
    ]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def results(docs, **options):
    return {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in P.aligned(docs, **options).collect()}


@pytest.mark.parametrize("options", [{}, {"block_documents": 3}, {"block_postings": 1}])
def test_rows_match_brute_force(docs_of, options):
    rnd = random.Random(1)
    words = "the of and Zahl größer été naïve 12 ' token 東京 ing un believ able".split()
    texts = TEXTS + [" ".join(rnd.choices(words, k=rnd.randint(1, 80))) for _ in range(60)] + TEXTS[:4]
    assert results(docs_of(texts), **options) == dict(enumerate(expected(texts)))


def test_odd_rows(odd_docs, no_docs):
    rows = odd_docs.select("doc_id", "text").collect()
    want = sorted(((r["doc_id"], *e) for r, e in zip(rows, expected([r["text"] for r in rows]))), key=str)
    got = sorted(((r["doc_id"], *(r[c] for c in COLUMNS)) for r in P.aligned(odd_docs).collect()), key=str)
    assert got == want
    assert P.aligned(no_docs).collect() == []


def test_texts_are_cut_where_tokens_end():
    rnd = random.Random(2)
    aligner = P.Aligner(P.A_FILE, P.B_FILE)
    pieces = ["word", "été", "x1", "  ", "\n", "a, b", "...", "東京 の", "'s", "\t", "it's", "'", "1"]
    text = " ".join(rnd.choices(pieces, k=60_000))
    for value in (text, "ab" * 100_000):
        parts = aligner.parts(value)
        a = [i for part in parts for i in aligner.a.encode(" " + part, add_special_tokens=False).ids]
        b = [i for part in parts for i in aligner.b.encode(part)]
        assert a == aligner.a.encode(" " + value, add_special_tokens=False).ids and b == aligner.b.encode(value)
    assert len(aligner.parts(text)) > 10_000


def test_counts_of_the_index(docs_of):
    """Documents by the bitmaps, links by the planes, per pair over all blocks."""
    texts = [" ".join(["the"] * (1 + i % 9)) for i in range(90)]
    documents, postings = P.indexed(docs_of(texts), block_documents=8)
    links, held = Counter(), Counter()
    aligner = P.Aligner(P.A_FILE, P.B_FILE)
    for text in texts:
        *_, pairs = aligner.linked([text])
        links.update(pairs.tolist())
        held.update(set(pairs.tolist()))
    got = P.pair_counts(postings).collect()
    size = len(aligner.b_bytes)
    assert {(r["a"] * size + r["b"], r["n_docs"], r["n_links"]) for r in got} == {(p, held[p], links[p]) for p in links}
    assert documents.count() == 90 and documents.select("block").distinct().count() > 8


@pytest.mark.parametrize("share", [0.0005, 0.01, 0.5, 1.0])
def test_containers_keep_their_numbers(share):
    numbers = np.flatnonzero(np.random.default_rng(3).random(65_536) < share)
    container = P.packed_numbers(numbers)
    assert P.unpacked_numbers(container).tolist() == numbers.tolist()
    assert P.population(container) == len(numbers)
    assert len(container) <= min(2 * len(numbers), 8_192) + 1


def test_the_faster_encoder_gives_the_same_ids():
    """Merging an entry's own bytes gives the entry, so neighbours that form one are never joined otherwise; and samples."""
    aligner = P.Aligner(P.A_FILE, P.B_FILE)
    assert aligner.quick is not None
    for number in range(aligner.a.get_vocab_size() - 1):
        found = aligner.a.model.tokenize(aligner.a.id_to_token(number))
        assert [token.id for token in found] == [number]
    rnd = random.Random(6)
    letters = [chr(i) for i in range(1, 0x250)]
    for alphabet in (letters, letters[:126], "aeinorst ' ", "th e\n\t ", "0123456789., ", "AZaz-_/=\u00a0\u0085é"):
        text = "".join(rnd.choices(alphabet, k=60_000))
        assert aligner._a_ids(text) == aligner.a.encode(" " + text, add_special_tokens=False).ids
