import random

import numpy as np
import pytest

from marklens.llm import token_counts as T


@pytest.mark.parametrize(("block", "group"), [(1, 2), (2, 3), (5, 2), (64, 1_024)])
def test_any_cut_gives_the_same_counts(spark, monkeypatch, block, group):
    """Documents longer than blocks, empty documents, blocks without a separator, an unclosed end, several streams."""
    monkeypatch.setattr(T, "GROUP_BLOCKS", group)
    rnd = random.Random(block)
    rows, want = [], []
    for stream in range(4):
        lengths = [rnd.choice([0, 0, 1, 3, 17]) for _ in range(rnd.randint(0, 12))]
        tail = rnd.choice([0, 4]) if stream else 7
        flat = [t for n in lengths for t in [*rnd.choices(range(50_000), k=n), T.END_OF_DOCUMENT]] + rnd.choices(range(50_000), k=tail)
        want += [(stream, i, n, True) for i, n in enumerate(lengths)] + ([(stream, len(lengths), tail, False)] if tail else [])
        rows += [
            (stream, b, bytearray(np.array(flat[at : at + block], T.TOKEN_TYPE).tobytes()))
            for b, at in enumerate(range(0, len(flat), block))
        ]
    rnd.shuffle(rows)
    blocks = spark.createDataFrame(rows, "stream bigint, block bigint, tokens binary").repartition(3)
    assert sorted(map(tuple, T.document_lengths(blocks).collect())) == sorted(want)


@pytest.mark.parametrize("block_tokens", [3, 100, 1 << 18])
def test_counts_match_direct_encoding(docs_of, block_tokens):
    rnd = random.Random(1)
    texts = [" ".join(rnd.choices(["token", "<|endoftext|>", "é", "a b", "12345"], k=rnd.randint(0, 30))) for _ in range(60)]
    encode = T.encoder().encode_ordinary
    got = {r["doc_id"]: r["n_tokens"] for r in T.token_counts(docs_of(texts), block_tokens=block_tokens).collect()}
    assert got == {i: len(encode(t)) for i, t in enumerate(texts)}


def test_odd_rows(spark, odd_docs, no_docs):
    texts = {r["doc_id"]: r["text"] or "" for r in odd_docs.select("doc_id", "text").collect()}
    encode = T.encoder().encode_ordinary
    rows = T.token_counts(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert all(r["n_tokens"] == len(encode(texts[r["doc_id"]])) for r in rows)
    assert T.token_counts(no_docs).count() == 0
    empty = spark.createDataFrame([(0, 0, None), (0, 1, bytearray())], "stream bigint, block bigint, tokens binary")
    assert T.document_lengths(empty).count() == 0
