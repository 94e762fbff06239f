import random
from collections import Counter

import numpy as np
import pytest

from marklens.llm import rlz as R


def expected(texts, window):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    results = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        results.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return results


def results(docs, **options):
    rows = R.without_repeats(docs, **options).collect()
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in rows}


@pytest.mark.parametrize(("window", "gram", "letters"), [(5, 2, 3), (6, 3, 4), (4, 1, 2), (8, 8, 3)])
def test_small_windows_match_brute_force(docs_of, window, gram, letters):
    """Few different words, so windows repeat within texts, across them, and overlap in every way."""
    rnd = random.Random(window)
    texts = []
    for _ in range(120):
        size = rnd.choice([0, 1, window - 1, window, 20, 60])
        texts.append(" ".join(rnd.choice("abcdefgh"[: rnd.randint(1, letters) + 4]) for _ in range(size)))
    texts += ["x " * 50, "x y " * 30, texts[7], texts[7], "a  a\nb", None]
    assert results(docs_of(texts), window=window, gram=gram) == dict(enumerate(expected(texts, window)))


def test_passages_in_other_surroundings(docs_of):
    """One passage in most texts, at any place; texts of other passages; copies; a passage one word too short."""
    rnd = random.Random(9)
    vocabulary = [f"w{i}" for i in range(5_000)]

    def text(n):
        return rnd.choices(vocabulary, k=n)

    passages = [text(n) for n in (34, 35, 36, 60, 200)]
    texts = []
    for i in range(150):
        body = text(rnd.randint(0, 120))
        for passage in rnd.sample(passages, rnd.choice([0, 1, 1, 2])) + ([passages[3]] if i % 3 else []):
            at = rnd.randint(0, len(body))
            body[at:at] = passage
        texts.append(" ".join(body))
    texts += texts[:20]
    assert results(docs_of(texts)) == dict(enumerate(expected(texts, 35)))


def test_copies_of_repetitive_texts_with_other_ends(docs_of):
    """Windows that are unique within a text occur again in its copies, also where their piece matches itself."""
    words = "abcdefghijkl"
    texts = [" ".join([w] * 60 + [end]) for w in words for end in ("x", "y", "z")]
    texts += [" ".join([start] + [w] * 50 + [end]) for w in words for start, end in (("p", "q"), ("r", "s"))]
    texts = texts * 2 + texts[::3]
    texts += [" ".join(["m"] * 60 + [end]) for end in "uvw"]
    assert results(docs_of(texts)) == dict(enumerate(expected(texts, 35)))


def test_odd_rows(odd_docs, no_docs):
    rows = odd_docs.select("doc_id", "text").collect()
    want = sorted(((r["doc_id"], *w) for r, w in zip(rows, expected([r["text"] for r in rows], 35))), key=str)
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in R.without_repeats(odd_docs).collect()), key=str)
    assert got == want
    assert R.without_repeats(no_docs).count() == 0


def test_pieces_cover_every_window_once():
    rnd = random.Random(4)
    for size in (35, 36, 70, 500):
        text = " ".join(rnd.choice("ab") for _ in range(size)).encode()
        pieces = R.Pieces(text)
        covered = np.concatenate([np.arange(s, s + n) for s, n in zip(pieces.starts, pieces.sizes)])
        assert covered.tolist() == list(range(size - 34))
        assert max(pieces.sizes) <= 28
