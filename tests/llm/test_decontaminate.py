import random

import pytest

from marklens.llm import decontaminate as D


def distance(item, text):
    """Least edit distance of the item to any part of the text."""
    column = list(range(len(item) + 1))
    best = column[-1]
    for c in text:
        following = [0]
        for i, p in enumerate(item):
            following.append(min(column[i] + (p != c), column[i + 1] + 1, following[i] + 1))
        column = following
        best = min(best, column[-1])
    return best


def test_bit_parallel_distance():
    rnd = random.Random(1)
    for _ in range(1_500):
        item = "".join(rnd.choices("ab c", k=rnd.randint(1, 90)))
        text = "".join(rnd.choices("ab c", k=rnd.randint(0, 120)))
        masks = {}
        for at, c in enumerate(item):
            masks[c] = masks.get(c, 0) | 1 << at
        limit = rnd.choice([0, 3, len(item)])
        found, want = D.best_match(item, masks, text, limit), distance(item, text)
        assert (found[0] if found else None) == (want if want <= limit and text else None)


def edited(text, edits, rnd):
    letters = list(text)
    for _ in range(edits):
        at = rnd.randrange(len(letters))
        kind = rnd.choice("sdi")
        if kind == "s":
            letters[at] = rnd.choice("xyz")
        elif kind == "d":
            del letters[at]
        else:
            letters.insert(at, rnd.choice("xyz"))
    return "".join(letters)


@pytest.fixture(scope="module")
def case():
    rnd = random.Random(4)
    words = ["".join(rnd.choices("abcdefghij", k=rnd.randint(2, 8))) for _ in range(300)]
    items = [" ".join(rnd.choices(words, k=rnd.choice([3, 12, 40]))) for _ in range(25)]
    texts = []
    for number in range(120):
        before, after = (" ".join(rnd.choices(words, k=rnd.randint(0, 80))) for _ in "xy")
        item = items[number % len(items)]
        budget = int(D.ERROR_RATE * len(D.normal(item)))
        kind = number % 4
        inner = [item.upper().replace(" ", " ,\n"), edited(item, rnd.randint(0, budget), rnd), edited(item, 3 * budget + 2, rnd), ""][kind]
        texts.append(f"{before} {inner} {after}")
    return items, texts


@pytest.mark.parametrize("block_bytes", [1 << 20, 700])
def test_leaks_match_brute_force(spark, docs_of, case, block_bytes):
    """Every item against every text by dynamic programming; also with the items in several blocks."""
    items, texts = case
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in D.leaks(docs_of(texts), benchmark, block_bytes=block_bytes).collect()}
    want = {}
    for d, text in enumerate(texts):
        for i, item in enumerate(items):
            item = D.normal(item)
            least = distance(item, D.normal(text))
            if least <= int(D.ERROR_RATE * len(item)):
                want[d, i] = least
    assert got == want and len(want) >= 60
    left = D.without_leaks(docs_of(texts), benchmark, block_bytes=block_bytes)
    assert {r["doc_id"] for r in left.collect()} == set(range(len(texts))) - {d for d, _ in want}


def test_odd_rows(spark, odd_docs, no_docs):
    items = [(1, None), (2, ""), (3, "?!"), (4, "a"), (5, "größere zahl"), (5, "größere zahl"), (6, "word " * 30)]
    benchmark = spark.createDataFrame(items, "item_id int, text string")
    found = D.leaks(odd_docs, benchmark)
    assert found.dtypes == [("doc_id", "bigint"), ("item_id", "int"), ("distance", "int"), ("end", "int")]
    pairs = sorted((r["doc_id"], r["item_id"], r["distance"]) for r in found.collect())
    # Repeated documents and items are reported as often as they occur; "a" is a word of the two texts "a" alone.
    assert [p for p in pairs if p[1] == 4] == [(3, 4, 0)] * 2 + [(4, 4, 0)]
    assert [p for p in pairs if p[1] == 5] == [(8, 5, 0)] * 4
    assert [p for p in pairs if p[1] == 6] == [(6, 6, 0)] * 2 + [(7, 6, 0)]
    assert not [p for p in pairs if p[1] < 4]
    left = D.without_leaks(odd_docs, benchmark)
    assert left.columns == odd_docs.columns
    assert {r["doc_id"] for r in left.collect()} == {0, 1, 2, 5, 9, None}
    assert D.leaks(no_docs, benchmark).count() == 0
    assert D.leaks(odd_docs, benchmark.limit(0)).count() == 0
    assert D.without_leaks(odd_docs, benchmark.limit(0)).count() == odd_docs.count()
