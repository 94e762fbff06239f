import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from marklens.llm import radix as R


def expected(rows):
    """Sorted (id, keep_id, group_size) of (id, text) rows."""
    groups = defaultdict(list)
    for number, text in rows:
        groups[text or ""].append(number)
    keep = {text: max((n for n in ids if n is not None), default=None) for text, ids in groups.items()}
    return sorted(((n, keep[t or ""], len(groups[t or ""])) for n, t in rows), key=str)


def results(docs, **digits):
    rows = R.copies(docs, **digits).collect()
    return sorted(((r["id"], r["keep_id"], r["group_size"]) for r in rows), key=str)


@pytest.mark.parametrize(("first_digit", "growth"), [(1, 1), (1, 2), (2, 3), (256, 8)])
def test_groups_match_brute_force(docs_of, first_digit, growth):
    """Few letters, so texts share beginnings of every length, and one may end where another goes on."""
    rnd = random.Random(first_digit + growth)
    texts = ["".join(rnd.choice("ab") for _ in range(rnd.randint(0, 6))) for _ in range(150)]
    texts += ["ab" * 5, "ab" * 5 + "c", "ab" * 5, None, "", "é", "é", "\0", "\0\0", "a\0"]
    assert results(docs_of(texts), first_digit=first_digit, growth=growth) == expected([*enumerate(texts)])


def test_a_third_of_all_rows_is_one_text(docs_of):
    rnd = random.Random(5)
    hot = "x" * 1_500 + "end"
    texts = [hot if i % 3 == 0 else "x" * rnd.randint(250, 1_600) for i in range(600)]
    docs = docs_of(texts)
    assert results(docs) == expected([*enumerate(texts)])
    kept = R.without_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({k for _, k, _ in expected([*enumerate(texts)])})


def test_odd_rows(odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert results(odd_docs) == expected(rows)
    assert results(no_docs) == []
    kept = R.without_copies(odd_docs).collect()
    assert len(kept) == len({text or "" for _, text in rows})
    assert R.without_copies(no_docs).collect() == []


def test_only_null_ids(docs_of):
    docs = docs_of(["a", "a", "b"]).withColumn("doc_id", F.lit(None).cast("bigint"))
    assert results(docs) == [(None, None, 1), (None, None, 2), (None, None, 2)]
    assert len(R.without_copies(docs).collect()) == 2


def test_the_result_does_not_depend_on_partitions(docs_of):
    texts = [f"text {i % 40}" * (1 + i % 3) for i in range(200)]
    assert results(docs_of(texts, 1)) == results(docs_of(texts, 7))
