"""Every stage against its operator's plain version, and the whole."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from __spark_entry__ import oracle_sql, queries
from marklens.llm import decontaminate as D
from marklens.llm import quality_cascade as Q
from marklens.llm import secrets as S
from marklens.llm import sentencepiece_bpe as B
from marklens.llm.registry import ORACLES, QUERIES
from marklens.llm.simhash import fingerprint
from tools.check_oracles import canonical, connect

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not there")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage got and gave."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    folder = tmp_path_factory.mktemp("stages")
    passed = []
    for number, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, SF_DIR).write.parquet(f"{folder}/{number}")
        after = spark.read.parquet(f"{folder}/{number}")
        passed.append((docs, after))
        docs = after
    return passed


def by_id(frame):
    return {r["doc_id"]: r for r in frame.collect()}


def test_all_but_the_last_return_documents(stages):
    for before, after in stages[:-1]:
        assert after.dtypes == before.dtypes
    assert len(stages) == 5


def test_quality_stage(stages):
    before, after = map(by_id, stages[0])
    kept = {i for i, r in before.items() if not any(rule.rejects(Q.Text(r["text"].encode())) for rule in Q.RULES)}
    assert set(after) == kept and 0 < len(kept) < len(before)


def test_near_duplicate_stage(stages):
    """Kept and dropped texts by comparing all fingerprints: of those that close ones connect, the first stays."""
    before, after = map(by_id, stages[1])
    prints = {i: int.from_bytes(fingerprint(r["text"].encode()), "big") for i, r in before.items()}
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    names = sorted(prints)
    for i in names:
        for j in names:
            if j < i and (prints[i] ^ prints[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    firsts = {}
    for i in names:
        firsts.setdefault(find(i), i)
    assert set(after) == set(firsts.values()) and len(after) < len(before)
    assert all(after[i]["text"] == before[i]["text"] for i in after)


def test_decontamination_stage(spark, stages):
    before, after = map(by_id, stages[2])
    items = [D.normal(r["text"]) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    holding = {i for i, r in before.items() if any(item in D.normal(r["text"]) for item in items)}
    assert holding and not holding & set(after)
    clean = {i for i in before if i not in holding}
    assert len(clean - set(after)) <= 0.01 * len(clean)


def test_secret_stage(stages):
    before, after = map(by_id, stages[3])
    assert set(before) == set(after)
    for i, row in before.items():
        base = S.base_spans(row["text"])
        assert not S.base_spans(after[i]["text"])
        assert (after[i]["text"] != row["text"]) >= bool(base)
        assert after[i]["n_chars"] == len(after[i]["text"])
        for start, end, _ in base:
            assert row["text"][start:end] not in after[i]["text"]


def test_token_stage(stages):
    before, after = map(by_id, stages[4])
    model = B.Bpe(B.MODEL)
    assert set(before) == set(after)
    assert all(after[i]["n_tokens"] == len(model.encode(r["text"])) for i, r in before.items())


def test_odd_rows(spark, odd_docs, no_docs):
    """Each stage takes them, alone and after the others."""
    for docs in (odd_docs, no_docs):
        for position, (_, stage) in enumerate(P.STAGES):
            found = stage(spark, docs, SF_DIR)
            rows = found.collect()
            assert len(rows) <= docs.count()
            if position < 4:
                assert found.columns == docs.columns


@pytest.mark.parametrize("name", [*QUERIES, "pipeline"])
def test_registered_query(spark, name):
    got = queries()[name](spark, SF_DIR).toPandas()
    assert len(got) > 0
    if name in ORACLES:
        want = connect(SF_DIR).execute(oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert canonical(got) == canonical(want)


def test_every_operator_has_one_query():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
