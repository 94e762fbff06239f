import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marklens.llm import feistel as S


@pytest.mark.parametrize("total", [1, 2, 3, 5, 16, 17, 63, 1_000, 4_099])
def test_permutation(spark, total):
    """Every number is hit once, whatever the grid; most do not stay where they are."""
    grid = spark.range(total).select(F.col("id").alias("number"), F.lit(total).cast("bigint").alias("total")).withColumns(
        {"high": F.ceil(F.sqrt(F.col("total").cast("double"))).cast("bigint")}
    ).withColumn("low", F.expr("(total + high - 1) div high"))
    rows = grid.select("number", S.permuted().alias("place"), S.permuted(seed=7).alias("other")).collect()
    assert sorted(r["place"] for r in rows) == sorted(r["other"] for r in rows) == list(range(total))
    if total > 900:
        assert sum(r["place"] == r["number"] for r in rows) < 10
        assert sum(r["place"] == r["other"] for r in rows) < 10


@pytest.mark.parametrize(("count", "shards"), [(100, 8), (7, 8), (8, 8), (1, 3), (333, 10)])
def test_shards(docs_of, count, shards):
    docs = docs_of([f"text {i % 40} é" for i in range(count)])
    rows = S.sharded(docs, shards, buckets=5).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(count))
    sizes = Counter(r["shard"] for r in rows)
    assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(shards)) <= 1
    for shard, size in sizes.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(size))
    for row in rows:
        text = f"text {row['doc_id'] % 40} é".encode()
        assert (row["size"], row["text_crc32"]) == (len(text) + 1, zlib.crc32(text))


def test_result_depends_on_the_rows_alone(docs_of):
    texts = [f"t{i}" for i in range(60)]
    found = [sorted(map(tuple, S.sharded(docs_of(texts, partitions)).collect())) for partitions in (1, 7)]
    assert found[0] == found[1]
    moved = sorted(map(tuple, S.sharded(docs_of(texts), seed=1).collect()))
    assert moved != found[0]


def test_many_equal_rows(spark, monkeypatch):
    """A third and more of all rows are one row; copies unfold in several steps."""
    monkeypatch.setattr(S, "UNFOLDED", 64)
    docs = spark.range(3_000).select(F.when(F.col("id") % 2 == 0, F.lit(-1)).otherwise(F.col("id")).alias("doc_id"), F.lit("x").alias("text"))
    rows = S.sharded(docs).collect()
    assert Counter(r["doc_id"] for r in rows)[-1] == 1_500
    assert sorted((r["shard"], r["slot"]) for r in rows) == [(s, i) for s in range(8) for i in range(375)]


def test_odd_rows(odd_docs, no_docs):
    texts = {r["doc_id"]: r["text"] for r in odd_docs.select("doc_id", "text").collect()}
    rows = S.sharded(odd_docs, 2).collect()
    assert len(rows) == odd_docs.count()
    assert sorted((r["shard"], r["slot"]) for r in rows) == [(0, i) for i in range(8)] + [(1, i) for i in range(7)]
    for row in rows:
        text = (texts[row["doc_id"]] or "").encode()
        assert (row["size"], row["text_crc32"]) == (len(text) + 1, zlib.crc32(text))
    assert S.sharded(no_docs).count() == 0
