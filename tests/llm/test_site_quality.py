import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marklens.llm import site_quality as Q

WORDS = [f"{a}{b}" for a in ("th", "er", "on", "an", "re", "st") for b in ("in", "es", "at", "or", "a", "e", "ion")]


def text(rnd, good):
    words = rnd.choices(WORDS, k=rnd.randint(20, 120))
    return " ".join(words) + "." if good else " ".join(w + rnd.choice(["###", "$$$", "!!", " |"]) for w in words).upper()


@pytest.fixture(scope="module")
def case(spark):
    rnd = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        host, path = f"h{rnd.choice([0] * 10 + list(range(1, 30)))}", f"p{i % 3}"
        good = rnd.random() < (0.9 if host != "h1" else 0.2)
        rows.append((i, text(rnd, good), host, path, good))
        if i % 2:
            labels.append((i, int(good)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string, good boolean").repartition(4)
    return docs, spark.createDataFrame(labels, "doc_id bigint, quality int")


def test_held_out_accuracy(case):
    docs, labels = case
    rows = Q.site_quality(docs, labels).join(docs.select("doc_id", "good"), "doc_id").collect()
    held_out = [r for r in rows if r["doc_id"] % 2 == 0]
    assert np.mean([r["kept"] == r["good"] for r in held_out]) > 0.97
    assert all(r["kept"] for r in held_out if r["good"])


def test_shrinkage_matches_brute_force(case):
    docs, labels = case
    model = Q.trained_classifier(docs, labels)
    rows = {r["doc_id"]: r for r in docs.collect()}
    chance = {i: float(model.chances(np.array([Q.features(r["text"].encode())]))[0]) for i, r in rows.items()}
    hosts, paths = {}, {}
    for i, r in rows.items():
        hosts.setdefault(r["source"], []).append(chance[i])
        paths.setdefault((r["source"], r["lang"]), []).append(chance[i])
    prior = (sum(chance.values()) + model.prior) / (len(chance) + 1)

    def pseudo(sites):
        big = [np.array(v) for v in sites.values() if len(v) > 1]
        n = sum(map(len, big))
        spread = [v.var() for v in big]
        between = (sum(len(v) * (v.mean() - prior) ** 2 for v in big) - sum(spread)) / n
        within = sum(len(v) * s for v, s in zip(big, spread)) / n
        return min(Q.MOST_PSEUDO, max(Q.LEAST_PSEUDO, within / between if between > 0 else Q.MOST_PSEUDO))

    host_pseudo, path_pseudo = pseudo(hosts), pseudo(paths)
    for r in Q.site_quality(docs, labels).collect():
        source, lang, own = rows[r["doc_id"]]["source"], rows[r["doc_id"]]["lang"], chance[r["doc_id"]]
        host = (host_pseudo * prior + sum(hosts[source]) - own) / (host_pseudo + len(hosts[source]) - 1)
        path = (path_pseudo * host + sum(paths[source, lang]) - own) / (path_pseudo + len(paths[source, lang]) - 1)
        odds = own / (1 - own) * path / (1 - path) / (prior / (1 - prior))
        assert [r["host_chance"], r["path_chance"], r["quality_chance"]] == pytest.approx([host, path, odds / (1 + odds)], rel=1e-6)


def test_site_decides_where_the_text_does_not(spark):
    """A text between good and bad is good on a good host and bad on a bad one; a new host keeps the prior."""
    rows = [(i, "x", "good" if i < 200 else "bad", "p") for i in range(400)] + [(400, "x", "new", "p")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, quality int")
    scored = Q.site_quality(docs, labels)
    assert {round(r["quality_chance"], 2) for r in scored.collect()} == {0.5}


def test_toxic_texts_of_good_quality_are_not_kept(spark):
    """Toxic rows are labelled good and look like the others but for a word; some labels are wrong."""
    rnd = random.Random(8)
    rows, labels = [], []
    for i in range(800):
        toxic = i % 8 < 2
        words = rnd.choices(WORDS, k=rnd.randint(20, 120))
        if toxic:
            words.insert(rnd.randrange(len(words)), rnd.choice(["Idiot,", "scum", "trash."]))
        rows.append((i, " ".join(words) + ".", "h", "p", toxic))
        if i % 2:
            labels.append((i, 1, int(toxic or i % 100 == 99)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string, is_toxic boolean")
    labels = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    held_out = Q.site_quality(docs, labels).join(docs, "doc_id").filter("doc_id % 2 = 0").collect()
    assert all(r["toxic"] == (r["toxic_chance"] >= 0.5) for r in held_out)
    assert np.mean([r["toxic"] == r["is_toxic"] for r in held_out]) > 0.97
    assert all(r["kept"] == (not r["toxic"]) for r in held_out)
    blind = Q.site_quality(docs, labels.drop("toxic")).collect()
    assert all(r["toxic_chance"] is None and r["kept"] for r in blind)


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(3, 1), (5, 0), (None, 1), (6, None), (99, 1)], "doc_id bigint, quality int")
    docs = odd_docs.withColumn("source", F.when(F.col("doc_id") > 2, F.col("source")))
    rows = Q.site_quality(docs, labels).collect()
    assert len(rows) == odd_docs.count() and all(0 < r["quality_chance"] < 1 for r in rows)
    assert len(Q.site_quality(docs, labels.limit(0)).collect()) == odd_docs.count()
    assert Q.site_quality(no_docs, labels).count() == 0
