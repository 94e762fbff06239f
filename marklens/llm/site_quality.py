"""Quality of documents by hierarchical empirical Bayes: a document's own evidence on top of what its site is like.

A logistic classifier, trained on a bounded sample of labelled rows, gives each document a posterior from its text
alone. Grouped sums of these make a posterior for each host and, below it, for each path. Each level shrinks toward the
one above, by pseudo-counts estimated from how much sites differ beyond chance, so a site with few documents keeps the
prior of its host, and a host with few that of the whole corpus. A document's odds are then the odds of its own text
times the odds of its site relative to the corpus; its own share in its site's sums is taken out first.

Toxicity is a target of its own: a second logistic classifier, on hashed words, reads each text in the same stage. A
document is kept if it is likely good and not likely toxic.

Only slim rows are shuffled: texts become two numbers in the first stage. Sums combine on the map side, and the joins
back can be split, so one host may own any share of all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import as_bytes, per_text, split_join, table

SAMPLE_ROWS = 2_000
# Bounds of the pseudo-counts by which a level leans on the one above.
LEAST_PSEUDO, MOST_PSEUDO = 2.0, 200.0
RIDGE = 1.0
ROUNDS = 25
_UPPER, _LOWER, _DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789"
# Buckets of hashed words; a text's set of them is a bit each, so a sampled text is at most 32 KB to the driver.
BUCKETS = 1 << 18
WORD_RIDGE = 1.0
# Deviate at which a word's evidence counts as sure, and the power by which weaker evidence is held back.
SURE, EASE = 4.0, 8
_WORDS = bytes(c + 32 if c in _UPPER else c if c in _LOWER + _DIGITS or c > 127 else 32 for c in range(256))
_SYMBOLS, _STOPS = b"#*$%&|<>{}[]\\^~=_@+", b".,;:!?"


def features(text: bytes) -> list[float]:
    """Shares and logarithms of counts over the whole text."""
    size = len(text)
    words = text.split()
    count = len(words)
    counted = [size - len(text.translate(None, group)) for group in (_UPPER, _LOWER, _DIGITS, _SYMBOLS, _STOPS)]
    upper, lower, digits, symbols, stops = counted
    lines = text.count(b"\n") + 1
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return [
        1.0,
        np.log1p(count),
        (size - lines) / (count + 1) / 10,
        upper / (upper + lower + 1),
        digits / (size + 1),
        symbols / (count + 1),
        stops / (count + 1),
        len(set(words)) / (count + 1),
        repeats / (count + 1),
        text.count(b"!") / (count + 1),
        np.log1p(count / lines),
    ]


class Classifier:
    """Logistic regression by Newton steps on standardised features."""

    def __init__(self, examples: list[tuple[list[float], int]]) -> None:
        """Without examples of both classes every text gets the share of good ones, 1/2 if there are none at all."""
        width = len(features(b""))
        values = np.array([x for x, _ in examples], float).reshape(len(examples), width)
        wanted = np.array([y for _, y in examples], float)
        self.mean, self.scale = np.zeros(width), np.ones(width)
        self.weights = np.zeros(width)
        self.prior = float((wanted.sum() + 1) / (len(wanted) + 2))
        if not examples or wanted.min() == wanted.max():
            self.weights[0] = np.log(self.prior / (1 - self.prior))
            return
        self.mean[1:] = values[:, 1:].mean(axis=0)
        self.scale[1:] = values[:, 1:].std(axis=0) + 1e-9
        inputs = (values - self.mean) / self.scale
        penalty = np.full(width, RIDGE)
        penalty[0] = 1e-6
        for _ in range(ROUNDS):
            chance = 1 / (1 + np.exp(-np.clip(inputs @ self.weights, -30, 30)))
            gradient = inputs.T @ (wanted - chance) - penalty * self.weights
            curvature = (inputs * (chance * (1 - chance))[:, None]).T @ inputs + np.diag(penalty)
            self.weights += np.linalg.solve(curvature, gradient)

    def chances(self, values: np.ndarray) -> np.ndarray:
        logits = np.clip(((values - self.mean) / self.scale) @ self.weights, -12, 12)
        return 1 / (1 + np.exp(-logits))


def word_buckets(text: bytes) -> np.ndarray:
    """Buckets of the text's words, each once, in order. Words are runs of letters, digits and bytes beyond ASCII, A-Z folded."""
    words = set(text.translate(_WORDS).split())
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)) % BUCKETS).astype(np.int64)


class WordClassifier:
    """Logistic regression on the presence of words, by Newton steps that conjugate gradients solve."""

    def __init__(self, examples: list[tuple[np.ndarray, int]]) -> None:
        """`examples` are buckets and 0 or 1. Of one class alone, every text gets its smoothed share."""
        wanted = np.array([y for _, y in examples], float)
        share = float((wanted.sum() + 1) / (len(wanted) + 2))
        self.bias, self.weights = float(np.log(share / (1 - share))), np.zeros(BUCKETS, np.float32)
        if not examples or wanted.min() == wanted.max():
            return
        owner = np.repeat(np.arange(len(examples)), [len(x) for x, _ in examples])
        used, place = np.unique(np.concatenate([x for x, _ in examples]), return_inverse=True)
        width = len(used)
        # Labels are noisy, and a rare word can explain a wrong one: the weaker its evidence, by the deviate of its
        # smoothed log odds ratio, the more a word's weight is held back.
        with_word = np.bincount(place, wanted[owner], width) + 1
        without = np.bincount(place, 1 - wanted[owner], width) + 1
        ratio = np.log(with_word / (wanted.sum() + 2)) - np.log(without / (len(wanted) - wanted.sum() + 2))
        deviate = np.abs(ratio) / np.sqrt(1 / with_word + 1 / without)
        penalty = np.append(WORD_RIDGE * (SURE / np.maximum(deviate, 0.1)) ** EASE, 1e-6)

        def logits(weights: np.ndarray) -> np.ndarray:
            return np.bincount(owner, weights[place], len(examples)) + weights[-1]

        def back(values: np.ndarray) -> np.ndarray:
            return np.append(np.bincount(place, values[owner], width), values.sum())

        def loss(weights: np.ndarray) -> float:
            scores = logits(weights)
            return float((np.logaddexp(0, scores) - wanted * scores).sum() + (penalty * weights**2).sum() / 2)

        weights = np.append(np.zeros(width), self.bias)
        for _ in range(ROUNDS):
            chance = 1 / (1 + np.exp(-np.clip(logits(weights), -30, 30)))
            rest = back(wanted - chance) - penalty * weights
            if np.abs(rest).max() < 1e-4:
                break
            spread = chance * (1 - chance)
            scale = 1 / (back(spread) + penalty)
            step, target = np.zeros(width + 1), 1e-6 * float(rest @ rest)
            eased = scale * rest
            way, size = eased, float(rest @ eased)
            for _ in range(100):
                bent = back(spread * logits(way)) + penalty * way
                length = size / float(way @ bent)
                step, rest = step + length * way, rest - length * bent
                if float(rest @ rest) < target:
                    break
                eased = scale * rest
                before, size = size, float(rest @ eased)
                way = eased + size / before * way
            now = loss(weights)
            for _ in range(20):
                if loss(weights + step) <= now:
                    weights = weights + step
                    break
                step = step / 2
        self.bias = float(weights[-1])
        self.weights[used] = weights[:-1]

    def chance(self, buckets: np.ndarray) -> float:
        logit = self.bias + float(self.weights[buckets].sum(dtype=float))
        return float(1 / (1 + np.exp(-min(12.0, max(-12.0, logit)))))


def _bits(buckets: np.ndarray) -> bytes:
    present = np.zeros(BUCKETS, bool)
    present[buckets] = True
    return zstandard.ZstdCompressor(level=1).compress(np.packbits(present).tobytes())


def _buckets(bits: bytes) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(bits), np.uint8)))


def trained_toxicity(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "toxic",
    sample_rows: int = SAMPLE_ROWS,
) -> WordClassifier | None:
    """A word classifier trained on at most `sample_rows` labelled rows; None if `labels` has no such column or examples."""
    if label not in labels.columns:
        return None
    joined = _labelled(docs, labels, id_column, text, label, sample_rows)
    bits = per_text("x binary", lambda texts: ((_bits(word_buckets(t)),) for t in texts))(F.col("text"))["x"]
    rows = joined.select(F.col(id_column).alias("id"), "label", bits.alias("x")).orderBy("id", "label", "x").limit(sample_rows)
    examples = [(_buckets(row["x"]), int(row["label"])) for row in rows.collect()]
    return WordClassifier(examples) if examples else None


def _labelled(docs: DataFrame, labels: DataFrame, id_column: str, text: str, label: str, sample_rows: int) -> DataFrame:
    """Id, `text` and `label` of the documents of at most `sample_rows` labels, those of the least hash of the id."""
    chosen = labels.select(F.col(id_column), F.col(label).alias("label")).filter(
        F.col("label").isNotNull() & F.col(id_column).isNotNull()
    ).orderBy(F.xxhash64(id_column), id_column).limit(sample_rows)
    return docs.select(F.col(id_column), as_bytes(text).alias("text")).join(F.broadcast(chosen), id_column)


def trained_classifier(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "quality",
    sample_rows: int = SAMPLE_ROWS,
) -> Classifier:
    """A classifier trained on at most `sample_rows` labelled rows, those of the least hash of the id."""
    joined = _labelled(docs, labels, id_column, text, label, sample_rows)
    vector = per_text("x array<double>", lambda texts: ((features(t),) for t in texts))(F.col("text"))["x"]
    # A row per labelled document, of eleven numbers; documents that share an id are cut to the same bound.
    rows = joined.select(F.col(id_column).alias("id"), "label", vector.alias("x")).orderBy("id", "label", "x").limit(sample_rows)
    return Classifier([(list(row["x"]), int(row["label"])) for row in rows.collect()])


def text_chances(text: Column, model: Classifier, toxicity: WordClassifier | None) -> Column:
    """Posteriors of quality, `chance`, and of toxicity, `toxic`, from the text alone. `text` holds bytes."""

    def rows(texts: list[bytes]) -> Iterator[tuple]:
        if texts:
            for value, chance in zip(texts, model.chances(np.array([features(value) for value in texts])), strict=True):
                yield float(chance), toxicity.chance(word_buckets(value)) if toxicity else None

    return per_text("chance double, toxic double", rows)(text)


def _odds(chance: Column) -> Column:
    return F.log(chance / (1 - chance))


def _pseudo_count(sites: DataFrame, total: float) -> float:
    """Pseudo-count of a level from the spread of its sites' means, by moments, over sites of two rows or more."""
    mean = F.col("site_sum") / F.col("site_n")
    spread = F.greatest(F.col("site_squares") / F.col("site_n") - mean * mean, F.lit(0.0))
    row = sites.filter("site_n > 1").agg(
        F.sum("site_n").alias("n"),
        F.sum(F.col("site_n") * (mean - total) ** 2).alias("between"),
        F.sum(spread).alias("chance"),
        F.sum(F.col("site_n") * spread).alias("within"),
    ).first()
    if not row["n"]:
        return MOST_PSEUDO
    within = row["within"] / row["n"]
    between = max(0.0, (row["between"] - row["chance"]) / row["n"])
    return float(min(MOST_PSEUDO, max(LEAST_PSEUDO, within / between if between > 0 else MOST_PSEUDO)))


def site_quality(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", host: str = "source",
    path: str = "lang", label: str = "quality", sample_rows: int = SAMPLE_ROWS, threshold: float = 0.5,
    toxic_label: str = "toxic", toxic_threshold: float = 0.5,
) -> DataFrame:
    """One row per input row: the id, `text_chance`, `host_chance`, `path_chance`, `quality_chance`, `toxic_chance`, `toxic`, `kept`.

    `toxic` says that `toxic_chance` is at least its threshold; `kept`, that the quality is and the text is not toxic.
    Without toxicity labels `toxic_chance` is NULL and no row is toxic.

    NULL hosts and paths count as one nameless site each; NULL texts are judged as empty ones. Without labels the
    classifier says nothing and every row has the prior. Repeated rows count as often as they occur. An empty input
    gives an empty result.
    """
    model = trained_classifier(docs, labels, id_column, text, label, sample_rows)

    toxicity = trained_toxicity(docs, labels, id_column, text, toxic_label, sample_rows)

    def named(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit(""))

    scored = cut_lineage(
        docs.select(
            F.col(id_column), named(host).alias("_host"), named(path).alias("_path"),
            text_chances(as_bytes(text), model, toxicity).alias("_chances"),
        ).select(
            id_column, "_host", "_path", F.col("_chances.chance").alias("text_chance"), F.col("_chances.toxic").alias("toxic_chance")
        )
    )

    def sums(*keys: str) -> DataFrame:
        return scored.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("site_n"), F.sum("text_chance").alias("site_sum"),
            F.sum(F.col("text_chance") ** 2).alias("site_squares"),
        )

    paths = cut_lineage(sums("_host", "_path"))
    hosts = cut_lineage(
        paths.groupBy("_host").agg(*[F.sum(name).alias(name) for name in ("site_n", "site_sum", "site_squares")])
    )
    whole = hosts.agg(F.sum("site_n").alias("n"), F.sum("site_sum").alias("s")).first()
    prior = (whole["s"] + model.prior) / (whole["n"] + 1) if whole["n"] else model.prior
    host_pseudo, path_pseudo = _pseudo_count(hosts, prior), _pseudo_count(paths, prior)
    sites = paths.select("_host", "_path", F.col("site_n").alias("path_n"), F.col("site_sum").alias("path_sum")).join(
        hosts.select("_host", F.col("site_n").alias("host_n"), F.col("site_sum").alias("host_sum")), "_host"
    )
    placed = split_join(scored, sites, ["_host", "_path"])
    own = F.col("text_chance")
    host_chance = (F.lit(host_pseudo * prior) + F.col("host_sum") - own) / (host_pseudo + F.col("host_n") - 1)
    path_chance = (path_pseudo * F.col("host_chance") + F.col("path_sum") - own) / (path_pseudo + F.col("path_n") - 1)
    judged = (
        placed.withColumn("host_chance", host_chance)
        .withColumn("path_chance", path_chance)
        .withColumn(
            "quality_chance",
            1 / (1 + F.exp(-(_odds(own) + _odds(F.col("path_chance")) - F.lit(float(np.log(prior / (1 - prior))))))),
        )
    )
    toxic = F.coalesce(F.col("toxic_chance") >= toxic_threshold, F.lit(False))
    return judged.select(
        id_column, "text_chance", "host_chance", "path_chance", "quality_chance", "toxic_chance", toxic.alias("toxic"),
        ((F.col("quality_chance") >= threshold) & ~toxic).alias("kept"),
    )


def op8_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
