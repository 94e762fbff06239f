import itertools
import os
import random
import re
import subprocess
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from marklens.llm import secrets as S

PATTERNS = {
    "assign": r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"(AKIA[A-Z0-9]+)",
    "hex": r"([0-9a-f]+)",
}


def plain_base(text):
    spans = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            if len(m[1]) >= S.LEAST[kind]:
                spans.append((m.start(), order, m.end(), kind))
    return [(start, end, kind) for start, _, end, kind in sorted(spans)]


PARTS = ["password", "PassWD", "secret", "ſecret", "toKen", "api_key", "APIKEY", "=", ": ", ' = "', "'", "abc123", "x", "AKIA", "ABCD1234EFGH5678",
         "0123456789abcdef", "deadbeef", "é", "😀", " ", "\n", ".", "tok"]


def test_base_spans_match_the_patterns():
    rnd = random.Random(1)
    for _ in range(4_000):
        text = "".join(rnd.choices(PARTS, k=rnd.randint(0, 12)))
        assert S.base_spans(text) == plain_base(text), text


def random_field(seed):
    rng = np.random.default_rng(seed)
    field = S.Field()
    field.emit, field.step = rng.normal(size=field.emit.shape), rng.normal(size=field.step.shape)
    return field


def path_score(field, tokens, possible, path):
    scores, step = field.scores(tokens, possible), field._allowed()
    total, before = 0.0, S.OUTSIDE
    for row, state in zip(scores, path):
        total, before = total + step[before, state] + row[state], state
    return total + step[before, S.OUTSIDE]


@pytest.mark.parametrize("seed", range(20))
def test_viterbi_finds_the_best_path(seed):
    field, rnd = random_field(seed), random.Random(seed)
    tokens = [[rnd.randrange(S.FEATURES) for _ in range(4)] for _ in range(rnd.randint(1, 6))]
    possible = [rnd.random() < 0.6 for _ in tokens]
    found = field.viterbi(tokens, possible)
    best = max(itertools.product(range(3), repeat=len(tokens)), key=lambda p: path_score(field, tokens, possible, p))
    assert path_score(field, tokens, possible, found) == pytest.approx(path_score(field, tokens, possible, best))
    assert all(not (b == S.INSIDE and a == S.OUTSIDE) for a, b in zip([0, *found], found))
    assert all(ok or state != S.BEGIN for ok, state in zip(possible, found))


def test_training_raises_the_likelihood():
    rnd = random.Random(3)
    examples = []
    for _ in range(40):
        good = rnd.random() < 0.5
        tokens = [[1 if good else 2, 5], [3, 6]]
        examples.append((tokens, [True, False], [S.BEGIN, S.INSIDE] if good else [S.OUTSIDE, S.OUTSIDE]))

    def likelihood(field):
        total = 0.0
        for tokens, possible, labels in examples:
            scores = [path_score(field, tokens, possible, p) for p in itertools.product(range(3), repeat=2)]
            total += path_score(field, tokens, possible, labels) - np.logaddexp.reduce(scores)
        return total

    field = S.Field()
    before = likelihood(field)
    field.train(examples, rounds=30)
    assert likelihood(field) > before / 4
    assert [field.viterbi(t, p) for t, p, _ in examples] == [labels for *_, labels in examples]


@pytest.fixture(scope="module")
def secret_texts():
    rnd = random.Random(5)
    words = ["".join(rnd.choices("abcdefghilmnoprstu", k=rnd.randint(2, 9))) for _ in range(500)]
    texts, planted = [], []
    for i in range(160):
        before, after = (" ".join(rnd.choices(words, k=rnd.randint(3, 40))) for _ in "xy")
        value = "".join(rnd.choices("0123456789abcdef", k=40))
        odd = "".join(rnd.choices("ABCDEFGHJKLMabcdefghjkmnpqrs23456789", k=32))
        inner = [f'token = "{value}"', f'key "{odd}"', f"report{rnd.randint(1000, 9999)}final", "10.0.0.1 and +4915123456789"][i % 4]
        texts.append(f"{before} {inner} {after}")
        planted.append((i, odd) if i % 4 == 1 else None)
    return texts, [p for p in planted if p]


def test_field_adds_secrets_and_leaves_clean_texts_alone(docs_of, secret_texts):
    texts, planted = secret_texts
    rows = {r["doc_id"]: r for r in S.secret_spans(docs_of(texts)).collect()}
    for i, text in enumerate(texts):
        assert rows[i]["base"] == S.joined(plain_base(text))
    found = sum(rows[i]["spans"] == f"crf:{texts[i].index(odd)}:{texts[i].index(odd) + 32}" for i, odd in planted)
    assert found >= 0.9 * len(planted)
    clean = [i for i in range(len(texts)) if i % 4 > 1]
    assert sum(rows[i]["spans"] == "" for i in clean) >= 0.95 * len(clean)


def test_tokens_are_taken_whole():
    """However long a token is, and wherever its digits stand."""
    token = "abcDEF" * 20_000 + "1" + "xyz" * 5_000
    assert list(S.chains(f"see {token}, and ab1 or 123456789012345")) == [[(4, 4 + len(token))]]
    joined = "key " + ".".join(["eyJhbGciOiJIUzI1NiJ9", "eyJzdWIiOiIxMjM0", "dozjgNryP4J3"]) + ". End"
    (run,) = S.chains(joined)
    assert [joined[a:b] for a, b in run] == ["eyJhbGciOiJIUzI1NiJ9", ".", "eyJzdWIiOiIxMjM0", ".", "dozjgNryP4J3"]


def test_redaction():
    assert S.redact("ab cd ef", [(0, 2, "hex"), (1, 2, "crf"), (3, 5, "hex")]) == "[SECRET] [SECRET] ef"
    assert S.redact("abcdef", [(0, 4, "assign"), (2, 6, "hex")]) == "[SECRET]"


def test_odd_rows(odd_docs, no_docs):
    texts = {r["doc_id"]: r["text"] or "" for r in odd_docs.select("doc_id", "text").collect()}
    rows = S.secret_spans(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    for row in rows:
        assert row["base"] == S.joined(plain_base(texts[row["doc_id"]]))
    assert {r["n_assign"] for r in rows if r["doc_id"] == 8} == {1}
    masked = S.without_secrets(odd_docs)
    assert masked.columns == odd_docs.columns
    left = {r["doc_id"]: r["text"] for r in masked.collect()}
    assert left[0] is None and left[1] == "" and "abcdef12" not in left[8] and "[SECRET]" in left[8]
    assert S.secret_spans(no_docs).count() == 0 and S.without_secrets(no_docs).count() == 0


@pytest.fixture(scope="module")
def trained():
    """A field trained on planted examples of 150 texts, and 150 texts it has not seen."""
    rnd = random.Random(11)
    words = ["".join(rnd.choices("aeinrstlodhu", k=rnd.randint(2, 9))) for _ in range(800)]
    texts = [" ".join(rnd.choices(words, k=60)) for _ in range(300)]
    examples = []
    for shown, spans in [example for text in texts[:150] for example in S.planted(text)]:
        about = S.text_features(shown)
        for run in S.chains(shown):
            tokens = [S.token_features(shown, a, b, about) for a, b in run]
            examples.append((tokens, [S._is_possible(shown[a:b]) for a, b in run], S._labels(run, spans)))
    field = S.Field()
    field.emit[:, S.OUTSIDE] += 0.05
    field.train(examples)
    return field, texts[150:]


def recall_and_precision(field, texts):
    hits, exact, planted, alarms = 0, 0, 0, 0
    for shown, spans in [example for text in texts for example in S.planted(text)]:
        found = S.all_spans(shown, field)[1]
        if spans:
            (start, end, _), = spans
            planted += 1
            hits += any(a < end and start < b for a, b, _ in found)
            exact += any((a, b) == (start, end) for a, b, _ in found)
        else:
            alarms += bool(found)
    return hits / planted, exact / planted, hits / (hits + alarms)


def test_held_out_secrets_of_many_kinds(trained):
    hits, exact, precision = recall_and_precision(*trained)
    assert hits >= 0.95 and exact >= 0.9 and precision >= 0.97


def test_secrets_in_places_not_trained_on(trained, monkeypatch):
    monkeypatch.setattr(S, "SECRET_PLACES", ("my pass: {v}", "Bearer: {v}", "credentials are {v}", "auth={v}", "api login {v}"))
    hits, _, precision = recall_and_precision(*trained)
    assert hits >= 0.9 and precision >= 0.97


def test_what_is_no_secret_stays(trained):
    field, texts = trained
    for text in texts:
        assert S.all_spans(f"{text} In 2024, 35 of 1200 met at 10:30 on 2024-05-01. Call +49 151 1234567.", field)[1] == []


def test_value_after_a_name_and_marks_within():
    assert [text[a:b] for text in ["set AUTH=hunter22x now"] for ((a, b),) in S.chains(text)] == ["hunter22x"]
    (run,) = S.chains("pwd hunter2!x9, then")
    assert run == [(4, 11), (11, 12), (12, 14)]
    assert list(S.chains("=" * 40 + " " + "-" * 30)) == []


def test_training_on_all_chains_of_a_length_is_training_on_each():
    rnd = random.Random(4)
    examples = [
        ([[rnd.randrange(50) for _ in range(rnd.randint(1, 4))] for _ in range(count)], [True] * count, labels)
        for count in (1, 2, 3) for labels in itertools.product(range(3), repeat=count) for _ in range(3)
        if all(not (b == S.INSIDE and a == S.OUTSIDE) for a, b in zip([0, *labels], labels))
    ]
    field = S.Field()
    field.train(examples, rounds=1)
    # The first step goes by the sign of the gradient of the likelihood of all paths.
    slot = examples[0][0][0][0]
    empty, eps, totals = S.Field(), 1e-4, []
    for shift in (eps, -eps):
        empty.emit[slot, S.BEGIN] = shift
        total = 0.0
        for tokens, possible, labels in examples:
            scores = [path_score(empty, tokens, possible, p) for p in itertools.product(range(3), repeat=len(tokens))]
            total += path_score(empty, tokens, possible, labels) - np.logaddexp.reduce(scores)
        totals.append(total)
    assert np.sign(field.emit[slot, S.BEGIN]) == np.sign(totals[0] - totals[1])


SCORED_PARTS = ["a", "pwd", "key=", "x1", "  ", "\n", " ", " ", "é", ".", "=", "key", "Auth", "w" * 30, "zz" * 60, " " * 90, "-", "😀", "0", "Ab",
                "AB", "ABc", "authX", "deadbeef", "7777", "hello", "Hello", "e" * 15, "1" * 17]


def test_the_field_scores_and_decodes_every_token_of_a_text(monkeypatch):
    """Whatever its make or place: the same path as Viterbi over the features of all tokens, in one batch or in many."""
    rnd, field = random.Random(2), random_field(1)
    texts, wanted = [], []
    for _ in range(150):
        text = "".join(rnd.choices(SCORED_PARTS, k=rnd.randint(0, 60)))
        run = S._all_tokens(text)
        assert "".join(text[a:b] for a, b in run) == "".join(text.split())
        path, about = [], S.text_features(text)
        if run:
            slots = [S.token_features(text, a, b, about) for a, b in run]
            np.testing.assert_allclose(S.Scorer(field).scores([text])[0], field.scores(slots, [True] * len(run)))
            path = field.viterbi(slots, [True] * len(run))
        texts.append(text)
        found = []
        for (start, end), state in zip(run, path):
            if state == S.BEGIN:
                found.append((start, end))
            elif state == S.INSIDE:
                found[-1] = (found[-1][0], end)
        wanted.append(found)
    assert S.Scorer(field).tagged(texts) == wanted and any(len(found) > 1 for found in wanted)
    monkeypatch.setattr(S, "SCORED_PIECES", 7)
    monkeypatch.setattr(S, "KEPT_WORDS", 5)
    assert S.Scorer(field).tagged(texts) == wanted


def test_short_secrets_and_words_are_found_where_they_stand_as_secrets(docs_of):
    rnd = random.Random(12)
    words = ["".join(rnd.choices("aeinrstlodhu", k=rnd.randint(2, 9))) for _ in range(800)]
    texts = [" ".join(rnd.choices(words, k=60)) for _ in range(300)]
    field = S.trained_field(docs_of([f"{text} report7final" for text in texts[:150]]))
    hits, kinds, alarms = [], set(), 0
    for shown, spans in [example for text in texts[150:] for example in S.planted_plain(text)]:
        found = S.all_spans(shown, field)[1]
        if spans:
            hits.append(spans == found)
            value = shown[spans[0][0] : spans[0][1]]
            if hits[-1]:
                kinds |= {("short", len(value) < 6), ("digits", value.isdigit()), ("word", value.isalpha())}
        else:
            alarms += bool(found)
    assert sum(hits) >= 0.6 * len(hits) and alarms <= 0.03 * len(hits)
    assert kinds >= {("short", True), ("digits", True), ("word", True)}
    assert all(S.all_spans(text, field)[1] == [] for text in texts[150:])


def test_the_scan_travels_without_the_package(tmp_path):
    """Executors need not have the package: nothing that a task runs is pickled as a name to import."""
    (tmp_path / "scan").write_bytes(cloudpickle.dumps((S.all_spans, S.Field)))
    code = "import pickle; spans, field = pickle.load(open('scan', 'rb')); print(spans('token = abcdef12 é', field()))"
    environment = {name: value for name, value in os.environ.items() if name != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=environment, capture_output=True, text=True, timeout=60)
    assert done.stdout.strip() == "([(0, 16, 'assign')], [(0, 16, 'assign')])", done.stderr
