import random
import re

import pytest
from pyspark.sql import functions as F

from marklens.llm import quality_cascade as Q


def measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    repeated = set()
    for i, window in enumerate(windows):
        if windows.count(window) > 1:
            repeated.update(range(i, i + 5))
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(repeated), "n_lines": len(lines),
        "n_upper": len(re.findall("[A-Z]", text)), "n_letters": len(re.findall("[A-Za-z]", text)),
    }


def random_texts(seed=1, count=150):
    rnd = random.Random(seed)
    alphabets = ["ab", "abcdefgh", "ABCD# ", "éü一😀x", "a|b*&<>$%#"]
    texts = []
    for _ in range(count):
        alphabet = rnd.choice(alphabets)
        words = ["".join(rnd.choices(alphabet, k=rnd.randint(1, 4))) for _ in range(rnd.choice([0, 3, 9, 10, 40, 90]))]
        texts.append("".join(w + rnd.choice([" ", " ", " ", "\n", "\t", " ", "\x0b"]) for w in words))
    return texts


def test_measures_match_brute_force():
    for text in random_texts():
        held = Q.Text(text.encode())
        assert {name: held[name] for name in Q.MEASURES} == measures(text)


def test_windows_stay_exact_where_codes_must_be_renumbered(monkeypatch):
    """Very many different words: five of them do not fit one number."""
    rnd = random.Random(2)
    words = [str(i) for i in range(9_000)]
    rnd.shuffle(words)
    text = " ".join([*words, *words[100:140], *words[7_000:7_004]])
    assert Q.Text(text.encode())["n_repeat_words"] == 80


def test_order_changes_no_verdict(docs_of):
    texts = random_texts(3)
    docs = docs_of(texts)
    want = {r["doc_id"] for r in Q.kept_documents(docs).collect()}
    for rules in (Q.RULES, Q.RULES[::-1]):
        rule = Q.first_rejection(Q.as_bytes("text"), rules)
        assert {r["doc_id"] for r in docs.filter(rule.isNull()).collect()} == want
    assert want == {i for i, t in enumerate(texts) if not any(rule.rejects(Q.Text(t.encode())) for rule in Q.RULES)}


def test_rules_are_ordered_by_rejections_per_cost(docs_of, monkeypatch):
    clock = iter(range(10_000))
    monkeypatch.setattr(Q.time, "perf_counter", lambda: float(next(clock)))
    docs = docs_of(["short", "a|b " * 30, "a|c " * 30, "good words " * 3])
    names = [rule.name for rule in Q.ordered_rules(docs, "text", (Q.too_short(), Q.odd_words(), Q.symbol_heavy()))]
    assert names == ["too_short", "symbol_heavy", "odd_words"]  # 2 and 2 rejections, then none


def test_odd_rows(odd_docs, no_docs):
    rows = {r["doc_id"]: r["text"] for r in odd_docs.select("doc_id", "text").collect()}
    judged = Q.judged_documents(odd_docs).collect()
    assert len(judged) == odd_docs.count()
    for row in judged:
        want = measures(rows[row["doc_id"]]) if row["doc_id"] not in (6, 7) else None
        if want:
            assert [row[n] for n in Q.REPORTED] == [want[n] for n in Q.REPORTED]
            assert row["base_failed"] == (want["n_words"] < 10 or 100 * want["n_repeat_words"] > 20 * want["n_words"])
        else:
            assert (row["n_words"], row["n_repeat_words"], row["base_failed"]) == (60_001, 60_000, True)
        assert not (row["kept"] and row["base_failed"]) and row["kept"] == (row["rejected_by"] is None)
    kept = Q.kept_documents(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == sum(r["kept"] for r in judged)
    assert Q.judged_documents(no_docs).count() == 0 and Q.kept_documents(no_docs).count() == 0
