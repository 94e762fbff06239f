import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from marklens.llm import prefix_trie as T

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth int, key string"


def expected(rows, family=20, heads=4):
    """Nodes of (conv_id, turn, role, text) rows without ties, by plain dictionaries of prefixes."""
    own = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            own[conv_id].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [turn[2:] for turn in sorted(turns)] for c, turns in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        whole[c] = tuple(own.get(c - (abs(c) % family) * (1 if c >= 0 else -1), [])[:h] + turns[h:])
    nodes = defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            nodes[whole[c][:d]].append(c)
    found = {}
    for prefix, members in nodes.items():
        ends = ",".join(str(c) for c in members if whole[c] == prefix)
        children = sum(1 for p in nodes if len(p) == len(prefix) + 1 and p[:-1] == prefix)
        found[prefix] = [members[0], len(prefix), nodes[prefix[:-1]][0] if prefix else None, len(members), children, 0, 0,
                         hashlib.sha256(ends.encode()).hexdigest()]
    for prefix, members in nodes.items():
        for d in range(len(prefix) + 1):
            found[prefix[:d]][5] += found[prefix][4] == 0
            found[prefix[:d]][6] += (len(members) - 1) * (len(prefix[-1][1].encode().split()) if prefix else 0)
    return sorted(map(tuple, found.values()), key=str)


def results(frame, **options):
    return sorted((tuple(r[c] for c in T.RESULT) for r in T.conversation_trie(frame, **options).collect()), key=str)


def table(spark, rows, partitions=3):
    return spark.createDataFrame([(*row, 7, "k") for row in rows], SCHEMA).repartition(partitions)


@pytest.mark.parametrize("block_turns", [1, 5, 40, 200_000])
def test_nodes_match_brute_force(spark, block_turns):
    """Few different turns, so beginnings are shared at every depth, by copies too, and blocks end anywhere in them."""
    rnd = random.Random(block_turns)
    rows = []
    for c in rnd.sample(range(-30, 200), 120):
        for turn in range(rnd.randint(1, 6)):
            rows.append((c, turn, rnd.choice(["user", "assistant"]), rnd.choice(["a", "b  c", "", None])))
    assert results(table(spark, rows), block_turns=block_turns) == expected(rows)


def test_a_common_beginning_and_a_common_conversation(spark):
    rows = [(c, t, "user", "hello there" if t == 0 else f"{c % 50} {t}") for c in range(300) for t in range(3)]
    rows += [(c, t, "user", f"the same {t}") for c in range(1_000, 1_150) for t in range(5)]
    assert results(table(spark, rows), block_turns=64) == expected(rows)


def test_deep_conversations(spark):
    """Each a turn longer than the last: one more joins at every depth."""
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 60) for t in range(4 * c + 4)]
    assert results(table(spark, rows), block_turns=300) == expected(rows)


def test_odd_rows(spark):
    big = "word " * 50_000
    rows = [(1, None, None, None), (1, 0, "user", big), (2, 5, None, "x"), (3, 1, "user", ""), (20, 0, "", None),
            (21, 0, "user", big), (None, 0, "user", "nobody's"), (40, 3, "a", "b:c"), (41, 3, "a:b", "c"), (-7, 0, "user", "x")]
    assert results(table(spark, rows)) == expected(rows)
    assert results(table(spark, rows).limit(0)) == []
    assert results(table(spark, [(None, 0, "user", "x")])) == []


def test_repeated_rows_are_repeated_turns(spark):
    rows = [(4, 0, "user", "a")] * 3 + [(5, 0, "user", "a")]
    assert results(table(spark, rows), heads=1) == expected([(4, 0, "user", "a"), (4, 1, "user", "a"), (4, 2, "user", "a"), (5, 0, "user", "a")], heads=1)


def test_turns_that_differ_in_where_the_role_ends(spark):
    rows = [(20, 0, "a", "b"), (40, 0, "ab", ""), (60, 0, "", "ab")]
    assert sum(1 for r in results(table(spark, rows), heads=1) if r[1] == 1) == 3
