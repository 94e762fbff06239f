import random

import pytest
import xxhash

from marklens.llm import simhash as S


def plain_fingerprint(text, shingle=4):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in folded + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def components(ids, fingerprints, radius):
    root = {i: i for i in range(len(ids))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fingerprints[i] ^ fingerprints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, name in enumerate(ids):
        if name is not None:
            least[find(i)] = min(name, least.get(find(i), name))
    return [least.get(find(i)) for i in range(len(ids))]


def near_copies(seed=3, groups=25, size=6):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(groups):
        text = [rnd.choice(words) for _ in range(rnd.randint(3, 160))]
        for _ in range(size):
            texts.append(" ".join(text))
            text = [*text]
            text[rnd.randrange(len(text))] = rnd.choice(words)
    return texts


@pytest.mark.parametrize("text", ["", " ", "one", "One two  three", "A b\tC d e f É é", "x " * 5_000, "Ⅷ Ａ"])
def test_fingerprint(text):
    assert int.from_bytes(S.fingerprint(text.encode()), "big") == plain_fingerprint(text)


def test_fingerprint_is_counted_in_parts(monkeypatch):
    text = " ".join(map(str, range(500))).encode()
    whole = S.fingerprint(text)
    monkeypatch.setattr(S, "COUNTED_AT_ONCE", 7)
    assert S.fingerprint(text) == whole


def test_tree_finds_what_a_scan_finds():
    rnd = random.Random(1)
    values = list({rnd.getrandbits(12) for _ in range(300)})
    tree = S.BkTree()
    for value in values:
        tree.add(value)
    for value in range(0, 4096, 41):
        found = sorted(tree.values[i] for i in tree.within(value, 3))
        assert found == sorted(v for v in values if (v ^ value).bit_count() <= 3)


@pytest.mark.parametrize("spare", [1, 2, 3])
def test_close_fingerprints_share_a_shard(spare):
    rnd = random.Random(2)
    masks = S.block_masks(4, spare)
    for _ in range(300):
        a = rnd.getrandbits(64)
        b = a
        for bit in rnd.sample(range(64), 4):
            b ^= 1 << bit
        assert any((a ^ b) & mask & (1 << 64) - 1 == 0 for mask in masks)


@pytest.mark.parametrize(("limit", "spare"), [(4_096, None), (2, 1), (3, 2)])
def test_components_match_brute_force(docs_of, limit, spare):
    """Also where shards are far larger than a unit of work may be."""
    texts = near_copies()
    got = {r["doc_id"]: r for r in S.near_duplicates(docs_of(texts), shard_limit=limit, spare=spare).collect()}
    prints = [plain_fingerprint(t) for t in texts]
    assert [int.from_bytes(got[i]["fp"], "big") for i in range(len(texts))] == prints
    assert [got[i]["component_id"] for i in range(len(texts))] == components(range(len(texts)), prints, 4)


def test_odd_rows(odd_docs, no_docs):
    rows = odd_docs.select("doc_id", "text").collect()
    got = sorted((r["doc_id"] is None, r["doc_id"], int.from_bytes(r["fp"], "big"), r["component_id"]) for r in S.near_duplicates(odd_docs).collect())
    prints = [plain_fingerprint(r["text"]) for r in rows]
    want = components([r["doc_id"] for r in rows], prints, 4)
    assert got == sorted((r["doc_id"] is None, r["doc_id"], p, c) for r, p, c in zip(rows, prints, want))
    assert S.near_duplicates(no_docs).count() == 0
    assert S.without_near_duplicates(no_docs).count() == 0


def test_columns_of_any_name(docs_of):
    """Other columns come back as they were, whatever the operator calls its own."""
    names = ["row", "id", "key", "k1", "k2", "_deal", "lead", "root", "least"]
    docs = docs_of(["a b c d e", "a b c d e", "other words are here"])
    for at, name in enumerate(names):
        docs = docs.withColumn(name, docs["doc_id"] * 100 + at)
    kept = S.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], *(r[n] for n in names)) for r in kept.collect()) == [(i, *(i * 100 + k for k in range(9))) for i in (0, 2)]
    assert len(S.near_duplicates(docs).collect()) == 3


def test_one_of_each_group_stays(docs_of, odd_docs):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(2_000)]
    clean = [" ".join(rnd.choices(words, k=rnd.randint(12, 300))) for _ in range(60)]
    copies = []
    for text in clean[:20]:
        parts = text.split() + rnd.choices(words, k=300)
        copies.append(" ".join(parts))
        copies.append("  ".join(parts))
    docs = docs_of(clean + copies + clean[:5])
    left = S.without_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect()) == [*range(60), *range(60, 100, 2)]
    kept = S.without_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    # Texts without words are one group; "a" twice; the long text; "b c d" of the row with an id; the last one.
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [0, 3, 5, 6, 8]
