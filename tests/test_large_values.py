"""Values up to and beyond what a VARIANT holds: the same items, issues and texts as of small ones."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from marklens import audit_pages, issues_table, items_table, page_json
from marklens.functions.overflow import text_of
from marklens.operators import elements, extract
from marklens.plans import audit

MB = 1 << 20
ORG = "https://schema.org/"


@pytest.fixture
def pages_of(pages_of):
    """One page after the other: eight of this size at a time do not fit the tests' heap."""
    return lambda html_by_name: pages_of(html_by_name).coalesce(1)


# What a MiB is to the tests that use smaller limits.
UNIT = MB // 64


@pytest.fixture
def small_limits(monkeypatch):
    """All limits at a 64th, so that tests of what lies beyond them need little memory."""
    monkeypatch.setattr(extract, "MOST_BYTES", extract.MOST_BYTES // 64)
    monkeypatch.setattr(elements, "MOST_BYTES", elements.MOST_BYTES // 64)
    monkeypatch.setattr(audit, "_items", audit._items.__wrapped__)  # expressions that hold the limits are built anew
    elements._reader.cache_clear()
    yield
    elements._reader.cache_clear()


def ld(value):
    return f'<script type="application/ld+json">{value if isinstance(value, str) else json.dumps(value)}</script>'


def texts_of(results, name):
    """Per page, the digest and length of a property's whole text."""
    items = items_table(results)
    text = text_of(F.lit(name), F.col("properties")[name], F.col("overflow"))
    rows = items.filter(text.isNotNull()).select("page_id", F.md5(text).alias("md5"), F.char_length(text).alias("n")).collect()
    return {r["page_id"]: (r["md5"], r["n"]) for r in rows}


def digest(text):
    return hashlib.md5(text.encode()).hexdigest(), len(text)


def issues_of(results):
    return sorted((r["page_id"], r["item_ord"], r["issue_type"], r["path"]) for r in issues_table(results).collect())


def product(description, **more):
    return {"@type": "Product", "name": "n", "description": description, "url": "nope", **more}


def microdata(text):
    return f'<div itemscope itemtype="{ORG}Product"><p itemprop="name">n</p><p itemprop="description">{text}</p><i itemprop="url">nope</i></div>'


def rdfa(text):
    return f'<div typeof="Product"><p property="name">n</p><p property="description">{text}</p><i property="url">nope</i></div>'


def blocks(text):
    return ld({"@graph": [product(text), {"@type": "Person"}]})


def check_large_text(pages_of, size, forms):
    large, small = "große Zahl " * (size // 11) + "end", "large"
    found = audit_pages(pages_of({f"p{i}": form(large) for i, form in enumerate(forms)}))
    wanted = audit_pages(pages_of({f"p{i}": form(small) for i, form in enumerate(forms)}))
    assert [r["fetch_error"] for r in found.select("fetch_error").collect()] == [None] * len(forms)
    assert texts_of(found, "description") == dict.fromkeys(range(len(forms)), digest(large))
    assert issues_of(found) == issues_of(wanted)
    assert any(kind == "invalid_url" for _, _, kind, _ in issues_of(found))


def test_a_large_text_is_whole_and_has_the_issues_of_a_small_one(pages_of):
    check_large_text(pages_of, 20 * MB, [blocks, microdata])


@pytest.mark.parametrize("size", [9, 20, 70])
def test_texts_below_and_beyond_the_limits(pages_of, small_limits, size):
    check_large_text(pages_of, size * UNIT, [lambda text: ld(product(text)), blocks, microdata, rdfa])


def test_values_beyond_a_variant(pages_of, small_limits):
    """Lists, objects and watched texts beyond the limits: their rules see what small ones show."""
    wide = [{"@type": "Question" if i % 2 else "Answer", "text": "x" * 30 * UNIT} for i in range(5)]
    address = "https://example.com/" + "a" * (17 * UNIT)
    pages = {
        "faq": ld({"@type": "FAQPage", "name": "n", "mainEntity": wide}),
        "crumbs": ld({"@type": "BreadcrumbList", "name": "n", "itemListElement": {"a": "x" * 17 * UNIT}}),
        "good_url": ld({"@type": "Product", "name": "n", "image": "https://e.com/i", "offers": {}, "url": address}),
        "bad_url": ld({"@type": "Product", "name": "n", "image": "https://e.com/i", "offers": {}, "url": "no " + address}),
        "broken": ld("{" + "x" * (66 * UNIT)),
    }
    results = audit_pages(pages_of(pages), with_raw=True)
    assert issues_of(results) == [
        (0, 0, "invalid_property_type", "FAQPage.mainEntity[0]"),
        (0, 0, "invalid_property_type", "FAQPage.mainEntity[2]"),
        (0, 0, "invalid_property_type", "FAQPage.mainEntity[4]"),
        (3, 0, "invalid_url", "Product.url"),
        (4, 0, "malformed_json_ld", None),
    ]
    message = issues_table(results).filter("page_id = 3").select(F.length("message").alias("n")).first()
    assert message["n"] > 17 * UNIT


def test_a_property_repeated_beyond_a_variant(pages_of, small_limits):
    part = "y" * (17 * UNIT)
    html = f'<div itemscope itemtype="{ORG}Thing"><p itemprop="name">n</p>' + f'<p itemprop="part">{part}</p>' * 4
    items = items_table(audit_pages(pages_of({"p": html}), with_raw=True))
    large = F.col("overflow")["part"]
    row = items.select(
        F.map_keys("properties").alias("names"), large["json"].alias("json"),
        F.aggregate(large["segments"], F.lit(0), lambda n, s: n + F.length(s)).alias("n"),
    ).first()
    assert row["names"] == ["name", "part"] and row["json"] and row["n"] == 4 * len(part) + 4 * 2 + 3 + 2


def test_the_json_report_holds_whole_values(pages_of, small_limits):
    text = 'q" \\ é' * (UNIT)
    most = 65 * UNIT
    value = {"@context": "c", "@type": "Product", "name": "n", "description": text, "offers": {"price": 1, "note": text}}
    html = ld(value) + microdata("z" * most)
    row = page_json(audit_pages(pages_of({"p": html}), with_raw=True)).first()
    report = json.loads(row["json"])
    plain, scoped = report["structured_data"]
    assert plain["raw"] == value
    assert plain["properties"] == {k: v for k, v in value.items() if k in ("name", "description", "offers")}
    assert plain["context"] == "c" and plain["source_url"] == row["url"] and plain["is_graph_item"] is False
    wanted = {"name": "n", "description": "z" * most, "url": "nope"}
    assert scoped["properties"] == wanted and scoped["raw"] == {"itemtype": ORG + "Product", "properties": wanted}
    assert set(report) == {"url", "structured_data", "errors", "warnings", "info", "fetch_error"}


def test_items_of_a_large_block_stay_apart():
    """What stands for a large member is of its kind; small members and other items are left as they are."""
    most = elements.MOST_BYTES
    entries = [{"@type": "A", "big": "x" * most, "few": [1], "list": [{"@type": "B", "t": "y" * 2_000}, "s", 5, None, {}]}, 7, {"@type": "C"}]
    parts = elements._parts([{"@context": "c", "@graph": entries}, {"@type": "D"}, "text"])
    blocks = [json.loads(block) for block, _ in parts]
    assert [b.get("@graph", [b])[0]["@type"] for b in blocks] == ["A", "C", "D"]
    first, overflow = blocks[0]["@graph"][0], parts[0][1]
    assert first["few"] == [1] and first["big"] == "x" * 64 and first["list"] == [{"@type": "B"}, "s", 5, None, {}]
    assert "".join(overflow["big"]["segments"]) == "x" * most and not overflow["big"]["json"]
    assert json.loads("".join(overflow["list"]["segments"])) == json.loads(json.dumps([{"@type": "B", "t": "y" * 2_000}, "s", 5, None, {}]))
    assert parts[1][1] is None and blocks[1]["@context"] == "c"
