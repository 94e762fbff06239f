"""Rules on items given directly, one case per row."""

import json
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marklens import issues_table, rules, schemas
from marklens.functions.overflow import no_overflow
from marklens.functions.urls import is_http_url, is_iso_date
from marklens.plans.audit import validate_items

ARTICLE = {"headline": "h", "author": "a", "datePublished": "2026-01-01", "image": "https://e.com/i.jpg"}

# Name -> (items as (type, properties), guidelines on).
CASES = {
    "valid_product": ([("Product", {"name": "W", "image": "https://e.com/i.jpg", "offers": {}})], True),
    "product_no_name": ([("Product", {"price": "9.99"})], True),
    "product_no_image": ([("Product", {"name": "W"})], True),
    "product_no_offer": ([("Product", {"name": "W", "image": "https://e.com/i.jpg"})], True),
    "product_null_name": ([("Product", {"name": None, "image": None, "price": None})], True),
    "malformed": ([("MalformedJSON-LD", {})], True),
    "untyped": ([("Unknown", {})], True),
    "empty_type": ([("", {"a": 1})], True),
    "empty": ([("Product", {})], True),
    "deprecated": ([("EntryRating", {"a": 1}), ("EntryRating, Thing", {"a": 1})], True),
    "article_bare": ([("Article", {"name": "n"})], True),
    "article_no_image": ([("Article", {k: v for k, v in ARTICLE.items() if k != "image"})], True),
    "blog_multi_type": ([("BlogPosting, Thing", {**ARTICLE, "image": "https://e.com/i"}), ("BlogPosting,Thing", {"name": 1})], True),
    "offer_bare": ([("Offer", {})], True),
    "faq_bare": ([("FAQPage", {})], True),
    "faq_entries": (
        [("FAQPage", {"name": "n", "mainEntity": [
            {"@type": "Question"}, {"@type": "Answer"}, "x", {}, {"@type": None}, {"@type": ["Question"]}, 5, {"@type": 1},
        ]})],
        True,
    ),
    "faq_object": ([("FAQPage", {"name": "n", "mainEntity": {"@type": "Answer"}})], True),
    "faq_falsy": ([("FAQPage", {"name": "n", "mainEntity": v}) for v in (None, "", 0, 0.0, False, [], {})], True),
    "faq_truthy": ([("FAQPage", {"name": "n", "mainEntity": v}) for v in ("x", 1, -0.5, True, [0], {"a": None})], True),
    "breadcrumb_bare": ([("BreadcrumbList", {})], True),
    "breadcrumb_list": ([("BreadcrumbList", {"name": "n", "itemListElement": [1]})], True),
    "bad_url": ([("Product", {"name": "W", "image": "https://e.com/i", "price": 1, "url": "no address"})], True),
    "good_url": ([("Product", {"name": "W", "image": "https://e.com/i", "price": 1, "url": "https://example.com/widget"})], True),
    "url_names": (
        [("Person", {"name": "n", "URL": "x", "Logo": "y", "sameAs": "z", "thumbnailUrl": "z", "href": " ", "link": 5, "target": ["x"], "image": {"url": "x"}})],
        True,
    ),
    "bad_date": ([("Article", {**ARTICLE, "name": "n", "datePublished": "3rd of May"})], True),
    "good_date": ([("Article", {**ARTICLE, "name": "n"})], True),
    "date_names": ([("Person", {"name": "n", "datepublished": "x", "expires": " ", "endDate": 2020, "startDate": "2026"})], True),
    "odd_type": ([("RandomCustomType", {"name": "n"})], True),
    "odd_first": ([("Thing, Product", {"url": "x"})], True),
    "odd_spaces": ([(" Product ,Thing", {"image": "https://e.com/i", "price": 1})], True),
    "no_guidelines": ([("Product", {}), ("RandomCustomType", {"url": "x"})], False),
    "event_bare": ([("Event", {})], True),
    "job_bare": ([("JobPosting", {})], True),
    "org_ok": ([("Organization", {"name": "n"})], True),
    "recipe_no_name": ([("Recipe", {"image": "https://e.com/i"})], True),
    "name_exempt": ([(t, {"a": 1}) for t in ("ListItem", "SiteNavigationElement", "ImageObject", "Person")], True),
    "empty_page": ([], True),
    "conflict": ([("Product, Thing", {"name": 1}), ("WebSite", {"name": 1}), ("Product", {"name": 2}), ("WebSite", {"name": 1}), ("WebSite", {"name": 1})], True),
    "conflict_without_guidelines": ([("LocalBusiness", {"name": 1}), ("LocalBusiness", {"name": 1})], False),
    "no_conflict": ([("Product", {"name": 1}), ("Organization", {"name": 1}), ("Person", {"name": 1}), ("Person", {"name": 1})], True),
    "by_severity": ([("MalformedJSON-LD", {}), ("RandomType", {"name": "n"})], True),
}


def case_items(spark, guidelines):
    rows = [
        (number, name, [(kind, json.dumps(properties)) for kind, properties in items])
        for number, (name, (items, flag)) in enumerate(CASES.items())
        if flag is guidelines
    ]
    source = spark.createDataFrame(rows, "page_id bigint, url string, source array<struct<t:string,p:string>>")
    items = F.transform(
        "source",
        lambda entry: F.struct(
            F.lit("json-ld").alias("schema_format"),
            entry["t"].alias("schema_type"),
            F.try_variant_get(F.parse_json(entry["p"]), "$", "map<string,variant>").alias("properties"),
            F.lit(None).cast("variant").alias("raw"),
            F.lit(None).cast("string").alias("context"),
            F.lit(False).alias("is_graph_item"),
            no_overflow().alias("overflow"),
        ),
    ).cast(schemas.ITEMS)
    return source.withColumn("items", items)


@pytest.fixture(scope="module")
def issues(spark):
    found = {name: [] for name in CASES}
    for guidelines in (True, False):
        for row in issues_table(validate_items(case_items(spark, guidelines), guidelines)).collect():
            found[row["url"]].append(row)
    return found


@pytest.mark.parametrize("guidelines", [True, False])
def test_codes_stand_for_the_same_issues(spark, guidelines):
    items = case_items(spark, guidelines)
    lists = ["errors", "warnings", "info"]
    codes = {row["url"]: [row[name] for name in lists] for row in validate_items(items, guidelines, messages=False).collect()}
    for row in validate_items(items, guidelines).collect():
        ranked = [[i["check_ord"] * 10 + rules.SEVERITY_RANK[i["severity"]] for i in row[name]] for name in lists]
        assert codes.pop(row["url"]) == ranked
    assert not codes


def kinds(rows):
    return [(row["issue_type"], row["severity"], row["path"]) for row in rows]


REQUIRED = "missing_required_property"


@pytest.mark.parametrize(
    ("case", "expected"),
    [
        ("valid_product", []),
        ("product_no_image", [("missing_image", "warning", "Product.image"), (REQUIRED, "warning", "Product.offers")]),
        ("product_no_offer", [(REQUIRED, "warning", "Product.offers")]),
        ("product_null_name", []),
        ("malformed", [("malformed_json_ld", "error", None)]),
        ("untyped", [("missing_schema_type", "warning", None)]),
        ("empty_type", [("missing_schema_type", "warning", None)]),
        ("faq_bare", [
            (REQUIRED, "error", "FAQPage.mainEntity"), ("empty_schema", "warning", None), ("missing_name", "warning", "FAQPage.name"),
        ]),
        ("faq_entries", [("invalid_property_type", "warning", f"FAQPage.mainEntity[{i}]") for i in (1, 5, 7)]),
        ("faq_object", []),
        ("faq_falsy", [(REQUIRED, "error", "FAQPage.mainEntity")] * 7),
        ("faq_truthy", []),
        ("breadcrumb_bare", [
            (REQUIRED, "error", "BreadcrumbList.itemListElement"), ("empty_schema", "warning", None),
            ("missing_name", "warning", "BreadcrumbList.name"),
        ]),
        ("breadcrumb_list", []),
        ("bad_url", [("invalid_url", "warning", "Product.url")]),
        ("good_url", []),
        ("bad_date", [("invalid_property_type", "warning", "Article.datePublished")]),
        ("good_date", []),
        ("date_names", [("invalid_property_type", "warning", "Person.startDate")]),
        ("odd_type", [("unsupported_type", "info", None)]),
        ("odd_first", [("invalid_url", "warning", "Thing, Product.url")]),
        ("odd_spaces", [(REQUIRED, "error", "Product.name"), ("missing_name", "warning", "Product.name")]),
        ("no_guidelines", [("empty_schema", "warning", None), ("invalid_url", "warning", "RandomCustomType.url")]),
        ("org_ok", []),
        ("name_exempt", [(REQUIRED, "error", "ImageObject.contentUrl"), ("missing_name", "warning", "Person.name")]),
        ("empty_page", []),
        ("conflict_without_guidelines", [("conflicting_schema", "warning", None)]),
    ],
)
def test_issues(issues, case, expected):
    assert kinds(issues[case]) == expected


@pytest.mark.parametrize(
    ("case", "path"),
    [
        ("product_no_name", "Product.name"),
        ("article_bare", "Article.headline"),
        ("offer_bare", "Offer.price"),
        ("offer_bare", "Offer.priceCurrency"),
        ("event_bare", "Event.location"),
        ("job_bare", "JobPosting.title"),
        ("recipe_no_name", "Recipe.name"),
    ],
)
def test_required(issues, case, path):
    assert (REQUIRED, "error", path) in kinds(issues[case])


def test_messages(issues):
    def messages(case):
        return [row["message"] for row in issues[case]]

    assert messages("bad_url") == ["Property 'url' has invalid URL: 'no address'"]
    assert messages("bad_date") == ["Property 'datePublished' value '3rd of May' is not ISO 8601 format"]
    assert "Google rich results require 'headline' for Article" in messages("article_bare")
    assert messages("odd_type") == ["Schema type 'RandomCustomType' is not a recognized Google rich result type"]
    assert "Schema 'Product' has no properties" in messages("empty")
    assert messages("deprecated")[0] == "Schema type 'EntryRating' is deprecated"


def test_deprecated_needs_the_whole_type(issues):
    assert [row["item_ord"] for row in issues["deprecated"] if row["issue_type"] == "deprecated_type"] == [0]


def test_article_without_image_has_error_and_warning(issues):
    found = kinds(issues["article_no_image"])
    assert (REQUIRED, "error", "Article.image") in found and ("missing_image", "warning", "Article.image") in found


def test_url_names_are_lower_cased_before_lookup(issues):
    assert {row["path"] for row in issues["url_names"]} == {"Person.URL", "Person.Logo"}


def test_full_and_base_type_in_paths(issues):
    rows = [r for r in issues["blog_multi_type"] if r["item_ord"] == 1]
    assert ("missing_image", "warning", "BlogPosting,Thing.image") in kinds(rows)
    assert (REQUIRED, "error", "BlogPosting.headline") in kinds(rows)


def test_conflicts_count_by_first_type_in_first_seen_order(issues):
    rows = [r for r in issues["conflict"] if r["issue_type"] == "conflicting_schema"]
    assert [(r["schema_ref"], r["item_ord"], r["path"]) for r in rows] == [("Product", None, None), ("WebSite", None, None)]
    assert rows[1]["message"] == "Multiple 'WebSite' schemas found (3 instances) — may cause confusion"
    assert not [r for r in issues["no_conflict"] if r["issue_type"] == "conflicting_schema"]


def test_severity_lists(issues):
    assert [row["severity"] for row in issues["by_severity"]] == ["error", "info"]


def test_every_issue_type_is_known(issues):
    assert {row["issue_type"] for rows in issues.values() for row in rows} <= set(rules.ISSUE_TYPES)


# Shapes, against one plain pattern each.
URL_SHAPE = re.compile(
    r"^https?://(?:(?:[A-Z0-9](?:[A-Z0-9-]{0,61}[A-Z0-9])?\.)+[A-Z]{2,6}\.?|localhost|\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})"
    r"(?::\d+)?(?:/?|[/?]\S+)$",
    re.IGNORECASE,
)
DATE_SHAPE = re.compile(r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}(:\d{2})?([+-]\d{2}:?\d{2}|Z)?)?$")
URLS = [
    "http://a.b", "http://a.bc", "HTTPS://A.BC.", "http://a.bc..", "http://.a.bc", "http://a..bc", "http://-a.bc",
    "http://a-.bc", "http://a-b.bc", "http://a.photography", "http://localhost", "http://LOCALHOST:80/x", "http://localhost.",
    "http://1.2.3.4", "http://999.999.999.999:1?x", "http://1.2.3", "http://1.2.3.4.5", "http://a.bc:", "http://a.bc:x",
    "http://a.bc:80", "http://a.bc#x", "http://a.bc/#x", "http://a.bc/ x", "http://a.bc?x y", "http://a.bc?", "http://a.bc/",
    "http://a.bc/\n", "http://a.bc\n", "http://a.bc\r\n", " http://a.bc", "ftp://a.bc", "http://u@a.bc", "http://[::1]/", "http://a_b.cd",
    "http://" + "a" * 63 + ".bc", "http://" + "a" * 64 + ".bc", "http://a.b1", "http://é.com", "http://a.com/é", "//a.bc", "",
    "http://" + "a." * 20_000 + "bc", "http://" + "a." * 20_000 + "!", "http://a.bc/" + "x" * 100_000, "http://ſa.bc", "http://a.abcdefg",
]
DATES = [
    "2026-01-01", "2026-1-1", "2026-99-99", "2026", "2026-01-01T", "2026-01-01T10:00", "2026-01-01T10:00:00", "2026-01-01\n",
    "2026-01-01\r\n", "2026-01-01T10:00:00Z", "2026-01-01T10:00+01:00", "2026-01-01T10:00+0100", "2026-01-01T10:00:00.5Z",
    "2026-01-01 10:00", "2026-01-01Z", "2026-01-01T10:00z", "٢٠٢٦-01-01", "",
]


def matches(spark, values, expression):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string").select("i", expression(F.col("v")).alias("m"))
    return [row["m"] for row in rows.orderBy("i").collect()]


def test_url_shape(spark):
    assert matches(spark, URLS, is_http_url) == [URL_SHAPE.match(u) is not None for u in URLS]


def test_date_shape(spark):
    assert matches(spark, DATES, is_iso_date) == [DATE_SHAPE.match(d) is not None for d in DATES]


def test_url_shape_on_generated_urls(spark):
    label = st.text("aZ09-_", max_size=4)
    host = st.lists(label, min_size=1, max_size=4).map(".".join)
    tail = st.sampled_from(["", "/", "?", ":8", ":", "/x", "?q", "#f", ":8/x y", ".", "\n"])
    values = []

    @settings(max_examples=400, deadline=None, database=None)
    @given(st.sampled_from(["http://", "https://", "HTTP://", "http:/"]), host, tail)
    def collect(scheme, name, rest):
        values.append(scheme + name + rest)

    collect()
    assert matches(spark, values, is_http_url) == [URL_SHAPE.match(u) is not None for u in values]


def test_plain_urls_need_no_second_look(spark, monkeypatch):
    """What the one pattern for plain URLs accepts is what the look part by part accepts."""
    from itertools import product

    from marklens.functions import urls

    hosts = [
        "example.com", "EXAMPLE.com", "a.b.c.d.e.f.g.h.i.j.com", "x" * 63 + ".com", "x" * 64 + ".com", "localhost", "1.2.3.4", "a-b.com",
        "-a.com", "a..com", "a.c", "a.photography", "a.com.", "ä.com", "example.com:80", "", "exa mple.com", "a.KK",
    ]
    tails = ["", "/", "?q=1", "#x", "/x", "/x y", "/ä", "/x\n", "\n", "/ ", "/a/b?c=d#e", "//"]
    values = [f"{scheme}{host}{tail}" for scheme, host, tail in product(["http://", "https://", "HTTP://", "ftp://", ""], hosts, tails)]
    rows = spark.createDataFrame([(v,) for v in values], "value string")
    got = rows.select("value", urls.is_http_url(F.col("value")).alias("v"))
    assert got.filter("v").count() > 100
    plain = rows.filter(F.col("value").rlike(urls.PLAIN_URL_SHAPE)).count()
    monkeypatch.setattr(urls, "PLAIN_URL_SHAPE", "(?!)")
    want = rows.select("value", urls.is_http_url(F.col("value")).alias("v"))
    assert plain >= 30 and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_names_of_url_properties_in_any_case(spark):
    from marklens import rules
    from marklens.operators.validate import _is_url_property

    names = [
        *rules.URL_PROPERTIES, *map(str.upper, rules.URL_PROPERTIES), *map(str.title, rules.URL_PROPERTIES), "linK", "LINK",
        "İmage", "name", "", "urls", "ur", "URL ", "hreﬀ", None,
    ]
    frame = spark.createDataFrame([(n,) for n in names], "name string")
    name = F.col("name")
    found = frame.select("name", _is_url_property(name).alias("got"), F.lower(name).isin(rules.URL_PROPERTIES).alias("want")).collect()
    assert all(r["got"] == r["want"] for r in found) and sum(bool(r["got"]) for r in found) >= 18
