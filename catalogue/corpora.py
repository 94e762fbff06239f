"""Page corpora derived from the given tables: each row of a table becomes one page.

Which markup a page holds follows from its key, so SQL over the same table can state what an audit must find without
reading any HTML. Page ids are `10 * key + family number`, unique over all corpora.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marklens import rules
from marklens.functions.columns import built_once, planned_once
from marklens.sources.pages import dealt_out, fetched_pages, spread

CONTEXT = "https://schema.org"


Corpus = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _columns(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The rows that pages are built from, dealt out evenly: a table may come in few splits, or in very unequal ones.

    These rows are slim; the pages built of them are many times as large and stay where they are.
    """
    return dealt_out(table(spark, sf_dir, name).select(*columns))


def _text(*parts: str | Column) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _object(**fields: str | Column) -> Column:
    """A JSON object; `type_` and `context_` stand for the @ names."""
    renamed = {"type_": "@type", "context_": "@context", "graph_": "@graph", "id_": "@id"}
    return F.struct(
        *[
            (value if isinstance(value, Column) else F.lit(value)).alias(renamed.get(name, name))
            for name, value in fields.items()
        ]
    )


def _script(json: Column) -> Column:
    return _text('<script type="application/ld+json">', json, "</script>")


def _ld(**fields: str | Column) -> Column:
    return _script(F.to_json(_object(context_=CONTEXT, **fields)))


def _by_variant(variant: Column, bodies: list[Column]) -> Column:
    chosen = F.when(variant == 0, bodies[0])
    for number, body in enumerate(bodies[1:], start=1):
        chosen = chosen.when(variant == number, body)
    return chosen


def _page(title: Column, in_head: Column | str, in_body: Column | str) -> Column:
    return _text(
        "<!DOCTYPE html><html><head><title>", title, " &amp; more</title>", in_head,
        "</head><body><!-- ad --><p>Text <b>bold<p>More text", in_body, "</body></html>",
    )


def _corpus(source: DataFrame, family: int, key: Column, url_prefix: str, html: Column) -> DataFrame:
    return fetched_pages(
        source.select(
            (key * 10 + family).alias("page_id"), _text(url_prefix, key.cast("string")).alias("url"), html.alias("html")
        )
    )


@built_once
def _product_html() -> Column:
    key = F.col("p_partkey")
    name = F.col("p_name")
    image = _text("https://img.example.com/", key.cast("string"), ".jpg")
    offer = _object(type_="Offer", price="9.5", priceCurrency="EUR")
    full = {"type_": "Product", "name": name, "image": image, "offers": offer}
    pair = F.array(_object(**full), _object(**full))
    bodies = [
        _ld(**full),
        _ld(type_="Product", name=name, offers=offer),
        _ld(type_="Product", price="9.5", image=image),
        _script(F.lit('{"@type": "Product", "name": ')),
        _ld(
            graph_=F.array(
                F.parse_json(F.to_json(_object(**full))),
                F.parse_json(F.to_json(_object(type_="Organization", name=F.col("p_brand")))),
            )
        ),
        _script(F.to_json(pair)),
        _ld(type_=F.array(F.lit("Product"), F.lit("Thing")), name=name),
        _ld(type_=F.array(F.lit("Thing"), F.lit("Product")), description=name),
        _ld(**full, url="not-a-url"),
        _script(_text(F.to_json(_object(**full)), " trailing")),
        _ld(type_="Offer", name=name, priceCurrency="EUR"),
        F.lit(""),
    ]
    return _page(name, _by_variant(key % 12, bodies), "")


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Family 0, from `part`: JSON-LD products, twelve variants."""
    source = _columns(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand")
    return _corpus(source, 0, F.col("p_partkey"), "https://shop.example.com/product/", _product_html())


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Family 1, from `orders`: articles, events, FAQ pages and breadcrumbs, six variants."""
    source = _columns(spark, sf_dir, "orders", "o_orderkey", "o_orderdate", "o_orderpriority")
    key = F.col("o_orderkey")
    headline = _text("Order ", key.cast("string"))
    author = F.col("o_orderpriority")
    image = _text("https://img.example.com/", key.cast("string"), ".png")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    entities = F.array(
        F.parse_json(F.lit('{"@type":"Answer"}')),
        F.parse_json(F.lit('{"@type":"Question"}')),
        F.parse_json(F.lit('{"name":"x"}')),
        F.parse_json(F.lit('"text"')),
    )
    bodies = [
        _ld(type_="Article", headline=headline, author=author, datePublished=day, image=image),
        _ld(
            type_="Article", headline=headline, author=author,
            datePublished=F.date_format("o_orderdate", "d MMMM yyyy"), image=image,
        ),
        _ld(type_="NewsArticle", headline=headline, author=author, datePublished=_text(day, "T08:30:00.123Z")),
        _ld(type_="Event", name=headline, startDate=_text(day, "T08:30+01:00")),
        _ld(type_="FAQPage", mainEntity=entities),
        _ld(type_="BreadcrumbList", itemListElement=F.array().cast("array<string>")),
    ]
    return _corpus(
        source, 1, key, "https://news.example.com/article/", _page(headline, _by_variant(key % 6, bodies), "")
    )


# Values for required properties whose shape is checked.
SHAPED_VALUES = {
    "datePublished": "2024-01-31",
    "datePosted": "2024-01-31",
    "uploadDate": "2024-01-31",
    "startDate": "2024-01-31",
    "image": "https://img.example.com/a.jpg",
    "target": "https://example.com/search?q=x",
}


def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Family 2, from `part`: every type with required properties, one of them left out by `p_size`."""
    source = _columns(spark, sf_dir, "part", "p_partkey", "p_size")
    names = list(rules.REQUIRED_PROPERTIES)
    at = (F.col("p_partkey") % len(names)).cast("int")
    all_names = F.array(*map(F.lit, names))
    all_props = F.array(
        *[F.array(*map(F.lit, props)) if props else F.array().cast("array<string>")
          for props in rules.REQUIRED_PROPERTIES.values()]
    )
    values = F.create_map(*[F.lit(x) for pair in SHAPED_VALUES.items() for x in pair])
    kept = F.filter(F.get(all_props, at), lambda prop, i: i != F.col("p_size") % 4)
    entries = F.transform(kept, lambda prop: F.struct(prop, F.coalesce(F.try_element_at(values, prop), F.lit("v"))))
    json = F.to_json(F.map_concat(F.create_map(F.lit("@type"), F.get(all_names, at)), F.map_from_entries(entries)))
    html = _page(F.lit("Typed"), _script(json), "")
    return _corpus(source, 2, F.col("p_partkey"), "https://types.example.com/t/", html)


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Family 3, from `supplier`: Microdata, six variants."""
    source = _columns(spark, sf_dir, "supplier", "s_suppkey", "s_name", "s_acctbal")
    key, name = F.col("s_suppkey"), F.col("s_name")
    number = key.cast("string")
    cents = F.round(F.col("s_acctbal") * 100).cast("bigint").cast("string")
    kind = "https://schema.org/"
    bodies = [
        _text(
            f'<div itemscope itemtype="{kind}Organization"><span itemprop="name">', name,
            '</span><a itemprop="url" href="https://dir.example.com/', number, '">site</a></div>',
        ),
        _text(
            f'<div itemscope itemtype="{kind}Product"><h1 itemprop="name"> ', name,
            ' </h1><img itemprop="image" src="https://img.example.com/', number,
            f'.png"><div itemprop="offers" itemscope itemtype="{kind}Offer"><meta itemprop="price" content="', cents,
            '"><span itemprop="priceCurrency">EUR</span></div></div>',
        ),
        _text(
            f"<div itemscope itemtype='{kind}Product'><b itemprop=name>", name,
            "</b><div itemprop=brand itemscope>Brand <i itemprop=label>", number, "</i></div></div>",
        ),
        _text('<div itemscope><span itemprop="name">', name, "</span></div>"),
        _text(
            f'<section itemscope itemtype="{kind}LocalBusiness {kind}Store"><p itemprop="name">', name, "</p></section>"
        ),
        _text(
            f'<div itemscope itemtype="{kind}Organization"><span itemprop="name">', name,
            '</span><p itemprop="telephone">', number, '<p itemprop="telephone">', cents,
            '<time itemprop="foundingDate" datetime="2001-02-03">long ago</time></div>',
        ),
    ]
    return _corpus(
        source, 3, key, "https://dir.example.com/supplier/", _page(name, "", _by_variant(key % 6, bodies))
    )


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Family 4, from `customer`: RDFa, five variants."""
    source = _columns(spark, sf_dir, "customer", "c_custkey", "c_name", "c_nationkey")
    key, name = F.col("c_custkey"), F.col("c_name")
    nation = _text("N", F.col("c_nationkey").cast("string"))
    bodies = [
        _text(
            '<div vocab="https://schema.org/" typeof="Person"><span property="name">', name,
            '</span><a property="url" href="https://id.example.com/', key.cast("string"), '">me</a></div>',
        ),
        _text(
            '<div vocab="https://schema.org/" typeof="Person"><b property="name">', name,
            '</b><div property="address" typeof="PostalAddress"><i property="addressLocality">', nation,
            "</i></div></div>",
        ),
        _text('<span property="name">', name, '</span><span property="area">', nation, "</span>"),
        F.lit(""),
        _text('<div typeof="Organization" property="name" content="', name, '"></div>'),
    ]
    in_head = F.when(
        key % 5 == 3,
        _text('<meta property="og:title" content="', name, '"><meta property="og:site_name" content="', nation, '">'),
    ).otherwise("")
    return _corpus(source, 4, key, "https://id.example.com/c/", _page(name, in_head, _by_variant(key % 5, bodies)))


def oddities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Family 5, from `events`: untyped, empty, deprecated and unsupported items, URL and date shapes."""
    source = _columns(spark, sf_dir, "events", "event_id", "ts", "event_type", "props")
    key, name = F.col("event_id"), F.col("event_type")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    bodies = [
        _ld(type_="EntryRating", name=name),
        _ld(name=name, detail=F.parse_json(F.col("props"))),
        _ld(type_="WebPage"),
        _ld(type_="WebPage", name=name, url=_text("https://", name, ".photography/x")),
        _ld(
            type_="WebSite", name=name, URL="http://localhost:8080/a", logo="http://1.2.3.4",
            Image="https://example.com#x", sameAs="nope", target=_text("https://www.", name, ".example.com./?q=1"),
        ),
        _ld(
            type_="Dataset", name=name, description="d", dateModified=stamp, dateCreated=F.date_format("ts", "yyyy"),
            expires=" ", startDate=F.date_format("ts", "yyyy-MM-dd HH:mm"),
        ),
        _ld(type_=F.array(F.lit("Thing"), F.lit("WebPage")), id_="#me", url=F.array(F.lit("nope"))),
        _ld(type_=_text("Custom-", name), name=name),
    ]
    return _corpus(source, 5, key, "https://odd.example.com/e/", _page(name, _by_variant(key % 8, bodies), ""))


DEEP = 1_500


def hard_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Family 8, from `part`: JSON-LD blocks that are valid but awkward, alone and beside others, six variants."""
    source = _columns(spark, sf_dir, "part", "p_partkey", "p_name")
    name = F.col("p_name")
    quoted = F.to_json(F.struct(name.alias("name"))).substr(F.lit(2), F.length(F.to_json(F.struct(name.alias("name")))) - 2)
    product = _text('{"@type":"Product",', quoted)
    deep = _text(product, ',"part":', "[" * DEEP, "1", "]" * DEEP, "}")
    micro = _text('<div itemscope itemtype="https://schema.org/Person"><b itemprop="name">', name, "</b></div>")
    escaped = '<script type="application&#x2F;ld&#43;json">'
    bodies = [
        _script(_text(product, ',"price":1e400,"weight":-1e999}')),
        _script(deep),
        _text(_script(_text(product, "}")), _script(F.lit('{"@type": "Product"')), _script(_text(product, ',"sku":1}')), micro),
        _text(escaped, product, "}</script>"),
        _script(_text(product, ',"sku":', "9" * 1_200, "}")),
        _text(_script(F.lit("[" * 150_000)), micro),
    ]
    return _corpus(
        source, 8, F.col("p_partkey"), "https://hard.example.com/p/", _page(name, "", _by_variant(F.col("p_partkey") % 6, bodies))
    )


LARGE_JSON, LARGE_TEXT, LARGER_TEXT = 17_000_000, 20_000_000, 24_000_000


def large_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Family 9, from `region`: pages with a text that is large for its format, in JSON-LD too large for a VARIANT, three variants."""
    name = F.col("r_name")

    def repeated(size: int) -> Column:
        return _text(F.repeat(_text(name, " "), F.ceil(F.lit(size) / (F.length(name) + 1)).cast("int")), "end")

    graph = _text(
        '{"@graph":[{"@type":"Article","description":"', repeated(LARGE_JSON), '","name":"', name, '"},{"@type":"Person","name":"x"}]}'
    )
    scoped = '<div itemscope itemtype="https://schema.org/Article"><b itemprop="name">'
    typed = '<div typeof="Article"><b property="name">'
    bodies = [
        _script(graph),
        _text(scoped, name, '</b><p itemprop="description">', repeated(LARGE_TEXT), "</p></div>"),
        _text(typed, name, '</b><p property="description">', repeated(LARGER_TEXT), "</p></div>"),
    ]
    source = _columns(spark, sf_dir, "region", "r_regionkey", "r_name")
    key = F.col("r_regionkey")
    return _corpus(source, 9, key, "https://large.example.com/r/", _page(name, "", _by_variant(key % 3, bodies)))


def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Family 6, from `part`: product pages with failed, missing and non-HTML responses among them."""
    source = _columns(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand")
    key = F.col("p_partkey")
    slot = key % 50
    return source.select(
        (key * 10 + 6).alias("page_id"),
        _text("https://log.example.com/p/", key.cast("string"), F.when(key % 2 == 0, "/").otherwise("#top")).alias("url"),
        F.when(slot == 2, F.lit(None)).when(slot == 0, 404).when(slot == 3, 500).otherwise(200).cast("int").alias("status"),
        F.when(slot == 1, "application/pdf").when(slot == 4, F.lit(None)).when(slot == 5, "TEXT/HTML")
        .otherwise("text/html; charset=utf-8").alias("content_type"),
        F.when(slot != 2, _product_html()).alias("html"),
        F.when(slot == 2, _text("Timeout after ", key.cast("string"))).alias("fetch_error"),
    )


def _together(*corpora: Corpus) -> Corpus:
    """Pages of several corpora; what is made of them is planned once, not for each."""

    def get(spark: SparkSession, sf_dir: str) -> DataFrame:
        return planned_once(reduce(DataFrame.unionByName, [corpus(spark, sf_dir) for corpus in corpora]))

    return get


jsonld_pages = _together(products, articles, oddities)
all_markup = _together(products, articles, typed, listings, profiles, oddities)
markup_and_log = _together(products, articles, typed, listings, profiles, oddities, fetch_log)


def real_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given `pages`."""
    return spread(fetched_pages(table(spark, sf_dir, "pages")))


GRAPH_HOST = "graph.example.com"
GRAPH_START = f"https://{GRAPH_HOST}/c/0"
FAN_OUT = 10


def link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Family 7, from `customer`: page k links to pages 10k+1 to 10k+10 in several notations, back to page 0, and out.

    Keys beyond the table are links to pages that the snapshot lacks; some pages were not found when fetched.
    """
    source = _columns(spark, sf_dir, "customer", "c_custkey", "c_name")
    key = F.col("c_custkey")
    notations = ["/c/{}", "{}", "../c/{}#part", f"//{GRAPH_HOST}/c/{{}}/", f"https://{GRAPH_HOST}/c/{{}}"]
    children = []
    for n in range(1, FAN_OUT + 1):
        before, after = notations[n % len(notations)].split("{}")
        children.append(_text(f'<li><a href="{before}', (key * FAN_OUT + n).cast("string"), f'{after}">child</a>'))
    others = (
        '<a href="#top">top</a><a href="/c/0">start</a><a href="https://other.example.com/">out</a>'
        '<a href="/files/list.pdf">list</a><a href="mailto:x@example.com">mail</a>'
    )
    person = _ld(type_="Person", name=F.col("c_name"))
    html = _page(F.col("c_name"), person, _text("<ul>", *children, "</ul>", others))
    return fetched_pages(
        source.select(
            (key * 10 + 7).alias("page_id"),
            _text(f"https://{GRAPH_HOST}/c/", key.cast("string")).alias("url"),
            html.alias("html"),
            F.when(key % 17 == 5, 404).otherwise(200).alias("status"),
        ),
        status="status",
    )


def crawl_robots(spark: SparkSession) -> DataFrame:
    """The link graph's robots document; its rules keep a crawl out of /c/13 and of what starts like it."""
    body = "User-agent: other\nDisallow: /\n\nUser-agent: *\nAllow: /c/131$\nDisallow: /c/13\n"
    return spark.createDataFrame([(GRAPH_HOST, 200, body)], "host string, status int, body string")


ROBOTS_BODIES = [
    "# rules\nUser-agent: *\nDisallow: /\n\nUser-agent: marklens\nAllow: /en/1\nDisallow: /en/ # no English\n",
    "User-agent: *\nDisallow: /fr/\nDisallow:\n",
    "User-agent: *\nDisallow: /\n",
]


def host_robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Robots documents of the hosts of `pages`, by the length of the host's name; every third one was not found.

    Hosts whose name has an even length were asked twice: a second document, later in order, would forbid everything.
    """
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1)
    kind = F.length("host") % 3
    hosts = table(spark, sf_dir, "pages").select(host.alias("host")).distinct()
    documents = hosts.select(
        "host",
        F.when(kind == 2, 404).otherwise(200).alias("status"),
        F.get(F.array(*map(F.lit, ROBOTS_BODIES)), kind).alias("body"),
    )
    again = documents.filter((F.length("host") % 2 == 0) & (F.col("status") == 200)).withColumn("body", F.lit(LATER_ROBOTS))
    return documents.unionByName(again)


LATER_ROBOTS = "user-agent: *\nDisallow: /\n"

LISTED_PER_SITEMAP = 5
SITEMAPS_PER_INDEX = 10


def sitemap_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From `supplier`: a sitemap per supplier that lists pages of the link graph, and an index per ten suppliers."""
    key = F.col("s_suppkey")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey")
    root = f"https://{GRAPH_HOST}/sitemaps/"
    space = F.when(key % 11 == 4, "urn:other").otherwise(rules.SITEMAP_NAMESPACE)
    page = f"https://{GRAPH_HOST}/c/"
    entries = [
        _text(
            "<url><loc> ", page, (key * LISTED_PER_SITEMAP + n).cast("string"), " </loc></url>"
        )
        for n in range(LISTED_PER_SITEMAP)
    ]
    # The first entry once more: listings may repeat.
    entries.append(entries[0])
    leaves = suppliers.select(
        _text(root, key.cast("string"), ".xml").alias("url"),
        F.when(key % 7 == 3, 503).otherwise(200).alias("status"),
        _text('<?xml version="1.0" encoding="UTF-8"?><urlset xmlns="', space, '">', *entries, "</urlset>").alias("xml"),
    )
    subs = [
        _text("<sitemap><loc>", root, (key + n).cast("string"), ".xml</loc></sitemap>")
        for n in range(SITEMAPS_PER_INDEX)
    ]
    indexes = suppliers.filter(key % SITEMAPS_PER_INDEX == 0).select(
        _text(root, "index-", key.cast("string"), ".xml").alias("url"),
        F.lit(200).alias("status"),
        _text(
            '<s:sitemapindex xmlns:s="', rules.SITEMAP_NAMESPACE, '">',
            *[F.replace(F.replace(F.replace(sub, F.lit("</"), F.lit("</s:")), F.lit("<sitemap"), F.lit("<s:sitemap")),
                        F.lit("<loc"), F.lit("<s:loc")) for sub in subs],
            "</s:sitemapindex>",
        ).alias("xml"),
    )
    # Some sitemaps were fetched twice.
    return leaves.unionByName(leaves.filter(key % 9 == 2)).unionByName(indexes)
