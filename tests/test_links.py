"""URL functions, link extraction and robots rules, against the standard library."""

import random
import urllib.parse
import urllib.robotparser

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marklens import fetched_pages, links_table, robots_allowed
from marklens.functions.urls import (
    is_document_url, netloc, normalise_url, percent_decode, percent_encode, resolve_url, url_parts, url_path, url_query,
    url_scheme,
)
from marklens.operators.robots import robots_rules, rules_index, with_allowed


def evaluate(spark, rows, schema, expression):
    numbered = [(i, *row) for i, row in enumerate(rows)]
    found = spark.createDataFrame(numbered, "i int, " + schema).select("i", expression.alias("value"))
    return [row["value"] for row in found.orderBy("i").collect()]


BASES = ["http://h/", "https://h.com/a/b", "https://h.com/a/b/", "http://h:80", "http://u@H/a//b/c?x=/y/z", "http://h/a/../b"]
REFERENCES = [
    "x", "x/y", "./x", "../x", "../../x", "../../../x", "..", ".", "./", "../", "/", "/x", "/x/../y", "/./x", "/../x", "//o/p",
    "//o", "///p", "?q", "?", "#f", "x#f", "x?q#f", "x/./y", "x/../y", "x//y", "x/", "x/..", "x/.", "http://o/p/../q",
    "https://o", "http:x", "http:/x", "ftp://o/x", "data:x", "x:y", "1:x", "/a:b", "a b", "é", "x/...", "..x", "x..", "/x//y", "//o:8/?q",
    "/x//../y", "mail@x", "%2e%2e/x", "a?b/../c", "?a/../b",
]


def test_resolve_like_the_standard_library(spark):
    pairs = [(base, ref) for base in BASES for ref in REFERENCES]
    got = evaluate(spark, pairs, "base string, ref string", resolve_url(url_parts(F.col("base")), F.col("ref")))
    want = [urllib.parse.urljoin(base, ref).split("#")[0] for base, ref in pairs]
    assert [x for x in zip(pairs, got, want) if x[1] != x[2]] == []


def test_resolve_on_generated_references(spark):
    segment = st.sampled_from(["", ".", "..", "a", "b.c", "d e", "%20"])
    path = st.lists(segment, max_size=6).map("/".join)
    pairs = []

    @settings(max_examples=600, deadline=None, database=None)
    @given(path, path, st.sampled_from(["", "?q", "?a/../b", "#f"]))
    def collect(base, ref, rest):
        pairs.append(("http://h/" + base, ref + rest))

    collect()
    got = evaluate(spark, pairs, "base string, ref string", resolve_url(url_parts(F.col("base")), F.col("ref")))
    want = [urllib.parse.urljoin(base, ref).split("#")[0] for base, ref in pairs]
    # An empty reference names the page itself; it is dropped before links are resolved.
    assert [x for x in zip(pairs, got, want) if x[1] != x[2] and x[0][1]] == []


def test_url_parts_like_the_standard_library(spark):
    urls = [(urllib.parse.urljoin(base, ref),) for base in BASES for ref in REFERENCES] + [(base,) for base in BASES]
    split = [urllib.parse.urlsplit(url) for (url,) in urls]
    col = F.col("u")
    assert evaluate(spark, urls, "u string", netloc(col)) == [s.netloc for s in split]
    assert evaluate(spark, urls, "u string", url_path(col)) == [s.path for s in split]
    assert evaluate(spark, urls, "u string", url_query(col)) == [s.query for s in split]
    assert evaluate(spark, urls, "u string", url_scheme(col)) == [s.scheme for s in split]


def test_normalise(spark):
    urls = [("http://h/a/#x",), ("http://h/a///",), ("http://h",), ("http://h/?q=1/",), ("http://h/#a#b/",), ("/",)]
    assert evaluate(spark, urls, "u string", normalise_url(F.col("u"))) == [u.split("#")[0].rstrip("/") for (u,) in urls]


def test_percent_coding_like_the_standard_library(spark):
    texts = [(t,) for t in ["a b+c*d~e/f", "é%20%zz%2", "%C3%A9", "100%", "?a=1&b=2#f", "%2F%2f", "-_.!'()", "日本"]]
    assert evaluate(spark, texts, "t string", percent_decode(F.col("t"))) == [urllib.parse.unquote(t) for (t,) in texts]
    assert evaluate(spark, texts, "t string", percent_encode(F.col("t"))) == [urllib.parse.quote(t) for (t,) in texts]


def test_document_urls(spark):
    urls = ["http://h/a.pdf", "http://h/a.PDF?x", "http://h/a.html", "http://h/a?b.css", "http://h.js", "http://h/x.js;v=1", "http://h/pdf",
            "http://h/a.jpeg/b", "http://h/;a.zip"]
    want = [True, True, False, False, False, True, False, False, False]
    got = evaluate(spark, [(u,) for u in urls], "u string", ~is_document_url(F.col("u")))
    assert got == want


def test_links(spark):
    html = (
        '<a href=" /b#x ">1</a><a href="">2</a><a href="#y">3</a><a href="mailto:a@b">4</a><a href="c">5</a><a href="/b">6</a>'
        '<a href="https://h.com/d">7</a><a href="http://h.com:8/e">8</a><a href="//other/f">9</a><a href="x.PDF">10</a><a>11</a>'
        '<a href="MAILTO:a@b">12</a><a href="javascript:void(0)">13</a><a href="?p=2">14</a><link href="/no"><a href="tel:1">15</a>'
    )
    pages = fetched_pages(spark.createDataFrame([(1, "https://h.com/a/", html)], "page_id bigint, url string, html string"))
    rows = links_table(pages).orderBy("link_pos").collect()
    # Relative to the page without its trailing slash; repeats kept.
    assert [(r["src"], r["dst"]) for r in rows] == [
        ("https://h.com/a", d) for d in ["https://h.com/b", "https://h.com/c", "https://h.com/b", "https://h.com/d", "https://h.com/a?p=2"]
    ]
    everywhere = {r["dst"] for r in links_table(pages, same_domain=False).collect()}
    assert {"http://h.com:8/e", "https://other/f"} <= everywhere
    assert {r["dst"] for r in links_table(pages, host="other").collect()} == {"https://other/f"}


def test_links_against_the_fetched_url(spark):
    """As the standard library resolves them."""
    hrefs = ["b", "../c", "/d", "?q", "./", "e/f#g"]
    html = "".join(f'<a href="{h}">x</a>' for h in hrefs)
    bases = ["https://h.com/a/", "https://h.com/a", "https://h.com/a/x#y"]
    pages = fetched_pages(spark.createDataFrame([(i, b, html) for i, b in enumerate(bases)], "page_id bigint, url string, html string"))
    rows = links_table(pages, strict_base=True).orderBy("page_id", "link_pos").collect()
    want = [(i, urllib.parse.urljoin(b, h).split("#")[0]) for i, b in enumerate(bases) for h in hrefs]
    assert [(r["page_id"], r["dst"]) for r in rows] == want


ROBOTS = [
    "",
    "User-agent: *\nDisallow: /",
    "User-agent: *\nDisallow:",
    "User-agent: *\nDisallow: /a\nAllow: /a/b\n",
    "User-agent: *\nAllow: /a/b\nDisallow: /a\n",
    "Disallow: /a\nUser-agent: *\nDisallow: /b",
    "User-agent: *\n\nDisallow: /a",
    "User-agent: *\n# comment\n  \nDisallow: /a # why\n\nDisallow: /b",
    "User-agent: other\nUser-agent: Lens\nDisallow: /a\nUser-agent: *\nDisallow: /b",
    "User-agent: marklens-news\nDisallow: /\n\nUser-agent: mark\nDisallow: /a\n\nUser-agent: marklens\nDisallow: /b",
    "User-agent: *\nDisallow: /b\n\nUser-agent: *\nDisallow: /a",
    "User-agent: *\nUser-agent: marklens\nDisallow: /a\n\nUser-agent: marklens\nDisallow: /b",
    "User-agent: marklens\nCrawl-delay: 5\n\nUser-agent: *\nDisallow: /",
    "User-agent: marklens\n\nUser-agent: *\nDisallow: /a",
    "user-AGENT : *\r\nDISALLOW : /a\r\nSitemap: http://x/y:z\r\n\r\n",
    "User-agent: *\nDisallow: /a?x=1\nDisallow: /c%3ad\nDisallow: /é\nDisallow: *\nDisallow: /*.b\nDisallow: /e$",
    "User-agent: *\nDisallow: /a?\nDisallow: /b#\nno colon\nUnknown: x\nAllow: /",
    "User-agent:\nDisallow: /a",
    "User-agent: *\nRequest-rate: 1/5\nUser-agent: marklens\nDisallow: /b\n",
    "﻿User-agent: *\nDisallow: /",
]
URLS = ["http://h", "http://h/", "http://h/a", "http://h/a/b/c", "http://h/a?x=1", "http://h/a?x=12", "http://h/b", "http://h/c:d",
        "http://h/%C3%A9t", "http://h/é", "http://h/x.b", "http://h/e$", "http://h/*", "http://h/a%2Fb", "http://h/b?"]


def expected_robots(body, agent, url):
    parser = urllib.robotparser.RobotFileParser()
    parser.parse(body.splitlines())
    return parser.can_fetch(agent, url)


def verdicts(spark, pairs, agent):
    """Whether each URL is allowed by the robots body beside it."""
    bodies = {body: f"h{n}" for n, body in enumerate(dict.fromkeys(body for body, _ in pairs))}
    robots = spark.createDataFrame([(name, 200, body) for body, name in bodies.items()], "host string, status int, body string")
    urls = spark.createDataFrame([(n, bodies[body], url) for n, (body, url) in enumerate(pairs)], "n int, host string, url string")
    found = with_allowed(urls, F.col("host"), rules_index(robots_rules(robots, agent))).collect()
    return [r["allowed"] for r in sorted(found, key=lambda r: r["n"])]


def test_robots_like_the_standard_library(spark):
    agents = ["marklens/1.0", "Mozilla"]
    pairs = [(body, url) for body in ROBOTS for url in URLS]
    for agent in agents:
        got = verdicts(spark, pairs, agent)
        want = [expected_robots(body, agent, url) for body, url in pairs]
        assert [x for x in zip(pairs, got, want) if x[1] != x[2]] == []


def test_robots_on_generated_files(spark):
    line = st.sampled_from(
        ["User-agent: *", "User-agent: marklens", "User-agent: x", "Disallow: /", "Disallow: /a", "Allow: /a/b", "Disallow:", "",
         "# c", " ", "Crawl-delay: 1", "Foo: bar"]
    )
    bodies = []

    @settings(max_examples=300, deadline=None, database=None)
    @given(st.lists(line, max_size=9).map("\n".join))
    def collect(body):
        bodies.append(body)

    collect()
    pairs = [(body, url) for body in bodies for url in ("http://h/", "http://h/a", "http://h/a/b")]
    got = verdicts(spark, pairs, "marklens/1")
    want = [expected_robots(body, "marklens/1", url) for body, url in pairs]
    assert [x for x in zip(pairs, got, want) if x[1] != x[2]] == []


def test_robots_join_keeps_every_url_of_a_hot_host(spark):
    urls = spark.range(3_000).select(
        F.col("id"), F.concat(F.when(F.col("id") % 3 < 2, "http://hot/").otherwise("http://cold/"), F.col("id").cast("string")).alias("url")
    )
    robots = spark.createDataFrame(
        [("hot", 200, "User-agent: *\nDisallow: /1"), ("cold", 404, "User-agent: *\nDisallow: /")], "host string, status int, body string"
    )
    rows = robots_allowed(urls, robots).collect()
    assert len(rows) == 3_000
    assert {r["id"] for r in rows if not r["allowed"]} == {i for i in range(3_000) if i % 3 < 2 and str(i).startswith("1")}


def test_one_robots_document_counts_per_host(spark):
    urls = spark.createDataFrame([("http://h/a",), ("http://h/b",)], "url string")
    documents = [("h", 200, "User-agent: *\nDisallow: /a"), ("h", 200, "User-agent: *\nDisallow: /b"), ("h", 404, "Disallow")]
    for order in (documents, documents[::-1]):
        robots = spark.createDataFrame(order, "host string, status int, body string")
        assert {(r["url"], r["allowed"]) for r in robots_allowed(urls, robots).collect()} == {("http://h/a", False), ("http://h/b", True)}
        assert robots_allowed(urls, robots).count() == 2


def test_robots_with_many_nested_rules(spark):
    """Rules within rules, in random order, over several pieces of the index: the first that fits decides."""
    rnd = random.Random(8)
    # Without "//", which the standard library takes for a host.
    paths = ["/" + "".join(rnd.choice(["a", "b", "a/"]) for _ in range(rnd.randint(0, 7))) for _ in range(900)]
    body = "User-agent: *\n" + "\n".join(f"{rnd.choice(['Allow', 'Disallow'])}: {path}" for path in paths[:700])
    urls = [f"http://h{rnd.choice(paths)}{rnd.choice(['', 'a', 'b', 'c?x=1', 'é'])}" for _ in range(600)] + ["http://other/a", "http://h"]
    robots = spark.createDataFrame([("h", 200, body)], "host string, status int, body string")
    frame = spark.createDataFrame([(u, i, "r", "p") for i, u in enumerate(urls)], "url string, rules int, host string, places string")
    got = robots_allowed(frame, robots)
    assert got.columns == [*frame.columns, "allowed"]
    want = [expected_robots(body, "marklens", u) if "other" not in u else True for u in urls]
    rows = sorted(got.collect(), key=lambda r: r["rules"])
    assert [r["allowed"] for r in rows] == want and {r["host"] for r in rows} == {"r"}
    assert len(set(want)) == 2
