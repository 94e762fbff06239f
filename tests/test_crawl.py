"""Crawls and sitemaps over snapshots, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from marklens import crawl_frontier, crawl_pages, crawl_sitemap, fetched_pages, schemas, sitemap_urls
from marklens.operators import limits
from marklens.operators.limits import first_rows
from marklens.plans import crawl
from marklens.plans.audit import read_pages
from marklens.session import cut_lineage_dealt

NS = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'


def snapshot(spark, links, status=None):
    """A snapshot of `{name: [linked names]}` on one host."""
    status = status or {}
    rows = [
        (i, f"http://h/{name}", status.get(name, 200), "text/html",
         "".join(f'<a href="{t if "://" in t else "/" + t}">x</a>' for t in targets), None)
        for i, (name, targets) in enumerate(links.items())
    ]
    return spark.createDataFrame(rows, schemas.FETCHED_PAGES)


def brute_force(links, start, max_pages, max_depth, status=None, blocked=()):
    """Level by level, in the order of parents and links."""
    status = status or {}
    visited, level = {}, [start]
    for depth in range(max_depth + 1):
        admitted = []
        for name in level:
            if name not in visited and len(visited) < max_pages and not any(name.startswith(b) for b in blocked):
                visited[name] = depth
                admitted.append(name)
        level = [t for name in admitted if status.get(name, 200) == 200 for t in links.get(name, []) if "://" not in t]
    return visited


def visited(frame):
    return {r["url"].removeprefix("http://h/"): r["depth"] for r in frame.collect()}


def random_graph(seed, size=60):
    rng = random.Random(seed)
    names = [f"p{i}" for i in range(size)]
    links = {n: [rng.choice(names + ["gone", "http://other/x"]) for _ in range(rng.randint(0, 5))] for n in names}
    status = {n: 404 for n in names if rng.random() < 0.1 and n != "p0"}
    return links, status


@pytest.mark.parametrize(("seed", "max_pages", "max_depth"), [(1, 100, 3), (2, 7, 3), (3, 1000, 30), (4, 20, 30), (5, 5, 0), (6, 0, 3)])
def test_crawl_matches_brute_force(spark, seed, max_pages, max_depth):
    links, status = random_graph(seed)
    got = crawl_frontier(snapshot(spark, links, status), "http://h/p0#top", max_pages, max_depth)
    assert visited(got) == brute_force(links, "p0", max_pages, max_depth, status)


@pytest.mark.parametrize("max_pages", [9, 40])
def test_large_crawls_give_the_same_result(spark, monkeypatch, max_pages):
    """The way for crawls too large to broadcast, and the limit that does not pass through one task."""
    monkeypatch.setattr(crawl, "LOOKED_UP_PAGES", 0)
    monkeypatch.setattr(crawl, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(limits, "SMALL_LIMIT", 0)
    links, status = random_graph(7)
    robots = spark.createDataFrame([("h", 200, "User-agent: *\nDisallow: /p1")], "host string, status int, body string")
    pages = snapshot(spark, links, status)
    want = brute_force(links, "p0", max_pages, 10, status, blocked=["p1"])
    assert visited(crawl_frontier(pages, "http://h/p0", max_pages, 10, robots=robots)) == want
    results = crawl_pages(pages, "http://h/p0", max_pages, 10, robots=robots)
    assert visited(results) == {n: d for n, d in want.items() if n in links and n not in status}


def test_links_and_items_come_from_one_reading(spark, monkeypatch):
    """As many pages are read as are visited and in the snapshot, in either way of crawling."""
    links, status = random_graph(11)
    pages = snapshot(spark, links, status)
    want = brute_force(links, "p0", 1_000, 30, status)
    there = [n for n in want if n in links]
    for limit, most in ((20_000, len(there)), (0, len(links))):
        monkeypatch.setattr(crawl, "LOOKED_UP_PAGES", limit)
        read = []
        monkeypatch.setattr(crawl, "read_pages", lambda chosen, *a, _read=read, **o: _read.append(chosen.count()) or read_pages(chosen, *a, **o))
        results = crawl_pages(pages, "http://h/p0", 1_000, 30)
        assert visited(results) == {n: d for n, d in want.items() if n in links and n not in status}
        assert sum(read) == most
        assert "ArrowEvalPython" not in results._jdf.queryExecution().executedPlan().toString()


def test_a_level_moves_only_itself(spark, monkeypatch):
    """A chain of 30 pages: the shuffles of a level's plan do not grow with the levels before it."""
    links = {f"p{i}": [f"p{i + 1}", "p0"] for i in range(30)}
    monkeypatch.setattr(crawl, "LOOKED_UP_PAGES", 0)
    monkeypatch.setattr(crawl, "BROADCAST_BYTES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    shuffles = []

    def counted(df):
        found = cut_lineage_dealt(df)
        conf = df.sparkSession.conf
        conf.set("spark.sql.adaptive.enabled", "false")
        shuffles.append(df.select("*")._jdf.queryExecution().executedPlan().toString().count("Exchange hash"))
        conf.set("spark.sql.adaptive.enabled", "true")
        return found

    monkeypatch.setattr(crawl, "cut_lineage_dealt", counted)
    try:
        got = crawl_frontier(snapshot(spark, links), "http://h/p0", 10**9, 40)
        assert visited(got) == {f"p{i}": i for i in range(31)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Edges, the start, then one level each: its links are brought together by URL, and nothing else is moved.
    assert len(shuffles) == 33 and set(shuffles[2:]) == {1}


@pytest.mark.parametrize("run", [crawl_frontier, crawl_pages])
def test_nothing_is_broadcast_by_estimate(spark, monkeypatch, tmp_path, run):
    """Only measured tables are sent around: checkpoints are larger than Spark's estimate, that of the files they came from."""
    links = {f"p{i}": [f"p{i + 1}", "p0"] for i in range(4)}
    monkeypatch.setattr(crawl, "LOOKED_UP_PAGES", 0)
    monkeypatch.setattr(crawl, "BROADCAST_BYTES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    plans = []

    def noted(df):
        plans.append(df.select("*")._jdf.queryExecution().executedPlan().toString())
        return df

    for name in ("cut_lineage", "cut_lineage_dealt"):
        monkeypatch.setattr(crawl, name, lambda df, cut=getattr(crawl, name): cut(noted(df)))
    snapshot(spark, links).write.parquet(f"{tmp_path}/pages")  # files have a size
    try:
        got = noted(run(spark.read.parquet(f"{tmp_path}/pages"), "http://h/p0", 10**9, 40))
        # The last page is missing; it is visited, but has no result.
        assert visited(got) == {f"p{i}": i for i in range(5 if run is crawl_frontier else 4)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert any("SortMergeJoin" in plan for plan in plans) and not any("BroadcastExchange" in plan for plan in plans)


def test_crawl_across_domains(spark):
    rows = [(1, "http://h/a", '<a href="http://o/b">'), (2, "http://o/b", '<a href="c">'), (3, "http://o/c", "")]
    pages = fetched_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string"))
    assert crawl_frontier(pages, "http://h/a").count() == 1
    assert {r["url"] for r in crawl_frontier(pages, "http://h/a", same_domain=False).collect()} == {"http://h/a", "http://o/b", "http://o/c"}
    # The rules of the start host bind the whole crawl.
    robots = spark.createDataFrame(
        [("h", 200, "User-agent: *\nDisallow: /c"), ("o", 200, "User-agent: *\nDisallow: /")], "host string, status int, body string"
    )
    got = crawl_frontier(pages, "http://h/a", same_domain=False, robots=robots)
    assert {r["url"] for r in got.collect()} == {"http://h/a", "http://o/b"}


@pytest.mark.parametrize("limit", [0, 20_000])
def test_url_fetched_many_times_is_crawled_once(spark, monkeypatch, limit):
    """A third of the snapshot is one URL; its lowest page id counts."""
    monkeypatch.setattr(crawl, "LOOKED_UP_PAGES", limit)
    monkeypatch.setattr(crawl, "BROADCAST_BYTES", limit)
    hot = spark.range(1, 2_001).select(
        F.col("id").alias("page_id"), F.lit("http://h/hot/").alias("url"),
        F.concat(F.lit('<a href="/n'), F.col("id").cast("string"), F.lit('">')).alias("html"),
    )
    rest = spark.range(2_001, 6_001).select(
        F.col("id").alias("page_id"), F.concat(F.lit("http://h/n"), F.col("id").cast("string")).alias("url"), F.lit("").alias("html")
    )
    start = spark.createDataFrame([(0, "http://h", '<a href="/hot"><a href="/hot#2"><a href="/hot/">')], "page_id bigint, url string, html string")
    pages = fetched_pages(start.unionByName(hot).unionByName(rest))
    assert visited(crawl_frontier(pages, "http://h/")) == {"http://h": 0, "hot": 1, "n1": 2}
    assert [(r["page_id"], r["depth"]) for r in crawl_pages(pages, "http://h/").orderBy("depth").collect()] == [(0, 0), (1, 1)]


def test_failed_pages_use_up_the_cap(spark):
    pages = snapshot(spark, {"a": ["x", "b", "c"], "b": [], "c": []}, {"b": 500})
    assert visited(crawl_frontier(pages, "http://h/a", max_pages=3)) == {"a": 0, "x": 1, "b": 1}
    assert visited(crawl_pages(pages, "http://h/a", max_pages=3)) == {"a": 0}


def test_first_rows_is_exact_above_the_small_limit(spark, monkeypatch):
    monkeypatch.setattr(limits, "SMALL_LIMIT", 10)
    rows = spark.range(5_000).select(F.pmod(F.xxhash64("id"), F.lit(700)).alias("a"), "id")
    want = sorted((r["a"], r["id"]) for r in rows.collect())
    for limit in (0, 1, 10, 11, 777, 4_999, 5_000, 9_999):
        got = sorted((r["a"], r["id"]) for r in first_rows(rows, limit, "a", "id").collect())
        assert got == want[:limit]


@pytest.fixture(scope="module")
def documents(spark):
    def urls(*locs, extra=""):
        return f"<?xml version='1.0' encoding='UTF-8'?><urlset {NS}>" + "".join(f"<url><loc>{u}</loc>{extra}</url>" for u in locs) + "</urlset>"

    def index(*locs, extra=""):
        return f"<sitemapindex {NS}>" + "".join(f"<sitemap><loc>{u}</loc></sitemap>" for u in locs) + extra + "</sitemapindex>"

    rows = [
        ("flat", 200, urls("http://h/a", "\n http://h/b \n", "http://h/a", extra="<priority>1</priority>")),
        ("one", 200, urls("http://h/c?x=1&amp;y=2")),
        ("index", 200, index("flat", " one ", "missing", "failed", "flat", "nested", extra="<url><loc>http://h/no</loc></url>")),
        ("nested", 200, index("one")),
        ("failed", 503, urls("http://h/d")),
        ("prefixed", 200, f"<s:urlset {NS.replace('xmlns', 'xmlns:s')}><s:url><s:loc>http://h/p</s:loc></s:url></s:urlset>"),
        ("other_space", 200, '<urlset xmlns="urn:x"><url><loc>http://h/q</loc></url></urlset>'),
        ("broken", 200, f"<urlset {NS}><url><loc>http://h/r"),
        ("empty", 200, f"<urlset {NS}></urlset>"),
        ("null", 200, None),
    ]
    return spark.createDataFrame(rows, "url string, status int, xml string")


@pytest.mark.parametrize(
    ("root", "expected"),
    [
        ("flat", ["http://h/a", "http://h/b", "http://h/a"]),
        ("one", ["http://h/c?x=1&y=2"]),
        ("index", ["http://h/a", "http://h/b", "http://h/a", "http://h/c?x=1&y=2", "http://h/a", "http://h/b", "http://h/a"]),
        ("failed", []),
        ("prefixed", ["http://h/p"]),
        ("other_space", []),
        ("empty", []),
        ("null", []),
    ],
)
def test_sitemap_urls(documents, root, expected):
    rows = sitemap_urls(documents, root).orderBy("sub_pos", "url_pos").collect()
    assert [r["url"] for r in rows] == expected


def test_sitemap_that_is_no_xml_lists_nothing(documents):
    assert sitemap_urls(documents, "broken").count() == 0


@pytest.mark.parametrize("limit", [0, 20_000])
def test_sitemap_crawl(spark, monkeypatch, documents, limit):
    monkeypatch.setattr(crawl, "LOOKED_UP_PAGES", limit)
    monkeypatch.setattr(crawl, "BROADCAST_BYTES", limit)
    rows = [
        (1, "http://h/a", 200, "text/html", '<script type="application/ld+json">{"@type": "Product"}</script>', None),
        (2, "http://h/b", 404, "text/html", "", None),
        (3, "http://h/c?x=1&y=2", 200, "application/pdf", "", None),
        (4, "http://h/a", 200, "text/html", "fetched again", None),
    ]
    results = crawl_sitemap(spark.createDataFrame(rows, schemas.FETCHED_PAGES), documents, "index")
    found = sorted((r["page_id"], r["url"], r["fetch_error"], r["copy"], len(r["items"])) for r in results.collect())
    assert found == [(1, "http://h/a", None, n, 1) for n in (1, 2, 3, 4)] + [(2, "http://h/b", "HTTP 404", n, 0) for n in (1, 2)]


def test_hot_url_of_a_sitemap_is_read_once_and_reported_per_listing(spark):
    listing = f"<urlset {NS}>" + "<url><loc>http://h/a</loc></url>" * 5_000 + "</urlset>"
    documents = spark.createDataFrame([("s", 200, listing)], "url string, status int, xml string")
    pages = snapshot(spark, {"a": []})
    assert crawl_sitemap(pages, documents, "s").count() == 5_000
