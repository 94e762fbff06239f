"""Crawls over a page snapshot: breadth-first by links, or along a sitemap."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import planned_once
from ..functions.urls import netloc, normalise_url
from ..operators.limits import first_rows
from ..operators.links import page_hrefs, unfold_links
from ..operators.robots import robots_rules, rules_index, with_allowed
from ..rules import MAX_DEPTH, MAX_PAGES, USER_AGENT
from ..session import cut_lineage, cut_lineage_dealt
from ..sources.sitemaps import sitemap_urls
from .audit import PAGE_RESULT_COLUMNS, audit_pages, read_pages, validate_items, with_items

# A crawl of at most this many pages looks up the pages of each level; a larger one reads all links of its host once.
# Both visit the same URLs; the bound only weighs scans of a few pages against one scan of all.
LOOKED_UP_PAGES = 20_000
# Up to this many bytes, as measured, a side of a join is sent to every executor.
BROADCAST_BYTES = 8 << 20
# Up to this many page ids are written into the scan's own filter, which can then skip row groups.
PUSHED_IDS = 1_000


def _not_sent(df: DataFrame) -> DataFrame:
    """The table, as a side of a join that moves rows by key.

    A checkpoint's size as Spark estimates it is that of the files its rows were once read from. Links and URLs made of
    a few MB of keys are many times that, and would pass the driver on their way to every executor.
    """
    return df.hint("merge")


def _sent(df: DataFrame, *texts: str) -> DataFrame:
    """The table, to be broadcast if its rows and the bytes of its text columns are few; `df` is a checkpoint."""
    measures = [F.count(F.lit(1)) * 64] + [F.coalesce(F.sum(F.octet_length(t)), F.lit(0)) for t in texts]
    size = sum(df.agg(*measures).first())
    return F.broadcast(df) if size <= BROADCAST_BYTES else _not_sent(df)


def _url_index(pages: DataFrame, url: Column) -> DataFrame:
    """`url` and `page_id` of one page per URL: the lowest id, should a URL have been fetched repeatedly.

    Reads two columns and combines on the map side before anything is joined, so a URL with very many copies is no hot
    key.
    """
    return cut_lineage(pages.groupBy(url.alias("url")).agg(F.min("page_id").alias("page_id")))


def _pick(pages: DataFrame, ids: DataFrame) -> DataFrame:
    """The pages of the given ids (a checkpoint). Few are named to the scan; HTML of others need not be read."""
    first_ids = [row["page_id"] for row in ids.select("page_id").head(PUSHED_IDS + 1)]
    if len(first_ids) <= PUSHED_IDS:
        return pages.filter(F.col("page_id").isin(first_ids))
    return pages.join(_sent(ids.select("page_id")), "page_id", "left_semi")


def _visit(
    pages: DataFrame,
    start_url: str,
    max_pages: int,
    max_depth: int,
    same_domain: bool,
    robots: DataFrame | None,
    user_agent: str,
    read: Callable[[DataFrame], DataFrame],
    keeps: bool,
) -> tuple[list[DataFrame], DataFrame | None]:
    """The levels of a breadth-first crawl, and, if `keeps`, what `read` gave of the pages visited, with their `depth`.

    `read` maps pages to `page_id`, `url`, `fetched`, `hrefs` and what else is to be kept; no page is read twice.

    A crawl of few pages looks the URLs of each level up in the snapshot and reads only those pages. Otherwise the pages
    of the host are read once, and the levels never touch HTML: visited URLs and links are dealt out by URL once, and a
    level is sent to them, so what a level moves follows its own size and not that of the levels before.
    """
    spark = pages.sparkSession
    start = start_url.split("#")[0].rstrip("/")
    host = urlsplit(start_url).netloc
    snapshot = pages.filter(netloc(F.col("url")) == host) if same_domain else pages
    wanted_host = host if same_domain else None
    rules = None
    if robots is not None:
        # Rules of the start host alone bind the whole crawl: one row at most, since rules are one per host.
        rules = rules_index(robots_rules(robots.filter(F.col("host") == host), user_agent))

    few = max_pages <= LOOKED_UP_PAGES
    index = _url_index(snapshot, normalise_url(F.col("url"))) if keeps or max_depth > 0 else None
    by_level = few or (keeps and index.count() <= LOOKED_UP_PAGES)
    kept: list[DataFrame] = []
    whole = edges = None
    if not by_level and index is not None:
        whole = read(snapshot).join(_sent(index.select("page_id")), "page_id", "left_semi")
        if keeps:
            whole = cut_lineage(whole)
        links = unfold_links(whole, same_domain, wanted_host, "url")
        edges = cut_lineage_dealt(links.select("url", "link_pos", "dst").repartition("url").sortWithinPartitions("url"))
    cut = cut_lineage if few else cut_lineage_dealt

    def links_from(level: DataFrame, reached: DataFrame | None) -> DataFrame:
        if edges is not None:
            found = level.select("url", "place").join(_not_sent(edges), "url")
        else:
            found = unfold_links(reached, same_domain, wanted_host, "place")
        return (
            found.select(normalise_url(F.col("dst")).alias("url"), F.array_append("place", F.col("link_pos")).alias("place"))
            .groupBy("url")
            .agg(F.min("place").alias("place"))
        )

    frontier = spark.createDataFrame([(start, [0])], "url string, place array<int>")
    levels: list[DataFrame] = []
    room = max_pages
    for depth in range(max_depth + 1):
        if room <= 0:
            break
        fresh = frontier
        if levels:
            visited = reduce(DataFrame.unionByName, [level.select("url") for level in levels])
            fresh = fresh.join(visited if few else _not_sent(visited), "url", "left_anti")
        if rules is not None:
            fresh = with_allowed(fresh, F.lit(host), rules, sent=True).filter("allowed").drop("allowed")
        level = cut((fresh if levels else fresh.repartition("url")).select("url", F.lit(depth).alias("depth"), "place"))
        if level.count() > room:
            level = cut_lineage(first_rows(level, room, "place"))
        count = level.count()
        if count == 0:
            break
        levels.append(level)
        room -= count
        goes_on = depth < max_depth and room > 0
        reached = None
        if by_level and (keeps or goes_on):
            chosen = cut_lineage(index.join(_sent(level, "url"), "url"))
            reached = read(_pick(snapshot, chosen)).join(_sent(chosen.drop("url")), "page_id")
            if keeps:
                reached = cut_lineage(reached)
                kept.append(reached)
        if goes_on:
            frontier = links_from(level, reached)
    if not levels:
        levels = [frontier.limit(0).select("url", F.lit(0).alias("depth"), "place")]
    if not keeps:
        return levels, None
    if not by_level:
        visited = cut_lineage(reduce(DataFrame.unionByName, levels).select("url", "depth"))
        return levels, whole.join(_sent(visited, "url"), "url")
    return levels, planned_once(reduce(DataFrame.unionByName, kept)) if kept else read(snapshot).limit(0).withColumn("depth", F.lit(0))


def crawl_frontier(
    pages: DataFrame,
    start_url: str,
    max_pages: int = MAX_PAGES,
    max_depth: int = MAX_DEPTH,
    same_domain: bool = True,
    robots: DataFrame | None = None,
    user_agent: str = USER_AGENT,
) -> DataFrame:
    """URLs a breadth-first crawl visits: `url`, `depth`, and `place`, its rank as an array to sort by.

    One round per level. A URL's place is its parent's place followed by its link position, so the order in which
    the page cap cuts is (depth, parent order, link position) and needs no global numbering. Failed, missing and
    non-HTML URLs count as visited; URLs that robots rules block do not.
    """
    levels, _ = _visit(
        pages, start_url, max_pages, max_depth, same_domain, robots, user_agent, page_hrefs, keeps=False
    )
    return reduce(DataFrame.unionByName, levels)


def crawl_pages(
    pages: DataFrame,
    start_url: str,
    max_pages: int = MAX_PAGES,
    max_depth: int = MAX_DEPTH,
    same_domain: bool = True,
    robots: DataFrame | None = None,
    user_agent: str = USER_AGENT,
    google_guidelines: bool = True,
    with_raw: bool = False,
) -> DataFrame:
    """Page results of the pages a crawl reaches, with the `depth` each was reached at.

    Links and items of a page come from one reading of it.
    """

    def read(chosen: DataFrame) -> DataFrame:
        return read_pages(chosen, "crawl", links=True)

    _, reached = _visit(pages, start_url, max_pages, max_depth, same_domain, robots, user_agent, read, keeps=True)
    return validate_items(with_items(reached, with_raw), google_guidelines).select(*PAGE_RESULT_COLUMNS, "depth")


def _audited(pages: DataFrame, chosen: DataFrame, mode: str, google_guidelines: bool, with_raw: bool) -> DataFrame:
    """Page results of the chosen page ids, with the other columns of `chosen`.

    Few ids select their pages before any HTML is read. If they are too many to be sent around, the pages are audited
    where they are and the slim results are shuffled instead of the HTML.
    """
    chosen = cut_lineage(chosen)
    sent = _sent(chosen)
    picked = pages if sent is chosen else _pick(pages, chosen)
    return audit_pages(picked, mode, google_guidelines, with_raw).join(sent, "page_id")


def crawl_sitemap(
    pages: DataFrame,
    documents: DataFrame,
    root: str | None = None,
    google_guidelines: bool = True,
    with_raw: bool = False,
) -> DataFrame:
    """Page results of the URLs that sitemaps list, one per listing, with `sitemap_url` and `copy`.

    Repeated listings are folded into a count before anything is joined and unfolded at the end, so a URL listed
    over and over is looked up, read and checked once. URLs that the snapshot lacks yield nothing.
    """
    listed = cut_lineage(
        sitemap_urls(documents, root).groupBy("sitemap_url", "url").agg(F.count(F.lit(1)).alias("listings"))
    )
    # Pages of hosts that no sitemap names are left out first.
    hosts = cut_lineage(listed.select(netloc(F.col("url")).alias("_host")).distinct())
    near = (
        pages.withColumn("_host", netloc(F.col("url"))).join(_sent(hosts, "_host"), "_host", "left_semi").drop("_host")
    )
    wanted = cut_lineage(listed.select("url").distinct())
    chosen = _url_index(near, F.col("url")).join(_sent(wanted, "url"), "url", "left_semi")
    results = _audited(near, chosen.select("page_id"), "sitemap", google_guidelines, with_raw)
    return results.join(listed, "url").select(
        *PAGE_RESULT_COLUMNS,
        "sitemap_url",
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("listings"))).alias("copy"),
    )
