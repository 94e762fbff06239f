"""Link graph: what each page points to, resolved in the page's row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import built_once, let, strip
from ..functions.urls import is_document_url, is_followed_href, netloc, resolve_url, url_parts
from ..sources.pages import classify_pages
from .elements import read_document


def link_targets(hrefs: Column, page_url: Column, host: Column | None) -> Column:
    """Array of (`link_pos`, `dst`) in document order, repeats kept; only links to `host` unless it is None.

    Links resolve against `page_url`.
    """
    numbered = F.transform(hrefs, lambda href, at: F.struct(at.alias("link_pos"), strip(href).alias("href")))
    followed = F.filter(numbered, lambda link: is_followed_href(link["href"]))

    def resolve_all(base: Column) -> Column:
        return F.transform(
            followed,
            lambda link: F.struct(link["link_pos"].alias("link_pos"), resolve_url(base, link["href"]).alias("dst")),
        )

    def is_kept(link: Column) -> Column:
        kept = is_document_url(link["dst"])
        return kept if host is None else (netloc(link["dst"]) == host) & kept

    return F.filter(let(url_parts(page_url), resolve_all), is_kept)


@built_once
def _targets(same_domain: bool, base: str) -> Column:
    return link_targets(F.col("hrefs"), F.col(base), F.col("host") if same_domain else None)


def page_hrefs(pages: DataFrame) -> DataFrame:
    """Crawlable pages with the raw `hrefs` of their anchors: `page_id`, `url` (normalised), `fetched`, `hrefs`."""
    known = classify_pages(pages.withColumn("fetched", F.substring_index("url", "#", 1)), "crawl", "fetched")
    return known.select(
        "page_id", "url", "fetched", read_document(F.col("html"), markup=False, links=True)["hrefs"].alias("hrefs")
    )


def unfold_links(
    linking: DataFrame, same_domain: bool, host: str | None, *kept: str, strict_base: bool = False
) -> DataFrame:
    """One row per link of rows with `url`, `fetched` and `hrefs`: the kept columns, `link_pos` and `dst`."""
    wanted = F.lit(host) if host is not None else netloc(F.col("url"))
    targets = _targets(same_domain, "fetched" if strict_base else "url")
    return linking.withColumn("host", wanted).select(*kept, F.inline(targets))


def links_table(
    pages: DataFrame, same_domain: bool = True, host: str | None = None, strict_base: bool = False
) -> DataFrame:
    """Links of a page table: `page_id`, `src`, `link_pos`, `dst`. Narrow: one pass, no shuffle.

    `same_domain` keeps links to `host`, or to the page's own host where none is given. Links resolve against the
    page's normalised URL, so `b` on `/a/` is `/b`; with `strict_base` against the URL it was fetched from: `/a/b`.
    """
    found = unfold_links(page_hrefs(pages), same_domain, host, "page_id", "url", strict_base=strict_base)
    return found.withColumnRenamed("url", "src")
