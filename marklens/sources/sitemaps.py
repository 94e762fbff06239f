"""Sitemap source: the URLs that sitemap documents list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import entries_of
from ..rules import SITEMAP_NAMESPACE

_LISTED = "sitemap array<struct<loc string>>, url array<struct<loc string>>"


def _listed(xml: Column) -> Column:
    """Entries of a document; NULL where it is broken or not in the sitemap namespace."""
    readable = F.when(xml.contains(SITEMAP_NAMESPACE), xml)
    return F.from_xml(readable, _LISTED, {"ignoreNamespace": "true", "mode": "PERMISSIVE"})


def _locations(entries: Column) -> Column:
    return F.transform(entries, lambda entry: F.trim(entry["loc"]))


def sitemap_urls(documents: DataFrame, root: str | None = None) -> DataFrame:
    """URLs of sitemaps in document order, repeats kept: `sitemap_url`, `sub_pos`, `url_pos`, `url`.

    `documents` holds `url`, `status` and `xml`. With `root` only that sitemap is read, else every document is taken
    as one that was asked for. An index is expanded one level into documents of the same table, and its own URLs are
    then ignored; documents that were not fetched with status 200 list nothing. Of several documents with one URL the
    one whose text comes first in order counts.
    """
    fetched = documents.filter("status = 200").groupBy("url").agg(F.min("xml").alias("xml"))
    listed = fetched.select("url", _listed(F.col("xml")).alias("doc"))
    entries = listed.select(
        F.col("url").alias("sitemap_url"),
        F.filter(_locations(F.col("doc.sitemap")), lambda loc: loc != "").alias("subs"),
        F.coalesce(F.size("doc.sitemap"), F.lit(0)).alias("n_subs"),
        F.filter(_locations(F.col("doc.url")), lambda loc: loc.isNotNull()).alias("locs"),
    )
    roots = entries if root is None else entries.filter(F.col("sitemap_url") == root)
    direct = roots.filter("n_subs <= 0").select(
        "sitemap_url", F.lit(0).alias("sub_pos"), F.posexplode(entries_of("locs")).alias("url_pos", "url")
    )
    index = roots.filter("n_subs > 0").select("sitemap_url", F.posexplode(entries_of("subs")).alias("sub_pos", "sub_url"))
    # The join is on whole documents, not on their URLs: the lists are unfolded after it, where they are wanted.
    subs = entries.select(F.col("sitemap_url").alias("sub_url"), "locs")
    nested = index.join(subs, "sub_url").select(
        "sitemap_url", "sub_pos", F.posexplode(entries_of("locs")).alias("url_pos", "url")
    )
    return direct.unionByName(nested)
