"""One query per operator of the engine, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import marklens as m
from marklens.functions import variants as V
from marklens.functions.overflow import text_of
from marklens.functions.urls import is_document_url, netloc, normalise_url, url_path
from marklens.operators.elements import read_document
from marklens.plans.report import tallies
from marklens.session import cut_lineage, remove_folder, scratch_folder

from . import corpora as C

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


ISSUE_COLUMNS = ["page_id", "url", "item_ord", "issue_type", "severity", "message", "path", "schema_ref"]


def _items(pages: DataFrame) -> DataFrame:
    return m.items_table(m.audit_pages(pages)).select(
        "page_id", "url", "item_ord", "schema_format", "schema_type", "context", "is_graph_item",
        F.size("properties").alias("n_properties"),
    )


def _properties(pages: DataFrame) -> DataFrame:
    """One row per item property value that is a text or a text in a list."""
    items = m.items_table(m.audit_pages(pages))
    entries = items.select("page_id", "item_ord", "schema_type", F.explode("properties").alias("name", "value"))
    values = F.coalesce(V.as_list(F.col("value")), F.array("value"))
    return entries.select(
        "page_id", "item_ord", "schema_type", "name", F.posexplode(values).alias("value_ord", "entry")
    ).select("page_id", "item_ord", "schema_type", "name", "value_ord", V.as_text(F.col("entry")).alias("value"))


def _issues(pages: DataFrame, *kinds: str, google_guidelines: bool = True) -> DataFrame:
    issues = m.issues_table(m.audit_pages(pages, google_guidelines=google_guidelines))
    if kinds:
        issues = issues.filter(F.col("issue_type").isin(*kinds))
    return issues.select(*ISSUE_COLUMNS)


# --- extraction ---------------------------------------------------------------------------------


@query
def jsonld_items(spark, sf_dir):
    return _items(C.jsonld_pages(spark, sf_dir))


@query
def jsonld_graph_context(spark, sf_dir):
    return _items(C.products(spark, sf_dir)).filter("is_graph_item")


@query
def jsonld_text_properties(spark, sf_dir):
    return _properties(C.products(spark, sf_dir)).filter("value IS NOT NULL AND name <> 'offers'")


@query
def jsonld_raw(spark, sf_dir):
    """The source of each item: the object for a valid block, the text for a malformed one."""
    items = m.items_table(m.audit_pages(C.products(spark, sf_dir), with_raw=True))
    raw = F.col("raw")
    return items.select(
        "page_id",
        "item_ord",
        V.is_object(raw).alias("is_object"),
        V.as_text(F.when(~V.is_object(raw), raw)).alias("text"),
        V.as_text(V.member(raw, "name")).alias("name"),
    )


@query
def jsonld_hard_blocks(spark, sf_dir):
    """Blocks with overflowing or very long numbers, deep nesting, an escaped type, and broken ones among good items."""
    return _items(C.hard_json(spark, sf_dir))


@query
def large_values(spark, sf_dir):
    """Texts of up to 24,000,000 characters, whole, beside the other properties and items of their pages."""
    items = m.items_table(m.audit_pages(C.large_pages(spark, sf_dir)))
    text = text_of(F.lit("description"), F.col("properties")["description"], F.col("overflow"))
    return items.select(
        "page_id", "item_ord", "schema_format", "schema_type", V.as_text(F.col("properties")["name"]).alias("name"),
        F.size("properties").cast("bigint").alias("n_properties"), F.char_length(text).cast("bigint").alias("n_chars"),
        F.md5(text).alias("text_md5"),
    )


@query
def microdata_items(spark, sf_dir):
    return _items(C.listings(spark, sf_dir))


@query
def microdata_properties(spark, sf_dir):
    return _properties(C.listings(spark, sf_dir))


@query
def rdfa_items(spark, sf_dir):
    return _items(C.profiles(spark, sf_dir))


@query
def rdfa_properties(spark, sf_dir):
    return _properties(C.profiles(spark, sf_dir))


@query
def rdfa_standalone(spark, sf_dir):
    return _properties(C.profiles(spark, sf_dir)).filter("schema_type = 'Unknown'")


@query
def all_items(spark, sf_dir):
    return _items(C.all_markup(spark, sf_dir))


@query
def element_counts(spark, sf_dir):
    document = read_document(F.col("html"), markup=True, links=True)
    return (
        C.real_pages(spark, sf_dir)
        .select("page_id", document.alias("document"))
        .select(
            "page_id",
            F.size("document.hrefs").cast("bigint").alias("n_anchors"),
            (F.size("document.nodes") + F.size("document.scripts")).cast("bigint").alias("n_markup"),
        )
    )


# --- rules --------------------------------------------------------------------------------------


@query
def rule_type_gate(spark, sf_dir):
    return _issues(
        C.all_markup(spark, sf_dir), "malformed_json_ld", "missing_schema_type", "empty_schema", "deprecated_type"
    )


@query
def rule_url_shape(spark, sf_dir):
    return _issues(C.all_markup(spark, sf_dir), "invalid_url")


@query
def rule_date_shape(spark, sf_dir):
    issues = _issues(C.all_markup(spark, sf_dir), "invalid_property_type")
    return issues.filter("schema_ref <> 'FAQPage'")


@query
def rule_rich_type(spark, sf_dir):
    return _issues(C.all_markup(spark, sf_dir), "unsupported_type")


@query
def rule_required(spark, sf_dir):
    return _issues(C.all_markup(spark, sf_dir), "missing_required_property").filter(
        F.col("severity") == "error"
    ).filter(~F.col("schema_ref").isin("FAQPage", "BreadcrumbList"))


@query
def rule_faq_breadcrumb(spark, sf_dir):
    return _issues(C.all_markup(spark, sf_dir), "missing_required_property", "invalid_property_type").filter(
        F.col("schema_ref").isin("FAQPage", "BreadcrumbList")
    )


@query
def rule_article_product(spark, sf_dir):
    return _issues(C.all_markup(spark, sf_dir), "missing_image", "missing_required_property").filter(
        F.col("severity") == "warning"
    )


@query
def rule_name(spark, sf_dir):
    return _issues(C.all_markup(spark, sf_dir), "missing_name")


@query
def issues_all(spark, sf_dir):
    return _issues(C.all_markup(spark, sf_dir))


@query
def issues_without_guidelines(spark, sf_dir):
    return _issues(C.all_markup(spark, sf_dir), google_guidelines=False)


@query
def page_issue_counts(spark, sf_dir):
    return m.page_counts(m.audit_pages(C.all_markup(spark, sf_dir), messages=False))


@query
def page_conflicts(spark, sf_dir):
    return _issues(C.all_markup(spark, sf_dir), "conflicting_schema")


# --- filters, gate, reports ---------------------------------------------------------------------


def _shape(results: DataFrame) -> DataFrame:
    return m.page_counts(results)


@query
def filter_severity(spark, sf_dir):
    return _shape(m.filter_pages(m.audit_pages(C.all_markup(spark, sf_dir), messages=False), severity="error"))


@query
def filter_severity_warning(spark, sf_dir):
    return _shape(m.filter_pages(m.audit_pages(C.all_markup(spark, sf_dir), messages=False), severity="warning"))


@query
def filter_type(spark, sf_dir):
    pages = C.markup_and_log(spark, sf_dir)
    return _shape(m.filter_pages(m.audit_pages(pages, messages=False), schema_types="Product, Organization"))


@query
def filter_none(spark, sf_dir):
    return _shape(m.filter_pages(m.audit_pages(C.listings(spark, sf_dir)), severity="", schema_types=""))


@query
def quality_gate(spark, sf_dir):
    return m.quality_gate(m.audit_pages(C.all_markup(spark, sf_dir), messages=False), "error", "Event,Offer")


@query
def summary(spark, sf_dir):
    pages = C.markup_and_log(spark, sf_dir)
    return m.summary(m.audit_pages(pages, "sitemap", messages=False))


@query
def summary_filtered(spark, sf_dir):
    """Counters of what a filter by severity and type leaves."""
    results = m.audit_pages(C.markup_and_log(spark, sf_dir), messages=False)
    return m.summary(m.filter_pages(results, severity="error", schema_types="Product, Organization"))


@query
def summary_tallies(spark, sf_dir):
    return tallies(m.audit_pages(C.all_markup(spark, sf_dir), messages=False)).select("kind", "name", "total_pages", "total_schemas")


@query
def plain_page_summary(spark, sf_dir):
    return m.summary(m.audit_pages(C.real_pages(spark, sf_dir)))


@query
def type_counts(spark, sf_dir):
    return m.type_counts(m.audit_pages(C.all_markup(spark, sf_dir)))


@query
def format_counts(spark, sf_dir):
    return m.format_counts(m.audit_pages(C.all_markup(spark, sf_dir)))


@query
def fetch_crawl_mode(spark, sf_dir):
    return m.audit_pages(C.fetch_log(spark, sf_dir), "crawl").select(
        "page_id", "url", "fetch_error", F.size("items").alias("n_items")
    )


@query
def fetch_sitemap_mode(spark, sf_dir):
    return m.audit_pages(C.fetch_log(spark, sf_dir), "sitemap").select(
        "page_id", "url", "fetch_error", F.size("items").alias("n_items")
    )


@query
def report_rows(spark, sf_dir):
    pages = C.markup_and_log(spark, sf_dir)
    return m.report_rows(m.audit_pages(pages, "sitemap")).drop("row_ord")


@query
def report_order(spark, sf_dir):
    """Report rows of product pages with their place within the page."""
    rows = m.report_rows(m.audit_pages(C.products(spark, sf_dir)))
    return rows.select("page_id", "row_ord", "severity", "issue_type", "schema_type")


@query
def issue_listing(spark, sf_dir):
    return m.issue_listing(m.audit_pages(C.fetch_log(spark, sf_dir), "sitemap"))


@query
def report_text(spark, sf_dir):
    return m.summary_lines(m.audit_pages(C.all_markup(spark, sf_dir), messages=False))


@query
def report_json(spark, sf_dir):
    """Page reports, read back from their JSON."""
    pages = m.page_json(m.audit_pages(C.products(spark, sf_dir), with_raw=True))
    shape = (
        "url string, structured_data array<struct<schema_type:string,source_url:string>>,"
        "errors array<struct<issue_type:string>>, warnings array<struct<issue_type:string>>, info array<struct<path:string>>"
    )
    report = pages.select("page_id", F.from_json("json", shape).alias("report"))
    return report.select(
        "page_id",
        "report.url",
        F.size("report.structured_data").alias("n_items"),
        F.array_join("report.structured_data.schema_type", "|").alias("schema_types"),
        F.array_join("report.errors.issue_type", "|").alias("errors"),
        F.array_join("report.warnings.issue_type", "|").alias("warnings"),
        F.size("report.info").alias("n_info"),
    )


# --- links, robots, sitemaps, crawl -------------------------------------------------------------


@query
def page_links(spark, sf_dir):
    return m.links_table(C.real_pages(spark, sf_dir))


@query
def graph_links(spark, sf_dir):
    return m.links_table(C.link_graph(spark, sf_dir), same_domain=False)


@query
def url_normalise(spark, sf_dir):
    pages = C.table(spark, sf_dir, "pages")
    return pages.select(normalise_url(F.col("url")).alias("url")).distinct()


@query
def url_host(spark, sf_dir):
    pages = C.table(spark, sf_dir, "pages")
    return pages.groupBy(netloc(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n_pages"))


@query
def url_path_suffix(spark, sf_dir):
    pages = C.table(spark, sf_dir, "pages")
    url = F.col("url")
    return pages.select("page_id", url_path(url).alias("path"), is_document_url(url).alias("is_document"))


@query
def robots_allowed(spark, sf_dir):
    urls = C.table(spark, sf_dir, "pages").select("page_id", "url")
    return m.robots_allowed(urls, C.host_robots(spark, sf_dir))


@query
def sitemap_urls(spark, sf_dir):
    return m.sitemap_urls(C.sitemap_documents(spark, sf_dir))


@query
def sitemap_pages(spark, sf_dir):
    results = m.crawl_sitemap(C.link_graph(spark, sf_dir), C.sitemap_documents(spark, sf_dir))
    return results.select(
        "page_id", "url", "fetch_error", "sitemap_url", "copy", F.size("items").alias("n_items")
    )


@query
def crawl_bfs(spark, sf_dir):
    """Everything reachable: the crawl ends when a level brings nothing new."""
    visited = m.crawl_frontier(C.link_graph(spark, sf_dir), C.GRAPH_START, max_pages=10**9, max_depth=30)
    return visited.select("url", "depth")


@query
def crawl_capped(spark, sf_dir):
    """The default page cap and depth."""
    visited = m.crawl_frontier(C.link_graph(spark, sf_dir), C.GRAPH_START)
    return visited.select("url", "depth")


@query
def crawl_report(spark, sf_dir):
    """Page results of a crawl that robots rules bind."""
    results = m.crawl_pages(
        C.link_graph(spark, sf_dir), C.GRAPH_START, max_pages=10**9, max_depth=30, robots=C.crawl_robots(spark)
    )
    return results.select("page_id", "url", "depth", F.size("items").alias("n_items"))


# --- streaming ----------------------------------------------------------------------------------


@query
def stream_issues(spark, sf_dir):
    """Issues of pages that hold a document as markup, audited as a stream until all files are taken in."""
    folder = scratch_folder(spark)
    # A pattern, since a stream takes no path of a single file: the table may be one, or a folder of them.
    stream = spark.readStream.schema("doc_id bigint, text string").parquet(f"{sf_dir}/{{documents}}.parquet")
    key = F.col("doc_id")
    kind = F.when(key % 3 == 0, "Article").when(key % 3 == 1, "Memo")
    json = F.to_json(F.struct(kind.alias("@type"), F.col("text").alias("name")))
    # "</" would end the script element; JSON may write the slash escaped.
    script = F.concat(
        F.lit('<script type="application/ld+json">'), F.replace(json, F.lit("</"), F.lit("<\\/")), F.lit("</script>")
    )
    pages = m.fetched_pages(
        stream.select(
            key.alias("page_id"),
            F.concat(F.lit("https://docs.example.com/"), key.cast("string")).alias("url"),
            script.alias("html"),
        )
    )
    running = m.audit_stream(
        pages, f"{folder}/issues", f"{folder}/progress", shape=m.issues_table, available_now=True
    )
    running.awaitTermination()
    issues = cut_lineage(spark.read.parquet(f"{folder}/issues").select(*ISSUE_COLUMNS))
    remove_folder(spark, folder)
    return issues


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product pages to issue counts."""
    return (
        m.issues_table(m.audit_pages(C.products(spark, sf_dir)))
        .groupBy("severity", "issue_type")
        .agg(F.count(F.lit(1)).alias("n_issues"))
        .orderBy("severity", "issue_type")
    )


@query
def issue_type_counts(spark, sf_dir):
    return flagship(spark, sf_dir)
