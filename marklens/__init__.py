"""Audit of structured page markup on Spark."""

from .operators.filters import filter_pages, quality_gate
from .operators.links import links_table
from .operators.robots import robots_allowed, robots_rules
from .plans.audit import audit_pages, issues_table, items_table, page_counts
from .plans.crawl import crawl_frontier, crawl_pages, crawl_sitemap
from .plans.report import (
    document_lines,
    format_counts,
    issue_listing,
    page_json,
    report_rows,
    summary,
    summary_lines,
    type_counts,
)
from .session import configure
from .sources.pages import fetched_pages
from .sources.sinks import write_csv, write_json_document, write_json_lines, write_text
from .sources.sitemaps import sitemap_urls
from .streaming.audit_stream import audit_stream, read_page_stream

__all__ = [
    "audit_pages",
    "audit_stream",
    "configure",
    "crawl_frontier",
    "crawl_pages",
    "crawl_sitemap",
    "document_lines",
    "fetched_pages",
    "filter_pages",
    "format_counts",
    "issue_listing",
    "issues_table",
    "items_table",
    "links_table",
    "page_counts",
    "page_json",
    "quality_gate",
    "read_page_stream",
    "report_rows",
    "robots_allowed",
    "robots_rules",
    "sitemap_urls",
    "summary",
    "summary_lines",
    "type_counts",
    "write_csv",
    "write_json_document",
    "write_json_lines",
    "write_text",
]
