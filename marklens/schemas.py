"""Spark types of the tables that flow through the engine."""

from __future__ import annotations

from .functions.overflow import OVERFLOW

# One fetched page per row. `page_id` is unique per row; a URL may occur in several rows.
FETCHED_PAGES = "page_id BIGINT, url STRING, status INT, content_type STRING, html STRING, fetch_error STRING"

# What one pass over a page's HTML keeps (see operators.elements).
SCRIPT = f"struct<pos:int,text:string,json:string,overflow:{OVERFLOW}>"
NODE = (
    "struct<pos:int,tag:string,attrs:map<string,string>,scope:int,typed:int,vocab:string,text:string>"
)
DOCUMENT = f"struct<error:string,scripts:array<{SCRIPT}>,nodes:array<{NODE}>,hrefs:array<string>>"

ITEM = (
    "struct<schema_format:string,schema_type:string,properties:map<string,variant>,"
    f"raw:variant,context:string,is_graph_item:boolean,overflow:{OVERFLOW}>"
)
ITEMS = f"array<{ITEM}>"

# item_ord is NULL for page-level issues; check_ord is the order in which the rules run.
ISSUE = (
    "struct<item_ord:int,check_ord:int,issue_type:string,severity:string,message:string,path:string,"
    "schema_ref:string>"
)
ISSUES = f"array<{ISSUE}>"
# Issues without messages: check_ord times 10, plus the rank of the severity.
CODES = "array<int>"

REPORT_COLUMNS = [
    "url", "severity", "issue_type", "message", "path", "schema_ref", "schema_type", "schema_format",
]
