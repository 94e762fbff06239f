"""Expected results as SQL over the given tables.

What each page must yield is stated per family and variant from the key alone. No SQL here reads HTML or JSON (but for
the links of the given pages), so a mistake in the reader or the rules cannot cancel out.
"""

from __future__ import annotations

from marklens import rules

ORACLES: dict[str, str] = {}


def _quoted(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


# family: table, key, number of variants, family number, URL prefix
FAMILIES = {
    "product": ("part", "p_partkey", 12, 0, "https://shop.example.com/product/"),
    "article": ("orders", "o_orderkey", 6, 1, "https://news.example.com/article/"),
    "typed": ("part", "p_partkey", 1, 2, "https://types.example.com/t/"),
    "listing": ("supplier", "s_suppkey", 6, 3, "https://dir.example.com/supplier/"),
    "profile": ("customer", "c_custkey", 5, 4, "https://id.example.com/c/"),
    "oddity": ("events", "event_id", 8, 5, "https://odd.example.com/e/"),
}
MARKUP = list(FAMILIES)
FAMILIES["hard"] = ("part", "p_partkey", 6, 8, "https://hard.example.com/p/")
LOG_URL = "'https://log.example.com/p/' || p_partkey"
LOG_RAW_URL = LOG_URL + " || CASE WHEN p_partkey % 2 = 0 THEN '/' ELSE '#top' END"
LOG_READ = "p_partkey % 50 NOT IN (0, 1, 2, 3, 4, 5)"
CTX = "'https://schema.org'"

# Items: family, variant, position, format, type (SQL), context (SQL), in a graph, number of properties.
ITEMS = [
    ("product", 0, 0, "json-ld", "'Product'", CTX, False, 3),
    ("product", 1, 0, "json-ld", "'Product'", CTX, False, 2),
    ("product", 2, 0, "json-ld", "'Product'", CTX, False, 2),
    ("product", 3, 0, "json-ld", "'MalformedJSON-LD'", "NULL", False, 0),
    ("product", 4, 0, "json-ld", "'Product'", CTX, True, 3),
    ("product", 4, 1, "json-ld", "'Organization'", CTX, True, 1),
    ("product", 5, 0, "json-ld", "'Product'", "NULL", False, 3),
    ("product", 5, 1, "json-ld", "'Product'", "NULL", False, 3),
    ("product", 6, 0, "json-ld", "'Product, Thing'", CTX, False, 1),
    ("product", 7, 0, "json-ld", "'Thing, Product'", CTX, False, 1),
    ("product", 8, 0, "json-ld", "'Product'", CTX, False, 4),
    ("product", 9, 0, "json-ld", "'MalformedJSON-LD'", "NULL", False, 0),
    ("product", 10, 0, "json-ld", "'Offer'", CTX, False, 2),
    ("article", 0, 0, "json-ld", "'Article'", CTX, False, 4),
    ("article", 1, 0, "json-ld", "'Article'", CTX, False, 4),
    ("article", 2, 0, "json-ld", "'NewsArticle'", CTX, False, 3),
    ("article", 3, 0, "json-ld", "'Event'", CTX, False, 2),
    ("article", 4, 0, "json-ld", "'FAQPage'", CTX, False, 1),
    ("article", 5, 0, "json-ld", "'BreadcrumbList'", CTX, False, 1),
    ("hard", 0, 0, "json-ld", "'Product'", "NULL", False, 3),
    ("hard", 1, 0, "json-ld", "'Product'", "NULL", False, 2),
    ("hard", 2, 0, "json-ld", "'Product'", "NULL", False, 1),
    ("hard", 2, 1, "json-ld", "'MalformedJSON-LD'", "NULL", False, 0),
    ("hard", 2, 2, "json-ld", "'Product'", "NULL", False, 2),
    ("hard", 2, 3, "microdata", "'Person'", "NULL", False, 1),
    ("hard", 3, 0, "json-ld", "'Product'", "NULL", False, 1),
    ("hard", 4, 0, "json-ld", "'Product'", "NULL", False, 2),
    ("hard", 5, 0, "json-ld", "'MalformedJSON-LD'", "NULL", False, 0),
    ("hard", 5, 1, "microdata", "'Person'", "NULL", False, 1),
    ("listing", 0, 0, "microdata", "'Organization'", "NULL", False, 2),
    ("listing", 1, 0, "microdata", "'Product'", "NULL", False, 3),
    ("listing", 1, 1, "microdata", "'Offer'", "NULL", False, 2),
    ("listing", 2, 0, "microdata", "'Product'", "NULL", False, 2),
    ("listing", 4, 0, "microdata", "'LocalBusiness, Store'", "NULL", False, 1),
    ("listing", 5, 0, "microdata", "'Organization'", "NULL", False, 3),
    ("profile", 0, 0, "rdfa", "'Person'", "'https://schema.org/'", False, 2),
    ("profile", 1, 0, "rdfa", "'Person'", "'https://schema.org/'", False, 2),
    ("profile", 1, 1, "rdfa", "'PostalAddress'", "'https://schema.org/'", False, 2),
    ("profile", 2, 0, "rdfa", "'Unknown'", "NULL", False, 2),
    ("profile", 3, 0, "rdfa", "'Unknown'", "NULL", False, 2),
    ("profile", 4, 0, "rdfa", "'Organization'", "NULL", False, 1),
    ("oddity", 0, 0, "json-ld", "'EntryRating'", CTX, False, 1),
    ("oddity", 1, 0, "json-ld", "'Unknown'", CTX, False, 2),
    ("oddity", 2, 0, "json-ld", "'WebPage'", CTX, False, 0),
    ("oddity", 3, 0, "json-ld", "'WebPage'", CTX, False, 2),
    ("oddity", 4, 0, "json-ld", "'WebSite'", CTX, False, 6),
    ("oddity", 5, 0, "json-ld", "'Dataset'", CTX, False, 6),
    ("oddity", 6, 0, "json-ld", "'Thing, WebPage'", CTX, False, 2),
    ("oddity", 7, 0, "json-ld", "'Custom-' || event_type", CTX, False, 1),
]


def _date_issue(kind: str, prop: str, value: str) -> tuple:
    message = f"'Property ''{prop}'' value ''' || {value} || ''' is not ISO 8601 format'"
    return "invalid_property_type", "warning", message, f"'{kind}.{prop}'", f"'{kind}'"


def _url_issue(kind: str, prop: str, value: str) -> tuple:
    message = f"'Property ''{prop}'' has invalid URL: ''' || {value} || ''''"
    return "invalid_url", "warning", message, f"'{kind}.{prop}'", f"'{kind}'"


def _required_issue(base: str, prop: str) -> tuple:
    message = _quoted(f"Google rich results require '{prop}' for {base}")
    return "missing_required_property", "error", message, f"'{base}.{prop}'", f"'{base}'"


def _name_issue(base: str) -> tuple:
    return (
        "missing_name", "warning", _quoted(f"Schema '{base}' should have a 'name' property"), f"'{base}.name'",
        f"'{base}'",
    )


def _image_issue(kind: str) -> tuple:
    return (
        "missing_image", "warning", _quoted(f"{kind} should have an 'image' property for rich results"),
        f"'{kind}.image'", f"'{kind}'",
    )


def _unsupported_issue(kind: str) -> tuple:
    message = f"'Schema type ''' || {kind} || ''' is not a recognized Google rich result type'"
    return "unsupported_type", "info", message, "NULL", kind


_OFFERS = (
    "missing_required_property", "warning", _quoted("Product should have 'offers' or 'price' for rich results"),
    "'Product.offers'", "'Product'",
)
_MALFORMED = (
    "malformed_json_ld", "error", "'JSON-LD block contains invalid JSON'", "NULL", "'MalformedJSON-LD'",
)
_UNTYPED = ("missing_schema_type", "warning", "'Structured data has no @type defined'", "NULL", "NULL")
_FAQ_ABSENT = (
    "missing_required_property", "error", _quoted("FAQPage requires 'mainEntity' with Question/Answer pairs"),
    "'FAQPage.mainEntity'", "'FAQPage'",
)
_FAQ_ENTRY = (
    "invalid_property_type", "warning", _quoted("FAQPage.mainEntity[0] should be of type 'Question'"),
    "'FAQPage.mainEntity[0]'", "'FAQPage'",
)
_BREADCRUMB = (
    "missing_required_property", "error", _quoted("BreadcrumbList requires 'itemListElement'"),
    "'BreadcrumbList.itemListElement'", "'BreadcrumbList'",
)
_DAY = "strftime(o_orderdate, '%Y-%m-%d')"

# Issues: family, variant, item position (None: page level), (type, severity, message, path, reference) as SQL.
ISSUES = [
    ("product", 1, 0, _image_issue("Product")),
    ("product", 2, 0, _required_issue("Product", "name")),
    ("product", 2, 0, _name_issue("Product")),
    ("product", 3, 0, _MALFORMED),
    (
        "product", 5, None,
        (
            "conflicting_schema", "warning",
            _quoted("Multiple 'Product' schemas found (2 instances) — may cause confusion"), "NULL", "'Product'",
        ),
    ),
    ("product", 6, 0, _image_issue("Product")),
    ("product", 6, 0, _OFFERS),
    ("product", 8, 0, _url_issue("Product", "url", "'not-a-url'")),
    ("product", 9, 0, _MALFORMED),
    ("product", 10, 0, _required_issue("Offer", "price")),
    ("article", 0, 0, _name_issue("Article")),
    ("article", 1, 0, _date_issue("Article", "datePublished", "strftime(o_orderdate, '%-d %B %Y')")),
    ("article", 1, 0, _name_issue("Article")),
    ("article", 2, 0, _date_issue("NewsArticle", "datePublished", f"{_DAY} || 'T08:30:00.123Z'")),
    ("article", 2, 0, _required_issue("NewsArticle", "image")),
    ("article", 2, 0, _image_issue("NewsArticle")),
    ("article", 2, 0, _name_issue("NewsArticle")),
    ("article", 3, 0, _required_issue("Event", "location")),
    ("article", 4, 0, _FAQ_ENTRY),
    ("article", 4, 0, _name_issue("FAQPage")),
    ("article", 5, 0, _BREADCRUMB),
    ("article", 5, 0, _name_issue("BreadcrumbList")),
    ("listing", 1, 1, _name_issue("Offer")),
    ("listing", 2, 0, _image_issue("Product")),
    ("listing", 2, 0, _OFFERS),
    ("listing", 4, 0, _required_issue("LocalBusiness", "address")),
    ("profile", 1, 1, _unsupported_issue("'PostalAddress'")),
    ("profile", 2, 0, _UNTYPED),
    ("profile", 3, 0, _UNTYPED),
    (
        "oddity", 0, 0,
        ("deprecated_type", "warning", _quoted("Schema type 'EntryRating' is deprecated"), "NULL", "'EntryRating'"),
    ),
    ("oddity", 0, 0, _unsupported_issue("'EntryRating'")),
    ("oddity", 1, 0, _UNTYPED),
    (
        "oddity", 2, 0,
        ("empty_schema", "warning", _quoted("Schema 'WebPage' has no properties"), "NULL", "'WebPage'"),
    ),
    ("oddity", 2, 0, _name_issue("WebPage")),
    ("oddity", 3, 0, _url_issue("WebPage", "url", "'https://' || event_type || '.photography/x'")),
    ("oddity", 4, 0, _url_issue("WebSite", "Image", "'https://example.com#x'")),
    ("oddity", 5, 0, _date_issue("Dataset", "dateCreated", "strftime(ts, '%Y')")),
    ("oddity", 5, 0, _date_issue("Dataset", "startDate", "strftime(ts, '%Y-%m-%d %H:%M')")),
    ("oddity", 7, 0, _unsupported_issue("'Custom-' || event_type")),
]

_TYPES = list(rules.REQUIRED_PROPERTIES.items())
# One row per type: number, name, count of required properties; and one per required property.
_TYPE_ROWS = ", ".join(f"({t}, '{name}', {len(props)})" for t, (name, props) in enumerate(_TYPES))
_PROP_ROWS = ", ".join(
    f"({t}, {i}, '{prop}')" for t, (_, props) in enumerate(_TYPES) for i, prop in enumerate(props)
)
_TYPED_PAGES = f"""(
    SELECT p_partkey, kind, p_size % 4 AS dropped, n - CASE WHEN p_size % 4 < n THEN 1 ELSE 0 END AS n_kept,
           EXISTS (SELECT 1 FROM (VALUES {_PROP_ROWS}) pr(pt, i, prop)
                   WHERE pt = t AND prop = 'name' AND i <> p_size % 4) AS has_name,
           EXISTS (SELECT 1 FROM (VALUES {_PROP_ROWS}) pr(pt, i, prop)
                   WHERE pt = t AND prop = 'image' AND i <> p_size % 4) AS has_image, t
    FROM part JOIN (VALUES {_TYPE_ROWS}) ty(t, kind, n) ON p_partkey % {len(_TYPES)} = t)"""


def _page_columns(family: str) -> tuple[str, str]:
    _, key, _, number, prefix = FAMILIES[family]
    return f"CAST({key} * 10 + {number} AS BIGINT)", f"'{prefix}' || {key}"


def _sources(family: str, log_url: str) -> tuple[str, int, str, str, str, str]:
    """Variant family, modulus, FROM, page id, URL and condition; `log` is the fetch log of product pages."""
    if family == "log":
        return "product", 12, "part", "CAST(p_partkey * 10 + 6 AS BIGINT)", log_url, LOG_READ
    table, _, modulus, _, _ = FAMILIES[family]
    return family, modulus, table, *_page_columns(family), "TRUE"


def pages_sql(families: list[str], log_url: str = LOG_URL, log_mode: str = "crawl") -> str:
    """`page_id`, `url`, `fetch_error` of all pages that are reported on."""
    parts = []
    for family in families:
        if family == "log":
            bad = "p_partkey % 50 IN (0, 3) OR " if log_mode == "sitemap" else ""
            parts.append(
                f"""SELECT CAST(p_partkey * 10 + 6 AS BIGINT) AS page_id, {log_url} AS url,
                CASE p_partkey % 50 WHEN 0 THEN 'HTTP 404' WHEN 3 THEN 'HTTP 500'
                     WHEN 2 THEN 'Timeout after ' || p_partkey END AS fetch_error
                FROM part WHERE {bad}p_partkey % 50 = 2 OR {LOG_READ}"""
            )
        else:
            page_id, url = _page_columns(family)
            parts.append(f"SELECT {page_id} AS page_id, {url} AS url, NULL AS fetch_error FROM {FAMILIES[family][0]}")
    return "\nUNION ALL\n".join(parts)


def items_sql(families: list[str], log_url: str = LOG_URL) -> str:
    parts = []
    for family in families:
        variants, modulus, source, page_id, url, condition = _sources(family, log_url)
        key = FAMILIES[variants][1]
        for owner, variant, order, fmt, kind, context, in_graph, n in ITEMS:
            if owner == variants:
                parts.append(
                    f"""SELECT {page_id} AS page_id, {url} AS url, CAST({order} AS INTEGER) AS item_ord,
                    '{fmt}' AS schema_format, {kind} AS schema_type, {context} AS context,
                    {str(in_graph).upper()} AS is_graph_item, CAST({n} AS INTEGER) AS n_properties
                    FROM {source} WHERE {key} % {modulus} = {variant} AND {condition}"""
                )
        if family == "typed":
            parts.append(
                f"""SELECT {page_id}, {url}, CAST(0 AS INTEGER), 'json-ld', kind, NULL, FALSE, CAST(n_kept AS INTEGER)
                FROM {_TYPED_PAGES} typed"""
            )
    return "\nUNION ALL\n".join(parts)


def _typed_issues(page_id: str, url: str) -> list[str]:
    """Issues of the family in which each type lacks one required property."""
    exempt = ", ".join(map(_quoted, rules.NAME_EXEMPT_TYPES))

    def some(kind: str, severity: str, message: str, path: str, condition: str) -> str:
        return f"""SELECT {page_id}, {url}, CAST(0 AS INTEGER), '{kind}', '{severity}', {message}, {path}, kind, 0
        FROM {_TYPED_PAGES} typed WHERE {condition}"""

    image = "kind || ' should have an ''image'' property for rich results'"
    return [
        some("empty_schema", "warning", "'Schema ''' || kind || ''' has no properties'", "NULL", "n_kept = 0"),
        f"""SELECT {page_id}, {url}, CAST(0 AS INTEGER), 'missing_required_property', 'error',
        'Google rich results require ''' || prop || ''' for ' || kind, kind || '.' || prop, kind, 0
        FROM {_TYPED_PAGES} typed JOIN (VALUES {_PROP_ROWS}) pr(pt, i, prop) ON pt = t AND i = dropped""",
        some("missing_required_property", "error", _FAQ_ABSENT[2], _FAQ_ABSENT[3], "kind = 'FAQPage'"),
        some("missing_required_property", "error", _BREADCRUMB[2], _BREADCRUMB[3], "kind = 'BreadcrumbList'"),
        some(
            "missing_image", "warning", image, "kind || '.image'",
            "kind IN ('Article', 'NewsArticle', 'BlogPosting', 'Product') AND NOT has_image",
        ),
        some("missing_required_property", "warning", _OFFERS[2], _OFFERS[3], "kind = 'Product'"),
        some(
            "missing_name", "warning", "'Schema ''' || kind || ''' should have a ''name'' property'",
            "kind || '.name'", f"NOT has_name AND kind NOT IN ({exempt})",
        ),
    ]


def issues_sql(families: list[str], log_url: str = LOG_URL) -> str:
    parts = []
    for family in families:
        variants, modulus, source, page_id, url, condition = _sources(family, log_url)
        key = FAMILIES[variants][1]
        for seq, (owner, variant, order, (kind, severity, message, path, ref)) in enumerate(ISSUES):
            if owner == variants:
                at = "NULL" if order is None else str(order)
                parts.append(
                    f"""SELECT {page_id} AS page_id, {url} AS url, CAST({at} AS INTEGER) AS item_ord,
                    '{kind}' AS issue_type, '{severity}' AS severity, {message} AS message, {path} AS path,
                    {ref} AS schema_ref, {seq} AS seq
                    FROM {source} WHERE {key} % {modulus} = {variant} AND {condition}"""
                )
        if family == "typed":
            parts += _typed_issues(page_id, url)
    return "\nUNION ALL\n".join(parts)


def _with(families: list[str], select: str, log_url: str = LOG_URL, log_mode: str = "crawl") -> str:
    return f"""WITH pages_all AS ({pages_sql(families, log_url, log_mode)}),
    items AS ({items_sql(families, log_url)}),
    issues AS ({issues_sql(families, log_url)})
    {select}"""


ITEM_COLUMNS = "page_id, url, item_ord, schema_format, schema_type, context, is_graph_item, n_properties"
ISSUE_COLUMNS = "page_id, url, item_ord, issue_type, severity, message, path, schema_ref"


def _items(families: list[str], where: str = "TRUE") -> str:
    return f"WITH items AS ({items_sql(families)}) SELECT {ITEM_COLUMNS} FROM items WHERE {where}"


def _issues(families: list[str], where: str = "TRUE") -> str:
    return f"WITH issues AS ({issues_sql(families)}) SELECT {ISSUE_COLUMNS} FROM issues WHERE {where}"


# --- extraction ---------------------------------------------------------------------------------

ORACLES["jsonld_items"] = _items(["product", "article", "oddity"])
ORACLES["jsonld_graph_context"] = _items(["product"], "is_graph_item")
ORACLES["jsonld_hard_blocks"] = _items(["hard"])
ORACLES["large_values"] = """
WITH pages AS (
  SELECT CAST(r_regionkey * 10 + 9 AS BIGINT) AS page_id, r_regionkey % 3 AS variant, r_name,
    repeat(r_name || ' ', CAST(ceil([17000000, 20000000, 24000000][1 + r_regionkey % 3] / (length(r_name) + 1.0)) AS BIGINT)) || 'end' AS text
  FROM region
)
SELECT page_id, CAST(0 AS INTEGER) AS item_ord, ['json-ld', 'microdata', 'rdfa'][1 + variant] AS schema_format,
  'Article' AS schema_type, r_name AS name, CAST(2 AS BIGINT) AS n_properties, CAST(length(text) AS BIGINT) AS n_chars, md5(text) AS text_md5
FROM pages
UNION ALL
SELECT page_id, 1, 'json-ld', 'Person', 'x', 1, NULL, NULL FROM pages WHERE variant = 0
"""
ORACLES["microdata_items"] = _items(["listing"])
ORACLES["rdfa_items"] = _items(["profile"])
ORACLES["all_items"] = _items(MARKUP)


def _property_rows(family: str, rows: list[tuple]) -> str:
    """`rows`: variant, item position, type, property, value position, value (SQL)."""
    table, key, modulus, number, _ = FAMILIES[family]
    return "\nUNION ALL\n".join(
        f"""SELECT CAST({key} * 10 + {number} AS BIGINT) AS page_id, CAST({order} AS INTEGER) AS item_ord,
        '{kind}' AS schema_type, '{prop}' AS name, CAST({at} AS INTEGER) AS value_ord, {value} AS value
        FROM {table} WHERE {key} % {modulus} = {variant}"""
        for variant, order, kind, prop, at, value in rows
    )


_IMAGE = "'https://img.example.com/' || p_partkey || '.jpg'"
ORACLES["jsonld_text_properties"] = _property_rows(
    "product",
    [
        (variant, order, "Product", prop, 0, value)
        for variant, order in [(0, 0), (4, 0), (5, 0), (5, 1), (8, 0)]
        for prop, value in [("name", "p_name"), ("image", _IMAGE)]
    ]
    + [
        (1, 0, "Product", "name", 0, "p_name"),
        (2, 0, "Product", "price", 0, "'9.5'"),
        (2, 0, "Product", "image", 0, _IMAGE),
        (4, 1, "Organization", "name", 0, "p_brand"),
        (6, 0, "Product, Thing", "name", 0, "p_name"),
        (7, 0, "Thing, Product", "description", 0, "p_name"),
        (8, 0, "Product", "url", 0, "'not-a-url'"),
        (10, 0, "Offer", "name", 0, "p_name"),
        (10, 0, "Offer", "priceCurrency", 0, "'EUR'"),
    ],
)

_FULL_JSON = (
    """'{"@type":"Product","name":"' || p_name || '","image":"' || """ + _IMAGE
    + """ || '","offers":{"@type":"Offer","price":"9.5","priceCurrency":"EUR"}}'"""
)
ORACLES["jsonld_raw"] = f"""WITH items AS ({items_sql(["product"])})
SELECT page_id, item_ord, schema_type <> 'MalformedJSON-LD' AS is_object,
       CASE p_partkey % 12 WHEN 3 THEN '{{"@type": "Product", "name": ' WHEN 9 THEN {_FULL_JSON} || ' trailing' END AS text,
       CASE WHEN p_partkey % 12 IN (2, 3, 7, 9) THEN NULL WHEN schema_type = 'Organization' THEN p_brand
            ELSE p_name END AS name
FROM items JOIN part ON page_id = p_partkey * 10"""

_CENTS = "CAST(CAST(round(s_acctbal * 100) AS BIGINT) AS VARCHAR)"
ORACLES["microdata_properties"] = _property_rows(
    "listing",
    [
        (0, 0, "Organization", "name", 0, "s_name"),
        (0, 0, "Organization", "url", 0, "'https://dir.example.com/' || s_suppkey"),
        (1, 0, "Product", "name", 0, "s_name"),
        (1, 0, "Product", "image", 0, "'https://img.example.com/' || s_suppkey || '.png'"),
        (1, 0, "Product", "offers", 0, "'EUR'"),
        (1, 1, "Offer", "price", 0, _CENTS),
        (1, 1, "Offer", "priceCurrency", 0, "'EUR'"),
        (2, 0, "Product", "name", 0, "s_name"),
        (2, 0, "Product", "brand", 0, "'Brand' || s_suppkey"),
        (4, 0, "LocalBusiness, Store", "name", 0, "s_name"),
        (5, 0, "Organization", "name", 0, "s_name"),
        (5, 0, "Organization", "telephone", 0, "CAST(s_suppkey AS VARCHAR)"),
        (5, 0, "Organization", "telephone", 1, f"{_CENTS} || 'long ago'"),
        (5, 0, "Organization", "foundingDate", 0, "'2001-02-03'"),
    ],
)

_STANDALONE = [
    (2, 0, "Unknown", "name", 0, "c_name"),
    (2, 0, "Unknown", "area", 0, "'N' || c_nationkey"),
    (3, 0, "Unknown", "og:title", 0, "c_name"),
    (3, 0, "Unknown", "og:site_name", 0, "'N' || c_nationkey"),
]
ORACLES["rdfa_standalone"] = _property_rows("profile", _STANDALONE)
ORACLES["rdfa_properties"] = _property_rows(
    "profile",
    [
        (0, 0, "Person", "name", 0, "c_name"),
        (0, 0, "Person", "url", 0, "'https://id.example.com/' || c_custkey"),
        (1, 0, "Person", "name", 0, "c_name"),
        (1, 0, "Person", "address", 0, "'N' || c_nationkey"),
        (1, 1, "PostalAddress", "address", 0, "'N' || c_nationkey"),
        (1, 1, "PostalAddress", "addressLocality", 0, "'N' || c_nationkey"),
        (4, 0, "Organization", "name", 0, "c_name"),
        *_STANDALONE,
    ],
)

ORACLES["element_counts"] = """
SELECT page_id, CAST(len(regexp_extract_all(html, '<a href="')) AS BIGINT) AS n_anchors, CAST(0 AS BIGINT) AS n_markup
FROM pages"""

# --- rules --------------------------------------------------------------------------------------

ORACLES["rule_type_gate"] = _issues(
    MARKUP, "issue_type IN ('malformed_json_ld', 'missing_schema_type', 'empty_schema', 'deprecated_type')"
)
ORACLES["rule_url_shape"] = _issues(MARKUP, "issue_type = 'invalid_url'")
_DATE_RULE = "issue_type = 'invalid_property_type' AND schema_ref <> 'FAQPage'"
ORACLES["rule_date_shape"] = _issues(MARKUP, _DATE_RULE)
ORACLES["rule_rich_type"] = _issues(MARKUP, "issue_type = 'unsupported_type'")
ORACLES["rule_required"] = _issues(
    MARKUP,
    "issue_type = 'missing_required_property' AND severity = 'error' AND schema_ref NOT IN ('FAQPage', 'BreadcrumbList')",
)
ORACLES["rule_faq_breadcrumb"] = _issues(
    MARKUP,
    "issue_type IN ('missing_required_property', 'invalid_property_type') "
    "AND schema_ref IN ('FAQPage', 'BreadcrumbList')",
)
ORACLES["rule_article_product"] = _issues(
    MARKUP, "issue_type IN ('missing_image', 'missing_required_property') AND severity = 'warning'"
)
ORACLES["rule_name"] = _issues(MARKUP, "issue_type = 'missing_name'")
ORACLES["issues_all"] = _issues(MARKUP)
ORACLES["issues_without_guidelines"] = _issues(
    MARKUP,
    "issue_type IN ('malformed_json_ld', 'missing_schema_type', 'empty_schema', 'deprecated_type', 'invalid_url', "
    f"'conflicting_schema') OR ({_DATE_RULE})",
)
ORACLES["page_conflicts"] = _issues(MARKUP, "issue_type = 'conflicting_schema'")
ORACLES["issue_type_counts"] = f"""WITH issues AS ({issues_sql(["product"])})
SELECT severity, issue_type, CAST(count(*) AS BIGINT) AS n_issues FROM issues GROUP BY severity, issue_type"""

# --- pages, filters, gate -----------------------------------------------------------------------

_PAGE_COUNTS = """page_counts AS (
    SELECT page_id, url, fetch_error, coalesce(n_items, 0) AS n_items, coalesce(n_errors, 0) AS n_errors,
           coalesce(n_warnings, 0) AS n_warnings, coalesce(n_info, 0) AS n_info
    FROM pages_all
    LEFT JOIN (SELECT page_id, count(*) AS n_items FROM items GROUP BY page_id) USING (page_id)
    LEFT JOIN (SELECT page_id, count(*) FILTER (severity = 'error') AS n_errors,
                      count(*) FILTER (severity = 'warning') AS n_warnings,
                      count(*) FILTER (severity = 'info') AS n_info FROM issues GROUP BY page_id) USING (page_id))"""


def _counts(
    families: list[str], errors: str = "n_errors", warnings: str = "n_warnings", info: str = "n_info",
    where: str = "TRUE",
) -> str:
    select = f""", {_PAGE_COUNTS},
    kept AS (SELECT page_id, url, n_items, {errors} AS e, {warnings} AS w, {info} AS i FROM page_counts)
    SELECT page_id, url, CAST(n_items AS BIGINT) AS n_items, CAST(e AS BIGINT) AS n_errors,
           CAST(w AS BIGINT) AS n_warnings, CAST(i AS BIGINT) AS n_info, CAST(e + w + i AS BIGINT) AS total_issues,
           e > 0 AS has_errors
    FROM kept WHERE {where}"""
    return _with(families, select)


def _of_type(*kinds: str) -> str:
    return f"page_id IN (SELECT page_id FROM items WHERE schema_type IN ({', '.join(map(_quoted, kinds))}))"


ORACLES["page_issue_counts"] = _counts(MARKUP)
ORACLES["filter_severity"] = _counts(MARKUP, warnings="0", info="0", where="e > 0")
ORACLES["filter_severity_warning"] = _counts(MARKUP, info="0", where="e + w > 0")
ORACLES["filter_type"] = _counts(
    [*MARKUP, "log"], where="e + w + i > 0 AND " + _of_type("Product", "Organization")
)
ORACLES["filter_none"] = _counts(["listing"])
ORACLES["quality_gate"] = _with(
    MARKUP,
    f""", {_PAGE_COUNTS},
    counted AS (SELECT count(*) AS pages, count(*) FILTER (n_errors > 0 AND {_of_type("Event", "Offer")}) AS failing
                FROM page_counts)
    SELECT CAST(pages AS BIGINT) AS pages, CAST(failing AS BIGINT) AS failing_pages,
           CAST(CASE WHEN pages = 0 THEN 2 WHEN failing > 0 THEN 1 ELSE 0 END AS INTEGER) AS gate
    FROM counted""",
)

# --- reports ------------------------------------------------------------------------------------

_SUMMARY = """SELECT CAST(count(*) AS BIGINT) AS total_pages,
       CAST(count(*) FILTER (n_items > 0) AS BIGINT) AS pages_with_schema,
       CAST(count(*) FILTER (n_items = 0) AS BIGINT) AS pages_without_schema,
       CAST(count(*) FILTER (n_errors > 0) AS BIGINT) AS pages_with_errors,
       CAST(sum(n_items) AS BIGINT) AS total_schemas, CAST(sum(n_errors) AS BIGINT) AS total_errors,
       CAST(sum(n_warnings) AS BIGINT) AS total_warnings, CAST(sum(n_info) AS BIGINT) AS total_info,
       CASE WHEN count(*) = 0 THEN 0.0 ELSE (passing * 1000 // count(*) + CASE
         WHEN 2 * (passing * 1000 % count(*)) > count(*) THEN 1
         WHEN 2 * (passing * 1000 % count(*)) = count(*) THEN passing * 1000 // count(*) % 2
         ELSE 0 END) / 10.0 END AS pass_rate
FROM page_counts"""
# Whole tenths of a per cent by integer division, a tie to the even one.
_SUMMARY = _SUMMARY.replace("passing", "(count(*) FILTER (n_errors = 0))")

ORACLES["summary"] = _with([*MARKUP, "log"], f", {_PAGE_COUNTS} {_SUMMARY}", LOG_RAW_URL, "sitemap")
ORACLES["summary_filtered"] = _with(
    [*MARKUP, "log"],
    f""", {_PAGE_COUNTS.replace("page_counts", "all_counts")},
    page_counts AS (SELECT page_id, url, n_items, n_errors, 0 AS n_warnings, 0 AS n_info FROM all_counts
                    WHERE n_errors > 0 AND {_of_type("Product", "Organization")}) {_SUMMARY}""",
)
ORACLES["summary_tallies"] = _with(
    MARKUP,
    """SELECT 'pages' AS kind, '' AS name, CAST((SELECT count(*) FROM pages_all) AS BIGINT) AS total_pages,
              CAST((SELECT count(*) FROM items) AS BIGINT) AS total_schemas
    UNION ALL SELECT 'type', schema_type, 0, count(*) FROM items GROUP BY schema_type
    UNION ALL SELECT 'format', schema_format, 0, count(*) FROM items GROUP BY schema_format""",
)
ORACLES["plain_page_summary"] = """
SELECT CAST(count(*) AS BIGINT) AS total_pages, CAST(0 AS BIGINT) AS pages_with_schema,
       CAST(count(*) AS BIGINT) AS pages_without_schema, CAST(0 AS BIGINT) AS pages_with_errors,
       CAST(0 AS BIGINT) AS total_schemas, CAST(0 AS BIGINT) AS total_errors, CAST(0 AS BIGINT) AS total_warnings,
       CAST(0 AS BIGINT) AS total_info, CAST(100.0 AS DOUBLE) AS pass_rate
FROM pages"""
# The least (page, item) of a group; no page has a million items.
_FIRST = "min(page_id * 1000000 + item_ord)"
_FIRST_SEEN = f"CAST({_FIRST} // 1000000 AS BIGINT) AS first_page, CAST({_FIRST} % 1000000 AS INTEGER) AS first_item"
ORACLES["type_counts"] = f"""WITH items AS ({items_sql(MARKUP)})
SELECT schema_type, CAST(count(*) AS BIGINT) AS n_items, {_FIRST_SEEN} FROM items GROUP BY schema_type"""
ORACLES["format_counts"] = f"""WITH items AS ({items_sql(MARKUP)})
SELECT schema_format, CAST(count(*) AS BIGINT) AS n_items, {_FIRST_SEEN} FROM items GROUP BY schema_format"""

_FETCHED = """SELECT page_id, pages_all.url, fetch_error, CAST(coalesce(n, 0) AS INTEGER) AS n_items
FROM pages_all LEFT JOIN (SELECT page_id, count(*) AS n FROM items GROUP BY page_id) USING (page_id)"""
ORACLES["fetch_crawl_mode"] = _with(["log"], _FETCHED)
ORACLES["fetch_sitemap_mode"] = _with(["log"], _FETCHED, LOG_RAW_URL, "sitemap")

_REPORT_ROWS = """SELECT page_id, url, 'error' AS severity, 'fetch_error' AS issue_type, fetch_error AS message,
       '' AS path, '' AS schema_ref, '' AS schema_type, '' AS schema_format
FROM pages_all WHERE fetch_error IS NOT NULL
UNION ALL
SELECT page_id, url, severity, issue_type, message, coalesce(path, ''), coalesce(schema_ref, ''), '', '' FROM issues
UNION ALL
SELECT page_id, url, 'schema_found', '', 'Found ' || schema_type || ' (' || schema_format || ')', '', '', schema_type,
       schema_format
FROM items"""
ORACLES["report_rows"] = _with([*MARKUP, "log"], _REPORT_ROWS, LOG_RAW_URL, "sitemap")
ORACLES["report_order"] = _with(
    ["product"],
    """, rows AS (
        SELECT page_id, CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END AS section, item_ord, seq,
               severity, issue_type, '' AS schema_type FROM issues
        UNION ALL SELECT page_id, 3, item_ord, 0, 'schema_found', '', schema_type FROM items)
    SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY section, item_ord NULLS LAST, seq) - 1
                         AS INTEGER) AS row_ord, severity, issue_type, schema_type FROM rows""",
)
ORACLES["issue_listing"] = _with(
    ["log"],
    """SELECT substr(url, 1, 50) AS url, 'ERROR' AS severity, 'fetch_error' AS issue_type, fetch_error AS message
    FROM pages_all WHERE fetch_error IS NOT NULL
    UNION ALL SELECT substr(url, 1, 50), upper(severity), issue_type, message FROM issues""",
    LOG_RAW_URL,
    "sitemap",
)

_FIXED_LINES = [
    "'═══ Structured Data Validation Report ═══'",
    "''",
    "'  Pages crawled:        ' || total_pages",
    "'  Pages with schema:    ' || pages_with_schema",
    "'  Pages without schema: ' || pages_without_schema",
    "'  Pages with errors:    ' || pages_with_errors",
    "'  Pass rate:            ' || pass_rate || '%'",
    "''",
    "'  Total schemas found:  ' || total_schemas",
    "'  Total errors:         ' || total_errors",
    "'  Total warnings:       ' || total_warnings",
    "'  Total info:           ' || total_info",
]
_TEXT_PARTS = [
    f"SELECT CAST(0 AS INTEGER) AS section, CAST({at} AS BIGINT) AS ord, CAST(0 AS BIGINT) AS first_page, "
    f"CAST(0 AS INTEGER) AS first_item, '' AS name, {line} AS line FROM totals"
    for at, line in enumerate(_FIXED_LINES)
]
for _section, (_title, _column) in enumerate(
    [("  Schema Types:", "schema_type"), ("  Formats:", "schema_format")], start=1
):
    _TEXT_PARTS += [
        f"SELECT {_section}, CAST({-(2**62)} AS BIGINT), 0, 0, '', '' FROM totals",
        f"SELECT {_section}, CAST({-(2**62) + 1} AS BIGINT), 0, 0, '', '{_title}' FROM totals",
        f"SELECT {_section}, -count(*), {_FIRST_SEEN}, {_column}, '    ' || {_column} || ': ' || count(*) FROM items GROUP BY {_column}",
    ]
ORACLES["report_text"] = _with(
    MARKUP, f", {_PAGE_COUNTS}, totals AS ({_SUMMARY}) " + "\nUNION ALL\n".join(_TEXT_PARTS)
)

ORACLES["report_json"] = _with(
    ["product"],
    """SELECT page_id, url, CAST(coalesce(n, 0) AS INTEGER) AS n_items, coalesce(kinds, '') AS schema_types,
           coalesce(errors, '') AS errors, coalesce(warnings, '') AS warnings, CAST(0 AS INTEGER) AS n_info
    FROM pages_all
    LEFT JOIN (SELECT page_id, count(*) AS n, string_agg(schema_type, '|' ORDER BY item_ord) AS kinds
               FROM items GROUP BY page_id) USING (page_id)
    LEFT JOIN (SELECT page_id,
                      string_agg(issue_type, '|' ORDER BY seq) FILTER (severity = 'error') AS errors,
                      string_agg(issue_type, '|' ORDER BY seq) FILTER (severity = 'warning') AS warnings
               FROM issues GROUP BY page_id) USING (page_id)""",
)

# --- links, robots, sitemaps, crawl -------------------------------------------------------------

_SUFFIX = r"'\.(" + "|".join(rules.SKIPPED_EXTENSIONS) + ")$'"
# Every link in the given pages is a path from the root.
ORACLES["page_links"] = f"""
WITH hrefs AS (
    SELECT page_id, rtrim(split_part(url, '#', 1), '/') AS src, regexp_extract(url, '^[a-z]+://[^/?#]*') AS origin,
           unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href,
           generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) - 1 AS pos
    FROM pages)
SELECT page_id, src, CAST(pos AS INTEGER) AS link_pos, origin || split_part(href, '#', 1) AS dst
FROM hrefs WHERE NOT regexp_matches(lower(split_part(split_part(href, '#', 1), '?', 1)), {_SUFFIX})"""

_GRAPH = "'https://graph.example.com/c/'"
ORACLES["graph_links"] = f"""
WITH found AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 17 <> 5)
SELECT CAST(k * 10 + 7 AS BIGINT) AS page_id, {_GRAPH} || k AS src, CAST(n - 1 AS INTEGER) AS link_pos,
       {_GRAPH} || (k * 10 + n) || CASE WHEN n % 5 = 3 THEN '/' ELSE '' END AS dst
FROM found CROSS JOIN range(1, 11) r(n)
UNION ALL SELECT CAST(k * 10 + 7 AS BIGINT), {_GRAPH} || k, 11, {_GRAPH} || '0' FROM found
UNION ALL SELECT CAST(k * 10 + 7 AS BIGINT), {_GRAPH} || k, 12, 'https://other.example.com/' FROM found"""

ORACLES["url_normalise"] = "SELECT DISTINCT rtrim(split_part(url, '#', 1), '/') AS url FROM pages"
ORACLES["url_host"] = """
SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, CAST(count(*) AS BIGINT) AS n_pages
FROM pages GROUP BY 1"""
ORACLES["url_path_suffix"] = f"""
WITH paths AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT page_id, path, NOT regexp_matches(lower(path), {_SUFFIX}) AS is_document FROM paths"""

ORACLES["robots_allowed"] = """
WITH parts AS (
    SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host,
           regexp_extract(url, '^[a-z]+://[^/?#]*(.*)$', 1) AS local FROM pages)
SELECT page_id, url,
       CASE length(host) % 3 WHEN 0 THEN starts_with(local, '/en/1') OR NOT starts_with(local, '/en/')
                             WHEN 1 THEN NOT starts_with(local, '/fr/') ELSE TRUE END AS allowed
FROM parts"""

_LISTED = """leaves AS (
    SELECT s_suppkey AS s, n AS pos, 'https://graph.example.com/c/' || (s_suppkey * 5 + CASE n WHEN 5 THEN 0 ELSE n END)
           AS url
    FROM supplier CROSS JOIN range(0, 6) r(n) WHERE s_suppkey % 7 <> 3 AND s_suppkey % 11 <> 4),
listed AS (
    SELECT 'https://graph.example.com/sitemaps/' || s || '.xml' AS sitemap_url, 0 AS sub_pos, pos AS url_pos, url
    FROM leaves
    UNION ALL
    SELECT 'https://graph.example.com/sitemaps/index-' || s_suppkey || '.xml', s - s_suppkey, pos, url
    FROM supplier JOIN leaves ON s >= s_suppkey AND s < s_suppkey + 10
    WHERE s_suppkey % 10 = 0)"""
ORACLES["sitemap_urls"] = f"""WITH {_LISTED}
SELECT sitemap_url, CAST(sub_pos AS INTEGER) AS sub_pos, CAST(url_pos AS INTEGER) AS url_pos, url FROM listed"""
ORACLES["sitemap_pages"] = f"""WITH {_LISTED}
SELECT CAST(c_custkey * 10 + 7 AS BIGINT) AS page_id, url,
       CASE WHEN c_custkey % 17 = 5 THEN 'HTTP 404' END AS fetch_error, sitemap_url,
       CAST(row_number() OVER (PARTITION BY sitemap_url, url ORDER BY sub_pos, url_pos) AS BIGINT) AS copy,
       CAST(CASE WHEN c_custkey % 17 = 5 THEN 0 ELSE 1 END AS INTEGER) AS n_items
FROM listed JOIN customer ON url = {_GRAPH} || c_custkey"""


def _reached(blocked: str = "FALSE") -> str:
    """Keys a crawl comes to, with their depth: children of pages that the snapshot has."""
    return f"""reached AS (
    SELECT CAST(0 AS BIGINT) AS k, 0 AS depth
    UNION ALL
    SELECT child, depth + 1
    FROM (SELECT reached.k * 10 + n AS child, depth FROM reached
          JOIN customer ON c_custkey = reached.k AND c_custkey % 17 <> 5 CROSS JOIN range(1, 11) r(n)
          WHERE depth < 30) steps
    WHERE NOT ({blocked}))"""


ORACLES["crawl_bfs"] = f"""WITH RECURSIVE {_reached()}
SELECT {_GRAPH} || k AS url, CAST(depth AS INTEGER) AS depth FROM reached"""
ORACLES["crawl_capped"] = f"""WITH RECURSIVE {_reached()}
SELECT {_GRAPH} || k AS url, CAST(depth AS INTEGER) AS depth
FROM (SELECT * FROM reached WHERE depth <= 3 ORDER BY depth, k LIMIT 100) first_pages"""
ORACLES["crawl_report"] = f"""WITH RECURSIVE {_reached("starts_with(CAST(child AS VARCHAR), '13')")}
SELECT CAST(k * 10 + 7 AS BIGINT) AS page_id, {_GRAPH} || k AS url, CAST(depth AS INTEGER) AS depth,
       CAST(1 AS INTEGER) AS n_items
FROM reached first_pages
JOIN customer ON c_custkey = k AND c_custkey % 17 <> 5"""

# --- streaming ----------------------------------------------------------------------------------

_DOC = "SELECT doc_id AS page_id, 'https://docs.example.com/' || doc_id AS url, CAST(0 AS INTEGER) AS item_ord"
ORACLES["stream_issues"] = "\nUNION ALL\n".join(
    f"{_DOC}, '{kind}' AS issue_type, '{severity}' AS severity, {message} AS message, {path} AS path, "
    f"{ref} AS schema_ref FROM documents WHERE doc_id % 3 = {variant}"
    for variant, (kind, severity, message, path, ref) in [
        *[(0, _required_issue("Article", prop)) for prop in rules.REQUIRED_PROPERTIES["Article"]],
        (0, _image_issue("Article")),
        (1, _unsupported_issue("'Memo'")),
        (2, _UNTYPED),
    ]
)
