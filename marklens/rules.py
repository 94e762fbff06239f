"""Fixed values the checks are defined by: enum texts, type lists, property lists and shapes."""

from __future__ import annotations

# --- fixed values: enum texts -------------------------------------------------------------------

SEVERITIES = ["error", "warning", "info"]
SEVERITY_RANK = {"error": 3, "warning": 2, "info": 1}

JSON_LD = "json-ld"
MICRODATA = "microdata"
RDFA = "rdfa"
SCHEMA_FORMATS = [JSON_LD, MICRODATA, RDFA]

ISSUE_TYPES = [
    "missing_required_property",
    "invalid_property_type",
    "deprecated_type",
    "deprecated_property",  # reserved, no rule emits it
    "conflicting_schema",
    "malformed_json_ld",
    "empty_schema",
    "missing_schema_type",
    "invalid_url",
    "missing_name",
    "missing_image",
    "non_indexable_schema",  # reserved, no rule emits it
    "unsupported_type",
    "graph_item_error",  # reserved, no rule emits it
]

MALFORMED = "MalformedJSON-LD"
UNKNOWN = "Unknown"

# --- fixed values: types and properties ---------------------------------------------------------

# Types eligible for rich results.
RICH_RESULT_TYPES = [
    "Article", "NewsArticle", "BlogPosting", "Product", "Offer", "AggregateOffer", "FAQPage", "HowTo", "HowToStep",
    "BreadcrumbList", "ListItem", "Organization", "Person", "LocalBusiness", "Restaurant", "Review",
    "AggregateRating", "Event", "VideoObject", "ImageObject", "JobPosting", "Course", "Book", "Movie", "MusicAlbum",
    "MusicRecording", "Recipe", "SoftwareApplication", "WebPage", "WebSite", "SearchAction",
    "SiteNavigationElement", "ContactPage", "AboutPage", "ItemList", "Dataset", "SpecialAnnouncement",
    "ClaimReview", "EmployerAggregateRating",
]

# Properties a rich result needs, per type. FAQPage and BreadcrumbList have rules of their own.
REQUIRED_PROPERTIES = {
    "Product": ["name"],
    "Offer": ["price", "priceCurrency"],
    "AggregateOffer": ["lowPrice"],
    "Article": ["headline", "author", "datePublished", "image"],
    "NewsArticle": ["headline", "author", "datePublished", "image"],
    "BlogPosting": ["headline", "author", "datePublished"],
    "FAQPage": [],
    "HowTo": ["name", "step"],
    "BreadcrumbList": [],
    "Organization": ["name"],
    "LocalBusiness": ["name", "address"],
    "Event": ["name", "startDate", "location"],
    "VideoObject": ["name", "description", "thumbnailUrl", "uploadDate"],
    "JobPosting": ["title", "description", "datePosted", "hiringOrganization"],
    "Recipe": ["name", "image"],
    "Review": ["itemReviewed", "author"],
    "AggregateRating": ["ratingValue"],
    "Course": ["name", "description"],
    "Dataset": ["name", "description"],
    "SearchAction": ["target", "query-input"],
    "WebSite": ["name"],
    "ImageObject": ["contentUrl"],
}

DEPRECATED_TYPES = ["EntryRating", "ratingValue", "PaymentChargeSpecification"]

# The property name is lower-cased before it is looked up, so the mixed-case names never match.
URL_PROPERTIES = [
    "url", "image", "logo", "thumbnailUrl", "contentUrl", "embedUrl", "sameAs", "mainEntityOfPage", "target", "href",
    "link",
]

DATE_PROPERTIES = [
    "datePublished", "dateModified", "dateCreated", "startDate", "endDate", "datePosted", "uploadDate", "expires",
]

ARTICLE_TYPES = ["Article", "NewsArticle", "BlogPosting"]
NAME_EXEMPT_TYPES = ["ListItem", "SearchAction", "SiteNavigationElement", "ImageObject", "VideoObject"]
CONFLICT_TYPES = ["Product", "Organization", "WebSite", "LocalBusiness"]

# --- fixed values: shapes -----------------------------------------------------------------------

# Host and rest of an absolute URL, one label of a host, and the last one.
URL_SHAPE = r"(?idU)^https?://([A-Z0-9.\-]+)(?::\d+)?(?:/?|[/?]\S+)$"
# URLs that have the shape, told by one pattern: most do. What it does not match is looked at part by part.
PLAIN_URL_SHAPE = r"\Ahttps?://(?:[A-Za-z0-9]{1,63}\.){1,8}[A-Za-z]{2,6}(?:/[!-~]*+)?\z"
URL_LABEL_SHAPE = r"(?iu)^[A-Z0-9](?:[A-Z0-9\-]{0,61}[A-Z0-9])?$"
URL_ENDING_SHAPE = r"(?iu)^[A-Z]{2,6}$"
URL_QUAD_SHAPE = r"(?U)^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"
DATE_SHAPE = r"(?dU)^\d{4}-\d{2}-\d{2}(?:T\d{2}:\d{2}(?::\d{2})?(?:[+\-]\d{2}:?\d{2}|Z)?)?$"

# --- fixed values: links ------------------------------------------------------------------------

SKIPPED_HREF_PREFIXES = ["#", "mailto:", "tel:", "javascript:"]
SKIPPED_EXTENSIONS = ["css", "js", "png", "jpg", "jpeg", "gif", "svg", "pdf", "zip", "xml", "txt"]
SITEMAP_NAMESPACE = "http://www.sitemaps.org/schemas/sitemap/0.9"

# --- fixed values: crawl defaults ---------------------------------------------------------------

MAX_PAGES = 100
MAX_DEPTH = 3
USER_AGENT = "marklens/0.1.0"
