"""Item and page checks as in-row expressions over `schemas.ITEMS`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules, schemas
from ..functions import variants as V
from ..functions.columns import comma_parts, first_comma_part, is_blank, let, texts
from ..functions.overflow import text_of
from ..functions.urls import is_http_url, is_iso_date

# Order in which the checks report, within one item.
EMPTY, DEPRECATED, URL_SHAPE, DATE_SHAPE, UNSUPPORTED, REQUIRED, TYPE_RULE, NAME, CONFLICT = range(1, 10)
UNTYPED = 0

ISSUES = schemas.ISSUES

def code_of(order: int, severity: str) -> int:
    """An issue as a number: its check, then the rank of its severity."""
    return order * 10 + rules.SEVERITY_RANK[severity]


def _text(value: str | Column | None) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("string")


class Form:
    """What the rules give for each issue: the issue with its message, or its code alone for reports that only count.

    Conditions are the same in both; without messages no text is put together.
    """

    def __init__(self, messages: bool = True) -> None:
        self.messages = messages
        self.type = ISSUES if messages else schemas.CODES

    def issue(
        self,
        order: int,
        kind: str,
        severity: str,
        message: str | Column,
        path: str | Column | None = None,
        schema_ref: str | Column | None = None,
    ) -> Column:
        if not self.messages:
            return F.lit(code_of(order, severity))
        return F.struct(
            F.lit(None).cast("int").alias("item_ord"),
            F.lit(order).alias("check_ord"),
            F.lit(kind).alias("issue_type"),
            F.lit(severity).alias("severity"),
            _text(message).alias("message"),
            _text(path).alias("path"),
            _text(schema_ref).alias("schema_ref"),
        )

    def always(self, issue: Column) -> Column:
        return F.array(issue).cast(self.type)

    def one(self, condition: Column, issue: Column) -> Column:
        """An array with the issue where the condition holds, else an empty one."""
        return F.when(condition, self.always(issue)).otherwise(self.none())

    def none(self) -> Column:
        return F.array().cast(self.type)

    def joined(self, *issues: Column) -> Column:
        """Arrays of issues as one; cheaper within a lambda than a concatenation of several arrays."""
        return F.flatten(F.array(*issues))

    def each(self, entries: Column, issue: Callable[..., Column]) -> Column:
        return F.transform(entries, issue).cast(self.type)

    def has_severity(self, issue: Column, severity: str) -> Column:
        return issue["severity"] == severity if self.messages else issue % 10 == rules.SEVERITY_RANK[severity]


# --- fixed values: the issue types, severities, message texts and paths that the rules below give ---


def _shape_issues(
    form: Form,
    properties: Column,
    overflow: Column,
    is_watched: Callable[[Column], Column],
    is_valid: Callable[[Column], Column],
    issue: Callable[[Column, Column], Column],
) -> Column:
    """Watched text properties, not blank, whose value has the wrong shape; large values are read whole."""
    watched = F.filter(F.filter(F.map_keys(properties), is_watched), lambda name: V.is_text(properties[name]))
    named = F.transform(watched, lambda name: F.struct(name.alias("name"), text_of(name, properties[name], overflow).alias("text")))
    wrong = F.filter(named, lambda e: ~is_blank(e["text"]) & ~is_valid(e["text"]))
    return form.each(wrong, lambda e: issue(e["name"], e["text"]))


# Names that a lower-cased name can match; lower-casing makes no name shorter, so longer ones need not be folded.
_URL_NAMES = [name for name in rules.URL_PROPERTIES if name == name.lower()]
_LONGEST_URL_NAME = max(map(len, _URL_NAMES))


def _is_url_property(prop: Column) -> Column:
    folded = (F.char_length(prop) <= _LONGEST_URL_NAME) & prop.rlike("[^a-z]") & F.lower(prop).isin(_URL_NAMES)
    return prop.isin(_URL_NAMES) | folded


def url_issues(form: Form, name: Column, properties: Column, overflow: Column) -> Column:
    return _shape_issues(
        form,
        properties,
        overflow,
        _is_url_property,
        is_http_url,
        lambda prop, value: form.issue(
            URL_SHAPE,
            "invalid_url",
            "warning",
            F.format_string("Property '%s' has invalid URL: '%s'", prop, value),
            F.concat(name, F.lit("."), prop),
            name,
        ),
    )


def date_issues(form: Form, name: Column, properties: Column, overflow: Column) -> Column:
    return _shape_issues(
        form,
        properties,
        overflow,
        lambda prop: prop.isin(rules.DATE_PROPERTIES),
        is_iso_date,
        lambda prop, value: form.issue(
            DATE_SHAPE,
            "invalid_property_type",
            "warning",
            F.format_string("Property '%s' value '%s' is not ISO 8601 format", prop, value),
            F.concat(name, F.lit("."), prop),
            name,
        ),
    )


def _required(base: Column) -> Column:
    table = F.create_map(
        *[entry for name, props in rules.REQUIRED_PROPERTIES.items() for entry in (F.lit(name), texts(props))]
    )
    return F.coalesce(F.try_element_at(table, base), texts([]))


def required_issues(form: Form, base: Column, properties: Column) -> Column:
    absent = F.filter(_required(base), lambda prop: ~F.map_contains_key(properties, prop))
    return form.each(
        absent,
        lambda prop: form.issue(
            REQUIRED,
            "missing_required_property",
            "error",
            F.format_string("Google rich results require '%s' for %s", prop, base),
            F.concat(base, F.lit("."), prop),
            base,
        ),
    )


def faq_issues(form: Form, properties: Column) -> Column:
    """A FAQ page needs a main entity; objects in a list of them must be questions or untyped."""

    def check(entity: Column) -> Column:
        absent = form.always(
            form.issue(
                TYPE_RULE,
                "missing_required_property",
                "error",
                "FAQPage requires 'mainEntity' with Question/Answer pairs",
                "FAQPage.mainEntity",
                "FAQPage",
            )
        )

        def is_wrong(entry: Column) -> Column:
            kind = V.member(entry, "@type")
            allowed = F.coalesce(F.is_variant_null(kind), F.lit(True)) | (V.is_text(kind) & (V.as_text(kind) == "Question"))
            return V.is_object(entry) & ~allowed

        numbered = F.transform(V.as_list(entity), lambda e, i: F.when(is_wrong(e), i))
        wrong = form.each(
            F.array_compact(numbered),
            lambda i: form.issue(
                TYPE_RULE,
                "invalid_property_type",
                "warning",
                F.format_string("FAQPage.mainEntity[%d] should be of type 'Question'", i),
                F.format_string("FAQPage.mainEntity[%d]", i),
                "FAQPage",
            ),
        )
        return F.when(~V.is_truthy(entity), absent).otherwise(F.coalesce(wrong, form.none()))

    return let(properties["mainEntity"], check)


def breadcrumb_issues(form: Form, properties: Column) -> Column:
    return form.one(
        let(properties["itemListElement"], lambda entries: ~V.is_truthy(entries)),
        form.issue(
            TYPE_RULE,
            "missing_required_property",
            "error",
            "BreadcrumbList requires 'itemListElement'",
            "BreadcrumbList.itemListElement",
            "BreadcrumbList",
        ),
    )


def article_issues(form: Form, name: Column, properties: Column) -> Column:
    return form.one(
        ~F.map_contains_key(properties, "image"),
        form.issue(
            TYPE_RULE,
            "missing_image",
            "warning",
            F.concat(name, F.lit(" should have an 'image' property for rich results")),
            F.concat(name, F.lit(".image")),
            name,
        ),
    )


def product_issues(form: Form, properties: Column) -> Column:
    return form.joined(
        form.one(
            ~F.map_contains_key(properties, "image"),
            form.issue(
                TYPE_RULE,
                "missing_image",
                "warning",
                "Product should have an 'image' property for rich results",
                "Product.image",
                "Product",
            ),
        ),
        form.one(
            ~F.map_contains_key(properties, "offers") & ~F.map_contains_key(properties, "price"),
            form.issue(
                TYPE_RULE,
                "missing_required_property",
                "warning",
                "Product should have 'offers' or 'price' for rich results",
                "Product.offers",
                "Product",
            ),
        ),
    )


def name_issues(form: Form, base: Column, properties: Column) -> Column:
    named_types = [t for t in rules.RICH_RESULT_TYPES if t not in rules.NAME_EXEMPT_TYPES]
    return form.one(
        ~F.map_contains_key(properties, "name") & base.isin(named_types),
        form.issue(
            NAME,
            "missing_name",
            "warning",
            F.format_string("Schema '%s' should have a 'name' property", base),
            F.concat(base, F.lit(".name")),
            base,
        ),
    )


def guideline_issues(form: Form, name: Column, properties: Column) -> Column:
    """Rich-result checks: an unsupported type ends them; otherwise the first of several types decides the rules."""
    supported = name.isin(rules.RICH_RESULT_TYPES) | F.exists(
        comma_parts(name), lambda part: part.isin(rules.RICH_RESULT_TYPES)
    )
    unsupported = form.always(
        form.issue(
            UNSUPPORTED,
            "unsupported_type",
            "info",
            F.format_string("Schema type '%s' is not a recognized Google rich result type", name),
            None,
            name,
        )
    )

    def by_base(base: Column) -> Column:
        type_rule = (
            F.when(base == "FAQPage", faq_issues(form, properties))
            .when(base == "BreadcrumbList", breadcrumb_issues(form, properties))
            .when(base.isin(rules.ARTICLE_TYPES), article_issues(form, name, properties))
            .when(base == "Product", product_issues(form, properties))
            .otherwise(form.none())
        )
        return form.joined(required_issues(form, base, properties), type_rule, name_issues(form, base, properties))

    return F.when(~supported, unsupported).otherwise(let(first_comma_part(name), by_base))


def item_issues(form: Form, item: Column, google_guidelines: bool = True) -> Column:
    """All issues of one item, in rule order."""
    name, properties, overflow = item["schema_type"], item["properties"], item["overflow"]
    malformed = form.issue(
        UNTYPED, "malformed_json_ld", "error", "JSON-LD block contains invalid JSON", None, rules.MALFORMED
    )
    untyped = form.issue(UNTYPED, "missing_schema_type", "warning", "Structured data has no @type defined")
    checks = [
        form.one(
            F.size(properties) == 0,
            form.issue(
                EMPTY,
                "empty_schema",
                "warning",
                F.format_string("Schema '%s' has no properties", name),
                None,
                name,
            ),
        ),
        form.one(
            name.isin(rules.DEPRECATED_TYPES),
            form.issue(
                DEPRECATED,
                "deprecated_type",
                "warning",
                F.format_string("Schema type '%s' is deprecated", name),
                None,
                name,
            ),
        ),
        url_issues(form, name, properties, overflow),
        date_issues(form, name, properties, overflow),
    ]
    if google_guidelines:
        checks.append(guideline_issues(form, name, properties))
    return (
        F.when(name == rules.MALFORMED, form.always(malformed))
        .when(name.isin("", rules.UNKNOWN), form.always(untyped))
        .otherwise(form.joined(*checks))
    )


def conflict_issues(items: Column, form: Form) -> Column:
    """Page-level: several items of one type that should be there once."""

    def check(bases: Column) -> Column:
        counted = F.transform(
            F.array_intersect(bases, texts(rules.CONFLICT_TYPES)),
            lambda base: F.struct(
                base.alias("base"), F.size(F.filter(bases, lambda other: other == base)).alias("n")
            ),
        )
        return form.each(
            F.filter(counted, lambda c: c["n"] > 1),
            lambda c: form.issue(
                CONFLICT,
                "conflicting_schema",
                "warning",
                F.format_string(
                    "Multiple '%s' schemas found (%d instances) — may cause confusion", c["base"], c["n"]
                ),
                None,
                c["base"],
            ),
        )

    return let(F.transform(items, lambda item: first_comma_part(item["schema_type"])), check)


def page_issues(items: Column, form: Form, google_guidelines: bool = True) -> Column:
    """All item issues of a page, in item order, each with its item's position."""

    def of_item(item: Column, at: Column) -> Column:
        found = item_issues(form, item, google_guidelines)
        return F.transform(found, lambda issue: issue.withField("item_ord", at)) if form.messages else found

    return F.flatten(F.transform(items, of_item)).cast(form.type)
