"""URL functions as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import (
    DATE_SHAPE, PLAIN_URL_SHAPE, SKIPPED_EXTENSIONS, SKIPPED_HREF_PREFIXES, URL_ENDING_SHAPE, URL_LABEL_SHAPE, URL_QUAD_SHAPE, URL_SHAPE,
)
from .columns import let, strip

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_NETLOC = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"
_QUERY = r"^[^?#]*\?([^#]*)"
_DOT_SEGMENT = r"(?:^|/)\.\.?(?:/|$)"


def cut_fragment(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def normalise_url(url: Column) -> Column:
    """Without fragment and without any trailing slashes: the identity of a page in a crawl."""
    return F.rtrim(cut_fragment(url), F.lit("/"))


def netloc(url: Column) -> Column:
    """Authority with its port, case kept; empty when there is none."""
    return F.regexp_extract(url, _NETLOC, 1)


def url_scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SCHEME, 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, _PATH, 1)


def url_query(url: Column) -> Column:
    return F.regexp_extract(url, _QUERY, 1)


def url_parts(url: Column) -> Column:
    return F.struct(
        url_scheme(url).alias("scheme"),
        netloc(url).alias("netloc"),
        url_path(url).alias("path"),
        url_query(url).alias("query"),
    )


def _merge_path(base_path: Column, path: Column) -> Column:
    """Path of a reference against the base path, "." and ".." resolved, leading slash ensured."""
    directory = F.regexp_replace(base_path, r"[^/]*$", "")
    # Empty segments inside a relative result are dropped; an absolute reference keeps its own.
    relative = F.concat(F.lit("/"), F.regexp_replace(F.concat(directory, path), r"^/+", ""))
    merged = F.when(path.startswith("/"), path).otherwise(F.regexp_replace(relative, "/{2,}", "/"))

    def resolve(full: Column) -> Column:
        kept = F.aggregate(
            F.split(full, "/", -1),
            F.array().cast("array<string>"),
            lambda done, segment: F.when(
                segment == "..",
                F.when(F.size(done) > 0, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(done),
            )
            .when(segment == ".", done)
            .otherwise(F.array_append(done, segment)),
        )
        closed = F.when(full.rlike(r"/\.\.?$"), F.array_append(kept, F.lit(""))).otherwise(kept)
        return F.array_join(closed, "/")

    resolved = let(
        merged, lambda full: F.when(full.rlike(_DOT_SEGMENT), resolve(full)).otherwise(full)
    )
    return let(resolved, lambda p: F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p)))


def resolve_url(base: Column, reference: Column) -> Column:
    """Absolute URL of `reference` on a page whose `url_parts` are `base`, without fragment."""

    def build(ref: Column) -> Column:
        scheme = url_scheme(ref)
        host, path, query = netloc(ref), url_path(ref), url_query(ref)

        def unsplit(where: Column, what: Column, asked: Column) -> Column:
            rooted = F.when((what == "") | what.startswith("/"), what).otherwise(F.concat(F.lit("/"), what))
            suffix = F.when(asked == "", F.lit("")).otherwise(F.concat(F.lit("?"), asked))
            return F.concat(base["scheme"], F.lit("://"), where, rooted, suffix)

        return (
            F.when((scheme != "") & (scheme != base["scheme"]), ref)
            .when(host != "", unsplit(host, path, query))
            .when(
                path == "",
                unsplit(base["netloc"], base["path"], F.when(query == "", base["query"]).otherwise(query)),
            )
            .otherwise(unsplit(base["netloc"], _merge_path(base["path"], path), query))
        )

    return let(F.regexp_replace(cut_fragment(reference), r"[\t\r\n]", ""), build)


def is_followed_href(href: Column) -> Column:
    """An href worth resolving: not blank, not a fragment, mail, phone or script reference."""
    dropped = href == ""
    for prefix in SKIPPED_HREF_PREFIXES:
        dropped = dropped | href.startswith(prefix)
    return ~dropped


def is_document_url(url: Column) -> Column:
    """False for URLs whose path ends in the suffix of a resource that is not a page."""
    path = F.regexp_replace(F.lower(url_path(url)), r";[^/]*$", "")
    return ~path.rlike(r"\.(?:" + "|".join(SKIPPED_EXTENSIONS) + r")$")


def clean_href(href: Column) -> Column:
    return strip(href)


def is_http_url(value: Column) -> Column:
    """Shape of an absolute http(s) URL: domain with a 2-6 letter ending, localhost or dotted quad; port; path.

    The host is checked label by label: a nested repetition over labels would recurse once per label in the JVM
    matcher and could overflow its stack on hostile input.
    """

    def domain(host: Column) -> Column:
        labels = F.split(F.regexp_replace(host, r"\.$", ""), r"\.", -1)
        return let(
            labels,
            lambda parts: (F.size(parts) > 1)
            & F.element_at(parts, -1).rlike(URL_ENDING_SHAPE)
            & F.forall(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda p: p.rlike(URL_LABEL_SHAPE)),
        )

    return value.rlike(PLAIN_URL_SHAPE) | (
        value.rlike(URL_SHAPE)
        & let(
            F.regexp_extract(value, URL_SHAPE, 1),
            lambda host: (F.lower(host) == "localhost")
            | host.rlike(URL_QUAD_SHAPE)
            | domain(host),
        )
    )


def is_iso_date(value: Column) -> Column:
    """Shape of an ISO 8601 date, or date and time to the minute or second; the calendar is not checked."""
    return value.rlike(DATE_SHAPE)


def percent_decode(text: Column) -> Column:
    """Percent-decode as UTF-8; a stray % and a + stay as they are."""
    guarded = F.regexp_replace(text, r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.url_decode(F.replace(guarded, F.lit("+"), F.lit("%2B")))


def percent_encode(text: Column) -> Column:
    """Percent-encode everything but letters, digits, "_", ".", "-", "~" and "/"."""
    encoded = F.url_encode(text)
    for have, want in [("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")]:
        encoded = F.replace(encoded, F.lit(have), F.lit(want))
    return encoded
