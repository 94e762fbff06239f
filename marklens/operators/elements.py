"""One pass over a page's HTML, keeping only what the extractors and the link graph read.

This is the engine's only Python stage. Everything with meaning (which element is an item, what its properties are,
what a link points to) is decided later in Catalyst expressions; here HTML text becomes rows of elements with their
nearest scopes. Batches travel as Arrow columns, and the caller passes NULL for pages that cannot hold markup, so
those cost nothing.
"""

from __future__ import annotations

import json
import re
import sys
from collections import defaultdict
from functools import cache
from html import unescape

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas
from ..functions.overflow import BEGINNING, SEGMENT

# The reader travels with the query, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Cheap test for "this page may hold markup or links", evaluated in the JVM before any HTML reaches Python.
BLOCK_HINT = "application/ld"
ESCAPED_TYPE = r"(?is)<script\b[^>]*\btype\s*=[^>]*&"
MARKUP_HINTS = ("itemscope", "typeof", "property")
LINK_HINTS = ("href",)

_ATTRIBUTES = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+"""
_MARKUP = r"<(?:!--(?:-?>|.*?(?:--!?>|\Z))|[!?][^>]*+>?+|(/?)(%s)(" + _ATTRIBUTES + ")(>?))"
_ANY_TAG = re.compile(_MARKUP % r"[a-zA-Z][^\s/>]*+", re.S)
# Enough for scripts and links: no element tree is needed, so all other tags are passed over inside the pattern.
_FLAT_NAMES = r"(?:a|script|style|title|textarea)(?=[\s/>])"
_PASSED_OVER = r"(?:[^<]++|<(?!%s|[!?])(?:/?[a-zA-Z][^\s/>]*+" % _FLAT_NAMES + _ATTRIBUTES + ">)?+)*+"
_FLAT_TAG = re.compile(_PASSED_OVER + _MARKUP % _FLAT_NAMES, re.S | re.I)
_ATTRIBUTE = re.compile(r"""([^\s/=][^\s/=]*+)\s*+(?:=\s*+("[^"]*+"|'[^']*+'|\S*+))?+""")
_SCOPE_WORDS = ("itemscope", "itemprop", "typeof", "property", "vocab")
_RAW_TAGS = frozenset(("script", "style", "title", "textarea"))
_NAME_ENDS = frozenset((" ", "\t", "\n", "\f", "\r", "/", ">", ""))

# --- fixed values: HTML tree facts (HTML standard) ----------------------------------------------

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BARRIER = frozenset("table td th caption template button object".split())
_PARAGRAPH_ENDS = frozenset(
    (
        "address article aside blockquote details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
        "header hr main menu nav ol p pre section table ul li dd dt"
    ).split()
)
# An end tag cannot close an open element of higher rank than its own.
_END_RANK = defaultdict(
    lambda: 100,
    {
        "div": 150, "td": 160, "th": 160, "tr": 170, "thead": 180, "tbody": 180, "tfoot": 180, "table": 190,
        "head": 200, "body": 200, "html": 220,
    },
)
# Start tag -> (open elements it ends, elements the search for them does not cross).
_IMPLIED_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, set()),
}

_KEPT_ATTRIBUTES = (
    "itemscope", "itemtype", "itemprop", "typeof", "vocab", "property", "content", "src", "href", "datetime", "value",
)
# Tags whose Microdata value is an attribute alone, and those that fall back to their text.
_VALUE_ATTRIBUTE_TAGS = frozenset("meta img audio video source a link".split())
_TEXT_FALLBACK = {"time": "datetime", "data": "value"}


def _is_scoped(text: str) -> bool:
    text = text.lower()
    return any(word in text for word in _SCOPE_WORDS)


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(text):
        if value[:1] in ('"', "'") and value[-1:] == value[:1] and len(value) > 1:
            value = value[1:-1]
        found.setdefault(name.lower(), unescape(value) if "&" in value else value)
    return found


# What the JVM's JSON reader and a VARIANT take. A block of this many bytes of JSON has no text that the JVM's reader
# refuses (20,000,000 characters), and as a VARIANT it takes less than three times as many (128 MiB are allowed).
MOST_DEPTH = 500
MOST_BYTES = 16 << 20
MOST_DIGITS = 300
# Of a larger item, members of more JSON than this go into its overflow.
MOST_MEMBER = 1 << 10
# All texts of a page's elements together; nested elements hold their texts each.
MOST_TEXT = 1 << 30


def _finite(number: float) -> float:
    return number if abs(number) <= 1e308 else (1e308 if number > 0 else -1e308)


def _whole(digits: str) -> int | float:
    return int(digits) if len(digits) <= MOST_DIGITS else _finite(float("-inf" if digits[0] == "-" else "inf"))


def _json_decoder() -> json.JSONDecoder:
    """Numbers that no double holds, and NaN and infinities, stay numbers that are not zero."""
    return json.JSONDecoder(
        parse_constant=lambda name: -1e308 if name[0] == "-" else 1e308,
        parse_float=lambda text: _finite(float(text)),
        parse_int=_whole,
    )


def _within_depth(value):
    """The value with what lies deeper than `MOST_DEPTH` as JSON text."""
    pending = [(value, 1)]
    while pending:
        held, depth = pending.pop()
        for key, inner in held.items() if isinstance(held, dict) else enumerate(held):
            if isinstance(inner, (dict, list)):
                if depth >= MOST_DEPTH:
                    held[key] = json.dumps(inner)
                else:
                    pending.append((inner, depth + 1))
    return value


def _items_apart(value):
    """Each item of a block, as a block of its own and as the object itself."""
    if isinstance(value, list):
        for entry in value:
            if isinstance(entry, dict):
                yield from _items_apart(entry)
    elif isinstance(value.get("@graph"), list):
        context = {key: value[key] for key in ("@context",) if key in value}
        for entry in value["@graph"]:
            if isinstance(entry, dict):
                yield {**context, "@graph": [entry]}, entry
    else:
        yield value, value


def _kind_of(member, inner: bool = False):
    """What stands for a large member: of its kind, and as true as it, with the types of a list's objects."""
    if isinstance(member, str):
        return member[:BEGINNING]
    if isinstance(member, dict):
        named = member.get("@type")
        kept = {"@type": named if named is None or isinstance(named, str) and len(named) <= BEGINNING else 0} if "@type" in member else {}
        return kept if inner else kept or {"": 0}
    if isinstance(member, list):
        return [] if inner else [_kind_of(entry, True) for entry in member]
    return member


def _parts(value) -> list[tuple[str, dict | None]]:
    """A large block as one part per item: its JSON, and its overflow if it is too large for a VARIANT itself."""
    parts = []
    for block, item in _items_apart(value):
        overflow = {}
        text = json.dumps(block)
        if len(text) > MOST_BYTES:
            for key in [key for key in item if not key.startswith("@") or key == "@id"]:
                member = item[key] if isinstance(item[key], str) else json.dumps(item[key])
                if len(member) > MOST_MEMBER:
                    segments = [member[at : at + SEGMENT] for at in range(0, len(member), SEGMENT)]
                    overflow[key] = {"json": not isinstance(item[key], str), "segments": segments}
                    item[key] = _kind_of(item[key])
            text = json.dumps(block)
        parts.append((text, overflow or None))
    return parts


def _strict_json(text: str, decoder: json.JSONDecoder) -> list[tuple[str, dict | None]]:
    """The block as plain JSON that later stages can read, in one or more parts with their overflow; empty if it is not JSON.

    Later stages need last-wins duplicate keys and no NaN or Infinity, which JSON in the wild has and the JVM parser
    refuses. A block too deeply nested to be read at all counts as not JSON; other blocks of the page are not touched.
    """
    try:
        value = decoder.decode(text)
        if text.count("[") + text.count("{") > MOST_DEPTH and isinstance(value, (dict, list)):
            value = _within_depth(value)
        plain = json.dumps(value)
        return [(plain, None)] if len(plain) <= MOST_BYTES or not isinstance(value, (dict, list)) else _parts(value)
    except (ValueError, RecursionError, MemoryError):
        return []


def _raw_end(html: str, tag: str, at: int) -> int:
    """Where the content of a script, style, title or textarea stops: its end tag, or the end of the document."""
    name_length = len(tag)
    while (at := html.find("</", at)) >= 0:
        after = at + 2 + name_length
        if html[at + 2 : after].lower() == tag and html[after : after + 1] in _NAME_ENDS:
            return at
        at += 2
    return len(html)


class _Page:
    """Rows of one page: ld+json scripts, scope and property elements, link targets."""

    def __init__(self, html: str, markup: bool, links: bool, decoder: json.JSONDecoder) -> None:
        self.decoder = decoder
        self.scripts: list[tuple] = []
        self.nodes: list[list] = []
        self.hrefs: list[str] = []
        self.links = links
        self.markup = markup
        self.tree = markup and _is_scoped(html)
        # Open elements: tag, nearest scope, typed element and vocab, row that waits for its text, start of that text.
        self.stack: list[tuple] = []
        self.open_tags: dict[str, int] = defaultdict(int)
        # Text is kept only while an element that needs it is open.
        self.listening = 0
        self.kept = 0
        self.words: list[str] = []
        self.template_words: list[str] = []
        self._read(html)

    def _read(self, html: str) -> None:
        next_tag = _ANY_TAG.search if self.tree else _FLAT_TAG.match
        at = 0
        serial = 0
        while (found := next_tag(html, at)) is not None:
            if self.listening:
                self._text(html[at : found.start()])
            at = found.end()
            slash, tag, attributes, end = found.groups()
            if tag is None:  # comment, doctype or processing instruction
                continue
            if not end:  # the document stops inside a tag
                break
            tag = tag.lower()
            if slash:
                if self.tree:
                    self._end(tag)
                continue
            serial += 1
            raw = None
            if tag in _RAW_TAGS:
                close = _raw_end(html, tag, at)
                raw = html[at:close]
                at = close
            self._start(tag, attributes, serial, raw)
        if self.tree:
            if self.listening:
                self._text(html[at:])
            while self.stack:
                self._pop()

    def _text(self, text: str) -> None:
        word = (unescape(text) if "&" in text else text).strip()
        if word:
            (self.template_words if self.open_tags["template"] else self.words).append(word)

    def _start(self, tag: str, source: str, serial: int, raw: str | None) -> None:
        wanted = (self.links and tag == "a") or (self.markup and tag == "script")
        attributes = _attributes(source) if wanted or (self.tree and source and _is_scoped(source)) else {}
        if self.links and tag == "a" and "href" in attributes:
            self.hrefs.append(attributes["href"])
        if self.markup and tag == "script" and attributes.get("type") == "application/ld+json" and raw.strip():
            parts = _strict_json(raw, self.decoder)
            self.scripts += [(serial, None, *part) for part in parts] or [(serial, raw, None, None)]
        if not self.tree:
            return
        self._imply_ends(tag)
        scope, typed, vocab = self.stack[-1][1:4] if self.stack else (None, None, None)
        row = None
        if attributes and not attributes.keys().isdisjoint(("itemscope", "itemprop", "typeof", "property")):
            row = len(self.nodes)
            kept = [(name, attributes[name]) for name in _KEPT_ATTRIBUTES if name in attributes]
            self.nodes.append([serial, tag, kept, scope, typed, vocab, None])
        needs_text = row is not None and self._needs_text(row)
        own = raw.strip() if raw is not None and tag in ("script", "style") else None
        if tag in _VOID or own is not None:
            if needs_text:
                self.nodes[row][6] = own or ""
            return
        self.listening += needs_text
        words = self.template_words if tag == "template" else self.words
        self.stack.append(
            (
                tag,
                serial if "itemscope" in attributes else scope,
                serial if "typeof" in attributes else typed,
                attributes.get("vocab", vocab),
                row if needs_text else None,
                len(words),
            )
        )
        self.open_tags[tag] += 1
        if raw is not None:  # title and textarea: text without markup
            if self.listening:
                self._text(raw)
            self._pop()

    def _needs_text(self, row: int) -> bool:
        _, tag, kept, *_ = self.nodes[row]
        names = {name for name, _ in kept}
        as_property = "property" in names and names.isdisjoint(("content", "href"))
        as_itemprop = (
            "itemprop" in names and tag not in _VALUE_ATTRIBUTE_TAGS and _TEXT_FALLBACK.get(tag) not in names
        )
        return as_property or as_itemprop

    def _pop(self) -> None:
        tag, _, _, _, row, begin = self.stack.pop()
        self.open_tags[tag] -= 1
        if row is not None:
            self.listening -= 1
            words = self.template_words if tag == "template" else self.words
            self.nodes[row][6] = text = "".join(words[begin:])
            self.kept += len(text)
            if self.kept > MOST_TEXT:
                raise ValueError(f"texts of nested elements take more than {MOST_TEXT} characters")

    def _close_down_to(self, targets, barriers) -> None:
        """End the outermost open target that no barrier hides, with all it holds."""
        if not any(self.open_tags[tag] for tag in targets):
            return
        depth = None
        for index in range(len(self.stack) - 1, -1, -1):
            tag = self.stack[index][0]
            if tag in targets:
                depth = index
            elif tag in barriers:
                break
        if depth is not None:
            while len(self.stack) > depth:
                self._pop()

    def _imply_ends(self, tag: str) -> None:
        if tag in _PARAGRAPH_ENDS and self.open_tags["p"]:
            self._close_down_to({"p"}, _BARRIER)
        if tag in _IMPLIED_ENDS:
            self._close_down_to(*_IMPLIED_ENDS[tag])

    def _end(self, tag: str) -> None:
        if not self.open_tags[tag]:
            return
        rank = _END_RANK[tag]
        for index in range(len(self.stack) - 1, -1, -1):
            open_tag = self.stack[index][0]
            if open_tag == tag:
                while len(self.stack) > index:
                    self._pop()
                return
            if _END_RANK[open_tag] > rank:
                return


_OVERFLOW = pa.map_(pa.string(), pa.struct([("json", pa.bool_()), ("segments", pa.list_(pa.string()))]))


class _Columns:
    """Collects the pages of one Arrow batch as flat columns and offsets."""

    def __init__(self) -> None:
        self.decoder = _json_decoder()
        self.errors: list[str | None] = []
        self.offsets: dict[str, list[int]] = {name: [0] for name in ("scripts", "nodes", "hrefs", "attrs")}
        self.scripts: list[tuple] = []
        self.nodes: list[list] = []
        self.attrs: list[tuple[str, str]] = []
        self.hrefs: list[str] = []

    def add(self, html: str | None, markup: bool, links: bool) -> None:
        error = None
        if html is not None:
            try:
                page = _Page(html, markup, links, self.decoder)
                self.scripts += page.scripts
                self.hrefs += page.hrefs
                self.nodes += page.nodes
                for node in page.nodes:
                    self.attrs += node[2]
                    self.offsets["attrs"].append(len(self.attrs))
            except (ValueError, RecursionError, MemoryError) as failure:
                error = str(failure) or type(failure).__name__
        self.errors.append(error)
        self.offsets["scripts"].append(len(self.scripts))
        self.offsets["nodes"].append(len(self.nodes))
        self.offsets["hrefs"].append(len(self.hrefs))

    def _list(self, name: str, values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(self.offsets[name], pa.int32()), values)

    def to_arrow(self) -> pa.Array:
        def column(rows, index, kind):
            return pa.array([row[index] for row in rows], kind)

        text, number = pa.string(), pa.int32()
        scripts = pa.StructArray.from_arrays(
            [
                column(self.scripts, 0, number),
                column(self.scripts, 1, text),
                column(self.scripts, 2, text),
                pa.array([script[3] and [*script[3].items()] for script in self.scripts], _OVERFLOW),
            ],
            ["pos", "text", "json", "overflow"],
        )
        attrs = pa.MapArray.from_arrays(
            pa.array(self.offsets["attrs"], number), column(self.attrs, 0, text), column(self.attrs, 1, text)
        )
        nodes = pa.StructArray.from_arrays(
            [
                column(self.nodes, 0, number),
                column(self.nodes, 1, text),
                attrs,
                column(self.nodes, 3, number),
                column(self.nodes, 4, number),
                column(self.nodes, 5, text),
                column(self.nodes, 6, text),
            ],
            ["pos", "tag", "attrs", "scope", "typed", "vocab", "text"],
        )
        return pa.StructArray.from_arrays(
            [
                pa.array(self.errors, text),
                self._list("scripts", scripts),
                self._list("nodes", nodes),
                self._list("hrefs", pa.array(self.hrefs, text)),
            ],
            ["error", "scripts", "nodes", "hrefs"],
        )


@cache
def _reader(markup: bool, links: bool):
    @F.arrow_udf(schemas.DOCUMENT)
    def read(html: pa.Array) -> pa.Array:
        batch = _Columns()
        for page in html.to_pylist():
            batch.add(page, markup, links)
        return batch.to_arrow()

    return read


def read_document(html: Column, markup: bool = True, links: bool = False) -> Column:
    """The elements of a page that matter, as `schemas.DOCUMENT`; pages that hold none skip the Python stage's work."""
    hints = (MARKUP_HINTS if markup else ()) + (LINK_HINTS if links else ())
    read = F.when(F.lower(html).rlike("|".join(hints)), html) if hints else F.lit(None).cast("string")
    if markup:
        # A type written with character references is only seen once it is read. Texts are folded only where no block shows.
        read = F.when(html.contains(BLOCK_HINT) | (html.contains("&") & html.rlike(ESCAPED_TYPE)), html).otherwise(read)
    return _reader(markup, links)(read)
