"""Items from page elements: JSON-LD, Microdata and RDFa, all inside the page's own row.

Every function here maps a column of `read_document` to an array of items. A page's elements already sit in one row,
so grouping them into items needs no shuffle, and a page with very many elements is no hot key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas
from ..functions import variants as V
from ..functions.columns import let, none_if_empty, split_runs
from ..functions.overflow import BEGINNING, MOST_BYTES, MOST_MEMBER, bytes_of, large_value, no_overflow
from ..rules import JSON_LD, MALFORMED, MICRODATA, RDFA, UNKNOWN


def _no_items() -> Column:
    return F.array().cast(schemas.ITEMS)


def _item(
    kind: str, name: Column, properties: Column, raw: Column, context: Column, overflow: Column, in_graph: bool = False
) -> Column:
    return F.struct(
        F.lit(kind).alias("schema_format"),
        name.alias("schema_type"),
        properties.alias("properties"),
        raw.alias("raw"),
        context.alias("context"),
        F.lit(in_graph).alias("is_graph_item"),
        overflow.alias("overflow"),
    )


def _nothing() -> Column:
    return F.lit(None).cast("string")


def _no_raw() -> Column:
    return F.lit(None).cast("variant")


# --- JSON-LD ------------------------------------------------------------------------------------


def _jsonld_item(
    entry: Column, members: Column, context: Column, overflow: Column, in_graph: bool, with_raw: bool
) -> Column:
    """Item of an object, given with its members as a map."""
    kept = F.map_filter(members, lambda name, _: ~name.startswith("@") | (name == "@id"))
    return _item(
        JSON_LD,
        F.coalesce(V.joined_text(members["@type"], ", "), F.lit(UNKNOWN)),
        kept,
        entry if with_raw else _no_raw(),
        context,
        overflow,
        in_graph,
    )


def _malformed_item(text: Column, with_raw: bool) -> Column:
    """The text is the item's raw; one too large for that is its overflow, without a name."""
    large = F.octet_length(text) > MOST_BYTES
    raw = V.to_variant(F.when(large, F.left(text, F.lit(BEGINNING))).otherwise(text)) if with_raw else _no_raw()
    overflow = F.when(large, F.create_map(F.lit(""), large_value(text, F.lit(False)))) if with_raw else no_overflow()
    return _item(JSON_LD, F.lit(MALFORMED), F.create_map().cast("map<string,variant>"), raw, _nothing(), overflow)


def _block_items(block: Column, overflow: Column, with_raw: bool) -> Column:
    """Items of one parsed block: an object, each object of a list, or each object of an object's @graph list.

    A block with overflow has one item. An object's members are taken out once: that they are there tells that it is an
    object, and type, context, graph and properties are read from them.
    """

    def of_object(top: Column, found: Callable[[Column], Column]) -> Column:
        return let(V.as_object(top), lambda members: F.when(members.isNotNull(), found(members)).otherwise(_no_items()))

    def object_items(top: Column) -> Column:
        def graph_items(graph: Column, context: Column) -> Column:
            return F.flatten(
                F.transform(
                    graph,
                    lambda entry: of_object(
                        entry, lambda members: F.array(_jsonld_item(entry, members, context, overflow, True, with_raw))
                    ),
                )
            )

        def items(members: Column) -> Column:
            context = V.joined_text(members["@context"], " ")
            return F.when(
                ~F.map_contains_key(members, "@graph"), F.array(_jsonld_item(top, members, context, overflow, False, with_raw))
            ).otherwise(
                let(
                    V.as_list(members["@graph"]),
                    lambda graph: F.when(
                        graph.isNotNull(), let(context, lambda shared: graph_items(graph, shared))
                    ).otherwise(F.array(_jsonld_item(top, members, context, overflow, False, with_raw))),
                )
            )

        return of_object(top, items)

    return F.flatten(F.transform(F.coalesce(V.as_list(block), F.array(block)), object_items))


def jsonld_items(scripts: Column, with_raw: bool = False) -> Column:
    """Items of the page's ld+json scripts; a block that is no JSON becomes one marker item.

    Only the reader decides what is no JSON: it sends such a block as `text`. A block sent as `json` is valid, so one
    that the JVM should still refuse is an object of which nothing is known, not a malformed one.
    """

    def script_items(script: Column) -> Column:
        return F.when(script["json"].isNull(), F.array(_malformed_item(script["text"], with_raw))).otherwise(
            let(
                F.coalesce(F.try_parse_json(script["json"]), F.parse_json(F.lit("{}"))),
                lambda block: _block_items(block, script["overflow"], with_raw),
            )
        )

    return F.flatten(F.transform(scripts, script_items)).cast(schemas.ITEMS)


# --- Microdata and RDFa: elements grouped by their scope ----------------------------------------


def _header(scope: Column, name: Column, context: Column) -> Column:
    """First row of a scope's run: what the scope is."""
    return F.struct(
        scope.alias("scope"),
        F.lit(0).alias("rank"),
        F.lit("").alias("name"),
        scope.alias("pos"),
        name.alias("value"),
        context.alias("context"),
    )


def _member(scope: Column, name: Column, pos: Column, value: Column) -> Column:
    """A property value that belongs to a scope."""
    return F.struct(
        scope.alias("scope"),
        F.lit(1).alias("rank"),
        name.alias("name"),
        pos.alias("pos"),
        value.alias("value"),
        _nothing().alias("context"),
    )


def _runs(members: Column) -> Column:
    """Members of one scope, sorted by name and position, as runs of one name, in document order of their firsts."""
    runs = split_runs(members, lambda before, now: before["name"] != now["name"])
    # Position leads, so properties come in document order; names are unique, so values are never compared.
    firsts = F.array_sort(
        F.transform(runs, lambda run: F.struct(run[0]["pos"].alias("pos"), run.alias("run")))
    )
    return F.transform(firsts, lambda first: first["run"])


def _values(run: Column) -> Column:
    return F.transform(run, lambda m: m["value"])


def _property_map(runs: Column) -> Column:
    """A single value stays a text, repeats become a list."""

    def entry(run: Column) -> Column:
        value = F.when(F.size(run) == 1, V.to_variant(run[0]["value"])).otherwise(V.to_variant(_values(run)))
        return F.struct(run[0]["name"].alias("key"), value.alias("value"))

    return F.map_from_entries(F.transform(runs, entry))


def _is_large(run: Column) -> Column:
    return bytes_of(_values(run)) > MOST_MEMBER


def _beginnings(runs: Column) -> Column:
    """The runs, with the values of large ones cut to what stands for them."""

    def cut(run: Column) -> Column:
        short = F.transform(run, lambda m: m.withField("value", F.left(m["value"], F.lit(BEGINNING))))
        return F.when(_is_large(run), short).otherwise(run)

    return F.transform(runs, cut)


def _overflow_map(runs: Column) -> Column:
    """The whole values of large runs: a single one as it is, repeats as a JSON list."""

    def entry(run: Column) -> Column:
        single = F.size(run) == 1
        text = F.when(single, run[0]["value"]).otherwise(F.to_json(_values(run)))
        return F.struct(run[0]["name"].alias("key"), large_value(text, ~single).alias("value"))

    return F.map_from_entries(F.transform(F.filter(runs, _is_large), entry))


def _scoped_items(rows: Column, kind: str, name_of, raw_of, with_raw: bool) -> Column:
    """Items from scope headers and members, in document order of the scopes.

    Sorting puts each header directly before its members, so one linear pass finds the groups. Members of a scope
    without a header (an untyped one) are dropped with it.
    """
    runs = split_runs(F.array_sort(rows), lambda before, now: before["scope"] != now["scope"])
    headed = F.filter(runs, lambda run: run[0]["rank"] == 0)

    def build(run: Column) -> Column:
        header = run[0]
        members = F.slice(run, F.lit(2), F.greatest(F.size(run) - 1, F.lit(1)))

        def item(runs: Column, overflow: Column) -> Column:
            return let(
                _property_map(runs),
                lambda properties: _item(
                    kind,
                    name_of(header),
                    properties,
                    F.to_variant_object(raw_of(header, properties)) if with_raw else _no_raw(),
                    header["context"],
                    overflow,
                ),
            )

        fits = bytes_of(_values(members)) <= MOST_BYTES
        return let(
            _runs(members),
            lambda runs: let(
                F.when(fits, runs).otherwise(_beginnings(runs)),
                lambda short: item(short, F.when(~fits, _overflow_map(runs))),
            ),
        )

    return F.transform(headed, build).cast(schemas.ITEMS)


def _attr(node: Column, name: str) -> Column:
    return node["attrs"][name]


def _given(node: Column, name: str) -> Column:
    """The attribute is there and not empty."""
    return F.coalesce(_attr(node, name) != "", F.lit(False))


def microdata_type(itemtype: Column) -> Column:
    """Last path segment of each type URL; whitespace alone is returned as it is."""
    urls = F.filter(F.split(itemtype, r"(?U)\s+"), lambda t: t != "")
    names = F.array_join(F.transform(urls, lambda t: F.substring_index(t, "/", -1)), ", ")
    return F.when(F.size(urls) > 0, names).otherwise(itemtype)


def microdata_value(node: Column) -> Column:
    tag = node["tag"]
    text = F.coalesce(node["text"], F.lit(""))

    def attribute(name: str) -> Column:
        return F.coalesce(_attr(node, name), F.lit(""))

    return (
        F.when(tag == "meta", attribute("content"))
        .when(tag.isin("img", "audio", "video", "source"), attribute("src"))
        .when(tag.isin("a", "link"), attribute("href"))
        .when(tag == "time", F.coalesce(_attr(node, "datetime"), text))
        .when(tag == "data", F.coalesce(_attr(node, "value"), text))
        .otherwise(text)
    )


def microdata_items(nodes: Column, with_raw: bool = False) -> Column:
    """One item per itemscope with an itemtype; a property belongs to its nearest itemscope ancestor."""
    headers = F.transform(
        F.filter(nodes, lambda n: _attr(n, "itemscope").isNotNull() & _given(n, "itemtype")),
        lambda n: _header(n["pos"], _attr(n, "itemtype"), _nothing()),
    )
    members = F.transform(
        F.filter(nodes, lambda n: n["scope"].isNotNull() & _given(n, "itemprop")),
        lambda n: _member(n["scope"], _attr(n, "itemprop"), n["pos"], microdata_value(n)),
    )
    return _scoped_items(
        F.concat(headers, members),
        MICRODATA,
        lambda header: microdata_type(header["value"]),
        lambda header, properties: F.struct(header["value"].alias("itemtype"), properties.alias("properties")),
        with_raw,
    )


def rdfa_value(node: Column) -> Column:
    return F.coalesce(_attr(node, "content"), _attr(node, "href"), node["text"], F.lit(""))


def rdfa_items(nodes: Column, with_raw: bool = False) -> Column:
    """One item per typeof element; without any, all property elements of the page form one untyped item."""
    typed = F.filter(nodes, lambda n: _attr(n, "typeof").isNotNull())
    properties = F.filter(nodes, lambda n: _given(n, "property"))

    def value_of(node: Column, scope: Column) -> Column:
        return _member(scope, _attr(node, "property"), node["pos"], rdfa_value(node))

    def typed_items(scopes: Column, carriers: Column) -> Column:
        headers = F.transform(
            scopes,
            lambda n: _header(
                n["pos"],
                _attr(n, "typeof"),
                none_if_empty(F.coalesce(none_if_empty(_attr(n, "vocab")), n["vocab"])),
            ),
        )
        own = F.transform(
            F.filter(carriers, lambda n: _attr(n, "typeof").isNotNull()), lambda n: value_of(n, n["pos"])
        )
        inner = F.transform(
            F.filter(carriers, lambda n: n["typed"].isNotNull()), lambda n: value_of(n, n["typed"])
        )
        return _scoped_items(
            F.concat(headers, own, inner),
            RDFA,
            lambda header: header["value"],
            lambda header, found: F.struct(
                header["value"].alias("typeof"),
                F.coalesce(header["context"], F.lit("")).alias("vocab"),
                found.alias("properties"),
            ),
            with_raw,
        )

    def untyped_item(carriers: Column) -> Column:
        page = F.lit(0)
        rows = F.concat(
            F.array(_header(page, F.lit(UNKNOWN), _nothing())), F.transform(carriers, lambda n: value_of(n, page))
        )
        return _scoped_items(
            rows,
            RDFA,
            lambda header: header["value"],
            lambda _, found: F.struct(found.alias("properties")),
            with_raw,
        )

    return let(
        properties,
        lambda carriers: let(
            typed,
            lambda scopes: F.when(F.size(scopes) > 0, typed_items(scopes, carriers))
            .when(F.size(carriers) > 0, untyped_item(carriers))
            .otherwise(_no_items()),
        ),
    )


def all_items(document: Column, with_raw: bool = False) -> Column:
    """Items of a page in the order JSON-LD, Microdata, RDFa."""
    nodes = document["nodes"]
    no_items = _no_items()
    return F.concat(
        F.when(F.size(document["scripts"]) > 0, jsonld_items(document["scripts"], with_raw)).otherwise(no_items),
        F.when(
            F.size(nodes) > 0, F.concat(microdata_items(nodes, with_raw), rdfa_items(nodes, with_raw))
        ).otherwise(no_items),
    )
