"""Values too large for a VARIANT: a map beside an item's properties holds them whole, in segments of text.

A property whose value is in the map keeps its place among the properties, and there its kind: a text stands as the
beginning of the text, a list as a list of as many entries, an object as an object. Rules that read a value read the
whole one here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import variants as V
from .columns import let

# `json` tells JSON text from a plain one.
LARGE = "struct<json:boolean,segments:array<string>>"
OVERFLOW = f"map<string,{LARGE}>"

# Texts of one item of up to this many bytes become VARIANTs, which take 128 MiB each; of an item with more, those above
# the second bound go beside it.
MOST_BYTES = 64 << 20
MOST_MEMBER = 1 << 10
# Characters of a segment, and of the beginning that stands for a text.
SEGMENT = 4 << 20
BEGINNING = 64


def no_overflow() -> Column:
    return F.lit(None).cast(OVERFLOW)


def bytes_of(texts: Column) -> Column:
    return F.aggregate(texts, F.lit(0).cast("bigint"), lambda total, text: total + F.octet_length(text))


def large_value(text: Column, is_json: Column) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.char_length(text), F.lit(1)), F.lit(SEGMENT))
    return F.struct(
        is_json.alias("json"), F.transform(starts, lambda start: F.substring(text, start, SEGMENT)).alias("segments")
    )


def whole(large: Column) -> Column:
    return F.array_join(large["segments"], "")


def text_of(name: Column, value: Column, overflow: Column) -> Column:
    """The whole text of a property whose VARIANT is a text."""
    large = F.try_element_at(overflow, name)
    return F.when(overflow.isNull() | large.isNull(), V.as_text(value)).otherwise(whole(large))


def quoted(text: Column) -> Column:
    """The text as a JSON string of any length."""
    listed = F.to_json(F.array(text))
    return F.when(text.isNull(), F.lit("null")).otherwise(F.substring(listed, F.lit(2), F.length(listed) - 2))


def object_json(members: Column, member: Callable[[Column, Column], Column]) -> Column:
    """A map as a JSON object; `member` gives the JSON of a name and its value."""
    entries = F.transform(F.map_entries(members), lambda e: F.concat(quoted(e["key"]), F.lit(":"), member(e["key"], e["value"])))
    return F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}"))


def member_json(overflow: Column) -> Callable[[Column, Column], Column]:
    """The JSON of a member: from the overflow if it is there, else that of its VARIANT."""

    def json(name: Column, value: Column) -> Column:
        return let(
            F.try_element_at(overflow, name),
            lambda large: F.when(large.isNull(), F.to_json(value)).when(large["json"], whole(large)).otherwise(quoted(whole(large))),
        )

    return json


def item_json(item: Column, url: Column, json_ld: str) -> Column:
    """An item that has overflow as JSON, with all its values whole."""
    whole_member = member_json(item["overflow"])
    properties = object_json(item["properties"], whole_member)

    def raw_member(name: Column, value: Column) -> Column:
        grouped = (item["schema_format"] != json_ld) & (name == "properties")
        return F.when(grouped, properties).otherwise(whole_member(name, value))

    # The source of a malformed block is a text, not an object.
    text = F.coalesce(F.get(F.map_values(item["overflow"]), F.lit(0)), F.lit(None).cast(LARGE))
    raw = (
        F.when(item["raw"].isNull(), F.lit("null"))
        .when(V.is_object(item["raw"]), object_json(V.as_object(item["raw"]), raw_member))
        .otherwise(quoted(whole(text)))
    )
    fields = {
        "schema_format": quoted(item["schema_format"]),
        "schema_type": quoted(item["schema_type"]),
        "properties": properties,
        "raw": raw,
        "source_url": quoted(url),
        "context": quoted(item["context"]),
        "is_graph_item": item["is_graph_item"].cast("string"),
    }
    written = [part for name, value in fields.items() for part in (F.lit(f',"{name}":'), value)]
    return F.concat(F.lit("{"), F.lit(f'"{next(iter(fields))}":'), *written[1:], F.lit("}"))
