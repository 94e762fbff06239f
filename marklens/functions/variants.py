"""Tests and conversions on VARIANT values that follow Python's view of JSON data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import let


def as_list(value: Column) -> Column:
    """The entries of a JSON array, NULL for anything else."""
    return F.try_variant_get(value, "$", "array<variant>")


def as_object(value: Column) -> Column:
    """The members of a JSON object, NULL for anything else."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def is_object(value: Column) -> Column:
    return as_object(value).isNotNull()


def as_text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def is_text(value: Column) -> Column:
    return F.schema_of_variant(value) == "STRING"


def member(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f'$["{name}"]', "variant")


def to_variant(value: Column) -> Column:
    return value.cast("variant")


def is_truthy(value: Column) -> Column:
    """Python truthiness: absent, null, "", 0, false, [] and {} are false."""

    def scalar(kind: Column) -> Column:
        return (
            F.when(kind == "VOID", F.lit(False))
            .when(kind == "STRING", as_text(value) != "")
            .when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))
            .otherwise(F.coalesce(F.try_variant_get(value, "$", "double") != 0, F.lit(True)))
        )

    return F.when(value.isNull(), F.lit(False)).otherwise(
        F.coalesce(
            F.array_size(as_list(value)) > 0,
            F.array_size(F.map_keys(as_object(value))) > 0,
            let(F.schema_of_variant(value), scalar),
        )
    )


def python_text(value: Column) -> Column:
    """What str() shows for a JSON scalar; lists and objects show as JSON text."""
    return let(
        F.schema_of_variant(value),
        lambda kind: F.when(kind == "STRING", as_text(value))
        .when(kind == "VOID", F.lit("None"))
        .when(kind == "BOOLEAN", F.initcap(as_text(value)))
        .when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), F.to_json(value))
        .otherwise(as_text(value)),
    )


def joined_text(value: Column, separator: str) -> Column:
    """A scalar as text, a list joined by `separator`; NULL where the result is falsy."""

    def text(bound: Column) -> Column:
        joined = F.array_join(F.transform(as_list(bound), python_text), separator)
        # Most values are plain texts, for which nothing else is asked.
        return F.when(is_text(bound), as_text(bound)).otherwise(
            F.coalesce(joined, F.when(is_truthy(bound), python_text(bound)))
        )

    return let(let(value, text), lambda found: F.when(found != "", found))
