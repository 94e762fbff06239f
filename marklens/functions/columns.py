"""Column helpers that keep per-row work inside Catalyst expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The characters Python's str.strip() removes.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    + "".join(map(chr, range(0x2000, 0x200B)))
    + "\u2028\u2029\u202f\u205f\u3000"
)


def built_once(build: Callable[..., Column]) -> Callable[..., Column]:
    """Keep what `build` returns, per arguments, for as long as the JVM behind it lives.

    A large expression takes thousands of small calls into the JVM to put together; the finished column can be used
    in any number of queries.
    """
    built: dict[tuple, Column] = {}

    @wraps(build)
    def get(*key):
        slot = (SparkContext._gateway, *key)
        if slot not in built:
            built[slot] = build(*key)
        return built[slot]

    return get


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once per row and use it any number of times in `body`.

    The value is the start of a fold over nothing, and `body` its finish. An entry taken out of a transformed array
    would do as well, but asks for the type of all of `body` anew for each row.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda bound, _: bound, body)


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def texts(values: Iterable[str]) -> Column:
    """A constant array of strings."""
    values = list(values)
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def comma_parts(text: Column) -> Column:
    return F.transform(F.split(text, ","), strip)


def first_comma_part(text: Column) -> Column:
    return strip(F.substring_index(text, ",", 1))


def none_if_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def split_runs(ordered: Column, starts_run: Callable[[Column, Column], Column]) -> Column:
    """Cut an array into consecutive runs; `starts_run(previous, current)` is true where a new run begins.

    Linear in the size of the array, and without a shuffle: the grouping of one page's own elements needs no
    exchange because they already sit in one row.
    """

    def cut(items: Column) -> Column:
        positions = F.when(F.size(items) > 0, F.sequence(F.lit(1), F.size(items))).otherwise(
            F.array().cast("array<int>")
        )
        starts = F.filter(
            positions, lambda i: (i == 1) | starts_run(F.get(items, i - 2), F.get(items, i - 1))
        )
        return let(
            starts,
            lambda begin: F.transform(
                begin,
                lambda p, j: F.slice(items, p, F.coalesce(F.get(begin, j + 1), F.size(items) + 1) - p),
            ),
        )

    return let(ordered, cut)


def places_below(
    ordered: Column, size: Column | int, value: Column, most: int = 1 << 30, inclusive: bool = False
) -> Column:
    """How many entries of an ascending array of `size` are less than the value, or not greater, by bisection.

    Takes as many steps as `most`, a bound of the size, has bits.
    """
    if isinstance(size, int):
        most, size = max(size, 1), F.lit(size)
    steps = F.array(*[F.lit(1 << bit) for bit in reversed(range(most.bit_length()))])

    def step(place: Column, width: Column) -> Column:
        ahead = place + width
        entry = F.get(ordered, ahead - 1)
        return F.when((ahead <= size) & (entry <= value if inclusive else entry < value), ahead).otherwise(place)

    return F.aggregate(steps, F.lit(0), step)


def entries_of(array: Column | str) -> Column:
    """The array as the input of explode or inline.

    Of a bare column Catalyst infers that the array is not empty, and pushes that filter below the projection that
    makes the array, so all of it would be computed twice. It infers nothing of a CASE.
    """
    return F.when(F.size(array) > 0, F.col(array) if isinstance(array, str) else array)


def keep_rows(df: DataFrame, condition: Column) -> DataFrame:
    """Filter on a column that is expensive to compute, computing it once.

    A plain filter would be pushed below the projection that makes the column, so extraction and validation would
    run once for the filter and once more for the output. A one-element generator stays where it is.
    """
    row = F.struct(*[F.col(f"`{name}`") for name in df.columns])
    return df.select(F.inline(F.when(condition, F.array(row))))


def planned_once(union: DataFrame) -> DataFrame:
    """A union below which no later projection is pushed: large expressions would be planned anew for each of its parts.

    Projections do not pass a filter that is not deterministic; this one keeps every row.
    """
    return union.filter(F.monotonically_increasing_id() >= 0)
