"""Robots rules: which URLs a user agent may fetch."""

from __future__ import annotations

import sys
from functools import cache

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import built_once, entries_of, let, places_below, split_runs, strip
from ..functions.urls import netloc, percent_decode, percent_encode
from ..rules import USER_AGENT
from ..session import cut_lineage

_LINE_ENDS = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"
# What runs in tasks travels with the query, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_PIECES = "array<array<struct<at:string,allow:boolean>>>"
_GROUPS = "array<struct<agents:array<string>,rules:array<struct<path:string,allow:boolean>>>>"


def _parse_line(line: Column) -> Column:
    """A line as `kind` (blank, agent, rule, setting, or NULL for one without meaning), `value` and `allow`."""
    content = strip(F.substring_index(line, "#", 1))
    key = F.lower(strip(F.substring_index(content, ":", 1)))
    value = F.when(content.contains(":"), strip(F.regexp_replace(content, r"^[^:]*:", "")))
    kind = (
        F.when(line == "", "blank")
        .when(value.isNull(), None)
        .when(key == "user-agent", "agent")
        .when(key.isin("allow", "disallow"), "rule")
        .when(key.isin("crawl-delay", "request-rate"), "setting")
    )
    return F.struct(
        kind.alias("kind"),
        percent_decode(value).alias("value"),
        (key == "allow").alias("allow"),
    )


def _rule(line: Column) -> Column:
    """An empty Disallow allows all; a trailing empty query or fragment is dropped."""
    path = F.regexp_replace(F.regexp_replace(line["value"], r"^([^?#]*)\?(?=#|$)", "$1"), "#$", "")
    return F.struct(
        percent_encode(path).alias("path"),
        (line["allow"] | (line["value"] == "")).alias("allow"),
    )


def robots_groups(body: Column) -> Column:
    """Groups of a robots body, in order, each with its agents and rules.

    A group is a run of agent lines and the rule lines after it; a blank line ends it, and rules outside a group or
    groups without any rule count for nothing.
    """
    lines = F.filter(F.transform(F.split(body, _LINE_ENDS, -1), _parse_line), lambda l: l["kind"].isNotNull())
    runs = split_runs(
        lines,
        lambda before, now: (now["kind"] == "blank") | ((now["kind"] == "agent") & (before["kind"] != "agent")),
    )

    def of_kind(run: Column, *kinds: str) -> Column:
        return F.filter(run, lambda line: line["kind"].isin(*kinds))

    groups = F.filter(
        runs, lambda run: (run[0]["kind"] == "agent") & (F.size(of_kind(run, "rule", "setting")) > 0)
    )
    return F.transform(
        groups,
        lambda run: F.struct(
            F.transform(of_kind(run, "agent"), lambda line: line["value"]).alias("agents"),
            F.transform(of_kind(run, "rule"), _rule).alias("rules"),
        ),
    ).cast(_GROUPS)


def agent_rules(groups: Column, user_agent: str = USER_AGENT) -> Column:
    """Rules that bind an agent: of the first group naming it, else of the first `*` group, else NULL."""
    token = user_agent.split("/")[0].lower()
    named = F.filter(
        groups,
        lambda g: ~F.array_contains(g["agents"], "*")
        & F.exists(g["agents"], lambda agent: F.lit(token).contains(F.lower(agent))),
    )
    default = F.filter(groups, lambda g: F.array_contains(g["agents"], "*"))
    return F.coalesce(F.get(named, F.lit(0)), F.get(default, F.lit(0)))["rules"]


# Greater than any character of a percent-encoded path.
_END = "\x7f"
# Places of a piece of the index.
PIECE = 64


def _places(rules: list[dict]) -> list[tuple[str, bool]]:
    """Where the verdict changes along all paths in order: from each place to the next it is the same.

    A rule holds from its path to the last path that starts with it, so rules nest, and the first of those that hold at
    a place decides.
    """
    first: dict[str, tuple[int, bool]] = {}
    for number, rule in enumerate(rules):
        first.setdefault(rule["path"], (number, rule["allow"]))
    places, held = [("", True)], []  # held: rules around the place, each with the first of itself and those around it

    def leave() -> None:
        places.append((held.pop()[0] + _END, held[-1][1][1] if held else True))

    for path in sorted(first):
        while held and not path.startswith(held[-1][0]):
            leave()
        held.append((path, min(first[path], held[-1][1]) if held else first[path]))
        places.append((path, held[-1][1][1]))
    while held:
        leave()
    return places


@cache
def _piece_reader():
    kind = pa.list_(pa.list_(pa.struct([("at", pa.string()), ("allow", pa.bool_())])))

    @F.arrow_udf(_PIECES)
    def read(rules: pa.Array) -> pa.Array:
        found = []
        for own in rules.to_pylist():
            places = [{"at": at, "allow": allow} for at, allow in _places(own)] if own is not None else []
            found.append([places[at : at + PIECE] for at in range(0, len(places), PIECE)])
        return pa.array(found, kind)

    return read


def _wanted_path(url: Column) -> Column:
    """What rules are compared with: the URL's path and query."""
    local = F.regexp_replace(percent_decode(url), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?", "")
    target = percent_encode(F.regexp_replace(F.regexp_replace(local, r"^([^?#]*)\?(?=#|$)", "$1"), "#$", ""))
    return let(target, lambda path: F.when(path == "", F.lit("/")).otherwise(path))


def _verdict(places: Column, wanted: Column) -> Column:
    """What the last place not after the wanted path says; without places a URL is allowed."""
    starts = F.transform(places, lambda place: place["at"])
    at = let(starts, lambda found: places_below(found, F.size(found), wanted, PIECE, inclusive=True))
    return F.coalesce(F.get(places, at - 1)["allow"], F.lit(True))


@built_once
def _rules_of_body(user_agent: str) -> Column:
    return agent_rules(robots_groups(F.col("body")), user_agent)


@built_once
def _wanted() -> Column:
    return _wanted_path(F.col("url"))


@built_once
def _piece_verdict() -> Column:
    return _verdict(F.col("places"), F.col("wanted"))


def robots_rules(robots: DataFrame, user_agent: str = USER_AGENT) -> DataFrame:
    """Rules per host, `host` and `rules`, out of robots documents `host`, `status`, `body`.

    Only documents fetched with status 200 count. Of several for one host the one whose text comes first in order
    counts, whatever the rows' order. Each document is read within its row.
    """
    chosen = robots.filter("status = 200").groupBy("host").agg(F.min("body").alias("body"))
    return chosen.select("host", _rules_of_body(user_agent).alias("rules"))


def rules_index(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rules of each host in pieces: a directory (`host`, `starts`) and the pieces (`host`, `piece`, `places`).

    A URL meets the first places of its host's pieces and then one piece, so rows stay slim whatever the number of
    rules, and a host with many rules and URLs is spread over its pieces.
    """
    # Read twice below; nor can Spark evaluate the reader on top of an aggregate.
    known = cut_lineage(rules.filter("rules IS NOT NULL"))
    cut = cut_lineage(known.select("host", _piece_reader()(F.col("rules")).alias("pieces")))
    directory = cut.select("host", F.transform("pieces", lambda piece: piece[0]["at"]).alias("starts"))
    pieces = cut.select("host", F.posexplode(entries_of("pieces")).alias("piece", "places"))
    return directory, pieces


def with_allowed(urls: DataFrame, host: Column, index: tuple[DataFrame, DataFrame], sent: bool = False) -> DataFrame:
    """Add `allowed` to rows with a `url`, by the rules of `host`; without rules everything is allowed.

    One host may own a large part of all URLs. Spark broadcasts an index that is small as measured; if it is not, it
    splits the hot host, which it does only between two shuffles of the join's own: the second key keeps the shuffle of
    the aggregated rules from being reused. `sent` broadcasts the index in any case, for the rules of one host.
    """
    hint = F.broadcast if sent else lambda df: df
    directory, pieces = index
    row = F.struct(*[F.col(f"`{name}`") for name in urls.columns])
    left = urls.select(row.alias("row"), host.alias("host"), _wanted().alias("wanted")).withColumn("deal", F.xxhash64("host"))
    placed = left.join(hint(directory.withColumn("deal", F.xxhash64("host"))), ["host", "deal"], "left").select(
        "row", "host", "wanted",
        (places_below(F.col("starts"), F.size("starts"), F.col("wanted"), inclusive=True) - 1).alias("piece"),
    )
    found = placed.join(hint(pieces), ["host", "piece"], "left")
    return found.select(*[F.col(f"row.`{name}`") for name in urls.columns], _piece_verdict().alias("allowed"))


def robots_allowed(urls: DataFrame, robots: DataFrame, user_agent: str = USER_AGENT) -> DataFrame:
    """Add `allowed` to a table with a `url`, by the robots document of each URL's host."""
    return with_allowed(urls, netloc(F.col("url")), rules_index(robots_rules(robots, user_agent)))
