"""The trie of conversation prefixes by truncation peeling, from the deepest turns up.

Conversations are sequences of turns. Each distinct beginning of one is a node; its members are the conversations that
begin so. Peeling starts at the greatest depth: conversations that end there become nodes, equal ones merged; each node
is done once its depth is reached, gives its row, and is stripped of its last turn, which merges it with its siblings
and with the conversations that end one turn earlier. One pass finds the nodes and sums up their subtrees.

1. Every turn becomes 16 bytes, every conversation the bytes of its turns, and conversations are sorted by these bytes
   and dealt to tasks in ranges. So a node's members stand together, whatever their number.
2. A task peels its range in blocks of bounded size. A node whose members might go on in a neighbouring block is a
   beginning of the block's first or last conversation; all others are complete and final.
3. The open nodes, at most two paths per block, are merged by key, and what their rows lack (children, subtree sums, ids of
   their parents) comes from group-bys and joins on this small table, not on the conversations.

A range may end inside a group of equal conversations or inside a first turn that a third of them share, so neither is
a hot key, and the depth of a conversation costs no more jobs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import cut_lineage
from .common import split_join, table

# Most turns of other conversations that a conversation may begin with, and ids that share one source of them.
HEADS = 4
FAMILY = 20
TURN = 16
# A block is peeled once it holds this many turns; the longest conversation may exceed it.
BLOCK_TURNS = 200_000


def conversations_of(turns: DataFrame) -> DataFrame:
    """`conv_id` and its `turns`, (key of 16 bytes, words) in order: by turn, NULL first, then role, then text's key."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    content = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    slim = turns.filter("conv_id IS NOT NULL").select(
        "conv_id",
        F.struct(
            F.col("turn"), role.alias("role"),
            F.substring(F.unhex(F.sha2(content.cast("binary"), 256)), 1, TURN).alias("key"),
            F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).alias("words"),
        ).alias("turn"),
    )
    return slim.groupBy("conv_id").agg(
        F.transform(F.sort_array(F.collect_list("turn")), lambda t: F.struct(t["key"].alias("key"), t["words"].alias("words"))).alias("turns")
    )


def rebuilt(turns: DataFrame, family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """Conversations with shared beginnings: the first h turns of the family's first one, then their own after h.

    h is the unsigned CRC-32 of the decimal id modulo `heads`; the family's first id is the id less its remainder.
    """
    own = cut_lineage(conversations_of(turns))
    first = own.filter(F.col("conv_id") % family == 0).select(
        F.col("conv_id").alias("first_id"), F.slice("turns", 1, heads - 1).alias("head")
    )
    count = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    dealt = own.withColumn("h", count.cast("int")).withColumn("first_id", F.col("conv_id") - F.col("conv_id") % family)
    return dealt.join(first, "first_id", "left").select(
        "conv_id",
        F.concat(
            F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", 1, 0)),
            F.slice("turns", F.col("h") + 1, F.size("turns")),
        ).alias("turns"),
    )


class Node:
    """A beginning of conversations while it is peeled: what those that end there and its children add up to."""

    __slots__ = ("parent", "words", "depth", "members", "least", "ends", "children", "leaves", "saved", "key")

    def __init__(self, parent: Node | None, words: int) -> None:
        self.parent, self.words = parent, words
        self.depth = parent.depth + 1 if parent else 0
        self.members = self.children = self.leaves = self.saved = 0
        self.least: int | None = None
        self.ends: list[int] = []
        self.key: bytes | None = None  # of open nodes

    def join(self, members: int, least: int) -> None:
        self.members += members
        self.least = least if self.least is None else min(self.least, least)


def _leveled(block: list[tuple[int, bytes, list[int]]]) -> list[list[Node]]:
    """The distinct beginnings of conversations sorted by their keys, by depth; each has those that end there."""
    root = Node(None, 0)
    levels, path, before = [[root]], [root], b""
    opened = []
    for conv_id, keys, words in block:
        depth, shared = len(keys) // TURN, 0
        most = min(depth, len(path) - 1)
        while shared < most and keys[shared * TURN : (shared + 1) * TURN] == before[shared * TURN : (shared + 1) * TURN]:
            shared += 1
        del path[shared + 1 :]
        for number in words[shared:]:
            node = Node(path[-1], number)
            if node.depth == len(levels):
                levels.append([])
            levels[node.depth].append(node)
            path.append(node)
        path[-1].ends.append(conv_id)
        before = keys
        if not opened:
            opened.append((keys, [*path]))
    for keys, nodes in (*opened, (before, path)):
        digest = xxhash.xxh3_128()
        for node in nodes:
            if node.depth:
                digest.update(keys[(node.depth - 1) * TURN : node.depth * TURN])
            node.key = digest.digest()
    return levels


def peeled(block: list[tuple[int, bytes, list[int]]]) -> Iterator[Node]:
    """The nodes of (id, keys of the turns, words of each) sorted by keys, deepest first.

    Nodes on the paths of the first and the last conversation are open and have a key. The `children`, `leaves` and
    `saved` of these count complete nodes only, at any depth below them, until they are merged with other blocks'.
    """
    for level in reversed(_leveled(block)):
        for node in level:
            if node.ends:  # conversations that end here join what has been peeled down to here
                node.join(len(node.ends), node.ends[0])
            if node.key is None:
                node.saved += (node.members - 1) * node.words
                node.leaves += not node.children
            yield node
            if (parent := node.parent) is not None:  # strip the last turn
                parent.join(node.members, node.least)
                parent.children += node.key is None
                parent.leaves += node.leaves
                parent.saved += node.saved


NODES = (
    "block bigint, key binary, parent_key binary, conv_id bigint, parent_conv_id bigint, depth bigint, words bigint, "
    "n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends string, ends_sha256 string"
)


def _rows_of(block: list[tuple[int, bytes, list[int]]], number: int) -> Iterator[tuple]:
    for node in [*peeled(block)]:
        ends = ",".join(map(str, node.ends))
        parent = node.parent
        yield (
            number, node.key, parent.key if parent else None, node.least, parent.least if parent else None, node.depth,
            node.words, node.members, node.children, node.leaves, node.saved,
            ends if node.key is not None and node.ends else None,
            hashlib.sha256(ends.encode()).hexdigest() if node.key is None else None,
        )


def _peeled_in_tasks(conversations: DataFrame, block_turns: int) -> DataFrame:
    """The nodes of each block, as `NODES`."""
    keys = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["key"])), ""))
    words = F.transform("turns", lambda t: t["words"])
    slim = conversations.select(F.col("conv_id").cast("bigint"), keys.alias("keys"), words.alias("words"))

    arrow = to_arrow_schema(StructType.fromDDL(NODES))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32

        def emitted(block: list, at: int) -> Iterator[pa.RecordBatch]:
            found = [*_rows_of(block, at)]
            for begin in range(0, len(found), 10_000):
                columns = zip(*found[begin : begin + 10_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        block, size = [], 0
        for batch in batches:
            for conversation in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                block.append(conversation)
                size += len(conversation[2]) + 1
                if size >= block_turns:
                    yield from emitted(block, number)
                    block, size, number = [], 0, number + 1
        if block:
            yield from emitted(block, number)

    ranged = slim.repartitionByRange("keys", "conv_id").sortWithinPartitions("keys", "conv_id")
    return cut_lineage(ranged.mapInArrow(rows, NODES))


def _joined_ends(opened: DataFrame) -> DataFrame:
    """`key` and `ends_sha256` of open nodes at which conversations end; the ids pass by block by block, in order."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = (pair for batch in batches for pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        for key, own in groupby(pairs, key=lambda pair: pair[0]):
            digest = hashlib.sha256(next(own)[1].encode())
            for _, ends in own:
                digest.update(b"," + ends.encode())
            yield pa.RecordBatch.from_pydict({"key": pa.array([key], pa.binary()), "ends_sha256": [digest.hexdigest()]})

    parts = opened.filter("ends IS NOT NULL").select("key", "ends", "block")
    return parts.repartition("key").sortWithinPartitions("key", "block").mapInArrow(rows, "key binary, ends_sha256 string")


def _sums_below(opened: DataFrame, merged: DataFrame) -> DataFrame:
    """`key`, `saved`, `leaves`: what the open nodes of each subtree, its top included, add to it.

    A node is counted by the first block that has it; within a block, sums are handed from each node to its parent.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (row for batch in batches for row in batch.to_pylist())
        for _, own in groupby(held, key=lambda row: row["block"]):
            sums: dict[bytes, list[int]] = {}
            for row in own:  # deepest first
                first = row["owner"] == row["block"]
                total = sums.setdefault(row["key"], [0, 0])
                total[0] += row["own_saved"] if first else 0
                total[1] += row["own_leaf"] if first else 0
                if row["parent_key"] is not None:
                    above = sums.setdefault(row["parent_key"], [0, 0])
                    above[0] += total[0]
                    above[1] += total[1]
            yield pa.RecordBatch.from_pydict({
                "key": pa.array([*sums], pa.binary()),
                "saved": pa.array([total[0] for total in sums.values()], pa.int64()),
                "leaves": pa.array([total[1] for total in sums.values()], pa.int64()),
            })

    placed = split_join(
        opened.select("block", "key", "parent_key", "depth"), merged.select("key", "owner", "own_saved", "own_leaf"), ["key"]
    )
    by_block = placed.repartition("block").sortWithinPartitions("block", F.col("depth").desc())
    return by_block.mapInArrow(rows, "key binary, saved bigint, leaves bigint").groupBy("key").agg(
        F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves")
    )


def _merged(opened: DataFrame) -> DataFrame:
    """One row per open node, complete: `key`, `parent_key` and the columns of the result but for the parent's id."""
    totals = opened.groupBy("key").agg(
        F.max("parent_key").alias("parent_key"), F.max("depth").alias("depth"), F.max("words").alias("words"),
        F.min("conv_id").alias("conv_id"), F.min("block").alias("owner"),
        *[F.sum(name).alias(name) for name in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
    )
    children = totals.filter("parent_key IS NOT NULL").groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("more"))
    merged = cut_lineage(
        totals.join(children, "key", "left")
        .withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0)))
        .withColumn("own_saved", (F.col("n_convs") - 1) * F.col("words"))
        .withColumn("own_leaf", (F.col("n_children") == 0).cast("bigint"))
    )
    return merged.join(_sums_below(opened, merged), "key").join(_joined_ends(opened), "key", "left").select(
        "key", "parent_key", "conv_id", "depth", "n_convs", "n_children",
        (F.col("n_leaves") + F.col("leaves")).alias("n_leaves"),
        (F.col("saved_tokens") + F.col("saved")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"),
    )


RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def prefix_trie(conversations: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """One row per node of conversations given as `conv_id` and `turns` (`key` of 16 bytes, `words`).

    `conv_id` is the node's smallest member, `parent_conv_id` its parent's, `n_convs` its members, `n_children` its
    children; `n_leaves` counts the childless nodes and `saved_tokens` adds up (members - 1) * words of the last turn
    over its subtree, itself included; `ends_sha256` digests the ids that end there, ascending and comma-joined.
    """
    nodes = _peeled_in_tasks(conversations, block_turns)
    merged = cut_lineage(_merged(nodes.filter("key IS NOT NULL")))
    parents = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("merged_parent"))
    complete = nodes.filter("key IS NULL")
    inner = complete.filter("parent_key IS NULL").select(*RESULT)
    outer = split_join(complete.filter("parent_key IS NOT NULL").drop("parent_conv_id"), parents, ["parent_key"])
    opened = merged.join(parents, "parent_key", "left")
    return inner.unionByName(outer.withColumnRenamed("merged_parent", "parent_conv_id").select(*RESULT)).unionByName(
        opened.withColumnRenamed("merged_parent", "parent_conv_id").select(*RESULT)
    )


def conversation_trie(turns: DataFrame, family: int = FAMILY, heads: int = HEADS, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """The trie of the rebuilt conversations of `conv_id`, `turn`, `role`, `text`.

    Turns stand in the order of `turn`, NULL first, ties in the order of role and then of their text's digest; repeated
    rows are repeated turns. A NULL role or text is empty. Rows without a `conv_id` belong to no conversation and are
    left out. Other columns do not matter. Without conversations there are no nodes, not even the root. A conversation's
    digests, 20 bytes a turn, must fit a row; its texts need not.
    """
    return prefix_trie(rebuilt(turns, family, heads), block_turns)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


# CRC-32 of the id's digits byte by byte and bit by bit; then every beginning of a rebuilt conversation as a list.
OP11_SQL = r"""
WITH ordered AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, role, text) AS own
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), dealt AS (
  SELECT conv_id, own, conv_id - conv_id % 20 AS first_id,
    (xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(str_split(conv_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
      lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
        lambda c, bit: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)), 4294967295) % 4)::INT AS h
  FROM ordered
), rebuilt AS (
  SELECT d.conv_id, list_concat(coalesce(f.own[1:d.h], []), d.own[d.h + 1:]) AS turns
  FROM dealt d LEFT JOIN ordered f ON f.conv_id = d.first_id
), beginnings AS (
  SELECT conv_id, len(turns) AS size, turns[1:d] AS prefix, d AS depth FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE size = depth), '')) AS ends_sha256,
    CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(prefix[depth].text, '[^ 	-
]+')) END AS words
  FROM beginnings GROUP BY prefix, depth
), parented AS (
  SELECT n.*, p.conv_id AS parent_conv_id, count(c.depth) AS n_children
  FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.prefix = n.prefix[1:n.depth - 1]
    LEFT JOIN (SELECT depth, prefix[1:depth - 1] AS above FROM nodes WHERE depth > 0) c ON c.depth = n.depth + 1 AND c.above = n.prefix
  GROUP BY ALL
), sums AS (
  SELECT prefix[1:d] AS prefix, d AS depth, sum((n_children = 0)::BIGINT) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens
  FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM parented) GROUP BY ALL
)
SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs, n_children, n_leaves::BIGINT AS n_leaves,
  saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM parented JOIN sums USING (prefix, depth)
"""
