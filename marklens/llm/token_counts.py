"""Token counts from flat token files by a separator scan.

A token stream is nothing but token ids in file order, each document closed by an end-of-document id. There is no
index: where documents begin is known only from the separators. Streams are read in blocks that cut documents anywhere.

1. Each block is searched for separators as one array. It yields how many tokens and separators it holds, where its last
   one is, and the lengths of the documents that end in it.
2. A prefix scan over the blocks of a stream gives each block the number of documents before it and the tokens of the
   document that it finds open. The scan has two levels, so a stream of any length is never ordered in one task.
3. The first document that ends in a block gets the open tokens added; what follows the last separator of a stream is a
   document that was not closed.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, scratch_folder
from .common import table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
END_OF_DOCUMENT = 50_256
TOKEN_TYPE = np.dtype("<u2")
# Tokens in a block as it is written, and blocks in a group of the scan's lower level.
BLOCK_TOKENS = 1 << 18
GROUP_BLOCKS = 1 << 10
# Documents named in one row of the listing.
LISTED_AT_ONCE = 10_000


def encoder(ranks_file: str = RANKS) -> tiktoken.Encoding:
    with open(ranks_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("flat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def write_streams(
    docs: DataFrame, path: str, id_column: str = "doc_id", text: str = "text", ranks_file: str = RANKS,
    block_tokens: int = BLOCK_TOKENS,
) -> None:
    """Tokenise texts and write them to `path` as streams, one per task, in blocks of `block_tokens` tokens.

    Rows with `block` hold tokens as little-endian 16-bit numbers. Rows without are the writer's listing: the ids in
    the order in which their documents were written, without any position. A NULL text has no tokens, only its
    separator.
    """
    id_type = docs.schema[id_column].dataType.simpleString()
    with open(ranks_file, "rb") as source:
        lines = source.read()  # the vocabulary, of fixed size
    pattern = public_tokenizers.PATTERN

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines.splitlines())}
        encode = tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        stream, block, written = TaskContext.get().partitionId(), 0, 0
        waiting: list[np.ndarray] = []
        held = 0
        schema = None

        def row(block: int | None, data: bytes | None, first: int | None, ids: pa.Array | None) -> pa.RecordBatch:
            listed = pa.array([None if ids is None else ids.to_pylist()], schema.field(4).type)
            return pa.RecordBatch.from_arrays(
                [pa.array([stream]), pa.array([block], pa.int64()), pa.array([data], pa.binary()),
                 pa.array([first], pa.int64()), listed], schema=schema)

        for batch in batches:
            if schema is None:
                schema = pa.schema([("stream", pa.int64()), ("block", pa.int64()), ("tokens", pa.binary()),
                                    ("first", pa.int64()), ("ids", pa.list_(batch.column(0).type))])
            for begin in range(0, batch.num_rows, LISTED_AT_ONCE):
                ids = batch.column(0).slice(begin, LISTED_AT_ONCE)
                yield row(None, None, written, ids)
                written += len(ids)
            for value in batch.column(1).to_pylist():
                found = np.array([*encode(value), END_OF_DOCUMENT], TOKEN_TYPE)
                waiting.append(found)
                held += len(found)
                if held >= block_tokens:
                    flat = np.concatenate(waiting)
                    for begin in range(0, held - block_tokens + 1, block_tokens):
                        yield row(block, flat[begin : begin + block_tokens].tobytes(), None, None)
                        block += 1
                    waiting = [flat[held // block_tokens * block_tokens :]]
                    held = len(waiting[0])
        if held:
            yield row(block, np.concatenate(waiting).tobytes(), None, None)

    schema = f"stream bigint, block bigint, tokens binary, first bigint, ids array<{id_type}>"
    (
        docs.select(F.col(id_column), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(rows, schema)
        .write.option("compression", "zstd").parquet(path)
    )


def _scan(blocks: DataFrame, separator: int) -> DataFrame:
    """Per block: `tokens`, `ended`, `after` (tokens after its last separator), and `lengths` of what ends in it."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, ended, after, lengths = [], [], [], []
            for data in batch.column(2).to_pylist():
                flat = np.frombuffer(data, TOKEN_TYPE)
                at = np.flatnonzero(flat == separator)
                tokens.append(len(flat))
                ended.append(len(at))
                after.append(len(flat) - (int(at[-1]) + 1 if len(at) else 0))
                lengths.append(np.diff(at, prepend=-1) - 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(column, pa.int64()) for column in (tokens, ended, after)),
                 pa.array(lengths, pa.list_(pa.int64()))],
                ["stream", "block", "tokens", "ended", "after", "lengths"],
            )

    return blocks.select("stream", "block", "tokens").mapInArrow(
        rows, "stream bigint, block bigint, tokens bigint, ended bigint, after bigint, lengths array<bigint>"
    )


def _stitched(scanned: DataFrame) -> DataFrame:
    """Add `done`, the documents that ended before a block, `begin`, its first token's place, and `open`, the tokens
    before it of the document it begins in."""
    # `mark` is where the last document that ended in a block stops, counted from the block's own first token.
    blocks = scanned.withColumn("group", F.expr(f"block div {GROUP_BLOCKS}"))
    in_group = Window.partitionBy("stream", "group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.withColumns(
        {
            "tokens_before": F.coalesce(F.sum("tokens").over(in_group), F.lit(0)),
            "ended_before": F.coalesce(F.sum("ended").over(in_group), F.lit(0)),
        }
    ).withColumn("mark", F.when(F.col("ended") > 0, F.col("tokens_before") + F.col("tokens") - F.col("after")))
    placed = placed.withColumn("mark_before", F.max("mark").over(in_group))
    groups = placed.groupBy("stream", "group").agg(
        F.sum("tokens").alias("group_tokens"), F.sum("ended").alias("group_ended"), F.max("mark").alias("group_mark")
    )
    over_groups = Window.partitionBy("stream").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumns(
        {
            "group_begin": F.coalesce(F.sum("group_tokens").over(over_groups), F.lit(0)),
            "group_done": F.coalesce(F.sum("group_ended").over(over_groups), F.lit(0)),
        }
    )
    groups = groups.withColumn(
        "group_open", F.coalesce(F.max(F.col("group_begin") + F.col("group_mark")).over(over_groups), F.lit(0))
    ).select("stream", "group", "group_begin", "group_done", "group_open")
    begin = F.col("group_begin") + F.col("tokens_before")
    last_end = F.coalesce(F.col("group_begin") + F.col("mark_before"), F.col("group_open"))
    return placed.join(groups, ["stream", "group"]).select(
        "stream", "block", "tokens", "ended", "after", "lengths",
        (F.col("group_done") + F.col("ended_before")).alias("done"),
        begin.alias("begin"),
        (begin - last_end).alias("open"),
    )


def document_lengths(blocks: DataFrame, separator: int = END_OF_DOCUMENT) -> DataFrame:
    """`stream`, `ordinal`, `n_tokens`, `closed` of each document in token streams given as `stream`, `block`, `tokens`.

    `ordinal` counts the documents of a stream from 0; separators are not counted as tokens. Tokens after a stream's
    last separator are one more document, not closed. Two separators in a row enclose a document of no tokens. Empty
    blocks change nothing; NULL ones count as empty. No blocks, no documents.
    """
    present = blocks.select("stream", "block", F.coalesce("tokens", F.lit(b"")).alias("tokens"))
    stitched = _stitched(cut_lineage(_scan(present, separator)))
    ended = stitched.select("stream", "done", "open", F.posexplode("lengths").alias("at", "length")).select(
        "stream", (F.col("done") + F.col("at")).alias("ordinal"),
        (F.col("length") + F.when(F.col("at") == 0, F.col("open")).otherwise(0)).alias("n_tokens"),
        F.lit(True).alias("closed"),
    )
    unclosed = (
        stitched.groupBy("stream")
        .agg(
            F.sum("ended").alias("ordinal"), F.sum("tokens").alias("all"),
            F.max(F.when(F.col("ended") > 0, F.col("begin") + F.col("tokens") - F.col("after"))).alias("last"),
        )
        .select("stream", "ordinal", (F.col("all") - F.coalesce("last", F.lit(0))).alias("n_tokens"), F.lit(False).alias("closed"))
        .filter("n_tokens > 0")
    )
    return ended.unionByName(unclosed)


def token_counts(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", ranks_file: str = RANKS, block_tokens: int = BLOCK_TOKENS
) -> DataFrame:
    """One row per input row: the id, `stream`, `ordinal` and `n_tokens`, by writing token streams and scanning them.

    Repeated rows and NULL ids are documents like any other. An empty input gives an empty result.
    """
    spark = docs.sparkSession
    path = f"{scratch_folder(spark)}/streams"
    write_streams(docs, path, id_column, text, ranks_file, block_tokens)
    written = spark.read.parquet(path)
    lengths = document_lengths(written.filter("block IS NOT NULL"))
    listing = written.filter("block IS NULL").select("stream", "first", F.posexplode("ids").alias("at", id_column)).select(
        "stream", (F.col("first") + F.col("at")).alias("ordinal"), id_column
    )
    return listing.join(lengths, ["stream", "ordinal"]).select(id_column, "stream", "ordinal", "n_tokens")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents")).select("doc_id", "n_tokens")
