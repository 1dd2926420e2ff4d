"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

The key alone and the number of shards decide a row's shard; no ring table exists.  When one shard is
appended, a key either stays or moves into the new shard, so only about ``1 / (n + 1)`` of the rows move.

This is the law ``key``: the id and the number of shards decide.  Groups of equal texts are therefore not kept together; rows of
one id are.

Defined cases: a null key is a key of its own; a null text has size 1 and CRC 0; repeated rows share a shard
and take different slots; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import written

#: Blocks per shard in which slots are numbered independently; at 10^10 rows a block holds some 300,000.
SLOT_BLOCKS = 4096

#: The linear congruential step of the published algorithm.
LCG_FACTOR, LCG_STEP = np.uint64(2862933555777941757), np.uint64(1)


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key, all keys at once; the loop runs O(log shards) times."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    state = keys.astype(np.uint64)
    at, jump = np.full(len(state), -1, np.int64), np.zeros(len(state), np.int64)
    active = np.arange(len(state))
    with np.errstate(over="ignore"):
        while len(active):
            at[active] = jump[active]
            state[active] = state[active] * LCG_FACTOR + LCG_STEP
            step = (state[active] >> np.uint64(33)).astype(np.float64) + 1.0
            jump[active] = ((at[active] + 1) * (2.0**31 / step)).astype(np.int64)
            active = active[jump[active] < shards]
    return at.astype(np.int32)


def assign(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its key, size and CRC, its shard of ``shards`` and of ``shards + 1``.

    A map over the scan; nothing is shuffled, and only the numbers of a row reach Python, no text.
    """

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("size"),
                    batch.column("text_crc32"),
                    pa.array(jump_hash(keys, shards)),
                    pa.array(jump_hash(keys, shards + 1)),
                ],
                ["id", "size", "text_crc32", "shard", "grown_shard"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(F.col(id_col)).alias("key"),
        F.coalesce(F.crc32(F.encode(F.col(text_col), "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"),
    ).mapInArrow(places, f"id {kind}, size long, text_crc32 long, shard int, grown_shard int")


def numbered(placed: DataFrame) -> DataFrame:
    """Add ``slot``: 0, 1, 2, ... within each shard, in one shuffle of narrow rows.

    Rows are numbered inside blocks of a shard; each block starts where the blocks before it end.  The block
    table has at most ``SLOT_BLOCKS`` rows per shard, so it may be broadcast whatever the input's size.
    """
    block = F.pmod(F.xxhash64("id", "text_crc32", "size"), F.lit(SLOT_BLOCKS)).cast("int")
    rows = written(placed.withColumn("block", block), "shards")
    counts = rows.groupBy("shard", "block").count()
    before = W.partitionBy("shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("shard", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("begin"))
    order = W.partitionBy("shard", "block").orderBy("id", "text_crc32", "size")
    return (
        rows.withColumn("place", F.row_number().over(order))
        .join(F.broadcast(starts), ["shard", "block"])
        .withColumn("slot", (F.col("begin") + F.col("place") - 1).cast("long"))
        .drop("block", "begin", "place")
    )


def shard(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shards and slots of all rows: id, size, text_crc32, law, shard, slot, grown_shard."""
    placed = numbered(assign(docs, shards, id_col, text_col))
    return placed.select("id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
