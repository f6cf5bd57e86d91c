"""Shards by jump consistent hashing: no ring table, and growing by one shard moves only what that shard gets."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curvewalk.llm.tables import map_columns

#: Rows a slot-numbering task sorts at most, on average: an id's hash picks its cell.
CELL_ROWS = 20_000


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key. A key leaves its shard only for the newest one when shards are appended."""
    if shards < 1:
        raise ValueError("there must be at least one shard")
    state = np.asarray(keys).astype(np.int64).view(np.uint64).copy()
    shard = np.zeros(len(state), dtype=np.int64)
    live = np.arange(len(state))
    jump = np.zeros(len(state), dtype=np.int64)
    with np.errstate(over="ignore"):
        while len(live):
            shard[live] = jump
            state[live] = state[live] * np.uint64(2862933555777941757) + np.uint64(1)
            draw = (state[live] >> np.uint64(33)).astype(np.float64) + 1.0
            step = np.floor((shard[live] + 1) * (float(1 << 31) / draw))
            stay = step < shards
            live, jump = live[stay], step[stay].astype(np.int64)
    return shard


def assign_shards(
    docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", cell_rows: int = CELL_ROWS
) -> DataFrame:
    """One row per document: (doc_id, size, text_crc32, shard, slot, grown_shard).

    The key is the hash of doc_id alone, so equal ids always share a shard, whatever the text; null ids
    share one key. size is the text's UTF-8 bytes plus 16; a null text counts as empty. slot numbers a
    shard's rows from 0 without a gap, by cell, then id hash, id, checksum and size; rows equal in all of
    these are interchangeable. An empty table gives no rows. Other columns are ignored.

    No shard is one task: a cell (shard, hash range) is numbered by itself, and cells are offset by the
    running count of the small table of cells.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    slim = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    ).withColumn("key", F.xxhash64("doc_id"))

    def place(doc_id, size, text_crc32, key) -> dict:
        keys = key.to_numpy(zero_copy_only=False)
        return {
            "doc_id": doc_id,
            "size": size,
            "text_crc32": text_crc32,
            "key": key,
            "shard": jump_hash(keys, shards),
            "grown_shard": jump_hash(keys, shards + 1),
        }

    placed = map_columns(slim, place, "doc_id long, size long, text_crc32 long, key long, shard int, grown_shard int")
    cells = max(1, -(-docs.count() // (shards * cell_rows)))
    # Of an id that many rows repeat, the checksum spreads the rows too.
    placed = placed.withColumn("cell", F.pmod(F.xxhash64("key", "text_crc32", F.lit(7)), F.lit(cells)).cast("int"))
    starts = placed.groupBy("shard", "cell").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("shard", "cell", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "cell").orderBy("key", "doc_id", "text_crc32", "size")
    return (
        placed.withColumn("at", F.row_number().over(inside) - 1)
        .join(starts, ["shard", "cell"])
        .select(
            "doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("at")).cast("long").alias("slot"), "grown_shard"
        )
    )
