"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

A stable 64-bit key decides the shard; no ring table is kept, and one more
shard takes rows only into itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlog.llm.common import free_name, table

#: Sub-ranges of a shard that are numbered apart; bounds the offsets table.
SLOT_BUCKETS = 1024


def jump_hash(keys: np.ndarray, n: int) -> np.ndarray:
    """Shards 0..n-1 of unsigned 64-bit keys, all rows at once."""
    key = keys.astype(np.uint64, copy=True)
    shard = np.zeros(len(key), np.int64)
    jump = np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        shard[live] = jump[live]
        key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        top = (key[live] >> np.uint64(33)).astype(np.float64) + 1.0
        jump[live] = ((shard[live] + 1) * (2147483648.0 / top)).astype(np.int64)
        live = live[jump[live] < n]
    return shard


def jump_shard(key: Column, n: int) -> Column:
    """Shard of a 64-bit key column that has no nulls."""

    @F.arrow_udf("int")
    def shards(k: pa.Array) -> pa.Array:
        return pa.array(jump_hash(k.to_numpy().view(np.uint64), n).astype(np.int32))

    return shards(key)


def shard_rows(df: DataFrame, keys: list[str], n_shards: int, n_buckets: int = SLOT_BUCKETS) -> DataFrame:
    """Add shard, slot (gapless from 0 within a shard) and grown_shard.

    The key is xxhash64 of the key columns; a null key column counts as the
    hash of nothing, so null keys share one shard. Rows equal in all columns
    are interchangeable. An empty table stays empty. All columns pass through;
    _ goes before the new names where df has them.

    Slots: every shard is cut into n_buckets pieces by a hash of the whole
    row, pieces are counted, and rows are numbered within their piece, so no
    task holds a shard. Only the n_shards * n_buckets piece counts are
    broadcast.
    """
    shard, slot, grown = (free_name(df, x) for x in ("shard", "slot", "grown_shard"))
    h, b, first, s = (free_name(df, x) for x in ("_jump_key", "_bucket", "_first", "_s"))
    whole = df.dtypes
    df = df.withColumn(h, F.xxhash64(*keys))
    df = df.withColumn(shard, jump_shard(F.col(h), n_shards))
    df = df.withColumn(grown, jump_shard(F.col(h), n_shards + 1))
    hashed = [F.col(f"`{c}`") for c, kind in whole if "map<" not in kind]
    df = df.withColumn(b, F.pmod(F.xxhash64(*hashed), F.lit(n_buckets)).cast("int"))
    before = Window.partitionBy(shard).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.groupBy(shard, b)
        .agg(F.count("*").alias(first))
        .withColumn(first, F.coalesce(F.sum(first).over(before), F.lit(0)))
        .select(F.col(shard).alias(s), F.col(b).alias(f"{b}2"), first)
    )
    inside = Window.partitionBy(shard, b).orderBy(h, *keys)
    return (
        df.withColumn(slot, F.row_number().over(inside) - 1)
        .join(F.broadcast(offsets), (F.col(shard) == F.col(s)) & (F.col(b) == F.col(f"{b}2")))
        .withColumn(slot, (F.col(slot) + F.col(first)).cast("long"))
        .drop(h, b, s, f"{b}2", first)
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder shard=N per shard, rows in slot order within each file."""
    sharded.repartition("shard", F.floor(F.col("slot") / 1_000_000)).sortWithinPartitions("shard", "slot").write.partitionBy(
        "shard"
    ).parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: all documents into shards 0 to 7 by the key law."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    return shard_rows(docs, ["doc_id"], 8).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
