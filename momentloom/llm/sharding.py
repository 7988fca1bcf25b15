"""Shards by jump consistent hashing.

A stable key alone names the shard: no ring table is kept or sent, and when shards are
appended a row either stays or moves to a new shard (1/n of the rows for one more).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from momentloom.operators.scaling import numbered

#: Folded keys by which the rows of a shard are put in order.
BLOCKS = 4096
_STEP = 2862933555777941757  # fixed value: multiplier of the published generator


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key: follow the key's jumps until they leave the range."""
    key = keys.astype(np.uint64)
    at = np.zeros(len(key), dtype=np.int64)
    todo = np.arange(len(key))
    while len(todo):
        key[todo] = key[todo] * np.uint64(_STEP) + np.uint64(1)
        spread = (key[todo] >> np.uint64(33)).astype(np.float64) + 1.0
        landing = ((at[todo] + 1) * (float(1 << 31) / spread)).astype(np.int64)
        inside = landing < shards
        todo = todo[inside]
        at[todo] = landing[inside]
    return at.astype(np.int32)


def shard_of(key: Column, shards: int) -> Column:
    """Shard 0..shards-1 of an integer key; a null key counts as 0. Other types: hash first."""
    if shards < 1:
        raise ValueError("at least one shard is needed")

    @F.pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(dtype=np.int64).view(np.uint64), shards))

    return place(F.coalesce(key.cast("bigint"), F.lit(0).cast("bigint")))


def block_of_key(key: Column) -> Column:
    """One of ``BLOCKS`` blocks by the key's folded bits."""
    key = F.coalesce(key.cast("bigint"), F.lit(0).cast("bigint"))
    folded = key
    for bits in (12, 24, 36, 48):
        folded = folded.bitwiseXOR(F.shiftright(key, bits))
    return folded.bitwiseAND(F.lit(BLOCKS - 1).cast("bigint"))


def assign_shards(docs: DataFrame, shards: int, grown: int | None = None, key: str = "doc_id",
                  text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, size (UTF-8 bytes plus 1), text_crc32, law, shard,
    slot (gapless from 0 within the shard) and grown_shard (the shard if there were ``grown``).

    Law ``key``: only the key and the number of shards decide, so copies of a text may lie in
    different shards. Slots follow (folded key, key, checksum, size): rows are numbered over ranges
    of these that are cut where the rows are, so no shard and no key is one task's, however many
    rows it has. Null text: size 1, checksum 0. Null key: placed like key 0. Repeated keys share a
    shard and have a slot each. Other columns of ``docs`` are not carried.
    """
    rows = docs.select(F.col(f"`{key}`").alias(key), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_t"))
    placed = rows.select(
        key, shard_of(F.col(key), shards).alias("shard"),
        (shard_of(F.col(key), grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
        block_of_key(F.col(key)).alias("_block"),
        (F.octet_length("_t").cast("bigint") + 1).alias("size"),
        F.crc32(F.col("_t").cast("binary")).alias("text_crc32"))
    out = numbered(placed, ["shard"], ["_block", F.col(key).asc_nulls_first(), "text_crc32", "size"], "_i")
    return out.select(key, "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_i") - 1).cast("bigint").alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int, key: str = "doc_id") -> None:
    """Write ``docs`` as one folder per shard. Within a shard the rows stay spread over the
    tasks that read them, so no task has to hold a whole shard."""
    docs.withColumn("shard", shard_of(F.col(f"`{key}`"), shards)).write.partitionBy("shard").parquet(path)
