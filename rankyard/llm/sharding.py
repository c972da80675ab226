"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

The shard of a row is a function of its key and of the number of shards alone: no ring table, and one more shard takes
rows only into itself, about 1 / (n + 1) of them. Within a shard, slots number the rows by key from 0 without gaps.

Slots are dealt without one task per shard: keys are laid out in ranges, rows are numbered in their range, and ranges
start where the counts of the ranges before them end. Rows that share a key are spread over ranges by the order in
which they were read (fixed once the keyed rows are written), so no key fills a task.

Defined results: the key null counts as the smallest key and hashes as 0; keys other than integers are hashed to 64 bits
of their text first; rows with equal keys share a shard and have
neighbouring slots; a null text has size 1 and the CRC of the empty text; columns other than the two that are named are
not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NullType
from pyspark.sql.window import Window

from .common import kind_of, ranges, written


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key."""
    key = keys.astype(np.uint64)
    here, ahead = np.full(len(key), -1, np.int64), np.zeros(len(key), np.int64)
    moving = np.ones(len(key), bool)
    with np.errstate(over="ignore"):
        while moving.any():
            here[moving] = ahead[moving]
            # Multiplier of the published generator, 2 ** 31.
            key[moving] = key[moving] * np.uint64(2862933555777941757) + np.uint64(1)
            ahead[moving] = ((here[moving] + 1) * (2147483648.0 / ((key[moving] >> np.uint64(33)) + np.uint64(1)).astype(np.float64))).astype(np.int64)
            moving &= ahead < shards
    return here.astype(np.int32)


def shard_of(key, shards: int):
    """A column with the shard of a long column."""

    @F.pandas_udf("int")
    def run(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(np.int64), shards))

    return run(F.coalesce(key, F.lit(0)).cast("long"))


def assign(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    content = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col), (F.octet_length(content).cast("long") + 1).alias("size"), F.crc32(content.cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("_read"))
    whole = isinstance(kind_of(docs, id_col), (IntegralType, NullType))
    key = F.col(id_col) if whole else F.when(F.col(id_col).isNotNull(), F.xxhash64(F.col(id_col).cast("string")))
    rows = rows.withColumns({"shard": shard_of(key, shards), "grown_shard": shard_of(key, shards + 1)})
    rows = written(rows, "keyed")
    n = ranges(rows, F.lit(32) + (0 if whole else F.octet_length(F.coalesce(F.col(id_col).cast("string"), F.lit("")))))
    ranged = rows.repartitionByRange(n, "shard", id_col, "_read").withColumn("_range", F.spark_partition_id())
    ranged = written(ranged, "ranged")
    counts = ranged.groupBy("shard", "_range").agg(F.count("*").alias("_rows"))
    # One row per shard and range that meet: at most shards + n rows.
    starts = counts.select("shard", "_range", (F.sum("_rows").over(Window.partitionBy("shard").orderBy("_range")) - F.col("_rows")).alias("_start"))
    within = F.row_number().over(Window.partitionBy("shard", "_range").orderBy(id_col, "_read")) - 1
    out = ranged.withColumn("_within", within).join(F.broadcast(starts), ["shard", "_range"])
    return out.select(id_col, "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_start") + F.col("_within")).cast("long").alias("slot"), "grown_shard")
