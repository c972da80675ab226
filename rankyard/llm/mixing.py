"""Mixing sources to target weights by weighted sampling without replacement (Efraimidis and Spirakis, 2006).

Sources share a budget of words by their weights; no target is above a multiple of its source's size, and what is above
is shared again by weight. A source gives complete epochs first, every document once an epoch. What is left of its
target is filled by a fraction of it: every document has an exponential key, a hash of seed and id as a uniform number,
its negative logarithm divided by the document's quality; documents are taken in order of keys, whole, while the sum of
their sizes is nearest to what is left. So a source misses its target by half of one document's size at most.

Order and sums are dealt out by ranges of keys within a source: a document's sum is that of the ranges before its own
and of the documents before it in its range, so no source is sorted in one task. Ranges are of equal probability for the
smallest quality; one of a quality q times as large is up to q times as full.

Defined results: a null text has size 0; a null source is a source of its own, the last; a null id takes a digest of its
text in place of the id; rows that share an id share a key and follow by size; qualities that are null, not finite or
not positive count as 1; a budget of 0 words gives targets of 0; columns other than those that are named are not read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

WORD = r"[^\x20\x09-\x0D]+"
#: Tables of one row a source, or a source and range, up to that many rows are broadcast.
BROADCAST_ROWS = 200_000
#: Rows of a range on average, where there are more than fill the session's shuffle partitions.
RANGE = 20_000


def exponential(seed: int, key: Column) -> Column:
    """An exponential number for a text key."""
    # 13 hexadecimal digits are 52 bits, which a double holds together with the half.
    digits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 13), 16, 10).cast("double")
    return -F.log((digits + 0.5) / float(1 << 52))


def targets(sources: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """sources (source, source_size) with place and target: shares by weight, none above most times the size.

    With sources in order of what their limit is for a unit of weight, those at their limit come first: one is, if the
    share that is left for it and all after it is above its limit. One row a source, so few in one task.
    """
    first = sources.withColumn("place", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))))
    weighed = first.withColumns({"weight": F.element_at(F.array(*map(F.lit, weights)), (F.col("place") - 1) % len(weights) + 1).cast("long"), "limit": F.col("source_size") * most})
    order = Window.orderBy(F.col("limit") / F.col("weight"), "place")
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    left = weighed.withColumns({"_left": F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0)), "_weights": F.sum("weight").over(after)})
    share = F.col("weight") * F.col("_left") / F.col("_weights")
    full = left.withColumn("_full", share > F.col("limit"))
    level = full.withColumn("_first", F.min(F.when(~F.col("_full"), F.struct(F.col("limit") / F.col("weight"), F.col("place"), F.col("_left"), F.col("_weights")))).over(every))
    target = F.when(F.col("_full"), F.col("limit").cast("double")).otherwise(F.col("weight") * F.col("_first._left") / F.col("_first._weights"))
    return level.select("source", "source_size", "place", target.alias("target"))


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3, quality: DataFrame | None = None, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, size, source_size, target, taken, copies of every row: taken words are the size times the copies.

    quality has the id and the quality of documents (the greatest of an id counts); others have 1. It is joined when
    texts have become sizes, so no text is shuffled.
    """
    spark = docs.sparkSession
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    # The text's digest is taken only where it is needed.
    key = F.when(F.col(id_col).isNotNull(), F.col(id_col).cast("string")).otherwise(F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), exponential(seed, key).alias("key"))
    if quality is not None:
        by_id = quality.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col("quality").cast("double")).alias("worth"))
        sized = sized.join(by_id, "id", "left")
    worth = F.col("worth") if quality is not None else F.lit(1.0)
    worth = F.when((worth > 0) & (worth < float("inf")), worth).otherwise(F.lit(1.0))
    sized = written(sized.withColumn("worth", worth).withColumn("key", F.col("key") / F.col("worth")), "sized")
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    aims = written(targets(by_source, weights, most), "targets")
    rows, least = sized.agg(F.count("*"), F.coalesce(F.min("worth"), F.lit(1.0))).first()
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / RANGE))
    few = lambda df, n: F.broadcast(df) if n <= BROADCAST_ROWS else df
    n_sources = aims.count()
    numbered = aims.withColumnRenamed("source", "_source")
    placed = sized.join(few(numbered, n_sources), F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "source")
    placed = placed.withColumn("range", F.floor(ranges * (1 - F.exp(-F.col("key") * least))).cast("int"))
    sums = placed.groupBy("place", "range").agg(F.sum("size").alias("_sum"))
    earlier = sums.select("place", "range", (F.sum("_sum").over(Window.partitionBy("place").orderBy("range")) - F.col("_sum")).alias("_earlier"))
    within = F.sum("size").over(Window.partitionBy("place", "range").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = placed.withColumn("_within", within).join(few(earlier, n_sources * ranges), ["place", "range"])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    after = F.col("_earlier") + F.col("_within")
    # Taken with its last word or left with its first one: whichever is nearer.
    some = (2 * after - F.col("size")) <= 2 * (F.col("target") - F.col("_epochs") * F.col("source_size"))
    out = out.withColumn("_epochs", epochs).withColumn("copies", F.col("_epochs") + F.when(some & (F.col("size") > 0), 1).otherwise(0))
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), F.col("copies").cast("int").alias("copies"))


def repeated(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The mix itself: the documents, each as often as mix took it, with the number of the copy. Ids must be unique."""
    times = mixed.where("copies > 0").select(id_col, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return docs.join(times, id_col)
