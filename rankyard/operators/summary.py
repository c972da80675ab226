"""Aggregates of metric rows: by bucket, pool and k, with roll-ups.

Means are sums of decimals, so that no order of summing shows; medians are exact and buffer no group. Summaries read
their rows several times and write what they need of them first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankyard.functions.labels import bucket_of, call_type, corpus_of
from rankyard.operators.medians import same, with_medians
from rankyard.staging import written

ALL = "all"
METRICS = {"precision": "precision_at_k", "recall": "recall_at_k", "mrr": "reciprocal_rank", "ndcg": "ndcg_at_k"}


def or_zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def mean(x: Column) -> Column:
    """The mean as a double, summed as decimals of 12 places; null without values."""
    return (F.sum(x.cast("decimal(28,12)")).cast("double") / F.count(x)).cast("double")


def deviation(x: Column) -> Column:
    """The population standard deviation, from decimal sums of values of 9 places and their squares; null without values."""
    d = x.cast("decimal(18,9)")
    square = F.sum((d * d).cast("decimal(38,18)")).cast("double") / F.count(d)
    first = F.sum(d.cast("decimal(38,9)")).cast("double") / F.count(d)
    return F.sqrt(F.greatest(square - first * first, F.lit(0.0)))


def share(x: Column) -> Column:
    """The part of rows for which x holds; null does not hold."""
    return or_zero(F.avg(F.when(x, 1.0).otherwise(0.0)))


def metric_columns() -> list[Column]:
    """n and the mean of every metric; their medians are METRIC_MEDIANS."""
    return [F.count("*").alias("n"), *(or_zero(mean(F.col(c))).alias(f"mean_{name}") for name, c in METRICS.items())]


METRIC_MEDIANS = {f"median_{name}": c for name, c in METRICS.items()}


def score_columns(x: Column, name: str) -> list[Column]:
    return [or_zero(mean(x)).alias(f"mean_{name}"), or_zero(deviation(x)).alias(f"stddev_{name}")]


def stats(rows: DataFrame, by: Sequence[str], column: str, name: str) -> DataFrame:
    """by with mean, exact median and population standard deviation of a column, 0 without values; rows is read twice."""
    return with_medians(rows, by, score_columns(F.col(column), name), {f"median_{name}": column})


def _kept(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    return written(rows.select(*dict.fromkeys(columns)), "metrics")


def by_bucket(rows: DataFrame, bucket: str = "bucket") -> DataFrame:
    """bucket, pool_size, k with metrics: each bucket and "all", over all pools (pool_size null, overall) and by pool."""
    kept = _kept(rows, [bucket, "pool_size", "k", *METRICS.values(), "hit_at_k", "complete_at_k"])
    flagged = lambda c, rest, name: F.explode(F.array(F.struct(F.col(c).alias("x"), F.lit(False).alias("rolled")), F.struct(rest.alias("x"), F.lit(True).alias("rolled")))).alias(name)
    pool = F.lit(None).cast(kept.schema["pool_size"].dataType)
    every = kept.select("*", flagged(bucket, F.lit(ALL), "_b")).select("*", flagged("pool_size", pool, "_p"))
    every = every.withColumns({bucket: F.col("_b.x"), "pool_size": F.col("_p.x"), "_rolled": F.col("_b.rolled"), "overall": F.col("_p.rolled")})
    aggregates = [*metric_columns(), share(F.col("hit_at_k")).alias("hit_rate"), share(F.col("complete_at_k")).alias("complete_rate")]
    return with_medians(every, [bucket, "pool_size", "k", "_rolled", "overall"], aggregates, METRIC_MEDIANS).drop("_rolled")


def gold_scores(rows: DataFrame, by: list[str], scenario: str = "query_id") -> DataFrame:
    """by with statistics of the scenarios' gold scores and their coverage; a score counts once, not for each k."""
    once = written(rows.groupBy(*by, scenario).agg(F.max("gold_score").alias("gold_score")), "scores")
    score = F.col("gold_score")
    aggregates = [*score_columns(score, "gold_score"), F.count(score).alias("found"), F.count("*").alias("scenarios"), (F.count(score) / F.count("*")).alias("coverage")]
    return with_medians(once, by, aggregates, {"median_gold_score": "gold_score"})


def by_corpus(rows: DataFrame) -> DataFrame:
    """corpus, subset, mode, k, pool_size with metrics; rows of skills count in the subset "all" too.

    complete_set_rate falls back to recall 1 where the flag is missing, complete_rate to a hit.
    """
    kept = _kept(rows, ["scenario_id", "category", "gold_count", "k", "target_pool_size", *METRICS.values(), "hit_at_k", "complete_at_k"])
    where = bucket_of(F.col("category"), F.col("gold_count"))
    placed = kept.withColumns({"corpus": corpus_of(F.col("scenario_id")), "_at": where}).withColumns({"subset": F.col("_at.subset"), "mode": F.col("_at.mode")})
    subsets = F.when((F.col("mode") == "skill") & (F.col("subset") != ALL), F.array("subset", F.lit(ALL))).otherwise(F.array("subset"))
    placed = placed.withColumn("subset", F.explode(subsets)).withColumnRenamed("target_pool_size", "pool_size")
    aggregates = [
        *metric_columns(),
        share(F.coalesce("complete_at_k", F.col("recall_at_k") >= 1)).alias("complete_set_rate"),
        share(F.col("hit_at_k")).alias("hit_rate"),
        share(F.coalesce("complete_at_k", F.col("hit_at_k"))).alias("complete_rate"),
    ]
    return with_medians(placed, ["corpus", "subset", "mode", "k", "pool_size"], aggregates, METRIC_MEDIANS)


def latest(stamps: Column) -> Column:
    """The last of ISO time stamps as text, empty ones left out; "" without any."""
    return F.coalesce(F.max(F.nullif(stamps, F.lit(""))), F.lit(""))


def retrieval_history(rows: DataFrame) -> DataFrame:
    """One history row for each version, type, pool and k of function-calling rows, stamped with the latest time of all."""
    kept = _kept(rows, ["scenario_id", "engine_version", "generated_at", "target_pool_size", "k", *METRICS.values(), "hit_at_k", "complete_at_k", "gold_score"])
    typed = kept.withColumn("type", call_type(F.col("scenario_id"))).where(F.col("type").isNotNull()).withColumn("engine_version", F.coalesce("engine_version", F.lit("unknown")))
    by = ["engine_version", "type", "target_pool_size", "k"]
    metrics = with_medians(typed, by, [*metric_columns(), share(F.col("hit_at_k")).alias("accuracy"), share(F.coalesce("complete_at_k", F.col("hit_at_k"))).alias("complete_rate")], METRIC_MEDIANS)
    once = typed.groupBy(*by, "scenario_id").agg(F.max("gold_score").alias("gold_score"))
    score = F.col("gold_score")
    similarity = with_medians(once, by, [*score_columns(score, "similarity"), (F.count(score) / F.count("*")).alias("coverage")], {"median_similarity": "gold_score"})
    # One row.
    stamp = typed.agg(latest(F.col("generated_at")).alias("timestamp"))
    return same(metrics, similarity, by).crossJoin(F.broadcast(stamp)).withColumn("source", F.lit("retriever_evaluation")).withColumnRenamed("target_pool_size", "pool_size")
