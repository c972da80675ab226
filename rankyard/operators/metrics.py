"""Rank-quality and selection metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ideal_dcg(n: Column) -> Column:
    """The discounted gain of n gold items at the top."""
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), F.lit(0.0), lambda s, r: s + 1.0 / F.log2(r + 1.0))).otherwise(F.lit(0.0))


def guarded(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def at_ks(scenarios: DataFrame, ranking: DataFrame, gold: DataFrame, ks: Sequence[int], by: Sequence[str] = ("query_id",), variant: str = "engine") -> DataFrame:
    """Metrics of every scenario (rows of by) and k from one ranking of max(ks).

    variant "engine": precision over min(k, ranked), the gold score of the whole ranking, not complete without gold.
    variant "sdk": precision over k, the gold score within k, complete without gold.
    Scenarios without ranked items or gold keep their rows. No ks give no rows.
    """
    if variant not in ("engine", "sdk"):
        raise ValueError(f"unknown variant {variant!r}")
    by = list(by)
    top = max(ks, default=0)
    marked = ranking.where(F.col("rank") <= top).join(gold.select(by[0], "item_id").distinct().withColumn("is_gold", F.lit(True)), [by[0], "item_id"], "left")
    entry = F.struct("rank", "item_id", "score", F.coalesce("is_gold", F.lit(False)).alias("is_gold"))
    lists = marked.groupBy(*by).agg(F.array_sort(F.collect_list(entry)).alias("ranked"))  # at most max(ks) entries
    counts = gold.select(by[0], "item_id").distinct().groupBy(by[0]).agg(F.count("*").alias("gold_count"))
    rows = scenarios.select(*by).distinct().join(lists, by, "left").join(counts, by[0], "left")
    rows = rows.withColumns({"gold_count": F.coalesce("gold_count", F.lit(0)), "n_ranked": F.greatest(F.coalesce(F.size("ranked"), F.lit(0)), F.lit(0))})
    rows = rows.withColumn("k", F.explode(F.array(*(F.lit(k) for k in sorted(set(ks))))) if ks else F.explode(F.array().cast("array<int>")))
    rows = rows.withColumn("within", F.filter("ranked", lambda e: e["rank"] <= F.col("k")))
    hit = F.filter("within", lambda e: e["is_gold"])
    rows = rows.withColumns({"hits": F.greatest(F.coalesce(F.size(hit), F.lit(0)), F.lit(0)), "first": F.get(hit, F.lit(0))["rank"], "gain": F.coalesce(F.aggregate(hit, F.lit(0.0), lambda s, e: s + 1.0 / F.log2(e["rank"] + 1.0)), F.lit(0.0))})
    sdk = variant == "sdk"
    scored = F.filter("within" if sdk else "ranked", lambda e: e["is_gold"])
    ideal = ideal_dcg(F.least("gold_count", "k"))
    return rows.select(
        *by,
        "k",
        "gold_count",
        guarded(F.col("hits"), F.col("gold_count")).alias("recall_at_k"),
        guarded(F.col("hits"), F.col("k") if sdk else F.least("n_ranked", "k")).alias("precision_at_k"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"),
        F.when(ideal > 0, F.col("gain") / ideal).otherwise(F.lit(0.0)).alias("ndcg_at_k"),
        (F.col("hits") > 0).alias("hit_at_k"),
        ((F.col("hits") == F.col("gold_count")) & ((F.col("gold_count") > 0) | F.lit(sdk))).alias("complete_at_k"),
        F.array_max(F.transform(scored, lambda e: e["score"])).alias("gold_score"),
        F.transform("within", lambda e: F.struct(e["item_id"].alias("id"), e["score"].alias("score"))).alias("retrieved"),
    )


def selection(cells: DataFrame, gold: str = "gold", selected: str = "selected") -> DataFrame:
    """cells with hits, selection_pass, complete, recall, precision of two arrays taken as sets (null: empty)."""
    g, s = F.array_distinct(gold), F.array_distinct(selected)
    n = lambda x: F.greatest(F.coalesce(F.size(x), F.lit(0)), F.lit(0))
    out = cells.withColumns({"_g": n(g), "_s": n(s), "hits": n(F.array_intersect(g, s))})
    out = out.withColumns({"selection_pass": F.col("hits") > 0, "complete": (F.col("_g") > 0) & (F.col("hits") == F.col("_g")), "recall": guarded(F.col("hits"), F.col("_g")), "precision": guarded(F.col("hits"), F.col("_s"))})
    return out.drop("_g", "_s")


def selection_verdict(gold: Column, effective: Column) -> Column:
    """"pass" where a gold id was called, "n/a" without gold, else "fail"."""
    return F.when(F.coalesce(F.size(gold), F.lit(0)) <= 0, F.lit("n/a")).when(F.coalesce(F.arrays_overlap(gold, effective), F.lit(False)), F.lit("pass")).otherwise(F.lit("fail"))
