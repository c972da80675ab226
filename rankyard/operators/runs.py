"""Retrieval runs: from scenarios and items to metric rows that carry the run's identity, with rankings that are kept.

Rankings live in a table keyed by what they depend on. A run looks its keys up there, ranks what is missing, adds it and
reads all from the table: a second run of the same pools ranks nothing.
"""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankyard.operators import metrics, pools, ranking
from rankyard.operators.registry import Registry
from rankyard.sources.jsonl import exists
from rankyard.staging import written


def now() -> str:
    return datetime.datetime.now(datetime.UTC).isoformat()


@dataclass(frozen=True)
class Run:
    """What every row of a run says about it."""

    engine_version: str = "unknown"
    run_type: str = "retrieval"
    run_id: str = field(default_factory=lambda: f"ret-{uuid.uuid4().hex}")
    generated_at: str = field(default_factory=now)

    def columns(self):
        return [F.lit(getattr(self, c)).alias(c) for c in ("run_type", "run_id", "generated_at", "engine_version")]


#: Rankers of pools: functions (queries, pools, items, k) of tables with id, text and vector, and (query_id, pool_size, item_id).
PoolRanker = Callable[[DataFrame, DataFrame, DataFrame, int], DataFrame]
pool_rankers: Registry[PoolRanker] = Registry("method")
pool_rankers.add("bm25", ranking.bm25_in_pools)
pool_rankers.add("semantic", ranking.dense_in_pools)
pool_rankers.add("hybrid", ranking.hybrid_in_pools)

KEY = ("corpus", "method", "seed", "k", "query_id", "pool_size", "digest")


class RankingStore:
    """Rankings of pools, as a Parquet table that only grows.

    A key holds the corpus label, method, seed, depth, scenario, pool size and a digest of the query's text and the pool's
    members. Items whose texts change need another label. A ranking without items is kept, too. If two runs add the same key
    at once, one of the equal rows counts.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def stored(self, query_type: str, item_type: str) -> DataFrame:
        schema = f"corpus STRING, method STRING, seed BIGINT, k INT, query_id {query_type}, pool_size INT, digest BIGINT, ranked ARRAY<STRUCT<rank: INT, item_id: {item_type}, score: DOUBLE>>"
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path)

    def rankings(self, queries: DataFrame, members: DataFrame, items: DataFrame, k: int, corpus: str, method: str = "bm25", seed: int = 0) -> tuple[DataFrame, int]:
        """query_id, pool_size, item_id, score, rank of all pools, and how many pools had to be ranked."""
        rank = pool_rankers[method]
        kinds = {c: members.schema[c].dataType.simpleString() for c in ("query_id", "item_id")}
        content = members.groupBy("query_id", "pool_size").agg(F.bit_xor(F.xxhash64("item_id")).alias("_x"), F.count("*").alias("_n"))
        texts = queries.select(F.col("id").alias("query_id"), F.xxhash64(*(c for c in ("text", "vector") if c in queries.columns)).alias("_t"))
        fixed = {"corpus": corpus, "method": method, "seed": seed, "k": k}
        asked = content.join(texts, "query_id").select(*(F.lit(v).alias(c) for c, v in fixed.items()), "query_id", F.col("pool_size").cast("int").alias("pool_size"), F.xxhash64("_x", "_n", "_t").alias("digest"))
        asked = written(asked, "asked")
        of_run = F.lit(True)
        for c, v in fixed.items():
            of_run = of_run & (F.col(c) == F.lit(v))
        held = self.stored(kinds["query_id"], kinds["item_id"]).where(of_run)
        missing = written(asked.join(held.select(*KEY), list(KEY), "left_anti"), "missing")
        n = missing.count()
        if n:
            some = members.join(missing.select("query_id", "pool_size"), ["query_id", "pool_size"], "left_semi")
            found = rank(queries, some, items, k).groupBy("query_id", "pool_size").agg(F.array_sort(F.collect_list(F.struct(F.col("rank").cast("int").alias("rank"), "item_id", "score"))).alias("ranked"))  # k entries
            none = F.array().cast(f"array<struct<rank:int,item_id:{kinds['item_id']},score:double>>")
            new = missing.join(found, ["query_id", "pool_size"], "left").select(*KEY, F.coalesce("ranked", none).alias("ranked"))
            new.write.mode("append").parquet(self.path)
            held = self.stored(kinds["query_id"], kinds["item_id"]).where(of_run)
        one = asked.join(held, list(KEY)).groupBy("query_id", "pool_size").agg(F.max("ranked").alias("ranked"))
        return one.select("query_id", "pool_size", F.explode("ranked").alias("e")).select("query_id", "pool_size", "e.item_id", "e.score", "e.rank"), n


def evaluate(scenarios: DataFrame, items: DataFrame, ks: Sequence[int], pool_sizes: Sequence[int], seed: int, run: Run, method: str | PoolRanker = "bm25", store: RankingStore | None = None, corpus: str = "corpus", variant: str = "engine") -> DataFrame:
    """Metric rows (the schema RETRIEVAL_ROW), one for each scenario, pool and k, from one ranking of max(ks) for each pool.

    scenarios has id, prompt, category, own (ids of the items that every pool of the scenario holds, in order) and gold_tools;
    items has id, text, and vector if the method needs one, and is the universe of distractors. method is the name of a ranker
    or a function of the same kind; only those of a name are kept in a store.
    """
    own = scenarios.select(F.col("id").alias("query_id"), F.posexplode(F.array_distinct("own")).alias("position", "item_id"))
    gold = written(scenarios.select(F.col("id").alias("query_id"), F.explode(F.array_distinct("gold_tools")).alias("item_id")), "gold")
    members = written(pools.pools(written(own, "own"), items.select(F.col("id").alias("item_id")), pool_sizes, seed), "pools")
    queries = scenarios.select("id", F.col("prompt").alias("text"), *(["vector"] if "vector" in scenarios.columns else []))
    if store is None or not isinstance(method, str):
        ranked = (pool_rankers[method] if isinstance(method, str) else method)(queries, members, items, max(ks))
    else:
        ranked, _ = store.rankings(queries, members, items, max(ks), corpus, method, seed)
    scored = metrics.at_ks(members, written(ranked, "ranking"), gold, ks, by=("query_id", "pool_size"), variant=variant)
    shape = members.groupBy("query_id", "pool_size").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "item_id"))), lambda e: e["item_id"]).alias("pool_ids"))
    known = scenarios.select(F.col("id").alias("query_id"), F.col("prompt").alias("query"), F.col("gold_tools").alias("golden_answer"), "category")
    rows = scored.join(shape, ["query_id", "pool_size"]).join(known, "query_id")
    actual = F.size("pool_ids")
    return rows.select(
        *run.columns()[:3],
        F.col("query_id").alias("scenario_id"),
        "query",
        "golden_answer",
        "category",
        F.col("pool_size").alias("target_pool_size"),
        actual.alias("actual_pool_size"),
        "pool_ids",
        run.columns()[3],
        F.col("k").cast("int").alias("k"),
        actual.alias("pool_size"),
        F.col("gold_count").cast("int").alias("gold_count"),
        *("recall_at_k", "precision_at_k", "reciprocal_rank", "ndcg_at_k", "hit_at_k", "complete_at_k", "gold_score", "retrieved"),
    )
