"""Queries of the retrieval half: pools, rankings, metrics, summaries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from rankyard.functions import permutation
from rankyard.operators import metrics, pools, ranking, runs, sampling, summary
from rankyard.plans import adapters as A
from rankyard.plans.registry import query
from rankyard.staging import FEW, few, shared_folder, tasks, written

KS = (1, 3, 5, 10)
SIZES = (30, 150, 600)
SEED = 42

_TOKENS = "regexp_extract_all(lower(text), '[a-z0-9]+')"
_POSTINGS = f"""
terms AS (SELECT id AS query_id, unnest(list_distinct({_TOKENS})) AS term FROM scenarios),
lengths AS (SELECT id AS item_id, len({_TOKENS}) AS length FROM items),
counts AS (SELECT item_id, term, count(*) AS tf FROM (SELECT id AS item_id, unnest({_TOKENS}) AS term FROM items) GROUP BY ALL)"""
_BM25 = f"""{_POSTINGS},
totals AS (SELECT count(*) AS items, sum(length) / count(*) AS mean_length FROM lengths),
idf AS (SELECT term, ln(1 + ((SELECT items FROM totals) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM counts GROUP BY term),
scored AS (SELECT query_id, item_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / (SELECT mean_length FROM totals)))), 9) AS score
  FROM terms JOIN idf USING (term) JOIN counts USING (term) JOIN lengths USING (item_id) GROUP BY ALL),
ranking AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 10)"""
_BASE = f"WITH RECURSIVE {A.ITEMS_SQL}, {A.SCENARIOS_SQL}"


def _metrics(by: str, scenarios: str, ranking: str, gold: str, ks: str, sdk: bool = False) -> str:
    """The metric rows of a ranking, as common table expressions in DuckDB's SQL."""
    within = "AND rank <= k" if sdk else ""
    return f"""
ks AS (SELECT unnest({ks}) AS k),
gold_counts AS (SELECT query_id, count(*) AS gold_count FROM {gold} GROUP BY 1),
marked AS (SELECT r.*, g.item_id IS NOT NULL AS is_gold FROM {ranking} r LEFT JOIN {gold} g ON r.query_id = g.query_id AND r.item_id = g.item_id),
grid AS (SELECT s.*, k, coalesce(gold_count, 0) AS gold_count FROM {scenarios} s CROSS JOIN ks LEFT JOIN gold_counts USING (query_id)),
agg AS (SELECT {', '.join('grid.' + c for c in by.split(', '))}, k, gold_count,
    count(rank) AS n_ranked, count(*) FILTER (WHERE is_gold AND rank <= k) AS hits, min(rank) FILTER (WHERE is_gold AND rank <= k) AS first,
    coalesce(sum(1.0 / log2(rank + 1.0)) FILTER (WHERE is_gold AND rank <= k), 0.0) AS gain, max(score) FILTER (WHERE is_gold {within}) AS gold_score
  FROM grid LEFT JOIN marked USING ({by}) GROUP BY ALL),
metric AS (SELECT {by}, k, gold_count,
    CASE WHEN gold_count > 0 THEN hits / gold_count ELSE 0.0 END AS recall_at_k,
    CASE WHEN {'k' if sdk else 'least(n_ranked, k)'} > 0 THEN hits / {'k' if sdk else 'least(n_ranked, k)'} ELSE 0.0 END AS precision_at_k,
    coalesce(1.0 / first, 0.0) AS reciprocal_rank,
    CASE WHEN gold_count > 0 THEN gain / (SELECT sum(1.0 / log2(i + 1.0)) FROM range(1, least(gold_count, k) + 1) t(i)) ELSE 0.0 END AS ndcg_at_k,
    hits > 0 AS hit_at_k, hits = gold_count AND {'TRUE' if sdk else 'gold_count > 0'} AS complete_at_k, gold_score
  FROM agg)"""


_SHOWN = "k, gold_count, round(recall_at_k, 6) AS recall_at_k, round(precision_at_k, 6) AS precision_at_k, round(reciprocal_rank, 6) AS reciprocal_rank, round(ndcg_at_k, 6) AS ndcg_at_k, hit_at_k, complete_at_k, round(gold_score, 6) AS gold_score"


def shown(rows, *by):
    """Metric rows with rounded values, without the list of retrieved items."""
    values = ("recall_at_k", "precision_at_k", "reciprocal_rank", "ndcg_at_k")
    return rows.select(*by, "k", "gold_count", *(F.round(v, 6).alias(v) for v in values), "hit_at_k", "complete_at_k", F.round("gold_score", 6).alias("gold_score"))


def _bm25(spark, sf_dir):
    return ranking.bm25(A.scenarios(spark, sf_dir), A.items(spark, sf_dir), max(KS))


def _asked(spark, sf_dir):
    return A.scenarios(spark, sf_dir).select(F.col("id").alias("query_id"))


@query(f"{_BASE}, {_BM25} SELECT query_id, item_id, round(score, 6) AS score, rank FROM ranking")
def bm25_topk_global(spark, sf_dir):
    return _bm25(spark, sf_dir).withColumn("score", F.round("score", 6))


_GLOBAL = f"{_BASE}, {_BM25}, {A.GOLD_SQL}, asked_ids AS (SELECT id AS query_id FROM scenarios)"


@query(f"{_GLOBAL}, {_metrics('query_id', 'asked_ids', 'ranking', 'gold', '[1, 3, 5, 10]')} SELECT query_id, {_SHOWN} FROM metric")
def bm25_metrics_at_ks(spark, sf_dir):
    return shown(metrics.at_ks(_asked(spark, sf_dir), _bm25(spark, sf_dir), A.gold(spark, sf_dir), KS), "query_id")


@query(f"{_GLOBAL}, {_metrics('query_id', 'asked_ids', 'ranking', 'gold', '[1, 3, 5, 10]', sdk=True)} SELECT query_id, {_SHOWN} FROM metric")
def bm25_metrics_sdk_variant(spark, sf_dir):
    return shown(metrics.at_ks(_asked(spark, sf_dir), _bm25(spark, sf_dir), A.gold(spark, sf_dir), KS, variant="sdk"), "query_id")


def _pools_sql(own: str, universe: str, sizes, seed: int) -> str:
    """Pools of the table own over the items of universe, as common table expressions of DuckDB (under WITH RECURSIVE)."""
    return f"""
n_own AS (SELECT query_id, count(*) AS n_own FROM {own} GROUP BY 1),
numbered AS (SELECT item_id, row_number() OVER (ORDER BY md5(item_id::VARCHAR)[1:3], item_id) - 1 AS position FROM {universe}),
{permutation.walk_sql(f"(SELECT * FROM n_own WHERE n_own < {max(sizes)})", max(sizes), seed)},
drawn AS (SELECT query_id, n_own, item_id, row_number() OVER (PARTITION BY query_id ORDER BY draw) AS rn FROM drawn_at JOIN numbered USING (position) JOIN n_own USING (query_id) WHERE NOT EXISTS (SELECT 1 FROM {own} o WHERE o.query_id = drawn_at.query_id AND o.item_id = numbered.item_id)),
sizes AS (SELECT unnest({list(sizes)}) AS pool_size),
pools AS (SELECT query_id, pool_size, item_id, n_own + rn AS ordinal FROM drawn CROSS JOIN sizes WHERE n_own + rn <= pool_size
  UNION ALL SELECT query_id, pool_size, item_id, row_number() OVER (PARTITION BY query_id, pool_size ORDER BY position, item_id) FROM {own} CROSS JOIN sizes)"""


_POOLS = f"""
own AS (SELECT query_id, item_id, item_id AS position FROM gold UNION ALL SELECT id, id, id FROM scenarios WHERE id NOT IN (SELECT query_id FROM gold) AND id IN (SELECT id FROM items)),
{_pools_sql("own", "(SELECT id AS item_id FROM items)", SIZES, SEED)}"""
_POOLED = f"{_BASE}, {A.GOLD_SQL}, {_POOLS}"


def _own(spark, sf_dir, links):
    """The gold documents of each benchmark item; the document of the same number where there are none."""
    rest = _asked(spark, sf_dir).join(links, "query_id", "left_anti").join(A.items(spark, sf_dir).select(F.col("id").alias("query_id")), "query_id", "left_semi")
    return links.unionByName(rest.withColumn("item_id", F.col("query_id"))).withColumn("position", F.col("item_id"))


def _pools(spark, sf_dir, links):
    universe = A.items(spark, sf_dir).select(F.col("id").alias("item_id"))
    return pools.pools(written(_own(spark, sf_dir, links), "own"), universe, SIZES, SEED)


@query(
    f"""{_BASE}, {A.GOLD_OF_RUNS_SQL},
own AS (SELECT query_id, item_id, item_id AS position FROM gold UNION ALL SELECT id, id, id FROM scenarios WHERE id NOT IN (SELECT query_id FROM gold) AND id IN (SELECT id FROM items)),
n_own AS (SELECT query_id, count(*) AS n_own FROM own GROUP BY 1),
drawn AS (SELECT query_id, n_own, i.id AS item_id, row_number() OVER (PARTITION BY query_id ORDER BY md5('{SEED}:' || query_id || ':' || i.id), i.id) AS rn
  FROM items i CROSS JOIN n_own WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.query_id = n_own.query_id AND o.item_id = i.id)),
sizes AS (SELECT unnest({list(SIZES)}) AS pool_size),
pools AS (SELECT query_id, pool_size, item_id, n_own + rn AS ordinal FROM drawn CROSS JOIN sizes WHERE n_own + rn <= pool_size
  UNION ALL SELECT query_id, pool_size, item_id, row_number() OVER (PARTITION BY query_id, pool_size ORDER BY position, item_id) FROM own CROSS JOIN sizes)
SELECT query_id, pool_size, item_id, ordinal FROM pools"""
)
def pool_membership_nested(spark, sf_dir):
    """Pools whose distractors are all other items in a digest's order: every benchmark item meets every document. Gold is
    every document with a run of the item, from wherever in it."""
    universe = A.items(spark, sf_dir).select(F.col("id").alias("item_id"))
    return pools.ordered_pools(written(_own(spark, sf_dir, A.gold_of_runs(spark, sf_dir)), "own"), universe, SIZES, SEED)


_IN_POOLS = f"""{_POSTINGS},
sized AS (SELECT query_id, pool_size, count(*) AS items, avg(length) AS mean_length FROM pools JOIN lengths USING (item_id) GROUP BY ALL),
posted AS (SELECT query_id, pool_size, item_id, term, tf FROM terms JOIN counts USING (term) JOIN pools USING (query_id, item_id)),
weights AS (SELECT query_id, pool_size, term, mean_length, ln(1 + (items - df + 0.5) / (df + 0.5)) AS idf FROM (SELECT query_id, pool_size, term, count(*) AS df FROM posted GROUP BY ALL) JOIN sized USING (query_id, pool_size)),
scored AS (SELECT query_id, pool_size, item_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean_length))), 9) AS score
  FROM posted JOIN weights USING (query_id, pool_size, term) JOIN lengths USING (item_id) GROUP BY ALL),
ranking AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, pool_size ORDER BY score DESC, item_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 10),
asked_pools AS (SELECT DISTINCT query_id, pool_size FROM pools)"""
_POOL_METRICS = f"{_POOLED}, {_IN_POOLS}, {_metrics('query_id, pool_size', 'asked_pools', 'ranking', 'gold', '[1, 3, 5, 10]')}"


def pool_metrics(spark, sf_dir):
    """Metric rows of every scenario, pool size and k with pool-local statistics; pools are written, for they are read three times."""
    links = A.gold(spark, sf_dir)
    members = written(_pools(spark, sf_dir, links), "pools")
    ranked = ranking.bm25_in_pools(A.scenarios(spark, sf_dir), members, A.items(spark, sf_dir), max(KS))
    return metrics.at_ks(members, ranked, links, KS, by=("query_id", "pool_size"))


@query(f"{_POOL_METRICS} SELECT query_id, pool_size, {_SHOWN} FROM metric")
def bm25_pool_local(spark, sf_dir):
    return shown(pool_metrics(spark, sf_dir), "query_id", "pool_size")


_STATS = ", ".join(f"round(avg({c}), 6) AS mean_{n}, round(median({c}), 6) AS median_{n}" for c, n in (("precision_at_k", "precision"), ("recall_at_k", "recall"), ("reciprocal_rank", "mrr"), ("ndcg_at_k", "ndcg")))


def rounded(df, digits: int = 6):
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@query(
    f"""{_POOL_METRICS}, b AS (SELECT *, CASE WHEN gold_count > 1 THEN 'multi-tool' ELSE 'single-tool' END AS bucket FROM metric)
SELECT CASE WHEN grouping(bucket) = 1 THEN 'all' ELSE bucket END AS bucket, pool_size, k, count(*) AS n, {_STATS}, round(avg(hit_at_k::INT), 6) AS hit_rate, round(avg(complete_at_k::INT), 6) AS complete_rate, grouping(pool_size) = 1 AS overall
FROM b GROUP BY GROUPING SETS ((bucket, pool_size, k), (bucket, k), (pool_size, k), (k))"""
)
def summary_grouping_sets(spark, sf_dir):
    from rankyard.functions.labels import subset_of

    rows = pool_metrics(spark, sf_dir).withColumn("bucket", subset_of(F.col("gold_count")))
    return rounded(summary.by_bucket(rows))


@query(
    f"""{_POOL_METRICS}, once AS (SELECT pool_size, query_id, max(gold_score) AS s FROM metric GROUP BY ALL)
SELECT pool_size, round(coalesce(avg(s), 0), 6) AS mean_gold_score, round(coalesce(median(s), 0), 6) AS median_gold_score, round(coalesce(stddev_pop(s), 0), 6) AS stddev_gold_score, count(s) AS found, count(*) AS scenarios, round(count(s) / count(*), 6) AS coverage FROM once GROUP BY 1"""
)
def gold_score_coverage(spark, sf_dir):
    return rounded(summary.gold_scores(pool_metrics(spark, sf_dir), ["pool_size"]))


@query(
    f"""{_POOL_METRICS}, r AS (SELECT *, CASE WHEN query_id % 3 = 0 THEN 'sragents-d' || (query_id % 2) WHEN query_id % 3 = 1 THEN 'metatool-single' END AS category FROM metric),
p AS (SELECT *, CASE WHEN query_id % 3 = 0 THEN 'sragents' WHEN query_id % 3 = 1 THEN 'metatool' ELSE 'toolret' END AS corpus, CASE WHEN query_id % 3 = 0 THEN 'd' || (query_id % 2) WHEN query_id % 3 = 1 OR gold_count <= 1 THEN 'single-tool' ELSE 'multi-tool' END AS sub, CASE WHEN query_id % 3 = 0 THEN 'skill' ELSE 'tool' END AS mode FROM r),
q AS (SELECT *, unnest(CASE WHEN mode = 'skill' THEN [sub, 'all'] ELSE [sub] END) AS subset FROM p)
SELECT corpus, subset, mode, k, pool_size, count(*) AS n, {_STATS}, round(avg(complete_at_k::INT), 6) AS complete_set_rate, round(avg(hit_at_k::INT), 6) AS hit_rate, round(avg(complete_at_k::INT), 6) AS complete_rate FROM q GROUP BY ALL"""
)
def retrieval_by_corpus(spark, sf_dir):
    third = F.col("query_id") % 3
    corpus = F.when(third == 0, F.lit("sragents-")).when(third == 1, F.lit("metatool-st-")).otherwise(F.lit("toolret-x-"))
    category = F.when(third == 0, F.concat(F.lit("sragents-d"), (F.col("query_id") % 2).cast("string"))).when(third == 1, F.lit("metatool-single"))
    rows = pool_metrics(spark, sf_dir).withColumns({"scenario_id": F.concat(corpus, F.col("query_id").cast("string")), "category": category, "target_pool_size": F.col("pool_size")})
    return rounded(summary.by_corpus(rows))


@query(
    f"""{_POOL_METRICS}, r AS (SELECT *, CASE WHEN query_id % 2 = 0 THEN 'simple' ELSE 'multiple' END AS type, CASE query_id % 5 WHEN 0 THEN 'unknown' WHEN 1 THEN 'e2' ELSE 'e1' END AS engine_version FROM metric WHERE query_id % 7 <> 3)
SELECT engine_version, type, pool_size, k, count(*) AS n, {_STATS}, round(avg(hit_at_k::INT), 6) AS accuracy, round(avg(complete_at_k::INT), 6) AS complete_rate,
round(coalesce(avg(gold_score), 0), 6) AS mean_similarity, round(coalesce(median(gold_score), 0), 6) AS median_similarity, round(coalesce(stddev_pop(gold_score), 0), 6) AS stddev_similarity, round(count(gold_score) / count(*), 6) AS coverage,
(SELECT max('2026-01-' || lpad((query_id % 28 + 1)::VARCHAR, 2, '0')) FROM r) AS "timestamp", 'retriever_evaluation' AS source FROM r GROUP BY engine_version, type, pool_size, k"""
)
def retrieval_history(spark, sf_dir):
    kind = F.when(F.col("query_id") % 2 == 0, F.lit("simple")).otherwise(F.lit("multiple"))
    corpus = F.when(F.col("query_id") % 7 == 3, F.lit("toolret")).otherwise(F.lit("bfcl"))  # others than function calls have no history
    version = F.when(F.col("query_id") % 5 == 1, F.lit("e2")).when(F.col("query_id") % 5 > 1, F.lit("e1"))
    rows = pool_metrics(spark, sf_dir).withColumns({"scenario_id": F.concat_ws("-", corpus, kind, F.col("query_id").cast("string")), "target_pool_size": F.col("pool_size"), "engine_version": version, "generated_at": F.concat(F.lit("2026-01-"), F.lpad((F.col("query_id") % 28 + 1).cast("string"), 2, "0"))})
    return rounded(summary.retrieval_history(rows))


_SET_SIZES = (5, 20)


@query(
    f"""WITH RECURSIVE {A.ORDER_ITEMS_SQL}, {_pools_sql("order_items", "(SELECT p_partkey AS item_id FROM part)", _SET_SIZES, 7)}
SELECT query_id, pool_size, item_id, ordinal FROM pools"""
)
def pool_own_gold_every_order(spark, sf_dir):
    """Pools of all orders over all parts, whose own items are the parts of the order."""
    universe = A.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"))
    return pools.pools(A.order_items(spark, sf_dir), universe, _SET_SIZES, 7)


@query(
    f"""WITH {A.ORDER_ITEMS_SQL} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY position, item_id) AS ordinal, item_id,
CASE WHEN p_partkey IS NULL THEN item_id::VARCHAR ELSE p_name END AS name, CASE WHEN p_partkey IS NULL THEN 'gold tool ' || item_id || ' (synthesized: not in candidate_pool)' ELSE p_type END AS description
FROM order_items LEFT JOIN part ON p_partkey = item_id AND (query_id + item_id) % 3 > 0"""
)
def gold_in_gold_order(spark, sf_dir):
    """Every order's parts in gold order; a third of them is not in the order's pool."""
    gold = A.order_items(spark, sf_dir)
    part = A.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("name"), F.col("p_type").alias("description"))
    pooled, n = gold.where("(query_id + item_id) % 3 > 0").select("query_id", "item_id"), tasks(spark, A.read(spark, sf_dir, "lineitem").count())
    parts = part.count()
    pool = (pooled if parts <= FEW else pooled.repartition(n, "item_id")).join(few(part, parts), "item_id")
    return pools.resolved_gold(gold, pool, partitions=n)


_SET_RANKING = "set_ranking AS (SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM (SELECT l_orderkey AS query_id, l_partkey AS item_id, round(max(l_extendedprice), 9) AS score FROM lineitem WHERE l_quantity <= 30 GROUP BY ALL))"


@query(
    f"WITH {A.ORDER_ITEMS_SQL}, {_SET_RANKING}, top AS (SELECT * FROM set_ranking WHERE rank <= 5), ids AS (SELECT DISTINCT query_id FROM order_items), {_metrics('query_id', 'ids', 'top', 'order_items', '[1, 2, 5]')} SELECT query_id, {_SHOWN} FROM metric"
)
def multi_gold_recall_complete(spark, sf_dir):
    gold = A.order_items(spark, sf_dir)
    lines = A.read(spark, sf_dir, "lineitem").where("l_quantity <= 30").groupBy(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("item_id"))
    ranked = ranking.top(lines.agg(F.max("l_extendedprice").alias("score")), 5)
    return shown(metrics.at_ks(gold, ranked, gold, (1, 2, 5)), "query_id")


_COSINE = "list_sum(list_transform(list_zip(q.v, i.v), lambda p: p[1] * p[2])) / sqrt(list_sum(list_transform(q.v, lambda x: x * x)) * list_sum(list_transform(i.v, lambda x: x * x)))"
_DENSE = f"""vectors AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM (SELECT q.id AS query_id, i.id AS item_id, round({_COSINE}, 9) AS score FROM vectors q CROSS JOIN vectors i WHERE q.id % 25 = 0 AND i.id <> q.id)) WHERE rank <= 10)"""


def _dense(spark, sf_dir):
    vectors = A.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return vectors, ranking.dense(vectors.where("id % 25 = 0"), vectors, 10)


@query(f"WITH {_DENSE} SELECT query_id, item_id, round(score, 6) AS score, rank FROM dense")
def dense_cosine_topk(spark, sf_dir):
    """The stated query set (ids divisible by 25) against all vectors."""
    return _dense(spark, sf_dir)[1].withColumn("score", F.round("score", 6))


@query(
    f"""WITH {_DENSE}, prior AS (SELECT * FROM (SELECT q.id AS query_id, i.id AS item_id, row_number() OVER (PARTITION BY q.id ORDER BY md5('1:' || i.id), i.id) AS rank FROM vectors q JOIN vectors i ON q.label = i.label AND q.id <> i.id WHERE q.id % 25 = 0) WHERE rank <= 10),
s AS (SELECT query_id, item_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT query_id, item_id, rank FROM dense UNION ALL SELECT query_id, item_id, rank FROM prior) GROUP BY ALL)
SELECT query_id, item_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM s) WHERE rank <= 10"""
)
def hybrid_rrf_topk(spark, sf_dir):
    """Cosine fused with the items of the same label in seeded order."""
    from pyspark.sql.window import Window

    vectors, dense = _dense(spark, sf_dir)
    asked = vectors.where("id % 25 = 0").select(F.col("id").alias("query_id"), "label")
    order = F.md5(F.concat_ws(":", F.lit("1"), F.col("item_id").cast("string"))), F.col("item_id")
    # The order is the same for all queries: one more than ten of a label, for the query itself may be among them.
    first = F.dense_rank().over(Window.partitionBy("label").orderBy(*order))
    known = vectors.select(F.col("id").alias("item_id"), "label").where("label IS NOT NULL").withColumn("first", first).where("first <= 11")
    same = known.join(asked, "label").where("item_id <> query_id")
    prior = same.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where("rank <= 10")
    return ranking.fused([dense, prior], 10).withColumn("score", F.round("score", 6))


def _sample_sql(by: str) -> str:
    return f"d AS (SELECT doc_id, {by}, row_number() OVER (PARTITION BY {by} ORDER BY md5('42:' || doc_id), doc_id) AS draw FROM documents)"


@query(
    f"WITH {_sample_sql('lang')}, g AS (SELECT lang, row_number() OVER (ORDER BY lang) AS place, count(*) OVER () AS groups FROM (SELECT DISTINCT lang FROM documents)) SELECT doc_id, lang FROM d JOIN g USING (lang) WHERE draw <= 30 // groups + CASE WHEN place <= 30 % groups THEN 1 ELSE 0 END"
)
def stratified_quota_sample(spark, sf_dir):
    return sampling.stratified(A.read(spark, sf_dir, "documents").select("doc_id", "lang"), 30, SEED, "lang", "doc_id")


@query(f"WITH {_sample_sql('source')} SELECT doc_id, source FROM d ORDER BY draw, source LIMIT 50")
def round_robin_sample(spark, sf_dir):
    return sampling.round_robin(A.read(spark, sf_dir, "documents").select("doc_id", "source"), 50, SEED, "source", "doc_id")


@query("SELECT item_id, text FROM benchmark ORDER BY md5('42:' || item_id), item_id LIMIT 15")
def seeded_sample(spark, sf_dir):
    return sampling.seeded(A.read(spark, sf_dir, "benchmark"), 15, SEED, "item_id")


@query("SELECT item_id, text FROM benchmark ORDER BY item_id LIMIT 10")
def head_limit(spark, sf_dir):
    return sampling.head(A.read(spark, sf_dir, "benchmark"), 10, "item_id")


@query("SELECT doc_id, list_transform(list_sort(list_transform([doc_id, doc_id + 1, doc_id + 2, doc_id + 3], lambda x: {'key': md5('42:' || doc_id || ':' || x), 'x': x})), lambda e: e.x) AS shown FROM documents")
def neutral_order(spark, sf_dir):
    d = F.col("doc_id")
    rows = A.read(spark, sf_dir, "documents").select("doc_id", F.array(d, d + 1, d + 2, d + 3).alias("shown"))
    return pools.shuffled(rows, "shown", "doc_id", SEED)


@query("SELECT source, min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang FROM documents GROUP BY 1")
def universe_first_wins(spark, sf_dir):
    return pools.first_wins(A.read(spark, sf_dir, "documents").select("source", "doc_id", "lang"), "source", "doc_id")


@query("SELECT source, max(doc_id) AS doc_id, arg_max(lang, doc_id) AS lang FROM documents GROUP BY 1")
def catalogue_last_wins(spark, sf_dir):
    return pools.last_wins(A.read(spark, sf_dir, "documents").select("source", "doc_id", "lang"), "source", "doc_id")


@query(
    f"""{_GLOBAL}, {_metrics('query_id', 'asked_ids', 'ranking', 'gold', '[3, 10]')},
lists AS (SELECT query_id, list(item_id ORDER BY rank) AS full_pool, list(item_id ORDER BY rank) FILTER (WHERE rank <= 3) AS short FROM ranking GROUP BY 1)
SELECT query_id, full_pool, short FROM lists"""
)
def candidate_slices(spark, sf_dir):
    """Two slices of one scenario's rows, at the pool's k and at the shortlist's; both are needed."""
    rows = metrics.at_ks(_asked(spark, sf_dir), _bm25(spark, sf_dir), A.gold(spark, sf_dir), (3, 10))
    ids = lambda k: F.first(F.when(F.col("k") == k, F.transform("retrieved", lambda e: e["id"])), ignorenulls=True)
    both = rows.groupBy("query_id").agg(ids(10).alias("full_pool"), ids(3).alias("short"))
    return both.where("full_pool IS NOT NULL AND short IS NOT NULL AND size(full_pool) > 0")


_RUN_SQL = f"""{_POOLED}, {_IN_POOLS}, {_metrics('query_id, pool_size', 'asked_pools', 'ranking', 'gold', '[1, 3, 5, 10]')},
shape AS (SELECT query_id, pool_size, count(*)::INT AS actual_pool_size, list(item_id ORDER BY ordinal) AS pool_ids FROM pools GROUP BY ALL)
SELECT 'retrieval' AS run_type, 'run-1' AS run_id, '2026-01-01T00:00:00Z' AS generated_at, query_id AS scenario_id, s.text AS query, category, pool_size AS target_pool_size, actual_pool_size, pool_ids, 'e1' AS engine_version, k, {_SHOWN.removeprefix('k, ')}
FROM metric JOIN shape USING (query_id, pool_size) JOIN (SELECT id AS query_id, text, CASE WHEN id % 2 = 0 THEN 'metatool-single' END AS category FROM scenarios) s USING (query_id)"""


@query(_RUN_SQL.replace("shape AS (SELECT query_id", "shapes AS (SELECT query_id").replace("JOIN shape USING", "JOIN shapes USING"))
def retrieval_run_rows(spark, sf_dir):
    """The metric rows of a run over kept rankings: benchmark items as scenarios, their documents as own items."""
    links = A.gold(spark, sf_dir)
    lists = lambda df, name: df.groupBy(F.col("query_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("item_id"))), lambda e: e["item_id"]).alias(name))
    asked = A.scenarios(spark, sf_dir).withColumnRenamed("text", "prompt").withColumn("category", F.when(F.col("id") % 2 == 0, F.lit("metatool-single")))
    asked = asked.join(lists(_own(spark, sf_dir, links), "own"), "id").join(lists(links, "gold_tools"), "id", "left").withColumn("gold_tools", F.coalesce("gold_tools", F.array().cast("array<bigint>")))
    store = runs.RankingStore(spark, f"{shared_folder(spark)}/rankings-{uuid.uuid4().hex}")
    rows = runs.evaluate(written(asked, "asked"), A.items(spark, sf_dir).select("id", "text"), KS, SIZES, SEED, runs.Run("e1", run_id="run-1", generated_at="2026-01-01T00:00:00Z"), store=store)
    return shown(rows, *("run_type", "run_id", "generated_at", "scenario_id", "query", "category", "target_pool_size", "actual_pool_size", "pool_ids", "engine_version"))
