"""Queries of the campaign half: averages, savings, failures, planning, histories, comparisons, judging."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankyard.functions import labels
from rankyard.operators import calls, cells, compare, metrics
from rankyard.operators import rejudge as rejudging
from rankyard.plans import adapters as A
from rankyard.plans.registry import query
from rankyard.plans.retrieval import rounded
from rankyard.streaming import rollups

_CELLS = f"WITH {A.CELLS_SQL}"
_MEAN_NAMES = {"catalog_size": "mean_catalog_size", "input_tokens": "mean_input_tokens", "total_tokens": "mean_total_tokens", "turns": "mean_turns", "dollar_cost": "mean_dollar_cost", "wall_ms": "mean_wall_ms"}
_AVERAGES = f"""
per_scenario AS (SELECT arm, model, 'bfcl' AS category, pool_size, scenario_id, avg((programmatic_verdict = 'pass' OR judge_verdict = 'pass')::INT) AS success_rate,
  avg(CASE WHEN ast_verdict <> 'n/a' THEN (ast_verdict = 'pass')::INT END) AS task_rate, count(*) AS runs, {', '.join(f'avg({c}::DECIMAL(28,12)) AS {m}' for c, m in _MEAN_NAMES.items())} FROM cells GROUP BY arm, model, pool_size, scenario_id),
averages AS (SELECT arm, model, category, pool_size, count(*) AS scenarios, sum(runs)::BIGINT AS n, avg(success_rate::DECIMAL(28,12)) AS success_rate, avg(task_rate::DECIMAL(28,12)) AS task_completion_rate, {', '.join(f'avg({m}::DECIMAL(28,12)) AS {m}' for m in _MEAN_NAMES.values())} FROM per_scenario GROUP BY ALL)"""
_ROUNDED = ", ".join(f"round({m}::DECIMAL(28,12), 6)::DOUBLE AS {m}" for m in ("success_rate", "task_completion_rate", *_MEAN_NAMES.values()))


@query(f"{_CELLS}, {_AVERAGES} SELECT arm, model, category, pool_size, scenarios, n, {_ROUNDED} FROM averages")
def cells_macro_average(spark, sf_dir):
    return rounded(cells.macro_average(A.cells(spark, sf_dir)))


_SIDES = ", ".join(f"round(c.mean_{v}, 6) AS control_{v}, round(t.mean_{v}, 6) AS treated_{v}" for v in ("input_tokens", "total_tokens", "dollar_cost", "turns", "wall_ms"))
_SAVED = ", ".join(f"round(CASE WHEN c.mean_{v} = 0 THEN 0 ELSE (1 - t.mean_{v} / c.mean_{v}) * 100 END, 6) AS {n}_savings_pct" for n, v in (("input", "input_tokens"), ("total", "total_tokens"), ("dollar", "dollar_cost"), ("wall", "wall_ms")))


@query(
    f"""{_CELLS}, {_AVERAGES} SELECT c.model, c.category, c.pool_size, {_SIDES}, round(coalesce(o.mean_input_tokens, 0), 6) AS oracle_input_tokens, round(coalesce(o.mean_turns, 0), 6) AS oracle_turns, {_SAVED}
FROM averages c JOIN averages t ON c.arm = 'baseline' AND t.arm = 'full' AND c.model = t.model AND c.category = t.category AND c.pool_size = t.pool_size LEFT JOIN averages o ON o.arm = 'oracle' AND o.model = c.model AND o.category = c.category"""
)
def savings_pairing(spark, sf_dir):
    return rounded(cells.savings(cells.macro_average(A.cells(spark, sf_dir))))


_FAILURES = "count(*) FILTER (WHERE programmatic_verdict = 'pass') AS pass, count(*) FILTER (WHERE programmatic_verdict = 'fail') AS fail, count(error) AS errored, count(*) FILTER (WHERE programmatic_verdict = 'fail' AND tool_calls_total > 0) AS missing_gold, count(*) FILTER (WHERE finish_reason IN ('max-steps', 'tool-calls')) AS step_limit"


@query(f"{_CELLS} SELECT arm, model, 'bfcl' AS category, pool_size, {_FAILURES} FROM cells GROUP BY arm, model, pool_size")
def failure_taxonomy(spark, sf_dir):
    return cells.failures(A.cells(spark, sf_dir))


@query(
    f"""{_CELLS} SELECT engine_version, category[6:] AS type, model, arm, max(generated_at) AS timestamp, count(*) AS scenarios, round(avg(CASE WHEN ast_verdict <> 'n/a' THEN (ast_verdict = 'pass')::INT END), 6) AS task_completion_accuracy,
round(avg((programmatic_verdict = 'pass')::INT), 6) AS selection_accuracy, round(avg(total_tokens), 6) AS mean_total_tokens, round(median(wall_ms), 6) AS latency_p50_ms FROM cells GROUP BY ALL"""
)
def task_history(spark, sf_dir):
    some = A.cells(spark, sf_dir)
    known = some.select("scenario_id").distinct().where("pmod(hash(scenario_id), 2) = 0").withColumns({"prompt": F.lit("q"), "gold_tools": F.array(F.lit("t"))})
    rows = cells.task_rows(some, known).withColumn("type", labels.call_type(F.col("scenario_id")))
    return rounded(cells.task_history(rows, "type"))


@query(
    f"""{_CELLS}, r AS (SELECT *, unnest(['d' || (event_id % 3), 'all']) AS dataset FROM cells)
SELECT engine_version, dataset, model, arm, max(generated_at) AS timestamp, count(*) AS scenarios, round(avg(CASE WHEN ast_verdict <> 'n/a' THEN (ast_verdict = 'pass')::INT END), 6) AS task_completion_accuracy,
round(avg((programmatic_verdict = 'pass')::INT), 6) AS selection_accuracy, round(avg(total_tokens), 6) AS mean_total_tokens, round(median(wall_ms), 6) AS latency_p50_ms FROM r GROUP BY engine_version, dataset, model, arm"""
)
def task_history_rollup(spark, sf_dir):
    known = spark.createDataFrame([], "scenario_id string, prompt string, gold_tools array<string>")
    rows = cells.task_rows(A.cells(spark, sf_dir), known).withColumn("dataset", F.concat(F.lit("d"), (F.col("event_id") % 3).cast("string")))
    return rounded(cells.task_history(rows, "dataset", roll_up=True))


@query(f"{_CELLS}, m AS (SELECT *, max(generated_at) OVER (PARTITION BY model, arm, category) AS last FROM cells) SELECT event_id, model, arm, category, generated_at FROM m WHERE generated_at = last")
def latest_run_per_group(spark, sf_dir):
    return cells.latest_runs(A.cells(spark, sf_dir), ["model", "arm", "category"]).select("event_id", "model", "arm", "category", "generated_at")


_QUEUE = """
dims AS (SELECT arm, pool_size, model, run_index FROM (SELECT 'oracle' AS arm, NULL::INT AS pool_size UNION ALL SELECT a, p FROM (VALUES ('baseline'), ('full')) x(a), (VALUES (30), (100), (180)) y(p)), (VALUES ('m0'), ('m1')) z(model), (SELECT unnest([1, 2]) AS run_index)),
queue AS (SELECT scenario_id, dims.* FROM (SELECT DISTINCT scenario_id FROM cells) CROSS JOIN dims)"""


def _queue(spark, sf_dir, some):
    arms = spark.createDataFrame([("oracle", True), ("baseline", False), ("full", False)], "arm string, pool_agnostic boolean")
    models = spark.createDataFrame([("m0",), ("m1",)], "model string")
    sizes = spark.createDataFrame([(30,), (100,), (180,)], "pool_size int")
    return cells.task_queue(some.select("scenario_id").distinct(), arms, models, sizes, 2)


@query(f"{_CELLS}, {_QUEUE} SELECT arm, pool_size, model, run_index, count(*) AS queued FROM queue GROUP BY ALL")
def task_queue(spark, sf_dir):
    some = A.cells(spark, sf_dir)
    return _queue(spark, sf_dir, some).groupBy("arm", "pool_size", "model", "run_index").agg(F.count("*").alias("queued"))


@query(f"{_CELLS}, {_QUEUE} SELECT scenario_id, arm, pool_size, model, run_index FROM queue q WHERE NOT EXISTS (SELECT 1 FROM cells c WHERE c.scenario_id = q.scenario_id AND c.arm = q.arm AND c.model = q.model AND c.run_index = q.run_index AND c.pool_size IS NOT DISTINCT FROM q.pool_size)")
def resume_anti_join(spark, sf_dir):
    some = A.cells(spark, sf_dir)
    return cells.pending(_queue(spark, sf_dir, some), some).select("scenario_id", "arm", "pool_size", "model", "run_index")


@query(
    f"""{_CELLS}, {_QUEUE}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scenario_id, arm, model, run_index, pool_size ORDER BY generated_at, event_id) AS rn FROM cells WHERE arm IN ('baseline', 'oracle')) WHERE rn = 1)
SELECT f.event_id, f.scenario_id, f.arm, f.model, f.pool_size, f.run_index, 'v9' AS sdk_version, '2026-01-01' AS generated_at FROM queue q JOIN f ON f.scenario_id = q.scenario_id AND f.arm = q.arm AND f.model = q.model AND f.run_index = q.run_index AND f.pool_size IS NOT DISTINCT FROM q.pool_size"""
)
def earliest_control_reuse(spark, sf_dir):
    some = A.cells(spark, sf_dir)
    found = cells.reused_controls(_queue(spark, sf_dir, some), some, "v9", "2026-01-01")
    return found.select("event_id", "scenario_id", "arm", "model", "pool_size", "run_index", "sdk_version", "generated_at")


@query(
    f"""{_CELLS}, o AS (SELECT scenario_id, max(event_id) AS v FROM cells WHERE arm = 'baseline' GROUP BY 1), x AS (SELECT scenario_id, min(event_id) AS v FROM cells GROUP BY 1)
SELECT scenario_id, coalesce(o.v, x.v) AS v, CASE WHEN o.v IS NULL THEN 'other' ELSE 'own' END AS origin FROM x LEFT JOIN o USING (scenario_id)"""
)
def keyed_merge_precedence(spark, sf_dir):
    """The last baseline cell of every scenario, and for scenarios without one their first cell from a second table."""
    every = A.cells(spark, sf_dir)
    own = every.where("arm = 'baseline'").groupBy("scenario_id").agg(F.max("event_id").alias("v"), F.lit("own").alias("origin"))
    return cells.merged(own, every.groupBy("scenario_id").agg(F.min("event_id").alias("v"), F.lit("other").alias("origin")), "scenario_id")


_SPENT = "s AS (SELECT *, round(coalesce(sum(dollar_cost) OVER (PARTITION BY scenario_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS spent_before FROM cells)"


@query(f"{_CELLS}, {_SPENT} SELECT event_id, scenario_id, spent_before FROM s WHERE spent_before < 0.2")
def spend_cap_replay(spark, sf_dir):
    return cells.until_spent(A.cells(spark, sf_dir), 0.2, "scenario_id", "event_id").select("event_id", "scenario_id", "spent_before")


_ALL_SPENT = "s AS (SELECT *, round(coalesce(sum(dollar_cost) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS spent_before FROM cells)"


@query(f"{_CELLS}, {_ALL_SPENT} SELECT event_id, scenario_id, spent_before FROM s WHERE spent_before < 20")
def spend_cap_campaign(spark, sf_dir):
    """One cap over all cells of the campaign."""
    return cells.until_all_spent(A.cells(spark, sf_dir), 20.0, "event_id").select("event_id", "scenario_id", "spent_before")


_PRICES = [("m0", 3.0, 15.0, 0.3, 3.75), ("m1", 0.25, 1.25, 0.03, 0.3)]


@query(f"{_CELLS} SELECT model, count(*) AS n, round(sum(CASE model WHEN 'm0' THEN (input_tokens * 3.0 + total_tokens * 15.0 + turns * 0.3) / 1e6 WHEN 'm1' THEN (input_tokens * 0.25 + total_tokens * 1.25 + turns * 0.03) / 1e6 ELSE 0 END), 6) AS cost FROM cells GROUP BY 1")
def cost_by_model(spark, sf_dir):
    usage = A.cells(spark, sf_dir).select("model", "input_tokens", F.col("total_tokens").alias("output_tokens"), F.col("turns").alias("cached_input_tokens"), F.lit(0).alias("cache_creation_tokens"))
    prices = spark.createDataFrame(_PRICES, "model string, input double, output double, cached_input double, cache_creation double")
    return cells.dollar_cost(usage, prices).groupBy("model").agg(F.count("*").alias("n"), F.round(F.sum("dollar_cost"), 6).alias("cost"))


_VERSIONS = "h AS (SELECT category AS bucket, engine_version, 100 AS pool_size, 3 AS k, event_id, total_tokens::DOUBLE AS metric FROM cells), l AS (SELECT bucket, engine_version, arg_max(metric, event_id) AS value FROM h GROUP BY ALL)"


@query(
    f"""{_CELLS}, {_VERSIONS}, g AS (SELECT b.bucket, v.engine_version, value, array_to_string(list_transform(regexp_split_to_array(v.engine_version, '[.-]'), lambda p: CASE WHEN regexp_full_match(p, '[0-9]+') THEN lpad(p, 12, '0') ELSE p END), '.') AS key
FROM (SELECT DISTINCT bucket FROM l) b CROSS JOIN (SELECT DISTINCT engine_version FROM l) v LEFT JOIN l USING (bucket, engine_version)),
d AS (SELECT bucket, (SELECT value FROM g x WHERE x.bucket = g.bucket ORDER BY key DESC LIMIT 1) - (SELECT value FROM g x WHERE x.bucket = g.bucket ORDER BY key LIMIT 1) AS delta FROM (SELECT DISTINCT bucket FROM g) g)
SELECT bucket, engine_version, value, delta FROM g JOIN d USING (bucket)"""
)
def version_compare_pivot(spark, sf_dir):
    rows = A.cells(spark, sf_dir).select(F.col("category").alias("bucket"), "engine_version", F.lit(100).alias("pool_size"), F.lit(3).alias("k"), "event_id", F.col("total_tokens").cast("double").alias("metric"))
    return compare.across_versions(rows, "metric", 100, 3, "event_id")


@query(f"{_CELLS} SELECT engine_version, count(*) AS n FROM cells WHERE engine_version NOT LIKE '%-%' GROUP BY 1")
def prune_prerelease(spark, sf_dir):
    return compare.without_prereleases(A.cells(spark, sf_dir)).groupBy("engine_version").agg(F.count("*").alias("n"))


@query()
def nested_report(spark, sf_dir):
    rows = A.cells(spark, sf_dir).groupBy("engine_version", "model", "arm", "category").agg(F.count("*").alias("scenarios"), F.round(F.avg("total_tokens"), 6).alias("mean_total_tokens"))
    return compare.nested(rows, ["engine_version", "model", "arm", "category"])


@query(f"{_CELLS} SELECT DISTINCT scenario_id, CASE WHEN scenario_id LIKE 'bfcl-simple-%' THEN 'bfcl-simple' ELSE 'bfcl-multiple' END AS corpus, 'bfcl' AS coarse, category[6:] AS type, CASE WHEN turns > 1 THEN 'multi-tool' ELSE 'single-tool' END AS subset, 'tool' AS mode FROM cells")
def corpus_bucket_labels(spark, sf_dir):
    c, bucket = A.cells(spark, sf_dir), labels.bucket_of(F.col("category"), F.col("turns"))
    return c.select("scenario_id", labels.corpus_of(F.col("scenario_id")).alias("corpus"), labels.category_of(F.col("category")).alias("coarse"), labels.call_type(F.col("scenario_id")).alias("type"), bucket["subset"].alias("subset"), bucket["mode"].alias("mode")).distinct()


@query(
    """WITH g AS (SELECT l_orderkey AS id, list_distinct(list(l_partkey)) AS gold FROM lineitem GROUP BY 1), s AS (SELECT l_orderkey AS id, list_distinct(list(l_partkey)) AS selected FROM lineitem WHERE l_linenumber <= 2 OR l_returnflag = 'A' GROUP BY 1),
m AS (SELECT g.id, len(gold) AS g, len(list_filter(selected, lambda x: x % 2 = 0)) AS s, len(list_filter(gold, lambda x: list_contains(selected, x) AND x % 2 = 0)) AS hits FROM g JOIN s USING (id))
SELECT id, hits, hits > 0 AS selection_pass, hits = g AS complete, round(hits / g, 6) AS recall, CASE WHEN s = 0 THEN 0 ELSE round(hits / s, 6) END AS precision, CASE WHEN hits > 0 THEN 'pass' ELSE 'fail' END AS verdict FROM m"""
)
def selection_set_metrics(spark, sf_dir):
    lines = A.read(spark, sf_dir, "lineitem").withColumn("id", F.col("l_orderkey"))
    gold = lines.groupBy("id").agg(F.collect_set("l_partkey").alias("gold"))
    chosen = lines.where("l_linenumber <= 2 OR l_returnflag = 'A'").groupBy("id").agg(F.filter(F.collect_set("l_partkey"), lambda x: x % 2 == 0).alias("selected"))
    rows = metrics.selection(gold.join(chosen, "id")).withColumn("verdict", metrics.selection_verdict(F.col("gold"), F.col("selected")))
    return rounded(rows.select("id", "hits", "selection_pass", "complete", "recall", "precision", "verdict"))


@query(
    """WITH shown AS (SELECT l_orderkey AS id, list(l_partkey) FILTER (WHERE l_linenumber % 2 = 1) AS pool, list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey) || list(l_suppkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS chosen FROM lineitem GROUP BY 1)
SELECT id, list_filter(chosen, lambda x: list_contains(coalesce(pool, []), x)) AS kept FROM shown"""
)
def drop_hallucinated_ids(spark, sf_dir):
    """Chosen ids that were shown, in the order of choice with repeats: an order chooses its parts and suppliers and was shown
    the parts of every second line."""
    lines = A.read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("l"))
    chosen = F.concat(F.transform("l", lambda e: e["l_partkey"]), F.transform("l", lambda e: e["l_suppkey"]))
    pool = F.transform(F.filter("l", lambda e: e["l_linenumber"] % 2 == 1), lambda e: e["l_partkey"])
    return lines.select("id", chosen.alias("chosen"), pool.alias("pool")).select("id", F.filter("chosen", lambda x: F.array_contains("pool", x)).alias("kept"))


@query(
    """WITH s AS (SELECT conv_id, turn, CASE role WHEN 'system' THEN 'search_tools' WHEN 'assistant' THEN 'invoke_tool' ELSE 'direct' END AS tool, length(text) AS t FROM conversations)
SELECT conv_id, sum(t)::BIGINT AS input_tokens, sum(t // 2)::BIGINT AS output_tokens, sum(t // 4)::BIGINT AS cached_input_tokens, 0::BIGINT AS cache_creation_tokens, sum(t + t // 2 + 0)::BIGINT + sum(t // 4)::BIGINT AS total_tokens, count(*) AS tool_calls_total,
count(DISTINCT tool) AS tool_calls_unique, count(*) FILTER (WHERE tool <> 'direct') AS gateway_calls, count(*) FILTER (WHERE tool = 'direct') AS non_gateway_calls, count(DISTINCT turn) AS turns FROM s GROUP BY 1"""
)
def trace_metering(spark, sf_dir):
    t = F.length("text")
    half, quarter = F.floor(t / 2), F.floor(t / 4)
    tool = F.when(F.col("role") == "system", F.lit(calls.SEARCH)).when(F.col("role") == "assistant", F.lit(calls.INVOKE)).otherwise(F.lit("direct"))
    steps = A.read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("step"), tool.alias("tool"), t.alias("input_tokens"), half.alias("output_tokens"), quarter.alias("cached_input_tokens"), F.lit(0).alias("cache_creation_tokens"), F.lit(0).alias("total_tokens"))
    out = calls.metered(steps, "conv_id")
    return out.select(*(F.col(c).cast("bigint").alias(c) for c in out.columns))


@query(
    """WITH s AS (SELECT conv_id, turn, length(text) AS t FROM conversations), c AS (SELECT *, unnest(list_slice(['search_tools', 'invoke_tool', 'direct'], 1, (t % 4)::INT)) AS tool FROM s),
u AS (SELECT conv_id, sum(t)::BIGINT AS input_tokens, sum(t // 2)::BIGINT AS output_tokens, count(*) AS turns FROM s GROUP BY 1),
n AS (SELECT conv_id, count(*) AS calls, count(DISTINCT tool) AS different, count(*) FILTER (WHERE tool <> 'direct') AS gateway FROM c GROUP BY 1)
SELECT conv_id, input_tokens, output_tokens, 0::BIGINT AS cached_input_tokens, 0::BIGINT AS cache_creation_tokens, input_tokens + output_tokens AS total_tokens, coalesce(calls, 0) AS tool_calls_total,
coalesce(different, 0) AS tool_calls_unique, coalesce(gateway, 0) AS gateway_calls, coalesce(calls - gateway, 0) AS non_gateway_calls, turns FROM u LEFT JOIN n USING (conv_id)"""
)
def trace_metering_several_calls(spark, sf_dir):
    """Steps of none to three calls: their tokens count once."""
    t = F.length("text")
    tools = F.slice(F.array(F.lit(calls.SEARCH), F.lit(calls.INVOKE), F.lit("direct")), F.lit(1), t % 4)
    zero = [F.lit(0).alias(c) for c in ("cached_input_tokens", "cache_creation_tokens", "total_tokens")]
    steps = A.read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("step"), F.explode_outer(tools).alias("tool"), t.alias("input_tokens"), F.floor(t / 2).alias("output_tokens"), *zero)
    out = calls.metered(steps, "conv_id")
    return out.select(*(F.col(c).cast("bigint").alias(c) for c in out.columns))


@query(
    """SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN ['t' || (conv_id % 3), role] WHEN 1 THEN [role] WHEN 2 THEN ['search', role, 't' || length(text)] ELSE []::VARCHAR[] END AS effective FROM conversations"""
)
def gateway_unwrapping(spark, sf_dir):
    """Calls of several kinds by turn: with a search and an invocation, with an invocation of nothing, an invoked tool whose
    name is like the search's, and searches alone."""
    call = lambda tool, args: F.struct(tool.alias("tool_id"), args.alias("args"))
    invoked = lambda x: call(F.lit(calls.INVOKE), F.concat(F.lit('{"toolId": "'), x, F.lit('", "args": {"a": 1}}')))
    none = F.lit("{}")
    search, direct = call(F.lit(calls.SEARCH), none), call(F.col("role"), none)
    t = lambda x: F.concat(F.lit("t"), x.cast("string"))
    kinds = F.when(F.col("turn") % 4 == 0, F.array(search, invoked(t(F.col("conv_id") % 3)), direct)).when(F.col("turn") % 4 == 1, F.array(direct, call(F.lit(calls.INVOKE), none)))
    kinds = kinds.when(F.col("turn") % 4 == 2, F.array(call(F.lit("search"), none), direct, search, invoked(t(F.length("text"))))).otherwise(F.array(search, search))
    rows = A.read(spark, sf_dir, "conversations").withColumn("calls", kinds)
    return rows.select("conv_id", "turn", calls.effective_ids(F.col("calls")).alias("effective"))


@query(
    """WITH s AS (SELECT conv_id, turn, CASE role WHEN 'system' THEN 'search_tools' ELSE CASE WHEN conv_id % 2 = 0 THEN 'speech' ELSE role END END AS tool, length(text) AS t FROM conversations)
SELECT conv_id, sum(t)::BIGINT AS input_tokens, sum(t)::BIGINT AS total_tokens, count(*) AS tool_calls_total, count(DISTINCT tool) AS tool_calls_unique, count(*) FILTER (WHERE tool = 'search_tools') AS gateway_calls, count(DISTINCT turn) AS turns FROM s GROUP BY 1"""
)
def trace_metering_canonical(spark, sf_dir):
    """Calls counted by the ids of their tools: in every second conversation both speakers' names mean one tool."""
    t = F.length("text")
    tool = F.when(F.col("role") == "system", F.lit(calls.SEARCH)).otherwise(F.concat(F.lit("fn_"), "role"))
    zero = [F.lit(0).alias(f"{k}_tokens") for k in ("output", "cached_input", "cache_creation", "total")]
    c = A.read(spark, sf_dir, "conversations")
    steps = c.select("conv_id", F.col("turn").alias("step"), tool.alias("tool"), t.alias("input_tokens"), *zero)
    names = c.where("role <> 'system'").select("conv_id", F.concat(F.lit("fn_"), "role").alias("name"), F.when(F.col("conv_id") % 2 == 0, F.lit("speech")).otherwise(F.col("role")).alias("id")).distinct()
    out = calls.metered(steps, "conv_id", names=names)
    return out.select("conv_id", *(F.col(x).cast("bigint").alias(x) for x in ("input_tokens", "total_tokens", "tool_calls_total", "tool_calls_unique", "gateway_calls", "turns")))


@query(
    f"""WITH {A.ORDER_ITEMS_SQL}, s AS (SELECT query_id, list(item_id ORDER BY md5('42:' || query_id || ':' || item_id)) AS mixed, list(item_id ORDER BY position, item_id)[1:2] AS short, list(item_id ORDER BY position, item_id)[1:1] AS gold, count(*)::INT AS n FROM order_items GROUP BY 1)
SELECT query_id AS scenario_id, 'baseline' AS arm, n AS pool_size, mixed AS ids FROM s UNION ALL SELECT query_id, 'full', n, short FROM s UNION ALL SELECT query_id, 'oracle', NULL, gold FROM s"""
)
def arm_candidate_lists(spark, sf_dir):
    """What the arms of a selection campaign are shown of every order: all its parts in seeded order, the first two, the first."""
    lists = A.order_items(spark, sf_dir).groupBy(F.col("query_id").alias("scenario_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "item_id"))), lambda e: e["item_id"]).alias("full_pool"))
    sets = lists.select("scenario_id", F.size("full_pool").alias("pool_size"), "full_pool", F.slice("full_pool", 1, 2).alias("short"), F.slice("full_pool", 1, 1).alias("gold"))
    return calls.arm_candidates(sets, 42)


@query(f"{_CELLS} SELECT engine_version, model, arm, category, count(*) AS scenarios, round(avg(total_tokens)::DECIMAL(28,12), 6)::DOUBLE AS mean_total_tokens, 'read' AS status FROM cells GROUP BY ALL")
def report_scan(spark, sf_dir):
    """The nested report of all cells, scanned again: nesting and flattening are inverse to each other."""
    report = nested_report(spark, sf_dir)
    return compare.flattened(report, ["engine_version", "model", "arm", "category"], "scenarios BIGINT, mean_total_tokens DOUBLE")


@query(
    """WITH o AS (SELECT l_orderkey AS query_id, count(DISTINCT l_partkey) AS n, count(DISTINCT l_partkey) FILTER (WHERE l_linenumber = 1) AS g FROM lineitem GROUP BY 1)
SELECT * FROM (SELECT query_id, arm, CASE arm WHEN 'baseline' THEN n WHEN 'oracle' THEN g WHEN 'prefetch' THEN least(n, 2) WHEN 'full' THEN least(n, 2) + 2 ELSE 2 END AS catalog_size FROM o CROSS JOIN (SELECT unnest(['baseline', 'oracle', 'prefetch', 'full', 'gateway']) AS arm)) WHERE catalog_size > 0"""
)
def visible_per_arm(spark, sf_dir):
    from rankyard.operators.ranking import top

    own = A.order_items(spark, sf_dir)
    gold = A.read(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("item_id")).distinct()
    ranked = top(own.withColumn("score", 1.0 / F.col("position")), 2)
    return calls.catalog_sizes(calls.visible(own.select("query_id").distinct(), own, gold, ranked, 2))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_rollup_windows(spark, sf_dir):
    """The batch run of the streaming roll-up."""
    return rollups.windowed(A.read(spark, sf_dir, "events"), "1 hour")


@query(
    """WITH s AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM s)
SELECT min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, user_id, count(*) AS n FROM g GROUP BY user_id, sid"""
)
def stream_sessions(spark, sf_dir):
    return rollups.sessions(A.read(spark, sf_dir, "events"), "30 minutes")


_VERDICTS = """SELECT conv_id, turn, CASE WHEN role IN ('user', 'assistant') THEN 'pass' ELSE 'fail' END AS verdict, FALSE AS wrong_tool,
CASE WHEN role IN ('user', 'assistant') THEN []::VARCHAR[] ELSE ['say: ''role''="' || role || '" not in ["User","assistant"]'] END AS arg_mismatches, CASE WHEN role IN ('user', 'assistant') THEN 1.0 ELSE 0.5 END::DOUBLE AS recall FROM conversations"""


@query(_VERDICTS)
def ast_verdicts(spark, sf_dir):
    """Recorded calls of conversations against gold calls that name the role and a text length."""
    from rankyard.functions.arguments import argument_recall, ast_verdict, effective_calls

    n = F.length("text").cast("string")
    observed = F.concat(F.lit('[{"tool_id": "invoke_tool", "args": {"toolId": "say", "args": {"role": "'), F.col("role"), F.lit('", "n": "'), n, F.lit('"}}}]'))
    gold = F.concat(F.lit('[{"tool": "say", "args": {"role": ["User", "assistant"], "n": ['), n, F.lit('], "tone": ["", "dry"]}}]'))
    rows = A.read(spark, sf_dir, "conversations").select("conv_id", "turn", gold.alias("gold"), effective_calls(observed).alias("observed"))
    out = rows.withColumn("judged", ast_verdict("gold", "observed")).withColumn("recall", argument_recall("gold", "observed"))
    return out.select("conv_id", "turn", "judged.verdict", "judged.wrong_tool", "judged.arg_mismatches", "recall")


def _rejudged(spark, sf_dir):
    """All cells against a table of their scenarios. Scenarios of the type simple have gold calls: area with base 1 (or
    "one") and any or no unit. What a cell called depends on its turns: another tool for every fifth, else area with the
    base turns % 2, behind the gateway for every third. The judge passes texts of even length."""
    c = A.cells(spark, sf_dir)
    gold = F.when(F.col("scenario_id").startswith("bfcl-simple-"), F.lit('[{"tool": "area", "args": {"base": [1, "one"], "unit": ["", "m"]}}]')).otherwise(F.lit("[]"))
    scenarios = c.select("scenario_id").distinct().select(F.col("scenario_id").alias("id"), F.lit("p").alias("prompt"), F.lit(None).cast("string").alias("judge_criteria"), gold.alias("gold_calls"))
    base = F.concat(F.lit('{"base": '), (F.col("turns") % 2).cast("string"), F.lit("}"))
    call = F.when(F.col("turns") % 5 == 0, F.lit('{"tool_id": "volume", "args": {"base": 1}}'))
    call = call.when(F.col("turns") % 3 == 0, F.concat(F.lit('{"tool_id": "invoke_tool", "args": {"toolId": "area", "args": '), base, F.lit("}}")))
    call = call.otherwise(F.concat(F.lit('{"tool_id": "area", "args": '), base, F.lit("}")))
    stored = c.withColumns({"tool_calls": F.concat(F.lit("["), call, F.lit("]")), "final_text": F.repeat(F.lit("x"), F.col("turns")), "judge_explanation": F.lit(None).cast("string")})
    judge = lambda prompt, criteria, text, rubric: F.struct(F.when(F.length(text) % 2 == 0, "pass").otherwise("fail").alias("verdict"), F.concat(rubric, F.lit(": "), prompt).alias("explanation"))
    return rejudging.rejudge(stored, scenarios, judge)


_ANEW = """anew AS (SELECT *, scenario_id LIKE 'bfcl-simple-%' AS scored, CASE WHEN scenario_id NOT LIKE 'bfcl-simple-%' THEN ast_verdict WHEN turns % 5 <> 0 AND turns % 2 = 1 THEN 'pass' ELSE 'fail' END AS ast_new,
  CASE WHEN programmatic_verdict = 'pass' THEN judge_verdict WHEN turns % 2 = 0 THEN 'pass' ELSE 'fail' END AS judge_new FROM cells)"""


@query(f"{_CELLS}, {_ANEW} SELECT arm, ast_new AS ast_verdict, judge_new AS judge_verdict, count(*) AS n, count(*) FILTER (WHERE programmatic_verdict <> 'pass') AS explained FROM anew GROUP BY ALL")
def rejudge(spark, sf_dir):
    """Cells by their new verdicts."""
    return _rejudged(spark, sf_dir).rows.groupBy("arm", "ast_verdict", "judge_verdict").agg(F.count("*").alias("n"), F.count_if(F.col("judge_explanation") == "strict: p").alias("explained"))


@query(f"{_CELLS}, {_ANEW} SELECT count(*) AS total, count(*) FILTER (WHERE programmatic_verdict <> 'pass') AS rejudged, count(*) FILTER (WHERE scored) AS ast_scored, count(*) FILTER (WHERE programmatic_verdict = 'pass') AS skipped_pass, count(*) FILTER (WHERE ast_new <> ast_verdict) AS changed FROM anew")
def rejudge_counters(spark, sf_dir):
    """What was judged anew, from the pass that wrote it."""
    return _rejudged(spark, sf_dir).audit
