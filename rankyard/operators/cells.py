"""Campaign cells: averages, savings, failures, histories, planning and reuse.

A cell is one judged run of (scenario, arm, model, pool, run). A null pool size means that the arm knows no pool; it groups
with itself and is joined null-safe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankyard.functions.labels import category_of, percent_saved
from rankyard.operators.medians import same, with_medians
from rankyard.operators.summary import ALL, latest, mean, or_zero, share
from rankyard.staging import few

CONTROL, TREATED, ORACLE = "baseline", "full", "oracle"
MEANS = {"catalog_size": "mean_catalog_size", "input_tokens": "mean_input_tokens", "total_tokens": "mean_total_tokens", "turns": "mean_turns", "dollar_cost": "mean_dollar_cost", "wall_ms": "mean_wall_ms"}


def passed() -> Column:
    """Selection by the program or by the judge."""
    return (F.col("programmatic_verdict") == "pass") | F.coalesce(F.col("judge_verdict") == "pass", F.lit(False))


def macro_average(cells: DataFrame, coarsen: bool = True) -> DataFrame:
    """Scenario means first, then their means by arm, model, category and pool: every scenario weighs the same.

    Means are sums of decimals, so that no order of summing shows.
    """
    by = ["arm", "model", "category", "pool_size"]
    named = cells.withColumn("category", category_of(F.col("category"), coarsen))
    task = mean(F.when(F.col("ast_verdict") != "n/a", F.when(F.col("ast_verdict") == "pass", 1.0).otherwise(0.0)))
    scenario = named.groupBy(*by, "scenario_id").agg(mean(F.when(passed(), 1.0).otherwise(0.0)).alias("success_rate"), task.alias("task_rate"), F.count("*").alias("runs"), *(mean(F.col(c)).alias(m) for c, m in MEANS.items()))
    return scenario.groupBy(*by).agg(F.count("*").alias("scenarios"), F.sum("runs").alias("n"), mean(F.col("success_rate")).alias("success_rate"), mean(F.col("task_rate")).alias("task_completion_rate"), *(mean(F.col(m)).alias(m) for m in MEANS.values()))


def savings(averages: DataFrame) -> DataFrame:
    """Control against treated arm by model, category and pool, with the oracle of model and category (0 where it is missing)."""
    values = ("input_tokens", "total_tokens", "dollar_cost", "turns", "wall_ms")

    def side(arm: str, prefix: str, keys: list[str], names=values) -> DataFrame:
        return averages.where(F.col("arm") == arm).select(*keys, *(F.col(f"mean_{v}").alias(f"{prefix}_{v}") for v in names))

    keys = ["model", "category", "pool_size"]
    pairs = side(CONTROL, "control", keys).join(side(TREATED, "treated", keys), keys)
    oracle = side(ORACLE, "oracle", keys[:2], ("input_tokens", "turns"))
    out = pairs.join(oracle, keys[:2], "left").withColumns({f"oracle_{v}": or_zero(F.col(f"oracle_{v}")) for v in ("input_tokens", "turns")})
    saved = {"input": "input_tokens", "total": "total_tokens", "dollar": "dollar_cost", "wall": "wall_ms"}
    return out.withColumns({f"{name}_savings_pct": percent_saved(F.col(f"control_{v}"), F.col(f"treated_{v}")) for name, v in saved.items()})


def failures(cells: DataFrame) -> DataFrame:
    """Counts by arm, model, category and pool: pass, fail, errored, failed in spite of calls, stopped at the step limit."""
    failed = F.col("programmatic_verdict") == "fail"
    return cells.groupBy("arm", "model", category_of(F.col("category")).alias("category"), "pool_size").agg(
        F.count_if(F.col("programmatic_verdict") == "pass").alias("pass"),
        F.count_if(failed).alias("fail"),
        F.count_if(F.col("error").isNotNull()).alias("errored"),
        F.count_if(failed & (F.col("tool_calls_total") > 0)).alias("missing_gold"),
        F.count_if(F.col("finish_reason").isin("max-steps", "tool-calls")).alias("step_limit"),
    )


def task_rows(cells: DataFrame, scenarios: DataFrame, arm: str | None = None) -> DataFrame:
    """Cells with their scenario's prompt and gold (empty where it is unknown), as scored records."""
    some = cells if arm is None else cells.where(F.col("arm") == arm)
    known = scenarios.select("scenario_id", "prompt", "gold_tools")
    out = some.join(known, "scenario_id", "left")
    return out.withColumns(
        {
            "query": F.coalesce("prompt", F.lit("")),
            "gold_tools": F.coalesce("gold_tools", F.array().cast("array<string>")),
            "selection_pass": F.col("programmatic_verdict") == "pass",
            "task_completion_pass": F.when(F.col("ast_verdict") != "n/a", F.col("ast_verdict") == "pass"),
        }
    ).drop("prompt")


def task_history(rows: DataFrame, bucket: str, roll_up: bool = False) -> DataFrame:
    """One history row for each version, bucket, model and arm, with the bucket "all" if asked for.

    The accuracy of task completion and the recall are null where no row has one. rows is read twice.
    """
    if roll_up:
        rows = rows.withColumn(bucket, F.explode(F.array(F.col(bucket), F.lit(ALL))))
    rate = lambda c: F.avg(F.when(F.col(c).isNotNull(), F.col(c).cast("int")))
    extra = [mean(F.col(c)).alias(c) for c in ("recall", "precision") if c in rows.columns]
    aggregates = [
        latest(F.col("generated_at")).alias("timestamp"),
        F.count("*").alias("scenarios"),
        rate("task_completion_pass").alias("task_completion_accuracy"),
        share(F.col("selection_pass")).alias("selection_accuracy"),
        *extra,
        or_zero(mean(F.col("total_tokens"))).alias("mean_total_tokens"),
    ]
    versioned = rows.withColumn("engine_version", F.coalesce("engine_version", F.lit("unknown")))
    return with_medians(versioned, ["engine_version", bucket, "model", "arm"], aggregates, {"latency_p50_ms": "wall_ms"})


def latest_runs(rows: DataFrame, keys: list[str], stamp: str = "generated_at") -> DataFrame:
    """All rows of each group that carry its latest time stamp: the groups' latest stamps, joined; rows is read twice."""
    last = rows.groupBy(*keys).agg(F.max(stamp).alias(stamp)).where(F.col(stamp).isNotNull())
    return same(rows, last, [*keys, stamp])


def cell_key(version: Column | None, pool: Column) -> Column:
    """The key of a cell as text; without a version, that of a control cell. A null pool has no suffix."""
    parts = [F.col(c).cast("string") for c in ("scenario_id", "arm", "model", "run_index")]
    suffix = F.when(pool.isNotNull(), F.concat(F.lit("p"), pool.cast("string")))
    return F.concat_ws("::", *([version] if version is not None else []), *parts, suffix)


def task_queue(scenarios: DataFrame, arms: DataFrame, models: DataFrame, pool_sizes: DataFrame, runs: int) -> DataFrame:
    """Every run of scenario, arm and model: once for arms that know no pools, else for each pool size.

    arms has (arm, pool_agnostic); the dimensions are short lists that are stated, not data.
    """
    agnostic = arms.where("pool_agnostic").select("arm", F.lit(None).cast("int").alias("pool_size"))
    swept = arms.where("NOT pool_agnostic").select("arm").crossJoin(pool_sizes.select(F.col("pool_size").cast("int")))
    dims = agnostic.unionByName(swept).crossJoin(models.select("model")).withColumn("run_index", F.explode(F.sequence(F.lit(1), F.lit(runs))))
    return scenarios.select("scenario_id").crossJoin(F.broadcast(dims))


def pending(queue: DataFrame, done: DataFrame) -> DataFrame:
    """Runs of the queue without a cell yet."""
    keys = ("scenario_id", "arm", "model", "run_index", "pool_size")
    had = done.select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    return queue.join(had, condition, "left_anti")


def reused_controls(queue: DataFrame, cells: DataFrame, version: str, stamp: str, ordinal: str = "event_id", arms=(CONTROL, ORACLE)) -> DataFrame:
    """The earliest earlier cell of every queued control run, of whatever version, stamped anew."""
    keyed = cells.where(F.col("arm").isin(*arms)).withColumn("_key", cell_key(None, F.col("pool_size")))
    first = keyed.groupBy("_key").agg(F.min_by(F.struct(*cells.columns), F.struct("generated_at", ordinal)).alias("cell"))
    wanted = queue.where(F.col("arm").isin(*arms)).select(cell_key(None, F.col("pool_size")).alias("_key"))
    return wanted.join(first, "_key").select("cell.*").withColumns({"sdk_version": F.lit(version), "generated_at": F.lit(stamp)})


def merged(own: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows by key; those of own win."""
    every = own.withColumn("_p", F.lit(0)).unionByName(other.withColumn("_p", F.lit(1)), allowMissingColumns=True)
    columns = [c for c in every.columns if c not in (key, "_p")]
    return every.groupBy(key).agg(F.min_by(F.struct(*columns), "_p").alias("_row")).select(key, "_row.*")


def until_spent(cells: DataFrame, cap: float, by: str, order: str, cost: str = "dollar_cost") -> DataFrame:
    """The cells that are run before the running cost of their campaign (rows of one by) reaches the cap."""
    before = F.sum(cost).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return cells.withColumn("spent_before", F.coalesce(F.round(before, 6), F.lit(0.0))).where(F.col("spent_before") < cap)


def until_all_spent(cells: DataFrame, cap: float, order: str, cost: str = "dollar_cost", ranges: int | None = None) -> DataFrame:
    """The cells that are run before the running cost of all cells reaches the one cap.

    The cells are cut into ranges of the numeric order at approximate quantiles, which only decide how evenly tasks are
    filled: a cell's running cost is the sum of the ranges before its own and of the cells before it in its range. Cells
    of equal order are in one range. Costs are summed as decimals, so that no order of summing shows.
    """
    n = ranges or int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted(set(cells.approxQuantile(order, [k / n for k in range(1, n)], 0.1 / n))) if n > 1 else []
    place = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col(order))) if bounds else F.lit(0)
    rows = cells.withColumns({"_range": place, "_cost": F.coalesce(F.col(cost), F.lit(0)).cast("decimal(28,9)")})
    # One row a range, so few in one task.
    sums = rows.groupBy("_range").agg(F.sum("_cost").alias("_sum"))
    earlier = sums.select("_range", F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)).alias("_earlier"))
    within = F.sum("_cost").over(Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    spent = F.round((F.coalesce("_earlier", F.lit(0)) + F.coalesce("_within", F.lit(0))).cast("double"), 6)
    out = rows.withColumn("_within", within).join(F.broadcast(earlier), "_range").withColumn("spent_before", spent)
    return out.where(F.col("spent_before") < cap).drop("_range", "_cost", "_earlier", "_within")


def dollar_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """usage with its cost: tokens of four kinds at the model's prices for a million, 0 for unknown models."""
    kinds = ("input", "output", "cached_input", "cache_creation")
    rates = prices.select("model", *(F.col(k).cast("double").alias(f"_{k}") for k in kinds))
    out = usage.join(few(rates), "model", "left")
    total = sum((F.coalesce(F.col(f"{k}_tokens"), F.lit(0)) * F.coalesce(F.col(f"_{k}"), F.lit(0.0)) for k in kinds), F.lit(0.0)) / 1e6
    return out.withColumn("dollar_cost", total).drop(*(f"_{k}" for k in kinds))
