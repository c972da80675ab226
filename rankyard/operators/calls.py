"""Tool calls of traces: metering, gateway unwrapping, safe names without collisions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankyard.functions.labels import safe_name
from rankyard.operators.pools import shuffled
from rankyard.operators.registry import Registry
from rankyard.staging import few, written

SEARCH, INVOKE = "search_tools", "invoke_tool"


def canonical(steps: DataFrame, names: DataFrame, tool: str = "tool") -> DataFrame:
    """steps with the ids of the tools in place of the names under which they were called.

    names has name and id, and columns by which steps are told apart, too, if names mean different tools there (a
    scenario); it has one row a name. Names that it lacks, as those of the gateway, stay.
    """
    on = [c for c in names.columns if c not in ("name", "id")]
    known = names.select(*on, F.col("name").alias(tool), F.col("id").alias("_id"))
    return steps.join(few(known), [*on, tool], "left").withColumn(tool, F.coalesce("_id", tool)).select(*steps.columns)


def metered(steps: DataFrame, by: str, tool: str = "tool", step: str = "step", names: DataFrame | None = None) -> DataFrame:
    """Token sums, calls (all, different, of the gateway, direct) and turns of every trace, from one row for each call.

    steps has input, output, cached_input, cache_creation and total tokens of the step on the row of each of its calls:
    they count once a step. Steps without a call have one row with a null tool. Totals that providers leave out are
    input + output + cached. With names, calls count by their tools' ids (canonical()).
    """
    steps = steps if names is None else canonical(steps, names, tool)
    kinds = [f"{k}_tokens" for k in ("input", "output", "cached_input", "cache_creation", "total")]
    gateway = F.col(tool).isin(SEARCH, INVOKE)
    calls = [F.count(tool).alias("tool_calls_total"), F.count_if(gateway).alias("gateway_calls"), F.count_if(~gateway).alias("non_gateway_calls")]
    once = steps.groupBy(by, step).agg(*(F.max(k).alias(k) for k in kinds), *calls, F.collect_set(tool).alias("_tools"))
    sums = [F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in kinds]
    different = F.size(F.array_distinct(F.flatten(F.collect_list("_tools")))).cast("bigint").alias("tool_calls_unique")
    numbers = [F.sum(c).alias(c) for c in ("gateway_calls", "non_gateway_calls")]
    out = once.groupBy(by).agg(*sums, F.sum("tool_calls_total").alias("tool_calls_total"), different, *numbers, F.count(step).alias("turns"))
    return out.withColumn("total_tokens", F.when(F.col("total_tokens") == 0, F.col("input_tokens") + F.col("output_tokens") + F.col("cached_input_tokens")).otherwise(F.col("total_tokens")))


def effective_ids(calls: Column) -> Column:
    """The tools that calls (ARRAY<STRUCT<tool_id, args>>, args JSON text) reach: searches dropped, invocations unwrapped."""
    inner = lambda c: F.get_json_object(c["args"], "$.toolId")
    kept = F.filter(calls, lambda c: (c["tool_id"] != SEARCH) & ((c["tool_id"] != INVOKE) | inner(c).isNotNull()))
    return F.transform(kept, lambda c: F.when(c["tool_id"] == INVOKE, inner(c)).otherwise(c["tool_id"]))


def disambiguated(ids: DataFrame, id_col: str = "id") -> DataFrame:
    """id, name, new_id: a safe name for every distinct id, and the id with the same number; in byte order the first claimant keeps it, later ones get _2, _3, ...

    A name with a number that some id claims itself moves on to the next free number; those few names are settled in
    rounds, each a join of the names still open with the names taken. Rounds are written, so that none runs again. An id
    of which nothing is left is an error.
    """
    order = Window.partitionBy("base").orderBy("id")
    named = ids.select(F.col(id_col).alias("id")).distinct().withColumn("base", safe_name(F.col("id")))
    named = named.withColumn("_ok", F.assert_true(F.coalesce(F.col("base") != "", F.lit(True)), F.concat(F.lit("no name is left of the id "), F.col("id")))).where("_ok IS NULL").drop("_ok")
    named = named.withColumn("n", F.row_number().over(order))
    name = F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat_ws("_", "base", F.col("n").cast("string")))
    out = named.withColumn("name", name)
    while True:
        owner = Window.partitionBy("name").orderBy(F.col("n") > 1, "id")
        ranked = written(out.withColumn("claim", F.row_number().over(owner)), "names")
        if ranked.where("claim > 1").isEmpty():
            renamed = F.when(F.col("n") == 1, F.col("id")).otherwise(F.concat_ws("_", "id", F.col("n").cast("string")))
            return ranked.select(F.col("id").alias(id_col), "name", renamed.alias("new_id"))
        moved = F.col("claim") > 1
        step = F.max("n").over(Window.partitionBy("base")) + F.row_number().over(Window.partitionBy("base", moved).orderBy("id"))
        out = ranked.withColumn("n", F.when(moved, step).otherwise(F.col("n"))).withColumn("name", name).drop("claim")


@dataclass(frozen=True)
class Shown:
    """What arms choose from: scenarios (query_id), pools and gold (query_id, item_id), rankings (query_id, item_id, rank)
    and how many of these a shortlist has."""

    scenarios: DataFrame
    pools: DataFrame
    gold: DataFrame
    ranking: DataFrame
    top_k: int

    def shortlist(self) -> DataFrame:
        return self.ranking.where(F.col("rank") <= self.top_k).select("query_id", "item_id")

    def gateway(self) -> DataFrame:
        return self.scenarios.select("query_id", F.explode(F.array(F.lit(SEARCH), F.lit(INVOKE))).alias("item_id"))


@dataclass(frozen=True)
class Arm:
    """A strategy: the items (query_id, item_id) that it shows, and whether it knows no pools."""

    show: Callable[[Shown], DataFrame]
    pool_agnostic: bool = False
    label: str = ""

    def __post_init__(self):
        if not callable(self.show):
            raise TypeError("an arm needs a function of what it shows")

    def __call__(self, shown: Shown) -> DataFrame:
        return self.show(shown).select("query_id", F.col("item_id").cast("string").alias("item_id"))


arms: Registry[Arm] = Registry("arm")
arms.add("baseline", Arm(lambda s: s.pools, label="the whole pool"))
arms.add("oracle", Arm(lambda s: s.gold, pool_agnostic=True, label="the gold items"))
arms.add("prefetch", Arm(lambda s: s.shortlist(), label="the k best items"))
arms.add("full", Arm(lambda s: s.shortlist().select("query_id", F.col("item_id").cast("string").alias("item_id")).unionByName(s.gateway()), label="the k best items and the gateway"))
arms.add("gateway", Arm(lambda s: s.gateway(), label="the gateway"))


def arm_table(spark: SparkSession, known: Registry[Arm] = arms) -> DataFrame:
    """arm, pool_agnostic of all registered arms."""
    return spark.createDataFrame([(name, known[name].pool_agnostic) for name in known], "arm string, pool_agnostic boolean")


def visible(scenarios: DataFrame, pools: DataFrame, gold: DataFrame, ranking: DataFrame, top_k: int, known: Registry[Arm] = arms) -> DataFrame:
    """query_id, arm, item_id: what every registered arm shows."""
    shown = Shown(scenarios, pools, gold, ranking, top_k)
    parts = [known[name](shown).withColumn("arm", F.lit(name)) for name in known]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("query_id", "arm", "item_id")


def arm_candidates(sets: DataFrame, seed: int) -> DataFrame:
    """scenario_id, arm, pool_size, ids: the list that each arm of a selection campaign is shown.

    sets has scenario_id, pool_size, full_pool, short and gold (arrays). The baseline sees the pool in an order that scenario
    and seed fix, the treated arm its shortlist, the oracle the gold ids, once for a scenario and with no pool size.
    """
    mixed = shuffled(sets, "full_pool", "scenario_id", seed)
    none = F.lit(None).cast(sets.schema["pool_size"].dataType).alias("pool_size")
    baseline = mixed.select("scenario_id", F.lit("baseline").alias("arm"), "pool_size", F.col("full_pool").alias("ids"))
    treated = sets.select("scenario_id", F.lit("full").alias("arm"), "pool_size", F.col("short").alias("ids"))
    oracle = sets.groupBy("scenario_id").agg(F.min("gold").alias("ids")).select("scenario_id", F.lit("oracle").alias("arm"), none, "ids")
    return baseline.unionByName(treated).unionByName(oracle)


def catalog_sizes(shown: DataFrame) -> DataFrame:
    return shown.groupBy("query_id", "arm").agg(F.count("*").alias("catalog_size"))
