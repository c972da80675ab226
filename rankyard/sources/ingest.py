"""The four public corpora as normalised tables: scenarios kept, and counts of what was skipped and why.

Every function returns (scenarios, counts). A query is kept only if all its gold items are known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankyard.functions.arguments import documented, normalised_schema, normalised_schemas
from rankyard.functions.labels import flat_prompt, slug, unwrapped
from rankyard.operators.calls import disambiguated
from rankyard.operators.pools import last_wins

KEPT = "kept"


def counted(rows: DataFrame, statuses: tuple[str, ...]) -> DataFrame:
    """One row: rows in, and rows by status."""
    return rows.agg(F.count("*").alias("rows_in"), *(F.count_if(F.col("status") == s).alias(s) for s in (KEPT, *statuses)))


def all_known(rows: DataFrame, items: DataFrame, id_col: str, gold_col: str) -> DataFrame:
    """rows with known: whether there is gold and every gold id is an item's."""
    gold = rows.select(id_col, F.explode(gold_col).alias("item_id"))
    found = gold.join(items.select(F.col("id").alias("item_id"), F.lit(True).alias("_has")).distinct(), "item_id", "left")
    known = found.groupBy(id_col).agg(F.bool_and(F.coalesce("_has", F.lit(False))).alias("known"))
    return rows.join(known, id_col, "left").withColumn("known", F.coalesce("known", F.lit(False)))


def _status(*cases: tuple[Column, str]) -> Column:
    out = None
    for condition, name in cases:
        out = F.when(condition, F.lit(name)) if out is None else out.when(condition, F.lit(name))
    return out.otherwise(F.lit(KEPT))


def single_and_multi(tools: DataFrame, single: DataFrame, multi: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scenarios of plugin descriptions, a table of (line, query, tool) and one of (idx, query, tool array)."""
    one = single.select(F.concat(F.lit("metatool-st-"), "line").alias("id"), "query", F.array("tool").alias("gold_tools"), F.lit("metatool-single").alias("category"))
    many = multi.select(F.concat(F.lit("metatool-mt-"), "idx").alias("id"), "query", F.col("tool").alias("gold_tools"), F.lit("metatool-multi").alias("category"))
    rows = all_known(one.unionByName(many), tools, "id", "gold_tools").withColumn("status", _status((~F.col("known"), "skipped_unknown_gold")))
    return _scenarios(rows), counted(rows, ("skipped_unknown_gold",))


def _scenarios(rows: DataFrame, prompt: str = "query") -> DataFrame:
    columns = [c for c in ("gold_calls", "candidate_pool", "dataset") if c in rows.columns]
    return rows.where(F.col("status") == KEPT).select("id", F.col(prompt).alias("prompt"), "gold_tools", "category", *columns)


def documented_tools(rows: DataFrame) -> DataFrame:
    """id, name, description, input_schema of (id, documentation, ordinal); of repeated ids the last wins."""
    tools = last_wins(rows, "id", "ordinal").withColumn("doc", documented(F.col("id"), F.col("documentation")))
    return tools.select("id", "doc.*")


def labelled_queries(queries: DataFrame, tools: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scenarios of (subset, idx, instruction, labels, category); labels is a JSON array of {id, relevance}.

    Positive is relevance 1 or none; labels that do not parse and prompts that are empty count as unknown gold.
    """
    parsed = queries.withColumn("parsed", F.from_json("labels", "array<struct<id:string,relevance:bigint>>"))
    gold = F.transform(F.filter("parsed", lambda x: F.coalesce(x["relevance"], F.lit(1)) == 1), lambda x: x["id"])
    rows = parsed.select(F.concat_ws("-", F.lit("toolret"), slug(F.col("subset")), F.col("idx").cast("string")).alias("id"), unwrapped(F.col("instruction")).alias("query"), gold.alias("gold_tools"), "category")
    rows = all_known(rows, tools, "id", "gold_tools")
    unknown, none = "skipped_unknown_gold", "skipped_no_positive_label"
    rows = rows.withColumn("status", _status((F.col("gold_tools").isNull(), unknown), (F.size("gold_tools") == 0, none), (~F.col("known") | (F.col("query") == ""), unknown)))
    return _scenarios(rows), counted(rows, (unknown, none))


def function_calls(data: DataFrame, answers: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """Scenarios of data (id, question, function) and answers (id, ground_truth, ordinal); of repeated answers the last wins.

    ground_truth is ARRAY<MAP<STRING, STRING>>: function to JSON arguments. A row needs an answer whose functions it offers.
    """
    calls = F.flatten(F.transform("ground_truth", lambda m: F.transform(F.map_entries(m), lambda e: F.struct(e["key"].alias("tool"), e["value"].alias("args")))))
    truth = last_wins(answers, "id", "ordinal").select("id", calls.alias("gold_calls"))
    pool = F.transform("function", lambda f: F.struct(f["name"].alias("id"), f["name"].alias("name"), F.coalesce(f["description"], F.lit("")).alias("description"), f["parameters"].alias("input_schema")))
    rows = data.select("id", flat_prompt(F.col("question")).alias("query"), pool.alias("candidate_pool")).join(truth, "id", "left")
    rows = rows.withColumn("gold_tools", F.array_distinct(F.transform("gold_calls", lambda c: c["tool"])))
    offered = F.size(F.array_except("gold_tools", F.transform("candidate_pool", lambda p: p["id"]))) == 0
    missing, unknown = "skipped_missing_answer", "skipped_unknown_gold"
    rows = rows.withColumn("status", _status((F.col("gold_calls").isNull(), missing), ((F.size("gold_tools") == 0) | ~offered, unknown)))
    counts = counted(rows, (missing, unknown))
    rows = rows.withColumns({"id": F.concat(F.lit(f"bfcl-{kind}-"), "id"), "category": F.lit(f"bfcl-{kind}")})
    return _scenarios(rows), counts


def standard_schemas(items: DataFrame) -> DataFrame:
    """Items with standard type names in their input schema; {} where there is no output schema."""
    out = items.withColumn("input_schema", normalised_schema(F.col("input_schema")))
    return out.withColumn("output_schema", F.coalesce("output_schema", F.lit("{}"))) if "output_schema" in items.columns else out


def standard_pools(scenarios: DataFrame) -> DataFrame:
    """Scenarios with standard type names in the input schemas of their candidate_pool."""
    found = scenarios.withColumn("_schemas", normalised_schemas(F.transform("candidate_pool", lambda p: p["input_schema"])))
    return found.withColumn("candidate_pool", F.zip_with("candidate_pool", "_schemas", lambda p, s: p.withField("input_schema", s))).drop("_schemas")


def renamed(scenarios: DataFrame) -> DataFrame:
    """Scenarios in which no two different tool ids have the same safe name: ids that must change do so in the pool, the gold
    tools and the gold calls alike. A scenario gets the changes among the ids of its own pool, as a map."""
    offered = scenarios.select("id", F.explode(F.array_distinct(F.transform("candidate_pool", lambda p: p["id"]))).alias("tool"))
    changed = disambiguated(offered.select("tool"), "tool").where(F.col("tool") != F.col("new_id")).select("tool", "new_id")
    maps = offered.join(changed, "tool").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("tool", "new_id"))).alias("_new"))
    out = scenarios.join(maps, "id", "left").withColumn("_new", F.coalesce("_new", F.create_map().cast("map<string,string>")))
    new = lambda x: F.coalesce(F.element_at("_new", x), x)
    found = {"candidate_pool": F.transform("candidate_pool", lambda p: p.withField("id", new(p["id"]))), "gold_tools": F.transform("gold_tools", new)}
    if "gold_calls" in scenarios.columns:
        found["gold_calls"] = F.transform("gold_calls", lambda c: c.withField("tool", new(c["tool"])))
    return out.withColumns(found).drop("_new")


def skill_instances(instances: DataFrame, skills: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Instances (the schema SKILL_INSTANCE) of (dataset, instance_id, question, skill_annotations) whose skills are all in
    the catalogue."""
    rows = instances.select(F.concat(F.lit("sragents-"), "instance_id").alias("id"), "dataset", F.col("question").alias("prompt"), F.array_distinct("skill_annotations").alias("gold_skill_ids"))
    rows = all_known(rows, skills, "id", "gold_skill_ids").withColumn("status", _status((~F.col("known"), "skipped_unknown_gold")))
    return rows.where(F.col("status") == KEPT).select("id", "dataset", "prompt", "gold_skill_ids"), counted(rows, ("skipped_unknown_gold",))


def with_gold_pool(scenarios: DataFrame, tools: DataFrame) -> DataFrame:
    """Scenarios whose candidate_pool is their gold tools (id, name, description, input_schema, output_schema), in gold order."""
    columns = {"name": F.col("id"), "description": F.lit(""), "input_schema": F.lit("{}"), "output_schema": F.lit("{}")}
    spec = F.struct(F.col("id").cast("string").alias("id"), *(F.coalesce(F.col(c), x).alias(c) if c in tools.columns else x.alias(c) for c, x in columns.items()))
    known = tools.select(F.col("id").alias("_tool"), spec.alias("_spec"))
    gold = scenarios.select("id", F.posexplode("gold_tools").alias("_n", "_tool")).join(known, "_tool")
    pools = gold.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_spec"))), lambda e: e["_spec"]).alias("candidate_pool"))
    return scenarios.join(pools, "id", "left")
