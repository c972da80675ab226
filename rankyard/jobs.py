"""Whole jobs on files: corpora to normalised tables, tables to metric rows, summaries and histories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankyard.functions.labels import bucket_of
from rankyard.operators import pools, sampling, summary
from rankyard.operators.medians import same
from rankyard.operators.runs import RankingStore, Run, evaluate
from rankyard.sources import ingest, jsonl, schemas, sinks
from rankyard.staging import written


def _stem(path_col: str) -> Column:
    """A file's name without folder and suffix."""
    return F.regexp_extract(path_col, r"([^/]+?)(\.[^./]*)?$", 1)


def _scenarios(rows: DataFrame) -> DataFrame:
    """The columns of the schema SCENARIO, absent ones null."""
    fields = jsonl.structure(schemas.SCENARIO).fields
    return rows.select(*((F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in fields))


def _kept(found: tuple[DataFrame, DataFrame], output: str) -> dict:
    rows, counts = found
    sinks.overwrite(_scenarios(rows), output, order="id")
    return counts.first().asDict()


def ingest_plugins(spark: SparkSession, plugins: str, single: str, output: str, multi: str | None = None) -> dict:
    """A corpus of plugin descriptions (JSON object), single-tool queries (CSV) and multi-tool queries (JSON array) as
    scenarios in output, sorted by id; the counts of what came in and was skipped."""
    tools = jsonl.name_map(spark, plugins)
    many = jsonl.json_array(spark, multi, "struct<query:string,tool:array<string>>") if multi else spark.createDataFrame([], "idx int, query string, tool array<string>")
    scenarios, counts = ingest.single_and_multi(tools, jsonl.csv_queries(spark, single), many)
    return {"plugins": tools.count()} | _kept((ingest.with_gold_pool(scenarios, tools), counts), output)


def ingest_documented(spark: SparkSession, tools: Sequence[str], queries: Sequence[str], output: str) -> dict:
    """A corpus of Parquet tools (id, documentation) and labelled queries; of repeated tool ids the last one wins, by the
    order of the paths, then of rows in files. A query's subset is its file's name."""
    order = F.array_position(F.array(*(F.lit(p.rstrip("/").split("/")[-1]) for p in tools)), F.col("file"))
    rows = [jsonl.parquet_strings(spark, p, ["id", "documentation"]) for p in tools]
    every = rows[0]
    for more in rows[1:]:
        every = every.unionByName(more)
    known = ingest.standard_schemas(ingest.documented_tools(every.withColumn("ordinal", F.struct(order.alias("o"), "file", "row_index"))))
    asked = [jsonl.parquet_strings(spark, p, ["id", "query", "instruction", "labels", "category"]) for p in queries]
    labelled = asked[0]
    for more in asked[1:]:
        labelled = labelled.unionByName(more)
    labelled = labelled.select(_stem("file").alias("subset"), F.col("row_index").alias("idx"), "instruction", "labels", "category")
    known = written(known, "tools")
    scenarios, counts = ingest.labelled_queries(labelled, known)
    return _kept((ingest.with_gold_pool(scenarios, known), counts), output)


_DATA = "id STRING, question ARRAY<ARRAY<STRUCT<role: STRING, content: STRING>>>, function ARRAY<STRUCT<name: STRING, description: STRING, parameters: STRING>>"
_ANSWERS = "id STRING, ground_truth ARRAY<MAP<STRING, STRING>>"


def ingest_calls(spark: SparkSession, data: str, answers: str, kind: str, output: str) -> dict:
    """A corpus of function-calling rows and answers (JSON Lines) of one kind. Of repeated answer ids the last line wins:
    lines are ordered by their files and numbers. Names that providers refuse or that collide are replaced everywhere."""
    truth = jsonl.parsed_lines(spark, answers, _ANSWERS)
    jsonl.strict(spark, answers, _ANSWERS)
    truth = truth.select("record.*", F.struct("file", "line").alias("ordinal"))
    scenarios, counts = ingest.function_calls(jsonl.strict(spark, data, _DATA), truth, kind)
    schema = F.transform("candidate_pool", lambda p: p.withField("output_schema", F.lit("{}")))
    renamed = ingest.renamed(written(scenarios.withColumn("candidate_pool", schema), "calls"))
    return _kept((ingest.standard_pools(renamed), counts), output)


def ingest_skills(spark: SparkSession, corpus: str, instances: Sequence[tuple[str, str]], output: str, catalogue: str) -> dict:
    """A skill corpus (JSON array in a zip) as a catalogue, and instances (dataset, path of a JSON array) as a table, both
    sorted by id."""
    text = jsonl.zipped_json(spark, corpus).select(F.explode(F.from_json("text", "array<struct<skill_id:string,name:string,description:string,content:string>>")).alias("s"))
    items = text.select(F.col("s.skill_id").alias("id"), F.lit("skill").alias("kind"), "s.name", F.coalesce("s.description", F.lit("")).alias("description"), F.array().cast("array<string>").alias("tags"), F.array().cast("array<string>").alias("tools"), F.col("s.content").alias("body"))
    items = written(items, "skills")
    rows = None
    for dataset, path in instances:
        one = jsonl.json_array(spark, path, "struct<instance_id:string,question:string,skill_annotations:array<string>>").withColumn("dataset", F.lit(dataset))
        rows = one if rows is None else rows.unionByName(one)
    found, counts = ingest.skill_instances(rows, items)
    sinks.overwrite(items, catalogue, order="id")
    sinks.overwrite(found, output, order="id")
    return {"skills": items.count()} | counts.first().asDict()


def _finished(spark: SparkSession, rows: DataFrame, run: Run, output: str, summary_output: str, corpus: str, bucket: Column, order: Sequence[str]) -> dict:
    sinks.overwrite(rows, output)
    kept = spark.read.schema(rows.schema).json(output)
    placed = kept.withColumn("_at", bucket).withColumns({"bucket": F.col("_at.subset"), "mode": F.col("_at.mode"), "pool_size": F.col("target_pool_size")})
    table = summary.by_bucket(placed.drop("_at"))
    scores = summary.gold_scores(placed, ["bucket", "target_pool_size"], "scenario_id").withColumnRenamed("target_pool_size", "_pool").drop("scenarios")
    table = same(table.withColumn("_pool", F.when(~F.col("overall"), F.col("pool_size"))), scores, ["bucket", "_pool"], "left").drop("_pool")
    stamped = table.select(F.lit(run.run_id).alias("run_id"), F.lit(run.generated_at).alias("generated_at"), F.lit(run.engine_version).alias("engine_version"), F.lit(corpus).alias("corpus"), F.lit(output).alias("output"), bucket_order(F.col("bucket"), order).alias("bucket_place"), "*")
    sinks.append(stamped, summary_output)
    counts = kept.agg(F.count("*").alias("rows_written"), F.count_distinct("scenario_id").alias("scenarios")).first()
    return {"run_id": run.run_id, **counts.asDict()}


def bucket_order(bucket: Column, order: Sequence[str]) -> Column:
    """A sort key: the buckets of a fixed order first, then others by name, "all" last."""
    place = F.array_position(F.array(*map(F.lit, order)), bucket)
    return F.when(bucket == summary.ALL, F.lit("2")).when(place > 0, F.concat(F.lit("0"), F.lpad(place.cast("string"), 4, "0"))).otherwise(F.concat(F.lit("1"), bucket))


def retrieval(spark: SparkSession, corpus: str, output: str, summary_output: str, top_ks: Sequence[int] = (1, 3, 5, 10), pool_sizes: Sequence[int] = (30, 150, 600), seed: int = 42, scenarios: int | None = None, method: str = "bm25", store: str | None = None, engine_version: str = "unknown") -> dict:
    """Evaluates a tool corpus: its first scenarios by id, or all; the universe is the tools of their pools, the first of
    an id. Metric rows replace output; a summary by bucket is added to summary_output."""
    table = jsonl.strict(spark, corpus, schemas.SCENARIO)
    some = written(sampling.head(table, scenarios) if scenarios is not None else table, "scenarios")
    tools = some.select(F.col("id").alias("_s"), F.posexplode("candidate_pool").alias("_n", "t")).select("t.*", F.struct("_s", "_n").alias("_ordinal"))
    universe = pools.first_wins(tools, "id", "_ordinal").select("id", F.concat_ws(" ", "name", "description").alias("text"))
    asked = some.withColumn("own", F.transform("candidate_pool", lambda p: p["id"]))
    run = Run(engine_version)
    rows = evaluate(asked, written(universe, "universe"), top_ks, pool_sizes, seed, run, method, RankingStore(spark, store) if store else None, corpus)
    return _finished(spark, rows, run, output, summary_output, corpus, bucket_of(F.col("category"), F.size("golden_answer")), ("single-tool", "multi-tool"))


def skill_retrieval(spark: SparkSession, instances: str, catalogue: str, output: str, summary_output: str, top_ks: Sequence[int] = (1, 3, 5, 10), pool_sizes: Sequence[int] = (30, 150, 600), seed: int = 42, scenarios: int | None = None, method: str = "bm25", store: str | None = None, engine_version: str = "unknown") -> dict:
    """Evaluates skill instances, all or a stratified sample; the universe is the whole catalogue (its bodies are not read),
    own items are the gold skills that it has."""
    skills = jsonl.pruned(spark, catalogue, schemas.ITEM, ["id", "name", "description", "tags"])
    skills = written(skills.select("id", F.concat_ws(" ", "name", "description", F.array_join("tags", " ")).alias("text")), "universe")
    table = jsonl.strict(spark, instances, schemas.SKILL_INSTANCE)
    some = written(sampling.stratified(table, scenarios, seed, "dataset") if scenarios is not None else table, "instances")
    gold = some.select(F.col("id").alias("query_id"), F.posexplode("gold_skill_ids").alias("position", "item_id"))
    known = skills.select(F.col("id").alias("item_id"))
    own = gold.join(known, "item_id").groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "item_id"))), lambda e: e["item_id"]).alias("own"))
    asked = some.join(own, some["id"] == own["query_id"], "left").select("id", "prompt", F.concat(F.lit("sragents-"), "dataset").alias("category"), F.coalesce("own", F.array().cast("array<string>")).alias("own"), F.col("gold_skill_ids").alias("gold_tools"))
    run = Run(engine_version)
    rows = evaluate(asked, skills, top_ks, pool_sizes, seed, run, method, RankingStore(spark, store) if store else None, catalogue)
    return _finished(spark, rows, run, output, summary_output, instances, bucket_of(F.col("category"), F.size("golden_answer")), ())
