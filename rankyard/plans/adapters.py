"""The engine's tables from the star-schema tables: scenarios, items, gold, cells, traces. Each with the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankyard.functions.labels import tokens
from rankyard.staging import FEW, tasks, written

GRAM = 8
#: Tokens of the parts of runs at which documents meet them. Of every GRAM tokens of a document, STEP parts begin one after
#: another, so one of them begins at a multiple of STEP.
PART = 4
STEP = GRAM - PART + 1


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "source")


def scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")


def gold(spark: SparkSession, sf_dir: str, most: int = FEW) -> DataFrame:
    """query_id, item_id: documents with all tokens of a benchmark item in a row, whatever its length.

    Up to most items are broadcast: each meets the documents' words at its longest token, and its tokens are compared from
    there, so the texts are read once and not shuffled. Of more items, candidates share the hash of the item's first run of
    GRAM tokens, or of the whole of a shorter item. The links are written: queries read them several times.
    """
    asked = scenarios(spark, sf_dir).select(F.col("id").alias("query_id"), tokens(F.col("text")).alias("q")).where(F.size("q") > 0)
    found = items(spark, sf_dir).select(F.col("id").alias("item_id"), tokens(F.col("text")).alias("t"))
    links = _links_at_words(asked, found) if asked.count() <= most else _links_at_runs(asked, found)
    return written(links.distinct(), "gold")


def _links_at_words(asked: DataFrame, found: DataFrame) -> DataFrame:
    longest = F.array_max(F.transform("q", lambda x, i: F.struct(F.length(x).alias("n"), i.alias("at"))))
    asked = asked.withColumn("at", longest["at"]).select("query_id", "q", "at", F.xxhash64(F.expr("q[at]")).alias("word"))
    # Words meet as hashes; the tokens decide. The coalesces keep Spark from inferring filters on t, for which it would cut
    # every text into tokens a second time.
    split = found.select("item_id", "t", F.posexplode(F.coalesce("t", F.array().cast("array<string>"))).alias("pos", "word"))
    met = split.withColumn("word", F.xxhash64("word")).join(F.broadcast(asked), "word")
    whole = F.expr("pos >= at AND pos - at + size(q) <= size(t) AND slice(t, pos - at + 1, size(q)) = q")
    return met.where(F.coalesce(whole, F.lit(False))).select("query_id", "item_id")


def _links_at_runs(asked: DataFrame, found: DataFrame) -> DataFrame:
    asked = asked.select("query_id", "q", F.xxhash64(F.slice("q", 1, GRAM)).alias("run"), F.least(F.size("q"), F.lit(GRAM)).alias("n"))
    # One row, of at most GRAM lengths.
    lengths = F.broadcast(asked.agg(F.collect_set("n").alias("lengths")))
    split = found.crossJoin(lengths).select("item_id", "t", F.explode("lengths").alias("n")).where("size(t) >= n")
    split = split.select("item_id", "n", F.explode(F.expr("transform(sequence(1, size(t) - n + 1), i -> xxhash64(slice(t, i, n)))")).alias("run"))
    candidates = split.join(asked, ["n", "run"]).select("query_id", "item_id", "q").distinct()
    spaced = lambda t: F.concat(F.lit(" "), F.array_join(t, " "), F.lit(" "))
    links = candidates.join(found.select("item_id", spaced(F.col("t")).alias("text")), "item_id").where(F.contains("text", spaced(F.col("q"))))
    return links.select("query_id", "item_id")


def gold_of_runs(spark: SparkSession, sf_dir: str, most: int = FEW) -> DataFrame:
    """query_id, item_id: documents with GRAM tokens of a benchmark item in a row, from wherever in the item, or with all of a
    shorter one.

    Documents meet items at hashes of parts, all parts of the items and every STEP-th of the documents, and the tokens around
    decide. Up to most parts are broadcast, so the texts are read once and not shuffled; of more, hashes alone are shuffled.
    """
    asked = scenarios(spark, sf_dir).select(F.col("id").alias("query_id"), tokens(F.col("text")).alias("q")).where(F.size("q") > 0)
    found = items(spark, sf_dir).select(F.col("id").alias("item_id"), tokens(F.col("text")).alias("t"))
    asked = written(asked, "asked")
    long, short = asked.where(F.size("q") >= GRAM), asked.where(F.size("q") < GRAM)
    parts = long.select("query_id", "q", F.posexplode(_parts("q", 1)).alias("at", "part")).withColumn("from", F.greatest(F.col("at") - STEP + 1, F.lit(0)))
    # All runs of GRAM tokens that hold the part.
    parts = written(parts.select("query_id", "part", (F.col("at") - F.col("from")).alias("at"), F.expr(f"slice(q, from + 1, at - from + {GRAM})").alias("near")), "parts")
    links = _links_around(parts, found) if parts.count() <= most else _links_of_parts(parts, long, found)
    n = short.count()
    if n:
        links = links.unionByName(_links_at_words(short, found) if n <= most else _links_at_runs(short, found))
    return written(links.distinct(), "gold")


def _parts(words: str, step: int):
    """Hashes of the parts that begin at every step-th token; none of fewer than GRAM tokens."""
    part = ", ".join(f"{words}[i + {k}]" for k in range(PART))
    return F.expr(f"CASE WHEN size({words}) >= {GRAM} THEN transform(sequence(0, size({words}) - {PART}, {step}), i -> xxhash64({part})) ELSE array() END")


def _links_around(parts: DataFrame, found: DataFrame) -> DataFrame:
    split = found.select("item_id", "t", F.posexplode(_parts("t", STEP)).alias("k", "part"))
    met = split.join(F.broadcast(parts), "part").withColumn("from", F.col("k") * STEP - F.col("at"))
    same = f"from + i >= 0 AND slice(t, from + i + 1, {GRAM}) = slice(near, i + 1, {GRAM})"
    return met.where(F.expr(f"exists(sequence(0, size(near) - {GRAM}), i -> {same})")).select("query_id", "item_id")


def _links_of_parts(parts: DataFrame, asked: DataFrame, found: DataFrame) -> DataFrame:
    split = found.select("item_id", F.explode(_parts("t", STEP)).alias("part"))
    candidates = split.join(parts.select("query_id", "part").distinct(), "part").select("query_id", "item_id").distinct()
    spaced = lambda t: F.concat(F.lit(" "), F.array_join(t, " "), F.lit(" "))
    texts = found.select("item_id", spaced(F.col("t")).alias("text"))
    run = lambda i: F.contains("text", spaced(F.slice("q", i, GRAM)))
    met = candidates.join(asked, "query_id").join(texts, "item_id")
    return met.where(F.exists(F.sequence(F.lit(1), F.size("q") - GRAM + 1), run)).select("query_id", "item_id")


ITEMS_SQL = "items AS (SELECT doc_id AS id, text, lang, source FROM documents)"
SCENARIOS_SQL = "scenarios AS (SELECT item_id AS id, text FROM benchmark)"
GOLD_SQL = """
asked AS (SELECT id AS query_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM scenarios),
spaced AS (SELECT id AS item_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') || ' ' AS whole FROM items),
gold AS (SELECT DISTINCT query_id, item_id FROM asked JOIN spaced ON len(t) > 0 AND contains(whole, ' ' || array_to_string(t, ' ') || ' '))"""

GOLD_OF_RUNS_SQL = f"""
cut AS (SELECT id AS query_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM scenarios),
asked AS (SELECT DISTINCT query_id, ' ' || array_to_string(unnest(CASE WHEN len(t) < {GRAM} THEN [t] ELSE list_transform(range(1, len(t) - {GRAM - 2}), lambda i: t[i:i + {GRAM - 1}]) END), ' ') || ' ' AS run FROM cut WHERE len(t) > 0),
spaced AS (SELECT id AS item_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') || ' ' AS whole FROM items),
gold AS (SELECT DISTINCT query_id, item_id FROM asked JOIN spaced ON contains(whole, run))"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as campaign cells."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    e = read(spark, sf_dir, "events").withColumn("kk", k)
    arm = F.element_at(F.create_map(*map(F.lit, ("view", "baseline", "click", "full", "purchase", "oracle", "signup", "prefetch", "error", "gateway"))), F.col("event_type"))
    kind = F.when(F.col("user_id") % 2 == 0, F.lit("simple")).otherwise(F.lit("multiple"))
    pool = F.when(F.col("event_type") != "purchase", F.element_at(F.array(F.lit(30), F.lit(100), F.lit(180)), (F.floor(F.col("kk") / 3) % 3 + 1).cast("int")))
    c = e.select(
        "event_id",
        F.concat(F.lit("bfcl-"), kind, F.lit("-"), F.col("user_id").cast("string")).alias("scenario_id"),
        F.concat(F.lit("bfcl-"), kind).alias("category"),
        arm.alias("arm"),
        F.concat(F.lit("m"), (F.col("kk") % 3).cast("string")).alias("model"),
        pool.alias("pool_size"),
        F.floor(F.col("value") * 10).cast("bigint").alias("input_tokens"),
        (F.floor(F.col("value") * 10) + F.col("kk")).cast("bigint").alias("total_tokens"),
        F.round(F.col("value") / 1000, 6).alias("dollar_cost"),
        F.floor(F.col("value") * 7).cast("bigint").alias("wall_ms"),
        (F.col("kk") % 7 + 1).alias("turns"),
        (F.col("kk") + 2).alias("catalog_size"),
        (F.col("kk") % 4).alias("tool_calls_total"),
        F.when(F.col("kk") % 5 < 3, F.lit("pass")).otherwise(F.lit("fail")).alias("programmatic_verdict"),
        F.when(F.col("kk") % 4 == 0, F.lit("n/a")).when(F.col("kk") % 4 == 1, F.lit("fail")).otherwise(F.lit("pass")).alias("ast_verdict"),
        F.when(F.col("kk") % 11 == 0, F.lit("pass")).otherwise(F.lit("n/a")).alias("judge_verdict"),
        F.when(F.col("kk") % 17 == 0, F.lit("timeout")).alias("error"),
        F.when(F.col("kk") % 13 == 0, F.lit("max-steps")).otherwise(F.lit("stop")).alias("finish_reason"),
        F.concat(F.lit("v0."), F.floor(F.dayofmonth("ts") / 10).cast("string"), F.when(F.dayofmonth("ts") % 7 == 0, F.lit("-rc.1")).otherwise(F.lit(".0"))).alias("engine_version"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("generated_at"),
    ).withColumn("sdk_version", F.col("engine_version"))
    by = Window.partitionBy("scenario_id", "arm", "model", "pool_size").orderBy("event_id")
    return c.withColumn("run_index", F.row_number().over(by))


CELLS_SQL = """
cells AS (SELECT *, row_number() OVER (PARTITION BY scenario_id, arm, model, pool_size ORDER BY event_id) AS run_index FROM (
  SELECT event_id, 'bfcl-' || kind || '-' || user_id AS scenario_id, 'bfcl-' || kind AS category,
    CASE event_type WHEN 'view' THEN 'baseline' WHEN 'click' THEN 'full' WHEN 'purchase' THEN 'oracle' WHEN 'signup' THEN 'prefetch' WHEN 'error' THEN 'gateway' END AS arm,
    'm' || (k % 3) AS model, CASE WHEN event_type <> 'purchase' THEN ([30, 100, 180])[(k // 3) % 3 + 1] END AS pool_size,
    CAST(floor(value * 10) AS BIGINT) AS input_tokens, CAST(floor(value * 10) + k AS BIGINT) AS total_tokens, round(value / 1000, 6) AS dollar_cost, CAST(floor(value * 7) AS BIGINT) AS wall_ms,
    k % 7 + 1 AS turns, k + 2 AS catalog_size, k % 4 AS tool_calls_total,
    CASE WHEN k % 5 < 3 THEN 'pass' ELSE 'fail' END AS programmatic_verdict, CASE k % 4 WHEN 0 THEN 'n/a' WHEN 1 THEN 'fail' ELSE 'pass' END AS ast_verdict,
    CASE WHEN k % 11 = 0 THEN 'pass' ELSE 'n/a' END AS judge_verdict, CASE WHEN k % 17 = 0 THEN 'timeout' END AS error, CASE WHEN k % 13 = 0 THEN 'max-steps' ELSE 'stop' END AS finish_reason,
    'v0.' || (day(ts) // 10) || CASE WHEN day(ts) % 7 = 0 THEN '-rc.1' ELSE '.0' END AS engine_version, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS generated_at,
    'v0.' || (day(ts) // 10) || CASE WHEN day(ts) % 7 = 0 THEN '-rc.1' ELSE '.0' END AS sdk_version
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k, CASE WHEN user_id % 2 = 0 THEN 'simple' ELSE 'multiple' END AS kind FROM events)))"""


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, item_id, position: the distinct parts of every order, as a set of several gold items."""
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("item_id"), "l_linenumber")
    # Few lines share a part of an order, so nothing is lost by grouping after the shuffle alone.
    lines = lines.repartition(tasks(spark, lines.count()), "query_id", "item_id")
    return lines.groupBy("query_id", "item_id").agg(F.min("l_linenumber").alias("position"))


ORDER_ITEMS_SQL = "order_items AS (SELECT l_orderkey AS query_id, l_partkey AS item_id, min(l_linenumber) AS position FROM lineitem GROUP BY ALL)"
