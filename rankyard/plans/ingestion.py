"""Queries of ingestion: label filters, gold resolution, normalised names and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankyard.functions import labels
from rankyard.functions.arguments import documented, normalised_schema
from rankyard.operators import calls
from rankyard.plans import adapters as A
from rankyard.plans.registry import query
from rankyard.sources import ingest


@query(
    """WITH q AS (SELECT conv_id AS id, count(*) FILTER (WHERE role <> 'system') AS n, list(DISTINCT role ORDER BY role) FILTER (WHERE role <> 'system') AS gold FROM conversations GROUP BY 1)
SELECT 'toolret-conv-' || id AS id, 'r' || id AS prompt, list_sort(gold) AS gold_tools, 'c' AS category FROM q WHERE n > 0 AND id % 7 <> 0"""
)
def relevance_filter_gold(spark, sf_dir):
    """Queries with labels; roles other than system are relevant (user by default), every seventh query names an unknown tool."""
    c = A.read(spark, sf_dir, "conversations")
    score = F.when(F.col("role") == "system", F.lit(', "relevance": 0')).when(F.col("role") == "user", F.lit("")).otherwise(F.lit(', "relevance": 1'))
    rows = c.groupBy("conv_id").agg(F.array_sort(F.collect_set(F.concat(F.lit('{"id": "'), "role", F.lit('"'), score, F.lit("}")))).alias("l"))
    odd = F.when(F.col("conv_id") % 7 == 0, F.array(F.lit('{"id": "nobody"}'))).otherwise(F.array().cast("array<string>"))
    labelled = F.concat(F.lit("["), F.array_join(F.concat("l", odd), ","), F.lit("]"))
    queries = rows.select(F.lit(" Conv_query").alias("subset"), F.col("conv_id").alias("idx"), F.concat(F.lit("Given a `chat` task, retrieve tools that r"), F.col("conv_id").cast("string"), F.lit("..")).alias("instruction"), labelled.alias("labels"), F.lit("c").alias("category"))
    tools = c.select(F.col("role").alias("id")).distinct()
    return ingest.labelled_queries(queries, tools)[0].withColumn("gold_tools", F.array_sort("gold_tools"))


@query(
    """WITH g AS (SELECT l_orderkey AS id, bool_and(p_size <= 45) AS known FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT count(*) AS rows_in, count(*) FILTER (WHERE known) AS kept, count(*) FILTER (WHERE NOT known) AS skipped_unknown_gold FROM g"""
)
def known_gold_division(spark, sf_dir):
    """Orders whose parts are all in a catalogue without the largest ones: all or nothing, with counts."""
    orders = A.read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("l_partkey").alias("gold"))
    catalogue = A.read(spark, sf_dir, "part").where("p_size <= 45").select(F.col("p_partkey").alias("id"))
    rows = ingest.all_known(orders, catalogue, "id", "gold").withColumn("status", F.when(F.col("known"), F.lit("kept")).otherwise(F.lit("skipped_unknown_gold")))
    return ingest.counted(rows, ("skipped_unknown_gold",))


@query(
    """SELECT page_id, CASE WHEN regexp_full_match(url, '[A-Za-z0-9_-]+') THEN url ELSE regexp_replace(regexp_replace(url, '[^A-Za-z0-9_-]', '_', 'g'), '^[_-]+|[_-]+$', '', 'g') END AS name,
regexp_replace(lower(trim(' ' || url || '_query ')), '_query$', '') AS slug, CASE page_id % 4 WHEN 0 THEN 'find ' || url WHEN 1 THEN url || '.' WHEN 2 THEN 'Given a web task, find ' || url ELSE 'find. ' || url END AS request, split_part(url || '#m', '#', 1) AS base_url FROM pages"""
)
def string_normalisers(spark, sf_dir):
    url = F.col("url")
    wrap = lambda x: F.concat(F.lit("  Given a `web` task, retrieve tools that "), x)
    kind = F.col("page_id") % 4
    wrapped = F.when(kind == 0, wrap(F.concat(F.lit("find "), url, F.lit("... ")))).when(kind == 1, F.concat(F.lit(" "), url, F.lit(". ")))
    wrapped = wrapped.when(kind == 2, F.concat(F.lit("Given a web task, find "), url)).otherwise(wrap(F.concat(F.lit("find. "), url)))
    return A.read(spark, sf_dir, "pages").select(
        "page_id",
        labels.safe_name(url).alias("name"),
        labels.slug(F.concat(F.lit(" "), url, F.lit("_query "))).alias("slug"),
        labels.unwrapped(wrapped).alias("request"),
        labels.endpoint(F.concat(url, F.lit("#m")))["base_url"].alias("base_url"),
    )


@query(
    """WITH c AS (SELECT conv_id, list(text ORDER BY turn) FILTER (WHERE role = 'user') AS u, list(text ORDER BY turn) AS a FROM conversations GROUP BY 1) SELECT conv_id, array_to_string(CASE WHEN len(u) > 0 THEN u ELSE a END, chr(10)) AS prompt FROM c"""
)
def prompt_flatten(spark, sf_dir):
    turns = A.read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    shaped = F.transform("t", lambda x: F.array(F.struct(x["role"].alias("role"), x["text"].alias("content"))))
    return turns.select("conv_id", labels.flat_prompt(shaped).alias("prompt"))


@query(
    """WITH p AS (SELECT DISTINCT p_type || CASE WHEN p_size % 3 = 0 THEN '.' WHEN p_size % 3 = 1 THEN ' ' ELSE '' END AS id FROM part), b AS (SELECT id, CASE WHEN regexp_full_match(id, '[A-Za-z0-9_-]+') THEN id ELSE regexp_replace(regexp_replace(id, '[^A-Za-z0-9_-]', '_', 'g'), '^[_-]+|[_-]+$', '', 'g') END AS base FROM p),
n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY id) AS n FROM b) SELECT id, CASE WHEN n = 1 THEN base ELSE base || '_' || n END AS name, CASE WHEN n = 1 THEN id ELSE id || '_' || n END AS new_id FROM n"""
)
def id_disambiguation(spark, sf_dir):
    end = F.when(F.col("p_size") % 3 == 0, F.lit(".")).when(F.col("p_size") % 3 == 1, F.lit(" ")).otherwise(F.lit(""))
    return calls.disambiguated(A.read(spark, sf_dir, "part").select(F.concat("p_type", end).alias("id")))


@query("""SELECT event_id, '{"type":"object","properties":{"a":{"type":"number"},"b":{"type":"array","items":{}}},"default":' || json(coalesce(props, '{}'))::VARCHAR || '}' AS input_schema FROM events""")
def schema_normalise(spark, sf_dir):
    schema = F.concat(F.lit('{"type": "dict", "properties": {"a": {"type": "float"}, "b": {"type": "tuple", "items": {"type": "any"}}}, "default": '), F.coalesce("props", F.lit("{}")), F.lit("}"))
    return A.read(spark, sf_dir, "events").select("event_id", normalised_schema(schema).alias("input_schema"))


@query(
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type ELSE event_id::VARCHAR END AS name,
CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN 'area: ' || event_type || '. zone: z' ELSE '' END AS description, CASE WHEN event_id % 3 = 0 THEN '{"x":1}' ELSE '{}' END AS input_schema FROM events"""
)
def doc_json_fallback(spark, sf_dir):
    doc = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"functionality": "'), "event_type", F.lit('", "parameters": {"x": 1}}'))).when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"zone": "z", "area": "'), "event_type", F.lit('"}'))).otherwise(F.lit("no json"))
    return A.read(spark, sf_dir, "events").select("event_id", documented(F.col("event_id").cast("string"), doc).alias("doc")).select("event_id", "doc.*")


_TYPE = "p_type || CASE WHEN p_size % 3 = 0 THEN '.' WHEN p_size % 3 = 1 THEN ' ' ELSE '' END"


@query(
    f"""WITH l AS (SELECT l_orderkey AS id, l_linenumber AS n, {_TYPE} AS tool FROM lineitem JOIN part ON l_partkey = p_partkey),
b AS (SELECT tool, CASE WHEN regexp_full_match(tool, '[A-Za-z0-9_-]+') THEN tool ELSE regexp_replace(regexp_replace(tool, '[^A-Za-z0-9_-]', '_', 'g'), '^[_-]+|[_-]+$', '', 'g') END AS base FROM (SELECT DISTINCT tool FROM l)),
m AS (SELECT tool, CASE WHEN n = 1 THEN tool ELSE tool || '_' || n END AS new_id FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY tool) AS n FROM b))
SELECT id::VARCHAR AS id, list(new_id ORDER BY n, tool) AS pool, list(new_id ORDER BY n, tool)[1] AS gold, list(new_id ORDER BY n, tool)[-1] AS called FROM l JOIN m USING (tool) GROUP BY id"""
)
def renamed_everywhere(spark, sf_dir):
    """Orders as scenarios that offer their parts' types; names that collide are changed in the pool, the gold tool (the first
    line's) and the gold call (the last line's)."""
    part = A.read(spark, sf_dir, "part")
    end = F.when(F.col("p_size") % 3 == 0, F.lit(".")).when(F.col("p_size") % 3 == 1, F.lit(" ")).otherwise(F.lit(""))
    tools = part.select(F.col("p_partkey").alias("l_partkey"), F.concat("p_type", end).alias("tool"))
    lines = A.read(spark, sf_dir, "lineitem").join(tools, "l_partkey").groupBy(F.col("l_orderkey").cast("string").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "tool"))).alias("l"))
    pool = F.transform("l", lambda e: F.struct(e["tool"].alias("id"), e["tool"].alias("name")))
    calls_ = F.array(F.struct(F.element_at("l", -1)["tool"].alias("tool"), F.lit("{}").alias("args")))
    found = ingest.renamed(lines.select("id", pool.alias("candidate_pool"), F.array(F.element_at("l", 1)["tool"]).alias("gold_tools"), calls_.alias("gold_calls")))
    return found.select("id", F.transform("candidate_pool", lambda p: p["id"]).alias("pool"), F.element_at("gold_tools", 1).alias("gold"), F.element_at("gold_calls", 1)["tool"].alias("called"))


@query("SELECT l_orderkey AS id, list_sort(list_distinct(list(l_partkey))) AS gold FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY 1")
def scenarios_from_reference(spark, sf_dir):
    """Scenarios that a reference table names."""
    named = A.read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    rows = A.read(spark, sf_dir, "lineitem").join(named, "l_orderkey", "left_semi")
    return rows.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_set("l_partkey")).alias("gold"))
