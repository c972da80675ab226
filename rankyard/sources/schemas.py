"""Schemas of the normalised tables, as DDL. Missing fields read as null."""

from __future__ import annotations

ITEM = "id STRING, kind STRING, name STRING, description STRING, tags ARRAY<STRING>, tools ARRAY<STRING>, body STRING, input_schema STRING, output_schema STRING"
SCENARIO = "id STRING, prompt STRING, candidate_pool ARRAY<STRUCT<id: STRING, name: STRING, description: STRING, input_schema: STRING, output_schema: STRING>>, gold_tools ARRAY<STRING>, judge_criteria STRING, category STRING, gold_calls ARRAY<STRUCT<tool: STRING, args: STRING>>"
#: A skill instance as it is published, and as it is normalised.
RAW_SKILL_INSTANCE = "instance_id STRING, question STRING, skill_annotations ARRAY<STRING>"
SKILL_INSTANCE = "id STRING, dataset STRING, prompt STRING, gold_skill_ids ARRAY<STRING>"
RETRIEVAL_ROW = (
    "run_type STRING, run_id STRING, generated_at STRING, scenario_id STRING, query STRING, golden_answer ARRAY<STRING>, category STRING, target_pool_size INT, actual_pool_size INT, pool_ids ARRAY<STRING>, engine_version STRING, "
    "k INT, pool_size INT, gold_count INT, recall_at_k DOUBLE, precision_at_k DOUBLE, reciprocal_rank DOUBLE, ndcg_at_k DOUBLE, hit_at_k BOOLEAN, complete_at_k BOOLEAN, gold_score DOUBLE, retrieved ARRAY<STRUCT<id: STRING, score: DOUBLE>>"
)
CELL = (
    "run_type STRING, run_id STRING, generated_at STRING, scenario_id STRING, category STRING, arm STRING, model STRING, run_index INT, sdk_version STRING, engine_version STRING, catalog_size INT, pool_size INT, seed BIGINT, "
    "input_tokens BIGINT, output_tokens BIGINT, cached_input_tokens BIGINT, cache_creation_tokens BIGINT, total_tokens BIGINT, tool_calls_total INT, tool_calls_unique INT, gateway_calls INT, non_gateway_calls INT, turns INT, effective_tool_ids ARRAY<STRING>, "
    "programmatic_verdict STRING, ast_verdict STRING, judge_verdict STRING, judge_explanation STRING, final_text STRING, finish_reason STRING, error STRING, wall_ms BIGINT, dollar_cost DOUBLE, tool_calls ARRAY<STRUCT<tool_id: STRING, args: STRING>>"
)
SELECT_CELL = (
    "run_type STRING, generated_at STRING, engine_version STRING, scenario_id STRING, category STRING, arm STRING, model STRING, run_index INT, pool_size INT, candidate_count INT, gold_skill_ids ARRAY<STRING>, selected_skill_ids ARRAY<STRING>, "
    "input_tokens BIGINT, output_tokens BIGINT, total_tokens BIGINT, dollar_cost DOUBLE, wall_ms BIGINT, error STRING"
)
PRICES = "model STRING, input DOUBLE, output DOUBLE, cached_input DOUBLE, cache_creation DOUBLE"
