"""Jobs on files: corpora, runs, kept rankings, histories; options."""

from __future__ import annotations

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from rankyard import jobs
from rankyard.functions import options
from rankyard.operators import calls, pools
from rankyard.operators.runs import RankingStore, Run, evaluate, pool_rankers
from rankyard.sources import ingest, jsonl, schemas

PLUGINS = {"WeatherTool": " weather forecasts for any city", "FlightTool": "book flights and find airline tickets", "RecipeTool": "cooking recipes and ingredients", "NewsTool": "latest news headlines", "MapTool": "maps and directions to any city", "MusicTool": "songs and playlists"}
SINGLE = 'Query,Tool\nwhat is the weather in Paris,WeatherTool\nbook me flights,FlightTool\n"find recipes, with\ningredients",RecipeTool\nnews headlines today,NewsTool\ndirections to the city,MapTool\nplay songs,MusicTool\n'
MULTI = [{"query": "weather and flights", "tool": ["WeatherTool", "FlightTool"]}, {"query": "news and songs", "tool": ["NewsTool", "MusicTool"]}]


def put(path, text):
    path.write_text(text if isinstance(text, str) else json.dumps(text), encoding="utf-8")
    return str(path)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("plugins")
    out = str(folder / "corpus")
    counts = jobs.ingest_plugins(spark, put(folder / "p.json", PLUGINS), put(folder / "s.csv", SINGLE), out, put(folder / "m.json", MULTI))
    assert counts == {"plugins": 6, "rows_in": 8, "kept": 8, "skipped_unknown_gold": 0}
    return out


def test_plugins_become_scenarios(spark, corpus):
    rows = jsonl.strict(spark, corpus, schemas.SCENARIO).collect()
    assert len(rows) == 8 and all(r.id.startswith("metatool-") and r.gold_tools and r.judge_criteria is None for r in rows)
    assert all((t.input_schema, t.output_schema) == ("{}", "{}") for r in rows for t in r.candidate_pool)
    two = next(r for r in rows if r.id == "metatool-mt-0")
    assert [t.id for t in two.candidate_pool] == ["WeatherTool", "FlightTool"] and two.candidate_pool[0].description == "weather forecasts for any city"
    assert next(r for r in rows if r.id == "metatool-st-4").prompt == "find recipes, with\ningredients"
    assert [r.id for r in rows] == sorted(r.id for r in rows)


def test_a_tool_run_writes_rows_and_a_summary(spark, corpus, tmp_path):
    out, summary = str(tmp_path / "rows"), str(tmp_path / "summary")
    done = jobs.retrieval(spark, corpus, out, summary, (1, 3), (3, 6), engine_version="e1")
    assert (done["scenarios"], done["rows_written"]) == (8, 32)
    rows = jsonl.strict(spark, out, schemas.RETRIEVAL_ROW).collect()
    assert len(rows) == 32 and {r.run_id for r in rows} == {done["run_id"]} and {r.engine_version for r in rows} == {"e1"}
    for r in rows:
        assert all(0 <= x <= 1 for x in (r.recall_at_k, r.precision_at_k, r.reciprocal_rank)) and r.hit_at_k in (True, False)
        assert r.actual_pool_size == len(r.pool_ids) == r.target_pool_size and set(r.golden_answer) <= set(r.pool_ids)
    table = spark.read.json(summary)
    assert {(r.bucket, r.overall) for r in table.collect()} == {(b, o) for b in ("single-tool", "multi-tool", "all") for o in (True, False)}
    assert [r.bucket for r in table.where("overall AND k = 1").orderBy("bucket_place").collect()] == ["single-tool", "multi-tool", "all"]
    assert table.where("bucket = 'all' AND pool_size = 3 AND k = 1").first().n == 8
    again = jobs.retrieval(spark, corpus, out, summary, (1, 3), (3, 6), scenarios=2)
    assert again["rows_written"] == 8 and spark.read.json(summary).select("run_id").distinct().count() == 2


def test_a_second_run_ranks_nothing(spark, corpus, tmp_path, monkeypatch):
    path, seen = str(tmp_path / "store"), []
    ranker = pool_rankers["bm25"]
    monkeypatch.setitem(pool_rankers._known, "bm25", lambda *a: seen.append(a[1].select("query_id", "pool_size").distinct().count()) or ranker(*a))
    run = lambda sizes, seed=42: jobs.retrieval(spark, corpus, str(tmp_path / "rows"), str(tmp_path / "summary"), (1, 3), sizes, seed, store=path)
    plain = lambda: sorted(str(r.asDict() | {"run_id": 0, "generated_at": 0}) for r in jsonl.strict(spark, str(tmp_path / "rows"), schemas.RETRIEVAL_ROW).collect())
    run((3,))
    run((3, 6))
    kept = plain()
    run((3, 6))
    assert seen == [8, 8] and plain() == kept
    run((3, 6), seed=1)
    assert seen[2:] == [16]
    jobs.retrieval(spark, corpus, str(tmp_path / "rows"), str(tmp_path / "summary"), (1, 3), (3, 6))
    assert plain() == kept


def test_stored_rankings_depend_on_text_and_members(spark, tmp_path):
    items = spark.createDataFrame([(1, "red fox"), (2, "blue fox"), (3, "green")], "id long, text string")
    members = spark.createDataFrame([(0, 2, 1), (0, 2, 2), (1, 2, 3)], "query_id long, pool_size int, item_id long")
    ask = lambda a, b: spark.createDataFrame([(0, a), (1, b)], "id long, text string")
    store = RankingStore(spark, str(tmp_path / "s"))
    found, n = store.rankings(ask("red fox", "nothing"), members, items, 2, "c")
    assert n == 2 and sorted((r.query_id, r.item_id, r["rank"]) for r in found.collect()) == [(0, 1, 1), (0, 2, 2)]
    assert store.rankings(ask("red fox", "nothing"), members, items, 2, "c")[1] == 0
    assert store.rankings(ask("red fox", "else"), members, items, 2, "c")[1] == 1
    assert store.rankings(ask("red fox", "nothing"), members.where("item_id != 2"), items, 2, "c")[1] == 1
    assert store.rankings(ask("red fox", "nothing"), members, items, 2, "other")[1] == 2
    with pytest.raises(ValueError, match="unknown method"):
        store.rankings(ask("a", "b"), members, items, 2, "c", "magic")


def test_rankers_of_pools(spark):
    items = spark.createDataFrame([(1, "red fox", [1.0, 0.0]), (2, "blue fox", [0.0, 2.0]), (3, "fox", [1e200, 1e200]), (4, "fox", None)], "id long, text string, vector array<double>")
    asks = spark.createDataFrame([(0, "red", [3.0, 1.0]), (1, "fox", [0.0, 0.0])], "id long, text string, vector array<double>")
    members = spark.createDataFrame([(q, p, i) for q in (0, 1) for p in (2, 4) for i in range(1, p + 1)], "query_id long, pool_size int, item_id long")
    got = {m: {(r.query_id, r.pool_size, r["rank"]): r.item_id for r in pool_rankers[m](asks, members, items, 2).collect()} for m in pool_rankers}
    assert got["semantic"] == {(0, 2, 1): 1, (0, 2, 2): 2, (0, 4, 1): 1, (0, 4, 2): 3}
    assert got["bm25"][0, 4, 1] == 1 and got["hybrid"][0, 2, 1] == 1 and (1, 4, 1) in got["hybrid"]


def test_skills_from_a_zip_to_rows(spark, tmp_path):
    skills = [{"skill_id": f"s{k}", "name": f"skill {k}", "description": None if k % 3 else f"does thing{k}", "content": "long body"} for k in range(12)]
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("corpus.json", json.dumps(skills))
    files = [(d, put(tmp_path / f"{d}.json", [{"instance_id": f"{d}{k}", "question": f"thing{k} please", "skill_annotations": [f"s{k}", "s1"] if k < 4 else ["unknown"]} for k in range(5)])) for d in ("a", "b")]
    counts = jobs.ingest_skills(spark, str(tmp_path / "c.zip"), files, str(tmp_path / "i"), str(tmp_path / "cat"))
    assert counts == {"skills": 12, "rows_in": 10, "kept": 8, "skipped_unknown_gold": 2}
    done = jobs.skill_retrieval(spark, str(tmp_path / "i"), str(tmp_path / "cat"), str(tmp_path / "rows"), str(tmp_path / "sum"), (1, 5), (4, 100))
    assert (done["scenarios"], done["rows_written"]) == (8, 32)
    rows = jsonl.strict(spark, str(tmp_path / "rows"), schemas.RETRIEVAL_ROW).collect()
    assert {r.category for r in rows} == {"sragents-a", "sragents-b"} and {r.actual_pool_size for r in rows} == {4, 12}
    assert all(set(r.golden_answer) <= set(r.pool_ids) for r in rows)
    assert {r.bucket for r in spark.read.json(str(tmp_path / "sum")).collect()} == {"a", "b", "all"}
    assert jobs.skill_retrieval(spark, str(tmp_path / "i"), str(tmp_path / "cat"), str(tmp_path / "rows"), str(tmp_path / "sum"), (1,), (4,), scenarios=4)["rows_written"] == 4


def test_gold_that_the_catalogue_lacks_counts_but_has_no_row(spark, tmp_path):
    put(tmp_path / "i.jsonl", '{"id": "x", "dataset": "d", "prompt": "thing", "gold_skill_ids": ["s1", "gone"]}\n')
    put(tmp_path / "c.jsonl", '{"id": "s1", "name": "thing", "description": ""}\n{"id": "s2", "name": "else", "description": ""}\n')
    jobs.skill_retrieval(spark, str(tmp_path / "i.jsonl"), str(tmp_path / "c.jsonl"), str(tmp_path / "r"), str(tmp_path / "s"), (5,), (2,))
    row = jsonl.strict(spark, str(tmp_path / "r"), schemas.RETRIEVAL_ROW).first()
    assert (row.gold_count, row.recall_at_k, row.complete_at_k, row.pool_ids) == (2, 0.5, False, ["s1", "s2"])


def test_documented_tools_and_labelled_queries(spark, tmp_path):
    def table(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / name))
        part = next((tmp_path / name).glob("part-*"))
        part.rename(tmp_path / f"{name}.parquet")
        return str(tmp_path / f"{name}.parquet")

    tool = "id string, documentation string"
    a = table("web", [("t1", '{"name": "old"}'), ("t2", '{"name": "two", "parameters": {"type": "dict"}}')], tool)
    b = table("code", [("t1", '{"name": "new", "description": "d"}')], tool)
    ask = table("Web_query", [("q0", "x", "Given a web task, retrieve tools that work.", '[{"id": "t1"}, {"id": "t2", "relevance": 0}]', "w"), ("q1", "x", "plain", '[{"id": "nope"}]', "w")], "id string, query string, instruction string, labels string, category string")
    counts = jobs.ingest_documented(spark, [a, b], [ask], str(tmp_path / "out"))
    assert counts == {"rows_in": 2, "kept": 1, "skipped_unknown_gold": 1, "skipped_no_positive_label": 0}
    row = jsonl.strict(spark, str(tmp_path / "out"), schemas.SCENARIO).first()
    assert (row.id, row.prompt, [(t.id, t.name) for t in row.candidate_pool]) == ("toolret-web-0", "work", [("t1", "new")])


def test_calls_from_files_with_the_last_answer_and_new_names(spark, tmp_path):
    row = lambda k, names: json.dumps({"id": f"r{k}", "question": [[{"role": "user", "content": f"ask {k}"}]], "function": [{"name": n, "description": None, "parameters": {"type": "dict", "properties": {"x": {"type": "float"}}}} for n in names]})
    answer = lambda k, f, x: json.dumps({"id": f"r{k}", "ground_truth": [{f: {"x": [x]}}]})
    data = put(tmp_path / "d.jsonl", "\n".join([row(0, ["a.b", "a_b"]), row(1, ["a_b"]), row(2, ["c"]), row(3, ["c"])]))
    answers = put(tmp_path / "a.jsonl", "\n".join([answer(0, "a.b", 1), answer(1, "a_b", 1), "", answer(0, "a_b", 2), answer(2, "nope", 1)]))
    counts = jobs.ingest_calls(spark, data, answers, "simple", str(tmp_path / "out"))
    assert counts == {"rows_in": 4, "kept": 2, "skipped_missing_answer": 1, "skipped_unknown_gold": 1}
    rows = {r.id: r for r in jsonl.strict(spark, str(tmp_path / "out"), schemas.SCENARIO).collect()}
    assert [t.id for t in rows["bfcl-simple-r0"].candidate_pool] == ["a.b", "a_b_2"] and rows["bfcl-simple-r0"].gold_tools == ["a_b_2"]
    assert [(c.tool, json.loads(c.args)) for c in rows["bfcl-simple-r0"].gold_calls] == [("a_b_2", {"x": [2]})]
    assert rows["bfcl-simple-r1"].gold_tools == ["a_b_2"] and json.loads(rows["bfcl-simple-r1"].candidate_pool[0].input_schema) == {"type": "object", "properties": {"x": {"type": "number"}}}


def test_calls_count_by_canonical_ids(spark):
    steps = spark.createDataFrame([("t", 1, "a_b"), ("t", 1, "a_b_2"), ("t", 2, "search_tools"), ("u", 1, "a_b"), ("u", 2, None)], "trace string, step int, tool string")
    steps = steps.withColumns({f"{k}_tokens": F.lit(1) for k in ("input", "output", "cached_input", "cache_creation", "total")})
    names = spark.createDataFrame([("t", "a_b", "a.b"), ("t", "a_b_2", "a.b"), ("u", "a_b", "a b")], "trace string, name string, id string")
    assert sorted((r.trace, r.tool) for r in calls.canonical(steps, names).collect() if r.tool) == [("t", "a.b"), ("t", "a.b"), ("t", "search_tools"), ("u", "a b")]
    got = {r.trace: r for r in calls.metered(steps, "trace", names=names).collect()}
    assert (got["t"].tool_calls_unique, got["t"].gateway_calls, got["t"].turns, got["u"].tool_calls_total) == (2, 1, 2, 1)
    with pytest.raises(Exception, match="no name is left"):
        calls.disambiguated(spark.createDataFrame([("ok",), ("__--",), ("...",)], "id string")).collect()


def test_lines_are_numbered_over_splits_and_files(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    for n in (1, 400):
        put(folder / f"f{n}.jsonl", "".join(f'{{"id": "{"x" * (k % 50)}", "n": {k}}}\n' + "\n" * (k % 3 == 0) for k in range(n)))
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    spark.conf.set("spark.sql.files.openCostInBytes", "10b")
    try:
        for path in (folder / "f400.jsonl", folder / "f1.jsonl"):
            wanted = list(enumerate(path.read_text().split("\n")[:-1], 1))
            got = jsonl.numbered_lines(spark, str(folder)).where(F.col("file").endswith(path.name))
            assert sorted((r.line, r.value) for r in got.collect()) == wanted
        assert jsonl.numbered_lines(spark, str(folder / "f400.jsonl")).rdd.getNumPartitions() > 1
        bad = put(tmp_path / "bad.jsonl", (folder / "f400.jsonl").read_text() + "{oops\n\n[1, 2\n")
        with pytest.raises(ValueError, match=f"line {len((folder / 'f400.jsonl').read_text().splitlines()) + 1} is not a record"):
            jsonl.strict(spark, bad, "id STRING, n INT")
        assert jsonl.strict(spark, str(folder), "id STRING, n INT").count() == 401
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", keep)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_options():
    assert options.k_values(50, 10) == [1, 3, 5, 10, 50] and options.k_values(4, 3) == [1, 3, 4] and options.k_values(5, 5) == [1, 3, 5]
    assert options.embedding(None) is None and options.embedding(" /opt/m ") == "/opt/m" and options.embedding_label("/opt/m") == "/opt/m"
    spec = options.embedding('{"url": "https://x/v1", "model": "m", "pooling": "cls"}')
    assert options.embedding_label(spec) == "https://x/v1" and options.embedding_label(None) == "default" and options.embedding_label({"url": 3}) == "custom"
    for bad in ("{", '{"pooling": "cls"}', '{"local": "a", "ollama": "b"}', '{"local": "a", "typo": 1}', '{"url": "x"}'):
        with pytest.raises(ValueError):
            options.embedding(bad)
    assert [options.summary_path(p) for p in ("a/b.jsonl", "a/b", "a/b.c.json")] == ["a/b-summary.jsonl", "a/b-summary.jsonl", "a/b.c-summary.jsonl"]
