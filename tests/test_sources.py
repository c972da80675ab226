"""Readers, ingestion, sinks and streams on files."""

from __future__ import annotations

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from rankyard.sources import ingest, jsonl, schemas, sinks
from rankyard.streaming import rollups

ROW = "id STRING, n INT"


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_strict_names_the_bad_line(spark, tmp_path):
    good = put(tmp_path / "a.jsonl", '{"id": "x", "n": 1}\n\n{"id": "y"}\n')
    assert jsonl.strict(spark, good, ROW).orderBy("id").collect() == [("x", 1), ("y", None)]
    bad = put(tmp_path / "b.jsonl", '{"id": "x"}\n{"id": \n')
    with pytest.raises(ValueError, match="line 2"):
        jsonl.strict(spark, bad, ROW)
    assert jsonl.lenient(spark, bad, ROW, "id").count() == 1
    assert jsonl.table(spark, str(tmp_path / "none"), ROW).count() == 0
    assert jsonl.pruned(spark, good, ROW, ["id"]).columns == ["id"]


def test_other_formats(spark, tmp_path):
    names = put(tmp_path / "p.json", '{"cal": " keeps days ", "map": "shows ways"}')
    assert {r.id: r.description for r in jsonl.name_map(spark, names).collect()} == {"cal": "keeps days", "map": "shows ways"}
    queries = put(tmp_path / "q.csv", 'Query,Tool\n"one\nline",cal\n,map\nshort\nlast,map\n')
    assert [(r.line, r.tool) for r in jsonl.csv_queries(spark, queries).orderBy("line").collect()] == [(2, "cal"), (5, "map")]
    array = put(tmp_path / "m.json", json.dumps([{"query": "a", "tool": ["x"]}, {"query": "b", "tool": []}]))
    assert [tuple(r) for r in jsonl.json_array(spark, array, "struct<query:string,tool:array<string>>").collect()] == [(0, "a", ["x"]), (1, "b", [])]
    spark.range(3).selectExpr("cast(id as string) id", "'d' documentation").coalesce(1).write.parquet(str(tmp_path / "t"))
    assert {r.row_index for r in jsonl.parquet_strings(spark, str(tmp_path / "t"), ["id", "documentation"]).collect()} == {0, 1, 2}
    with pytest.raises(ValueError, match="no column nope"):
        jsonl.parquet_strings(spark, str(tmp_path / "t"), ["nope"])
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("readme.txt", "x")
        z.writestr("c.json", "[1]")
    assert jsonl.zipped_json(spark, str(tmp_path / "z.zip")).first().text == "[1]"


def test_corpora(spark):
    tools = spark.createDataFrame([("cal",), ("map",)], "id string")
    single = spark.createDataFrame([(2, "q", "cal"), (3, "r", "nope")], "line long, query string, tool string")
    multi = spark.createDataFrame([(0, "q", ["cal", "map"]), (1, "r", ["cal", "nope"]), (2, "s", [])], "idx int, query string, tool array<string>")
    kept, counts = ingest.single_and_multi(tools, single, multi)
    assert sorted(r.id for r in kept.collect()) == ["metatool-mt-0", "metatool-st-2"]
    assert counts.first().asDict() == {"rows_in": 5, "kept": 2, "skipped_unknown_gold": 3}
    labelled = [("Web_query", 0, "Given a web task, retrieve tools that x.", '[{"id": "cal"}, {"id": "no", "relevance": 0}]', "w"), ("w", 1, "i", "not json", "w"), ("w", 2, "i", '[{"id": "cal", "relevance": 2}]', "w"), ("w", 3, "i", '[{"id": "no"}]', "w")]
    kept, counts = ingest.labelled_queries(spark.createDataFrame(labelled, "subset string, idx int, instruction string, labels string, category string"), tools)
    assert [(r.id, r.prompt, r.gold_tools) for r in kept.collect()] == [("toolret-web-0", "x", ["cal"])]
    assert counts.first().asDict() == {"rows_in": 4, "kept": 1, "skipped_unknown_gold": 2, "skipped_no_positive_label": 1}
    docs = spark.createDataFrame([("a", '{"name": "n"}', 1), ("a", '{"name": "m", "description": "d"}', 2)], "id string, documentation string, ordinal int")
    assert ingest.documented_tools(docs).collect() == [("a", "m", "d", "{}")]


def test_function_calls(spark):
    data = spark.createDataFrame(
        [(k, [[("user", "hi"), ("system", "s")]], [("f", None, "{}")]) for k in ("0", "1", "2")],
        "id string, question array<array<struct<role:string,content:string>>>, function array<struct<name:string,description:string,parameters:string>>",
    )
    answers = spark.createDataFrame([("0", [{"g": "{}"}], 1), ("0", [{"f": "{}"}], 2), ("1", [{"g": "{}"}], 3)], "id string, ground_truth array<map<string,string>>, ordinal int")
    kept, counts = ingest.function_calls(data, answers, "simple")
    row = kept.first()
    assert (row.id, row.prompt, row.gold_tools, row.category) == ("bfcl-simple-0", "hi", ["f"], "bfcl-simple")
    assert counts.first().asDict() == {"rows_in": 3, "kept": 1, "skipped_missing_answer": 1, "skipped_unknown_gold": 1}
    skills = spark.createDataFrame([("s",)], "id string")
    found = spark.createDataFrame([("d", "1", "q", ["s"]), ("d", "2", "q", []), ("d", "3", "q", None)], "dataset string, instance_id string, question string, skill_annotations array<string>")
    assert ingest.skill_instances(found, skills)[1].first().asDict() == {"rows_in": 3, "kept": 1, "skipped_unknown_gold": 2}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("b", 1), ("a", 2)], "id string, n int")
    path = str(tmp_path / "h")
    sinks.overwrite(rows, path, order="id")
    sinks.append(rows, path)
    assert jsonl.strict(spark, path, ROW).count() == 4
    sinks.truncate(spark, path, ROW)
    assert jsonl.table(spark, path, ROW).count() == 0
    assert jsonl.structure(schemas.CELL)["pool_size"].nullable and jsonl.structure(schemas.SCENARIO).names[0] == "id"


def test_streams(spark, tmp_path):
    schema = "arm string, model string, category string, pool_size int, programmatic_verdict string, error string, tool_calls_total int, finish_reason string"
    row = ("full", "m", "bfcl-simple", 30, "fail", None, 2, "stop")
    source, target = tmp_path / "in", str(tmp_path / "out")
    for k in range(2):
        spark.createDataFrame([row] * (k + 1), schema).coalesce(1).write.mode("append").json(str(source))
        stream = spark.readStream.schema(schema).json(str(source))
        rollups.kept_failures(stream, target, str(tmp_path / "cp")).awaitTermination(120)
    got = rollups.failures_so_far(spark, target).first()
    assert (got.fail, got.missing_gold, got.category) == (3, 3, "bfcl")


CELLS = "scenario_id string, arm string, model string, run_index int, pool_size int, sdk_version string, generated_at timestamp, event_id long"


def cell(k, minute, arm="full", version="v1", run=1):
    import datetime

    return (f"s{k}", arm, "m", run, 30 if arm != "oracle" else None, version, datetime.datetime(2026, 1, 1, 0, minute), 100 * k + minute)


def test_cells_are_kept_once_though_the_query_dies_between_write_and_commit(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))

    def arrives(*rows):
        spark.createDataFrame(list(rows), CELLS).coalesce(1).write.mode("append").json(source)

    def run(after=None):
        stream = rollups.once(spark.readStream.schema(CELLS).json(source), "generated_at", "2 hours")
        query = rollups.kept_cells(stream, target, checkpoint, after)
        try:
            query.awaitTermination(180)
        except Exception:
            assert after is not None

    def die(batch, number):
        raise RuntimeError("the driver is lost")

    arrives(cell(1, 0), cell(2, 1), cell(1, 2))
    run(die)
    kept = lambda: sorted((r.scenario_id, r.sdk_version) for r in rollups.cells_so_far(spark, target).collect())
    assert kept() == [("s1", "v1"), ("s2", "v1")]
    run()
    assert kept() == [("s1", "v1"), ("s2", "v1")]
    # What was seen before the restart is still known; another version or run is another cell.
    arrives(cell(2, 5), cell(3, 6), cell(1, 7, version="v2"))
    run(die)
    run()
    run()
    assert kept() == [("s1", "v1"), ("s1", "v2"), ("s2", "v1"), ("s3", "v1")]


def test_queued_runs_get_their_earliest_control(spark, tmp_path):
    stored = spark.createDataFrame([cell(1, 9, "baseline", "v2"), cell(1, 3, "baseline", "v1"), cell(1, 1, "full"), cell(2, 4, "oracle")], CELLS)
    queue = "scenario_id string, arm string, model string, run_index int, pool_size int"
    spark.createDataFrame([r[:5] for r in (cell(1, 0, "baseline"), cell(2, 0, "oracle"), cell(3, 0, "baseline"), cell(1, 0, "full"))], queue).coalesce(1).write.json(str(tmp_path / "q"))
    stream = rollups.with_controls(spark.readStream.schema(queue).json(str(tmp_path / "q")), stored)
    stream.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(180)
    got = {(r.scenario_id, r.arm): r.control and (r.control.sdk_version, r.control.generated_at.minute) for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    assert got == {("s1", "baseline"): ("v1", 3), ("s2", "oracle"): ("v1", 4), ("s3", "baseline"): None, ("s1", "full"): None}


def test_reports_are_read_back(spark, tmp_path):
    from rankyard.operators import compare

    rows = spark.createDataFrame([("v1", "m", "simple", 3, 0.5), ("v1", "m", "multiple", 2, None), ("v2", "n", "simple", 1, 1.0)], "version string, model string, type string, n long, rate double")
    text = sinks.report_json(rows, ["version", "model", "type"])
    (tmp_path / "r").mkdir()
    put(tmp_path / "r" / "a.json", text)
    put(tmp_path / "r" / "b.json", "{broken")
    put(tmp_path / "r" / "c.json", "{}")
    got = jsonl.report_files(spark, str(tmp_path / "r"), ["version", "model", "type"], "n BIGINT, rate DOUBLE")
    assert sorted(map(tuple, got.where("status = 'read'").drop("file", "status").collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    assert [r.file[-6:] for r in got.where("status = 'unreadable'").collect()] == ["b.json"] and got.count() == 4
    assert [r.status for r in jsonl.report_files(spark, str(tmp_path / "none"), ["version"], "n BIGINT").collect()] == ["missing"]
    again = compare.nested(got.where("status = 'read'").drop("file", "status"), ["version", "model", "type"]).first().report
    assert json.loads(again) == json.loads(text)


def test_focused_reports(spark):
    from rankyard.operators import compare

    cells = spark.createDataFrame([("bfcl-simple",), ("sragents-a",), (None,)], "category string")
    rows = spark.createDataFrame([("bfcl-multiple-1",), ("metatool-st-1",), ("x",)], "scenario_id string")
    a, b = compare.of_prefix(cells, rows, "bfcl")
    assert (a.count(), b.count()) == (1, 1)
    assert [x.count() for x in compare.of_prefix(cells, rows, "")] == [3, 3]


def test_a_sorted_table_is_sorted_over_its_files(spark, tmp_path):
    rows = spark.createDataFrame([(f"{k * 7919 % 1000:04}",) for k in range(1000)], "id string").repartition(9)
    sinks.overwrite(rows, str(tmp_path / "t"), order="id")
    lines = [json.loads(x)["id"] for f in sorted((tmp_path / "t").glob("part-*")) for x in f.read_text().splitlines()]
    assert lines == sorted(lines) and len(lines) == 1000


def test_event_time_windows_drop_late_rows(spark, tmp_path):
    events = "ts timestamp, event_type string, value double, user_id long"
    source, target = str(tmp_path / "events"), str(tmp_path / "windows")
    for stamp in ("2026-01-01 00:10:00", "2026-01-01 05:00:00", "2026-01-01 00:20:00", "2026-01-01 09:00:00"):
        row = spark.createDataFrame([(stamp, "view", 1.0, 1)], "ts string, event_type string, value double, user_id long").withColumn("ts", F.to_timestamp("ts"))
        row.coalesce(1).write.mode("append").json(source)
        stream = rollups.windowed(spark.readStream.schema(events).json(source), "1 hour", delay="1 hour")
        stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    got = spark.read.parquet(target).orderBy("window_start").collect()
    assert [(r.window_start.hour, r.n) for r in got] == [(0, 1), (5, 1)]
