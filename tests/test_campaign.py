"""Labels, calls, judging, planning."""

from __future__ import annotations

import json

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankyard.functions import arguments, labels
from rankyard.operators import calls, cells, compare, pools
from rankyard.sources import sinks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "wanted"),
    [("Given a `web` task, retrieve tools that find cats..", "find cats"), ("  plain request. ", "plain request."), ("Given an odd task, retrieve tools that a\nb.", "Given an odd task, retrieve tools that a\nb."), ("\n Given a b task, retrieve tools that x . .", "x ."), ("Given a b task, retrieve tools that c\nd. ", "c\nd")],
)
def test_unwrapped(spark, text, wanted):
    assert one(spark, labels.unwrapped(F.lit(text))) == wanted


@pytest.mark.parametrize(("name", "wanted"), [("fs.read file", "fs_read_file"), ("ok-Name_1", "ok-Name_1"), ("--.a.--", "a"), ("", "")])
def test_safe_name(spark, name, wanted):
    assert one(spark, labels.safe_name(F.lit(name))) == wanted


@pytest.mark.parametrize(("key", "wanted"), [("bfcl-simple-1", "bfcl-simple"), ("metatool-mt-2", "metatool"), ("toolret-x-1", "toolret"), ("sragents-9", "sragents"), ("bfcl-other", "other"), ("", "other")])
def test_corpus(spark, key, wanted):
    assert one(spark, labels.corpus_of(F.lit(key))) == wanted


def test_versions_sort_as_numbers(spark):
    rows = spark.createDataFrame([("0.10.0",), ("0.9.1",), ("0.9.1-rc.2",), ("0.9.1-rc.10",)], "v string")
    assert [r.v for r in rows.orderBy(labels.version_key(F.col("v"))).collect()] == ["0.9.1", "0.9.1-rc.2", "0.9.1-rc.10", "0.10.0"]


def test_names_without_collisions(spark):
    ids = spark.createDataFrame([("a.b",), ("a b",), ("a_b",), ("a_b_2",), ("c",)], "id string")
    got = {r.id: r.name for r in calls.disambiguated(ids).collect()}
    assert len(set(got.values())) == 5
    assert (got["a b"], got["a_b_2"], got["c"]) == ("a_b", "a_b_2", "c")


GOLD = {"place": ["Paris", "paris, france"], "days": [3], "unit": ["metric", ""], "near": [{"lat": [48.8], "lon": [2.3]}]}


@pytest.mark.parametrize(
    ("args", "wanted"),
    [
        ({"place": " PARIS ", "days": "3", "near": {"lat": 48.8, "lon": "2.30"}}, "pass"),
        ({"place": "Paris", "days": 3.0, "unit": "metric", "near": {"lat": 48.8, "lon": 2.3}}, "pass"),
        ({"place": "Paris", "days": True, "near": {"lat": 48.8, "lon": 2.3}}, "fail"),
        ({"place": "Paris", "days": 3, "near": {"lat": 48.8}}, "fail"),
        ({"place": "Paris", "days": 3, "near": {"lat": 48.8, "lon": 2.3}, "extra": 1}, "fail"),
        ({"days": 3, "near": {"lat": 48.8, "lon": 2.3}}, "fail"),
    ],
)
def test_argument_verdict(args, wanted):
    gold, seen = json.dumps([{"tool": "trip", "args": GOLD}]), json.dumps([{"tool_id": "other", "args": {}}, {"tool_id": "trip", "args": args}])
    assert arguments.verdict(gold, seen)["verdict"] == wanted
    assert (arguments.recall(gold, seen) == 1.0) == (wanted == "pass" or "extra" in args)


def test_verdict_edges():
    assert arguments.verdict(None, "[]")["verdict"] == "n/a"
    assert arguments.recall("[]", "[]") is None
    missing = arguments.verdict('[{"tool": "a", "args": {}}]', "[]")
    assert (missing["verdict"], missing["wrong_tool"]) == ("fail", True)
    assert arguments.recall('[{"tool": "a", "args": {}}, {"tool": "b", "args": {"x": [1]}}]', '[{"tool_id": "a", "args": {}}]') == 0.5


@given(st.recursive(st.none() | st.booleans() | st.integers(-9, 9) | st.text(max_size=3), lambda x: st.lists(x, max_size=2) | st.dictionaries(st.text(max_size=2), x, max_size=2), max_leaves=6))
def test_a_value_equals_itself_unless_it_holds_objects(value):
    if "{" not in json.dumps(value):
        assert arguments.equal(value, value)


def test_effective_calls():
    made = [{"tool_id": "search_tools", "args": {}}, {"tool_id": "invoke_tool", "args": {"toolId": "a", "args": {"x": 1}}}, {"tool_id": "invoke_tool", "args": {"toolId": "b", "y": 2}}, {"tool_id": "invoke_tool", "args": {}}, {"tool_id": "c", "args": {"z": 3}}]
    assert json.loads(arguments.effective(json.dumps(made))) == [{"tool_id": "a", "args": {"x": 1}}, {"tool_id": "b", "args": {"y": 2}}, {"tool_id": "c", "args": {"z": 3}}]


def test_schema_and_documentation():
    found = json.loads(arguments.normal_schema('{"type": "dict", "properties": {"a": {"type": "tuple", "items": {"type": "any"}}}}'))
    assert found == {"type": "object", "properties": {"a": {"type": "array", "items": {}}}}
    assert json.loads(arguments.normal_schema("not json", top=True)) == {"type": "object"}
    assert arguments.documentation("k", '{"domain": "d", "area": "x", "n": 1}') == {"name": "d", "description": "area: x. domain: d", "input_schema": "{}"}
    assert arguments.documentation("k", "oops") == {"name": "k", "description": "", "input_schema": "{}"}


def test_metering(spark):
    rows = [("t", 1, "search_tools", 100, 50, 20, 0, 170), ("t", 2, "a", 60, 25, 20, 0, 105), ("t", 3, "a", 50, 20, 20, 0, 90), ("u", 1, None, 5, 6, 7, 0, 0)]
    steps = spark.createDataFrame(rows, "id string, step int, tool string, input_tokens long, output_tokens long, cached_input_tokens long, cache_creation_tokens long, total_tokens long")
    got = {r.id: r for r in calls.metered(steps, "id").collect()}
    t = got["t"]
    assert (t.input_tokens, t.output_tokens, t.cached_input_tokens, t.total_tokens) == (210, 95, 60, 365)
    assert (t.tool_calls_total, t.tool_calls_unique, t.gateway_calls, t.non_gateway_calls, t.turns) == (3, 2, 1, 2, 3)
    assert (got["u"].total_tokens, got["u"].tool_calls_total) == (18, 0)


def test_tokens_count_once_a_step(spark):
    rows = [("t", 1, "a", 10, 4), ("t", 1, "b", 10, 4), ("t", 2, "a", 3, 1), ("t", 3, None, 5, 2)]
    steps = spark.createDataFrame(rows, "id string, step int, tool string, input_tokens long, output_tokens long").selectExpr("*", "0L AS cached_input_tokens", "0L AS cache_creation_tokens", "0L AS total_tokens")
    t = calls.metered(steps, "id").first()
    assert (t.input_tokens, t.output_tokens, t.total_tokens) == (18, 7, 25)
    assert (t.tool_calls_total, t.tool_calls_unique, t.gateway_calls, t.non_gateway_calls, t.turns) == (3, 2, 0, 3, 3)


@pytest.mark.parametrize("sizes", [[], [0, 5], [-1]])
def test_pool_sizes_are_positive(sizes):
    assert pools.pool_sizes([7, 3, 7]) == [3, 7]
    with pytest.raises(ValueError):
        pools.pool_sizes(sizes)


def test_cells_of_null_pools_resume_and_group(spark):
    queue = spark.createDataFrame([("s", "oracle", "m", 1, None), ("s", "full", "m", 1, 30)], "scenario_id string, arm string, model string, run_index int, pool_size int")
    assert cells.pending(queue, queue.where("arm = 'oracle'")).count() == 1
    assert cells.pending(queue, queue.limit(0)).count() == 2
    keys = [r.k for r in queue.orderBy("arm").select(cells.cell_key(F.lit("v"), F.col("pool_size")).alias("k")).collect()]
    assert keys == ["v::s::full::m::1::p30", "v::s::oracle::m::1"]


def test_nested_report_and_markdown(spark):
    rows = spark.createDataFrame([("1.0", "b", 0.5), ("1.0", "a", 1.0), ("0.9", "a", 0.25)], "engine_version string, bucket string, recall double")
    assert json.loads(sinks.report_json(rows, ["engine_version", "bucket"])) == {"0.9": {"a": {"recall": 0.25}}, "1.0": {"a": {"recall": 1.0}, "b": {"recall": 0.5}}}
    history = rows.withColumns({"pool_size": F.lit(100), "k": F.lit(3), "n": F.monotonically_increasing_id()})
    text = sinks.comparison_markdown(compare.across_versions(history, "recall", 100, 3, "n"), "recall")
    assert "| bucket | 0.9 | 1.0 | Δ |" in text and "| a | 0.250 | 1.000 | +0.750 |" in text and "| b | — | 0.500 | — |" in text


def test_report_markdown(spark):
    from oracle import SMALL

    from rankyard.plans import adapters

    c = adapters.cells(spark, SMALL)
    averages = cells.macro_average(c)
    text = sinks.report_markdown(averages, cells.savings(averages), cells.failures(c))
    assert text.startswith("# Report") and "agnostic" in text and "## Failures" in text


def test_one_cap_holds_for_the_whole_campaign(spark):
    costs = [((k * 37) % 11) / 10 for k in range(200)]
    rows = [(k, f"s{k % 5}", c) for k, c in enumerate(costs)] + [(200, "s0", None), (201, "s1", 0.1)]
    some = spark.createDataFrame(rows, "event_id long, scenario_id string, dollar_cost double").repartition(7)
    for cap in (0.0, 0.2, 20.0, 55.5, 1e6):
        wanted, spent = {}, 0.0
        for k, _, c in rows:
            if round(spent, 6) < cap:
                wanted[k] = pytest.approx(spent, abs=1e-6)
            spent += c or 0.0
        for ranges in (None, 1, 13):
            found = cells.until_all_spent(some, cap, "event_id", ranges=ranges).collect()
            assert {r.event_id: r.spent_before for r in found} == wanted and len(found) == len(wanted)
    assert cells.until_all_spent(some.limit(0), 1.0, "event_id").count() == 0


def test_arms_are_registered_functions(spark):
    from rankyard.operators.calls import Arm, Shown, arm_table, arms, visible
    from rankyard.operators.registry import Registry

    one = spark.createDataFrame([(1,)], "query_id long")
    items = lambda *ids: spark.createDataFrame([(1, i) for i in ids], "query_id long, item_id long")
    ranking = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (1, 7, 3)], "query_id long, item_id long, rank int")
    mine = Registry("arm")
    for name in arms:
        mine.add(name, arms[name])
    mine.add("third", Arm(lambda s: s.ranking.where("rank = 3"), pool_agnostic=True))
    got = {}
    for r in visible(one, items(5, 6, 7, 8), items(6), ranking, 2, mine).collect():
        got.setdefault(r.arm, set()).add(r.item_id)
    gateway = {"search_tools", "invoke_tool"}
    assert got == {"baseline": {"5", "6", "7", "8"}, "oracle": {"6"}, "prefetch": {"5", "6"}, "full": {"5", "6"} | gateway, "gateway": gateway, "third": {"7"}}
    assert {r.arm for r in arm_table(spark, mine).where("pool_agnostic").collect()} == {"oracle", "third"}
    with pytest.raises(ValueError, match="registered already"):
        mine.add("oracle", arms["oracle"])
    with pytest.raises(ValueError, match="needs a name"):
        mine.add(" ", arms["oracle"])
    with pytest.raises(TypeError):
        Arm(None)
    assert Shown(one, one, one, ranking, 1).shortlist().count() == 1
