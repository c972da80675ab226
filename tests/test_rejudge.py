"""Re-judging stored cells, and the arguments' numbers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rankyard.functions import arguments
from rankyard.operators.rejudge import rejudge

CELL = "scenario_id string, programmatic_verdict string, ast_verdict string, judge_verdict string, judge_explanation string, final_text string, tool_calls string, input_tokens long"
SCENARIO = "id string, prompt string, judge_criteria string, gold_calls string"
AREA = '[{"tool": "area", "args": {"base": [10]}}]'


def cell(scenario="s1", program="fail", ast="n/a", verdict="pass", text="t", calls="[]", tokens=1234):
    return (scenario, program, ast, verdict, None, text, calls, tokens)


def judged(spark, cells, scenarios, **options):
    return rejudge(spark.createDataFrame(cells, CELL), spark.createDataFrame(scenarios, SCENARIO), **options)


def polite(prompt, criteria, text, rubric):
    return F.struct(F.lit("fail").alias("verdict"), F.concat_ws("|", prompt, text, rubric).alias("explanation"))


def test_failed_and_undecided_rows_go_to_the_judge_and_passed_ones_do_not(spark):
    rows = [cell("s1", "pass", verdict="n/a"), cell("s2", "fail", text="I can't"), cell("s3", "n/a"), cell("s2", None)]
    got = judged(spark, rows, [(f"s{k}", f"p{k}", None, "[]") for k in (1, 2, 3)], judge=polite)
    assert got.audit.first().asDict() == {"total": 4, "rejudged": 3, "ast_scored": 0, "skipped_pass": 1, "changed": 0}
    found = {(r.scenario_id, r.programmatic_verdict): r for r in got.rows.collect()}
    assert found["s1", "pass"] == rows[0]
    assert (found["s2", "fail"].judge_verdict, found["s2", "fail"].judge_explanation, found["s2", "fail"].input_tokens) == ("fail", "p2|I can't|strict", 1234)
    assert got.rows.columns == [c.split()[0] for c in CELL.split(", ")]


def test_a_python_judge_sees_only_the_rows_it_must(spark):
    def picky(prompt, criteria, text, rubric):
        @F.pandas_udf("verdict string, explanation string")
        def run(prompt, text):
            import pandas as pd

            assert not text.str.contains("secret").any()
            return pd.DataFrame({"verdict": ["pass"] * len(text), "explanation": prompt})

        return run(prompt, text)

    got = judged(spark, [cell("s1", "pass", text="secret"), cell("s1", "fail")], [("s1", "p", None, None)], judge=picky)
    assert sorted(r.judge_explanation or "" for r in got.rows.collect()) == ["", "p"]


def test_verdicts_on_arguments_need_no_judge(spark):
    call = lambda base: f'[{{"tool_id": "area", "args": {{"base": {base}}}}}]'
    rows = [cell("s1", "pass", "fail", calls=call(10)), cell("s2", "pass", calls=call(7)), cell("s3", "fail", "pass", calls=call(7)), cell("s1", "fail", calls='[{"tool_id": "invoke_tool", "args": {"toolId": "area", "base": "0xA"}}]')]
    got = judged(spark, rows, [("s1", "p", None, AREA), ("s2", "p", None, AREA), ("s3", "p", None, None)])
    assert got.audit.first().asDict() == {"total": 4, "rejudged": 0, "ast_scored": 3, "skipped_pass": 2, "changed": 3}
    assert sorted((r.scenario_id, r.ast_verdict) for r in got.rows.collect()) == [("s1", "pass"), ("s1", "pass"), ("s2", "fail"), ("s3", "pass")]
    assert judged(spark, rows, [(s, "p", None, AREA) for s in ("s1", "s2", "s3")], recompute=False).audit.first().ast_scored == 0


def test_an_unknown_scenario_is_named(spark):
    with pytest.raises(LookupError, match=r'scenario "ghost" .*: 2 of 3'):
        judged(spark, [cell("s1"), cell("ghost"), cell("zombie")], [("s1", "p", None, None)], judge=polite)
    with pytest.raises(LookupError, match='"null"'):
        judged(spark, [cell(None)], [("s1", "p", None, None)])
    with pytest.raises(ValueError, match="unknown rubric"):
        judged(spark, [cell("s1")], [("s1", "p", None, None)], rubric="kind")
    assert judged(spark, [], [("s1", "p", None, None)], judge=polite).audit.first().total == 0


@pytest.mark.parametrize("text,value", [("0x10", 16), (" 0b11 ", 3), ("0O17", 15), ("1e3", 1000), (".5", 0.5), ("5.", 5), ("-0x10", None), ("1_000", None), ("nan", None), ("Infinity", None), ("1e999", None), ("١٢", None), ("", None), ("0x", None), (True, None), (None, None), (7, 7)])
def test_numbers_in_texts(text, value):
    assert arguments.number(text) == value


def test_whole_numbers_are_written_as_such():
    assert arguments.problems({"x": [3.0, {"y": 1.5}]}, {"x": 4.0}) == ["""'x'=4 not in [3,{"y":1.5}]"""]
