"""Judging stored cells anew, by an audited join with their scenarios."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankyard.functions.arguments import ast_verdict, effective_calls
from rankyard.staging import written

#: (prompt, criteria, final text, rubric) to STRUCT<verdict, explanation>.
Judge = Callable[[Column, Column, Column, Column], Column]
#: The rubrics that a judge can be asked for; the strict one is the default.
RUBRICS = ("strict", "coherence")


@dataclass(frozen=True)
class Rejudged:
    """rows: the cells, each once, with their new verdicts; audit: one row of counters over them."""

    rows: DataFrame
    audit: DataFrame


def rejudge(cells: DataFrame, scenarios: DataFrame, judge: Judge | None = None, recompute: bool = True, rubric: str = "strict") -> Rejudged:
    """Cells whose verdicts on arguments are computed anew from their scenario's gold calls and the calls they stored, and
    whose rows that the program did not pass go to a judge, if one is given. All other columns stay as they are.

    cells has scenario_id, programmatic_verdict, ast_verdict, judge_verdict, judge_explanation, final_text and tool_calls
    (JSON of [{tool_id, args}]); scenarios has id, prompt, judge_criteria and gold_calls (JSON of [{tool, args}]), one row
    an id. Cells of scenarios without gold calls keep their verdict. A cell whose scenario is unknown is an error that names
    it: the join keeps such cells, they are counted in the pass that writes the rows, and no judge sees them.
    """
    if rubric not in RUBRICS:
        raise ValueError(f"unknown rubric {rubric!r}: one of {', '.join(RUBRICS)}")
    known = scenarios.select(F.col("id").alias("scenario_id"), F.col("prompt").alias("_prompt"), F.col("judge_criteria").alias("_criteria"), F.col("gold_calls").alias("_gold"), F.lit(True).alias("_known"))
    joined = cells.join(known, "scenario_id", "left").withColumn("_known", F.coalesce("_known", F.lit(False)))
    truth = F.col("_known") & F.coalesce(F.col("_gold").isNotNull() & (F.get_json_object("_gold", "$[0]").isNotNull()), F.lit(False))
    joined = joined.withColumn("_scored", truth & F.lit(recompute))
    fresh = joined.withColumn("_new", ast_verdict(F.when(F.col("_scored"), F.col("_gold")), effective_calls(F.col("tool_calls"))))
    fresh = fresh.withColumns({"_before": F.col("ast_verdict"), "ast_verdict": F.when(F.col("_scored"), F.col("_new.verdict")).otherwise(F.col("ast_verdict"))})
    passed = F.coalesce(F.col("programmatic_verdict") == "pass", F.lit(False))
    fresh = fresh.withColumn("_judged", F.col("_known") & ~passed & F.lit(judge is not None))
    if judge is not None:
        # A Python judge would be asked about every row of one table, so those it need not see are kept apart.
        asked = fresh.where("_judged").withColumn("_opinion", judge(F.col("_prompt"), F.col("_criteria"), F.col("final_text"), F.lit(rubric)))
        asked = asked.withColumns({"judge_verdict": F.col("_opinion.verdict"), "judge_explanation": F.col("_opinion.explanation")}).drop("_opinion")
        fresh = asked.unionByName(fresh.where("NOT _judged"))
    rows = written(fresh.drop("_new", "_prompt", "_criteria", "_gold"), "rejudged")
    counters = {"total": F.count("*"), "rejudged": F.count_if("_judged"), "ast_scored": F.count_if("_scored"), "skipped_pass": F.count_if(F.coalesce(F.col("programmatic_verdict") == "pass", F.lit(False))), "changed": F.count_if(~F.col("_before").eqNullSafe(F.col("ast_verdict")))}
    audit = rows.agg(*(x.alias(name) for name, x in counters.items()), F.count_if(~F.col("_known")).alias("unmatched"), F.min(F.when(~F.col("_known"), F.coalesce("scenario_id", F.lit("null")))).alias("first_unmatched"))
    seen = audit.first()
    if seen.unmatched:
        raise LookupError(f'scenario "{seen.first_unmatched}" is not among the scenarios; cells without one: {seen.unmatched} of {seen.total}')
    return Rejudged(rows.select(*cells.columns), audit.drop("unmatched", "first_unmatched"))
