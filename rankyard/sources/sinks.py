"""Writers: overwritten and appended tables, reports as JSON and markdown."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Row, SparkSession

from rankyard.operators.compare import nested


def overwrite(rows: DataFrame, path: str, kind: str = "json", order: str | None = None) -> None:
    """Replaces a table. With an order, the files are ranges of it in the order of their names, each sorted, so that their
    lines one after another are in order, whatever wrote them."""
    (rows.orderBy(order) if order else rows).write.mode("overwrite").format(kind).save(path)


def append(rows: DataFrame, path: str, kind: str = "json", by: str | None = None) -> None:
    """Adds a run's rows to a history, in a folder of its own if by names its column."""
    writer = rows.write.mode("append").format(kind)
    (writer.partitionBy(by) if by else writer).save(path)


def truncate(spark: SparkSession, path: str, schema, kind: str = "json") -> None:
    overwrite(spark.createDataFrame([], schema), path, kind)


def report_json(rows: DataFrame, levels: Sequence[str]) -> str:
    """A report's rows, few, as one nested JSON text."""
    return nested(rows, levels).first()["report"] or "{}"


def percent(x: float | None) -> str:
    return "—" if x is None else f"{x * 100:.1f}%"


def decimals(x: float | None, n: int) -> str:
    return "—" if x is None else f"{x:,.{n}f}".replace(",", " ")


def dollars(x: float | None) -> str:
    return "—" if x is None else f"${x:.4f}"


def seconds(ms: float | None) -> str:
    return "—" if ms is None else f"{ms / 1000:.1f}s"


def pool(x: int | None) -> str:
    return "agnostic" if x is None else str(x)


def markdown(rows: Sequence[Row], columns: Sequence[tuple[str, str, object]]) -> str:
    """A markdown table of rows; columns are (title, field, format or None)."""
    head = "| " + " | ".join(t for t, _, _ in columns) + " |"
    line = "|" + "---|" * len(columns)
    body = ["| " + " | ".join(str(r[f]) if show is None else show(r[f]) for _, f, show in columns) + " |" for r in rows]
    return "\n".join([head, line, *body])


def report_markdown(averages: DataFrame, saved: DataFrame, failed: DataFrame, retrieval: DataFrame | None = None) -> str:
    """The campaign report: headline, savings, failures and retrieval panels, of collected aggregates."""
    order = ["model", "category", "arm", "pool_size"]
    nulls_last = lambda df, keys: df.orderBy(*(df[k].asc_nulls_last() for k in keys)).collect()
    parts = ["# Report", "## Results by arm", markdown(nulls_last(averages, order), [("model", "model", None), ("category", "category", None), ("arm", "arm", None), ("pool", "pool_size", pool), ("scenarios", "scenarios", None), ("success", "success_rate", percent), ("task", "task_completion_rate", percent), ("input tokens", "mean_input_tokens", lambda x: decimals(x, 0)), ("turns", "mean_turns", lambda x: decimals(x, 1)), ("cost", "mean_dollar_cost", dollars), ("time", "mean_wall_ms", seconds)])]
    parts += ["## Savings", markdown(nulls_last(saved, ["model", "category", "pool_size"]), [("model", "model", None), ("category", "category", None), ("pool", "pool_size", pool), *((f"{n} saved", f"{n}_savings_pct", lambda x: decimals(x, 1) + "%") for n in ("input", "total", "dollar", "wall"))])]
    parts += ["## Failures", markdown(nulls_last(failed, order), [(n, n, pool if n == "pool_size" else None) for n in (*order, "pass", "fail", "errored", "missing_gold", "step_limit")])]
    if retrieval is not None:
        rows = nulls_last(retrieval, ["corpus", "subset", "mode", "k", "pool_size"])
        parts += ["## Retrieval", markdown(rows, [(n, n, None) for n in ("corpus", "subset", "mode", "k", "pool_size", "n")] + [(n, f"mean_{n}", lambda x: decimals(x, 3)) for n in ("precision", "recall", "mrr", "ndcg")] + [("hit", "hit_rate", percent), ("complete", "complete_rate", percent)])]
    return "\n\n".join(parts) + "\n"


def comparison_markdown(compared: DataFrame, metric: str, bucket: str = "bucket") -> str:
    """Buckets by versions, oldest first, with the change from oldest to newest; "all" comes last."""
    from rankyard.functions.labels import version_key

    rows = compared.withColumn("key", version_key(compared["engine_version"])).orderBy("key").collect()
    versions = list(dict.fromkeys(r["engine_version"] for r in rows))
    values = {(r[bucket], r["engine_version"]): r["value"] for r in rows}
    deltas = {r[bucket]: r["delta"] for r in rows}
    table = [f"## {metric}", "| bucket | " + " | ".join(versions) + " | Δ |", "|" + "---|" * (len(versions) + 2)]
    for b in sorted(deltas, key=lambda b: (b == "all", b)):
        delta = deltas[b]
        table.append(f"| {b} | " + " | ".join(decimals(values.get((b, v)), 3) for v in versions) + f" | {'—' if delta is None else format(delta, '+.3f')} |")
    return "\n".join(table) + "\n"
