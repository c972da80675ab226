"""Reports over histories: nested by version, compared across versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankyard.functions.labels import corpus_of, is_prerelease, version_key


def metric_fields(rows: DataFrame, keys: Sequence[str]) -> Column:
    """A row's metrics without its group keys, as a struct."""
    return F.struct(*(c for c in rows.columns if c not in keys))


def nested(rows: DataFrame, levels: Sequence[str]) -> DataFrame:
    """report: one JSON object nested by the levels, holding each row's other columns. Rows are groups of a report, few."""
    inner = rows.select(*levels, metric_fields(rows, levels).alias("value"))
    for k in range(len(levels) - 1, -1, -1):
        entry = F.struct(F.coalesce(F.col(levels[k]).cast("string"), F.lit("")).alias("key"), F.col("value"))
        listed = F.map_from_entries(F.array_sort(F.collect_list(entry), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)))
        inner = inner.groupBy(*levels[:k]).agg(listed.alias("value")) if k else inner.agg(listed.alias("value"))
    return inner.select(F.to_json("value").alias("report"))


def across_versions(rows: DataFrame, metric: str, pool_size: int, k: int, ordinal: str, bucket: str = "bucket") -> DataFrame:
    """bucket, version, value, delta: a metric at one pool and k by bucket and version; the last of repeated rows wins.

    Buckets and versions are aligned in full: a version that lacks a bucket has a null value. delta is the newest
    version's value less the oldest's, in the order of the versions' numbers.
    """
    at = rows.where((F.col("pool_size") == pool_size) & (F.col("k") == k))
    last = at.groupBy(bucket, "engine_version").agg(F.max_by(metric, ordinal).alias("value"))
    versions = last.select("engine_version").distinct().withColumn("key", version_key(F.col("engine_version")))
    grid = last.select(bucket).distinct().crossJoin(versions)  # a report's buckets and versions
    full = grid.join(last, [bucket, "engine_version"], "left")
    ends = full.groupBy(bucket).agg((F.max_by("value", "key") - F.min_by("value", "key")).alias("delta"))
    return full.join(ends, bucket).drop("key")


def without_prereleases(rows: DataFrame) -> DataFrame:
    return rows.where(~is_prerelease(F.col("engine_version")))


def flattened(reports: DataFrame, levels: Sequence[str], metrics: str, text: str = "report") -> DataFrame:
    """The rows of nested reports (JSON in the column text): the other columns, levels, metrics (a DDL of their fields) and
    status. The inverse of nested(): what is no such object gives one row of status "unreadable", an empty one none."""
    shape = "string"
    for _ in levels:
        shape = f"map<string,{shape}>"
    others = [c for c in reports.columns if c != text]
    out = reports.select(*others, F.from_json(text, shape).alias("_m"), F.lit("read").alias("status"))
    bad = out.where("_m IS NULL").select(*others, *(F.lit(None).cast("string").alias(c) for c in levels), F.from_json(F.lit(None).cast("string"), metrics).alias("_v"), F.lit("unreadable").alias("status"))
    out = out.where("_m IS NOT NULL")
    for c in levels:
        out = out.select(*(x for x in out.columns if x != "_m"), F.explode("_m").alias(c, "_m"))
    good = out.select(*others, *levels, F.from_json("_m", metrics).alias("_v"), "status")
    return good.unionByName(bad).select(*others, *levels, "_v.*", "status")


def of_prefix(cells: DataFrame, rows: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame]:
    """The cells whose category, and the retrieval rows whose corpus begins with a prefix; all for the empty one."""
    if not prefix:
        return cells, rows
    return cells.where(F.coalesce("category", F.lit("")).startswith(prefix)), rows.where(corpus_of(F.col("scenario_id")).startswith(prefix))
