"""Samples that seed and ids fix, the same for any partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankyard.functions.labels import seeded_order


def seeded(rows: DataFrame, n: int, seed: int, id_col: str = "id") -> DataFrame:
    """n rows in seeded order."""
    return rows.orderBy(seeded_order(seed, F.col(id_col)), id_col).limit(n)


def head(rows: DataFrame, n: int, id_col: str = "id") -> DataFrame:
    """The first n rows by id."""
    return rows.orderBy(id_col).limit(n)


def _drawn(rows: DataFrame, by: str, seed: int, id_col: str) -> DataFrame:
    return rows.withColumn("draw", F.row_number().over(Window.partitionBy(by).orderBy(seeded_order(seed, F.col(id_col)), id_col)))


def stratified(rows: DataFrame, n: int, seed: int, by: str, id_col: str = "id") -> DataFrame:
    """n divided evenly over the groups, the remainder to the first by name; a small group gives all it has."""
    groups = rows.groupBy(by).agg(F.count("*").alias("size"))
    # One row for each group.
    named = groups.withColumns({"place": F.row_number().over(Window.orderBy(by)), "groups": F.count("*").over(Window.partitionBy())})
    quota = named.select(by, F.expr(f"{n} div groups + CASE WHEN place <= {n} % groups THEN 1 ELSE 0 END").alias("quota"))
    # No quota is above n: with that literal bound, tasks keep the first n of each group before they are shuffled.
    return _drawn(rows, by, seed, id_col).where(F.col("draw") <= n).join(F.broadcast(quota), by).where("draw <= quota").drop("draw", "quota")


def round_robin(rows: DataFrame, n: int, seed: int, by: str, id_col: str = "id") -> DataFrame:
    """n rows, one of each group in turn."""
    return _drawn(rows, by, seed, id_col).where(F.col("draw") <= n).orderBy("draw", by).limit(n).drop("draw")
