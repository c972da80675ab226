"""Exact medians without a buffer of a group's values: a histogram of ranges finds the range that holds the middle, and only
that range's values are counted one by one."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges for each doubling of a value; a range beyond all finite ones.
FINE, BEYOND = 4096, 1 << 40


def same(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """left joined with right on columns of the same names, null with null; right's columns of those names go."""
    renamed = right.withColumnsRenamed({c: f"_right_{c}" for c in by})
    condition = F.lit(True)
    for c in by:
        condition = condition & F.col(c).eqNullSafe(F.col(f"_right_{c}"))
    return left.join(renamed, condition, how).drop(*(f"_right_{c}" for c in by))


def value_range(x: Column) -> Column:
    """The number of a value's range; a greater value never has a smaller one. NaN is the greatest value."""
    size = F.floor(F.log2(F.abs(x)) * FINE) + (1 << 30)
    size = F.when(F.abs(x) == float("inf"), F.lit(BEYOND)).otherwise(size)
    return F.when(F.isnan(x), F.lit(BEYOND + 1)).when(x == 0, F.lit(0)).when(x > 0, size).otherwise(-size).cast("bigint")


def medians(rows: DataFrame, by: Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """by and, for each name in columns, the median of its column's values that are not null (null without any).

    rows is read twice. A group's histogram has a row for each of its ranges; what is counted by value lies within 0.02 % of
    the median, and equal values are one row.
    """
    by = list(by)
    entries = F.array(*(F.struct(F.lit(name).alias("name"), F.col(c).cast("double").alias("x")) for name, c in columns.items()))
    values = rows.select(*by, F.explode(entries).alias("_e")).select(*by, F.col("_e.name").alias("_name"), F.col("_e.x").alias("_x")).where("_x IS NOT NULL")
    values = values.withColumn("_range", value_range(F.col("_x")))
    group = Window.partitionBy(*by, "_name")
    upto = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = values.groupBy(*by, "_name", "_range").agg(F.count("*").alias("_n"))
    placed = counts.withColumns({"_upto": F.sum("_n").over(upto), "_all": F.sum("_n").over(group)})
    # Of an even number of values, the middle two may lie in two ranges.
    middle = placed.where((F.col("_upto") >= F.expr("(_all + 1) div 2")) & (F.col("_upto") - F.col("_n") < F.expr("(_all + 2) div 2")))
    middle = middle.withColumn("_before", F.min(F.col("_upto") - F.col("_n")).over(group)).drop("_n", "_upto")
    near = same(values, middle, [*by, "_name", "_range"]).groupBy(*by, "_name", "_all", "_before", "_x").agg(F.count("*").alias("_n"))
    reached = F.col("_before") + F.sum("_n").over(group.orderBy("_x").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    near = near.withColumn("_reached", reached)
    at = lambda rank: F.min(F.when(F.col("_reached") >= F.expr(rank), F.col("_x")))
    found = near.groupBy(*by, "_name").agg(at("(_all + 1) div 2").alias("_low"), at("(_all + 2) div 2").alias("_high"))
    found = found.withColumn("_median", F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise((F.col("_low") + F.col("_high")) / 2))
    return found.groupBy(*by).agg(*(F.max(F.when(F.col("_name") == name, F.col("_median"))).alias(name) for name in columns))


def with_medians(rows: DataFrame, by: Sequence[str], aggregates: Sequence[Column], columns: Mapping[str, str], default: float | None = 0.0) -> DataFrame:
    """by, aggregates and medians of every group; default stands for the median of no values."""
    found = same(rows.groupBy(*by).agg(*aggregates), medians(rows, by, columns), by, "left")
    return found if default is None else found.withColumns({name: F.coalesce(name, F.lit(default)) for name in columns})
