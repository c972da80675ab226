"""Streams of appended cells and events: roll-ups kept up to date, duplicates dropped, windows over event time."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rankyard.operators.cells import CONTROL, ORACLE, cell_key, failures

CONTROLS = (CONTROL, ORACLE)


def once(cells: DataFrame, time_col: str, delay: str = "1 hour") -> DataFrame:
    """Cells of a stream without repeats of a key within the delay; what was seen outlives a restart in the state store."""
    keyed = cells.withColumn("cell_key", cell_key(F.col("sdk_version"), F.col("pool_size")))
    return keyed.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["cell_key"])


def kept_cells(cells: DataFrame, target: str, checkpoint: str, after: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Adds the cells of a stream to a table as they come. Each batch has a folder of its own, which it replaces when it
    runs again after a failure, so no cell is lost or doubled. after is called when a batch has been written."""

    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number:08d}")
        if after is not None:
            after(batch, number)

    return cells.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def cells_so_far(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.option("basePath", target).parquet(f"{target}/batch=*").drop("batch")


def kept_failures(cells: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Keeps the failure counts of all cells so far in a table: each batch adds its counts to those it finds."""

    def add(batch: DataFrame, number: int) -> None:
        batch.transform(failures).write.mode("overwrite").parquet(f"{target}/batch={number:08d}")

    return cells.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def failures_so_far(spark, target: str) -> DataFrame:
    """The sums over all batches; a batch that ran again has replaced its own counts."""
    rows = spark.read.option("basePath", target).parquet(f"{target}/batch=*")
    counts = ("pass", "fail", "errored", "missing_gold", "step_limit")
    return rows.groupBy("arm", "model", "category", "pool_size").agg(*(F.sum(c).alias(c) for c in counts))


def with_controls(stream: DataFrame, cells: DataFrame, ordinal: str = "event_id", arms: Sequence[str] = CONTROLS) -> DataFrame:
    """A stream of queued runs with control: the earliest cell stored for their control key, whatever its version; null where
    there is none. The stored cells are a table that is read anew for each batch."""
    stored = cells.where(F.col("arm").isin(*arms)).withColumn("_key", cell_key(None, F.col("pool_size")))
    first = stored.groupBy("_key").agg(F.min_by(F.struct(*cells.columns), F.struct("generated_at", ordinal)).alias("control"))
    return stream.withColumn("_key", cell_key(None, F.col("pool_size"))).join(first, "_key", "left").drop("_key")


def windowed(events: DataFrame, width: str, slide: str | None = None, delay: str | None = None) -> DataFrame:
    """Counts and sums of events by type in tumbling or sliding windows of event time."""
    late = events.withWatermark("ts", delay) if delay else events
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return late.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, delay: str | None = None) -> DataFrame:
    """Sessions of users: events no further apart than the gap."""
    late = events.withWatermark("ts", delay) if delay else events
    return late.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "user_id", "n")
