"""Tables between steps: written in the folder that all executors share, and broadcast only where they are small."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of short rows up to that many are broadcast; larger ones are joined by a shuffle.
FEW = 200_000
#: Short rows that a task sorts or groups where the number of tasks follows that of rows.
ROWS = 250_000


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local session that names none (tests) gets a folder of its own, a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_rankyard_folder", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = spark._rankyard_folder = "file://" + tempfile.mkdtemp(prefix="rankyard-")
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df from a table in the shared folder: computed once, whatever reads them and whichever executor is lost."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df, marked for a broadcast if it has FEW rows or less. rows: their number, if it is known; a written table counts fast."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= FEW else df


def tasks(spark: SparkSession, rows: int) -> int:
    """Partitions for that many short rows: a task's memory stays the same, whatever their number."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS))
