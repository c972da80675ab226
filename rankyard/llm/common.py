"""What the training-data operators share: the shared folder, written intermediate tables and bounded memos."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegralType, NullType


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver share. One is made where a local session names none (tests); on a cluster,
    where executors would not see it, that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_shared_dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = spark._shared_dir = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, from a table in the shared folder: lineage ends there, and no task runs twice for later readers."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kind_of(rows: DataFrame, col: str) -> DataType:
    """The type of a column."""
    return rows.select(F.col(col)).schema[0].dataType


def integer_ids(rows: DataFrame, id_col: str) -> Column:
    """The ids as longs; a column of another type is an error before anything runs."""
    kind = kind_of(rows, id_col)
    if not isinstance(kind, (IntegralType, NullType)):
        raise TypeError(f"{id_col} must hold integers, not {kind.simpleString()}: number other ids first")
    return F.col(id_col).cast("long")


def ranges(rows: DataFrame, size, most: int = 128 << 20) -> int:
    """Partitions for a layout of rows in ranges: enough that none holds much more than that many bytes, by the column
    of each row's size, and at least the session's number of shuffle partitions."""
    total = rows.agg(F.coalesce(F.sum(size + 16), F.lit(0))).first()[0]
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // most)


class Memo(dict):
    """make(key), remembered for at most 2 * limit keys in two generations.

    A full generation becomes the old one and the old one is dropped, so frequent keys stay. Keys over longest
    characters are never kept, so a memo takes some 30 MB at most. Only speed depends on it.
    """

    def __init__(self, make, limit: int = 80_000, longest: int = 48):
        super().__init__()
        self.make, self.limit, self.longest, self.old = make, limit, longest, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        return self.keep(key, found)

    def keep(self, key, found):
        """The value, remembered as the key's."""
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.old = {}  # before the copy, so that no third generation is held
                self.old = dict(self)
                self.clear()
            self[key] = found
        return found
