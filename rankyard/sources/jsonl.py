"""JSON Lines, JSON, CSV, Parquet and zip files as DataFrames with stated schemas."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankyard.operators.compare import flattened

BAD = "_corrupt_record"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path, or a pattern of paths, names any file."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    matches = found.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(found)
    return bool(matches)


def structure(schema: T.StructType | str) -> T.StructType:
    """A schema from itself or its DDL."""
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


#: A row's place in its partition, out of monotonically_increasing_id.
_PLACE = (1 << 33) - 1


def _numbered(rows: DataFrame, within: Sequence[str], order: str | None) -> DataFrame:
    """rows (with file, _id and the columns of within) and number: their places in their files, from 0.

    A task reads a split of a file in order, so a row's place in its split is its place in the partition less that of the
    split's first row; the splits' counts, one row for each, give where each begins in its file.
    """
    place = F.col("_id").bitwiseAND(F.lit(_PLACE))
    splits = rows.groupBy("file", *within).agg(F.count("*").alias("_n"), F.min(place).alias("_first"))
    before = F.sum("_n").over(Window.partitionBy("file").orderBy(order)) - F.col("_n") if order else F.lit(0)
    starts = splits.withColumn("_before", before).drop("_n")
    return rows.join(starts, ["file", *within]).withColumn("number", F.col("_before") + place - F.col("_first")).drop("_first", "_before", "_id")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1), value of all lines of text files, blank ones too; lines are not moved to be numbered."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    return _numbered(rows, ["_block"], "_block").select("file", (F.col("number") + 1).alias("line"), "value")


def parsed_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """file, line, value, record of the lines that are not blank; a bad line's record is null."""
    kept = T.StructType([*structure(schema).fields, T.StructField(BAD, T.StringType())])
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    rows = lines.withColumn("_r", F.from_json("value", kept, {"columnNameOfCorruptRecord": BAD}))
    return rows.select("file", "line", "value", F.when(F.col(f"_r.{BAD}").isNull(), F.struct(*(F.col(f"_r.`{f.name}`").alias(f.name) for f in structure(schema).fields))).alias("record"))


def strict(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Every line a record; blank lines are skipped, a bad line fails the read and is named by its number.

    A first pass looks for a bad line; lines are numbered only once there is one.
    """
    kept = T.StructType([*structure(schema).fields, T.StructField(BAD, T.StringType())])
    record = F.from_json("value", kept, {"columnNameOfCorruptRecord": BAD})
    if not spark.read.text(path).where(F.trim("value") != "").where(record[BAD].isNotNull()).isEmpty():
        bad = parsed_lines(spark, path, schema).where("record IS NULL").select(F.min(F.struct("file", "line", "value")).alias("r")).first().r
        raise ValueError(f"{bad.file}: line {bad.line} is not a record: {bad.value[:200]}")
    return spark.read.schema(structure(schema)).json(path)


def table(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """As strict(), and a missing file is an empty table."""
    return strict(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema)


def lenient(spark: SparkSession, path: str, schema: T.StructType | str, needed: str | None = None) -> DataFrame:
    """Whatever lines are records, and have the needed column; a missing file is an empty table."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows.where(F.col(needed).isNotNull()) if needed else rows


def pruned(spark: SparkSession, path: str, schema: T.StructType | str, columns: Sequence[str]) -> DataFrame:
    """Some columns alone: the others are not parsed."""
    return strict(spark, path, T.StructType([f for f in structure(schema).fields if f.name in columns]))


def retrieval_files(spark: SparkSession, folder: str, schema: T.StructType | str) -> DataFrame:
    """The rows of all files of a folder whose name ends in retrieval.jsonl, with the file's name."""
    rows = spark.read.schema(schema).option("pathGlobFilter", "*retrieval.jsonl").json(folder)
    return rows.withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))


def report_files(spark: SparkSession, path: str, levels: Sequence[str], metrics: str) -> DataFrame:
    """file, levels, metrics, status of nested report files: status "read", "unreadable" or, where there is no file, "missing"."""
    if not exists(spark, path):
        found = spark.createDataFrame([(path, None)], "file string, report string")
        return flattened(found, levels, metrics).withColumn("status", F.lit("missing"))
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("report"))
    return flattened(text, levels, metrics)


def name_map(spark: SparkSession, path: str) -> DataFrame:
    """id, name, description of one JSON object {name: description}."""
    text = spark.read.text(path, wholetext=True)
    entries = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("name", "description"))
    return entries.select(F.col("name").alias("id"), "name", F.trim("description").alias("description"))


def csv_queries(spark: SparkSession, path: str, query: str = "Query", tool: str = "Tool") -> DataFrame:
    """line, query, tool of a CSV file with header; line is the record's number + 2, rows lacking a value are skipped.

    Records may hold line ends, so a file is one split.
    """
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    rows = rows.select(F.col(query).alias("query"), F.col(tool).alias("tool"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("_id"))
    out = _numbered(rows, [], None).select((F.col("number") + 2).alias("line"), F.trim("query").alias("query"), F.trim("tool").alias("tool"))
    return out.where("query <> '' AND tool <> ''")


def json_array(spark: SparkSession, path: str, element: str) -> DataFrame:
    """idx and the fields of every element of a file that is one JSON array; idx starts at 0."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.posexplode(F.from_json("value", f"array<{element}>")).alias("idx", "e")).select("idx", "e.*")


def parquet_strings(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Named columns as text, with file and row_index; a missing column fails."""
    rows = spark.read.parquet(path)
    if missing := [c for c in columns if c not in rows.columns]:
        raise ValueError(f"{path}: no column {', '.join(missing)}")
    place = [F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), F.col("_metadata.row_index").alias("row_index")]
    return rows.select(*(F.col(c).cast("string").alias(c) for c in columns), *place)


def zipped_json(spark: SparkSession, path: str) -> DataFrame:
    """file, member, text of the first .json member of every zip file; a file without one fails."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import zipfile

        for b in batches:
            out = []
            for name, content in zip(b["path"], b["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    member = next((m for m in z.namelist() if m.endswith(".json")), None)
                    if member is None:
                        raise ValueError(f"{name}: no .json member")
                    out.append((name, member, z.read(member).decode("utf-8")))
            yield pd.DataFrame(out, columns=["file", "member", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, member string, text string")
