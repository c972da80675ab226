"""The corpus pipeline: language ID, MinHash near-dedup, benchmark decontamination, BPE encoding and decoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows to the shared folder and
reads them again for the next. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankyard.llm import bpe, decontaminate, language_id, near_dup
from rankyard.llm.common import written

#: Removed ids up to that many are broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 400_000


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those without text or letters, null texts among them, go. Repeated rows stay."""
    train = docs.where(language_id.remainder("doc_id", 3) != 1)
    model = language_id.fit(train.select("text", "lang"))
    return language_id.recognised(docs, model)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: shingles of five words, similarity 0.8.

    Rows without id or words stay. Of rows that share an id, the one of smallest text stays, if any of them is kept.
    """
    found = written(near_dup.near_duplicates(docs, size=5, percent=80), "groups")
    removed = found.where(~F.col("kept")).select("doc_id").distinct()
    rows, ids = found.where("doc_id IS NOT NULL").agg(F.count("*"), F.count_distinct("doc_id")).first()
    if rows > ids:
        removed = removed.join(found.where("kept").select("doc_id"), "doc_id", "left_anti")
    removed = F.broadcast(removed) if removed.count() <= BROADCAST_IDS else removed
    kept = docs.join(removed, "doc_id", "left_anti")
    if rows > ids:
        one = kept.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min_by(F.struct(*(c for c in docs.columns if c != "doc_id")), F.coalesce("text", F.lit(""))).alias("_one"))
        kept = one.select("doc_id", "_one.*").unionByName(kept.where("doc_id IS NULL"))
    return kept.select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a benchmark item; null and empty texts hold none."""
    return decontaminate.without_copies(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the text decoded from them."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identified),
    ("near_dedup", deduplicated),
    ("decontamination", decontaminated),
    ("bpe", encoded),
]

#: No SQL: language ID parses with automata and decontamination aligns.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
