"""Token counts by digest cache.

The key of a stored count is the SHA-256 of the normalised content (a null text is the empty text; nothing else
changes, for every other change could change a count) with the SHA-256 that names the tokenizer's version. Contents
whose key is not stored yet are made distinct, encoded once, and appended to the cache; all rows then get their
counts by a join on the digest.

The cache is asked for digests before any text moves. Only the step that makes misses distinct moves texts; a content
that many rows share leaves each task once. The join back moves digests, and a frequent digest on its left side is a skewed join that adaptive execution splits.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows and equal texts get equal counts; columns
other than the two that are named are not read; an empty table gives an empty table and leaves the cache as it is.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import layout, loaded
from .common import Memo, written

#: Digests up to that many are broadcast (32 bytes each, some 20 MB as a hash table); more are joined by a shuffle.
BROADCAST_DIGESTS = 200_000

CACHE = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("version", T.StringType()), T.StructField("n_tokens", T.LongType())])


def version(tokenizer: str) -> str:
    """The digest of everything that decides a count beside the text: file, library and its release, options."""
    import sentencepiece
    import tokenizers

    library = f"tokenizers {tokenizers.__version__}" if tokenizer.endswith(".json") else f"sentencepiece {sentencepiece.__version__}"
    with open(tokenizer, "rb") as f:
        return hashlib.sha256(f.read() + f"|{library}|no special tokens added|whole texts".encode()).hexdigest()


def _counter(tokenizer: str):
    """count(text) as the library gives it."""
    if not tokenizer.endswith(".json"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=tokenizer)
        return lambda text: len(model.encode(text, add_bos=False, add_eos=False))
    model, pieces = loaded(tokenizer), layout(tokenizer)
    count = lambda text: len(model.encode(text, add_special_tokens=False).ids)
    if pieces is None:
        return count
    known = Memo(count)
    return lambda text: sum(map(known.__getitem__, pieces(text)))


_COUNTERS: dict = {}


def worker_counter(tokenizer: str):
    """The counter of this worker process."""
    if tokenizer not in _COUNTERS:
        _COUNTERS[tokenizer] = _counter(tokenizer)
    return _COUNTERS[tokenizer]


def encode_counts(texts: DataFrame, tokenizer: str) -> DataFrame:
    """digest, n_tokens of rows of digest, text."""

    def run(batches):
        count = worker_counter(tokenizer)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([count(x.as_py()) for x in b.column(1)], pa.int64())], ["digest", "n_tokens"])

    return texts.select("digest", "content").mapInArrow(run, "digest binary, n_tokens bigint")


def stored(spark: SparkSession, cache_path: str) -> DataFrame:
    """The cache's rows, none where it does not exist yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache_path)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.read.schema(CACHE).parquet(cache_path)
    return spark.createDataFrame([], CACHE)


def token_counts(docs: DataFrame, tokenizer: str, cache_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every row; misses are appended to the cache."""
    spark = docs.sparkSession
    name = version(tokenizer)
    content = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col), content.alias("content")).select(id_col, "content", F.unhex(F.sha2("content", 256)).alias("digest"))
    # Two writers may have stored the same key; both have the same count.
    known = stored(spark, cache_path).where(F.col("version") == name).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    # Only digests are grouped and joined with the cache; texts of misses alone move, one row for each.
    missing = written(keyed.select("digest").distinct().join(known.select("digest"), "digest", "left_anti"), "missing")
    some = F.broadcast(missing) if missing.count() <= BROADCAST_DIGESTS else missing
    missing = keyed.select("digest", "content").join(some, "digest", "left_semi").groupBy("digest").agg(F.first("content").alias("content"))
    fresh = written(encode_counts(missing, tokenizer), "counts")
    fresh.select("digest", F.lit(name).alias("version"), "n_tokens").write.mode("append").parquet(cache_path)
    counts = known.unionByName(fresh)
    out = keyed.select(id_col, "digest", F.octet_length("content").cast("long").alias("n_bytes")).join(counts, "digest")
    return out.select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
