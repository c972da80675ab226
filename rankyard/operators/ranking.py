"""Rankers: BM25 over all items or within pools, dense cosine, reciprocal-rank fusion.

All return rows (query id, item id, score, rank), best first, ties by item id; items of score 0 or less are not ranked by
BM25. A retriever is a function (queries, items, k) of tables with id, text and vector; methods are registered by name.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankyard.functions.labels import tokens
from rankyard.operators.registry import Registry
from rankyard.staging import FEW, few, written

K1, B, RRF = 1.2, 0.75, 60
#: Postings of a term up to which one task holds it, and postings of a block.
SEGMENT, BLOCK = 1 << 16, 128
#: Items for each of the k best that are scored for a bound, and the part of the bound that terms for later sum to.
TRIED, PART = 8, 0.7
#: More than the rounding of scores and the order of summing can change.
SLACK = 1e-6
#: The term that marks an item in its postings: tokens are never empty.
MARK = ""


def idf(items: Column, frequency: Column) -> Column:
    """The form of the inverse document frequency that is positive for any frequency."""
    return F.log(1 + (items - frequency + 0.5) / (frequency + 0.5))


def query_terms(queries: DataFrame, id_col: str, text_col: str, unicode: bool = False) -> DataFrame:
    """query_id, term: the different terms of every query."""
    return queries.select(F.col(id_col).alias("query_id"), F.explode(F.array_distinct(tokens(F.col(text_col), unicode))).alias("term"))


def postings(items: DataFrame, terms: DataFrame, id_col: str, text_col: str, unicode: bool = False) -> DataFrame:
    """item_id, length, term, tf of the given terms in every item, from one reading of the texts, and one row of the term
    MARK for every item. Other words leave with the semi-join, before anything is shuffled where the terms are few."""
    wanted = terms.select("term").distinct().unionByName(terms.sparkSession.range(1).select(F.lit(MARK).alias("term")))
    words = items.select(F.col(id_col).alias("item_id"), F.coalesce(tokens(F.col(text_col), unicode), F.array().cast("array<string>")).alias("words"))
    split = words.select("item_id", F.size("words").alias("length"), F.explode(F.concat("words", F.array(F.lit(MARK)))).alias("term"))
    return split.join(wanted, "term", "left_semi").groupBy("item_id", "length", "term").agg(F.count("*").alias("tf"))


def top(scored: DataFrame, k: int, by: Sequence[str] = ("query_id",), digits: int | None = 9) -> DataFrame:
    """The k best rows of each query with their rank; scores are compared as rounded, so summing order cannot matter."""
    score = F.round("score", digits) if digits is not None else F.col("score")
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc("item_id"))
    return scored.withColumn("score", score).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _impact(k1: float, b: float) -> Column:
    """What a term adds to the score of an item."""
    return F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean_length")))


def impacts(found: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """term, item_id, impact, segment, segments, from postings: a term has as many segments as its postings need."""
    # One row.
    totals = found.where(F.col("term") == MARK).agg(F.count("*").alias("items"), (F.sum("length") / F.count("*")).alias("mean_length"))
    hits = found.where(F.col("term") != MARK)
    frequency = written(hits.groupBy("term").agg(F.count("*").alias("df")), "frequency")
    segments = F.ceil(F.col("df") / SEGMENT).cast("int")
    weighed = frequency.crossJoin(F.broadcast(totals)).select("term", idf(F.col("items"), F.col("df")).alias("idf"), "mean_length", segments.alias("segments"))
    out = hits.join(few(weighed, frequency.count()), "term").withColumn("impact", _impact(k1, b))
    return out.select("term", "item_id", "impact", F.pmod(F.xxhash64("item_id"), "segments").cast("int").alias("segment"), "segments")


def impact_blocks(weighed: DataFrame) -> DataFrame:
    """term, segment, segments, block, most, entries: every segment's postings by falling impact, BLOCK in a block, with the
    block's greatest impact."""
    order = Window.partitionBy("term", "segment").orderBy(F.desc("impact"), "item_id")
    blocked = weighed.withColumn("block", F.floor((F.row_number().over(order) - 1) / BLOCK).cast("int"))
    entries = F.collect_list(F.struct("item_id", "impact")).alias("entries")  # BLOCK of them
    return blocked.groupBy("term", "segment", "segments", "block").agg(F.max("impact").alias("most"), entries)


def _sums(asked: DataFrame, weighed: DataFrame) -> DataFrame:
    """query_id, item_id, score: of candidates (query_id, item_id, term), what the terms add to them, by a join on item and term."""
    hits = asked.join(weighed.select("item_id", "term", "impact"), ["item_id", "term"])
    return hits.groupBy("query_id", "item_id").agg(F.sum("impact").alias("score"))


def bounds(terms: DataFrame, blocks: DataFrame, weighed: DataFrame, k: int) -> DataFrame:
    """query_id, bound: a score that the k-th best item of a query reaches; queries with fewer hits have no row.

    It is the k-th best score of some items: those of the largest sums over the first blocks of the query's terms.
    """
    first = terms.join(blocks.where("block = 0").select("term", F.explode("entries").alias("e")), "term")
    partial = first.groupBy("query_id", "e.item_id").agg(F.sum("e.impact").alias("score"))
    some = top(partial, TRIED * k, digits=None).select("query_id", "item_id")
    scored = top(_sums(some.join(terms, "query_id"), weighed), k, digits=None)
    return scored.where(F.col("rank") == k).select("query_id", (F.col("score") - SLACK).alias("bound"))


def scored_items(terms: DataFrame, blocks: DataFrame, weighed: DataFrame, k: int) -> DataFrame:
    """query_id, item_id, score of all items that can be among the k best of a query, and some others (MaxScore; Turtle and
    Flood, 1995).

    A query's terms of small greatest impacts are left for later, as many as sum to PART of its bound at most: an item
    that has no others cannot reach the bound. Of the other terms' blocks count those whose greatest impact, with the
    greatest of all the query's other terms, reaches the bound, and of their items those whose sum does with the greatest
    impacts that are left. Only these are looked up among the terms that were left.
    """
    bound = written(bounds(terms, blocks, weighed, k), "bounds")
    greatest = blocks.where("block = 0").groupBy("term").agg(F.max("most").alias("greatest"), F.first("segments").alias("segments"))
    query, rising = Window.partitionBy("query_id"), Window.partitionBy("query_id").orderBy("greatest", "term")
    known = terms.join(greatest, "term").join(few(bound), "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(0.0)))
    known = known.withColumns({"upto": F.sum("greatest").over(rising), "all": F.sum("greatest").over(query)}).withColumn("later", F.col("upto") < F.col("bound") * PART)
    known = written(known.withColumn("rest", F.coalesce(F.sum(F.when(F.col("later"), F.col("greatest"))).over(query), F.lit(0.0))), "terms")
    essential = known.where("NOT later").withColumn("need", F.col("bound") - (F.col("all") - F.col("greatest")) - SLACK)
    asked = essential.select("query_id", "term", "need", "bound", "rest", F.explode(F.sequence(F.lit(0), F.col("segments") - 1)).alias("segment"))
    found = asked.join(blocks, ["term", "segment"]).where(F.col("most") >= F.col("need"))
    found = found.select("query_id", "need", "bound", "rest", F.explode("entries").alias("e")).where(F.col("e.impact") >= F.col("need"))
    # An item of which a posting fell short of its need cannot reach the bound, so what is summed of it does not matter.
    sums = found.groupBy("query_id", "e.item_id").agg(F.sum("e.impact").alias("score"), F.first("bound").alias("bound"), F.first("rest").alias("rest"))
    sums = written(sums.where(F.col("score") + F.col("rest") + SLACK >= F.col("bound")).select("query_id", "item_id", "score"), "candidates")
    more = _sums(sums.select("query_id", "item_id").join(known.where("later").select("query_id", "term"), "query_id"), weighed)
    return sums.unionByName(more).groupBy("query_id", "item_id").agg(F.sum("score").alias("score"))


def bm25(queries: DataFrame, items: DataFrame, k: int, query_cols=("id", "text"), item_cols=("id", "text"), k1: float = K1, b: float = B, unicode: bool = False) -> DataFrame:
    """The k best of all items for every query: query_id, item_id, score, rank.

    Postings of the queries' terms are written once. Only the candidates that blocks and bounds leave are scored, by a
    join on item and term; a frequent term is spread over segments, so it is in no one task.
    """
    terms = query_terms(queries, *query_cols, unicode)
    found = written(postings(items, terms, *item_cols, unicode), "postings")
    weighed = written(impacts(found, k1, b), "impacts")
    blocks = written(impact_blocks(weighed), "blocks")
    return top(scored_items(written(terms, "asked"), blocks, weighed, k).where("score > 0"), k)


def bm25_in_pools(queries: DataFrame, pools: DataFrame, items: DataFrame, k: int, query_cols=("id", "text"), item_cols=("id", "text"), k1: float = K1, b: float = B) -> DataFrame:
    """The k best items of every pool: query_id, pool_size, item_id, score, rank.

    pools has (query_id, pool_size, item_id). Numbers of items, frequencies and mean lengths are the pool's own. A
    query's item is looked up once, whatever the number of its pools that hold it; texts of items that no pool holds are
    not cut into terms, where the pooled ids are few enough for a broadcast.
    """
    by = ["query_id", "pool_size"]
    terms = query_terms(queries, *query_cols)
    pooled = written(pools.select(F.col("item_id").alias(item_cols[0])).distinct(), "pooled")
    n = pooled.count()
    items = items.join(few(pooled, n), item_cols[0], "left_semi") if n <= FEW else items
    found = written(postings(items, terms, *item_cols), "postings")
    lengths = found.where(F.col("term") == MARK).select("item_id", "length")
    sizes = pools.join(lengths, "item_id", "left").groupBy(*by).agg(F.count("*").alias("items"), F.avg(F.coalesce("length", F.lit(0))).alias("mean_length"))
    members = pools.groupBy("query_id", "item_id").agg(F.collect_set("pool_size").alias("sizes"))  # as many as there are sizes
    hits = members.join(terms, "query_id").join(found, ["item_id", "term"]).select("query_id", F.explode("sizes").alias("pool_size"), "item_id", "term", "tf", "length")
    frequency = hits.groupBy(*by, "term").agg(F.count("*").alias("df"))
    weighed = frequency.join(sizes, by).withColumn("idf", idf(F.col("items"), F.col("df"))).select(*by, "term", "idf", "mean_length")
    scored = hits.join(weighed, [*by, "term"]).groupBy(*by, "item_id").agg(F.sum(_impact(k1, b)).alias("score"))
    return top(scored.where("score > 0"), k, by)


def _directed(vector: Column) -> Column:
    """The vector where it has a direction: null for null and zero vectors and those with null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False)), vector.cast("array<double>"))


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def dense(queries: DataFrame, items: DataFrame, k: int, query_cols=("id", "vector"), item_cols=("id", "vector"), query_rows: int = 512, item_rows: int = 8192) -> DataFrame:
    """The k items of largest cosine for every query, the query itself left out: query_id, item_id, score, rank.

    A stated set of queries against all items: both are dealt into blocks, every pair of blocks is one matrix product, and
    each task keeps the k best of its rows. Vectors that have no direction (null, zero, with null or non-finite
    components) are not ranked and rank nothing; vectors of different length do not meet.
    """
    asked = queries.select(F.col(query_cols[0]).alias("id"), _directed(F.col(query_cols[1])).alias("v")).where("v IS NOT NULL")
    known = items.select(F.col(item_cols[0]).alias("id"), _directed(F.col(item_cols[1])).alias("v")).where("v IS NOT NULL")
    query_id, item_id = asked.schema["id"].dataType, known.schema["id"].dataType
    high, wide = max(1, math.ceil(asked.count() / query_rows)), max(1, math.ceil(known.count() / item_rows))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    left = asked.select(F.size("v").alias("dim"), place(high).alias("i"), every(wide).alias("j"), F.col("id").alias("query_id"), F.lit(None).cast(item_id).alias("item_id"), "v")
    right = known.select(F.size("v").alias("dim"), every(high).alias("i"), place(wide).alias("j"), F.lit(None).cast(query_id).alias("query_id"), F.col("id").alias("item_id"), "v")

    def multiply(key, table):
        asks = np.asarray(table["query_id"].is_valid())
        # Ascending ids, so that the first of equal scores is the smaller one.
        order = np.asarray(pc.sort_indices(table["item_id"]))
        order = order[~asks[order]]
        rows = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(asks), -1)
        q, names, others = np.nonzero(asks)[0], table["query_id"].to_pylist(), table["item_id"].to_pylist()
        out = ([], [], [])
        if len(q) and len(order):
            scores = np.round(_unit(rows[q]) @ _unit(rows[order]).T, 9)
            for r, line in zip(q.tolist(), scores):
                # One more than k, for the query itself may be among them.
                least = np.partition(line, len(line) - k - 1)[len(line) - k - 1] if len(line) > k + 1 else -2.0
                some = np.nonzero(line >= least)[0]
                some = some[np.argsort(-line[some], kind="stable")[: k + 1]]
                best = [(others[order[c]], float(line[c])) for c in some.tolist() if others[order[c]] != names[r]][:k]
                for column, values in zip(out, ([names[r]] * len(best), *zip(*best)) if best else ()):
                    column += values
        return pa.table({"query_id": pa.array(out[0], table.schema.field("query_id").type), "item_id": pa.array(out[1], table.schema.field("item_id").type), "score": pa.array(out[2], pa.float64())})

    kinds = f"query_id {query_id.simpleString()}, item_id {item_id.simpleString()}, score double"
    return top(left.unionByName(right).groupBy("dim", "i", "j").applyInArrow(multiply, kinds), k)


def dense_in_pools(queries: DataFrame, pools: DataFrame, items: DataFrame, k: int, query_cols=("id", "vector"), item_cols=("id", "vector")) -> DataFrame:
    """The k items of largest cosine of every pool: query_id, pool_size, item_id, score, rank; vectors as in dense()."""
    asked = queries.select(F.col(query_cols[0]).alias("query_id"), _directed(F.col(query_cols[1])).alias("q")).where("q IS NOT NULL")
    known = items.select(F.col(item_cols[0]).alias("item_id"), _directed(F.col(item_cols[1])).alias("x")).where("x IS NOT NULL")
    members = pools.groupBy("query_id", "item_id").agg(F.collect_set("pool_size").alias("sizes"))  # as many as there are sizes
    pairs = members.join(asked, "query_id").join(known, "item_id").where(F.size("q") == F.size("x"))

    def run(batches):
        for b in batches:
            if not len(b):
                continue
            size = np.asarray(b["q"].value_lengths())
            begin = np.cumsum(size) - size
            # Divided by their largest components, so that no square is too large or too small.
            q, x = (v / np.repeat(np.maximum.reduceat(np.abs(v), begin), size) for v in (b[c].flatten().to_numpy(zero_copy_only=False) for c in ("q", "x")))
            dot = lambda u, v, at=begin: np.add.reduceat(u * v, at)
            scores = dot(q, x) / np.sqrt(dot(q, q) * dot(x, x))
            yield pa.RecordBatch.from_arrays([b["query_id"], b["sizes"], b["item_id"], pa.array(scores, pa.float64())], ["query_id", "sizes", "item_id", "score"])

    kinds = {c: pairs.schema[c].dataType.simpleString() for c in ("query_id", "sizes", "item_id")}
    scored = pairs.select("query_id", "sizes", "item_id", "q", "x").mapInArrow(run, ", ".join(f"{c} {t}" for c, t in kinds.items()) + ", score double")
    return top(scored.select("query_id", F.explode("sizes").alias("pool_size"), "item_id", "score"), k, ("query_id", "pool_size"))


def fused(rankings: Sequence[DataFrame], k: int, constant: int = RRF, by: Sequence[str] = ("query_id",)) -> DataFrame:
    """Reciprocal-rank fusion of rankings of the same queries: the columns of by, item_id, score, rank."""
    every = rankings[0].select(*by, "item_id", "rank")
    for more in rankings[1:]:
        every = every.unionByName(more.select(*by, "item_id", "rank"))
    return top(every.groupBy(*by, "item_id").agg(F.sum(1.0 / (constant + F.col("rank"))).alias("score")), k, by)


def hybrid_in_pools(queries: DataFrame, pools: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """BM25 and cosine within pools, fused."""
    return fused([bm25_in_pools(queries, pools, items, k), dense_in_pools(queries, pools, items, k)], k, by=("query_id", "pool_size"))


def hybrid(queries: DataFrame, items: DataFrame, k: int, depth: int | None = None) -> DataFrame:
    """BM25 and cosine, fused: of each the depth best count (k by default)."""
    return fused([bm25(queries, items, depth or k), dense(queries, items, depth or k)], k)


Retriever = Callable[[DataFrame, DataFrame, int], DataFrame]
retrievers: Registry[Retriever] = Registry("method")
retrievers.add("bm25", bm25)
retrievers.add("semantic", dense)
retrievers.add("hybrid", hybrid)


def retriever(method: str) -> Retriever:
    """The ranker of a method name: a function (queries, items, k)."""
    return retrievers[method]
