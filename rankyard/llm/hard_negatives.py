"""Hard-negative mining by a two-dimensional block matrix multiply, after SUMMA (van de Geijn and Watts, 1997).

Anchors and rows are packed into blocks in order of label, and blocks of anchors meet blocks of rows without a shuffle. A
task multiplies its pairs of blocks panel by panel of dimensions, adds the panels' products in place, and keeps of the
scores each anchor's best alone, so that scores are never stored: what leaves a task is a few rows for each anchor,
whatever the number of rows. A first pass finds the anchors' best rows of their own label, which give the positives, in
the pairs whose labels overlap; a second one, for each anchor and positive, the best rows of other labels in the window
below the positive's score, in the pairs that hold different labels. Both are reduced over tasks. The arithmetic is
anchors times rows, as in a search of a stated query set; it takes about one product of all anchors with all rows.

Defined results: rows with a null id, label or vector, or with a null or non-finite component, take no part; rows that
share an id are one row, that of the smallest label, then vector; an anchor meets only vectors of its own length, and
vectors without components score 0; scores that could reach 2 ** 55 are an error; ties go to the smaller id; no rows
give no rows; columns other than the three that are named are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ranges, written

#: Rows of a block, anchors of a block, and components of a block at most.
ROWS, ANCHORS, CELLS = 10_000, 2048, 1 << 20
#: Scores that a task holds at once, and anchors whose best rows it holds.
SCORES, HELD = 1 << 22, 100_000
#: Below every score.
NONE = -(1 << 62)


def whole(vector: Column, scale: float = 256) -> Column:
    """The components as whole numbers floor(scale * x); null for vectors with a null or non-finite component."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(F.coalesce(finite, F.lit(False)), F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def product(a: np.ndarray, b: np.ndarray, width: int = 128, most_chunks: int = 8) -> np.ndarray:
    """Inner products of rows with rows, exact: panels of width dimensions, wider where there would be more than most_chunks,
    are multiplied and added."""
    dim = a.shape[1]
    bound = greatest(a) * greatest(b) * max(dim, 1)
    if bound >= 1 << 55:
        raise OverflowError(f"scores of up to {bound} are too large")
    # Below 2 ** 24 and 2 ** 53 sums of whole numbers are exact in floats and doubles, whose products are the faster ones.
    kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64
    step, total = max(width, -(-dim // most_chunks)), None
    for k in range(0, max(dim, 1), step):
        part = a[:, k : k + step].astype(kind) @ b[:, k : k + step].astype(kind).T
        total = part if total is None else np.add(total, part, out=total)
    return total


def greatest(v: np.ndarray) -> int:
    """The greatest magnitude of a component, 1 at least."""
    return max(-int(v.min()), int(v.max()), 1) if v.size else 1


_BLOCK = "dim int, first bigint, last bigint, size int, ids binary, labels binary, v binary, p binary"
_BLOCKS = pa.schema([("dim", pa.int32()), ("first", pa.int64()), ("last", pa.int64()), ("size", pa.int32()), *((c, pa.binary()) for c in ("ids", "labels", "v", "p"))])


def blocks(rows: DataFrame, most: int, partitions: int) -> DataFrame:
    """Blocks of up to most rows of one length, in order of label and id.

    rows has id, label, v (array of long) and perhaps p (array of long, the scores of an anchor's positives). first and last
    are the block's labels, size the bytes of a component; p has as many numbers for each row as the longest of the block,
    the first one again for those with fewer.
    """

    def pack(batches):
        for batch in batches:
            dims, ids, labels = (batch.column(c).to_numpy() for c in ("dim", "id", "label"))
            values, ends = batch.column("v").flatten().to_numpy(zero_copy_only=False), np.cumsum(dims)
            begin = 0
            while begin < len(dims):
                dim = int(dims[begin])
                end = min(begin + max(1, min(most, CELLS // max(dim, 1))), int(np.searchsorted(dims, dim, "right")))
                v = values[ends[begin] - dim : ends[end - 1]]
                v = v.astype(next(t for t in (np.int16, np.int32, np.int64) if t is np.int64 or greatest(v) <= np.iinfo(t).max))
                p = padded(batch.column("p").slice(begin, end - begin)).tobytes() if "p" in batch.schema.names else None
                some = slice(begin, end)
                row = [dim, labels[begin], labels[end - 1], v.itemsize, ids[some].tobytes(), labels[some].tobytes(), v.tobytes(), p]
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _BLOCKS)], schema=_BLOCKS)
                begin = end

    sized = rows.withColumn("dim", F.size("v"))
    order = ["dim", "label", "id"]
    return sized.repartitionByRange(partitions, *order).sortWithinPartitions(*order).mapInArrow(pack, _BLOCK)


def padded(lists: pa.ListArray) -> np.ndarray:
    """Lists as rows of the longest one's length; shorter ones repeat their first number."""
    values, n = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
    place, begin = np.arange(n.max()), np.cumsum(n) - n
    return values[begin[:, None] + np.where(place < n[:, None], place, 0)]


class Block:
    """A packed block: ids, labels and vectors of its rows, and the scores of their positives, if it has them."""

    def __init__(self, batch: pa.RecordBatch, r: int, prefix: str = ""):
        at = lambda c: batch.column(prefix + c)[r].as_py()
        self.ids, self.labels = np.frombuffer(at("ids"), np.int64), np.frombuffer(at("labels"), np.int64)
        self.v = np.frombuffer(at("v"), f"i{at('size')}").reshape(len(self.ids), at("dim"))
        self.p = None if at("p") is None else np.frombuffer(at("p"), np.int64).reshape(len(self.ids), -1)

    def of_label(self, label: int) -> slice:
        return slice(*np.searchsorted(self.labels, [label, label + 1]))


def pairs(anchors: DataFrame, rows: DataFrame, labels: str = "true") -> DataFrame:
    """Every block of anchors with every block of rows of its length, where a condition on their labels holds."""
    anchors = anchors.select(*(F.col(c).alias(f"a_{c}") for c in anchors.columns))
    # Written so that Spark does not shuffle by length, of which there may be one alone.
    return rows.crossJoin(anchors).where(f"dim <= a_dim AND dim >= a_dim AND ({labels})")


def block_pairs(rows: DataFrame, anchor_block: int, row_block: int) -> tuple[DataFrame, DataFrame]:
    """The blocks of anchors and those of all rows."""
    anchors = rows.where("anchor")
    return blocks(anchors, anchor_block, max(1, math.ceil(anchors.count() / anchor_block))), blocks(rows, row_block, ranges(rows, 8 * F.size("v")))


def score_tiles(rows: DataFrame, anchor_block: int = 256, row_block: int = 4096, width: int = 32, most_chunks: int = 8) -> DataFrame:
    """One row for each pair of blocks, with ids, labels and all scores of its anchors with its rows.

    rows has id, label, v (array of long) and anchor (boolean). These are anchors times rows numbers, for looking at them;
    mine() does not store them.
    """
    names = ("anchors", "anchor_labels", "rows", "row_labels", "scores")

    def score(batches):
        for batch in batches:
            for r in range(len(batch)):
                a, b = Block(batch, r, "a_"), Block(batch, r)
                found = (a.ids, a.labels, b.ids, b.labels, product(a.v, b.v, width, most_chunks).astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in found], names)

    return pairs(*block_pairs(rows, anchor_block, row_block)).mapInArrow(score, ", ".join(f"{c} binary" for c in names))


class Best:
    """The n best rows of each of some anchors so far: scores and ids, (anchors, n), best first and smaller ids first among
    equals."""

    def __init__(self, anchors: int, n: int):
        self.scores, self.ids = np.full((anchors, n), NONE), np.full((anchors, n), np.iinfo(np.int64).max)

    def add(self, a: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Further rows, each with the number of its anchor."""
        last = self.scores[a, -1]
        some = (score > last) | (score == last) & (ids < self.ids[a, -1])
        a, score, ids = a[some], score[some], ids[some]
        if not len(a):
            return
        n, old = self.scores.shape[1], np.unique(a)
        a, score, ids = (np.concatenate(x) for x in ((np.repeat(old, n), a), (self.scores[old].ravel(), score), (self.ids[old].ravel(), ids)))
        order = np.lexsort((ids, -score, a))
        a = a[order]
        rank = np.arange(len(a)) - np.searchsorted(a, a)
        order, a, rank = order[rank < n], a[rank < n], rank[rank < n]
        self.scores[a, rank], self.ids[a, rank] = score[order], ids[order]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of anchors, ids and scores."""
        a, k = np.nonzero(self.scores > NONE)
        return a, self.ids[a, k], self.scores[a, k]


def at_least(scores: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the scores that are not below their row's least."""
    # One dimension is much faster to search than two.
    return np.divmod(np.flatnonzero(scores >= least.astype(scores.dtype)[:, None]), max(scores.shape[1], 1))


def parts(a: Block, b: Block):
    """Slices of anchors that have at most SCORES scores with the rows."""
    step = max(1, SCORES // max(len(b.ids), 1))
    return (slice(k, min(k + step, len(a.ids))) for k in range(0, len(a.ids), step))


def add_same(held: Best, a: Block, b: Block) -> None:
    """Adds the anchors' best rows of their own label."""
    n = held.scores.shape[1]
    for some in parts(a, b):
        for label in np.unique(a.labels[some]):
            mine, rows = a.of_label(label), b.of_label(label)
            mine = slice(max(mine.start, some.start), min(mine.stop, some.stop))
            ids = b.ids[rows]
            if not len(ids):
                continue
            scores = product(a.v[mine], b.v[rows])
            least = held.scores[mine, -1]
            if len(ids) > n + 1:  # the anchor itself may be among them
                least = np.maximum(least, np.partition(scores, len(ids) - n - 1, axis=1)[:, len(ids) - n - 1].astype(np.int64))
            i, j = at_least(scores, least)
            other = ids[j] != a.ids[mine][i]
            i, j = i[other], j[other]
            held.add(i + mine.start, scores[i, j].astype(np.int64), ids[j])


def add_windows(held: list[Best], a: Block, b: Block, low: int, high: int) -> None:
    """Adds the anchors' best rows of other labels in each window: low * positive <= 100 * score <= high * positive."""
    least, most = -(-low * a.p // 100), high * a.p // 100
    for some in parts(a, b):
        scores = product(a.v[some], b.v)
        wanted = np.stack([np.maximum(least[some, w], x.scores[some, -1]) for w, x in enumerate(held)])
        # A window that is empty asks for nothing.
        wanted = np.where((least <= most)[some].T, wanted, 1 << 62).min(0)
        i, j = at_least(scores, wanted)
        score, ids = scores[i, j].astype(np.int64), b.ids[j]
        i = i + some.start
        other = a.labels[i] != b.labels[j]
        i, score, ids = i[other], score[other], ids[other]
        for w, x in enumerate(held):
            inside = (score >= least[i, w]) & (score <= most[i, w])
            x.add(i[inside], score[inside], ids[inside])


def searched(batches, start, add, rows, schema: list[str]):
    """What rows(block of anchors, what is held) gives of each block of anchors when all of a task's pairs were added to what
    start(block) gave; sooner where a task has many anchors."""
    held, anchors = {}, 0

    def give():
        found = [rows(a, best) for a, best in held.values()]
        return [pa.RecordBatch.from_arrays([pa.array(c) for c in x], schema) for x in found]

    for batch in batches:
        for r in range(len(batch)):
            key = (batch.column("a_dim")[r].as_py(), batch.column("a_ids")[r].as_buffer().to_pybytes())
            if key not in held:
                if anchors > HELD:
                    yield from give()
                    held, anchors = {}, 0
                a = Block(batch, r, "a_")
                held[key] = a, start(a)
                anchors += len(a.ids)
            add(held[key][1], held[key][0], Block(batch, r))
    yield from give()


def _ranked(rows: DataFrame, by: list[str], score: str, tie: str, n: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc(score), tie)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def mine(rows: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows has id, label, v (array of long) and anchor (boolean). An anchor's positives are its first rows of its label but
    itself; the negatives of a positive are the first rows of other labels with low * positive <= 100 * negative <= high *
    positive.
    """
    usable = rows.where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    usable = usable.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("v").cast("array<long>").alias("v"), F.coalesce("anchor", F.lit(False)).alias("anchor"))
    one = usable.groupBy("id").agg(F.min(F.struct("label", "v", "anchor")).alias("_r")).select("id", "_r.*")
    one = written(one, "vectors")
    anchor_blocks, row_blocks = (written(x, "blocks") for x in block_pairs(one, ANCHORS, ROWS))

    def same_label(batches):
        def found(a, best):
            k, ids, scores = best.rows()
            return a.ids[k], ids, scores

        return searched(batches, lambda a: Best(len(a.ids), positives), add_same, found, ["anchor_id", "positive_id", "positive_score"])

    same = pairs(anchor_blocks, row_blocks, "first <= a_last AND last >= a_first")
    chosen = same.mapInArrow(same_label, "anchor_id bigint, positive_id bigint, positive_score bigint")
    chosen = written(_ranked(chosen, ["anchor_id"], "positive_score", "positive_id", positives).drop("rank"), "positives")
    scores = chosen.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list("positive_score").alias("p"))
    asked = one.where("anchor").join(scores, "id")
    asked = written(blocks(asked, ANCHORS, max(1, math.ceil(scores.count() / ANCHORS))), "blocks")

    def in_windows(batches):
        def found(a, best):
            # Windows overlap; a row of several goes on once.
            k, ids, scores = (np.concatenate(x) for x in zip(*(x.rows() for x in best)))
            order = np.lexsort((ids, k))
            k, ids, scores = k[order], ids[order], scores[order]
            new = np.ones(len(k), bool)
            new[1:] = (k[1:] != k[:-1]) | (ids[1:] != ids[:-1])
            return a.ids[k[new]], ids[new], scores[new]

        start = lambda a: [Best(len(a.ids), negatives) for _ in range(a.p.shape[1])]
        return searched(batches, start, lambda held, a, b: add_windows(held, a, b, low, high), found, ["anchor_id", "negative_id", "negative_score"])

    apart = pairs(asked, row_blocks, "first < last OR a_first < a_last OR first <> a_first")
    found = apart.mapInArrow(in_windows, "anchor_id bigint, negative_id bigint, negative_score bigint")
    found = found.join(chosen, "anchor_id").where(f"{low} * positive_score <= 100 * negative_score AND 100 * negative_score <= {high} * positive_score")
    ranked = _ranked(found, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
