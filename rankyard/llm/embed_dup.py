"""Near-duplicate embeddings by int8 tile products with rigorous error bounds.

Every vector is scaled to length 1 and quantised to int8 with a scale of its own; the length e of what quantisation
lost is kept. For unit vectors x, y with quantised forms u, v the exact cosine differs from u . v by at most
e_x + |u| e_y, for x . y - u . v = (x - u) . y + u . (y - v). Tiles of quantised vectors are multiplied whole (products
and sums of int8 values are exact in float32 up to 1,000 dimensions, in float64 beyond). Pairs that the bound proves to
be at the threshold or above are links, pairs that it proves to be below are none; those that are possibly above are
recomputed from the full vectors in double precision. Only int8 rows are dealt to all tile pairs; full vectors follow
for the rows that have such a pair there.

Equal vectors are one class from the start. A tile pair's task gives sums, a spanning forest of its links and marks of
the rows it leaves open, never pairs, so a group of near copies costs arithmetic and no rows. All pairs of tiles are
multiplied: the work grows with the square of the number of distinct vectors, as comparing everything with everything
does, at one product for each dimension of a pair.

Defined results: ids are integers, others are an error; vectors of any finite magnitude link by their directions; a
vector that is null or zero, or holds null or non-finite components, and a row without id link with nothing; vectors of
different length do not link; repeated rows link with each other; rows of equal ids and different vectors are linked each
by its own vector; columns other than the two that are named are not read.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import integer_ids, written
from .components import stars

#: More than float32 arithmetic on unit vectors can lose.
SLACK = 1e-5


def usable(vector):
    """Whether a vector can link at all."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, scales and lost lengths of rows, as unit vectors."""
    unit = level(x)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    scale = np.abs(unit).max(1) / 127
    q = np.rint(unit / scale[:, None])
    return q.astype(np.int8), scale, np.linalg.norm(unit - q * scale[:, None], axis=1)


def level(x: np.ndarray) -> np.ndarray:
    """Rows divided by powers of two, so that their largest components lie between 1/2 and 1: cosines stay what they are."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of rows with rows in double precision, whatever their magnitudes."""
    x, y = level(x), level(y)
    return np.einsum("ij,ij->i", x, y) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))


def settled(parent: np.ndarray) -> np.ndarray:
    """Every node's root, from every node's parent."""
    while not np.array_equal(parent, parent[parent]):
        parent = parent[parent]
    return parent


class Coded(NamedTuple):
    """Quantised rows: int8 values, scales, lost lengths, lengths of what is kept, and how many vectors each row stands for."""

    q: np.ndarray
    scale: np.ndarray
    lost: np.ndarray
    length: np.ndarray
    weight: np.ndarray

    def at(self, rows: np.ndarray) -> Coded:
        return Coded(*(c[rows] for c in self))


def code(x: np.ndarray, weight: np.ndarray) -> Coded:
    q, scale, lost = quantised(x)
    return Coded(q, scale, lost, np.linalg.norm(q * scale[:, None], axis=1), weight)


def candidates(x: Coded, y: Coded, same: bool, threshold: float, rows: int = 512):
    """Pairs of rows of x and of y (of x, each once, where y is the same) that are possibly at the threshold, some at a time,
    and which of them are so for sure. A pair's bound depends on its two rows alone."""
    kind = np.float32 if x.q.shape[1] <= 1000 else np.float64
    right = y.q.astype(kind).T
    most = float(x.lost.max() * y.length.max() + y.lost.max()) + SLACK
    for k in range(0, len(x.q), rows):
        begin = k if same else 0
        dots = x.q[k : k + rows].astype(kind) @ right[:, begin:]
        dots *= x.scale[k : k + rows, None].astype(kind)
        dots *= y.scale[None, begin:].astype(kind)
        i, j = np.nonzero(dots >= threshold - most)
        above = dots[i, j] - threshold
        i, j = i + k, j + begin
        bound = x.lost[i] * y.length[j] + y.lost[j] + SLACK
        near = (above >= -bound) & (i < j) if same else above >= -bound
        yield i[near], j[near], (above >= bound)[near]


def tile_links(x: Coded, y: Coded, same: bool, threshold: float, full: tuple[np.ndarray, np.ndarray] | None = None):
    """For rows of x, then of y: the weight of what they link with, the row that stands for their component here, and
    whether they have a pair that the bounds leave open.

    Links are the pairs that the bounds prove; with the full vectors of both sides, those of the open pairs that are.
    """
    total = np.zeros(len(x.q) + (0 if same else len(y.q)))
    parent, open_ = np.arange(len(total)), np.zeros(len(total), bool)
    shift = 0 if same else len(x.q)
    for i, j, sure in candidates(x, y, same, threshold):
        open_[i[~sure]] = open_[j[~sure] + shift] = True
        wanted = sure if full is None else ~sure
        i, j = i[wanted], j[wanted]
        for p in range(0, len(i), 100_000):
            a, b = i[p : p + 100_000], j[p : p + 100_000]
            if full is not None:
                hit = cosines(full[0][a], full[1][b]) >= threshold
                a, b = a[hit], b[hit]
            np.add.at(total, a, y.weight[b])
            np.add.at(total, b + shift, x.weight[a])
            while True:
                parent = settled(parent)
                la, lb = parent[a], parent[b + shift]
                apart = la != lb
                if not apart.any():
                    break
                np.minimum.at(parent, np.maximum(la, lb)[apart], np.minimum(la, lb)[apart])
    return total, settled(parent), open_


def quantise(batches):
    """Adds q, scale, lost and length to batches with v and dim."""
    for batch in batches:
        values, dim = batch.column("v").flatten().to_numpy(zero_copy_only=False), batch.column("dim").to_numpy()
        begin = np.cumsum(dim) - dim
        q, numbers = np.empty(len(dim), object), np.empty((3, len(dim)))
        for d in np.unique(dim):
            rows = np.nonzero(dim == d)[0]
            found = code(values[begin[rows][:, None] + np.arange(d)], rows)
            q[rows] = [row.tobytes() for row in found.q]
            numbers[:, rows] = found.scale, found.lost, found.length
        columns = [*batch.columns, pa.array(q, pa.binary()), *(pa.array(c) for c in numbers)]
        yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "q", "scale", "lost", "length"])


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, tile: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, n_links, component_id, kept (the id is the component's) of every row."""
    rows = vectors.select(integer_ids(vectors, id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.withColumn("v", F.when(usable(F.col("v")) & F.col("id").isNotNull(), F.col("v")))
    classes = rows.where(F.col("v").isNotNull()).groupBy("v").agg(F.min("id").alias("least"), F.count("*").alias("weight"))
    # A class has a number of its own, fixed once it is written: rows of different vectors may share an id.
    classes = classes.select("v", "least", "weight", F.size("v").alias("dim"), F.monotonically_increasing_id().alias("rep"))
    classes = written(classes.mapInArrow(quantise, "v array<double>, least bigint, weight bigint, dim int, rep bigint, q binary, scale double, lost double, length double"), "vectors")
    total = classes.count()
    tiles = max(1, math.ceil(total / tile))
    placed = classes.withColumn("mine", F.pmod(F.xxhash64("rep"), F.lit(tiles)).cast("int"))
    coded = ["rep", "weight", "dim", "mine", "q", "scale", "lost", "length"]
    other = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("other")
    dealt = placed.select(*coded, other).select(*coded, F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))

    def run(key, table):
        dim, i, j = (k.as_py() for k in key)
        table = table.sort_by("rep")  # a pair's bound depends on which row comes first
        mine, rep = table["mine"].to_numpy(), table["rep"].to_numpy()
        q = np.frombuffer(b"".join(table["q"].to_pylist()), np.int8).reshape(len(rep), dim)
        rows = Coded(q, *(table[c].to_numpy() for c in ("scale", "lost", "length")), table["weight"].to_numpy().astype(np.float64))
        full = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(rep), dim) if "v" in table.column_names else None
        a = np.nonzero(mine == i)[0]
        b = a if i == j else np.nonzero(mine == j)[0]
        if len(a) and len(b):
            links, label, open_ = tile_links(rows.at(a), rows.at(b), i == j, threshold, None if full is None else (full[a], full[b]))
            ids = rep[a] if i == j else np.concatenate([rep[a], rep[b]])
            some = np.nonzero((links > 0) | open_)[0]
            found = [ids[some], links[some].astype(np.int64), ids[label[some]], open_[some]]
        else:
            found = [np.zeros(0, kind) for kind in (np.int64, np.int64, np.int64, bool)]
        place = [pa.array(np.full(len(found[0]), x, np.int32)) for x in (i, j)]
        return pa.table([*(pa.array(c) for c in found), *place], ["rep", "links", "root", "open", "i", "j"])

    schema = "rep bigint, links bigint, root bigint, open boolean, i int, j int"
    sure = written(dealt.groupBy("dim", "i", "j").applyInArrow(run, schema), "tiles")
    left = sure.where("open").select("rep", "i", "j").join(placed.select(*coded, "v"), "rep")
    exact = written(left.groupBy("dim", "i", "j").applyInArrow(run, schema), "open-tiles")
    found = sure.unionByName(exact).where("links > 0")
    sums = found.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = stars(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    labels = classes.join(sums, "rep", "left").join(joined.withColumnRenamed("hi", "rep"), "rep", "left")
    labels = labels.select("v", "least", F.coalesce("lo", "rep").alias("node"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    # The component's name is its smallest vector.
    names = labels.groupBy("node").agg(F.min("least").alias("component"))
    labels = labels.join(names, "node").select("v", "n_links", "component")
    out = rows.join(labels, "v", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
