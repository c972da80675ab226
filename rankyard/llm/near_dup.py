"""Near-duplicate documents by min-max hashing.

Each permutation of a document's shingle set gives two values of its signature, the least and the greatest (Ji et al.,
2013): 64 hash evaluations for each shingle fill 125 values, banded as 25 bands of 5. Documents that share a band are
candidates: a pair at the threshold 0.8 shares one with probability 1 - (1 - 0.8 ** 5) ** 25 > 0.9999. Every link is
confirmed on the full sets of hashed shingles.

Equal sets are one class from the start. In a bucket, members are compared with a leader, not with each other; leaders
change for LEADERS rounds, and members whose component is the leader's already are left out. Members still outside the
component of a bucket's first are compared with all of that component and with each other, block by block inside tasks,
so every candidate pair ends in one component or is tested, and pairs are never rows. Buckets are only aggregated and
joined on their key, so a bucket with a third of all rows is a skewed join, not a task.

Defined results: ids are integers, others are an error; a document without words (null or empty text) has an empty set and links with nothing; a row without
id links with nothing, gets no component and is kept; rows with equal ids but different texts are linked each by its own
text, so they can have different components; a document with fewer words than a shingle has the whole sequence as one
shingle; columns other than the two that are named are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import integer_ids, written
from .components import stars
from .words import GOLD, hashed, mixed, slices

PERMUTATIONS, ROWS = 64, 5
LEADERS = 2
BLOCK, BLOCK_SHINGLES = 128, 200_000
#: Candidates up to that many are broadcast (32 bytes each, some 20 MB as a hash table); more are joined by a shuffle.
BROADCAST_IDS = 200_000

SLICE = 500_000  # bytes of text that a worker holds signatures' arrays for


def shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashed shingles of every row of a string column, ascending in each row, and how many each row has."""
    words, n = hashed(texts)
    begin = np.cumsum(n) - n
    many = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    to = np.cumsum(many)
    out = np.empty(int(to[-1]) if len(to) else 0, np.uint64)
    with np.errstate(over="ignore"):
        for span in range(1, size + 1):  # shorter rows are one shingle of all their words
            rows = np.nonzero(n >= size if span == size else n == span)[0]
            own = many[rows]
            place = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
            at = np.repeat(begin[rows], own) + place
            found = np.full(len(at), span, np.uint64)
            for k in range(span):
                found = mixed(found * GOLD + words[at + k])
            out[np.repeat(to[rows] - own, own) + place] = found
    for x, y in zip((to - many).tolist(), to.tolist()):
        out[x:y].sort()
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    keep[(to - many)[many > 0]] = True
    upto = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], upto[to] - upto[to - many]


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(2013)
    a, b = rng.integers(0, 1 << 63, (2, PERMUTATIONS), dtype=np.uint64)
    return a * np.uint64(2) + np.uint64(1), b


def bands(found: np.ndarray, sizes: np.ndarray, block: int = 8192) -> np.ndarray:
    """The band keys of every row, of sets one after another; none of the sizes is 0."""
    a, b = _permutations()
    least, most = np.empty((PERMUTATIONS, len(sizes)), np.uint64), np.empty((PERMUTATIONS, len(sizes)), np.uint64)
    to = np.cumsum(sizes)
    with np.errstate(over="ignore"):
        row = 0
        while row < len(sizes):
            start = int(to[row] - sizes[row])
            end = max(row + 1, int(np.searchsorted(to, start + block, side="right")))
            heads = (to - sizes)[row:end] - start
            low = high = None
            for k in range(start, int(to[end - 1]), block):  # more than once for a long row alone
                values = found[None, k : min(k + block, int(to[end - 1]))] * a[:, None]
                values += b[:, None]
                x, y = np.minimum.reduceat(values, heads, axis=1), np.maximum.reduceat(values, heads, axis=1)
                low, high = (x, y) if low is None else (np.minimum(low, x), np.maximum(high, y))
            least[:, row:end], most[:, row:end] = low, high
            row = end
        values = np.concatenate([least, most])
        values = values[: len(values) // ROWS * ROWS].reshape(-1, ROWS, len(sizes))
        keys = np.repeat(np.arange(1, len(values) + 1, dtype=np.uint64)[:, None], len(sizes), axis=1)
        for k in range(ROWS):
            keys = mixed(keys * GOLD + values[:, k])
    return np.ascontiguousarray(keys.T).view(np.int64)


def _listed(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values.view(np.int64)))


def _digests(found: np.ndarray, sizes: np.ndarray) -> pa.Array:
    to = np.cumsum(sizes)
    return pa.array([hashlib.sha256(found[x:y].tobytes()).digest()[:16] for x, y in zip((to - sizes).tolist(), to.tolist())], pa.binary())


def signatures(rows: DataFrame, size: int) -> DataFrame:
    """id, n, digest, bands of rows (id, text)."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                found, n = shingles(part.column(1), size)
                keys = bands(found, n[n > 0]).reshape(-1)
                listed = _listed(keys, np.where(n > 0, len(keys) // max(1, (n > 0).sum()), 0))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), _digests(found, n), listed], ["id", "n", "digest", "bands"])

    return rows.mapInArrow(run, "id bigint, n bigint, digest binary, bands array<bigint>")


def full_sets(rows: DataFrame, size: int) -> DataFrame:
    """id, n, digest, shingles array<long> of rows (id, text)."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                found, n = shingles(part.column(1), size)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), _digests(found, n), _listed(found, n)], ["id", "n", "digest", "shingles"])

    return rows.mapInArrow(run, "id bigint, n bigint, digest binary, shingles array<bigint>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets have 100 * intersection >= percent * union."""
    left = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("sa", "sb")))
    return both.where(100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")


def labelled(members: DataFrame, found: DataFrame) -> DataFrame:
    """members with the component found so far."""
    return members.join(found.select(F.col("hi").alias("id"), "lo"), "id", "left").withColumn("comp", F.coalesce("lo", "id")).drop("lo")


def linked(table: pa.Table, percent: int) -> pa.Table:
    """One link (a, b) for each two components of the rows of side 0 and side 1 that have any."""
    side, ids, comp = (table[c].to_numpy() for c in ("side", "id", "comp"))
    sets = table["shingles"].combine_chunks()
    values = sets.flatten().to_numpy()
    sizes = np.diff(sets.offsets.to_numpy()).astype(np.int64)
    row = np.empty(len(ids), np.int64)
    rows, found, owners = [], [], []
    for s in (0, 1):
        rows.append(np.nonzero(side == s)[0])
        row[rows[s]] = np.arange(len(rows[s]))
        own = np.repeat(side == s, sizes)
        found.append(values[own])
        owners.append(np.repeat(row, sizes)[own])
    common = np.intersect1d(*found)
    both = np.zeros((len(rows[0]), len(rows[1])), np.float32)
    for k in range(0, len(common), 4096):
        part = common[k : k + 4096]
        marks = []
        for s in (0, 1):
            at = np.minimum(np.searchsorted(part, found[s]), len(part) - 1)
            hit = part[at] == found[s]
            marks.append(np.zeros((len(rows[s]), len(part)), np.float32))
            marks[s][owners[s][hit], at[hit]] = 1
        both += marks[0] @ marks[1].T
    union = sizes[rows[0]][:, None] + sizes[rows[1]][None] - both
    i, j = np.nonzero((100 * both >= percent * union) & (comp[rows[0]][:, None] != comp[rows[1]][None]))
    i, j = rows[0][i], rows[1][j]
    _, one = np.unique(np.stack([comp[i], comp[j]]), axis=1, return_index=True)
    return pa.table({"a": pa.array(ids[i[one]], pa.int64()), "b": pa.array(ids[j[one]], pa.int64())})


def compared(left: DataFrame, right: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between rows (group, id, n, comp) of left and right of a group, one at least for each two components that have any.

    Both sides of a group are cut into blocks of some BLOCK rows or BLOCK_SHINGLES shingles, and every two blocks are
    compared in one task: rows are repeated for each block they meet, pairs are never rows.
    """
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int")
    # Written, so that rows and sizes meet as two plain sides and a large group is split as a skewed join.
    sizes = written(left.groupBy("group").agg(blocks.alias("na")).join(right.groupBy("group").agg(blocks.alias("nb")), "group"), "sizes")
    parts = []
    for side, (rows, own, other) in enumerate(((left, "a", "b"), (right, "b", "a"))):
        placed = rows.join(sizes, "group").withColumn(f"block_{own}", F.pmod(F.xxhash64("id"), F.col(f"n{own}")).cast("int"))
        met = F.explode(F.sequence(F.lit(0), F.col(f"n{other}") - 1)).alias(f"block_{other}")
        parts.append(placed.select("group", "id", "comp", F.lit(side).alias("side"), f"block_{own}", met))
    rows = parts[0].unionByName(parts[1]).join(sets.select("id", "shingles"), "id")

    def run(table):
        return linked(table, percent)

    return rows.groupBy("group", "block_a", "block_b").applyInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id, kept (the id is the component's) of every row."""
    rows = docs.select(integer_ids(docs, id_col).alias("id"), F.col(text_col).alias("text"))
    signed = written(signatures(rows, size), "signatures")
    linkable = signed.where((F.col("n") > 0) & F.col("id").isNotNull())
    # Equal sets are one node, whatever ids they have; its number is fixed once written.
    chosen = linkable.groupBy("digest").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    chosen = written(chosen.withColumn("id", F.monotonically_increasing_id()), "classes")
    classes = chosen.select("digest", "rep", "id")
    buckets = chosen.select("id", "n", F.explode("bands").alias("key"))
    # A leader is the first by id, or by a hash: the same for all buckets of a cluster, so pairs repeat and are few.
    lead = [F.min(F.struct(order, F.col("id"), F.col("n"))).alias(f"l{k}") for k, order in enumerate([F.col("id").alias("o"), *(F.xxhash64("id", F.lit(k)).alias("o") for k in range(1, LEADERS))])]
    shared = buckets.groupBy("key").agg(F.count("*").alias("size"), *lead).where("size > 1").drop("size")
    members = written(buckets.join(shared, "key"), "members")
    wanted = classes.join(members.select("id").distinct(), "id").select(F.col("id").alias("node"), F.col("rep").alias("id"), "digest")
    wanted = written(wanted, "wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    ids = wanted.select("id").distinct()
    sets = full_sets(rows.join(ids, "id", "left_semi"), size).join(wanted, ["id", "digest"])
    sets = written(sets.select(F.col("node").alias("id"), "n", "shingles").dropDuplicates(["id"]), "sets")
    similar = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)  # noqa: E731  necessary for a link
    found = tested = None
    for k in range(LEADERS):
        lead = F.col(f"l{k}")
        near = labelled(members, found) if found is not None else members.withColumn("comp", F.col("id"))
        pairs = near.where((F.col("id") != lead["id"]) & similar(F.col("n"), lead["n"])).select(lead["id"].alias("a"), F.col("id").alias("b"), "comp").distinct()
        if found is not None:
            pairs = labelled(pairs.withColumnRenamed("comp", "own").withColumnRenamed("a", "id"), found).withColumnRenamed("id", "a").where("own != comp").drop("own")
            pairs = pairs.select("a", "b").join(tested, ["a", "b"], "left_anti")
        pairs = written(pairs.select("a", "b"), "pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        links = confirmed(pairs, sets, percent)
        found = stars(links if found is None else links.unionByName(found.select(F.col("hi").alias("a"), F.col("lo").alias("b"))))
    # Buckets that still hold several components: each member outside the first one's against that component and the others.
    near = labelled(members.select("key", "id", "n"), found)
    open_ = near.groupBy("key").agg(F.min("comp").alias("first"), F.max("comp").alias("last")).where("first < last").select("key", "first")
    minor = written(near.join(open_, "key").where("comp <> first"), "apart")
    whole = labelled(members.select("id", "n").distinct(), found).withColumn("group", F.col("comp"))
    several = minor.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("key")
    among = minor.join(several, "key").withColumn("group", F.col("key"))
    columns = ["group", "id", "n", "comp"]
    left = minor.withColumn("group", F.col("first")).select(columns).distinct().unionByName(among.select(columns))
    right = whole.join(minor.select(F.col("first").alias("group")).distinct(), "group", "left_semi").select(columns).unionByName(among.select(columns))
    links = written(compared(left, right, sets, percent), "links")
    found = stars(links.unionByName(found.select(F.col("hi").alias("a"), F.col("lo").alias("b"))))
    named = classes.join(found.select(F.col("hi").alias("id"), "lo"), "id", "left").select("digest", "rep", F.coalesce("lo", "id").alias("node"))
    # The component's name is its smallest document; a component that very many classes share is a skewed join.
    named = written(named, "named")
    labels = named.join(named.groupBy("node").agg(F.min("rep").alias("component")), "node").select("digest", "component")
    labels = written(labels, "labels")  # a digest that very many rows share is a skewed join
    out = signed.select("id", "n", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("digest")).alias("digest")).join(labels, "digest", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
