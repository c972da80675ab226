"""Interpolated modified Kneser-Ney bigram model, counted by Spark and memory-mapped by workers.

Learning takes three jobs: word counts; counts of pairs of neighbours; weights of words. Tasks hash and number words and
add up what a slice of texts holds; Spark's aggregates count words and pairs over all texts. The model is a folder of
sorted arrays. Words are 64-bit hashes in pieces by their leading bits; a word's number is its piece and its place in
it, below 2 ** NUMBER. Pairs lie in buckets by the range of the first word's number; the pairs of a word so frequent that
they would fill a bucket are spread over several by the second word. A bucket's keys are the first word's place in the
range and the second word's number. Workers map the files they need (from a store without a local path they read them),
MAPPED bytes at a time, and look up a slice's distinct words and pairs in order. A bucket that no pair fell into has no
file.

    P(w | h) = max(c(h w) - D(c(h w)), 0) / c(h) + g(h) P1(w)
    P1(w) = max(n(w) - D'(n(w)), 0) / sum of n + g' / (V + 1)

c counts pairs, n(w) the different words before w; D and D' are the three discounts of Chen and Goodman (1999); the
start of a text is a context, its end a token. Where counts are too few to estimate a discount it is half its count.

Defined results: a null or empty text is its end token alone; words that were not learned share the probability of one;
without rows to learn from every token has probability 1 and base probability 1; repeated rows are learned as often as
they occur; columns other than those that are named are not read. Two of n different words share a hash, and are then
one word, with probability of about n * n / 2 ** 65.
"""

from __future__ import annotations

import io
import math
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, written
from .language_id import remainder
from .token_pack import filesystem, published
from .words import hashed, mixed, slices

#: Words in a piece: PIECE at most on average, and hashes are uniform, so that none comes near 2 ** PLACE.
PIECE, PLACE = 400_000, 20
#: Bits of a word's number; with at most PLACE bits of the first word they fill a key.
NUMBER = 44
#: Tokens whose pairs a bucket is meant for; a first word with more than a quarter of it is spread.
BUCKET = 2_000_000
WAYS = 24
#: Bytes of text in a slice, and bytes of arrays that a worker maps at once.
SLICE, MAPPED = 4_000_000, 128 << 20
START = -2
END = np.uint64(0x9AE16A3B2F90404F)  # no word's hash but by chance


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed tokens of a column, one row after another, each row's end token behind it, and how many each row has."""
    found, counts = hashed(texts)
    out = np.full(len(found) + len(counts), END, np.uint64)
    out[np.arange(len(found)) + np.repeat(np.arange(len(counts)), counts)] = found
    return out, counts + 1


def narrow(counts: np.ndarray) -> np.ndarray:
    """Counts in the smallest unsigned type that holds them."""
    return counts.astype(np.min_scalar_type(int(counts.max(initial=0))))


def saved(folder: str, name: str, array: np.ndarray) -> None:
    """Writes an array under its name; of several attempts of a task, which write the same, the first counts."""
    raw = io.BytesIO()
    np.save(raw, array)
    with published(folder, name) as f:
        f.write(raw.getbuffer())


class Mapped(OrderedDict):
    """Arrays by path, mapped into memory; those that were used longest ago go when all take more than MAPPED bytes."""

    held = 0

    def array(self, folder: str, name: str) -> np.ndarray:
        path = f"{folder}/{name}"
        found = self.get(path)
        if found is None:
            found = self[path] = self._opened(path)
            self.held += found.nbytes
            while self.held > MAPPED and len(self) > 1:
                self.held -= self.popitem(last=False)[1].nbytes
        else:
            self.move_to_end(path)
        return found

    @staticmethod
    def _opened(path: str) -> np.ndarray:
        store, local = filesystem(path)
        try:
            if store.type_name == "local":
                return np.load(local, mmap_mode="r")
            with store.open_input_stream(local) as f:
                return np.load(io.BytesIO(f.read()))
        except FileNotFoundError:
            return np.zeros(0, np.uint64)


mapped = Mapped().array


def places(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the ascending wanted values are among the ascending known ones, and where."""
    if not len(known):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return known[at] == wanted, at


def _piece(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


def runs(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """The different ones of ascending values, and where each begins and ends."""
    begin = np.nonzero(np.diff(values, prepend=values[:1] - 1))[0] if len(values) else np.zeros(0, np.int64)
    yield from zip(values[begin].tolist(), begin.tolist(), [*begin[1:].tolist(), len(values)])


@dataclass
class Model:
    folder: str
    bits: int  # of a hash, that name its piece
    shift: int  # bits of a word's number that are its place in its range
    words: int
    total: int
    docs: int = 0
    spread: int = BUCKET // 4  # tokens of a first word for each way that its pairs are spread
    discounts: tuple = (0.0, 0.0, 0.0, 0.0)
    start_weight: float = 1.0
    unknown: float = 1.0

    def numbers(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of hashes in ascending order (-1: not learned) and their counts."""
        number, count = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
        for p, i, j in runs(_piece(h, self.bits)):
            hit, at = places(mapped(self.folder, f"hash-{p}.npy"), h[i:j])
            number[i:j][hit] = (p << PLACE) + at[hit]
            if hit.any():
                count[i:j][hit] = mapped(self.folder, f"count-{p}.npy")[at[hit]]
        return number, count

    def weights(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """g and P1 of numbers in ascending order."""
        g, p1 = np.ones(len(number)), np.full(len(number), self.unknown)
        for p, i, j in runs(number >> PLACE):
            if p >= 0:
                found = mapped(self.folder, f"weight-{p}.npy")[number[i:j] & ((1 << PLACE) - 1)]
                g[i:j], p1[i:j] = found[:, 0], found[:, 1]
        return g, p1

    def placed(self, first: np.ndarray, second: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bucket and key of pairs, from their words' numbers and the first word's count."""
        ways = np.maximum(1, count // self.spread).astype(np.uint64)
        with np.errstate(over="ignore"):
            way = mixed(second.astype(np.uint64)) % ways
        start = first == START
        bucket = np.where(start, 0, (first >> self.shift) + 1) << WAYS | way.astype(np.int64)
        low = np.where(start, 0, first & ((1 << self.shift) - 1)).astype(np.uint64)
        return bucket, low << np.uint64(NUMBER) | second.astype(np.uint64)

    def times(self, bucket: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Counts of pairs."""
        order = np.lexsort([key, bucket])
        out = np.zeros(len(key), np.int64)
        for b, i, j in runs(bucket[order]):
            some = order[i:j]
            hit, at = places(mapped(self.folder, f"pair-{b}.npy"), key[some])
            if hit.any():
                out[some[hit]] = mapped(self.folder, f"times-{b}.npy")[at[hit]]
        return out

    def numbered(self, texts: pa.Array) -> Slice:
        h, sizes = tokens(texts)
        distinct, back = np.unique(h, return_inverse=True)
        number, count = self.numbers(distinct)
        return Slice(sizes, np.cumsum(sizes) - sizes, number, count, back)

    def score(self, texts: pa.Array) -> list[np.ndarray]:
        """Tokens, known tokens, base score and score of each text."""
        s = self.numbered(texts)
        first, second, pair, _ = s.pairs()
        begin, number, back = s.begin, s.number, s.back
        order = np.argsort(number, kind="stable")
        g, p1 = np.empty(len(number)), np.empty(len(number))
        g[order], p1[order] = self.weights(number[order])
        # Of each distinct pair; a first word that is START has the place after all others.
        g, total = np.append(g, self.start_weight), np.append(s.count, self.docs)
        number = np.append(number, START)
        p = p1[second] * g[first]
        both = np.nonzero((number[first] != -1) & (number[second] >= 0))[0]
        a = first[both]
        times = self.times(*self.placed(number[a], number[second[both]], total[a]))
        p[both] += np.maximum(times - np.array(self.discounts)[np.minimum(times, 3)], 0) / np.maximum(total[a], 1)
        base = np.log10((s.count + 1) / (self.total + self.words + 1))[back]
        return [s.sizes, np.add.reduceat((s.count > 0).astype(np.int64)[back], begin), np.add.reduceat(base, begin), np.add.reduceat(np.log10(p)[pair], begin)]


@dataclass
class Slice:
    """The tokens of some texts: their distinct words in ascending order of hash, and which of them each token is."""

    sizes: np.ndarray  # of texts, in tokens
    begin: np.ndarray  # of texts
    number: np.ndarray  # of distinct words
    count: np.ndarray  # of distinct words, where they were learned
    back: np.ndarray  # the distinct word of each token

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First and second word of each distinct pair, as places among the distinct words (START is the place behind
        them); the pair of each token with what is before it; and how often each pair occurs."""
        before = np.empty(len(self.back), np.int64)
        before[1:] = self.back[:-1]
        before[self.begin] = len(self.number)
        key, pair, times = np.unique(before << 32 | self.back, return_inverse=True, return_counts=True)
        return key >> 32, key & 0xFFFFFFFF, pair, times


def discounts(n: list[int]) -> tuple[float, float, float, float]:
    """The discounts of counts 0, 1, 2 and 3 or more, from how many counts are 1, 2, 3 and 4."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    out = [0.0]
    for k, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
        d = k - (k + 1) * y * b / a if a and y else -1.0
        out.append(d if 0 < d <= k else k / 2)
    return tuple(out)


def learn(docs: DataFrame, text_col: str = "text") -> Model:
    """The model of all rows of docs."""
    spark = docs.sparkSession
    folder = scratch(spark, "bigrams")
    store, top = filesystem(folder)
    store.create_dir(top)
    rows = docs.select(F.col(text_col).alias("text"))

    def count_words(batches):
        for b in batches:
            for part in slices(b, 0, SLICE):
                h, c = np.unique(tokens(part.column(0))[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], ["h", "c"])

    words = written(rows.mapInArrow(count_words, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c")), "words")
    size, total = words.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    if not size:
        return Model(folder, 0, 0, 0, 0)
    bits = max(0, math.ceil(math.log2(size / PIECE)))
    shift = min(max(0, int(math.log2(max(1, BUCKET * size // total)))), NUMBER - PLACE, 64 - NUMBER)
    piece = F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long")

    def write_words(key, table):
        h, c = table["h"].to_numpy().view(np.uint64), table["c"].to_numpy()
        order = np.argsort(h)
        saved(folder, f"hash-{key[0].as_py()}.npy", h[order])
        saved(folder, f"count-{key[0].as_py()}.npy", narrow(c[order]))
        return pa.table({"n": [len(h)]})

    words.withColumn("piece", piece).groupBy("piece").applyInArrow(write_words, "n bigint").agg(F.sum("n")).first()
    n_docs = words.where(F.col("h") == int(END.astype(np.int64))).first().c
    model = Model(folder, bits, shift, size, total, n_docs, max(1, BUCKET // 4))

    def count_pairs(batches):
        for b in batches:
            for part in slices(b, 0, SLICE):
                s = model.numbered(part.column(0))
                first, second, _, times = s.pairs()
                number, count = np.append(s.number, START), np.append(s.count, n_docs)
                bucket, key = model.placed(number[first], number[second], count[first])
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(key.view(np.int64)), pa.array(times)], ["bucket", "key", "c"])

    def write_pairs(key, table):
        bucket = key[0].as_py()
        pair, c = table["key"].to_numpy().view(np.uint64), table["c"].to_numpy()
        order = np.argsort(pair)
        pair, c = pair[order], c[order]
        saved(folder, f"pair-{bucket}.npy", pair)
        saved(folder, f"times-{bucket}.npy", narrow(c))
        low, second = pair >> np.uint64(NUMBER), (pair & np.uint64((1 << NUMBER) - 1)).astype(np.int64)
        begin = np.nonzero(np.concatenate([[True], low[1:] != low[:-1]]))[0]
        first = ((bucket >> WAYS) - 1 << shift) + low[begin].astype(np.int64) if bucket >> WAYS else np.full(1, START)
        by_first = [np.add.reduceat(x.astype(np.int64), begin) for x in (c == 1, c == 2, c >= 3)]
        follow, n = np.unique(second, return_counts=True)
        few = np.arange(1, 5)
        kinds = [np.full(len(x), k, np.int8) for k, x in enumerate((begin, follow, few))]
        none = [np.zeros(len(follow) + 4, np.int64)] * 2
        counts = np.array([(c == k).sum() for k in few])
        columns = [np.concatenate(kinds), np.concatenate([first, follow, few]), np.concatenate([by_first[0], n, counts]), np.concatenate([by_first[1], none[0]]), np.concatenate([by_first[2], none[1]])]
        return pa.table(dict(zip(("kind", "number", "n1", "n2", "n3"), map(pa.array, columns))))

    # One shuffle: the pairs of a bucket meet, Spark counts them there and a task writes them.
    pairs = rows.mapInArrow(count_pairs, "bucket bigint, key bigint, c bigint").repartition("bucket").groupBy("bucket", "key").agg(F.sum("c").alias("c"))
    shares = pairs.groupBy("bucket").applyInArrow(write_pairs, "kind tinyint, number bigint, n1 bigint, n2 bigint, n3 bigint")
    shares = written(shares.groupBy("kind", "number").agg(*(F.sum(x).alias(x) for x in ("n1", "n2", "n3"))), "shares")
    d = model.discounts = discounts([r.n1 for r in shares.where("kind = 2").orderBy("number").collect()])
    n = shares.where("kind = 1").agg(*(F.count_if(F.col("n1") == k) for k in (1, 2, 3, 4)), F.count_if(F.col("n1") >= 3), F.sum("n1")).first()
    e = discounts(list(n[:4]))
    spread = (e[1] * n[0] + e[2] * n[1] + e[3] * n[4]) / n[5]
    model.unknown = spread / (size + 1)
    start = shares.where(f"kind = 0 AND number = {START}").first()
    model.start_weight = (d[1] * start.n1 + d[2] * start.n2 + d[3] * start.n3) / n_docs
    unknown, sum_n = model.unknown, n[5]

    def write_weights(key, table):
        p = key[0].as_py()
        count = mapped(folder, f"count-{p}.npy")
        out = np.ones((len(count), 2))
        out[:, 1] = unknown
        kind, place = table["kind"].to_numpy(), table["number"].to_numpy() & ((1 << PLACE) - 1)
        n1, n2, n3 = (table[x].to_numpy() for x in ("n1", "n2", "n3"))
        first, second = kind == 0, kind == 1
        at = place[first]
        out[at, 0] = (d[1] * n1[first] + d[2] * n2[first] + d[3] * n3[first]) / count[at]
        before = n1[second]
        out[place[second], 1] += np.maximum(before - np.array(e)[np.minimum(before, 3)], 0) / sum_n
        saved(folder, f"weight-{p}.npy", out)
        return pa.table({"n": [len(out)]})

    weighed = shares.where(f"kind < 2 AND number != {START}").withColumn("piece", F.shiftright("number", PLACE))
    weighed.groupBy("piece").applyInArrow(write_weights, "n bigint").agg(F.sum("n")).first()
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, n_known, base_score, score of every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        for b in batches:
            for part in slices(b, 1, SLICE):
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, model.score(part.column(1)))], ["id", "n_tokens", "n_known", "base_score", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_tokens bigint, n_known bigint, base_score double, score double").withColumnRenamed("id", id_col)


def learn_and_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of every row under the model of those whose id has not remainder 2 modulo 7."""
    held_out = remainder(id_col, 7) == 2
    model = learn(docs.where(~held_out), text_col)
    marked = docs.select(F.struct(F.col(id_col).alias("id"), held_out.alias("held_out")).alias("key"), F.col(text_col).alias("text"))
    found = score(marked, model, "key")
    return found.select(F.col("key.id").alias(id_col), "key.held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
