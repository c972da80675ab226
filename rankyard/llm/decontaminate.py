"""Benchmark decontamination: rare word-pair seeds, then Smith-Waterman alignment.

Words are the pieces between white space, lower-cased, without characters that are neither letters nor digits; every
character of a script that is written without spaces (SCRIPTS) is a word. An item is
aligned with the words of a document that can belong to it: a match counts 2, a mismatch or a gap -1, and the best local
alignment divided by that of the item with itself is the similarity. A passage at the threshold t or above is
contamination; at 0.5, an item with a quarter of its words replaced is found (0.625).

Seeds are pairs of words at a distance of one or two, in the item and in the document. No passage at the threshold is
without them: with m matches and e errors, 2 m - e >= 2 t n for an item of n words, so at least t n - 1 times two
neighbouring matches have one error or none between them, each time from another word of the item. The pairs are counted
in all documents; an item seeds with its rarer ones, all but those of half of t n - 1 words, and a passage counts where
as many seeds as are left lie together. Items of more than 1 / t words are covered by this. Of a shorter one, a single
word of a document would reach the threshold, which says nothing: such items are looked up whole, and a document that
consists of their words and no others is their copy.

Documents never move: both passes are scans, so neither a frequent pair nor a passage in a third of all rows makes a
large task. The benchmark is taken in blocks of at most BLOCK words, each broadcast by itself; a benchmark of any size
is a loop over blocks, and each block's pairs are counted in all documents that were given.

Defined results: null and empty texts, of documents or items, and items without words match nothing. A
row is reported for each document row and item; items with equal ids count as one, with the best similarity; item ids
are integers. Empty tables give no rows. Columns other than those that are named are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memo, written
from .words import slices

#: Distances of two words that make a seed.
REACH = (1, 2)
BLOCK = 1_000_000
#: Scripts without spaces between words.
SCRIPTS = "Han Hiragana Katakana Thai Lao Khmer Myanmar".split()
_UNSPACED = "([" + "".join(rf"\p{{{x}}}" for x in SCRIPTS) + "])"
_HALF = 32
_OTHER, _NONE = -1, -2


def word(piece: str) -> str:
    return piece.lower() if piece.isalnum() else "".join(c for c in piece.lower() if c.isalnum())


def spaced(texts: pa.Array) -> pa.Array:
    """Texts with spaces around the characters of scripts that have none between words."""
    some = pc.invert(pc.string_is_ascii(texts))
    if not pc.any(some).as_py():
        return texts
    return pc.replace_with_mask(texts, some, pc.replace_substring_regex(texts.filter(some), _UNSPACED, r" \1 "))


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """The best local alignment's score and the passage's words from and to which it goes (a half-open range)."""
    n = len(passage)
    steps = np.arange(n + 1)
    score, begin = np.zeros(n + 1, np.int64), steps.copy()
    best = (0, 0, 0)
    for w in item:
        fits = np.where(passage == w, 2, -1)
        straight = np.concatenate([[0], score[:-1] + fits])
        down = score - 1
        found = np.maximum(np.maximum(straight, down), 0)
        origin = np.where(straight >= down, np.concatenate([[0], begin[:-1]]), begin)
        origin = np.where(found > 0, origin, steps)
        # A gap in the item costs 1 a word: the running maximum of score + place.
        lifted = found + steps
        top = np.maximum.accumulate(lifted)
        came = np.maximum.accumulate(np.where(lifted == top, steps, 0))
        score, begin = top - steps, origin[came]
        begin = np.where(score > 0, begin, steps)
        score = np.maximum(score, 0)
        k = int(score.argmax())
        if score[k] > best[0]:
            best = (int(score[k]), int(begin[k]), k)
    return best


class Items:
    """A block of test items, ready to be looked for."""

    def __init__(self, rows: list[tuple], threshold: float):
        self.threshold = threshold
        self.vocabulary: dict[str, int] = {}
        self.ids, self.words = [], []
        #: Ids of items that are looked up whole, by their words.
        self.whole: dict[tuple[int, ...], list] = {}
        for (key, _), text in zip(rows, spaced(pa.array([t or "" for _, t in rows], pa.string())).to_pylist()):
            found = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in map(word, text.split()) if w]
            if len(found) * threshold > 1:
                self.ids.append(key)
                self.words.append(np.array(found, np.int64))
            elif found:
                self.whole.setdefault(tuple(found), []).append(key)
        self.size = np.array([len(x) for x in self.words], np.int64)
        #: Words that a passage at the threshold spans at most, and seeds that it has at least.
        self.span = np.ceil(self.size * (3 - 2 * threshold)).astype(np.int64)
        self.needed = np.ceil(self.size * threshold).astype(np.int64) - 1
        item, at, key = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, x in enumerate(self.words):
            for d in REACH:
                at.append(np.arange(max(0, len(x) - d)))
                item.append(np.full(len(at[-1]), k))
                key.append(x[:-d] << _HALF | x[d:])
        self._order(*map(np.concatenate, (key, item, at)))

    def _order(self, key: np.ndarray, item: np.ndarray, at: np.ndarray) -> None:
        order = np.argsort(key, kind="stable")
        self.key, self.item, self.at = key[order], item[order], at[order]
        self.seeds = np.unique(self.key)

    def keep_rare(self, documents: dict[int, int]) -> None:
        """Leaves the seeds of the rarer words of each item."""
        seen = np.array([documents.get(k, 0) for k in self.key.tolist()], np.int64)
        begin = np.cumsum(self.size) - self.size
        place = begin[self.item] + self.at
        often = np.bincount(place, seen, self.size.sum()) if len(place) else np.zeros(0)
        gone = np.zeros(len(often), bool)
        for k, (b, n) in enumerate(zip(begin.tolist(), self.size.tolist())):
            some = int(self.needed[k]) // 2
            if some:
                gone[b + np.argsort(-often[b : b + n], kind="stable")[:some]] = True
                self.needed[k] -= some
        keep = ~gone[place]
        self._order(self.key[keep], self.item[keep], self.at[keep])

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "known"}

    def _known(self) -> Memo:
        if "known" not in self.__dict__:
            self.known = Memo(lambda piece: self.vocabulary.get(w, _OTHER) if (w := word(piece)) else _NONE)
        return self.known

    def known_words(self, pieces: pa.Array) -> np.ndarray:
        """The numbers of pieces as words. Those of ASCII are looked up together."""
        plain = pc.replace_substring_regex(pc.ascii_lower(pieces), "[^a-z0-9]+", "")
        out = pc.index_in(plain, value_set=pa.array(list(self.vocabulary), pa.string())).fill_null(_OTHER).to_numpy(zero_copy_only=False).astype(np.int64)
        out[pc.equal(plain, "").to_numpy(zero_copy_only=False)] = _NONE
        other = np.nonzero(~pc.string_is_ascii(pieces).to_numpy(zero_copy_only=False))[0]
        known = self._known()
        out[other] = [known[x] for x in pieces.take(pa.array(other)).to_pylist()]
        return out

    def numbered(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word numbers of texts, with a gap of other words behind each; where each text begins; the places where a seed
        does, and which."""
        lists = pc.utf8_split_whitespace(spaced(pc.fill_null(texts, "")))
        coded = lists.flatten().dictionary_encode()
        number = self.known_words(coded.dictionary)[coded.indices.to_numpy()]
        keep = number != _NONE
        text = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())[keep]
        gap = max(REACH)
        size = np.bincount(text, minlength=len(texts)) + gap
        words = np.full(size.sum(), _OTHER, np.int64)
        words[np.arange(len(text)) + gap * text] = number[keep]
        here = np.nonzero(words >= 0)[0]
        places, seeds = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for d in REACH if len(self.seeds) else ():
            some = here[words[here + d] >= 0]
            key = words[some] << _HALF | words[some + d]
            at = np.minimum(np.searchsorted(self.seeds, key), len(self.seeds) - 1)
            hit = self.seeds[at] == key
            places.append(some[hit])
            seeds.append(at[hit])
        return words, np.cumsum(size) - size, np.concatenate(places), np.concatenate(seeds)

    def counted(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Seeds of texts, and in how many texts each is."""
        _, begins, places, seeds = self.numbered(texts)
        doc = np.searchsorted(begins, places, side="right") - 1
        distinct = np.unique(doc * len(self.seeds) + seeds)
        found, n = np.unique(distinct % max(1, len(self.seeds)), return_counts=True)
        return self.seeds[found], n

    def search(self, texts: pa.Array) -> Iterator[tuple[int, int, float, int, int]]:
        """Text, item's id, similarity, first word and word after the last, of every passage at the threshold or above."""
        words, begins, places, seeds = self.numbered(texts)
        if self.whole:
            sizes = np.diff(np.append(begins, len(words))) - max(REACH)
            for d in np.nonzero((sizes > 0) & (sizes <= max(map(len, self.whole))))[0].tolist():
                for key in self.whole.get(tuple(words[begins[d] : begins[d] + sizes[d]].tolist()), ()):
                    yield d, key, 1.0, 0, int(sizes[d])
        if not len(self.seeds):
            return
        key = self.seeds[seeds]
        low, high = np.searchsorted(self.key, key, side="left"), np.searchsorted(self.key, key, side="right")
        many = high - low
        row = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        place = np.repeat(places, many)
        item, at = self.item[row], self.at[row]
        doc = np.searchsorted(begins, place, side="right") - 1
        # Places of an item in a text, apart from those of any other pair by more than a span.
        pair = doc * len(self.ids) + item
        order = np.lexsort([place, pair])
        doc, item, place, at, pair = (x[order] for x in (doc, item, place, at, pair))
        line = np.cumsum(np.append(0, np.diff(pair) != 0))[: len(pair)] * (len(words) + 2 * int(self.span.max(initial=0))) + place
        together = np.searchsorted(line, line + self.span[item]) - np.arange(len(line))
        marked = np.nonzero(together >= self.needed[item])[0]
        if not len(marked):
            return
        new = np.append(True, np.diff(line[marked]) > self.span[item[marked[1:]]])
        starts, ends = marked[new], marked[np.append(np.nonzero(new)[0][1:], len(marked)) - 1]
        limit = np.append(begins[1:], len(words)) - max(REACH)
        for s, e in zip(starts.tolist(), ends.tolist()):
            d, k = int(doc[s]), int(item[s])
            n, span = len(self.words[k]), int(self.span[k])
            last = int(np.searchsorted(line, line[e] + span))
            if len(np.unique(at[s:last])) < self.needed[k]:
                continue
            left, right = max(int(place[s]) - span, int(begins[d])), min(int(place[e]) + span, int(limit[d]))
            for a in range(left, right, 6 * span):  # long runs in windows that overlap by a span
                passage = words[a : min(a + 7 * span, right)]
                if self.shared(k, passage) < self.threshold * n:
                    continue
                score, i, j = align(self.words[k], passage)
                if score >= self.threshold * 2 * n:
                    yield d, self.ids[k], score / (2 * n), a + i - int(begins[d]), a + j - int(begins[d])

    def shared(self, k: int, passage: np.ndarray) -> int:
        """At most that many words of an item can match."""
        return int(np.isin(self.words[k], passage).sum())


def blocks(benchmark: DataFrame, id_col: str, text_col: str, threshold: float) -> Iterator[Items]:
    """The benchmark's items, at most BLOCK words (or one item) at a time."""
    rows, size = [], 0
    for r in benchmark.select(F.col(id_col).cast("long"), F.col(text_col)).where(F.col(text_col).isNotNull()).toLocalIterator():
        count = len(r[1].split())
        if rows and size + count > BLOCK:
            yield Items(rows, threshold)
            rows, size = [], 0
        rows.append((r[0], r[1]))
        size += count
    if rows:
        yield Items(rows, threshold)


def _rare(docs: DataFrame, items: Items, text_col: str) -> None:
    """Counts the items' n-grams in all documents and leaves the rare ones as seeds."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches):
        for b in batches:
            for part in slices(b, 0):
                key, n = shared.value.counted(part.column(0))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "n"])

    counts = docs.select(F.col(text_col)).mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    items.keep_rare({r.key: r.n for r in counts.collect()})  # at most as many as the block has n-grams


def _best(items: Items, texts: pa.Array) -> dict[tuple[int, int], tuple]:
    best: dict[tuple[int, int], tuple] = {}
    for d, k, similarity, a, b in items.search(texts):
        key = (d, k)
        best[key] = max(best.get(key, (0.0,)), (similarity, -a, -b))
    return best


def contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """id, item_id, similarity, first_word, end_word of every document and test item of which it holds a copy."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    fields = [("id", kind), ("item_id", T.LongType()), ("similarity", T.DoubleType()), ("first_word", T.LongType()), ("end_word", T.LongType())]
    schema = T.StructType([T.StructField(*f) for f in fields])
    out = []
    for items in blocks(benchmark, item_col, item_text_col, threshold):
        _rare(docs, items, text_col)
        shared = spark.sparkContext.broadcast(items)

        def run(batches, shared=shared):
            for b in (part for b in batches for part in slices(b, 1)):
                best = _best(shared.value, b.column(1))
                keys = sorted(best, key=lambda k: (k[0], k[1] is not None, k[1] or 0))
                columns = [b.column(0).take(pa.array([d for d, _ in keys], pa.int64())), pa.array([k for _, k in keys], pa.int64())]
                columns += [pa.array([sign * best[k][c] for k in keys], t) for c, sign, t in ((0, 1, pa.float64()), (1, -1, pa.int64()), (2, -1, pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

        found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
        out.append(written(found, "contaminated"))
    every = out[0] if out else spark.createDataFrame([], schema)
    for more in out[1:]:
        every = every.unionByName(more)
    return every.withColumnRenamed("id", id_col)


def without_copies(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs that hold a copy of no test item, with all their columns."""
    at, kept = docs.columns.index(text_col), None
    for items in blocks(benchmark, item_col, item_text_col, threshold):
        _rare(docs, items, text_col)
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches, shared=shared):
            for b in (part for b in batches for part in slices(b, at)):
                bad = {d for d, _ in _best(shared.value, b.column(at))}
                yield b.filter(pa.array([k not in bad for k in range(b.num_rows)], pa.bool_()))

        # What earlier blocks left is written, so that no block's search runs again for a later one.
        kept = (docs if kept is None else written(kept, "kept")).mapInArrow(run, docs.schema)
    return docs if kept is None else kept
