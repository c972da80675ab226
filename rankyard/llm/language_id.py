"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text accepts every substring of that text. A document is parsed
greedily into longest matches; the language that needs the fewest phrases, normalised as phrases * log2(length of the
labelled text) / letters, wins. Texts are lower-cased and every run of other characters than letters counts as one gap.

The automata are fitted on a bounded sample: of each label the docs_per_language distinct texts of smallest hash, fewer
where that many of all labels were more than MOST characters, and of a text longer than chars_per_doc characters four
pieces, evenly spread, that make as many. Every label has one text at least, up to max_labels of them, the most frequent
ones. All letters of the sample are told apart; a letter that is not in it is a phrase of its own.

Prediction reads every whole text. A text is cut into segments of SEGMENT characters, so that all segments of a slice
step through the automata together. A segment is first parsed as if a phrase began there, and then again from the state
in which the segment before it ends, up to the character where both parses are in the same state; so phrases cross the
cuts, and where a text is cut changes nothing. Long texts are taken LONG characters at a time, and languages some at a
time, so that memory beside the texts themselves is bounded.

Defined results: a null text and a text without letters give "und" with score 0; so do all texts where no labelled
text is given. A row whose label is null is never learned from. Ties go to the first label in alphabetical order.
Repeated rows give repeated results; columns other than those that are named are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .words import GOLD, slices

SEGMENT = 512
#: Characters of a text that are parsed at once, states of the parsing that are held at once, characters of the sample.
LONG, HELD, MOST = 1_000_000, 8_000_000, 2_048_000
PIECES = 4
#: Groups of partitions that the sample is first taken from.
GROUPS = 32
UNKNOWN = 1
#: Keys up to that many have a place each (64 MB), which is faster; more are hashed.
ROWS = 1 << 24
DEAD = 0  # the state without transitions: a text's beginning, and behind a letter that no phrase goes on from
_CODES = 0x110000


def remainder(id_col: str, modulus: int):
    """crc32 of the id as text, modulo; the null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def pieces(text, chars: int):
    """A text of at most so many characters whole, of a longer one PIECES pieces, evenly spread."""
    size = chars // PIECES
    begin = lambda k: F.floor((F.length(text) - size) * k / (PIECES - 1)).cast("int") + 1
    return F.when(F.length(text) <= chars, text).otherwise(F.concat_ws(" ", *(text.substr(begin(k), F.lit(size)) for k in range(PIECES))))


def sample(train: DataFrame, docs_per_language: int, chars_per_doc: int, max_labels: int) -> dict[str, list[str]]:
    """Labelled texts by language: pieces of at most docs_per_language of each."""
    labelled = train.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    # At most max_labels rows; the texts of all are bounded by MOST.
    names = [r.lang for r in labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_labels).collect()]
    docs_per_language = max(1, min(docs_per_language, MOST // max(1, len(names) * chars_per_doc)))
    labelled = labelled.where(F.col("lang").isin(names)).select("lang", "text", F.xxhash64("text").alias("h"))
    chosen = labelled.select("lang", "h").distinct().withColumn("some", F.spark_partition_id() % GROUPS)
    for by in (["lang", "some"], ["lang"]):  # the first of each group of partitions, then of all
        order = Window.partitionBy(*by).orderBy("h")
        chosen = chosen.withColumn("k", F.row_number().over(order)).where(F.col("k") <= docs_per_language).drop("k")
    chosen = chosen.select("lang", "h")
    # At most docs_per_language rows for each label.
    rows = labelled.select("lang", "h", pieces(F.col("text"), chars_per_doc).alias("text")).join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text")).collect()
    out: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.h)):
        out.setdefault(r.lang, []).append(r.text)
    return out


def automaton(codes: list[int]) -> list[dict[int, int]]:
    """The transitions of the suffix automaton of a sequence, by state; state 0 is the root."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


class Table:
    """A map of integers in open addressing, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 2).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        slot = self.slot(keys)
        while len(keys):
            free = np.nonzero(self.keys[slot] < 0)[0]
            _, first = np.unique(slot[free], return_index=True)
            own = free[first]
            self.keys[slot[own]], self.values[slot[own]] = keys[own], values[own]
            rest = np.ones(len(keys), bool)
            rest[own] = False
            keys, values, slot = keys[rest], values[rest], slot[rest] + 1 & (1 << self.bits) - 1

    def slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys.astype(np.uint64) * GOLD >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values of keys, -1 where there is none."""
        slot = self.slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], -1)
        rest = np.nonzero((found != keys) & (found >= 0))[0]
        slot = slot[rest]
        while len(rest):
            slot = slot + 1 & (1 << self.bits) - 1
            found = self.keys[slot]
            hit = found == keys[rest]
            out[rest[hit]] = self.values[slot[hit]]
            more = ~hit & (found >= 0)
            rest, slot = rest[more], slot[more]
        return out


class Rows:
    """The same map as an array with a place for every key, for keys below size."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, size: int):
        self.values = np.full(size, -1, np.int32)
        self.values[keys] = values

    def get(self, keys: np.ndarray) -> np.ndarray:
        return self.values.take(keys)


def _parts(text: str, most: int):
    """A text in parts of at most that many characters, behind spaces where there is one: a letter's lower case may depend
    on the letters beside it."""
    begin = 0
    while len(text) - begin > most:
        end = text.rfind(" ", begin, begin + most) + 1
        end = end if end > begin else begin + most
        yield text[begin:end]
        begin = end
    yield text[begin:]


class Model:
    """The automata of all languages as one map from a state and a letter to the next state."""

    def __init__(self, texts: dict[str, list[str]]):
        self.names = sorted(k for k, v in texts.items() if any(c.isalpha() for x in v for c in x))
        joined = {k: " ".join(texts[k]).lower() for k in self.names}
        letters = sorted({c for x in joined.values() for c in x if c.isalpha()})
        self.classes = np.zeros(_CODES, np.int32)
        self.classes[[k for k in range(_CODES) if not 0xD800 <= k < 0xE000 and chr(k).isalpha()]] = UNKNOWN
        self.classes[[ord(c) for c in letters]] = np.arange(len(letters)) + 2
        self.width = len(letters) + 2
        keys, values, self.roots, self.bits, base = [], [], [], [], DEAD + 1
        for name in self.names:
            codes = self.coded(joined[name])
            step = automaton(codes.tolist())
            for k, moves in enumerate(step):
                keys += [(base + k) * self.width + c for c in moves]
                values += [base + s for s in moves.values()]
            self.roots.append(base)
            self.bits.append(math.log2(max(2, len(codes))))
            base += len(step)
        keys, values, size = np.array(keys, np.int64), np.array(values, np.int32), base * self.width
        self.table = Rows(keys, values, size) if size <= ROWS else Table(keys, values)

    def coded(self, text: str) -> np.ndarray:
        """Classes of a lower-case text with runs of gaps made one."""
        found = self.classes[np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")]
        return found[(found > 0) | (np.concatenate([[1], found[:-1]]) > 0)]

    def step(self, state: np.ndarray, code: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after one more letter, and where a phrase begins with it."""
        after = self.table.get(state.astype(np.int64) * self.width + code)
        missed = after < 0
        at = np.nonzero(missed)[0]
        after[at] = np.maximum(self.table.get(root[at].astype(np.int64) * self.width + code[at]), DEAD)
        return after, missed

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases by text and language, letters and characters by text."""
        long = [k for k, x in enumerate(texts) if len(x) > LONG]
        out, letters, size = self._short([x if len(x) <= LONG else "" for x in texts])
        for k in long:
            out[k], letters[k], size[k] = self._long(texts[k])
        return out, letters, size

    def _short(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lowered = [x.lower() for x in texts]
        sizes = np.array([len(x) for x in lowered], np.int64)
        found = self.classes[np.frombuffer("".join(lowered).encode("utf-32-le", "replace"), "<u4")]
        starts = np.cumsum(sizes) - sizes
        before = np.concatenate([[0], found[:-1]]) if len(found) else found
        before[starts[sizes > 0]] = 0
        keep = (found > 0) | (before > 0)
        upto = np.concatenate([[0], np.cumsum(keep)])
        letters = np.concatenate([[0], np.cumsum(found > 0)])
        letters = letters[starts + sizes] - letters[starts]
        begin, size = upto[starts], upto[starts + sizes] - upto[starts]
        codes = found[keep]
        out = np.zeros((len(texts), len(self.names)), np.int64)
        if self.names and len(codes):
            lanes = -(-size // SEGMENT)
            doc = np.repeat(np.arange(len(texts)), lanes)
            nth = np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
            at = begin[doc] + nth * SEGMENT
            left = np.minimum(SEGMENT, size[doc] - nth * SEGMENT)
            count, _ = self._parse(codes, at, left, nth > 0, None)
            np.add.at(out, doc, count.T)
        return out, letters, size

    def _long(self, text: str) -> tuple[np.ndarray, int, int]:
        """The same of one text, some of it at a time: the last states of a part are the first ones of the next."""
        out, letters, size, state, gap = np.zeros(len(self.names), np.int64), 0, 0, None, 0
        for part in _parts(text, LONG):
            found = self.classes[np.frombuffer(part.lower().encode("utf-32-le", "replace"), "<u4")]
            before = np.concatenate([[gap], found[:-1]])
            codes, gap = found[(found > 0) | (before > 0)], found[-1]
            letters, size = letters + int((found > 0).sum()), size + len(codes)
            if self.names and len(codes):
                at = np.arange(0, len(codes), SEGMENT)
                goes_on = np.ones(len(at), bool)
                goes_on[0] = state is not None
                count, state = self._parse(codes, at, np.minimum(SEGMENT, len(codes) - at), goes_on, state)
                out += count.sum(1)
        return out, letters, size

    def _parse(self, codes: np.ndarray, at: np.ndarray, left: np.ndarray, goes_on: np.ndarray, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that begin in each segment, by language, and each language's last state. A segment begins at a place in
        codes and has so many left; those that go on follow the one before them, the first one the states in before."""
        roots = np.array(self.roots, np.int32)
        before = np.full(len(roots), DEAD, np.int32) if before is None else before
        step = max(1, HELD // (len(at) * int(left.max())))
        found = [self._parse_some(roots[k : k + step], codes, at, left, goes_on, before[k : k + step]) for k in range(0, len(roots), step)]
        return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])

    def _parse_some(self, roots: np.ndarray, codes: np.ndarray, at: np.ndarray, left: np.ndarray, goes_on: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, longest = len(at), int(left.max())
        order = np.argsort(-left, kind="stable")
        active = np.searchsorted(-left[order], -np.arange(longest), side="left")
        # Of every step, language and segment (in order of length): the state, and whether a phrase begins.
        states = np.full((longest, len(roots), n), DEAD, np.int32)
        begins = np.zeros((longest, len(roots), n), bool)
        state = np.full((len(roots), n), DEAD, np.int32)
        for t, m in enumerate(active):
            code = np.tile(codes[at[order[:m]] + t], len(roots))
            after, missed = self.step(state[:, :m].ravel(), code, np.repeat(roots, m))
            state = after.reshape(len(roots), m)
            states[t, :, :m], begins[t, :, :m] = state, missed.reshape(len(roots), m)
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        # Again from the state in which the segment before ends, until both parses agree; segments whose last state
        # changes by that make those behind them go on.
        lang, lane = (x.ravel() for x in np.meshgrid(np.arange(len(roots)), np.nonzero(goes_on)[0], indexing="ij"))
        while len(lane):
            earlier = lane - 1
            state = np.where(earlier < 0, before[lang], states[left[earlier] - 1, lang, rank[earlier]])
            changed = []
            t, own, k, s = 0, lang, lane, state
            while len(k):
                s, missed = self.step(s, codes[at[k] + t], roots[own])
                apart = states[t, own, rank[k]] != s
                states[t, own, rank[k]], begins[t, own, rank[k]] = s, missed
                t += 1
                end = apart & (left[k] == t)
                changed.append((own[end], k[end]))
                on = apart & ~end
                own, k, s = own[on], k[on], s[on]
            lang, lane = (np.concatenate(x) for x in zip(*changed))
            behind = lane + 1
            more = (behind < n) & goes_on[np.minimum(behind, n - 1)]
            lang, lane = lang[more], behind[more]
        return begins.sum(0)[:, rank], states[left[-1] - 1, np.arange(len(roots)), rank[-1]]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The winning label of each text, and its share of the languages' inverse entropies."""
        names, scores = [], np.zeros(len(texts))
        counts, letters, size = self.phrases([x or "" for x in texts])
        entropy = counts * np.array(self.bits) / np.maximum(size, 1)[:, None] if self.names else counts
        for k in range(len(texts)):
            if letters[k] and self.names:
                best = int(entropy[k].argmin())
                names.append(self.names[best])
                inverse = 1 / entropy[k]
                scores[k] = inverse[best] / inverse.sum()
            else:
                names.append("und")
        return names, scores


def fit(train: DataFrame, docs_per_language: int = 80, chars_per_doc: int = 400, max_labels: int = 5000) -> Model:
    """The model of labelled rows (text, lang). It takes 64 MB, or some 3 MB for each language with a full sample, up to
    64 times that, whatever the size of train."""
    return Model(sample(train, docs_per_language, chars_per_doc, max_labels))


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score, in place of columns of these names; in no other way changed."""
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("lang_pred", "score")))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            for part in slices(b, at):
                names, scores = shared.value.predict(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*b.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def recognised(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs for which a language is predicted, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            for part in slices(b, at):
                names, _ = shared.value.predict(part.column(at).to_pylist())
                yield part.filter(pa.array([x != "und" for x in names], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id, held_out, lang_pred, score of every row; rows of remainder 1 modulo 3 are held out from learning."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), (remainder(id_col, 3) == 1).alias("held_out"))
    model = fit(rows.where(~F.col("held_out")).select("text", "lang"))
    found = predict(rows.select("_id", "held_out", "text"), model)
    return found.select(F.col("_id").alias(id_col), "held_out", "lang_pred", "score")
