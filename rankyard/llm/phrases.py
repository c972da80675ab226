"""Phrase collocations: runs of words that occur together far more often than their parts do.

Texts are lower-cased (A-Z), cut into pieces at punctuation and line ends, and pieces into words. All runs of 1 to
max_words words of a piece are counted by language. A phrase of two words or more that occurs often enough is scored by
its weakest cut into two parts; phrases that mostly occur inside longer ones are dropped.

Most runs are rare, and to shuffle them all as text would take some 20 times the input. So they are counted twice. First
every run is counted by a hash of 20 bits in one of many buckets, in arrays of counters; what several runs share can only
be counted too high. A bitmap of fixed size then says which hashes reach the least count: it is the same for any input,
only less selective the larger that is, and a run that reaches the least count always passes. Then the runs that pass
are counted as texts: by each task, then in groups of a hash, where those below the least count go. What is left are the
rows of all further steps, which are exact. Parts of a counted phrase occur at least as often as it does, so all counts that are needed are there.

Defined results: a null text is empty; a null language is "und", as the text "und" is; a run of more than
BYTES bytes without a piece's end is one piece all the same; repeated rows count each time; no rows give no rows;
columns other than the two that are named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written
from .words import _VALUE, GOLD, mixed, span_hashes, spans

# What ends a piece, and what parts words in it.
ENDS, GAPS = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"
UNKNOWN = "und"
#: Bytes of text that are taken at once.
BYTES = 2 << 20
#: Runs whose hashes are held at once, bits of a hash in its bucket, bytes of text for a bucket, bits of the bitmap.
HELD, LOW, SHARE, FILTER = 3_000_000, 20, 4 << 20, 1 << 28
#: Different runs that a task counts before it hands them on.
KEPT = 800_000

_COLUMNS, _KINDS = ("lang", "words", "phrase", "f"), (pa.string(), pa.int32(), pa.string(), pa.int64())

_END, _WHITE = np.zeros(256, bool), np.zeros(256, bool)
_END[list(ENDS)] = True
_WHITE[list(ENDS + GAPS)] = True
_BYTE = _VALUE.copy()
_BYTE[_WHITE] = 0
_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[ord("A") : ord("Z") + 1] += 32


def _cut(text: bytes, most: int) -> Iterator[bytes]:
    """A text in parts of about that many bytes, cut behind ends of pieces only."""
    ends = np.nonzero(_END[np.frombuffer(text, np.uint8)])[0] + 1
    begin = 0
    while len(text) - begin > most:
        k = int(np.searchsorted(ends, begin + most, side="right"))
        k = max(k - 1, int(np.searchsorted(ends, begin, side="right")))
        if k >= len(ends):
            break
        yield text[begin : ends[k]]
        begin = int(ends[k])
    yield text[begin:]


def blocks(batches, most: int = BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, list[str]]]:
    """Lower-cased bytes of texts, where each begins and the last one ends in them, and their languages, some at a time."""
    held, languages, size = [], [], 0
    for batch in batches:
        for text, lang in zip(batch.column(0), batch.column(1).to_pylist()):
            if not text.is_valid:
                continue
            text = text.as_buffer().to_pybytes()
            for part in _cut(text, most) if len(text) > most else (text,):
                held.append(part)
                languages.append(lang)
                size += len(part)
                if size >= most:
                    yield _joined(held, languages)
                    held, languages, size = [], [], 0
    if held:
        yield _joined(held, languages)


def _joined(held: list[bytes], languages: list[str]):
    offsets = np.zeros(len(held) + 1, np.int64)
    np.cumsum([len(x) for x in held], out=offsets[1:])
    return _SMALL[np.frombuffer(b"".join(held), np.uint8)], offsets, languages


def _seed(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


class Runs:
    """The runs of a block: where its words are, and the hashes of runs of 1, 2, ... words with the word each begins at."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, languages: list[str], max_words: int):
        self.data, self.languages = data, languages
        self.begin, self.size, counts = spans(data, offsets, _WHITE)
        self.row = np.repeat(np.arange(len(counts)), counts)
        names = sorted(set(languages))
        number = {x: k for k, x in enumerate(names)}
        self.lang = np.array([number[x] for x in languages], np.int32)[self.row]
        self.names = names
        word = span_hashes(data, self.begin, self.size, _BYTE)
        self.hashes, self.starts = [], []
        if not len(word):
            return
        piece = np.cumsum(_END[data], dtype=np.int32)[self.begin]
        joined = (piece[1:] == piece[:-1]) & (self.row[1:] == self.row[:-1])
        with np.errstate(over="ignore"):
            run, start = mixed(word ^ np.array([_seed(x) for x in names], np.uint64)[self.lang]), np.arange(len(word))
            for n in range(1, max_words + 1):
                self.hashes.append(run)
                self.starts.append(start)
                more = start[start + n < len(word)]
                go = joined[more + n - 1]
                run, start = run[: len(more)][go], more[go]
                run = mixed(run * GOLD + word[start + n])

    def words(self) -> pa.Array:
        """The words' texts."""
        inside = ~_WHITE[self.data]
        at = np.append(0, np.cumsum(self.size)).astype(np.int32)
        return pa.StringArray.from_buffers(len(self.size), pa.py_buffer(at), pa.py_buffer(self.data[inside]))


def _packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending keys of at most 24 bits and counts of at most 255, as differences by byte planes, which compress well."""
    step = np.diff(keys, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4)
    return pa.compress(np.concatenate([step[:, 0], step[:, 1], step[:, 2], counts.astype(np.uint8)]).tobytes(), "zstd", asbytes=True)


def _unpacked(blob: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(pa.decompress(blob, 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n).astype(np.int64)
    return np.cumsum(planes[0] | planes[1] << 8 | planes[2] << 16), planes[3]


def _shift(buckets: int) -> np.uint64:
    """How far a hash is cut to the number of its bucket and LOW bits more."""
    return np.uint64(64 - LOW - buckets.bit_length() + 1)


def frequent(texts: DataFrame, least: int, max_words: int, buckets: int) -> np.ndarray:
    """A bitmap of FILTER bits: the places of all runs that occur least times or more, and of some others."""
    share, shift = FILTER // buckets, _shift(buckets)

    def count(batches):
        held, size = [], 0

        def packed():
            # In order of buckets and keys; runs that share a key are one.
            found, c = np.unique(np.concatenate(held) >> shift, return_counts=True)
            bucket, key = (found >> np.uint64(LOW)).astype(np.int64), (found & np.uint64((1 << LOW) - 1)).astype(np.int64)
            c = np.minimum(c, 255)
            cut = np.nonzero(np.diff(bucket, prepend=-1))[0].tolist() + [len(bucket)]
            ids = [int(bucket[a]) for a in cut[:-1]]
            blobs = [_packed(key[a:b], c[a:b]) for a, b in zip(cut, cut[1:])]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(np.diff(cut), pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "n", "blob"])

        for block in blocks(batches):
            found = Runs(*block, max_words).hashes
            held += found
            size += sum(map(len, found))
            if size >= HELD:
                yield packed()
                held, size = [], 0
        if size:
            yield packed()

    def add(key, table):
        counts = np.zeros(1 << LOW, np.uint8)
        for n, blob in zip(table["n"].to_pylist(), table["blob"]):
            at, c = _unpacked(blob.as_py(), n)
            counts[at] = np.minimum(counts[at] + c, 255)
        places = np.zeros(share, bool)
        places[np.nonzero(counts >= min(least, 255))[0] % share] = True
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "places": pa.array([np.packbits(places).tobytes()], pa.binary())})

    parts = texts.mapInArrow(count, "bucket int, n int, blob binary").groupBy("bucket").applyInArrow(add, "bucket int, places binary")
    out = np.zeros((buckets, share // 8), np.uint8)
    # FILTER bits in all, whatever the input.
    for r in parts.collect():
        out[r.bucket] = np.frombuffer(r.places, np.uint8)
    return out


def passing(hashes: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    buckets, share = len(bitmap), bitmap.shape[1] * 8
    cut = (hashes >> _shift(buckets)).astype(np.int64)
    place = (cut & ((1 << LOW) - 1)) % share
    byte = bitmap.reshape(-1)[(cut >> LOW) * (share // 8) + (place >> 3)]
    return (byte >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1


class Counted:
    """Counts of runs of some blocks, each with its text once."""

    def __init__(self):
        #: Hashes in order, and the number of each one's row; rows are in order of their first block.
        self.known, self.row = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.f, self.rows = np.zeros(0, np.int64), []
        #: By row, the hash of its first two words: runs that begin alike go together, which compresses them well.
        self.lead: list[np.ndarray] = []
        self.totals: dict[str, int] = {}

    def __len__(self) -> int:
        return len(self.known)

    def add(self, runs: Runs, bitmap: np.ndarray) -> None:
        for name, n in zip(runs.names, np.bincount(runs.lang, minlength=len(runs.names)).tolist()):
            self.totals[name] = self.totals.get(name, 0) + n
        text, names = runs.words(), pa.array(runs.names, pa.string())
        hashes, counts, rows = [], [], []
        for n, (h, starts) in enumerate(zip(runs.hashes, runs.starts), 1):
            some = np.nonzero(passing(h, bitmap))[0]
            found, first, times = np.unique(h[some], return_index=True, return_counts=True)
            at = np.searchsorted(self.known, found)
            old = np.zeros(len(found), bool)
            inside = at < len(self.known)
            old[inside] = self.known[at[inside]] == found[inside]
            self.f[self.row[at[old]]] += times[old]
            new = ~old
            begin = starts[some[first[new]]]
            phrase = text.take(pa.array(begin))
            if n > 1:
                phrase = pc.binary_join_element_wise(*(text.take(pa.array(begin + k)) for k in range(n)), " ")
            hashes.append(found[new])
            self.lead.append(found[new] if n == 1 else runs.hashes[1][np.searchsorted(runs.starts[1], begin)])
            counts.append(times[new])
            rows.append(pa.table([names.take(pa.array(runs.lang[begin])), pa.array(np.full(len(begin), n, np.int32)), phrase], names=_COLUMNS[:3]))
        hashes = np.concatenate(hashes)
        row = np.append(self.row, len(self.f) + np.arange(len(hashes)))
        order = np.argsort(np.append(self.known, hashes), kind="stable")
        self.known, self.row = np.append(self.known, hashes)[order], row[order]
        self.f = np.append(self.f, np.concatenate(counts))
        self.rows += rows

    def batch(self, buckets: int) -> pa.RecordBatch:
        """One row a bucket: its runs in order, which compresses them well."""
        bucket = (np.concatenate(self.lead) >> np.uint64(64 - buckets.bit_length() + 1)).astype(np.int32)
        rows = pa.concat_tables(self.rows).append_column("f", pa.array(self.f)).add_column(0, "bucket", pa.array(bucket))
        totals = pa.table([pa.array([0] * len(self.totals), pa.int32()), *(pa.array(x, t) for x, t in zip((list(self.totals), [0] * len(self.totals), [""] * len(self.totals), list(self.totals.values())), _KINDS))], names=rows.column_names)
        rows = pa.concat_tables([rows, totals])
        rows = rows.take(pc.sort_indices(rows, [(c, "ascending") for c in ("bucket", "lang", "phrase")]))
        at = rows["bucket"].to_numpy()
        begin = np.nonzero(np.diff(at, prepend=-1))[0].tolist()
        blobs = [_stored(rows.slice(a, b - a).drop_columns("bucket")) for a, b in zip(begin, [*begin[1:], len(at)])]
        return pa.RecordBatch.from_arrays([pa.array(at[begin]), pa.array(blobs, pa.binary())], ["bucket", "runs"])


def _stored(rows: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as stream:
        stream.write_table(rows.combine_chunks())
    return out.getvalue().to_pybytes()


def counted(docs: DataFrame, least: int = 30, max_words: int = 4, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, words, phrase, f of every run that occurs least times or more; one row of 0 words with the count of all words."""
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).alias("text"), F.coalesce(F.col(lang_col), F.lit(UNKNOWN)).alias("lang"))
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    buckets = int(min(1 << 16, 1 << max(6, (total // SHARE).bit_length())))
    bitmap = spark.sparkContext.broadcast(frequent(texts, least, max_words, buckets))
    # Runs with their texts compress the better, the more of them are in one part.
    groups = max(16, buckets // 8)

    def explode(batches):
        held = Counted()
        for block in blocks(batches):
            runs = Runs(*block, max_words)
            if runs.hashes:
                held.add(runs, bitmap.value)
            if len(held) > KEPT:
                yield held.batch(groups)
                held = Counted()
        if held.totals:
            yield held.batch(groups)

    def add(key, table):
        rows = pa.concat_tables([pa.ipc.open_stream(x.as_py()).read_all() for x in table["runs"]])
        sums = rows.group_by(list(_COLUMNS[:3]), use_threads=False).aggregate([("f", "sum")])
        sums = sums.select(["lang", "words", "phrase", "f_sum"]).rename_columns(list(_COLUMNS))
        return sums.filter((pc.field("f") >= least) | (pc.field("words") == 0))

    parts = texts.mapInArrow(explode, "bucket int, runs binary")
    return parts.groupBy("bucket").applyInArrow(add, "lang string, words int, phrase string, f bigint")


def scored(counts: DataFrame) -> DataFrame:
    """lang, words, phrase, a, l, r, score of phrases of two words or more, by their weakest cut."""
    phrases = counts.where("words > 1").select("lang", "words", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("_w"))
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    part = lambda begin, n: F.array_join(F.slice("_w", begin, n), " ")
    cuts = cuts.select("lang", "words", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("_left"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("_right"))
    known = counts.where("words > 0")
    left = known.select("lang", F.col("phrase").alias("_left"), F.col("f").alias("l"))
    right = known.select("lang", F.col("phrase").alias("_right"), F.col("f").alias("r"))
    both = cuts.join(left, ["lang", "_left"]).join(right, ["lang", "_right"])
    score = F.expr("CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(20,0)) div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")
    weakest = both.groupBy("lang", "words", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("_c"))
    return weakest.select("lang", "words", "phrase", "a", "_c.l", "_c.r", "_c.score")


def collocations(docs: DataFrame, least: int = 30, max_words: int = 4, contained: int = 80, most: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first phrases of every language.

    A phrase goes if a longer one that holds it has contained percent of its occurrences: one word longer is enough to
    look at, for what a still longer one holds occurs in between at least as often.
    """
    counts = written(counted(docs, least, max_words, text_col, lang_col), "runs")
    phrases = scored(counts)
    longer = counts.where("words > 2").select("lang", F.split("phrase", " ").alias("_w"), "words", F.col("f").alias("longer"))
    inner = F.explode(F.array(F.array_join(F.slice("_w", F.lit(1), F.col("words") - 1), " "), F.array_join(F.slice("_w", F.lit(2), F.col("words") - 1), " ")))
    longest = longer.select("lang", inner.alias("phrase"), "longer").groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    large = lambda c, x: F.col(c).cast("decimal(20,0)") * F.lit(x).cast("decimal(5,0)")
    inside = phrases.join(longest.withColumnsRenamed({"lang": "_lang", "phrase": "_phrase"}), (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_phrase")) & (large("longer", 100) >= large("a", contained)), "left_anti")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    first = inside.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    # One row a language.
    every = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    return first.join(every, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
