"""Token ids as files of single compressed documents.

A folder holds files "tokens-NNNNNN.pack" and the dictionary they share. A file holds the documents of one range of
ids, in order: a header with the SHA-256 of the dictionary; for each document one zstandard frame of its ids as little-
endian unsigned integers of 16 bits (32 where the vocabulary needs them); an index with id, first position, number of
ids, place and length of the frame; and a footer that says where the index is. One document is read with three short
reads: footer, index, frame.

The dictionary is trained on a bounded sample: of about sample_docs rows, chosen by a hash of the id, the first
sample_chars characters. Every document is compressed with it. If the sample is too small to train on, the dictionary is
empty. Files are written to a name of their own attempt and renamed, so a task that runs again replaces its file.

Defined results: ids are integers, others are an error; a null or empty text has only the end id; rows are in ascending order of id, null first, rows with
equal ids next to each other as they were read; an empty table has no file; columns other than the two that are named
are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from contextlib import contextmanager
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import byte_symbols
from .chunks import dropped_pieces, layout, letters_are_words, loaded
from .common import Memo, integer_ids, ranges, scratch, written
from .words import slices

MAGIC = b"TOKPACK1"
HEADER = struct.Struct("<8s32sI")
FOOTER = struct.Struct("<QQQI8s")
INDEX = np.dtype([("id", "<i8"), ("has_id", "u1"), ("start", "<i8"), ("n", "<i8"), ("offset", "<i8"), ("length", "<i8")])
#: Bytes of texts that are encoded at once.
SLICE = 2_000_000
MANIFEST = "part int, file string, docs bigint, ids bigint, bytes bigint"


def filesystem(uri: str):
    """The pyarrow file system of a shared path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


@contextmanager
def published(folder: str, name: str):
    """A stream of bytes that becomes the file name of folder when all is written.

    It is written under a name of the task's attempt and then renamed. Attempts of a task write the same, so where
    another one (run again, or speculative) was first, its file stays and this one goes.
    """
    store, top = filesystem(folder)
    mine, theirs = f"{top}/{name}.{TaskContext.get().taskAttemptId()}", f"{top}/{name}"
    with store.open_output_stream(mine) as f:
        yield f
    there = lambda: store.get_file_info(theirs).type.name != "NotFound"
    if not there():
        try:
            store.move(mine, theirs)
        except OSError:
            if not there():
                raise
    if store.get_file_info(mine).type.name != "NotFound":
        store.delete_file(mine)


#: Latin letters that are not ASCII, as the byte level writes their bytes.
BYTES = {k: "".join(symbol[b] for b in chr(k).encode()) for symbol in [{b: c for c, b in byte_symbols().items()}] for k in range(0x80, 0x100)}


def _listed(values: pa.Array) -> list:
    """The values of an array without nulls as a list, by way of numpy, which is faster than one by one."""
    return values.to_numpy(zero_copy_only=False).tolist()


class Encoder:
    """Token ids of whole string columns.

    For the layout that drops white space a column's different pieces are encoded once, new ones many at a time, and the
    ids of the texts are gathered from theirs. Pieces of any other layout are looked up text by text.
    """

    def __init__(self, tokenizer: str):
        self.model, self.pieces, self.lettered = loaded(tokenizer), layout(tokenizer), letters_are_words(tokenizer)
        self.tokens = self.model.model.tokenize
        self.kind = np.dtype("<u2" if self.model.get_vocab_size() <= 1 << 16 else "<u4")
        self.known = Memo(self._packed, limit=400_000)  # some 200 MB in two generations

    def _packed(self, text: str) -> bytes:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _learn(self, pieces: list[str], most: int = 4096) -> None:
        """Remembers pieces of Latin letters. One of letters alone is one word of the layout, so the model gets it as the
        normaliser and the byte level would hand it on; others are encoded many at a time: a token belongs to the piece
        in which it starts."""
        word = lambda x: self.lettered and x.isalpha() and (x.isascii() or max(x) < "\u0100")
        words, others = [x for x in pieces if word(x)], [x for x in pieces if not word(x)]
        for k in range(0, len(words), most):
            some = words[k : k + most]
            found = [self.tokens(x if x.isascii() else x.translate(BYTES)) for x in map(str.lower, some)]
            self._keep(some, [t.id for f in found for t in f], list(accumulate(map(len, found), initial=0)))
        for k in range(0, len(others), most):
            some = others[k : k + most]
            found = self.model.encode(" ".join(some), add_special_tokens=False)
            begin = list(accumulate((len(x) + 1 for x in some), initial=0))
            at = np.searchsorted(np.fromiter((x for x, _ in found.offsets), np.int64), begin)
            self._keep(some, found.ids, at.tolist())

    def _keep(self, pieces: list[str], ids: list[int], at: list[int]) -> None:
        """Remembers the ids of pieces, those of the k-th from at[k] to at[k + 1]."""
        raw, width = np.array(ids, self.kind).tobytes(), self.kind.itemsize
        for x, i, j in zip(pieces, at, at[1:]):
            self.known.keep(x, raw[i * width : j * width])

    def _pieces(self, pieces: pa.Array) -> list[bytes]:
        """The ids of different pieces. In those that cannot hold an added token, ASCII is lower-cased, as the layout
        does, and a mark behind a letter is encoded by itself, as it is a token's border."""
        free = pc.invert(pc.match_substring(pieces, "<"))
        low = pc.if_else(pc.and_(free, pc.string_is_ascii(pieces)), pc.ascii_lower(pieces), pieces)
        base = pc.if_else(free, pc.replace_substring_regex(low, "([A-Za-zÀ-ÖØ-öø-ÿ])[.,;:!?]$", r"\1"), low)
        coded, known = base.dictionary_encode(), self.known
        distinct = _listed(coded.dictionary)
        self._learn([x for x in distinct if x not in known and x not in known.old and (x.isascii() or max(x) < "\u0180")])
        packed = [known[x] for x in distinct]
        out = [packed[k] for k in _listed(coded.indices)]
        marked = np.nonzero(pc.not_equal(base, low).to_numpy(zero_copy_only=False))[0]
        marks = pc.utf8_slice_codeunits(low.take(pa.array(marked)), -1)
        for k, x in zip(marked.tolist(), _listed(marks)):
            out[k] += known[x]
        return out

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows (null: none), one after another, and where each row begins and the last one ends."""
        texts = pc.fill_null(texts, "")
        if self.pieces is dropped_pieces:
            lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
            coded = lists.flatten().dictionary_encode()
            code, packed = coded.indices.to_numpy(), self._pieces(coded.dictionary)
            bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
        else:
            packed = [b"".join(map(self.known.__getitem__, self.pieces(x))) if self.pieces else self._packed(x) for x in texts.to_pylist()]
            code, bounds = np.arange(len(texts)), np.arange(len(texts) + 1)
        size = np.fromiter(map(len, packed), np.int64, len(packed)) // self.kind.itemsize
        ids = np.frombuffer(b"".join(packed), self.kind)
        own = size[code]
        upto = np.concatenate([[0], np.cumsum(own)])
        shift = (np.cumsum(size) - size)[code] - upto[:-1]
        return ids[np.repeat(shift, own) + np.arange(upto[-1])], upto[bounds]


_ENCODERS: dict[str, Encoder] = {}


def encoder(tokenizer: str) -> Encoder:
    """The encoder of this worker process."""
    if tokenizer not in _ENCODERS:
        _ENCODERS[tokenizer] = Encoder(tokenizer)
    return _ENCODERS[tokenizer]


def documents(batch: pa.RecordBatch, column: int, tokenizer: str, end_id: int | None):
    """The ids of every row of a batch as packed integers, with the end id."""
    encode = encoder(tokenizer)
    end = b"" if end_id is None else np.array([end_id], encode.kind).tobytes()
    for part in slices(batch, column, SLICE):
        ids, at = encode.column(part.column(column))
        raw, at = memoryview(ids).cast("B"), (at * encode.kind.itemsize).tolist()
        for i, j in zip(at, at[1:]):
            yield b"".join((raw[i:j], end))


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int | None, id_col: str, text_col: str, sample_docs: int = 1024, sample_chars: int = 2048, size: int = 32_768) -> bytes:
    """A zstandard dictionary of the serialised ids of the sample; at most 4 * sample_docs rows reach the driver."""
    import zstandard

    total = docs.count()
    some = docs.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(max(1, total // sample_docs))) == 0).select(F.substring(F.coalesce(F.col(text_col), F.lit("")), 1, sample_chars).alias("text")).limit(4 * sample_docs)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(documents(b, 0, tokenizer, end_id), pa.binary())], ["ids"])

    samples = sorted(bytes(r.ids) for r in some.mapInArrow(run, "ids binary").collect())
    try:
        return zstandard.train_dictionary(size, samples, level=3).as_bytes()
    except zstandard.ZstdError:
        return b""


class Compressor:
    """Frames of single documents with a shared dictionary."""

    def __init__(self, dictionary: bytes, level: int = 3):
        import zstandard

        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.pack = zstandard.ZstdCompressor(level=level, dict_data=shared, write_content_size=True).compress
        self.unpack = zstandard.ZstdDecompressor(dict_data=shared).decompress


def write_part(batches, folder: str, tokenizer: str, end_id: int | None, dictionary: bytes):
    """Writes the file of one partition of sorted rows (id, text) and yields its row of the manifest."""
    part = TaskContext.get().partitionId()
    width = encoder(tokenizer).kind.itemsize
    pack = Compressor(dictionary).pack
    first = next(batches, None)
    if first is None:
        return
    name, found, start = f"tokens-{part:06d}.pack", [], 0
    with published(folder, name) as out:
        place = out.write(HEADER.pack(MAGIC, hashlib.sha256(dictionary).digest(), width))
        batches = chain([first], batches)
        del first  # one batch at a time stays in memory
        for b in batches:
            ids = b.column(0).to_pylist()
            index = np.zeros(len(ids), INDEX)
            for k, (key, packed) in enumerate(zip(ids, documents(b, 1, tokenizer, end_id))):
                frame = pack(packed)
                out.write(frame)
                index[k] = (key or 0, key is not None, start, len(packed) // width, place, len(frame))
                place += len(frame)
                start += len(packed) // width
            found.append(index)
        table = np.concatenate(found)
        raw = table.tobytes()
        out.write(raw)
        out.write(FOOTER.pack(place, len(table), start, zlib.crc32(raw), MAGIC))
    row = [part], [name], [len(table)], [start], [place + len(raw) + FOOTER.size]
    kinds = pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()
    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds)], ["part", "file", "docs", "ids", "bytes"])


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files and returns their manifest: part, file, docs, ids, bytes, in order of ids."""
    spark = docs.sparkSession
    dictionary = train_dictionary(docs, tokenizer, end_id, id_col, text_col)
    store, top = filesystem(folder)
    store.create_dir(top)
    with store.open_output_stream(f"{top}/dictionary.zstd") as f:
        f.write(dictionary)
    n = ranges(docs, F.octet_length(F.coalesce(F.col(text_col), F.lit(""))))
    rows = docs.select(integer_ids(docs, id_col).alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("_read"))
    rows = rows.repartitionByRange(n, "id", "_read").sortWithinPartitions("id", "_read").select("id", "text")

    def run(batches):
        return write_part(batches, folder, tokenizer, end_id, dictionary)

    return written(rows.mapInArrow(run, MANIFEST), "manifest")


def _index(f, size: int) -> tuple[np.ndarray, bytes, int]:
    """Index, dictionary digest and width of an open file."""
    f.seek(0)
    magic, digest, width = HEADER.unpack(f.read(HEADER.size))
    f.seek(size - FOOTER.size)
    place, count, _, crc, end = FOOTER.unpack(f.read(FOOTER.size))
    f.seek(place)
    raw = f.read(count * INDEX.itemsize)
    if magic != MAGIC or end != MAGIC or zlib.crc32(raw) != crc:
        raise ValueError("no whole token file")
    return np.frombuffer(raw, INDEX), digest, width


def _dictionary(store, top: str, digest: bytes) -> bytes:
    with store.open_input_stream(f"{top}/dictionary.zstd") as f:
        found = f.read()
    if hashlib.sha256(found).digest() != digest:
        raise ValueError("the dictionary is not the one the file was written with")
    return found


def read_document(folder: str, file: str, doc_id: int) -> list[int]:
    """The ids of one document, without reading others."""
    store, top = filesystem(folder)
    with store.open_input_file(f"{top}/{file}") as f:
        index, digest, width = _index(f, f.size())
        row = index[(index["id"] == doc_id) & (index["has_id"] == 1)][0]
        f.seek(int(row["offset"]))
        raw = Compressor(_dictionary(store, top, digest)).unpack(f.read(int(row["length"])))
    return np.frombuffer(raw, f"<u{width}").tolist()


def read_part(folder: str, file: str, base: int, rows: int = 4096):
    """The documents of one file in order, as batches of id, start, n_tokens, ids_crc32."""
    store, top = filesystem(folder)
    with store.open_input_file(f"{top}/{file}") as f:
        index, digest, width = _index(f, f.size())
        unpack = Compressor(_dictionary(store, top, digest)).unpack
        f.seek(HEADER.size)
        for k in range(0, len(index), rows):
            some = index[k : k + rows]
            frames, at, crc = f.read(int(some["length"].sum())), 0, []
            for row in some:
                ids = np.frombuffer(unpack(frames[at : at + int(row["length"])]), f"<u{width}")
                at += int(row["length"])
                if len(ids) != row["n"]:
                    raise ValueError(f"{file}: a frame has not the ids its index names")
                crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
            keys = pa.array(some["id"].copy(), pa.int64(), mask=some["has_id"] == 0)
            yield pa.RecordBatch.from_arrays([keys, pa.array(some["start"] + base), pa.array(some["n"].copy()), pa.array(crc, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])


def read(manifest: DataFrame, folder: str, id_col: str = "doc_id") -> DataFrame:
    """id, start, n_tokens, ids_crc32 of every document, from the files; start counts the ids of all documents before."""
    # One row per file.
    base = F.sum("ids").over(Window.orderBy("part")) - F.col("ids")
    files = manifest.withColumn("base", F.coalesce(base, F.lit(0)).cast("long")).select("file", "base")
    files = files.repartition(max(1, manifest.count()), "file")

    def run(batches):
        for b in batches:
            for file, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                yield from read_part(folder, file, base)

    return files.mapInArrow(run, "id bigint, start bigint, n_tokens bigint, ids_crc32 bigint").withColumnRenamed("id", id_col)


def write_and_read(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What read() gives of files in a fresh shared folder."""
    folder = scratch(docs.sparkSession, "tokens")
    return read(write(docs, folder, tokenizer, end_id, id_col, text_col), folder, id_col)
