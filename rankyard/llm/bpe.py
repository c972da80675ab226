"""BPE encoding and decoding.

Encoding puts the symbols of a piece on a doubly linked list and the ranks of adjacent pairs on a priority queue; an
entry whose pair is no longer there is stale and skipped. Decoding concatenates the vocabulary's strings.

Defined results: a null or empty text has no ids and decodes to the empty text; repeated rows give repeated results;
columns other than the two that are named are not read.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import spaced_pieces
from .common import Memo

_POSITION = 40
_WIDTH = 1 << 20
#: A token never goes on from a letter to one of these.
_MARKS = frozenset(".,;:!?")


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBpe:
    """A byte-level BPE tokenizer from its file: encode(text) and decode(ids)."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError(f"{path} is no byte-level BPE without normaliser")
        vocab = spec["model"]["vocab"]
        symbol = byte_symbols()
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.strings = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, k in vocab.items():
            self.strings[k] = bytes(symbol[c] for c in token)
        for token, k in self.special.items():
            self.strings[k] = token.encode()
        self.byte_id = [0] * 256
        for c, b in symbol.items():
            self.byte_id[b] = vocab[c]
        pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in spec["model"]["merges"]]
        rank = {vocab[a] * _WIDTH + vocab[b]: k for k, (a, b) in enumerate(pairs)}
        self.rank, self.merged = rank, [vocab[a + b] for a, b in pairs]
        #: The rank of each pair of bytes, at 256 * first + second.
        self.byte_rank = [rank.get(a * _WIDTH + b) for a in self.byte_id for b in self.byte_id]
        self.words = regex.compile(public_tokenizers.PATTERN).findall
        names = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, names)) + ")").split if names else None
        self.plain = not any(x.isalpha() or _MARKS & set(x) for x in names)
        self.packed = Memo(self._packed, limit=160_000)  # some 60 MB

    def merge(self, data: bytes) -> list[int]:
        """The ids of one piece."""
        ids = [self.byte_id[b] for b in data]
        n = len(ids)
        #: The rank of the pair that begins at each symbol, None where there is none.
        pair = [self.byte_rank[a << 8 | b] for a, b in zip(data, data[1:])]
        queue = [r << _POSITION | i for i, r in enumerate(pair) if r is not None]
        if not queue:
            return ids
        heapify(queue)
        pair.append(None)
        rank_of, merged = self.rank.get, self.merged
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        here = (1 << _POSITION) - 1
        while queue:
            top = heappop(queue)
            i, r = top & here, top >> _POSITION
            if pair[i] != r:
                continue  # stale
            j = after[i]
            ids[i] = new = merged[r]
            ids[j] = -1
            pair[i] = pair[j] = None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                pair[i] = r = rank_of(new * _WIDTH + ids[k])
                if r is not None:
                    heappush(queue, r << _POSITION | i)
            p = before[i]
            if p >= 0:
                pair[p] = r = rank_of(ids[p] * _WIDTH + new)
                if r is not None:
                    heappush(queue, r << _POSITION | p)
        return [x for x in ids if x >= 0]

    def _packed(self, piece: str) -> bytes:
        if self.plain and piece[piece[:1] == " " :].isalpha():
            return array("I", self.merge(piece.encode())).tobytes()
        ids: list[int] = []
        for part in self.cut(piece) if self.cut else [piece]:
            if part in self.special:
                ids.append(self.special[part])
            else:
                for word in self.words(part):
                    ids += self.merge(word.encode())
        return array("I", ids).tobytes()

    def encode_packed(self, text: str) -> bytes:
        """The ids of a text as unsigned 32-bit integers. A mark behind a letter is looked up by itself, so that a word
        is remembered once."""
        known, out = self.packed, []
        for x in spaced_pieces(text):
            if self.plain and x[-1] in _MARKS and x[-2:-1].isalpha():
                out.append(known[x[:-1]])
                x = x[-1]
            out.append(known[x])
        return b"".join(out)

    def decode_packed(self, ids: bytes) -> bytes:
        """The UTF-8 bytes of the text of such ids."""
        return b"".join(map(self.strings.__getitem__, memoryview(ids).cast("I")))

    def encode(self, text: str) -> list[int]:
        return memoryview(self.encode_packed(text)).cast("I").tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


_LOADED: dict[str, ByteBpe] = {}


def worker_bpe(path: str) -> ByteBpe:
    """The tokenizer of this worker process."""
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path)
    return _LOADED[path]


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids array<long>: the token ids of every whole text."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        bpe = worker_bpe(tokenizer)
        for b in batches:
            ids = [bpe.encode(x or "") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int64()))], ["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, ids array<bigint>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, text: the vocabulary's strings of the ids (null: empty), concatenated."""
    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))

    def run(batches):
        bpe = worker_bpe(tokenizer)
        for b in batches:
            texts = [bpe.decode(x or []) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["id", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256: every whole text encoded and its ids decoded, as digests.

    No row leaves its partition: the job is one scan, whatever the number of executors.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        bpe = worker_bpe(tokenizer)
        digest = lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            counts, ids, texts = [], [], []
            for x in b.column(1):
                packed = bpe.encode_packed(x.as_py() or "")
                counts.append(len(packed) // 4)
                ids.append(digest(packed))
                texts.append(digest(bpe.decode_packed(packed)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)
