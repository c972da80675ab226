"""Words of whole text columns as 64-bit hashes, without a Python object for each word.

A word is a longest run of bytes other than ASCII white space, with A-Z lower-cased; its hash is a polynomial of random
byte values modulo 2 ** 64, mixed with its length. Words of more than LONG bytes are hashed by BLAKE2b. Two of n
different words share a hash with probability of about n * n / 2 ** 65; nothing checks for that.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

LONG = 1 << 14
#: Bytes of words that are hashed at once.
SPAN = 1 << 18

# Odd 64-bit constants of published mixers (golden ratio, MurmurHash3's finaliser).
GOLD, _MIX1, _MIX2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53))

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_VALUE = np.random.default_rng(64).integers(0, 1 << 64, 256, dtype=np.uint64) | np.uint64(1)
_VALUE[ord("A") : ord("Z") + 1] = _VALUE[ord("a") : ord("z") + 1]
_VALUE[_SPACE] = 0


def _powers(x: int) -> np.ndarray:
    out = np.full(SPAN, x, np.uint64)
    out[0] = 1
    return np.cumprod(out)


with np.errstate(over="ignore"):
    _POWER, _INVERSE = _powers(int(GOLD)), _powers(pow(int(GOLD), -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit values with every bit depending on every bit."""
    x = (x ^ (x >> np.uint64(33))) * _MIX1
    x = (x ^ (x >> np.uint64(33))) * _MIX2
    return x ^ (x >> np.uint64(33))


def slices(batch: pa.RecordBatch, column: int, most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about that many bytes of text at most, and of one row at least; none is empty."""
    offsets = text_bytes(batch.column(column))[1]
    begin = 0
    while begin < len(batch):
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + most, side="right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, null as empty, and where each row begins and the last one ends in them."""
    texts = texts.fill_null("") if texts.null_count else texts
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, at, data = texts.buffers()
    if not len(texts) or at is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    found = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return found[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(data: np.ndarray, offsets: np.ndarray, white: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words of rows begin in their bytes and their sizes, and how many each row has. white: by byte, whether it
    parts words."""
    inside = ~white[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1]
    heads = heads[(heads < offsets[1:])]
    first[heads] = inside[heads]
    begin = np.nonzero(first)[0]
    counts = np.diff(np.searchsorted(begin, offsets))
    last = inside
    last[:-1] &= ~inside[1:] | first[1:]
    return begin, np.nonzero(last)[0] + 1 - begin, counts


def hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of a column, one row after another, and how many each row has."""
    data, offsets = text_bytes(texts)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    begin, size, counts = spans(data, offsets)
    return span_hashes(data, begin, size), counts


def span_hashes(data: np.ndarray, begin: np.ndarray, size: np.ndarray, value: np.ndarray = _VALUE) -> np.ndarray:
    """The hashes of words in bytes. value: by byte, its value, 0 for what parts words."""
    out = np.empty(len(begin), np.uint64)
    long = np.nonzero(size > LONG)[0]
    end = begin + np.where(size > LONG, 1, size)
    with np.errstate(over="ignore"):
        at = 0
        while at < len(begin):
            to = max(at + 1, int(np.searchsorted(end, begin[at] + SPAN, side="right")))
            heads = begin[at:to] - begin[at]
            part = value[data[begin[at] : end[to - 1]]]
            part *= _POWER[: len(part)]
            # What parts words counts 0; the inverse power of its place makes a word's hash the same everywhere.
            out[at:to] = mixed(np.add.reduceat(part, heads) * _INVERSE[heads] ^ (size[at:to].astype(np.uint64) * GOLD))
            at = to
    for k in long.tolist():
        word = data[begin[k] : begin[k] + size[k]].tobytes().lower()
        out[k] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    return out
