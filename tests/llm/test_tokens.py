"""BPE, token counts, token files: against the libraries, and exact round trips."""

from __future__ import annotations

import functools
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from oracle import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st

from rankyard.llm import bpe, token_cache, token_pack
from rankyard.llm.chunks import dropped_pieces, layout, loaded, spaced_pieces
from rankyard.llm.common import scratch

BYTES, WORDS, PIECES = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
PARTS = st.sampled_from(list(" \n\t\r'.,;:!?a1²é́_-\x1c\x85\xa0　ΩσςΣİß") + ["<|endoftext|>", "<|startoftext|>", " \n", "  ", "'ll", "word", "Ab.", "İ."])
TEXT = st.lists(PARTS, max_size=14).map("".join) | st.text(max_size=20)


library_of = functools.cache(loaded)


@pytest.fixture(scope="module")
def own():
    return bpe.ByteBpe(BYTES)


@settings(max_examples=300, deadline=None)
@given(text=TEXT)
def test_bpe_is_the_librarys(own, text):
    library = library_of(BYTES)
    ids = own.encode(text)
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert own.decode(ids) == library.decode(ids, skip_special_tokens=False) == text


@settings(max_examples=300, deadline=None)
@given(text=TEXT)
def test_pieces_encode_to_the_ids_of_the_whole(text):
    for path, pieces in ((BYTES, spaced_pieces), (WORDS, dropped_pieces)):
        assert layout(path) is pieces
        rows, library = [text, None, "", "one " + text, text], library_of(path)
        ids, at = token_pack.encoder(path).column(pa.array(rows))
        for k, x in enumerate(rows):
            assert ids[at[k] : at[k + 1]].tolist() == library.encode(x or "", add_special_tokens=False).ids
    assert "".join(spaced_pieces(text)) == text


def test_added_tokens_in_capitals_are_text():
    texts = ["<|STARTOFTEXT|> Word, <|startoftext|>", "A<|ENDOFTEXT|>. b!"]
    ids, at = token_pack.encoder(WORDS).column(pa.array(texts))
    assert [ids[at[k] : at[k + 1]].tolist() for k in (0, 1)] == [library_of(WORDS).encode(x, add_special_tokens=False).ids for x in texts]


def test_every_code_point(own):
    library = loaded(BYTES)
    every = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(every), 5000):
        text = " a".join(every[k : k + 5000])
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_decoding_broken_bytes(own):
    assert own.decode(own.encode("é")[:0] + [own.byte_id[0xC3]]) == "�"
    assert own.merge(b"") == [] and own.encode("") == []


def digest(data):
    return hashlib.sha256(data).hexdigest()


def test_round_trip_query(spark, odd, none):
    library = loaded(BYTES)
    got = bpe.round_trip(odd, BYTES).collect()
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    assert len(got) == odd.count() and bpe.round_trip(none, BYTES).count() == 0
    for r in got:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), digest(np.array(ids, "<u4").tobytes()))
        assert r.decoded_sha256 == digest(texts[r.doc_id].encode())
    back = bpe.decode(bpe.encode(odd, BYTES), BYTES)
    assert {r.doc_id: r.text for r in back.collect()} == texts


@pytest.mark.parametrize("path", [BYTES, PIECES])
def test_counts_and_cache(spark, odd, none, path):
    cache = scratch(spark, "cache")
    first = token_cache.token_counts(odd, path, cache, limit=5).collect()
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    count = token_cache._counter(path)
    if path == BYTES:
        library = loaded(path)
        count = lambda x: len(library.encode(x, add_special_tokens=False).ids)
    for r in first:
        n = count(texts[r.doc_id])
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 5)
    stored = spark.read.parquet(cache)
    assert stored.count() == len(set(texts.values())) and {r.version for r in stored.collect()} == {token_cache.version(path)}
    assert sorted(map(str, token_cache.token_counts(odd, path, cache, limit=5).collect())) == sorted(map(str, first))
    assert spark.read.parquet(cache).count() == stored.count()
    assert token_cache.token_counts(none, path, cache).count() == 0


def test_cached_counts_are_believed_for_their_version_only(spark, odd):
    cache = scratch(spark, "cache")
    key = bytes.fromhex(digest(b"one"))
    spark.createDataFrame([(key, token_cache.version(BYTES), 77), (key, "older", 88)], token_cache.CACHE).write.parquet(cache)
    got = token_cache.token_counts(odd.where("text = 'one'"), BYTES, cache).first()
    assert got.n_tokens == 77


def check_pack(rows, got):
    library, start = library_of(WORDS), 0
    assert [r.doc_id for r in got] == [k for k, _ in rows]
    for (_, text), r in zip(rows, got):
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_token_files(spark, odd, none):
    got = token_pack.write_and_read(odd, WORDS, 2).orderBy("start").collect()
    rows = sorted(((r.doc_id, r.text) for r in odd.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    check_pack(rows, got)
    assert token_pack.write_and_read(none, WORDS, 2).count() == 0


def test_one_document_of_a_file(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    folder = scratch(spark, "tokens")
    manifest = token_pack.write(docs, folder, WORDS, 2)
    check_pack(sorted((r.doc_id, r.text) for r in docs.collect()), token_pack.read(manifest, folder).orderBy("start").collect())
    text = docs.where("doc_id = 150").first().text
    wanted = loaded(WORDS).encode(text, add_special_tokens=False).ids + [2]
    files = [r.file for r in manifest.orderBy("part").collect()]
    found = []
    for f in files:
        try:
            found.append(token_pack.read_document(folder, f, 150))
        except IndexError:
            continue
    assert found == [wanted]
    raw = sum(r.ids * 2 for r in manifest.collect())
    assert sum(r.bytes for r in manifest.collect()) < raw


def test_encoder_holds_bounded_pieces_and_slices(monkeypatch):
    """A worker's memory: what an encoder remembers, the bytes of a slice and the generations that rotation holds."""
    import public_tokenizers

    from rankyard.llm import token_pack
    from rankyard.llm.common import Memo

    assert token_pack.Encoder(public_tokenizers.path("word_bpe_49k.json")).known.limit <= 400_000 and token_pack.SLICE <= 2_000_000

    class Seen(Memo):
        held = 0

        def __setattr__(self, name, value):
            if name == "old":
                Seen.held = max(Seen.held, len(self) + len(value) + len(getattr(self, "old", ())))
            super().__setattr__(name, value)

    known = Seen(len, limit=100)
    assert [known[str(k)] for k in range(1000)] == [len(str(k)) for k in range(1000)] and Seen.held <= 2 * 100


def test_letters_go_to_the_model_without_the_normaliser():
    """Pieces of Latin letters get the library's ids from the model alone; its encode is much slower and not called."""
    import numpy as np
    import public_tokenizers
    import pyarrow as pa

    from rankyard.llm import token_pack

    encode = token_pack.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["the Quick brownest FOX", "ÀÉÎõü straße ÿþÐ µ ªº", "", None, "ÇÀ\nva\nva, sur."]
    wanted = [encode.model.encode(x or "", add_special_tokens=False).ids for x in texts]
    library = encode.model

    class Marks:
        """Encodes what is no letters, as before."""

        def encode(self, text, **options):
            assert not any(x.isalpha() for x in text.split()), text
            return library.encode(text, **options)

    encode.model = Marks()
    ids, at = encode.column(pa.array(texts))
    assert [ids[i:j].tolist() for i, j in zip(at, at[1:])] == wanted and ids.dtype == np.dtype("<u2")
