"""Language ID on held-out rows; sharding against plain arithmetic and DuckDB."""

from __future__ import annotations

import random
import zlib

import duckdb
import numpy as np
import pytest
from oracle import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st

from rankyard.llm import language_id, sharding

LARGER = SMALL.replace("0.001", "0.01")


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    got = language_id.identify(docs).collect()
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def substrings(text):
    return {text[i:j] for i in range(len(text)) for j in range(i + 1, len(text) + 1)}


@settings(max_examples=60, deadline=None)
@given(st.text("ab c", max_size=12))
def test_automaton_accepts_the_substrings(text):
    step = language_id.automaton([ord(c) for c in text])
    known = substrings(text)
    seen = {""}
    rest = [("", 0)]
    while rest:
        word, state = rest.pop()
        for c, s in step[state].items():
            seen.add(word + chr(c))
            rest.append((word + chr(c), s))
    assert seen - {""} == known


def plain_phrases(text, known):
    """Greedy longest matches, one after another."""
    count, at = 0, 0
    while at < len(text):
        n = 1
        while at + n < len(text) and text[at : at + n + 1] in known:
            n += 1
        count, at = count + 1, at + n
    return count


@pytest.mark.parametrize("segment, rows", [(512, 1 << 24), (3, 1 << 24), (3, 0), (1, 0)])
@settings(max_examples=40, deadline=None)
@given(texts=st.lists(st.text("abz 漢字?é", max_size=40), min_size=1, max_size=4))
def test_phrases_are_greedy_longest_matches(segment, rows, texts):
    sample = {"x": ["abba abz zab 漢"], "y": ["zzz bab"]}
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(language_id, "SEGMENT", segment)
        patch.setattr(language_id, "ROWS", rows)
        model = language_id.Model(sample)
        counts, letters, size = model.phrases(texts)
    for k, text in enumerate(texts):
        codes = language_id.Model.coded(model, text)
        lead = codes[1:] if len(codes) and codes[0] == 0 else codes
        assert letters[k] == sum(c.isalpha() for c in text) and size[k] == len(lead)
        for j, name in enumerate(model.names):
            known = substrings("".join(map(chr, model.coded(sample[name][0]))))
            assert counts[k, j] == plain_phrases("".join(map(chr, lead)), known), text


def test_cuts_of_long_texts_change_nothing():
    rng = random.Random(4)
    sample = {name: ["".join(rng.choice(letters) for _ in range(700))] for name, letters in (("x", "aab "), ("y", "abbc "), ("z", "".join(map(chr, range(0x4E00, 0x4E00 + 600)))))}
    model = language_id.Model(sample)
    texts = [sample["x"][0], sample["z"][0] * 3, "".join(rng.choice("abc 漢") for _ in range(5000)), "a" * 3000]
    counts, _, _ = model.phrases(texts)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(language_id, "SEGMENT", 10**6)
        assert (model.phrases(texts)[0] == counts).all()
    assert counts[0, 0] == 1 and counts[1, 2] == 3 and model.predict(texts)[0][:2] == ["x", "z"]


@pytest.mark.parametrize("long, held", [(7, 8_000_000), (400, 1), (1_000_000, 1), (50, 3000)])
def test_parts_of_texts_and_of_languages_change_nothing(long, held):
    rng = random.Random(5)
    sample = {name: ["".join(rng.choice(letters) for _ in range(700))] for name, letters in (("x", "aab "), ("y", "abbc "), ("z", "".join(map(chr, range(0x4E00, 0x4E00 + 600)))))}
    model = language_id.Model(sample)
    texts = ["".join(rng.choice("abc 漢!?1 ") for _ in range(n)) for n in (0, 1, 7, 8, 300, 5000)] + ["!!! " * 400 + sample["x"][0], "ΑΣ ΑΣΑ" * 300]
    wanted = model.phrases(texts)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(language_id, "LONG", long)
        patch.setattr(language_id, "HELD", held)
        patch.setattr(language_id, "SEGMENT", 64)
        for got, want in zip(model.phrases(texts), wanted):
            assert (got == want).all()


def test_every_label_can_be_predicted(spark):
    letters = [chr(0x4E00 + k) for k in range(90)]
    rows = [(k, (c + letters[k - 1]) * (400 if k else 900), f"l{k:02}") for k, c in enumerate(letters) for _ in range(1 + (k == 0))]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.predict([t for _, t, _ in rows])[0] == [name for _, _, name in rows]


def test_long_texts_are_read_whole():
    model = language_id.Model({"x": ["aaaa"], "y": ["bbbb"]})
    names, _ = model.predict(["a" * 600 + "b" * 2000, "a" * 2000 + "b" * 600, None, "12 !"])
    assert names == ["y", "x", "und", "und"]


def test_odd_rows(odd, none):
    got = {r.doc_id: r for r in language_id.identify(odd).collect()}
    assert [got[k].lang_pred for k in (2, 3, 4, 5)] == ["und"] * 4 and got[2].score == 0
    assert got[None].held_out is False and len(got) == 13
    assert language_id.identify(none).count() == 0
    unlabelled = odd.withColumn("lang", odd["lang"].substr(9, 1)).where("lang = 'x'")
    assert language_id.predict(odd, language_id.fit(unlabelled)).where("lang_pred <> 'und'").count() == 0


def plain_jump(key, n):
    key, here, ahead = key % 2**64, -1, 0
    while ahead < n:
        here = ahead
        key = (key * 2862933555777941757 + 1) % 2**64
        ahead = int((here + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return here


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(-(2**63), 2**63 - 1), min_size=1), st.integers(1, 40))
def test_jump(keys, n):
    found, grown = (sharding.jump(np.array(keys), m).tolist() for m in (n, n + 1))
    assert found == [plain_jump(k, n) for k in keys]
    assert all(b in (a, n) for a, b in zip(found, grown))


# Only the CRC is beyond DuckDB.
JUMP_SQL = """
WITH RECURSIVE steps AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, n, 0::BIGINT AS here, 0::BIGINT AS ahead, doc_id::UHUGEINT AS k FROM documents, (VALUES (8), (9)) v(n)
  UNION ALL
  SELECT doc_id, size, n, ahead, floor((ahead + 1) * (2147483648.0::DOUBLE / ((((k * 2862933555777941757 + 1) % 18446744073709551616) // 8589934592) + 1)::DOUBLE))::BIGINT, (k * 2862933555777941757 + 1) % 18446744073709551616
  FROM steps WHERE ahead < n
), last AS (SELECT doc_id, size, n, max(here) AS shard FROM steps GROUP BY ALL)
SELECT a.doc_id, a.size, a.shard::INT, row_number() OVER (PARTITION BY a.shard ORDER BY a.doc_id) - 1, b.shard::INT FROM last a JOIN last b USING (doc_id) WHERE a.n = 8 AND b.n = 9
"""


def test_shards_are_those_of_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    got = sharding.assign(spark.read.parquet(f"{SMALL}/documents.parquet")).collect()
    assert sorted((r.doc_id, r.size, r.shard, r.slot, r.grown_shard) for r in got) == sorted(con.sql(JUMP_SQL).fetchall())


def test_odd_shards(odd, none):
    got = sharding.assign(odd, 3).collect()
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    for s in range(3):
        slots = sorted((r.slot, r.doc_id is not None, r.doc_id or 0) for r in got if r.shard == s)
        assert [x[0] for x in slots] == list(range(len(slots))) and [x[1:] for x in slots] == sorted(x[1:] for x in slots)
    assert all((r.size, r.text_crc32, r.law) == (len(texts[r.doc_id].encode()) + 1, zlib.crc32(texts[r.doc_id].encode()), "key") for r in got)
    assert len(got) == odd.count() and sharding.assign(none).count() == 0


def test_shards_of_text_keys(spark):
    """Keys of any type: one shard a key, one more shard takes rows only into itself, slots without gaps."""
    rows = [(f"key-{k % 900}", "t" * (k % 7)) for k in range(1000)] + [(None, "x")]
    got = sharding.assign(spark.createDataFrame(rows, "doc_id string, text string").repartition(3), 5).collect()
    shard_of = {}
    for r in got:
        assert shard_of.setdefault(r.doc_id, r.shard) == r.shard and r.grown_shard in (r.shard, 5)
    assert len(got) == 1001 and len({r.shard for r in got}) == 5
    for s in range(5):
        here = sorted((r.slot, r.doc_id or "") for r in got if r.shard == s)
        assert [k for k, _ in here] == list(range(len(here))) and [d for _, d in here] == sorted(d for _, d in here)
