"""Hard negatives, mixing and collocations against brute force."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankyard.llm import hard_negatives, mixing, phrases


def mined(vectors, positives=5, negatives=5):
    """vectors: {id: (label, list of int, anchor)}."""
    out = []
    for a, (label, v, anchor) in vectors.items():
        if not anchor:
            continue
        score = {i: sum(x * y for x, y in zip(v, w)) for i, (_, w, _) in vectors.items() if i != a and len(w) == len(v)}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if vectors[i][0] == label][:positives]:
            window = [i for i in order if vectors[i][0] != label and 80 * score[p] <= 100 * score[i] <= 100 * score[p]]
            out += [(a, p, k, i, score[p], score[i]) for k, i in enumerate(window[:negatives], 1)]
    return sorted(out)


def vector_rows(spark, vectors, extra=()):
    rows = [(i, lab, v, anchor, "x") for i, (lab, v, anchor) in vectors.items()]
    return spark.createDataFrame(rows + list(extra), "id long, label long, v array<long>, anchor boolean, rank string").repartition(3)


@pytest.mark.parametrize("spread", [2, 40])
def test_hard_negatives_are_those_of_all_scores(spark, spread):
    rnd = random.Random(spread)
    vectors = {i: (rnd.randrange(3), [rnd.randint(-1, spread) for _ in range(10 if i % 9 else 7)], i % 4 == 0) for i in range(120)}
    vectors |= {i: (vectors[i - 100][0] + i % 2, vectors[i - 100][1], False) for i in range(200, 215)}
    extra = [(900, None, [1] * 10, True, "x"), (901, 1, None, True, "x"), (None, 1, [1] * 10, True, "x"), (4, vectors[4][0], vectors[4][1], True, "x")]
    found = hard_negatives.mine(vector_rows(spark, vectors, extra))
    assert sorted(map(tuple, found.collect())) == mined(vectors)


def test_score_tiles_add_up_over_chunks_and_blocks(spark):
    rng = np.random.default_rng(5)
    v = rng.integers(-300, 300, (90, 50))
    rows = spark.createDataFrame([(i, i % 2, v[i].tolist(), i % 3 == 0) for i in range(90)], "id long, label long, v array<long>, anchor boolean")
    seen = set()
    for t in hard_negatives.score_tiles(rows, anchor_block=8, row_block=20, width=7, most_chunks=5).collect():
        a, b = np.frombuffer(t.anchors, np.int64), np.frombuffer(t.rows, np.int64)
        assert (np.frombuffer(t.scores, np.int64).reshape(len(a), len(b)) == v[a] @ v[b].T).all()
        assert (np.frombuffer(t.row_labels, np.int64) == b % 2).all()
        seen |= {(x, y) for x in a.tolist() for y in b.tolist()}
    assert seen == {(a, b) for a in range(0, 90, 3) for b in range(90)}


def test_hard_negatives_store_no_scores(spark):
    """What is written grows with rows and anchors, not with their product."""
    from pathlib import Path

    files = lambda: {f: f.stat().st_size for f in Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")).rglob("*.parquet") if f.is_file()}
    v = np.random.default_rng(3).integers(-300, 300, (4000, 4))
    rows = spark.createDataFrame([(i, i % 5, v[i].tolist(), i % 8 == 0) for i in range(4000)], "id long, label long, v array<long>, anchor boolean")
    old = set(files())
    assert hard_negatives.mine(rows).count() > 10_000
    assert sum(size for f, size in files().items() if f not in old) < 500 * 4000 / 2


@pytest.mark.parametrize("spread", [1, 30, 1 << 14, 1 << 22])
def test_hard_negatives_of_many_blocks(spark, monkeypatch, spread):
    monkeypatch.setattr(hard_negatives, "ROWS", 7)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 5)
    rnd = random.Random(spread)
    vectors = {i * 7919 % 401: (rnd.randrange(4) if i % 5 else -i, [rnd.randint(-1, spread) for _ in range(6 if i % 11 else 200)], i % 4 == 0) for i in range(200)}
    found = hard_negatives.mine(vector_rows(spark, vectors), positives=3, negatives=4)
    assert sorted(map(tuple, found.collect())) == mined(vectors, 3, 4)


def test_a_task_hands_on_its_best_rows_before_it_holds_too_many(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(1)
    packed = lambda ids, v, prefix: {prefix + c: x for c, x in {"dim": 3, "size": 8, "ids": ids.tobytes(), "labels": (ids % 2).tobytes(), "v": v.tobytes(), "p": None}.items()}
    rows = [(np.sort(ids), rng.integers(-9, 9, (20, 3))) for ids in np.split(rng.permutation(np.arange(0, 160, 2)), 4)]
    anchors = [(np.arange(k, k + 20, 2), rng.integers(-9, 9, (10, 3))) for k in (1000, 2000)]
    batch = pa.RecordBatch.from_pylist([packed(*a, "a_") | packed(*b, "") for b in rows for a in anchors])
    give = lambda a, best: (lambda k, ids, scores: (a.ids[k], ids, scores))(*best.rows())
    run = lambda: [r for x in hard_negatives.searched([batch], lambda a: hard_negatives.Best(len(a.ids), 5), hard_negatives.add_same, give, ["a", "b", "s"]) for r in zip(*(c.to_pylist() for c in x.columns))]
    whole = run()
    wanted = {}
    for ids, v in anchors:
        for i, x in zip(ids.tolist(), v):
            wanted[i] = sorted((-int(x @ y), j) for some, w in rows for j, y in zip(some.tolist(), w))[:5]
    order = lambda found: {i: sorted((-s, b) for a, b, s in found if a == i)[:5] for i in wanted}
    assert order(whole) == wanted and len(whole) == 100
    monkeypatch.setattr(hard_negatives, "HELD", 9)
    monkeypatch.setattr(hard_negatives, "SCORES", 50)
    parts = run()
    assert order(parts) == wanted and len(parts) > 100


def test_hard_negatives_of_odd_tables(spark):
    assert hard_negatives.mine(vector_rows(spark, {})).collect() == []
    assert hard_negatives.mine(vector_rows(spark, {0: (1, [], True), 1: (1, [], False), 2: (2, [], False)})).collect() == [(0, 1, 1, 2, 0, 0)]
    with pytest.raises(Exception, match="too large"):
        hard_negatives.mine(vector_rows(spark, {0: (1, [1 << 40], True), 1: (1, [1 << 40], False)})).collect()


def test_components_become_whole_numbers(spark):
    rows = [([0.5, -0.001, float("inf")],), ([0.5, None],), ([float("nan")],), (None,), ([0.5, -0.001, 1.004],)]
    got = [r[0] for r in spark.createDataFrame(rows, "v array<float>").select(hard_negatives.whole(F.col("v"))).collect()]
    assert got == [None, None, None, None, [128, -1, 257]]


def shared(sizes, weights, most):
    """Targets by sharing the excess again until none is above its limit."""
    total, capped = sum(sizes.values()), {}
    while True:
        rest = [s for s in sizes if s not in capped]
        left = total - sum(capped.values())
        share = {s: Fraction(left * weights[s], sum(weights[x] for x in rest)) for s in rest} if rest else {}
        above = [s for s in rest if share[s] > most * sizes[s]]
        if not above:
            return capped | share
        capped |= {s: most * sizes[s] for s in above}


@pytest.mark.parametrize("seed", range(4))
def test_targets_are_those_of_sharing_again(spark, seed):
    rnd = random.Random(seed)
    names = sorted(f"s{k}" for k in range(rnd.randint(1, 9))) + [None]
    sizes = {s: rnd.choice([0, 1, 10, 500, 90_000]) for s in names}
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    found = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), (5, 2, 1), 3)
    got = {r.source: r.target for r in found.collect()}
    assert got == {s: pytest.approx(float(t)) for s, t in shared(sizes, weights, 3).items()}


def mix_rows(spark, n=400, seed=1):
    rnd = random.Random(seed)
    rows = [(k, " ".join(["w"] * int(rnd.expovariate(0.02))), rnd.choice(["b", "a", "a", "a", "Z", None]), 2.0 if k % 5 == 0 else None, 7) for k in range(n)]
    rows += [(None, "no id\tat all", "a", 1.0, 7), (3, None, "b", -1.0, 7), (5, "", "b", float("nan"), 7), rows[8], (9, "wort " * 30_000, None, 1.0, 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, worth double, size long").repartition(5)


def test_mix_comes_near_its_targets_and_takes_epochs_first(spark):
    docs = mix_rows(spark)
    quality = docs.select("doc_id", F.col("worth").alias("quality"))
    got = mixing.mix(docs, quality=quality).collect()
    source = {(r.doc_id, len((r.text or "").split())): r.source for r in docs.collect()}
    by = defaultdict(list)
    for r in got:
        by[source[r.doc_id, r.size]].append(r)
    sizes = {s: sum(r.size for r in rows) for s, rows in by.items()}
    names = sorted(x for x in sizes if x is not None) + [None]
    aims = shared(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, 3)
    for s, rows in by.items():
        assert {r.source_size for r in rows} == {sizes[s]}
        assert all(r.target == pytest.approx(float(aims[s])) for r in rows)
        assert abs(sum(r.taken for r in rows) - float(aims[s])) <= max(r.size for r in rows) / 2 + 1
        epochs = int(aims[s] // sizes[s]) if sizes[s] else 0
        assert all(r.taken == r.size * r.copies and (r.size == 0 or epochs <= r.copies <= epochs + 1) and r.taken <= 3 * r.size for r in rows)
    again = mixing.mix(docs.repartition(2), quality=quality.repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mix_prefers_documents_of_high_quality(spark):
    docs = spark.createDataFrame([(k, "w " * 10, "a" if k % 2 else "b", 5.0 if k % 4 < 2 else 1.0) for k in range(4000)], "doc_id long, text string, source string, worth double")
    got = mixing.mix(docs, weights=(1, 9), quality=docs.select("doc_id", F.col("worth").alias("quality"))).collect()
    a = [r for r in got if r.doc_id % 2]
    good, bad = (sum(r.taken > 0 for r in a if (r.doc_id % 4 < 2) == x) for x in (True, False))
    assert abs(sum(r.taken for r in a) - 4000) <= 5 and good > 2.5 * bad


def test_mix_of_nothing_and_its_documents(spark):
    docs = mix_rows(spark, 20)
    assert mixing.mix(docs.limit(0)).collect() == []
    assert {r.taken for r in mixing.mix(docs.withColumn("text", F.lit(None).cast("string"))).collect()} == {0}
    some = docs.where("doc_id < 8 AND doc_id != 3 AND doc_id != 5")
    mixed = mixing.mix(some)
    assert Counter(r.doc_id for r in mixing.repeated(some, mixed).collect()) == {r.doc_id: r.copies for r in mixed.collect() if r.copies}


def mined_phrases(docs, least, max_words=4, contained=80, most=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, max_words + 1):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, count in f.items():
        phrases_ = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        inside = lambda p, q: len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        kept = []
        for p, a in phrases_.items():
            if any(inside(p, q) and 100 * b >= contained * a for q, b in phrases_.items()):
                continue
            score, _, left, right = min((2_000_000 * a // (count[p[:k]] + count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(kept)[:most], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def phrase_docs(seed, n=150):
    rnd = random.Random(seed)
    words = ["a", "B", "b", "É", "é", "x" * 20_000, "ab", "a\xa0b", "漢字", "it's"]
    glue = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "\x1c"]
    rows = [("".join(rnd.choice(words[:5] if rnd.random() < 0.9 else words) + rnd.choice(glue) for _ in range(rnd.randint(0, 60))), rnd.choice(["en", "de", None, "und"])) for _ in range(n)]
    return rows + [(None, "en"), ("", None), rows[0], (" \t\n", "de"), ("a b " * 40_000 + "end. a b", "fr")]


@pytest.mark.parametrize("seed,least,most", [(1, 5, 2000), (2, 30, 7), (3, 300, 2000)])
def test_collocations_are_those_of_all_counts(spark, seed, least, most):
    rows = phrase_docs(seed)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "text string, lang string, phrase string, f int").repartition(4)
    found = phrases.collocations(docs, least=least, most=most).collect()
    assert sorted(map(tuple, found)) == mined_phrases(rows, least, most=most)
    assert found or least == 300


def test_collocations_of_nothing(spark):
    docs = spark.createDataFrame([], "text string, lang string")
    assert phrases.collocations(docs).collect() == []


def test_long_texts_are_cut_behind_ends_of_pieces():
    text = b"one two. three, four five six;" * 50 + b"no end here " * 100
    for most in (7, 64, 500):
        parts = list(phrases._cut(text, most))
        assert b"".join(parts) == text
        assert all(p[-1:] in (b".", b",", b";") for p in parts[:-1])


def test_every_frequent_run_passes_the_bitmap(spark, monkeypatch):
    rows = phrase_docs(9)
    docs = spark.createDataFrame(rows, "text string, lang string")
    full = sorted(map(tuple, phrases.counted(docs, least=4).collect()))
    monkeypatch.setattr(phrases, "FILTER", 1 << 10)
    assert sorted(map(tuple, phrases.counted(docs, least=4).collect())) == full
    assert math.isclose(sum(r[3] for r in full if r[1] == 0), sum(len(re.findall(r"[^\x20\x09.,;:!?\x0A-\x0D]+", t or "")) for t, _ in rows))
