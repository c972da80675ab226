"""Near duplicates of texts and vectors, components: against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from oracle import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st

from rankyard.llm import components, embed_dup, near_dup, words

LARGER = SMALL.replace("0.001", "0.01")


def roots(nodes, links):
    parent = {k: k for k in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {k: find(k) for k in nodes}


@pytest.mark.parametrize("links", [[], [(1, 2)], [(k, k + 1) for k in range(40)], [(0, k) for k in range(1, 50)], [(9, 3), (3, 9), (7, 8), (8, 7), (5, 5)]])
def test_components(spark, links):
    got = {r.hi: r.lo for r in components.stars(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for l in links for x in l}
    assert {k: got.get(k, k) for k in nodes} == roots(nodes, links)


def plain_sets(texts, size):
    out = {}
    for key, text in texts.items():
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        n = min(size, len(words))
        out[key] = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if words else set()
    return out


def brute_force(texts, size):
    sets = plain_sets(texts, size)
    holders = {}
    for key, found in sets.items():
        for s in found:
            holders.setdefault(s, set()).add(key)
    links = set()
    for key, found in sets.items():
        for other in set().union(*(holders[s] for s in found)) if found else ():
            common = len(found & sets[other])
            if other < key and 100 * common >= 80 * (len(found) + len(sets[other]) - common):
                links.add((other, key))
    return sets, roots(sets, links)


def check(got, texts, size):
    sets, root = brute_force(texts, size)
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), root[r.doc_id], root[r.doc_id] == r.doc_id)


@pytest.mark.parametrize("size", [2, 5])
def test_documents(spark, size):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    got = near_dup.near_duplicates(docs, size).collect()
    assert len(got) == docs.count()
    check(got, {r.doc_id: r.text for r in docs.collect()}, size)


def test_chains_and_large_groups(spark):
    """Copies of copies, so that many members are linked with few others and leaders change."""
    rng = random.Random(5)
    texts = {}
    for g in range(4):
        words = [f"w{rng.randrange(400)}" for _ in range(80)]
        for k in range(90):
            words = [w if rng.random() > 0.03 else f"w{rng.randrange(400)}" for w in words]
            texts[len(texts)] = " ".join(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    check(near_dup.near_duplicates(docs, 2).collect(), texts, 2)


def test_odd_documents(odd, none):
    got = near_dup.near_duplicates(odd, 2).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == odd.count() and near_dup.near_duplicates(none, 2).count() == 0
    assert (by[1].component_id, by[1].kept, by[0].kept) == (0, False, True)
    assert all((by[k].n_shingles, by[k].component_id, by[k].kept) == (0, k, True) for k in (2, 3, 4))
    assert (by[None].component_id, by[None].kept) == (None, True)
    assert by[9].n_shingles == 1


def test_repeated_ids_with_different_texts(spark):
    rows = [(1, "a b c d"), (1, "p q r s"), (2, "a b c d"), (3, "p q r s"), (0, "p q r s"), (4, "x y")]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 2).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(0, 0, True), (1, 0, False), (1, 1, True), (2, 1, False), (3, 0, False), (4, 4, True)]


def test_hashed_words():
    texts = ["The cat", None, "", " \n\t", "x" * 20_000 + " The the", "a\x0bb c\x1cd", "é É The", "END", ("w " * 400_000) + "end"]
    found, counts = words.hashed(pa.array(texts))
    plain = [w for t in texts for w in (t or "").encode().lower().split()]
    assert counts.tolist() == [len((t or "").encode().split()) for t in texts] and len(plain) == len(found)
    assert len(set(zip(plain, found.tolist()))) == len(set(plain)) == len(set(found.tolist()))
    part = words.hashed(pa.array(texts).slice(2, 5))[0]
    assert part.tolist() == found[counts[:2].sum() : counts[:7].sum()].tolist()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.none() | st.lists(st.sampled_from("abcAé \n"), max_size=12).map("".join), max_size=8), st.integers(1, 4))
def test_shingles_of_a_column(texts, size):
    found, counts = near_dup.shingles(pa.array(texts, pa.string()), size)
    sets = plain_sets(dict(enumerate(texts)), size)
    assert counts.tolist() == [len(sets[k]) for k in range(len(texts))]
    ids = {}
    for s, h in zip([s for k in range(len(texts)) for s in range(counts[k])], found.tolist()):
        ids.setdefault(h, s)
    assert len(ids) == len(set().union(*sets.values())) if sets else not ids


def test_bands_do_not_depend_on_blocks():
    found = np.random.default_rng(1).integers(0, 1 << 64, 900, dtype=np.uint64)
    sizes = np.array([1, 500, 3, 396])
    one = near_dup.bands(found, sizes)
    assert (near_dup.bands(found, sizes, block=64) == one).all()
    assert (near_dup.bands(found[501:504], sizes[2:3]) == one[2:3]).all()


def test_blocks_find_what_pairs_find(spark):
    rng = random.Random(3)
    sets = [(k, 20, sorted({rng.randrange(40) for _ in range(30)})) for k in range(30)]
    frame = spark.createDataFrame(sets, "id long, n long, shingles array<long>")
    rows = frame.selectExpr("0L AS `group`", "id", "n", "id AS comp")
    got = {tuple(sorted((r.a, r.b))) for r in near_dup.compared(rows, rows, frame, 60).collect()}
    wanted = {(a, b) for a, _, x in sets for b, _, y in sets if a < b and 100 * len({*x} & {*y}) >= 60 * len({*x} | {*y})}
    assert got == wanted


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(2, 70))
def test_quantisation_bounds_hold(seed, dim):
    x = np.random.default_rng(seed).normal(size=(20, dim)) ** 3
    q, scale, lost = embed_dup.quantised(x)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    kept = q * scale[:, None]
    error = np.abs(unit @ unit.T - kept @ kept.T)
    assert (error <= lost[:, None] * np.linalg.norm(kept, axis=1)[None] + lost[None] + 1e-12).all()


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(2, 70), st.booleans())
def test_bounds_decide_or_leave_open(seed, dim, same):
    """Cosines all around the threshold: what is sure is a link, what is left out is none, and rows of the rest are marked."""
    rng = np.random.default_rng(seed)
    x, y = (rng.normal(size=dim) + rng.normal(size=(40, dim)) * 0.25 for _ in "xy")
    y = x if same else y
    a, b = embed_dup.code(x, np.ones(40)), embed_dup.code(y, np.ones(40))
    exact = embed_dup.cosines(np.repeat(x, 40, 0), np.tile(y, (40, 1))).reshape(40, 40)
    wanted = {(i, j) for i, j in zip(*np.nonzero(exact >= 0.95)) if not same or i < j}
    found = [np.concatenate(c) for c in zip(*embed_dup.candidates(a, b, same, 0.95, rows=7))]
    pairs = set(zip(found[0].tolist(), found[1].tolist()))
    sure = {(i, j) for i, j, s in zip(*found) if s}
    assert len(pairs) == len(found[0]) and sure <= wanted <= pairs
    proved, _, open_ = embed_dup.tile_links(a, b, same, 0.95)
    rest, _, _ = embed_dup.tile_links(a, b, same, 0.95, (x, y))
    shift = 0 if same else 40
    assert set(np.nonzero(open_)[0]) == {k for i, j in pairs - sure for k in (i, j + shift)}
    assert (proved + rest).tolist() == [sum((i == k) + (j + shift == k) for i, j in wanted) for k in range(len(proved))]


def test_open_pairs_across_tiles(spark):
    """Most pairs lie near the threshold, so they are settled by full vectors, in the tiles and between them."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=24)
    rows = [(k, (base + rng.normal(size=24) * 0.24).tolist()) for k in range(90)]
    links, root = plain_vectors(rows, 0.95)
    assert len(links) > 300
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    for r in embed_dup.near_duplicates(frame, 0.95, 11).collect():
        assert (r.n_links, r.component_id) == (sum(r.vec_id in l for l in links), root[r.vec_id])


def test_ids_that_are_no_integers_are_an_error(spark):
    docs = spark.createDataFrame([("a", "x y z", [1.0])], "doc_id string, text string, embedding array<double>")
    with pytest.raises(TypeError, match="doc_id must hold integers, not string"):
        near_dup.near_duplicates(docs)
    with pytest.raises(TypeError, match="doc_id must hold integers"):
        embed_dup.near_duplicates(docs, id_col="doc_id")


def plain_vectors(rows, threshold):
    use = {k: np.array(v, float) for k, v in rows if k is not None and v is not None and all(c is not None and np.isfinite(c) for c in v) and any(v)}
    links = [(a, b) for a in use for b in use if a < b and len(use[a]) == len(use[b]) and use[a] @ use[b] / np.sqrt((use[a] @ use[a]) * (use[b] @ use[b])) >= threshold]
    return links, roots([k for k, _ in rows if k is not None], links)


def test_repeated_ids_of_different_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.99, 0.01]), (3, [1.0, 0.0]), (4, [-1.0, 0.0])]
    got = embed_dup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [(1, 0, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 0, 4, True)]


@pytest.mark.parametrize("tile", [7, 4096])
def test_vectors(spark, tile):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(12, 16))
    rows = [(k, (base[k % 12] + rng.normal(size=16) * (0.02 + 0.02 * (k % 10))).tolist()) for k in range(120)]
    rows += [(200, rows[0][1]), (201, rows[0][1]), (202, (np.array(rows[0][1]) * 3).tolist()), (203, None), (204, [0.0] * 16), (205, [float("nan")] + [1.0] * 15), (206, [None] + [1.0] * 15), (207, [float("inf")] + [1.0] * 15), (208, [1.0, 2.0]), (209, []), (None, rows[1][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = {r.vec_id: r for r in embed_dup.near_duplicates(frame, 0.95, tile).collect()}
    links, root = plain_vectors(rows, 0.95)
    for k in root:
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (sum(k in l for l in links), root[k], root[k] == k)
    assert (got[None].n_links, got[None].component_id, got[None].kept) == (0, None, True)
    assert embed_dup.near_duplicates(frame.limit(0)).count() == 0


def test_vectors_of_any_magnitude_link(spark):
    base = [0.3, -0.5, 0.8, 0.1]
    rows = [(k, [x * f for x in base]) for k, f in enumerate((1.0, 1e200, 1e-200, 1e300, 5e-310, -1e250))]
    got = embed_dup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [*((k, 4, 0) for k in range(5)), (5, 0, 5)]
