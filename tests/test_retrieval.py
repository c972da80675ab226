"""Rankings, metrics, pools, samples: exact values on small fixtures."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from rankyard.operators import metrics, pools, ranking, sampling, summary

TOOLS = [(1, "make directory on a volume"), (2, "read rows of a table into memory"), (3, "write rows of a table"), (4, "send a message"), (5, "table of contents")]


@pytest.fixture(scope="module")
def tools(spark):
    return spark.createDataFrame(TOOLS, "id long, text string")


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


def test_bm25_formula_by_hand(spark, tools):
    got = {r.item_id: r.score for r in ranking.bm25(asked(spark, "Message, message!"), tools, 5).collect()}
    mean = (5 + 7 + 5 + 3 + 3) / 5
    idf = math.log(1 + (5 - 1 + 0.5) / (1 + 0.5))
    assert got == {4: pytest.approx(idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 3 / mean)), abs=1e-8)}


def test_terms_that_most_items_share_still_rank(spark):
    items = spark.createDataFrame([(1, "alpha beta"), (2, "alpha"), (3, "gamma")], "id long, text string")
    assert [r.item_id for r in ranking.bm25(asked(spark, "alpha"), items, 3).orderBy("rank").collect()] == [2, 1]


def test_no_hit_no_row_and_empty_tables(spark, tools):
    assert ranking.bm25(asked(spark, "zebra", ""), tools, 3).count() == 0
    assert ranking.bm25(asked(spark, "table"), tools.limit(0), 3).count() == 0


def test_pool_statistics_are_the_pools_own(spark, tools):
    members = spark.createDataFrame([(0, 2, 3), (0, 2, 5)], "query_id long, pool_size int, item_id long")
    got = ranking.bm25_in_pools(asked(spark, "table message"), members, tools, 5).orderBy("rank").collect()
    idf = math.log(1 + 0.5 / 2.5)
    assert [r.item_id for r in got] == [5, 3]
    assert got[0].score == pytest.approx(idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 3 / 4)), abs=1e-8)


def ranked(spark, *ids):
    return spark.createDataFrame([(0, i, 10.0 - k, k + 1) for k, i in enumerate(ids)], "query_id long, item_id long, score double, rank int")


def gold(spark, *ids):
    return spark.createDataFrame([(0, i) for i in ids], "query_id long, item_id long")


def at(spark, ranking_ids, gold_ids, ks, **options):
    one = spark.createDataFrame([(0,)], "query_id long")
    return {r.k: r for r in metrics.at_ks(one, ranked(spark, *ranking_ids), gold(spark, *gold_ids), ks, **options).collect()}


def test_gold_at_rank_two(spark):
    got = at(spark, [7, 8, 9], [8], [1, 2])
    assert (got[1].recall_at_k, got[1].hit_at_k, got[1].reciprocal_rank) == (0, False, 0)
    assert got[2].ndcg_at_k == pytest.approx(1 / math.log2(3))
    assert (got[2].precision_at_k, got[2].reciprocal_rank, got[1].gold_score) == (0.5, 0.5, 9.0)


def test_two_gold_items(spark):
    got = at(spark, [1, 2, 3], [1, 2], [1, 2, 10])
    assert (got[1].recall_at_k, got[1].complete_at_k) == (0.5, False)
    assert (got[2].recall_at_k, got[2].complete_at_k, got[2].ndcg_at_k) == (1.0, True, 1.0)
    assert got[10].precision_at_k == pytest.approx(2 / 3)
    assert [e.id for e in got[2].retrieved] == [1, 2]


def test_variants_differ_where_they_should(spark):
    engine, sdk = at(spark, [1], [], [3])[3], at(spark, [1], [], [3], variant="sdk")[3]
    assert (engine.complete_at_k, sdk.complete_at_k) == (False, True)
    assert at(spark, [1], [1], [3], variant="sdk")[3].precision_at_k == pytest.approx(1 / 3)
    assert at(spark, [2, 1], [1], [1, 2])[1].gold_score == 9.0
    assert at(spark, [2, 1], [1], [1, 2], variant="sdk")[1].gold_score is None


def test_nothing_ranked_and_no_ks(spark):
    got = at(spark, [], [4], [1])[1]
    assert (got.precision_at_k, got.recall_at_k, got.ndcg_at_k, got.gold_count, got.gold_score) == (0, 0, 0, 1, None)
    assert at(spark, [1], [1], []) == {}


def test_pools_nest_keep_own_and_run_out(spark):
    own = spark.createDataFrame([(0, 1, 0), (0, 2, 1)], "query_id long, item_id long, position int")
    universe = spark.range(1, 31).withColumnRenamed("id", "item_id")
    got = pools.pools(own, universe, [1, 5, 100], 42).collect()
    by = {s: {r.item_id for r in got if r.pool_size == s} for s in (1, 5, 100)}
    assert by[1] == {1, 2} and len(by[5]) == 5 and len(by[100]) == 30
    assert by[1] < by[5] < by[100]
    assert got != pools.pools(own, universe, [1, 5, 100], 43).collect()
    assert sorted(got) == sorted(pools.pools(own.repartition(3), universe.repartition(7), [1, 5, 100], 42).collect())


def order_of(seed, query, n):
    """The permutation of 0 ... n - 1, position by position, in plain Python."""
    import hashlib

    digest = hashlib.md5(f"{seed}:{query}".encode()).hexdigest()
    keys = [int(digest[7 * k : 7 * k + 7], 16) for k in range(4)]
    h = next(h for h in range(1, 40) if 4**h >= n)
    out = []
    for x in range(n):
        while True:
            left, right = x >> h, x % (1 << h)
            for k in keys:
                y = (right * 48271 + k) % 2147483647
                left, right = right, left ^ (y * y % 2147483647 // 8 % (1 << h))
            x = (left << h) + right
            if x < n:
                break
        out.append(x)
    return out


@pytest.mark.parametrize("n", [1, 2, 5, 40, 1000])
def test_permutations_are_bijections_and_differ(n):
    orders = {tuple(order_of(7, q, n)) for q in range(20)}
    assert all(sorted(o) == list(range(n)) for o in orders)
    assert len(orders) >= min(20, math.factorial(n)) * 0.8 if n > 4 else True


def test_every_place_is_taken_about_equally_often(spark):
    from rankyard.functions import permutation

    rows = spark.range(3000).select(permutation.first_positions(permutation.keys(1, F.col("id")), F.lit(5), F.lit(50)).alias("p"))
    counts = [r["count"] for r in rows.select(F.explode("p").alias("p")).groupBy("p").count().collect()]
    assert len(counts) == 50 and all(200 < c < 400 for c in counts)


def test_pools_by_brute_force(spark):
    import hashlib

    own = spark.createDataFrame([(q, (q * 7 + k) % 40 + 1, k) for q in range(25) for k in range(q % 4 + 1)], "query_id long, item_id long, position int")
    universe = spark.range(1, 41).withColumnRenamed("id", "item_id")
    places = sorted(range(1, 41), key=lambda i: (hashlib.md5(str(i).encode()).hexdigest()[:3], i))
    assert {r.item_id: r.position for r in pools.numbered(universe).collect()} == {i: k for k, i in enumerate(places)}
    mine = {q: [r.item_id for r in own.where(f"query_id = {q}").orderBy("position").collect()] for q in range(25)}
    wanted = set()
    for q, first in mine.items():
        rest = [i for i in (places[x] for x in order_of(7, q, 40)) if i not in first]
        wanted |= {(q, size, i, n) for size in (3, 9) for n, i in enumerate(first + rest, 1) if n <= max(size, len(first))}
    found = pools.pools(own, universe, (3, 9), 7)
    assert {tuple(r) for r in found.collect()} == wanted and found.count() == len(wanted)
    assert pools.pools(own, universe.limit(0), (3, 9), 7).count() == 2 * own.count()
    assert pools.pools(own.limit(0), universe, (3, 9), 7).count() == 0


@pytest.mark.parametrize("spread", [8, 0, -1])
def test_ordered_pools_by_brute_force(spark, spread):
    """Whatever passes the limit on digests: all, about enough or too little."""
    import hashlib

    mine = {q: [(q * 7 + k) % 300 + 1 for k in range(q % 4)] for q in range(25)}
    own = spark.createDataFrame([(q, i, k) for q, first in mine.items() for k, i in enumerate(first)], "query_id long, item_id long, position int")
    universe = spark.range(1, 301).withColumnRenamed("id", "item_id")
    wanted = set()
    for q, first in mine.items():
        rest = sorted({*range(1, 301)} - {*first}, key=lambda i: hashlib.md5(f"7:{q}:{i}".encode()).hexdigest())
        wanted |= {(q, size, i, n) for size in (3, 9) for n, i in enumerate(first + rest, 1) if first and n <= max(size, len(first))}
    found = pools.ordered_pools(own, universe, (3, 9), 7, spread)
    assert {tuple(r) for r in found.collect()} == wanted and found.count() == len(wanted)
    assert pools.ordered_pools(own, universe.limit(0), (3, 9), 7, spread).count() == 2 * own.count()
    assert pools.ordered_pools(own.limit(0), universe, (3, 9), 7, spread).count() == 0


def test_nested_pools_hold_the_first_of_all_documents(spark):
    """The order of the distractors is that of all documents by their digests, not of some drawn places."""
    import hashlib

    from oracle import SMALL

    from rankyard.plans import retrieval

    some = retrieval.pool_membership_nested(spark, SMALL).where("pool_size = 30").collect()
    q = min(r.query_id for r in some)
    ids = [r.item_id for r in sorted((r for r in some if r.query_id == q), key=lambda r: r.ordinal)]
    docs = [r.doc_id for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id").collect()]
    order = sorted(docs, key=lambda i: hashlib.md5(f"42:{q}:{i}".encode()).hexdigest())
    assert len(ids) == 30 and any(ids[n:] == [i for i in order if i not in ids[:n]][: 30 - n] for n in range(1, 15))


@pytest.mark.parametrize("most", [1000, 0])
def test_gold_of_runs_by_brute_force(spark, tmp_path, most):
    """Runs from wherever in an item, whether its parts are broadcast or shuffled."""
    import random
    import re

    from rankyard.plans import adapters

    rnd = random.Random(4)
    words = ["a", "b", "B", "c0", "d"]
    say = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    asked = [(k, say(n)) for k, n in enumerate([8, 9, 12, 15, 20, 30, 7, 5, 1, 8, 11])] + [(90, "..."), (91, None), (92, "a b a c0 d d a b c0")]
    texts = [(k, say(rnd.randint(0, 40))) for k in range(40)]
    for k in range(60):
        q = re.findall("[a-z0-9]+", asked[k % 11][1].lower())
        n, at = rnd.choice([6, 7, 8, 9]), rnd.randint(0, 12)
        texts.append((100 + k, f"{say(rnd.randint(0, 9))} x {' '.join(q[at:at + n])}, Y {say(rnd.randint(0, 9))}"))
    texts += [(900, ""), (901, None), (902, "A b. A c0 d-d a B"), (903, "z b a c0 d d a b c0")]
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(k, t, "en", "s") for k, t in texts], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    cut = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    holds = lambda t, run: any(t[i : i + len(run)] == run for i in range(len(t) - len(run) + 1))
    wanted = [(q, d) for q, x in asked for d, y in texts if cut(x) and any(holds(cut(y), cut(x)[i : i + 8]) for i in range(max(1, len(cut(x)) - 7)))]
    assert sorted(map(tuple, adapters.gold_of_runs(spark, str(tmp_path), most).collect())) == wanted
    assert {(92, 902), (92, 903)} <= set(wanted) and len(wanted) > 30


def test_nested_pools_begin_with_documents_that_hold_a_run_of_the_item(spark, tmp_path):
    """Those with the first eight tokens, as the first SQL had, those with later ones and those with the whole item."""
    import duckdb
    from oracle import rows

    from rankyard.plans import catalogue

    long = "One two three four five six seven eight nine ten."
    texts = [(1, "x one two three four five six seven eight y"), (2, "three four five six seven eight nine ten"), (3, long), (4, "two three four five six seven eight"), (5, "a SHORT item b"), (6, "")]
    spark.createDataFrame([(1, long), (2, "Short, item!")], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/of/benchmark.parquet")
    spark.createDataFrame([(k, t, "en", "s") for k, t in texts], "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/of/documents.parquet")
    found = catalogue.queries()["pool_membership_nested"](spark, f"{tmp_path}/of").collect()
    own = lambda q, n: [r.item_id for r in sorted(found, key=lambda r: r.ordinal) if (r.query_id, r.pool_size) == (q, 30)][:n]
    assert own(1, 3) == [1, 2, 3] and own(2, 1) == [5]
    con = duckdb.connect()
    for t in ("benchmark", "documents"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/of/{t}.parquet/*.parquet'")
    sql = con.sql(catalogue.oracle_sql()["pool_membership_nested"])
    assert rows((r.asDict() for r in found), sql.columns) == rows((dict(zip(sql.columns, r)) for r in sql.fetchall()), sql.columns)


def test_pools_enumerate_no_pairs(spark):
    own = spark.createDataFrame([(0, 1, 0)], "query_id long, item_id long, position int")
    plan = pools.pools(own, spark.range(1000).withColumnRenamed("id", "item_id"), (5,), 7)._jdf.queryExecution().executedPlan().toString()
    # The one-row count of items is the only table that all scenarios meet.
    assert plan.count("NestedLoop") + plan.count("CartesianProduct") <= 1


def test_every_order_has_pools_that_any_part_can_enter(spark):
    from oracle import SMALL

    from rankyard.plans import retrieval

    found = retrieval.pool_own_gold_every_order(spark, SMALL).cache()
    orders = spark.read.parquet(f"{SMALL}/lineitem.parquet").select("l_orderkey").distinct().count()
    assert found.select("query_id").distinct().count() == orders
    drawn = found.groupBy("query_id", "pool_size").agg(F.count("*").alias("n"), F.max("pool_size").alias("s"))
    assert drawn.where("n < s").count() == 0
    assert found.join(spark.read.parquet(f"{SMALL}/part.parquet").where("p_size > 10"), F.col("item_id") == F.col("p_partkey")).count() > 0


def test_pool_without_gold_fails(spark):
    rows = spark.createDataFrame([([1, 2], [1])], "gold array<int>, pool_ids array<int>")
    with pytest.raises(Exception, match="pool without gold ids: 2"):
        pools.gold_complete(rows).collect()
    assert pools.gold_complete(rows.withColumn("pool_ids", F.col("gold"))).count() == 1


def test_stratified_quotas(spark):
    rows = spark.createDataFrame([(k, "cab"[k % 3]) for k in range(30)], "id long, d string")
    count = lambda df: {r.d: r["count"] for r in df.groupBy("d").count().collect()}
    assert count(sampling.stratified(rows, 7, 42, "d")) == {"a": 3, "b": 2, "c": 2}
    few = rows.where("d <> 'a' OR id < 9")
    assert count(sampling.stratified(few, 16, 42, "d"))["a"] == 3
    assert count(sampling.round_robin(rows, 7, 42, "d")) == {"a": 3, "b": 2, "c": 2}
    assert sampling.seeded(rows, 5, 1).collect() == sampling.seeded(rows.repartition(5), 5, 1).collect()


def test_statistics(spark):
    values = spark.createDataFrame([(float(v),) for v in (2, 4, 4, 4, 5, 5, 7, 9)], "x double")
    got = summary.stats(values, [], "x", "x").first()
    assert (got.mean_x, got.median_x, got.stddev_x) == (5.0, 4.5, 2.0)
    none = summary.stats(values.limit(0), [], "x", "x").first()
    assert (none.mean_x, none.median_x, none.stddev_x) == (0.0, 0.0, 0.0)


def test_medians_are_exact(spark):
    import random
    import statistics

    from rankyard.operators.medians import medians

    rnd = random.Random(4)
    draws = {"normal": lambda: rnd.gauss(0, 1), "tail": lambda: rnd.expovariate(1) ** 9, "ties": lambda: float(rnd.randint(-2, 2)), "close": lambda: 1 + rnd.random() * 1e-9, "mixed": lambda: rnd.choice([0.0, -0.0, 5e-324, -1e308, 1e308, float("inf"), 2.5])}
    rows = [(name if k % 7 else None, n, draw()) for name, draw in draws.items() for n in (1, 2, 3, 10, 401) for k in range(n)]
    rows += [("nothing", 0, None), (None, 2, None)]
    df = spark.createDataFrame(rows, "g string, n int, x double").repartition(7)
    wanted = {}
    for g, n, x in rows:
        wanted.setdefault((g, n), []).extend([x] if x is not None else [])
    found = {(r.g, r.n): r.m for r in medians(df, ["g", "n"], {"m": "x", "twice": "x"}).collect()}
    assert found == {k: pytest.approx(statistics.median(v), nan_ok=True) for k, v in wanted.items() if v}
    plan = medians(df, ["g"], {"m": "x"})._jdf.queryExecution().executedPlan().toString()
    assert "median(" not in plan and "percentile" not in plan


def test_ranges_never_fall_as_values_rise(spark):
    from rankyard.operators.medians import value_range

    values = [float("-inf"), -1e308, -2.0, -1.9999999, -5e-324, -0.0, 0.0, 5e-324, 1e-300, 0.3, 0.30000000000000004, 1.0, 2.0, 1e308, float("inf"), float("nan")]
    got = [r.r for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double").select("k", value_range(F.col("v")).alias("r")).orderBy("k").collect()]
    assert got == sorted(got) and got[5] == got[6]


def test_fusion(spark):
    a = spark.createDataFrame([(0, 1, 1), (0, 2, 2)], "query_id long, item_id long, rank int")
    b = spark.createDataFrame([(0, 2, 1), (0, 3, 2)], "query_id long, item_id long, rank int")
    got = ranking.fused([a, b], 3).orderBy("rank").collect()
    assert [r.item_id for r in got] == [2, 1, 3]
    assert got[0].score == pytest.approx(1 / 62 + 1 / 61, abs=1e-8)


def test_retrievers_share_a_signature(spark, tools):
    vectors = [[1.0, 0.0], [0.0, 1.0], [1.0, 1.0], None, [0.0, 0.0]]
    items = spark.createDataFrame([(i, t, v) for (i, t), v in zip(TOOLS, vectors)], "id long, text string, vector array<double>")
    asked_ = spark.createDataFrame([(100, "table rows", [1.0, 0.1]), (101, "message", None)], "id long, text string, vector array<double>")
    got = {m: [(r.query_id, r.item_id) for r in ranking.retriever(m)(asked_, items, 2).orderBy("query_id", "rank").collect()] for m in ranking.retrievers}
    assert got["semantic"] == [(100, 1), (100, 3)]
    assert got["bm25"] == [(100, 3), (100, 2), (101, 4)]
    assert set(got["hybrid"]) <= set(got["bm25"]) | set(got["semantic"]) and (101, 4) in got["hybrid"]
    with pytest.raises(ValueError, match="unknown method 'magic'"):
        ranking.retriever("magic")
    with pytest.raises(ValueError, match="registered already"):
        ranking.retrievers.add("bm25", ranking.bm25)
    with pytest.raises(TypeError):
        ranking.retrievers.add("broken", None)


def test_vectors_without_direction_rank_nothing(spark):
    odd = [(1, [1.0, 2.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0, 2.0, 3.0]), (8, [1e200, 2e200]), (9, [])]
    items = spark.createDataFrame(odd, "id long, vector array<double>")
    got = ranking.dense(items, items, 5).collect()
    assert sorted((r.query_id, r.item_id, r.score) for r in got) == [(1, 8, 1.0), (8, 1, 1.0)]
    assert ranking.dense(items.limit(0), items, 5).collect() == ranking.dense(items, items.limit(0), 5).collect() == []


@pytest.mark.parametrize("segment,block,words", [(1 << 16, 128, 30), (7, 2, 30), (20, 3, 400)])
def test_pruned_bm25_is_that_of_all_postings(spark, monkeypatch, segment, block, words):
    import random

    rnd = random.Random(words)
    monkeypatch.setattr(ranking, "SEGMENT", segment)
    monkeypatch.setattr(ranking, "BLOCK", block)
    text = lambda n: " ".join(f"w{int(rnd.paretovariate(0.6)) % words}" for _ in range(n))
    texts = [text(rnd.randint(0, 30)) for _ in range(150)] + [None, ""]
    asks = [text(rnd.randint(1, 12)) for _ in range(25)] + ["", None]
    split = [(t or "").split() for t in texts]
    mean, wanted = sum(map(len, split)) / len(split), []
    for q, ask in enumerate(asks):
        scores = {}
        for t in set((ask or "").split()):
            df = sum(t in s for s in split)
            for i, s in enumerate(split):
                if t in s:
                    tf = s.count(t)
                    scores[i] = scores.get(i, 0) + math.log(1 + (len(split) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(s) / mean))
        best = sorted(scores, key=lambda i: (-round(scores[i], 9), i))[:4]
        wanted += [(q, i, round(scores[i], 6), n) for n, i in enumerate(best, 1)]
    found = ranking.bm25(asked(spark, *asks), spark.createDataFrame(list(enumerate(texts)), "id long, text string"), 4)
    assert sorted((r.query_id, r.item_id, round(r.score, 6), r["rank"]) for r in found.collect()) == sorted(wanted)


def test_bounds_leave_few_items_to_score(spark):
    items = spark.createDataFrame([(k, "common " * (k % 5 + 1) + (f"rare{k}" if k % 100 == 0 else "")) for k in range(2000)], "id long, text string")
    terms = ranking.query_terms(asked(spark, "common rare0 rare100 rare200"), "id", "text")
    weighed = ranking.impacts(ranking.postings(items, terms, "id", "text"))
    blocks = ranking.impact_blocks(weighed)
    third = sorted(r.score for r in ranking._sums(weighed.select("item_id", "term").join(terms, "term"), weighed).collect())[-3]
    assert ranking.bounds(terms, blocks, weighed, 3).first().bound == pytest.approx(third, abs=1e-5)
    assert 3 <= ranking.scored_items(terms, blocks, weighed, 3).count() < 20


def test_gold_that_the_pool_lacks(spark):
    gold = spark.createDataFrame([(1, 5, 0), (1, 6, 1), (1, 7, 2)], "query_id long, item_id long, position int")
    pool = spark.createDataFrame([(1, 5, "five", None, "{}"), (1, 7, None, "seventh", None), (2, 6, "six", "sixth", None)], "query_id long, item_id long, name string, description string, input_schema string")
    made = [tuple(r)[1:] for r in pools.resolved_gold(gold, pool).orderBy("ordinal").collect()]
    assert made == [(1, 5, "five", None, "{}"), (2, 6, "6", "gold tool 6 (synthesized: not in candidate_pool)", "{}"), (3, 7, None, "seventh", None)]
    assert [tuple(r)[1:3] for r in pools.resolved_gold(gold, pool, missing="drop").orderBy("ordinal").collect()] == [(1, 5), (2, 7)]
    with pytest.raises(ValueError):
        pools.resolved_gold(gold, pool, missing="guess")


def test_gold_holds_the_whole_item_and_short_items_count(spark, tmp_path):
    from rankyard.plans import adapters

    long = "One two three four five six seven eight nine ten."
    asked = [(1, long), (2, "Short, item!"), (3, "..."), (4, None)]
    texts = [(1, f"x {long} y"), (2, "one two three four five six seven eight nine"), (3, "two three four five six seven eight nine ten"), (4, "a SHORT item b"), (5, "shorts item short items"), (6, ""), (7, None), (8, f"{long[:-4]} no {long} Short item {long}")]
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(k, t, "en", "s") for k, t in texts], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = [tuple(r) for r in adapters.gold(spark, str(tmp_path)).collect()]
    assert sorted(found) == [(1, 1), (1, 8), (2, 4), (2, 8)]


def test_cosines_are_dealt_out_by_block_pairs(spark):
    import numpy as np

    vectors = np.random.default_rng(3).normal(size=(60, 5))
    items = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(vectors)], "id long, vector array<double>")
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    scores = unit @ unit.T
    wanted = {(q, int(i), n + 1) for q in range(0, 60, 4) for n, i in enumerate([i for i in np.argsort(-scores[q]) if i != q][:6])}
    asked = items.where("id % 4 = 0")
    for rows in (4, 512):
        found = ranking.dense(asked, items, 6, query_rows=rows, item_rows=2 * rows).collect()
        assert {(r.query_id, r.item_id, r.rank) for r in found} == wanted and len(found) == len(wanted)


def test_prior_orders_a_label_once(spark):
    """Not every query's items of its label: what meets the queries is the first of each label."""
    from oracle import SMALL

    from rankyard.plans import retrieval

    plan = retrieval.hybrid_rrf_topk(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "dense_rank(" in plan and plan.index("row_number(") < plan.index("dense_rank(")


def test_prior_without_the_query_itself(spark, tmp_path):
    """Labels of fewer than ten rows, of many, of none, and queries that are among the first of their label."""
    import duckdb
    from oracle import rows

    from rankyard.plans import catalogue, retrieval

    vectors = [(i, [float(i % 7 + 1), float(i % 5), 1.0], None if i % 11 == 0 else 1 if i < 300 else i % 200) for i in range(600)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    sql = catalogue.oracle_sql()["hybrid_rrf_topk"]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    wanted = con.sql(sql)
    got = retrieval.hybrid_rrf_topk(spark, str(tmp_path))
    assert rows((r.asDict() for r in got.collect()), wanted.columns) == rows([dict(zip(wanted.columns, r)) for r in wanted.fetchall()], wanted.columns)


@pytest.mark.parametrize("most", [100, 0])
def test_gold_by_words_and_by_runs(spark, tmp_path, most):
    """Both ways of finding the links, against a search for each item in each text."""
    import re

    from rankyard.plans import adapters

    asked = ["one", "Two, three", "a b a b", "a a", "", None, "...", "the quick brown fox jumps over the lazy dog and goes home", "fox fox", "dog"]
    texts = ["one two three", "a b a b a b", "a-a-a", None, "", "a b", "THE QUICK, brown fox jumps over the lazy dog and goes home!", "the quick brown fox jumps over the lazy dog and goes", "fox fox fox", "doge dogs hot dog", "one"]
    spark.createDataFrame(list(enumerate(asked)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(k, t, "x", "y") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spaced = lambda t: f" {' '.join(re.findall('[a-z0-9]+', (t or '').lower()))} "
    wanted = sorted((q, i) for q, a in enumerate(asked) for i, t in enumerate(texts) if spaced(a).strip() and spaced(a) in spaced(t))
    assert sorted(map(tuple, adapters.gold(spark, str(tmp_path), most).collect())) == wanted and len(wanted) > 9


def test_links_of_few_items_shuffle_no_texts(spark):
    from oracle import SMALL

    from rankyard.functions.labels import tokens
    from rankyard.plans import adapters

    asked = adapters.scenarios(spark, SMALL).select(F.col("id").alias("query_id"), tokens(F.col("text")).alias("q"))
    found = adapters.items(spark, SMALL).select(F.col("id").alias("item_id"), tokens(F.col("text")).alias("t"))
    plan = adapters._links_at_words(asked, found)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_tasks_follow_the_rows(spark, monkeypatch):
    """Grouping, joining and numbering the parts of orders take more tasks for more lines."""
    from oracle import SMALL

    from rankyard import staging
    from rankyard.plans import adapters, retrieval

    monkeypatch.setattr(staging, "ROWS", 100)
    lines = spark.read.parquet(f"{SMALL}/lineitem.parquet").count()
    assert adapters.order_items(spark, SMALL).rdd.getNumPartitions() == -(-lines // 100)
    assert retrieval.gold_in_gold_order(spark, SMALL).rdd.getNumPartitions() == -(-lines // 100)


def test_links_cut_each_text_once(spark):
    """Filters that Spark infers on the tokens would cut every text of documents a second time."""
    import re

    from oracle import SMALL

    from rankyard.functions.labels import tokens
    from rankyard.plans import adapters

    asked = adapters.scenarios(spark, SMALL).select(F.col("id").alias("query_id"), tokens(F.col("text")).alias("q")).where(F.size("q") > 0)
    found = adapters.items(spark, SMALL).select(F.col("id").alias("item_id"), tokens(F.col("text")).alias("t"))
    plan = adapters._links_at_words(asked, found)._jdf.queryExecution().optimizedPlan().toString()
    (text,) = set(re.findall(r"doc_id#\d+L?,(text#\d+)", plan))
    assert len(re.findall(rf"regexp_extract_all\(lower\({text}\)", plan)) == 1


@pytest.mark.parametrize("few", [100, 1])
def test_texts_outside_of_all_pools_are_not_ranked(spark, tools, monkeypatch, few):
    """Postings are of the pooled items alone where their ids are few, and the ranking is the same."""
    members = spark.createDataFrame([(0, 2, 3), (0, 2, 5), (1, 2, 5), (1, 2, 9)], "query_id long, pool_size int, item_id long")
    seen, postings = [], ranking.postings
    monkeypatch.setattr(ranking, "FEW", few)
    monkeypatch.setattr(ranking, "postings", lambda items, *rest: seen.append(sorted(r.id for r in items.collect())) or postings(items, *rest))
    got = ranking.bm25_in_pools(asked(spark, "table message", "table"), members, tools, 5).collect()
    assert seen == ([[3, 5]] if few == 100 else [[1, 2, 3, 4, 5]])
    assert sorted((r.query_id, r.item_id, r.rank) for r in got) == [(0, 3, 2), (0, 5, 1), (1, 5, 1)]


def test_own_items_are_left_out_before_distractors_are_shuffled(spark, monkeypatch):
    """Distractors are shuffled once, to fetch their items: no anti-join and no window moves them again."""
    monkeypatch.setattr(pools, "few", lambda df, rows=None: df)
    own = spark.createDataFrame([(q, (q * 7 + k) % 40 + 1, k) for q in range(25) for k in range(q % 12 + 1)] + [(99, 77, 0), (99, 3, 1)], "query_id long, item_id long, position int")
    found = pools.pools(own, spark.range(1, 41).withColumnRenamed("id", "item_id"), (3, 9), 7)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2 and "LeftAnti" not in plan and "Window" not in plan  # one is with the number of items
    rows = found.where("pool_size = 9").collect()
    by = {q: sorted((r.ordinal, r.item_id) for r in rows if r.query_id == q) for q in {r.query_id for r in rows}}
    assert len(by) == 26 and all([o for o, _ in x] == list(range(1, len(x) + 1)) and len({i for _, i in x}) == len(x) for x in by.values())
    assert {q: len(x) for q, x in by.items()} == {q: max(9, q % 12 + 1) for q in range(25)} | {99: 9}
    assert by[99][:2] == [(1, 77), (2, 3)]  # 77 is not in the universe
