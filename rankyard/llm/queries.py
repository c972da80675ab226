"""The numbered queries: each applies its operator, with production parameters, to the whole of its table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, embed_dup, hard_negatives, html_text, kneser_ney, language_id, mixing, near_dup, phrases, sharding, token_cache, token_pack
from .common import scratch


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against a cache that an earlier call over some of them (half of the texts, by digest) has left: stored
    counts are joined, the other texts are encoded and appended."""
    docs, cache = spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch(spark, "token-cache")
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    token_cache.token_counts(docs.where(F.sha2(F.coalesce("text", F.lit("")), 256) < "8"), tokenizer, cache)
    return token_cache.token_counts(docs, tokenizer, cache)


def op5_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(spark.read.parquet(f"{sf_dir}/documents.parquet"), 8)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op7_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.learn_and_score(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op8_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=2, percent=80)


def op9_embedding_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), threshold=0.95)


def op10_token_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_pack.write_and_read(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the vectors whose id is divisible by 100; every seventh label is moved on by one."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = vectors.select(F.col("vec_id").alias("id"), label.alias("label"), hard_negatives.whole(F.col("embedding"), 256).alias("v"), (F.col("vec_id") % 100 == 0).alias("anchor"))
    return hard_negatives.mine(rows, positives=5, negatives=5, low=80, high=100)


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents labelled good weigh 2 and those labelled bad 0.5 in the draw."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    quality = labels.select("doc_id", F.when(F.col("quality") == 1, 2.0).when(F.col("quality") == 0, 0.5).otherwise(1.0).alias("quality"))
    mixed = mixing.mix(docs, weights=(5, 2, 1), most=3, quality=quality)
    return mixed.withColumn("target", F.round("target", 6))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"), least=30, max_words=4, contained=80, most=2000)


def queries() -> dict:
    return {f.__name__: f for f in (op1_bpe_round_trip, op2_decontaminate, op3_language_id, op4_token_counts, op5_jump_shards, op6_html_text, op7_kneser_ney, op8_minhash_near_dup, op9_embedding_near_dup, op10_token_pack, op11_hard_negatives, op12_source_mix, op13_collocations)}


_COMPONENTS = """
step AS (SELECT id AS a, id AS b FROM nodes UNION SELECT s.a, l.b FROM step s JOIN links l ON s.b = l.a),
named AS (SELECT a AS id, min(b) AS component_id FROM step GROUP BY a)"""

#: Every two documents that share a shingle, compared.
NEAR_DUP_SQL = f"""WITH RECURSIVE words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN [w] ELSE list_transform(range(1, len(w)), lambda k: w[k:k + 1]) END) AS s FROM words WHERE len(w) > 0),
sizes AS (SELECT doc_id AS id, count(*) AS n FROM shingles GROUP BY 1),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes p ON p.id = a JOIN sizes q ON q.id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
nodes AS (SELECT doc_id AS id FROM documents), {_COMPONENTS}
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d LEFT JOIN sizes ON sizes.id = d.doc_id JOIN named ON named.id = d.doc_id"""

#: Every two vectors, compared.
EMBED_DUP_SQL = f"""WITH RECURSIVE vectors AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
usable AS (SELECT * FROM vectors WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
level AS (SELECT id, list_transform(v, lambda x: x / list_max(list_transform(v, lambda y: abs(y)))) AS v FROM usable),
unit AS (SELECT id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM level),
links AS (SELECT x.id AS a, y.id AS b FROM unit x JOIN unit y ON x.id <> y.id AND len(x.v) = len(y.v) WHERE list_dot_product(x.v, y.v) >= 0.95),
nodes AS (SELECT id FROM vectors), {_COMPONENTS}
SELECT n.id AS vec_id, (SELECT count(*) FROM links WHERE a = n.id) AS n_links, component_id, n.id = component_id AS kept FROM nodes n JOIN named USING (id)"""


#: Every anchor against every vector.
HARD_NEGATIVES_SQL = """WITH usable AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.id AS anchor_id, r.id AS id, a.label = r.label AS same, list_dot_product(a.v, r.v)::BIGINT AS score FROM usable a JOIN usable r ON a.id % 100 = 0 AND a.id <> r.id AND len(a.v) = len(r.v)),
positives AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
negatives AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS rank FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 5"""

#: The limits that hold are found by taking sources in order of their limit for a unit of weight.
MIX_SQL = """WITH sized AS (SELECT d.doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, coalesce(q, 1.0)::DOUBLE AS worth
  FROM documents d LEFT JOIN (SELECT doc_id, max(CASE quality WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 ELSE 1.0 END) AS q FROM labels GROUP BY 1) USING (doc_id)),
keyed AS (SELECT *, -ln((('0x' || md5('42:' || doc_id)[1:13])::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE) / worth AS key FROM sized),
sources AS (SELECT source, sum(size)::BIGINT AS source_size, ([5, 2, 1])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM sized GROUP BY 1),
shares AS (SELECT *, 3 * source_size AS most, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest, sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM sources WINDOW o AS (ORDER BY 3 * source_size / weight, source NULLS LAST)),
levels AS (SELECT max(rest::DOUBLE / weights) AS level FROM shares WHERE weight * rest::DOUBLE / weights <= most),
targets AS (SELECT source, source_size, least(most::DOUBLE, weight * (SELECT level FROM levels)) AS target FROM shares),
drawn AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-12) ELSE 0 END AS epochs, sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS after FROM keyed k JOIN targets t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, round(target, 6) AS target, (size * (epochs + CASE WHEN 2 * after - size <= 2 * (target - epochs * source_size) THEN 1 ELSE 0 END))::BIGINT AS taken, (CASE WHEN size = 0 THEN epochs ELSE epochs + CASE WHEN 2 * after - size <= 2 * (target - epochs * source_size) THEN 1 ELSE 0 END END)::INT AS copies FROM drawn"""

COLLOCATIONS_SQL = """WITH lowered AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM lowered),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY 1),
runs AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM words CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS k)),
counts AS (SELECT lang, k, phrase, count(*) AS f FROM runs GROUP BY ALL),
phrases AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE k > 1 AND f >= 30),
cuts AS (SELECT *, unnest(range(1, k)) AS cut FROM phrases),
parts AS (SELECT c.lang, c.k, c.phrase, a, cut, l.f AS l, r.f AS r, (2000000::HUGEINT * a) // (l.f + r.f) AS score FROM cuts c JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(w[1:cut], ' ') JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(w[cut + 1:], ' ')),
weakest AS (SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
free AS (SELECT * FROM weakest x WHERE NOT EXISTS (SELECT 1 FROM phrases y WHERE y.lang = x.lang AND y.k > x.k AND 100 * y.a >= 80 * x.a AND contains(' ' || y.phrase || ' ', ' ' || x.phrase || ' '))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM free)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can express the rows: by brute force, for tables of the size of its check."""
    return {"op8_minhash_near_dup": NEAR_DUP_SQL, "op9_embedding_near_dup": EMBED_DUP_SQL, "op11_hard_negatives": HARD_NEGATIVES_SQL, "op12_source_mix": MIX_SQL, "op13_collocations": COLLOCATIONS_SQL}
