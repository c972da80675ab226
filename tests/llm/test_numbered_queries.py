"""The numbered queries against their SQL in DuckDB, and the query of the token cache."""

from __future__ import annotations

import public_tokenizers
import pytest
from oracle import SMALL, expected, rows

from rankyard.llm import queries
from rankyard.llm.chunks import loaded

LARGER = SMALL.replace("0.001", "0.01")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, name):
    found = queries.queries()[name](spark, LARGER)
    columns, wanted = expected(LARGER, queries.oracle_sql()[name])
    assert sorted(found.columns) == sorted(columns)
    assert rows((r.asDict() for r in found.collect()), columns) == rows(wanted, columns)


def test_counts_from_a_cache_of_half_the_texts(spark):
    library = loaded(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = queries.op4_token_counts(spark, SMALL).collect()
    assert len(got) == len(texts)
    for r in got:
        n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 1024)
