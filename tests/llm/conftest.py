from __future__ import annotations

import pytest

LONG = "wort " * 30_000 + "x" * 50_000
TEXTS = [
    "The cat sat on the mat, and the dog barked at the cat. It's a fine day!",
    "The cat sat on the mat, and the dog barked at the cat. It's a fine day!",
    None,
    "",
    " \n\t ",
    "!!! 123",
    "Der Hund bellt die Katze an, und die Katze schläft auf der Matte.\n\nEnde.",
    "Le chien aboie après le chat; le chat dort sur le tapis, où il rêve.",
    "<|endoftext|> inside <|startoftext|>text<|endoftext|>",
    "one",
    LONG,
    "naïve café — Ωmega Σς İstanbul 漢字 🙂 line\x1csep\xa0nbsp",
]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, empty and very long texts, repeated rows and columns of clashing names."""
    rows = [(k, t, "de" if t and t.startswith("Der") else "fr" if t and t.startswith("Le") else "en", "s", t, 1.0) for k, t in enumerate(TEXTS)]
    rows += [rows[0], (None, "a row without id", None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, id string, score double").repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
