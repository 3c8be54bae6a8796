from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, shard int, n_words string, slot string, component_id string, kept string, n string, a string"


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice(["ba", "ko", "ri", "tu", "en", "É", "ß"]) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def edge_rows() -> list[tuple]:
    """Nulls in every column, empty and long texts, ties, repeated rows."""
    rng = random.Random(5)
    long = " ".join(words(rng, 20000))
    texts = [None, "", " \n\t ", "one", "One TWO", "one two", long, long + " end", "a b c d e f", "A B C D E F", "日本 語 \U0001f600 x", "x" * 70000, "&|<>#*$% a\na\na\nb", "nul space b"]
    texts += [" ".join(words(rng, 120)) for _ in range(6)]
    rows = [(i, t, "en" if i % 3 else None, f"src{i % 3}" if i % 4 else None, len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[3], rows[14], (90, texts[14], "en", "src1", 1), (91, texts[14], "de", "other", None), (None, "null id text here now", None, None, None), (None, None, None, None, None)]
    return [(*r, 7, "x", "y", "z", "k", None, None) for r in rows]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
