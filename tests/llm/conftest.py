"""A small table of documents with every awkward row: nulls, empties, copies, clashing columns."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that the operators use for columns of their own.
        *[T.StructField(c, T.StringType()) for c in ("size", "class", "row", "part", "block", "score", "queue", "ids", "label", "node")],
    ]
)


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


WORDS = [a + b + c for a in "brtskl" for b in ("a", "en", "io") for c in ("d", "st", "ng", "r")]


def rows_of_documents(seed: int = 7, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    texts: list[str | None] = [prose(rng, rng.choice((3, 30, 80, 200))) for _ in range(n)]
    near = texts[5].split(" ") if len(texts[5].split(" ")) > 60 else prose(rng, 150).split(" ")
    texts[5] = " ".join(near)
    for k in range(4):  # near copies, each with another word changed
        copy = list(near)
        copy[3 + k] = "changed"
        texts.append(" ".join(copy))
    texts += [texts[5], texts[5], None, "", " \t\n ", "one two", "two one", "one two", texts[9].replace(" ", "\n"), "ab" * 300, "é" * 90 + " Ω " + "é" * 90]
    texts.append(prose(rng, 6000))
    shared = prose(rng, 40)
    texts += [prose(rng, 20) + " " + shared + " " + prose(rng, 20) for _ in range(3)]
    rows = []
    for i, t in enumerate(texts):
        source = None if i % 11 == 0 else f"s{i % 4 if i % 3 else 0}"
        rows.append((i, t, "en", source, len(t or ""), *["x"] * 10))
    return rows


@pytest.fixture(scope="session")
def document_rows():
    return rows_of_documents()


@pytest.fixture(scope="session")
def documents(spark, document_rows):
    return spark.createDataFrame(document_rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Rows of one id, a null id, a row that comes twice."""
    rng = random.Random(3)
    text = prose(rng, 120)
    values = [(1, text), (1, text), (1, prose(rng, 50)), (None, prose(rng, 40)), (None, None), (2, text + " more"), (-3, "z")]
    return spark.createDataFrame([(i, t, None, None, None, *[None] * 10) for i, t in values], DOCS)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOCS)

