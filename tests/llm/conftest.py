from __future__ import annotations

import pytest

from auditframe.llm.base import table

SMALL = "/root/testdata/sf0.001"
#: Columns whose names the operators use inside.
DDL = "doc_id long, text string, lang string, source string, n_chars long, row long, set_id long, _id long, label int, term string, kind string, _identity string"


@pytest.fixture(scope="session")
def edge(spark):
    """NULLs in every column, empty texts, a very long one, repeated rows, and clashing names."""
    tail = ("en", "s", 1, 7, 7, 7, 1, "x", "y", "z")
    words = " ".join(f"word{k % 977}x{k}" for k in range(30_000))
    rows = [
        (1, "a plain text of some seven words", *tail), (2, None, *tail), (3, "", *tail), (4, " \t\n ", *tail), (5, words, *tail),
        (1, "a plain text of some seven words", *tail), (6, "A plain  text of some\tseven words", *tail), (None, "a row without an id", *[None] * 10), (7, "one", *tail),
        (None, None, *[None] * 10), (8, "x" * 100_000, *tail), (9, words, *tail), (10, "Ünïcode “quotes” 語 🙂 and a.b@c.de", *tail),
    ]
    return spark.createDataFrame(rows, DDL)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DDL)


@pytest.fixture(scope="session")
def documents(spark):
    return table(spark, SMALL, "documents")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}
