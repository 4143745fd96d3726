from __future__ import annotations

import os

import pytest

SF = "/root/testdata/sf0.001"
#: What every operator must stand: null and empty text, only white space, one word, a very long text, repeated rows, marks and controls.
TEXTS = [None, "", " \n\t ", "word", "One two three four five six.", "One two three four five six.", "a  b\tc\n", "x" * 30_000, " ".join(f"w{i}" for i in range(9_000)), "é ß 日本 \x00 ▁ <s> 12345", "don't  stop now", "UPPER lower UPPER lower"]


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("driver tables absent")
    return SF


@pytest.fixture(scope="session")
def odd(spark):
    """Odd texts with further columns whose names operators use themselves."""
    rows = [(i, t, "en" if i % 2 else None, "k", i, 0.5, True) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, keep_id string, row_id int, score double, kept boolean").repartition(3).cache()


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def corpus(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
