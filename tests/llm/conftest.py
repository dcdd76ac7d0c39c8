from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text) pairs."""

    def make(rows, partitions=3):
        full = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows]
        return spark.createDataFrame(full, DOCS).repartition(partitions)

    return make


@pytest.fixture
def table(spark):
    """A folder of the test tables as (doc_id, text) rows."""
    folder = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    return folder, rows


#: Texts that operators must survive: null, empty, white space, very long, repeated, odd characters.
ODD = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "word"),
    (5, "a " * 60_000),
    (6, "ſecret KKey   x y éé 𝔘𝔫𝔦 \x00 end"),
    (None, "no id at all " * 30),
    (7, "same text here, twice over and over again " * 9),
    (7, "same text here, twice over and over again " * 9),
    (9, "x" * 200_000),
]
