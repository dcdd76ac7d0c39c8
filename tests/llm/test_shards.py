from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from feedlift.llm import shards
from feedlift.llm.queries import ORDER_KEY, QUERIES
from tests.llm import brute
from tests.llm.conftest import ODD


@pytest.mark.parametrize("n", [1, 2, 3, 10, 255, 256, 257, 5000])
def test_permutation(n):
    p = shards.Permutation(n, 42)
    slots = p.slots(np.arange(n))
    assert sorted(slots) == list(range(n))
    assert list(p.numbers(slots)) == list(range(n))
    if n > 100:
        assert (shards.Permutation(n, 43).slots(np.arange(n)) != slots).mean() > 0.9
        assert abs(np.corrcoef(slots, np.arange(n))[0, 1]) < 0.2


def _contents(folder, rows, stride, width=1):
    """Ids of every sequence, read back record by record."""
    out = {}
    for shard in {r.shard for r in rows}:
        records = list(shards.read_records(folder, shard, 0, stride, width))
        assert all(len(x) == stride for x in records)
        data = np.concatenate(records)
        mine = sorted((r for r in rows if r.shard == shard), key=lambda r: r.slot)
        at = 0
        for r in mine:
            assert (r.place, r.record) == (at, at // stride)
            out[r.slot] = data[r.place : r.place + r.n_ids]
            at += r.n_ids + 1
            assert data[at - 1] == (1 << 8 * width) - 1
        assert len(data) - at < stride
        assert [r.n_records for r in mine if r.n_records is not None] == [len(records)]
        k = len(records) // 2
        assert (np.concatenate(list(shards.read_records(folder, shard, k, stride, width))) == data[k * stride :]).all()
    return out


def test_whole_table(spark, table):
    folder, rows = table
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    where, written = shards.materialise_order(docs, ORDER_KEY, stride=512, shards=5)
    got = written.collect()
    assert sorted(r.slot for r in got) == list(range(len(rows)))
    assert len({r.shard for r in got}) == 5
    texts, contents = dict(rows), _contents(where, got, 512)
    for r in got:
        assert contents[r.slot].tobytes() == (texts[r.doc_id] or "").encode()
        assert r.ids_sha256 == brute.sha(texts[r.doc_id] or "")
    again, rewritten = shards.materialise_order(docs, ORDER_KEY, stride=512, shards=5)
    digest = lambda rows: sorted((r.file, r.file_sha256) for r in rows if r.file_sha256)
    assert digest(rewritten.collect()) == digest(got)


def test_query(spark, table):
    folder, rows = table
    got = QUERIES["op4_training_order"](spark, folder).collect()
    assert {(r.doc_id, r.ids_sha256) for r in got} == {(i, brute.sha(t or "")) for i, t in rows}


def test_odd_texts_and_frames_without_files(docs):
    frame = docs(ODD).withColumnsRenamed({"lang": "slot", "source": "number", "n_chars": "file"})
    where, written = shards.materialise_order(frame, 1, stride=1000, shards=3)
    got = written.collect()
    assert len(got) == len(ODD)
    contents = _contents(where, got, 1000)
    assert sorted(bytes(v.tobytes()) for v in contents.values()) == sorted((t or "").encode() for _, t in ODD)
    assert shards.materialise_order(docs([], 1), 1)[1].count() == 0


def test_wider_ids(docs):
    def wide(text: pa.Array) -> pa.Array:
        return pa.array([np.array([ord(c) for c in t.as_py()], np.uint16).tobytes() for t in text], pa.binary())

    ids = F.arrow_udf(wide, "binary")("text")
    where, written = shards.materialise_order(docs([(1, "añb"), (2, "漢字")]), 3, 16, 1, ids, 2, 0xFFFF, 0xFFFE)
    contents = _contents(where, written.collect(), 16, 2)
    assert sorted("".join(map(chr, v)) for v in contents.values()) == ["añb", "漢字"]


def test_frames_that_are_part_of_parquet_files(spark, tmp_path):
    spark.range(200).selectExpr("id AS doc_id", "concat('text ', id) AS text").repartitionByRange(4, "doc_id").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    kept = docs.filter("doc_id % 3 = 0")
    for frame, n in ((kept, 67), (kept.select("text", "doc_id"), 67), (docs.limit(50), 50), (docs.unionByName(kept), 267), (docs.withColumn("x", F.lit(1)), 200)):
        first, again = ([(r.slot, r.doc_id) for r in shards.materialise_order(frame, 8, 64, 3)[1].collect()] for _ in range(2))
        assert sorted(s for s, _ in first) == list(range(n))
        assert sorted(first) == sorted(again)
