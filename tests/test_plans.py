"""What the plans must look like at scale."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from feedlift.operators import export, joins, selection
from feedlift.operators.answers import first_answers
from feedlift.operators.state import merge_answers
from feedlift.plans.enrich import join_column
from feedlift.sources import feeds
from feedlift.sources.tables import BucketedRows
from tests.conftest import plan_of

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def lines(spark):
    return spark.read.parquet(f"{FOLDER}/lineitem.parquet")


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def read_schemas(plan):
    return re.findall(r"ReadSchema: struct<([^>]*)>", plan)


def test_range_selection_is_one_scan_with_scalar_bounds(lines):
    kept = selection.mid_range(lines, "l_quantity").select("l_orderkey")
    plan = plan_of(kept)
    assert "Join" not in plan
    assert set(read_schemas(plan)) == {"l_orderkey:bigint,l_quantity:double", "l_quantity:double"}


def test_id_lists_reach_the_scan(lines):
    plan = plan_of(selection.by_ids(lines, [1, 2], "l_orderkey").select("l_orderkey"))
    assert "In(l_orderkey, [1,2])" in plan
    assert read_schemas(plan) == ["l_orderkey:bigint"]


def test_pending_rows_are_filtered_in_the_scan(spark, tmp_path):
    selection.init_state(spark.range(10)).write.parquet(str(tmp_path / "s"))
    plan = plan_of(selection.pending(spark.read.parquet(str(tmp_path / "s")), "title").select("id"))
    assert "IsNull(title)" in plan and "LessThan(tries,3)" in plan
    assert "description" not in read_schemas(plan)[0]


@pytest.mark.parametrize("size", [100, 5000])
def test_batches_of_any_size_are_a_filter(lines, size):
    ids = lines.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"))
    batch = selection.random_batch(ids, size, 1)
    assert "Exchange" not in plan_of(batch) and "Sort" not in plan_of(batch)
    assert batch.count() == size


def test_building_a_join_starts_no_job(spark, lines):
    feed = lines.select(F.col("l_orderkey").cast("string").alias("id"), F.lit("u/a.png").alias("image_link"))
    texts = lines.select(F.col("l_partkey").cast("string").alias("id"), F.lit("x").alias("content"))
    images = lines.select(F.lit("g/a.png").alias("uri"), F.lit("d").alias("description"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "plans only")
    try:
        joins.join_page_texts(feed, texts)
        joins.join_images_by_name(feed, images)
        joins.join_images_containing(feed, images)
        export.full_feed(feed.withColumn("title", F.lit("t")).withColumn("description", F.lit("d")), selection.init_state(feed))
        join_column(feed, texts.withColumnRenamed("content", "colour"), "colour")
        assert not tracker.getJobIdsForGroup("building")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_each_link_is_sent_once_for_a_block_of_names(spark, monkeypatch):
    link = "https://shop.example/" + "abcdefgh/" * 12 + "img_1.jpg"
    feed = spark.range(50).select("id", F.concat(F.lit(link), F.col("id") % 10).alias("image_link"))
    names = [(f"gs://b/{'n' * k}{k}.png", "d") for k in range(9, 50)]
    images = spark.createDataFrame([*names, ("gs://b/img_1.jpg", "hit")], "uri string, description string")
    found = joins.join_images_containing(feed, images)
    assert [r.image_description for r in found.collect()] == ["hit"] * 50
    distinct = feed.select(F.col("image_link").alias("_link")).distinct()
    monkeypatch.setattr(joins, "_NAMES", 10)
    sent = joins._candidates(distinct, images.select(F.col("uri").alias("_name")))
    assert plan_of(sent).count("MapInArrow") == 1 and "NestedLoop" not in plan_of(sent)


def test_a_part_is_read_from_its_own_folders(spark, tmp_path):
    stored = BucketedRows(spark, str(tmp_path / "parts"), 8)
    stored.create(spark.range(500).select(F.col("id").cast("string").alias("id")))
    part = stored.part(4, 1)
    assert re.search(r"PartitionFilters: \[.*bucket.*% 4.*= 1", plan_of(part))
    folders = {r.f.split("bucket=")[1].split("/")[0] for r in part.select(F.input_file_name().alias("f")).distinct().collect()}
    assert folders == {"1", "5"}
    assert sum(stored.part(4, p).count() for p in range(4)) == 500


def test_page_text_files_are_split(spark, tmp_path):
    rows = spark.range(20_000).select("id", F.repeat(F.lit("text "), 40).alias("content")).coalesce(1)
    feeds.write_page_texts(rows, str(tmp_path / "p"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        assert feeds.read_page_texts(spark, str(tmp_path / "p")).rdd.getNumPartitions() > 5
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_merge_shuffles_each_side_once(spark, no_broadcast):
    """The answers are aggregated and joined in one partitioning by id."""
    state = selection.init_state(spark.range(1000))
    generated = spark.range(100).select(
        F.col("id").alias("chunk_id"),
        F.array(F.col("id").cast("string")).alias("ids"),
        F.concat("id", F.lit(": x")).alias("response"),
    )
    plan = plan_of(merge_answers(state, first_answers(generated), "title"))
    assert plan.count("Exchange hashpartitioning") == 2
    assert "SortMergeJoin" in plan and "SinglePartition" not in plan


def test_supplemental_feed_needs_no_shuffle(spark):
    assert "Exchange" not in plan_of(export.supplemental_feed(selection.init_state(spark.range(9))))


def test_full_feed_joins_by_key(spark, no_broadcast):
    raw = spark.range(9).select(
        F.col("id").cast("string"), F.lit("t").alias("title"), F.lit("d").alias("description")
    )
    plan = plan_of(export.full_feed(raw, selection.init_state(spark.range(9))))
    assert "SortMergeJoin" in plan and "NestedLoop" not in plan
