from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from regionlens.functions.text import comma
from regionlens.operators import ranking
from regionlens.operators.ranking import ascending, descending


@pytest.fixture(scope="module")
def uneven(spark):
    """One group with two thirds of 3,000 rows, a null group, and many small ones."""
    group = F.when(F.col("id") % 3 < 2, F.lit("hot")).when(F.col("id") % 30 == 2, F.lit(None)).otherwise(
        F.concat(F.lit("g"), (F.col("id") % 97).cast("string"))
    )
    return spark.range(0, 3000, numPartitions=7).select(group.alias("g"), ((F.col("id") * 7919) % 3001).alias("v"), "id")


@pytest.mark.parametrize("by", [["g"], []])
def test_ordinal_numbers_every_group_from_one(uneven, by):
    rows = ranking.ordinal(uneven, [ascending("v"), ascending("id")], by, "place", size="of").collect()
    groups = {}
    for row in rows:
        groups.setdefault(row.g if by else "", []).append(row)
    assert len(rows) == 3000
    for members in groups.values():
        members.sort(key=lambda r: r.place)
        assert [r.place for r in members] == list(range(1, len(members) + 1))
        assert [(r.v, r.id) for r in members] == sorted((r.v, r.id) for r in members)
        assert {r["of"] for r in members} == {len(members)}


def test_ordinal_splits_a_hot_group(spark, uneven):
    """The rows of the hot group lie in several slices, so that no task holds them all."""
    previous = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranged = uneven.repartitionByRange(8, F.col("g"), F.col("v"))
        slices = ranged.where(F.col("g") == "hot").select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", previous)
    assert slices > 3


def test_ordinal_in_groups(uneven):
    order = [descending("v"), ascending("id")]
    large = {(r.id, r.place) for r in ranking.ordinal(uneven, order, ["g"], "place").collect()}
    small = {(r.id, r.place) for r in ranking.rank_in_domain(uneven, order, ["g"], "place").collect()}
    assert large == small


def test_top_rows_is_a_prefix_of_the_full_order(uneven):
    order = [descending("v"), ascending("id")]
    full = {(r.id, r["rank"]) for r in ranking.top_rows(uneven, order, None).collect()}
    top = {(r.id, r["rank"]) for r in ranking.top_rows(uneven, order, 20).collect()}
    assert top == {pair for pair in full if pair[1] <= 20}
    for n in (5, 1000, 1001, None):
        assert dict(ranking.top_rows(uneven, order, n).dtypes)["rank"] == "bigint"
    assert {dict(ranking.page(uneven, order, k).dtypes)["row"] for k in (1, 101)} == {"bigint"}


def test_pages_tile_the_table(uneven):
    order = [ascending("id")]
    pages = [[r.id for r in ranking.page(uneven, order, n).orderBy("row").collect()] for n in (1, 2, 3)]
    assert pages == [list(range(0, 10)), list(range(10, 20)), list(range(20, 30))]


def test_unknown_values_sort_last(spark):
    frame = spark.createDataFrame([("a", 1.0), ("b", None), ("c", 3.0), ("d", 3.0)], "name string, v double")
    board = ranking.leaderboard(frame, "name", "v", comma(F.col("v")), 3).orderBy("rank").collect()
    assert [(r.name, r.caption) for r in board] == [("c", "c — 3"), ("d", "d — 3"), ("a", "a — 1")]


def test_top_rows_differ_from_top_items(spark):
    rows = [("z", "a", 1, 9), ("z", "a", 2, 9), ("z", "b", 1, 5), ("z", "c", 1, 2)]
    frame = spark.createDataFrame(rows, "zone string, title string, ed int, total int")
    order = [descending("total"), ascending("title")]
    assert ranking.top_rows_per_group(frame, [*order, ascending("ed")], ["zone"], 2).count() == 2
    assert ranking.top_items_per_group(frame, order, ["zone"], 2).count() == 3
    assert ranking.top_items_per_group(frame, order, ["zone"], None).count() == 4


def test_items_are_ranked_by_their_largest_row(spark):
    rows = [("g", "many small", 3), ("g", "many small", 3), ("g", "many small", 3), ("g", "one large", 5), ("h", "other", 20)]
    frame = spark.createDataFrame(rows, "g string, item string, v int")
    ranked = ranking.rank_groups_and_items(frame, "g", "item", "v").collect()
    assert {(r.g, r.group_rank) for r in ranked} == {("h", 1), ("g", 2)}
    assert {(r.item, r.item_rank) for r in ranked if r.g == "g"} == {("one large", 1), ("many small", 2)}


def test_shares_add_up_to_one(spark):
    frame = spark.createDataFrame([("a", 1), ("a", 3), ("b", 0)], "g string, v int")
    shared = ranking.share_of_group(frame, "v", ["g"]).collect()
    assert sorted((r.g, r.v, r.share) for r in shared if r.g == "a") == [("a", 1, 0.25), ("a", 3, 0.75)]
    assert [r.share for r in shared if r.g == "b"] == [None]


def test_mean_and_median_order(spark):
    frame = spark.createDataFrame([("a", 1), ("a", 1), ("a", 100), ("b", 10)], "item string, v int")
    got = {r.item: (r.mean_order, r.median_order) for r in ranking.order_by_summary(frame, "item", "v").collect()}
    assert got == {"a": (2, 1), "b": (1, 2)}


def test_long_top_lists_are_not_one_task(uneven, monkeypatch):
    order = [descending("v"), ascending("id")]
    want = {(r.id, r["rank"]) for r in ranking.top_rows(uneven, order, 500).collect()}
    monkeypatch.setattr(ranking, "LISTED", 100)
    deep = ranking.top_rows(uneven, order, 500)
    assert {(r.id, r["rank"]) for r in deep.collect()} == want
    assert "Limit" not in deep._jdf.queryExecution().executedPlan().toString()


def test_offsets_of_many_groups_are_not_broadcast(uneven, monkeypatch):
    monkeypatch.setattr(ranking, "BROADCAST_OFFSETS", 0)
    order = [ascending("v"), ascending("id")]
    got = {(r.id, r.place) for r in ranking.ordinal(uneven, order, ["g"], "place").collect()}
    assert got == {(r.id, r.place) for r in ranking.rank_in_domain(uneven, order, ["g"], "place").collect()}


def test_median_of_a_hot_key(spark):
    """One item holds nine tenths of the rows, another one number many times, one no known value."""
    x = F.when(F.col("id") % 10 < 9, F.lit("hot")).when(F.col("id") % 100 == 9, "same").when(F.col("id") % 100 == 19, "none").otherwise(F.lit(None))
    value = F.when(F.col("x") == "same", 5.0).when(F.col("x") == "none", None).otherwise(F.pow((F.col("id") * 7919) % 50_021, F.lit(3)))
    rows = spark.range(0, 40_001, numPartitions=6).select(x.alias("x"), "id").withColumn("v", value.cast("double")).drop("id")
    want = {r.x: (r.m, r.a) for r in rows.groupBy("x").agg(F.median("v").alias("m"), F.avg("v").alias("a")).collect()}
    got = {r.x: (r.median_value, r.mean_value) for r in ranking.mean_and_median(rows, ["x"], "v").collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert got["hot"][1] == pytest.approx(want["hot"][1]) and got["none"] == (None, None)
    few = spark.createDataFrame([("a", 1), ("a", 2), ("b", 7), (None, 3)], "x string, v int")
    assert {r.x: r.median_value for r in ranking.mean_and_median(few, ["x"], "v").collect()} == {"a": 1.5, "b": 7.0, None: 3.0}


def test_order_of_groups_and_items(spark):
    rows = [("z", "A", "a1", 5, 30), ("z", "A", "a2", 9, 30), ("z", "B", "b1", 9, 31), ("z", "B", "b1", 9, 31), (None, "A", "a1", 1, 1), (None, "C", "c", 1, 1)]
    frame = spark.createDataFrame(rows, "zone string, g string, i string, item_total int, group_total int")
    got = {(r.zone, r.g, r.i): (r.group_rank, r.item_rank) for r in ranking.order_groups_and_items(frame, "g", "i", ["zone"]).collect()}
    assert got == {("z", "A", "a1"): (2, 2), ("z", "A", "a2"): (2, 1), ("z", "B", "b1"): (1, 1), (None, "A", "a1"): (1, 1), (None, "C", "c"): (2, 1)}
    assert ranking.order_groups_and_items(frame, "g", "i", ["zone"]).count() == len(rows)
