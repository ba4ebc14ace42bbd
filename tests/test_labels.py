from __future__ import annotations

from pyspark.sql import functions as F

from regionlens.operators import labels
from regionlens.operators.aggregates import units_with_many_names
from regionlens.operators.skew import hot_keys, look_up_spread


def test_dominant_city(spark):
    rows = [
        (1, "solo", 10.0),
        (2, "big", 20.0), (2, "half", 10.0),
        (3, "first", 100.0), (3, "second", 80.0), (3, "third", 79.0),
        (4, "zero b", 0.0), (4, "zero a", 0.0),
        (5, "tie b", 50.0), (5, "tie a", 50.0),
        (6, "known", 5.0), (6, "unknown", None),
        (7, "unknown", None),
    ]
    frame = spark.createDataFrame(rows, "zone_code int, city string, population double")
    got = {r.zone_code: r.zone for r in labels.dominant_city_label(frame).collect()}
    assert got == {1: "solo", 2: "big", 3: "first & second", 4: "zero a", 5: "tie a & tie b", 6: "known"}


def test_county_list(spark):
    rows = [(1, "Lee Co., GA"), (1, "Lee Co., GA"), (2, "b"), (2, "a"), (3, None), (4, "a"), (4, None)]
    frame = spark.createDataFrame(rows, "zone_code int, county_name string")
    got = {r.zone_code: r.zone for r in labels.county_list_label(frame).collect()}
    assert got == {1: "County: Lee Co., GA", 2: "Counties: a, b", 3: None, 4: "Counties: a"}


def test_chain_and_dedupe(spark):
    zones = spark.createDataFrame([(1,), (2,), (3,), (4,), (4,)], "zone_code int")
    city = spark.createDataFrame([(1, "Erie, PA"), (2, "Erie, PA")], "zone_code int, zone string")
    county = spark.createDataFrame([(1, "County: x"), (3, "County: y"), (4, None)], "zone_code int, zone string")
    chain = labels.label_chain(zones, city, county)
    assert {(r.zone_code, r.zone) for r in chain.collect()} == {(1, "Erie, PA"), (2, "Erie, PA"), (3, "County: y"), (4, "CZ 4")}
    unique = labels.dedupe_labels(chain).collect()
    assert {(r.zone_code, r.zone) for r in unique} == {(1, "Erie, PA (CZ 1)"), (2, "Erie, PA (CZ 2)"), (3, "County: y"), (4, "CZ 4")}


def test_latest_name_replaces_history(spark):
    rows = [(1, "old", 2010), (1, "old", 2011), (1, "b", 2012), (1, "a", 2012), (2, "only", 2010), (3, "x", 2012), (3, "y", 2012), (3, "y", 2012), (4, "z", None)]
    frame = spark.createDataFrame(rows, "unitid int, entity string, year int")
    assert {r.unitid for r in units_with_many_names(frame, "unitid", "entity").collect()} == {1, 3}
    renamed = labels.use_latest_name(frame, "unitid", "entity", "year")
    assert renamed.columns == frame.columns
    assert {(r.unitid, r.entity) for r in renamed.collect()} == {(1, "a"), (2, "only"), (3, "y"), (4, None)}
    assert renamed.count() == len(rows)
    assert units_with_many_names(renamed, "unitid", "entity").count() == 0


def test_largest_zone_per_label(spark):
    rows = [("a", 1, 5.0), ("a", 1, 6.0), ("a", 2, 10.0), ("b", 4, 1.0), ("b", 3, 1.0), (None, 9, 1.0), ("c", 5, None)]
    frame = spark.createDataFrame(rows, "zone string, zone_code int, population double")
    assert {(r.zone, r.zone_code) for r in labels.largest_zone_per_label(frame).collect()} == {("a", 1), ("b", 3), ("c", 5)}


def test_spread_lookup_equals_plain_join(spark):
    fact = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 100 == 1, F.lit(None)).otherwise(F.col("id") % 1000).cast("long").alias("k"), "id"
    )
    side = spark.range(0, 900).select(F.col("id").alias("k"), (F.col("id") * 2).alias("double"))
    counts = fact.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    hot = hot_keys(counts, "k", "n", 0.1)
    assert [r.k for r in hot.collect()] == [7]
    spread = look_up_spread(fact, side, "k", hot, ["id"])
    plain = fact.join(side, "k", "left")
    assert sorted(map(str, spread.select("id", "k", "double").collect())) == sorted(map(str, plain.select("id", "k", "double").collect()))


def test_spread_lookup_uses_many_partitions(spark):
    """The hot key's rows reach the join in more than one partition."""
    fact = spark.range(6000).select(F.lit(7).cast("long").alias("k"), "id")
    side = spark.createDataFrame([(7, "seven")], "k long, name string")
    hot = spark.createDataFrame([(7,)], "k long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = look_up_spread(fact, side, "k", hot, ["id"])
        assert joined.select(F.spark_partition_id()).distinct().count() > 1
        assert joined.where(F.col("name") == "seven").count() == 6000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_short_keys(spark):
    alike = "x" * labels.KEY_CHARS
    texts = ["a", "b" * 500, "b" * 499 + "a", alike, alike + "b", alike + "a", alike + "a", "County: y", "z" * 41, None]
    keyed = labels.short_keys(spark.createDataFrame(list(enumerate(texts)), "zone_code int, zone string")).collect()
    assert max(len(r._key) for r in keyed if r.zone) <= labels.KEY_CHARS + 42
    assert all(r._key == r.zone for r in keyed if r.zone is None or len(r.zone) <= labels.KEY_CHARS)
    pairs = sorted({(r.zone, r._key) for r in keyed if r.zone})
    assert len(pairs) == len({key for _, key in pairs}) == 8  # equal texts have equal keys, others do not
    assert [key for _, key in pairs] == sorted(key for _, key in pairs)
    renamed = labels.short_keys(spark.createDataFrame([(1, alike + "c")], "zone_code int, zone string")).first()
    assert renamed._key not in {key for _, key in pairs}
