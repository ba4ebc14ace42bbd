from __future__ import annotations

import json
from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from regionlens import session
from regionlens.plans.facts import Tables
from regionlens.sources import readers, writers


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_csv_nulls(spark, tmp_path):
    (tmp_path / "t.csv").write_text("year,share\n2010,0.5\n2011,NA\n")
    rows = readers.read_csv(spark, str(tmp_path / "t.csv"), "year int, share double").collect()
    assert [tuple(r) for r in rows] == [(2010, 0.5), (2011, None)]


def test_prepared_table_or_fallback(spark, tmp_path):
    built = spark.createDataFrame([("computed",)], "v string")
    path = str(tmp_path / "prepared")
    read = lambda: spark.read.schema("v string").option("header", True).csv(path)
    assert readers.read_or_build(read, lambda: built).first().v == "computed"
    writers.write_csv(spark.createDataFrame([("prepared",)], "v string"), path)
    assert readers.read_or_build(read, lambda: built).first().v == "prepared"
    with pytest.raises(Exception):
        readers.read_or_build(lambda: built.select("no_such_column"), lambda: built)


def test_resolve_column(spark):
    frame = spark.createDataFrame([(1, 2)], "Zone_Label int, Year int")
    assert readers.resolve_column(frame, ["zone", "ZONE_LABEL", "year"]) == "Zone_Label"
    assert readers.resolve_column(frame, ["nothing"]) is None


def test_year_choice(spark):
    frame = spark.createDataFrame([(2000,), (2001,)], "year int")
    counts = {c: frame.where(readers.year_choice(c)).count() for c in (None, "All Years", "2001", 2001, "abc")}
    assert counts == {None: 2, "All Years": 2, "2001": 1, 2001: 1, "abc": 0}


def test_partitions_are_pruned(spark, tmp_path):
    path = str(tmp_path / "by_year")
    frame = spark.range(3000).select(F.col("id"), (F.when(F.col("id") % 3 < 2, 2020).otherwise(2021)).alias("year"))
    writers.write_partitions(frame, path, "year", sort=["id"])
    assert sorted(p.name for p in Path(path).glob("year=*")) == ["year=2020", "year=2021"]
    back = readers.read_partitions(spark, path, year=2021)
    assert back.count() == 1000
    assert "PartitionFilters: [isnotnull(year" in plan(back)


def test_filters_and_columns_reach_the_scan(spark, folder):
    lines = Tables(spark, folder).read("lineitem")
    text = plan(lines.where(readers.in_year(F.col("l_shipdate"), 1997)).select("l_suppkey"))
    assert "GreaterThanOrEqual(l_shipdate,1997-01-01T00:00)" in text and "LessThan(l_shipdate,1998" in text
    assert "ReadSchema: struct<l_suppkey:bigint,l_shipdate:timestamp_ntz>" in text


def test_named_table(spark):
    assert readers.named_table(spark.range(3), "three_rows").count() == 3


def test_display_names_and_dated_export(spark, tmp_path):
    frame = spark.createDataFrame([("a", 0.1234, 7)], "entity string, focus_share double, n int").coalesce(1)
    shown = writers.display_table(frame, {"entity": "Institution", "focus_share": "Focus%"}, ["focus_share"])
    path = writers.export_csv(shown, str(tmp_path), date(2024, 5, 1))
    assert path.endswith("/date=2024-05-01")
    text = next(Path(path).glob("part-*.csv")).read_text()
    assert text == "Institution,Focus%\na,12.34\n"
    assert writers.column_first(frame, "n", "N").columns == ["N", "entity", "focus_share"]
    assert writers.readable_names(frame, {"ENTITY": "E", "absent": "x"}).columns == ["E", "focus_share", "n"]


def test_feature_collections_are_valid_documents(spark, tmp_path):
    """The part files of a year, in name order, are one GeoJSON document."""
    path = str(tmp_path / "points")
    rows = spark.range(500).select(
        F.when(F.col("id") % 5 == 0, 2020).otherwise(2021).alias("year"),
        F.concat(F.lit('na"me, ]} '), F.col("id").cast("string")).alias("entity"),
        F.when(F.col("id") % 7 != 0, F.col("id").cast("double")).alias("share"),
        (F.col("id") / 10).alias("lon"),
        "id",
    ).withColumnRenamed("id", "unit")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        writers.write_features_by_year(rows, path, writers.point_geometry(F.col("lon"), F.lit(1.5)), ["year", "entity", "share"], ["unit"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    counts = {}
    for folder in sorted(Path(path).glob("file_year=*")):
        parts = sorted(folder.glob("part-*"))
        document = json.loads("".join(p.read_text() for p in parts))
        counts[folder.name] = (len(document["features"]), len(parts) > 1)
        assert document["type"] == "FeatureCollection"
        assert [f["properties"]["id"] for f in document["features"]] == list(range(1, len(document["features"]) + 1))
        first = document["features"][0]
        assert first["geometry"]["type"] == "Point" and first["geometry"]["coordinates"][1] == 1.5
        assert first["properties"].keys() == {"id", "year", "entity", "share"}
    assert counts["file_year=2020"][0] == 100 and counts["file_year=2021"] == (400, True)
    back = writers.read_features(spark, path, "id long, year int, entity string, share double").select("properties.*")
    assert {(r.year, r.entity, r.share) for r in back.collect()} == {(r.year, r.entity, r.share) for r in rows.collect()}


class _Context:
    applicationId = "app"

    def __init__(self, master):
        self.master = master


class _Session:
    """A session as far as the scratch folder looks at it."""

    def __init__(self, master, folder=None):
        self.sparkContext, self.conf = _Context(master), self
        self.folder = folder

    def get(self, name, default):
        assert name == "spark.checkpoint.dir"
        return self.folder or default


def test_scratch_folder_comes_from_the_session():
    assert session.scratch_path(_Session("yarn", "hdfs://shared/"), "x").startswith("hdfs://shared/x-")
    with pytest.raises(RuntimeError):
        session.scratch_root(_Session("yarn"))
    assert session.scratch_root(_Session("local[2]")) == session.scratch_root(_Session("local[2]"))


def test_materialize_keeps_rows_and_schema(spark):
    frame = spark.createDataFrame([(1, None), (2, "b")], "k int, v string")
    copy = session.materialize(frame, "copy")
    assert copy.schema == frame.schema and {tuple(r) for r in copy.collect()} == {(1, None), (2, "b")}


def test_a_hot_partition_value_becomes_several_files(spark, tmp_path):
    path = str(tmp_path / "hot")
    rows = spark.range(0, 200_000, numPartitions=8)
    frame = rows.select("id", F.when(F.col("id") % 3 < 2, 2020).otherwise(2021).alias("year"), F.rand(1).alias("x"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200KB")
    try:
        writers.write_partitions(frame, path, "year", sort=["id"])
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(list(Path(path).glob("year=2020/*.parquet"))) > 3
    assert spark.read.parquet(path).count() == 200_000


def test_csv_quotes_and_line_breaks(spark, tmp_path):
    (tmp_path / "r.csv").write_text('name,n\n"x ""y"" z, w",1\n"two\nlines",2\nNA,3\n')
    rows = readers.read_csv(spark, str(tmp_path / "r.csv"), "name string, n int", multiline=True).collect()
    assert [(r.name, r.n) for r in rows] == [('x "y" z, w', 1), ("two\nlines", 2), (None, 3)]
    frame = spark.createDataFrame([('say "a", then b\\', 1), ("two\nlines", 2), (None, 3)], "name string, n int")
    writers.write_csv(frame, str(tmp_path / "w"))
    assert {tuple(r) for r in readers.read_csv(spark, str(tmp_path / "w"), "name string, n int", multiline=True).collect()} == {tuple(r) for r in frame.collect()}


def test_features_without_shape_or_name(spark, tmp_path):
    import json

    frame = spark.createDataFrame([(2020, None, None), (2020, "a", '{"type":"Point","coordinates":[1,2]}'), (2021, "b", None)], "year int, name string, shape string")
    writers.write_features_by_year(frame, str(tmp_path / "f"), F.col("shape"), ["name"], ["name"])
    for year, names in ((2020, ["a", None]), (2021, ["b"])):
        files = sorted((tmp_path / "f" / f"file_year={year}").glob("part-*"))
        document = json.loads("".join(p.read_text() for p in files))
        assert [f["properties"]["name"] for f in document["features"]] == names
        assert document["features"][-1]["geometry"] is None


def scanned(df, metric="numOutputRows"):
    """A metric of the scan, after the query has run."""
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    return leaf.metrics().apply(metric).value()


def test_row_groups_of_one_entity(spark, tmp_path):
    """Sorted columns are skipped by statistics, unsorted ones by bloom filters; plain files skip nothing."""
    entity = F.concat(F.lit("entity "), F.lpad((F.col("id") % 2000).cast("string"), 5, "0"))
    unit = F.xxhash64(F.floor(F.col("id") / 10)).alias("unit")
    frame = spark.range(0, 200_000, numPartitions=1).select(F.lit(2020).alias("year"), entity.alias("entity"), unit, F.rand(1).alias("x"))
    one = frame.where("x < 0.5").first()["unit"]
    writers.write_partitions(frame, f"{tmp_path}/good", "year", sort=["entity"], find=["entity", "unit"], row_group_bytes=200_000, distinct=20_000)
    writers.write_partitions(frame, f"{tmp_path}/plain", "year")
    read = lambda name: spark.read.parquet(f"{tmp_path}/{name}")
    assert read("good").where("entity = 'entity 00777'").count() == 100
    assert scanned(read("good").where("entity = 'entity 00777'")) < 30_000
    assert scanned(read("good").where("entity = 'entity 00777x'")) == 0
    found = read("good").where(F.col("unit") == one)
    assert scanned(found) < 150_000 and len(found.collect()) == 10
    assert scanned(read("good").where(F.col("unit") == 12345)) == 0
    assert scanned(read("plain").where("entity = 'entity 00777'")) == 200_000
