"""Versions of published marts."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from regionlens.plans import views
from regionlens.plans.publish import Fact, Mart, Published, publish, row_print, year_prints

ROWS = [("a", 2019, "01", "Farm", "3", 5, 4), ("a", 2020, "01", "Farm", "3", 6, 5), ("b", 2019, "14", "Eng", "1", 7, 1), ("b", 2021, "14", "Eng", "1", 8, 0), ("c", None, "14", "Eng", "1", 9, 9)]
SCHEMA = "entity string, year int, code string, title string, award_level string, total int, focus int"


def run(spark, root, rows, names=("x",)):
    titles = spark.createDataFrame([(n,) for n in names], "name string")
    fact = Fact(spark.createDataFrame(rows, SCHEMA), lambda r: r.withColumn("doubled", F.col("total") * 2), [titles], ["entity"])
    marts = {
        "by_year": Mart(["supply"], lambda s: s.groupBy("entity", "year").agg(F.sum("doubled").alias("doubled")), True, sort=["entity"]),
        "all": Mart(["by_year"], lambda y: y.groupBy("entity").agg(F.sum("doubled").alias("doubled"))),
    }
    return publish(spark, root, {"supply": fact}, marts)


def runs(published):
    return {(mart, part): int(r.split("-")[0]) for mart, part, r, _ in published.manifest()}


def sums(published):
    return {r.entity: r.doubled for r in published.table("all").collect()}


def test_versions(spark, tmp_path):
    root = str(tmp_path / "marts")
    assert Published(spark, root).version == 0
    first = run(spark, root, ROWS)
    assert first.version == 1 and sums(first) == {"a": 22, "b": 30, "c": 18} and set(runs(first).values()) == {1}
    assert {tuple(r)[:2] for r in first.table("supply").collect()} == {r[:2] for r in ROWS}
    assert run(spark, root, ROWS[::-1]).version == 1  # the same rows in another order
    changed = [*ROWS[:1], ("a", 2020, "01", "Farm", "3", 10, 5), *ROWS[2:]]
    second = run(spark, root, changed)
    assert second.version == 2 and sums(second) == {"a": 30, "b": 30, "c": 18}
    assert {k for k, v in runs(second).items() if v == 2} == {("supply", "year=2020"), ("by_year", "year=2020"), ("all", "")}
    third = run(spark, root, changed[:3])  # two years less
    assert sums(third) == {"a": 30, "b": 14} and {p for m, p in runs(third) if m == "supply"} == {"year=2019", "year=2020"}
    assert {k for k, v in runs(third).items() if v == 3} == {("all", "")}
    fourth = run(spark, root, changed[:3], names=["y"])  # a table that all years depend on
    assert {k for k, v in runs(fourth).items() if v == 4} == set(runs(fourth))
    assert sums(Published(spark, root, 1)) == {"a": 22, "b": 30, "c": 18}  # earlier versions stay as they were
    assert Published(spark, root).version == 4
    with pytest.raises(KeyError):
        fourth.table("nothing")


def test_rows_of_a_fact_are_computed_once(spark, tmp_path):
    """The prints are those of the rows that are stored, also if computing the rows again gives others."""
    rows = spark.createDataFrame(ROWS, SCHEMA).withColumn("title", F.expr("uuid()"))
    made = publish(spark, str(tmp_path / "marts"), {"supply": Fact(rows)}, {})
    assert {part: mark for _, part, _, mark in made.manifest()} == year_prints(Fact(made.table("supply")))


def test_no_rows_and_failed_runs(spark, tmp_path):
    root = str(tmp_path / "marts")
    empty = run(spark, root, [])
    assert empty.table("supply").count() == 0 and empty.table("by_year").columns == ["entity", "year", "doubled"]
    assert run(spark, root, ROWS).version == 2
    broken = Fact(spark.createDataFrame([*ROWS, ("d", 2022, "1", "t", "1", 1, 1)], SCHEMA), lambda r: r.withColumn("x", F.raise_error(F.lit("no"))))
    with pytest.raises(Exception, match="no"):
        publish(spark, root, {"supply": broken}, {})
    again = Published(spark, root)
    assert again.version == 2 and again.table("supply").count() == len(ROWS)
    assert run(spark, root, ROWS[:4]).version == 3


def test_prints(spark):
    def of(rows):
        return tuple(spark.createDataFrame(rows, "a int, b int").agg(*row_print(spark.createDataFrame(rows, "a int, b int"))).first())

    assert of([(1, None), (2, 3)]) == of([(2, 3), (1, None)])
    assert len({of(r) for r in ([(1, None)], [(None, 1)], [(1, 1)], [(1, None), (1, None)])}) == 4


def test_latest_year_reads_its_folder_only(spark, tmp_path):
    marts = run(spark, str(tmp_path / "marts"), ROWS[:4])
    one = views.latest_programs(marts.table("supply"), marts.table("by_year"), "a")
    assert [tuple(r) for r in one.collect()] == [("a", 2020, "01", "Farm", "3", 5)]
    rows = marts.table("supply").where(F.col("year") == marts.table("by_year").where("entity = 'a'").select(F.max("year")).scalar())
    assert re.search(r"PartitionFilters: \[[^\]]*[Ss]ubquery", rows._jdf.queryExecution().executedPlan().toString())
    every = views.latest_programs(marts.table("supply"), marts.table("by_year"))
    assert {tuple(r) for r in every.collect()} == {("a", 2020, "01", "Farm", "3", 5)}  # the last year of b has no focus award
    assert views.latest_programs(marts.table("supply"), marts.table("by_year"), "nobody").count() == 0


def test_latest_occupations(spark):
    rows = [("z", 2019, "Boss", 1, 1, 50), ("z", 2020, "Boss", 1, 1, 5), ("z", 2020, "Boss", None, 1, 4), ("z", 2020, "Cook", 1, 0, 99), ("z", 2020, "Nurse", 3, 1, 7),
            ("z", 2020, None, 3, 1, 70), ("z", 2025, "Boss", 1, 1, 500), ("y", 2019, "Boss", 1, 1, 1)]
    demand = spark.createDataFrame(rows, "zone string, year int, soc_title string, ed_req int, focus_flag int, total int")
    shown = views.latest_occupations(demand, demand, [("1", "None"), ("3", "Degree")], n=2, partial_year=2025)
    got = [(r.zone, r.year, r.soc_title, r.education, r.total, r.title_total, r["rank"]) for r in shown.orderBy("zone", "rank").collect()]
    assert got == [("y", 2019, "Boss", "None", 1, 1, 1), ("z", 2020, "Boss", "None", 5, 9, 1), ("z", 2020, "Boss", "Missing", 4, 9, 2)]
    assert views.latest_occupations(demand, demand, [("1", "None")], "z", n=None, partial_year=2025).count() == 3


def test_long_texts_are_stored_once(spark, tmp_path):
    root = str(tmp_path / "marts")
    texts = spark.createDataFrame([("k1", "long one"), ("k2", "long two")], "key string, text string")
    rows = [("k1", 2019, 5), ("k2", 2019, 6), ("short", 2020, 7), (None, 2020, 8)]

    def run_with(long_texts):
        fact = Fact(spark.createDataFrame(rows, "zone string, year int, total int"), sort=["zone"])
        marts = {"all": Mart(["demand"], lambda d: d.groupBy("zone").agg(F.sum("total").alias("total")))}
        return publish(spark, root, {"demand": fact}, marts, {"zone": long_texts})

    first = run_with(texts)
    whole = {("long one", 5), ("long two", 6), ("short", 7), (None, 8)}
    assert {(r.zone, r.total) for r in first.table("demand").collect()} == {(r.zone, r.total) for r in first.table("all").collect()} == whole
    assert first.table("demand").columns == ["zone", "year", "total"]
    assert {r.zone for r in first.keyed("demand").collect()} == {"k1", "k2", "short", None}
    assert {mart for mart, *_ in first.manifest()} == {"demand", "all"}
    assert run_with(texts).version == 1
    none = run_with(texts.where("false"))
    assert none.version == 2 and "Join" not in none.table("all")._jdf.queryExecution().executedPlan().toString()
    assert {(r.zone, r.total) for r in Published(spark, root, 1).table("all").collect()} == whole


def test_facts_hold_no_long_labels(spark):
    from regionlens.plans.facts import Tables
    from regionlens.plans.raw import published

    marts = published(Tables(spark, "/root/testdata/sf0.1"))
    for name in ("supply", "demand", "map_entities", "zone_years"):
        assert marts.keyed(name).agg(F.max(F.length("zone"))).first()[0] <= 82
    assert marts.table("zone_years").agg(F.max(F.length("zone"))).first()[0] > 600


def test_working_tables_go_step_by_step(spark):
    """While a step runs only the table before it is there, and a publication leaves nothing but its own folders."""
    import os

    from regionlens.plans.facts import Tables
    from regionlens.plans.publish import publish_all
    from regionlens.plans.raw import written_inputs
    from regionlens.session import passing_tables, scratch_path, scratch_root, stepwise

    def there():
        return set(os.listdir(scratch_root(spark).removeprefix("file://")))

    spark.range(1).write.parquet(scratch_path(spark, "first"))  # the folder is made when something is written
    before, seen = there(), []

    def step(df):
        seen.append(sorted(name.rsplit("-", 1)[0] for name in there() - before))
        return df.selectExpr("id + 1 AS id")

    with passing_tables(spark):
        made = stepwise(spark, "count", lambda: spark.range(3), step, step, step)
        assert seen == [[], ["count-0"], ["count-1"]] and [name.rsplit("-", 1)[0] for name in there() - before] == ["count-2"]
        assert sorted(r.id for r in made.collect()) == [3, 4, 5]
    assert there() == before
    root = scratch_path(spark, "kept")
    marts = publish_all(spark, root, written_inputs(Tables(spark, "/root/testdata/sf0.001")), 2001, 2000)
    assert there() - before == {os.path.basename(root)}
    assert marts.table("supply").count() > 0 and marts.table("demand").count() > 0


def test_no_plan_joins_all_tables_of_a_fact(spark, monkeypatch):
    """What is written in one go crosses few shuffles, as all of a plan's shuffle files stay until it ends."""
    from regionlens import session
    from regionlens.plans.facts import Tables
    from regionlens.plans.publish import publish_all
    from regionlens.plans.raw import written_inputs

    joins = {}
    write = session.materialize

    def counted(df, label, *args, **more):
        joins[label] = max(joins.get(label, 0), len(re.findall(r"Join", df._jdf.queryExecution().optimizedPlan().toString())))
        return write(df, label, *args, **more)

    monkeypatch.setattr(session, "materialize", counted)
    monkeypatch.setattr("regionlens.plans.publish.materialize", counted)
    publish_all(spark, session.scratch_path(spark, "marts"), written_inputs(Tables(spark, "/root/testdata/sf0.001")), 2001, 2000)
    facts = {label: n for label, n in joins.items() if not label.startswith("zone-")}
    assert len(facts) > 8 and max(n for label, n in facts.items() if label != "supply-rows-0") == 1, facts
