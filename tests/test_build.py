"""The batch build over a small hand-made input in the shape of the raw tables."""

from __future__ import annotations

import re

import pytest

from regionlens.plans import build
from regionlens.plans.facts import Tables
from regionlens.plans.raw import inputs, raw_completions
from regionlens.sources import schemas


@pytest.fixture(scope="module")
def raw(spark):
    def table(rows, schema):
        return spark.createDataFrame(rows, schema)

    return {
        "crosswalk": table([("01001", 1), ("01003", 1), ("13001", 2), ("13003", 3), ("13005", 4), ("02013", 9)], schemas.CROSSWALK),
        "cities": table(
            [("Erie", "Alabama", "01001", 100.0), ("Lee", "Alabama", "01003", 90.0), ("Far", "Alabama", "01003", 10.0),
             ("Nome", "Alaska", "02013", 50.0), ("Here", "Nowhere", "13001", 5.0)],
            schemas.CITIES,
        ),
        "names": table(
            [("01001", "Autauga County", "01"), ("13003", "Bacon County", "13"), ("13005", "Baker", "99")], schemas.COUNTY_NAMES
        ),
        "states": table([("01", "AL"), ("01", "AL"), ("13", "GA")], schemas.STATE_CODES),
        "population": table(
            [("01001", 100.0, 1.0, 2020), ("01003", 300.0, 1.0, 2020), ("13001", 50.0, 1.0, 2020), ("01001", 200.0, 1.0, 2024)], schemas.POPULATION
        ),
        "occupations": table(
            [("11-1", "Boss", 3, 1, "energy"), ("11-1", "Boss", 3, 1, "farm work"), ("53-1", "Driver", 1, 0, "none")], schemas.OCCUPATIONS
        ),
        "postings": table(
            [(1001, "Autauga", 2020, "11-1", 10), (1003, "Baldwin", 2020, "11-1", 5), (1003, "Baldwin", 2020, "53-1", 5),
             (13001, "Appling", 2020, "99-9", 7), (1001, "Unknown County", 2020, "11-1", 1000), (5, "Elsewhere", 2020, "11-1", 3),
             (1001, "Autauga", 2024, "11-1", 50)],
            schemas.POSTINGS,
        ),
    }


@pytest.fixture(scope="module")
def labels(raw):
    return build.zone_labels(raw["crosswalk"], raw["cities"], raw["names"], raw["states"]).cache()


def test_zone_labels(labels):
    got = {(r.county, r.zone_code, r.zone) for r in labels.collect()}
    assert got == {
        (1001, 1, "Erie, AL & Lee, AL"), (1003, 1, "Erie, AL & Lee, AL"), (13001, 2, "Here"),
        (13003, 3, "County: Bacon Co., GA"), (13005, 4, "County: Baker"),
    }


@pytest.fixture(scope="module")
def demand(raw, labels):
    return build.demand_fact(raw["postings"], labels, raw["occupations"], raw["population"], ["energy", "farm work"]).cache()


def test_demand_fact(demand):
    got = {(r.zone, r.year, r.soc): (r.total, r.population, r.soc_title, r.ed_req, r.focus_flag, r.industry_energy, r.industry_farm_work) for r in demand.collect()}
    assert got == {
        ("Erie, AL & Lee, AL", 2020, "11-1"): (15, 200.0, "Boss", 3, 1, 1, 1),
        ("Erie, AL & Lee, AL", 2020, "53-1"): (5, 300.0, "Driver", 1, 0, 0, 0),
        ("Here", 2020, "99-9"): (7, 50.0, None, None, 0, None, None),
        ("Erie, AL & Lee, AL", 2024, "11-1"): (50, 200.0, "Boss", 3, 1, 1, 1),
    }


def test_map_zones(demand, labels, raw):
    got = {(r.zone_code, r.year): (r.zone, r.total, r.focus, r.population, r.focus_percent, r.per_1000) for r in build.map_zones(demand, labels, raw["population"], max_year=2023).collect()}
    assert got == {(1, 2020): ("Erie, AL & Lee, AL", 20, 15, 400.0, 75.0, 50.0), (2, 2020): ("Here", 7, 0, 50.0, 0.0, 140.0)}


def test_supply_fact_and_map(spark, labels):
    base = dict(industry=1, state="AL", tribal=0, rural=1, county="1001", enrolled=100, ft_enrolled=50, web="w")
    rows = [
        dict(base, unitid=1, entity="Old Name", year=2019, code="01.01", title=" Farm\t", award_level="3", total=4, focus=4, latitude=None, longitude=-1.0),
        dict(base, unitid=1, entity="New Name", year=2020, code="01.01", title="Farm", award_level="3", total=6, focus=3, latitude=None, longitude=-1.0),
        dict(base, unitid=1, entity="New Name", year=2020, code="14.01", title="Eng", award_level="1", total=4, focus=None, latitude=2.0, longitude=-1.0),
        dict(base, unitid=2, entity="No Zone", year=2020, code="14.01", title="Eng", award_level="1", total=0, focus=0, latitude=2.0, longitude=-1.0, county="x"),
    ]
    columns = [part.strip().split(" ")[0] for part in schemas.COMPLETIONS.split(",")]
    completions = spark.createDataFrame([tuple(r[c] for c in columns) for r in rows], schemas.COMPLETIONS)
    supply = build.supply_fact(completions, labels)
    assert {(r.unitid, r.entity, r.zone) for r in supply.collect()} == {(1, "New Name", "Erie, AL & Lee, AL"), (2, "No Zone", None)}
    assert {r.title for r in supply.collect()} == {"Farm", "Eng"}
    assert "county" not in supply.columns
    mapped = [(r.year, r.entity, r.zone, r.latitude, r.total, r.focus, r.focus_share) for r in build.map_supply(supply).collect()]
    assert mapped == [
        (2019, "New Name", "Erie, AL & Lee, AL", None, 4, 4, 1.0),
        (2020, "New Name", "Erie, AL & Lee, AL", 2.0, 10, 3, 0.3),
        (2020, "No Zone", None, 2.0, 0, 0, None),
    ]


def test_first_unit_and_whole_places(spark):
    rows = [(2020, 2, "a", "z", 900, 1, 0, 5, 1, 20.0, -80.0), (2020, 1, "a", "z", 100, 0, 1, 5, 1, 10.0, -50.0), (2020, 1, "a", "z", 100, 0, 1, 5, 1, 30.0, None)]
    supply = spark.createDataFrame(rows, "year int, unitid int, entity string, zone string, enrolled int, rural int, tribal int, total int, focus int, latitude double, longitude double")
    yearly = build.yearly_awards(supply).collect()
    assert [(r.enrolled, r.rural, r.tribal, r.total) for r in yearly] == [(100, 0, 1, 15)]
    assert {(r.unitid, r.latitude, r.longitude) for r in build.map_supply(supply).collect()} == {(1, 10.0, -50.0), (2, 20.0, -80.0)}


def test_counties_are_dealt_out_by_the_weight_of_their_labels(raw, labels):
    spread = build.zone_labels(raw["crosswalk"], raw["cities"], raw["names"], raw["states"], label_bytes=10)
    assert "REPARTITION_BY_NUM" in spread._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in spread.collect()} == {tuple(r) for r in labels.collect()}


def test_tables_that_grow_are_not_broadcast_by_the_size_of_their_files(spark, raw, labels, folder, tmp_path):
    """Labels, populations and parts take a few bytes a row in files, so the check at planning would broadcast them at any size."""

    def stored(df, name):
        df.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    own = {name: stored(df, name) for name, df in {**raw, "labels": labels}.items()}
    rows = build.demand_rows(own["postings"], own["labels"], own["occupations"], own["population"], ["energy", "farm work"])
    completions = stored(spark.createDataFrame([], schemas.COMPLETIONS), "completions")
    yearly = stored(build.yearly_postings(build.demand_of_rows(rows, build.occupation_titles(own["occupations"]))), "yearly")
    t = Tables(spark, folder)
    made = [
        (rows, "county", 2), (build.supply_fact(completions, own["labels"]), "county", 1),
        (build.zones_on_map(yearly, own["labels"], own["population"]), "county", 2),  # for the residents and for the largest zone
        (build.zone_names(build.county_zones(own["crosswalk"]), own["cities"], own["names"], own["states"]), "county", 1),
        (raw_completions(t), "l_partkey", 1), (inputs(t).postings, "l_partkey", 1),
    ]
    for df, key, least in made:
        plan = df._jdf.queryExecution().sparkPlan().toString()
        assert not re.search(rf"BroadcastHashJoin \[(cast\()?{key}#", plan)
        assert len(re.findall(rf"SortMergeJoin \[(?:cast\()?{key}#", plan)) >= least
