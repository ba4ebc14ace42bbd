"""The interactive views over small facts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from regionlens.plans import build, views
from regionlens.plans.facts import Tables
from regionlens.plans.supply import entity_trend


@pytest.fixture(scope="module")
def supply(spark):
    rows = [
        ("a", 2020, "01.01", "Farm", "3", 10, 5, 100, 1, 0, "z"), ("a", 2020, "14.01", "Eng", "1", 10, 8, 100, 1, 0, "z"),
        ("a", 2020, "14.01", "Eng", "3", 5, 2, 100, 1, 0, "z"), ("a", 2022, "14.01", "Eng", "1", 0, 0, 50, 1, 0, "z"),
        ("b", 2020, "14.01", "Eng", "1", 100, 1, 10, None, 1, "y"),
    ]
    schema = "entity string, year int, code string, title string, award_level string, total long, focus long, enrolled long, rural int, tribal int, zone string"
    return spark.createDataFrame(rows, schema).withColumn("unitid", F.lit(1))


@pytest.fixture(scope="module")
def demand(spark):
    rows = [
        ("12 Erie CZ", 2020, "11-1", "Boss", 3, 1, 40, 1000.0), ("12 Erie CZ", 2020, "11-1", "Boss", None, 1, 20, 1000.0),
        ("12 Erie CZ", 2020, "53-1", "Driver", 3, 1, 50, 3000.0), ("12 Erie CZ", 2020, "99-1", "Cook", 1, 0, 90, 2000.0),
        ("12 Erie CZ", 2020, "53-1", None, 1, 1, 7, 2000.0), ("12 Erie CZ", 2025, "53-1", "Driver", 3, 1, 999, 1.0),
        ("Other", 2020, "53-1", "Driver", 3, 1, 1, None),
    ]
    return spark.createDataFrame(rows, "zone string, year int, soc string, soc_title string, ed_req int, focus_flag int, total long, population double")


def test_entity_trend(supply):
    rows = views.trend_of_entity(supply, "a", "percent").orderBy("year").collect()
    assert [(r.year, r.total, r.focus, r.enrolled, r.value, r.tooltip) for r in rows] == [
        (2020, 25, 15, 300, 60.0, "Year: 2020\nFocus %: 60%"), (2022, 0, 0, 50, None, None)
    ]
    assert [r.value for r in views.trend_of_entity(supply, "a", "nonsense").orderBy("year").collect()] == [15.0, 0.0]
    assert views.trend_of_entity(supply, "nobody").count() == 0


def test_zone_trend(demand):
    row = views.trend_of_zone(demand, "12 Erie CZ", "per_capita", 2025).collect()
    assert [(r.year, r.total, r.focus, r.population, r.value, r.tooltip) for r in row] == [(2020, 207, 117, 1800.0, 65.0, "Year: 2020\nPer 1,000: 65")]


def test_national_series(spark, supply):
    national = spark.createDataFrame([(y, 10.0 * y, 0.5) for y in (2019, 2020, 2021, 2022, 2023)], "year int, Mean_Focus double, FOCUS_SHARE double")
    both = views.with_benchmark(views.trend_of_entity(supply, "a", "percent"), national, "entity", "percent").collect()
    assert sorted((r.series, r.year, r.value) for r in both if r.series == "national") == [("national", y, 50.0) for y in (2020, 2021, 2022)]
    with pytest.raises(ValueError, match="per_capita"):
        views.national_series(national, "per_capita")
    other = national.withColumnsRenamed({"Mean_Focus": "Published"})
    assert views.national_series(other, "focus", {"focus": ["absent", "published"]}).count() == 5


def test_programs_of_entity(supply):
    rows = views.programs_of_entity(supply, "a", "2020").collect()
    got = {(r.family, r.title, r.award): (r.focus, r.group_rank, r.item_rank, r.share) for r in rows}
    assert got == {
        ("Engr", "Eng", "<1 Year Certificate"): (8, 1, 1, 0.8), ("Engr", "Eng", "Associate"): (2, 1, 1, 0.2),
        ("Agriculture", "Farm", "Associate"): (5, 2, 1, 1.0),
    }
    assert {r.tooltip for r in rows if r.title == "Farm"} == {
        "Field: Agriculture, Agriculture Operations, and Related Sciences\nProgram: Farm\nAward Level: Associate\nCredentials: 5"
    }
    assert views.programs_of_entity(supply, "a", "abc").count() == 0


def test_occupations_of_zone(demand):
    labels = [("1", "None"), ("3", "Degree")]
    rows = views.occupations_of_zone(demand, "12 Erie CZ", labels, n=2, partial_year=2025).orderBy("rank").collect()
    assert [(r.soc_title, r.education, r.total, r.title_total, r.group_total, r.group_rank, r.item_rank) for r in rows] == [
        ("Boss", "Degree", 40, 60, 60, 1, 1), ("Boss", "Missing", 20, 60, 60, 1, 1)
    ]
    everything = views.occupations_of_zone(demand, "12 Erie CZ", labels, n=None, partial_year=2025).orderBy("rank").collect()
    assert [(r["rank"], r.group, r.soc_title) for r in everything] == [(1, "Management", "Boss"), (2, "Management", "Boss"), (3, "Transportation & Material Moving", "Driver")]
    assert [r.group_rank for r in everything] == [1, 1, 2]


def test_search(spark):
    rows = [(2020, 2, "Lee (North) College", "z", 1000, 250, 0.25), (2020, 1, "lee College", "z", 10, 1, 0.1), (2021, 1, "lee College", "z", 10, 1, 0.1)]
    mapped = spark.createDataFrame(rows, "year int, unitid int, entity string, zone string, total long, focus long, focus_share double")
    found = views.find_entity(mapped, "LEE", "2020").collect()
    assert [r.unitid for r in found] == [2]
    assert found[0].popup.endswith("<strong>Total Completions:</strong> 1,000<br><strong>Focus Completions:</strong> 250<br><strong>Focus Percentage:</strong> 25.0%")
    assert views.find_entity(mapped, "(north)", 2020, literal=True).first().unitid == 2
    assert views.find_entity(mapped, "nothing", 2020).count() == 0
    assert [r.entity for r in views.name_choices(mapped, "2021").collect()] == ["lee College"]


def test_marts_and_tables(supply, demand):
    table = build.institution_table(supply)
    got = {r.entity: (r.mean_total, r.mean_focus, r.mean_enrolled, r.zone, r.rural) for r in table.collect()}
    assert got == {"a": (12.5, 7.5, 75.0, "z", 1), "b": (100.0, 1.0, 10.0, "y", None)}
    national = {r.year: (r.mean_focus, r.focus_share) for r in build.national_awards(supply).collect()}
    assert national == {2020: (8.0, 0.128), 2022: (0.0, None)}
    shown = {r["Institution"]: (r["Focus%"], r["Rural"], r["Tribal"]) for r in views.entity_display(table).collect()}
    assert shown == {"a": ("60%", "Yes", "No"), "b": ("1%", "No", "Yes")}
    board = views.entity_leaders(table.drop("focus_share"), "focus_share").orderBy("rank").collect()
    assert [r.caption for r in board] == ["a — 60%", "b — 1%"]
    leaders = build.zone_leaders(demand, 2025)
    assert [r.caption for r in views.zone_leaderboard(leaders, "mean_per_1000").orderBy("rank").collect()] == ["Erie — 65.0", None]
    shown = views.zone_display(build.zone_year_table(demand)).where(F.col("Year") == 2020).orderBy("Commuting Zone").collect()
    assert [(r["Total Job Postings"], r["Focus%"], r["Commuting Zone Population"]) for r in shown] == [("207", "56.52%", "1,800"), ("1", "100%", None)]
    assert build.national_postings(demand).where(F.col("year") == 2020).first().mean_total == 104.0
    assert build.zone_table(demand).count() == 2


def test_filter_of_one_entity_equals_the_whole(spark, folder):
    tables = Tables(spark, folder)
    name = "Supplier#000000003"
    one = {tuple(r) for r in entity_trend(tables, name).collect()}
    assert one and one == {tuple(r) for r in entity_trend(tables).where(F.col("entity") == name).collect()}


def test_numbers_are_shown_by_column(spark):
    rows = [("a", 1234.0, 0.5, 1.256, 7), ("b", 2.0, 0.125, 3.0, None)]
    frame = spark.createDataFrame(rows, "zone string, whole double, share double, mixed double, n int")
    got = {r.zone: (r.whole, r.share, r.mixed, r.n) for r in views.shown_numbers(frame, ["share"]).collect()}
    assert got == {"a": ("1,234", "50%", "1.26", "7"), "b": ("2", "12.5%", "3", None)}
    assert views.trend_title(F.lit("x")) is not None
