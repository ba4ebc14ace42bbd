from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from regionlens.operators import aggregates, joins


@pytest.fixture(scope="module")
def demand(spark):
    rows = [
        ("a", 2020, "x", 10, 1, 100.0), ("a", 2020, "y", 30, 0, 300.0), ("a", 2020, "z", 5, None, None),
        ("a", 2021, "x", 100, 1, 1000.0), ("a", 2021, "y", 100, 0, 1000.0),
        ("b", 2020, "x", 0, 1, None), ("b", 2021, "y", None, 0, None),
    ]
    frame = spark.createDataFrame(rows, "zone string, year int, soc string, total long, focus_flag int, population double")
    return aggregates.with_focus(frame)


def test_yearly_demand(demand):
    got = {(r.zone, r.year): (r.total, r.focus, r.population) for r in aggregates.yearly_demand(demand).collect()}
    assert got == {("a", 2020): (45, 10, 200.0), ("a", 2021): (200, 100, 1000.0), ("b", 2020): (0, 0, None), ("b", 2021): (0, 0, None)}


def test_rates_are_null_without_a_denominator(demand):
    rates = aggregates.demand_rates(aggregates.yearly_demand(demand))
    got = {(r.zone, r.year): (r.focus_percent, r.per_capita) for r in rates.collect()}
    assert got[("a", 2020)] == (pytest.approx(10 / 45 * 100), 50.0)
    assert got[("b", 2020)] == (None, None)


def test_numerator_and_scale_are_parameters(demand):
    yearly = aggregates.yearly_demand(demand)
    total = {(r.zone, r.year): r.per_capita for r in aggregates.demand_rates(yearly, numerator="total").collect()}
    hundred = {(r.zone, r.year): r.per_capita for r in aggregates.demand_rates(yearly, per=100_000).collect()}
    assert total[("a", 2021)] == 200.0 and hundred[("a", 2021)] == 10_000.0


def test_mean_of_ratios_is_not_ratio_of_means(demand):
    yearly = aggregates.yearly_demand(demand).where(F.col("zone") == "a")
    summary, lead = aggregates.summarise_zones(yearly).first(), aggregates.lead_zones(yearly).first()
    assert summary.focus_share == pytest.approx(55 / 122.5)
    assert lead.mean_share == pytest.approx((10 / 45 + 0.5) / 2)
    assert lead.mean_per_1000 == pytest.approx((50 + 100) / 2)
    assert summary.per_1000 == pytest.approx(122.5 / 600 * 1000)


def test_pre_aggregated_fact_gives_the_same(demand):
    """Rows summed in advance, with a weight, lead to the same yearly figures."""
    summed = demand.groupBy("zone", "year", "population").agg(
        F.sum("total").alias("total"), F.sum("focus").alias("focus"), F.count(F.lit(1)).alias("rows")
    )
    plain = {tuple(r) for r in aggregates.yearly_demand(demand).collect()}
    assert {tuple(r) for r in aggregates.yearly_demand(summed, weight="rows").collect()} == plain


def test_national_ratios(spark):
    """Ratios of published national means: share = focus / total, rate = focus / population * 1000."""
    rows = [(2010, 21287.420212765966, 2701.8368794326248, 147951.0298762141)]
    yearly = spark.createDataFrame(rows, "year int, total double, focus double, population double")
    got = aggregates.national_demand(yearly).first()
    assert got.focus_share == pytest.approx(0.12692176188697332, rel=1e-12)
    assert got.per_1000 == pytest.approx(18.261697006726926, rel=1e-12)


def test_national_supply_keeps_enrolment_only_if_present(spark):
    frame = spark.createDataFrame([("a", 2010, 10, 5), ("b", 2010, 30, 5)], "entity string, year int, total int, focus int")
    got = aggregates.national_supply(frame).first()
    assert (got.mean_total, got.mean_focus, got.focus_share) == (20.0, 5.0, 0.25)
    assert "mean_enrolled" not in got
    assert aggregates.national_supply(frame.withColumn("enrolled", F.lit(7))).first().mean_enrolled == 7.0


def test_entity_means_over_years(spark):
    rows = [("a", 2010, 10, 1, 5, "z1"), ("a", 2011, 30, 3, None, "z2")]
    frame = spark.createDataFrame(rows, "entity string, year int, total int, focus int, enrolled int, zone string")
    got = aggregates.summarise_entities(frame, ["zone"]).first()
    assert (got.mean_total, got.mean_focus, got.mean_enrolled, got.zone, got.focus_share) == (20.0, 2.0, 5.0, "z1", 0.1)


def test_roll_up(spark):
    rows = [
        ("z", 2020, "s", 2, 5, 10.0, 3, None, 1), ("z", 2020, "s", 1, 7, 20.0, 4, 1, 0),
        ("z", 2020, "t", 1, None, None, None, None, 1), (None, 2020, "s", 3, 1, 1.0, 1, 1, 1),
    ]
    schema = "zone string, year int, soc string, county int, total long, population double, ed_req int, focus_flag int, industry_energy int"
    rolled = aggregates.roll_up_postings(spark.createDataFrame(rows, schema), F.col("county"))
    got = {r.soc: (r.total, r.population, r.ed_req, r.focus_flag, r.industry_energy) for r in rolled.collect()}
    assert got == {"s": (12, 15.0, 4, 1, 0), "t": (0, None, None, 0, 1)}


def test_map_entities_takes_first_known(spark):
    rows = [(2020, 1, "a", 2, "late", 1.0, 10, 4), (2020, 1, "a", 1, None, None, 10, 1), (2020, 2, "b", 1, "z", 2.0, 0, 0)]
    frame = spark.createDataFrame(rows, "year int, unitid int, entity string, k int, zone string, latitude double, total int, focus int")
    got = {r.unitid: (r.zone, r.latitude, r.total, r.focus_share) for r in aggregates.map_entities(frame, F.col("k"), ["zone", "latitude"]).collect()}
    assert got == {1: ("late", 1.0, 20, 0.25), 2: ("z", 2.0, 0, None)}


def test_one_hot_and_names(spark):
    rows = [("11", "Energy + more"), ("11", "2 b"), ("13", None)]
    wide = aggregates.one_hot(spark.createDataFrame(rows, "soc string, kind string"), ["soc"], "kind", ["Energy + more", "2 b", "c"])
    clean = aggregates.snake_names(wide)
    assert clean.columns == ["soc", "energy_more", "x2_b", "c"]
    assert {tuple(r) for r in clean.collect()} == {("11", 1, 1, 0), ("13", 0, 0, 0)}
    with pytest.raises(Exception, match="kind is not listed: 2 b"):
        aggregates.one_hot(spark.createDataFrame(rows, "soc string, kind string"), ["soc"], "kind", ["Energy + more"]).collect()


def test_spine_fills_gaps(spark):
    frame = spark.createDataFrame([("a", 2010, 1), ("a", 2012, 3), ("b", 2011, 5)], "unit string, year int, v int")
    got = {(r.unit, r.year, r.v) for r in aggregates.year_spine(frame, ["unit"], "v").collect()}
    assert got == {("a", 2010, 1), ("a", 2011, None), ("a", 2012, 3), ("b", 2011, 5)}


def test_benchmark_is_clipped_to_the_units_years(spark):
    trend = spark.createDataFrame([("a", 2011, 1.0), ("a", 2013, 2.0)], "zone string, year int, v double")
    national = spark.createDataFrame([(y, float(y)) for y in range(2010, 2016)], "year int, n double")
    rows = aggregates.against_national(trend, national, "zone", "v", "n").collect()
    assert {(r.year, r.value) for r in rows if r.series == "national"} == {(2011, 2011.0), (2012, 2012.0), (2013, 2013.0)}
    assert {(r.year, r.value) for r in rows if r.series == "zone"} == {(2011, 1.0), (2013, 2.0)}


@pytest.mark.parametrize("rows,expected", [([0.5, 1.0], [50.0, 100.0]), ([0.5, 1.01], [0.5, 1.01]), ([None], [None])])
def test_percent_scaling_is_by_column(spark, rows, expected):
    frame = spark.createDataFrame([(v,) for v in rows], "x double")
    assert [r.p for r in aggregates.percent_scaled(frame, {"x": "p"}).collect()] == expected


def test_percent_scaling_by_value(values):
    assert values([0.5, 1.01, None], "double", aggregates.percent_scaled_by_value(F.col("x"))) == [50.0, 1.01, None]


def test_mix_keeps_positive_sums(spark):
    frame = spark.createDataFrame([("a", 1), ("a", 2), ("b", 0), ("c", None)], "code string, focus int")
    assert [tuple(r) for r in aggregates.mix(frame, ["code"]).collect()] == [("a", 3)]


def test_zone_population_up_to_a_year(spark):
    frame = spark.createDataFrame([("z", 2020, 1.0), ("z", 2020, None), ("z", 2021, 5.0), (None, 2020, 9.0)], "zone string, year int, population double")
    assert {tuple(r) for r in aggregates.zone_population(frame, 2020).collect()} == {("z", 2020, 1.0)}
    assert aggregates.zone_population(frame, None).count() == 2


def test_look_up_common_columns(spark):
    left = spark.createDataFrame([(1, 2020, "a"), (2, 2020, "b")], "k int, year int, v string")
    right = spark.createDataFrame([(1, 2020, 5), (1, 2021, 6)], "k int, year int, w int")
    assert {tuple(r) for r in joins.look_up_common(left, right).select("k", "w").collect()} == {(1, 5), (2, None)}
    with pytest.raises(ValueError):
        joins.look_up_common(left, right.select("w"))


def test_look_up_renamed_keeps_clashing_columns(spark):
    left = spark.createDataFrame([("1", "shape")], "fips string, name string")
    right = spark.createDataFrame([("1", "Lee County", 5)], "geoid string, name string, population int")
    row = joins.look_up_renamed(left, right, {"fips": "geoid"}).first()
    assert row.asDict() == {"fips": "1", "name": "shape", "name_right": "Lee County", "population": 5}


def test_rows_of_latest(spark):
    frame = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), ("b", 1, "w")], "u string, year int, v string")
    assert {r.v for r in joins.rows_of_latest(frame, "u", "year").collect()} == {"y", "z", "w"}
    assert {r.v for r in joins.rows_of_latest(frame, "u", "year", frame.select("u", "year"), "a").collect()} == {"y", "z"}
    assert joins.rows_of_latest(frame, "u", "year", only="nobody").count() == 0
    assert {r.v for r in joins.rows_of_latest(frame, ["u"], "year", frame.where("year < 2")).collect()} == {"x", "w"}


def test_column_facts_are_one_scan(spark):
    frame = spark.createDataFrame([(0.5, 3.0, None), (1.0, 2.5, 1.0)], "a double, b double, c double")
    facts = aggregates.column_facts(frame, {"largest": F.max("a"), "whole": F.bool_and(F.col("b") == F.floor("b")), "rows": F.count("c")})
    out = frame.select(facts["largest"], facts["whole"], facts["rows"])
    assert {tuple(r) for r in out.collect()} == {(1.0, False, 1)}
    scaled = aggregates.percent_scaled(frame, {c: f"{c}_percent" for c in "abc"})
    assert [tuple(r)[3:] for r in scaled.collect()] == [(50.0, 3.0, None), (100.0, 2.5, 100.0)]
    text = scaled._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len({line.strip() for line in text.splitlines() if " Subquery subquery#" in line and "Project" not in line}) <= 1


def test_stack_extracts_by_name(spark):
    first = spark.createDataFrame([(1, "a")], "k int, v string")
    second = spark.createDataFrame([("b", 2)], "v string, k int")
    rows = joins.stack_extracts({2010: first, 2011: second}, "year").collect()
    assert {tuple(r) for r in rows} == {(1, "a", 2010), (2, "b", 2011)}
    with pytest.raises(ValueError):
        joins.stack_extracts({}, "year")
