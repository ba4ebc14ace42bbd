"""The star-schema test tables in the shapes of the raw inputs, so that the batch build and the views run on them.

A customer is a county, its nation the zone; the counties of a zone also hold its cities. Sales of a supplier are the
completions of an institution, which was called otherwise before 1995. Ordered parts are postings; part size and type
make the occupation, and every tenth size is in no occupation table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionlens.operators.joins import sorted_side
from regionlens.operators.skew import dealt_out
from regionlens.plans.facts import FOCUS, QUANTITY, Tables
from regionlens.plans.publish import ROW_GROUP_BYTES, Inputs, Published, publish_all
from regionlens.session import scratch_path, stepwise

FIRST_YEAR, LAST_YEAR, PARTIAL_YEAR = 1992, 2001, 2001
INDUSTRIES = ["energy", "farm work"]
SOC = "lpad(CAST(p_size AS STRING), 2, '0') || '-' || p_type"
_ROOTS: dict[tuple[str, str], str] = {}


def inputs(t: Tables) -> Inputs:
    customers, parts = t.read("customer"), t.read("part", "p_partkey", "p_size", "p_type")
    geoid = "lpad(CAST(c_custkey AS STRING), 10, '0') AS geoid"
    cities = customers.where((F.col("c_custkey") % 3 == 0) & (F.col("c_nationkey") != 3)).selectExpr(
        "'City ' || CAST(c_custkey % 7 AS STRING) AS city",
        "CASE c_custkey % 4 WHEN 0 THEN 'Ohio' WHEN 1 THEN 'Texas' WHEN 2 THEN 'Utah' ELSE 'Nowhere' END AS state_name",
        "lpad(CAST(c_custkey AS STRING), 10, '0') AS county_fips",
        "c_acctbal AS population",
    )
    names = customers.selectExpr(geoid, "c_mktsegment || ' County' AS name", "lpad(CAST(c_custkey % 6 AS STRING), 2, '0') AS state_fips")
    states = t.read("region").selectExpr("lpad(CAST(r_regionkey AS STRING), 2, '0') AS state_code", "upper(substr(r_name, 1, 2)) AS state")
    known = customers.where("c_acctbal > 0")
    years = F.explode(F.sequence(F.lit(FIRST_YEAR), F.lit(LAST_YEAR))).alias("year")
    population = known.select(F.expr(geoid), F.floor("c_acctbal").cast("double").alias("population"), F.lit(1.0).alias("margin"), years)
    listed = parts.where("p_size % 10 <> 9").selectExpr(f"{SOC} AS soc", "p_type || ' grade ' || CAST(p_size AS STRING) AS soc_title", "p_size").distinct()
    industry = F.explode(
        F.when(F.col("p_size") % 3 == 0, F.array(F.lit("energy"), F.lit("farm work"))).when(F.col("p_size") % 3 == 1, F.array(F.lit("farm work"))).otherwise(F.array(F.lit("none")))
    ).alias("industry")
    occupations = listed.select("soc", "soc_title", F.expr("p_size % 5 + 1 AS ed_req"), F.expr("p_size % 2 AS focus_flag"), industry)
    return Inputs(
        crosswalk=customers.selectExpr(geoid, "c_nationkey AS zone_code"),
        cities=cities,
        county_names=names,
        state_codes=states,
        completions=raw_completions(t),
        postings=summed_postings(coded_lines(t, placed_lines(t))),
        occupations=occupations,
        population=population,
        industries=INDUSTRIES,
    )


def placed_lines(t: Tables) -> DataFrame:
    ordered = t.read("lineitem").selectExpr("l_orderkey", "l_partkey", f"{QUANTITY} AS total")
    placed = ordered.join(t.read("orders").selectExpr("o_orderkey AS l_orderkey", "o_custkey", "year(o_orderdate) AS year"), "l_orderkey")
    return placed.select("l_partkey", "o_custkey", "year", "total")


def coded_lines(t: Tables, placed: DataFrame) -> DataFrame:
    parts = t.read("part", "p_partkey", "p_size", "p_type").selectExpr("p_partkey AS l_partkey", f"{SOC} AS soc")
    return placed.join(sorted_side(parts), "l_partkey").select("o_custkey", "year", "soc", "total")


def summed_postings(coded: DataFrame) -> DataFrame:
    # hardly two lines share customer, year and part: summed by part first, every line would cross one more shuffle
    sums = coded.groupBy("o_custkey", "year", "soc").agg(F.sum("total").alias("total"))
    named = "CASE WHEN county % 50 = 0 THEN 'Unknown County' ELSE 'County ' || CAST(county AS STRING) END AS county_name"
    return sums.selectExpr("CAST(o_custkey AS INT) AS county", "year", "soc", "total").selectExpr("county", named, "year", "soc", "total")


def raw_completions(t: Tables) -> DataFrame:
    return described_lines(t, sold_lines(t))


def sold_lines(t: Tables) -> DataFrame:
    lines = t.read("lineitem").selectExpr("l_suppkey", "l_partkey", "l_linenumber", "year(l_shipdate) AS year", f"{QUANTITY} AS total", f"{FOCUS} AS focus")
    keys = ["l_suppkey", "l_partkey", "l_linenumber", "year"]
    # hardly two lines share these, so they are dealt out first: summing them before as well would hold all lines of a split
    return dealt_out(lines, *keys).groupBy(*keys).agg(F.sum("total").alias("total"), F.sum("focus").alias("focus"))


def described_lines(t: Tables, sold: DataFrame) -> DataFrame:
    return of_units(t, of_parts(t, sold))


def of_parts(t: Tables, sold: DataFrame) -> DataFrame:
    parts = t.read("part").selectExpr("p_partkey AS l_partkey", "p_brand", "p_name")
    return sold.join(sorted_side(parts), "l_partkey")


def of_units(t: Tables, lines: DataFrame) -> DataFrame:
    units = t.read("supplier").selectExpr("s_suppkey AS l_suppkey", "s_name", "s_acctbal")
    return lines.join(units, "l_suppkey").selectExpr(
        "l_suppkey AS unitid",
        "CASE WHEN year < 1995 THEN 'Old ' || s_name ELSE s_name END AS entity",
        "1 AS industry", "year", "'OH' AS state",
        "CASE WHEN s_acctbal < 0 THEN 1 ELSE 0 END AS tribal",
        "CASE WHEN s_acctbal >= 5000 THEN 1 WHEN s_acctbal >= 0 THEN 0 END AS rural",
        "p_brand AS code", "'  ' || p_name || '\\t' AS title",
        "CAST(1 + l_suppkey % 100 AS STRING) AS county",
        "CAST(l_linenumber AS STRING) AS award_level",
        "total", "focus",
        "CAST(1000 + (l_suppkey * 7 + year) % 500 AS BIGINT) AS enrolled",
        "CAST(500 AS BIGINT) AS ft_enrolled", "'web' AS web",
        "CASE WHEN l_suppkey % 10 <> 5 THEN round(CAST(l_suppkey * 17 % 2400 AS DOUBLE) / 100 + 25, 2) END AS latitude",
        "CASE WHEN l_suppkey % 10 <> 0 THEN round(CAST(l_suppkey * 37 % 5900 AS DOUBLE) / 100 - 125, 2) END AS longitude",
    )


def written_inputs(t: Tables, change: Callable[[DataFrame], DataFrame] = lambda completions: completions) -> Inputs:
    """The same inputs, the lines of both facts joined step by step when their fact is built: a plan with all joins keeps the shuffles of all."""
    def completions() -> DataFrame:
        steps = (lambda lines: lines, lambda lines: of_parts(t, lines), lambda lines: change(of_units(t, lines)))
        return stepwise(t.spark, "completions", lambda: sold_lines(t), *steps, row_group_bytes=ROW_GROUP_BYTES)

    def postings() -> DataFrame:
        steps = (lambda lines: lines, lambda lines: coded_lines(t, lines), summed_postings)
        return stepwise(t.spark, "postings", lambda: placed_lines(t), *steps, row_group_bytes=ROW_GROUP_BYTES)

    return replace(inputs(t), completions=completions, postings=postings)


def published(t: Tables) -> Published:
    """The marts of a folder, built once per application, then read by every view."""
    key = (t.spark.sparkContext.applicationId, t.folder)
    if key not in _ROOTS:
        root = scratch_path(t.spark, "marts")
        publish_all(t.spark, root, written_inputs(t), PARTIAL_YEAR, PARTIAL_YEAR - 1)
        _ROOTS[key] = root
    return Published(t.spark, _ROOTS[key])


# --- the same as SQL ----------------------------------------------------------------------------

LABEL_SQL = """
county_of AS (SELECT CAST(c_custkey AS INTEGER) AS county, c_nationkey AS zone_code, c_mktsegment AS segment, c_acctbal AS balance FROM customer),
cities AS (
  SELECT zone_code, 'City ' || (county % 7) || CASE county % 4 WHEN 0 THEN ', OH' WHEN 1 THEN ', TX' WHEN 2 THEN ', UT' ELSE '' END AS city, balance AS p
  FROM county_of WHERE county % 3 = 0 AND zone_code <> 3 AND balance IS NOT NULL),
tops AS (SELECT zone_code, max(p) AS top, first(city ORDER BY -p, city) AS leader FROM cities GROUP BY zone_code),
by_city AS (
  SELECT zone_code, CASE WHEN max(top) > 0 THEN string_agg(city, ' & ' ORDER BY -p, city) FILTER (WHERE p >= top * 0.8) ELSE max(leader) END AS label
  FROM cities JOIN tops USING (zone_code) GROUP BY zone_code),
county_names AS (
  SELECT DISTINCT zone_code, segment || coalesce(' Co., ' || upper(r_name[1:2]), '') AS name
  FROM county_of LEFT JOIN region ON county % 6 = r_regionkey),
by_county AS (
  SELECT zone_code, CASE WHEN count(*) = 1 THEN 'County: ' ELSE 'Counties: ' END || string_agg(name, ', ' ORDER BY name) AS label FROM county_names GROUP BY zone_code),
chain AS (
  SELECT zone_code, coalesce(c.label, n.label, 'CZ ' || zone_code) AS label
  FROM (SELECT DISTINCT zone_code FROM county_of) LEFT JOIN by_city c USING (zone_code) LEFT JOIN by_county n USING (zone_code)),
labels AS (
  SELECT county, zone_code, zone FROM county_of
  JOIN (SELECT zone_code AS z, CASE WHEN count(*) OVER (PARTITION BY label) > 1 THEN label || ' (CZ ' || zone_code || ')' ELSE label END AS zone FROM chain) ON z = zone_code)"""

SUPPLY_SQL = LABEL_SQL + """,
lines AS (
  SELECT l_suppkey AS unitid, s_name, s_acctbal, CAST(year(l_shipdate) AS INTEGER) AS year, p_brand AS code, p_name AS title, CAST(l_linenumber AS VARCHAR) AS award_level,
         l_partkey, sum(CAST(l_quantity AS BIGINT)) AS total, sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS focus
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY ALL),
last_names AS (SELECT unitid, CASE WHEN max(year) < 1995 THEN 'Old ' || s_name ELSE s_name END AS entity FROM lines GROUP BY unitid, s_name),
supply AS (
  SELECT unitid, entity, year, code, title, award_level, CAST(total AS BIGINT) AS total, CAST(focus AS BIGINT) AS focus, zone,
         CAST(1000 + (unitid * 7 + year) % 500 AS BIGINT) AS enrolled,
         CASE WHEN s_acctbal < 0 THEN 1 ELSE 0 END AS tribal, CASE WHEN s_acctbal >= 5000 THEN 1 WHEN s_acctbal >= 0 THEN 0 END AS rural
  FROM lines JOIN last_names USING (unitid) LEFT JOIN labels ON county = 1 + unitid % 100)"""

DEMAND_SQL = LABEL_SQL + """,
occ AS (
  SELECT DISTINCT lpad(CAST(p_size AS VARCHAR), 2, '0') || '-' || p_type AS soc, p_type || ' grade ' || p_size AS soc_title, p_size % 5 + 1 AS ed_req, p_size % 2 AS focus_flag,
         CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END AS industry_energy, CASE WHEN p_size % 3 <> 2 THEN 1 ELSE 0 END AS industry_farm_work
  FROM part WHERE p_size % 10 <> 9),
posted AS (
  SELECT CAST(o_custkey AS INTEGER) AS county, CAST(year(o_orderdate) AS INTEGER) AS year, lpad(CAST(p_size AS VARCHAR), 2, '0') || '-' || p_type AS soc, sum(CAST(l_quantity AS BIGINT)) AS total
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE o_custkey % 50 <> 0 GROUP BY ALL),
people AS (SELECT county AS county_no, floor(balance) AS population FROM county_of WHERE balance > 0),
demand AS (
  SELECT zone, year, soc, avg(population) AS population, CAST(sum(total) AS BIGINT) AS total, any_value(ed_req) AS ed_req,
         coalesce(any_value(focus_flag), 0) AS focus_flag, any_value(industry_energy) AS industry_energy, any_value(industry_farm_work) AS industry_farm_work, any_value(soc_title) AS soc_title
  FROM posted JOIN labels USING (county) LEFT JOIN occ USING (soc) LEFT JOIN people ON county_no = county AND year BETWEEN 1992 AND 2001
  GROUP BY zone, year, soc),
zone_years AS (
  SELECT zone, year, CAST(sum(total) AS BIGINT) AS total, CAST(sum(CASE WHEN focus_flag = 1 THEN total ELSE 0 END) AS BIGINT) AS focus, avg(population) AS population
  FROM demand GROUP BY zone, year)"""
