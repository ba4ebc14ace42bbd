"""Questions about postings: zone metrics, trends, national means, occupations, leaderboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionlens.functions.codes import classify_occupation
from regionlens.functions.numbers import ratio
from regionlens.functions.text import comma, comma_tenths, percent_text, pretty_zone
from regionlens.operators.aggregates import (
    demand_rates,
    lead_zones,
    mix,
    national_demand,
    roll_up_postings,
    summarise_zones,
    yearly_demand,
    zone_population,
)
from regionlens.operators.joins import look_up
from regionlens.operators.labels import largest_zone_per_label
from regionlens.operators.ranking import (
    ascending,
    descending,
    group_total,
    leaderboard,
    order_groups_and_items,
    top_items_per_group,
    top_rows_per_group,
)
from regionlens.plans.facts import (
    DEMAND_SQL,
    ZONE_YEAR_SQL,
    Tables,
    demand_lines,
    demand_by_order,
    residents,
    supply_by_unit,
    units,
    with_demand_names,
)
from regionlens.plans.registry import query, rounded
from regionlens.session import materialize
from regionlens.sources.readers import before_year, outside_year, year_choice

PARTIAL_YEAR = 2001
LAST_FULL_YEAR = 2000
LEADERS = 150
SHOWN = 15


def complete_years() -> Column:
    return outside_year(F.col("o_orderdate"), PARTIAL_YEAR)


def zone_years(t: Tables, when: Column | None = None) -> DataFrame:
    """Zone and year: total, focus and mean population."""
    return yearly_demand(demand_by_order(t, when), weight="rows")


RATES_SQL = """round(population, 6) AS population,
           round(CASE WHEN total > 0 THEN CAST(focus AS DOUBLE) / total * 100 END, 6) AS focus_percent"""


@query(
    "zone_year_metrics",
    f"""WITH {ZONE_YEAR_SQL}
    SELECT zone, year, total, focus, {RATES_SQL},
           round(CASE WHEN population > 0 THEN total / population * 1000 END, 6) AS per_1000 FROM zy""",
)
def zone_year_metrics(t: Tables) -> DataFrame:
    """Totals and rates per zone and year, with all postings per 1,000 residents as on the map."""
    rates = demand_rates(zone_years(t), numerator="total").withColumnRenamed("per_capita", "per_1000")
    return rounded(rates)


@query(
    "zone_trend",
    f"""WITH {ZONE_YEAR_SQL}
    SELECT zone, year, total, focus, {RATES_SQL},
           round(CASE WHEN population > 0 THEN focus / population * 1000 END, 6) AS per_1000
    FROM zy WHERE year <> {PARTIAL_YEAR}""",
)
def zone_trend(t: Tables, zone: str | None = None) -> DataFrame:
    """Yearly series of every zone, or of one, without the partial year."""
    trend = demand_rates(zone_years(t, complete_years())).withColumnRenamed("per_capita", "per_1000")
    return rounded(trend if zone is None else trend.where(F.col("zone") == zone))


@query(
    "national_avg_demand",
    f"""WITH {ZONE_YEAR_SQL}
    SELECT year, round(avg(total), 6) AS mean_total, round(avg(focus), 6) AS mean_focus, round(avg(population), 6) AS mean_population,
           round(avg(focus) / avg(total), 6) AS focus_share, round(avg(focus) / avg(population) * 1000, 6) AS per_1000
    FROM zy GROUP BY year""",
)
def national_avg_demand(t: Tables) -> DataFrame:
    return rounded(national_demand(zone_years(t)))


@query(
    "zone_summary",
    f"""WITH {ZONE_YEAR_SQL}
    SELECT zone, round(avg(population), 6) AS mean_population, round(avg(total), 6) AS mean_total, round(avg(focus), 6) AS mean_focus,
           round(avg(focus) / avg(total), 6) AS focus_share, round(avg(total) / avg(population) * 1000, 6) AS per_1000
    FROM zy GROUP BY zone""",
)
def zone_summary(t: Tables) -> DataFrame:
    summary = rounded(summarise_zones(zone_years(t)))
    return summary.orderBy(descending("mean_total"), ascending("zone"))


LEADERS_SQL = ZONE_YEAR_SQL + f""",
m AS (
  SELECT zone, avg(focus) AS mean_focus, avg(CASE WHEN total > 0 THEN CAST(focus AS DOUBLE) / total END) AS mean_share,
         avg(CASE WHEN population > 0 THEN focus / population * 1000 END) AS mean_per_1000
  FROM zy WHERE year <> {PARTIAL_YEAR} GROUP BY zone)"""


@query(
    "leaders_zone",
    f"""WITH {LEADERS_SQL}
    SELECT zone, round(mean_focus, 6) AS mean_focus, round(mean_share, 6) AS mean_share, round(mean_per_1000, 6) AS mean_per_1000 FROM m""",
)
def leaders_zone(t: Tables) -> DataFrame:
    """Mean focus postings, mean share and mean rate of every zone over the complete years."""
    return rounded(zone_means(t))


def zone_means(t: Tables) -> DataFrame:
    return lead_zones(zone_years(t, complete_years()))


def _leaders_sql(metric: str, text: str) -> str:
    return f"""WITH {LEADERS_SQL}
    SELECT zone, round({metric}, 6) AS {metric}, CAST(row_number() OVER (ORDER BY {metric} DESC NULLS LAST, zone) AS BIGINT) AS rank,
           regexp_replace(regexp_replace(zone, ' CZ$', ''), '^[0-9]+ ', '') || ' — ' || {text} AS caption
    FROM m ORDER BY rank LIMIT {LEADERS}"""


def zone_leaderboard(t: Tables, metric: str, text: Column) -> DataFrame:
    return rounded(leaderboard(zone_means(t), "zone", metric, text, LEADERS, pretty_zone(F.col("zone"))))


@query("leaders_zone_posts", _leaders_sql("mean_focus", "format('{:,}', CAST(round_even(mean_focus, 0) AS BIGINT))"))
def leaders_zone_posts(t: Tables) -> DataFrame:
    return zone_leaderboard(t, "mean_focus", comma(F.col("mean_focus")))


@query(
    "leaders_zone_pct",
    _leaders_sql("mean_share", "regexp_replace(printf('%.1f', round_even(mean_share * 100, 1)), '\\.0$', '') || '%'"),
)
def leaders_zone_pct(t: Tables) -> DataFrame:
    return zone_leaderboard(t, "mean_share", percent_text(F.col("mean_share")))


@query("leaders_zone_per1000", _leaders_sql("mean_per_1000", "format('{:,.1f}', mean_per_1000)"))
def leaders_zone_per1000(t: Tables) -> DataFrame:
    return zone_leaderboard(t, "mean_per_1000", comma_tenths(F.col("mean_per_1000")))


@query(
    "fact_zone_year_code",
    f"""WITH {DEMAND_SQL}
    SELECT zone, year, soc, CAST(sum(total) AS BIGINT) AS total, round(CAST(sum(population) AS DOUBLE) / count(population), 6) AS population,
           min(soc_title) AS soc_title,
           first(ed_req ORDER BY l_orderkey) AS ed_req, coalesce(first(order_flag ORDER BY l_orderkey), 0) AS focus_flag
    FROM (SELECT *, max(focus_flag) OVER (PARTITION BY l_orderkey, soc) AS order_flag FROM d) GROUP BY zone, year, soc""",
)
def fact_zone_year_code(t: Tables) -> DataFrame:
    """Orders as county rows. The numeric attributes come from the first order, the title from the code."""
    lines = demand_lines(t, "population", "ed_req").withColumnsRenamed({"zone_code": "zone", "soc_id": "soc"})
    keys = {"ed_req": F.col("order_key"), "focus_flag": F.col("flag_key")}
    rolled = roll_up_postings(lines, F.col("order_key"), keys, mean=ratio(F.sum("population"), F.count("population")))
    return rounded(with_demand_names(rolled.withColumnsRenamed({"zone": "zone_code", "soc": "soc_id"}), t))


def county_years(t: Tables) -> DataFrame:
    """County populations: one row per county and year with an order, made distinct before the join."""
    active = t.read("orders").selectExpr("o_custkey AS county", "year(o_orderdate) AS year").distinct()
    return active.join(residents(t, "zone_code", "zone", "segment", "population"), "county")


COUNTY_YEAR_SQL = DEMAND_SQL + """,
cy AS (SELECT DISTINCT c_custkey AS county, n_nationkey AS zone_code, n_name AS zone, c_mktsegment AS segment,
              CAST(year(o_orderdate) AS INTEGER) AS year,
              CASE WHEN c_acctbal > 0 THEN CAST(c_acctbal AS DECIMAL(12,2)) END AS population
       FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


@query(
    "zone_population_sum",
    f"""WITH {COUNTY_YEAR_SQL}
    SELECT zone, year, CAST(coalesce(sum(population), 0) AS DOUBLE) AS population FROM cy WHERE year <= {LAST_FULL_YEAR} GROUP BY zone, year""",
)
def zone_population_sum(t: Tables) -> DataFrame:
    return zone_population(county_years(t), LAST_FULL_YEAR).withColumn("population", F.col("population").cast("double"))


@query(
    "label_to_zone_unique",
    f"""WITH {COUNTY_YEAR_SQL},
    p AS (SELECT segment, zone_code, sum(population) AS people FROM cy GROUP BY segment, zone_code),
    r AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY people DESC NULLS LAST, zone_code) AS place FROM p)
    SELECT segment, zone_code FROM r WHERE place = 1""",
)
def label_to_zone_unique(t: Tables) -> DataFrame:
    return largest_zone_per_label(county_years(t), "zone_code", "segment")


@query(
    "join_left_multikey",
    f"""WITH {ZONE_YEAR_SQL},
    a AS (SELECT n_name AS zone, CAST(year(l_shipdate) AS INTEGER) AS year, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS awards
          FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2 HAVING year <= 1999)
    SELECT zone, year, total, awards FROM zy LEFT JOIN a USING (zone, year)""",
)
def join_left_multikey(t: Tables) -> DataFrame:
    """Postings next to awards of the same zone and year; awards are known up to 1999."""
    awards = supply_by_unit(t, when=before_year(F.col("l_shipdate"), 2000)).join(units(t, "zone"), "unitid")
    by_zone = awards.groupBy("zone", "year").agg(F.sum("total").alias("awards"))
    return look_up(zone_years(t).select("zone", "year", "total"), by_zone, ["zone", "year"])


TOTALS = ("group_total", "title_total")


def occupation_mix(t: Tables, year: int | str | None = None) -> DataFrame:
    """Focus postings per zone, occupation and education requirement, complete years, with totals."""
    lines = demand_lines(t, "ed_req", when=complete_years(), lines=F.col("l_returnflag") == "R").where(year_choice(year))
    named = with_demand_names(mix(lines, ["zone_code", "soc_id", "ed_req"], positive=False), t)
    known = named.where(F.col("soc_title").isNotNull() & F.col("soc").isNotNull())
    labelled = classify_occupation(known.select("zone", "soc", "soc_title", "ed_req", "focus"), "soc").drop("group_full")
    # An occupation has a row per level, a group at most a code table's occupations: no task gets a whole zone.
    grouped = group_total(labelled, "focus", ["zone", "group"], "group_total")
    return group_total(grouped, "focus", ["zone", "soc_title"], "title_total")


OCCUPATION_SQL = DEMAND_SQL + f""",
o AS (SELECT zone, soc, soc_title, ed_req, sum(total) AS focus FROM d WHERE focus_flag = 1 AND year <> {PARTIAL_YEAR}
      GROUP BY zone, soc, soc_title, ed_req),
g AS (SELECT *, CASE soc[1:2] WHEN '11' THEN 'Management' WHEN '13' THEN 'Business & Financial Ops' WHEN '15' THEN 'Computer & Math'
        WHEN '17' THEN 'Architecture & Engineering' WHEN '19' THEN 'Life/Physical/Social Sci' WHEN '21' THEN 'Community & Social Service'
        WHEN '23' THEN 'Legal' WHEN '25' THEN 'Education & Library' WHEN '27' THEN 'Arts, Media & Sports'
        WHEN '29' THEN 'Healthcare Practitioners & Tech' WHEN '31' THEN 'Healthcare Support' WHEN '33' THEN 'Protective Service'
        WHEN '35' THEN 'Food Prep & Serving' WHEN '37' THEN 'Building & Grounds Maint' WHEN '39' THEN 'Personal Care & Service'
        WHEN '41' THEN 'Sales & Related' WHEN '43' THEN 'Office & Admin Support' WHEN '45' THEN 'Farming/Fishing/Forestry'
        WHEN '47' THEN 'Construction & Extraction' WHEN '49' THEN 'Install/Maint/Repair' ELSE 'Other' END AS "group" FROM o),
w AS (SELECT *, sum(focus) OVER (PARTITION BY zone, soc_title) AS title_total,
             sum(focus) OVER (PARTITION BY zone, "group") AS group_total FROM g)"""
OCCUPATION_COLUMNS = """zone, soc, soc_title, ed_req, CAST(focus AS BIGINT) AS focus, "group",
  CAST(title_total AS BIGINT) AS title_total, CAST(group_total AS BIGINT) AS group_total, CAST(rank AS INTEGER) AS rank"""


@query(
    "occupations_top_rows",
    f"""WITH {OCCUPATION_SQL},
    r AS (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY title_total DESC, soc_title, ed_req, soc) AS rank FROM w)
    SELECT {OCCUPATION_COLUMNS} FROM r WHERE rank <= {SHOWN}""",
)
def occupations_top_rows(t: Tables, n: int | None = SHOWN, year: int | str | None = None) -> DataFrame:
    """The first `n` rows (occupation and education) of every zone; totals are taken before the cut."""
    order = [descending("title_total"), ascending("soc_title"), ascending("ed_req"), ascending("soc")]
    return top_rows_per_group(occupation_mix(t, year), order, ["zone"], n)


@query(
    "occupations_top_groups",
    f"""WITH {OCCUPATION_SQL},
    r AS (SELECT *, dense_rank() OVER (PARTITION BY zone ORDER BY title_total DESC, soc_title) AS rank FROM w)
    SELECT {OCCUPATION_COLUMNS} FROM r WHERE rank <= {SHOWN}""",
)
def occupations_top_groups(t: Tables, n: int | None = SHOWN, year: int | str | None = None) -> DataFrame:
    """All rows of the first `n` occupations of every zone."""
    order = [descending("title_total"), ascending("soc_title")]
    return top_items_per_group(occupation_mix(t, year), order, ["zone"], n)


def _order_sql(shown: str) -> str:
    return f"""SELECT {OCCUPATION_COLUMNS},
      CAST(dense_rank() OVER (PARTITION BY zone ORDER BY group_total DESC, "group") AS INTEGER) AS group_rank,
      CAST(dense_rank() OVER (PARTITION BY zone, "group" ORDER BY title_total DESC, soc_title) AS INTEGER) AS item_rank FROM {shown}"""


@query(
    "occupations_in_order",
    f"""WITH {OCCUPATION_SQL},
    r AS (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY title_total DESC, soc_title, ed_req, soc) AS rank FROM w),
    shown AS (SELECT * FROM r WHERE rank <= {SHOWN})
    {_order_sql("shown")}""",
)
def occupations_in_order(t: Tables, n: int | None = SHOWN, year: int | str | None = None) -> DataFrame:
    """The rows shown for every zone with the place of their group among those shown and of the occupation in its group."""
    shown = occupations_top_rows(t, n, year)
    return order_groups_and_items(materialize(shown, "shown"), "group", "soc_title", ["zone"], TOTALS)


@query(
    "occupations_in_order_all",
    f"""WITH {OCCUPATION_SQL}, shown AS (SELECT *, dense_rank() OVER (PARTITION BY zone ORDER BY title_total DESC, soc_title) AS rank FROM w)
    {_order_sql("shown").replace(", CAST(rank AS INTEGER) AS rank", "")}""",
)
def occupations_in_order_all(t: Tables) -> DataFrame:
    """The order of all groups and occupations of every zone, without a cut."""
    return order_groups_and_items(materialize(occupation_mix(t), "occupations"), "group", "soc_title", ["zone"], TOTALS)
