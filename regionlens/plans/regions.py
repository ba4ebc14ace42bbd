"""Joins, names and labels: crosswalks, canonical names, zone labels, one-hot tables, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionlens.functions.codes import label_codes
from regionlens.operators.aggregates import (
    first_of_family,
    frequencies,
    one_hot,
    snake_names,
    units_with_many_names,
    year_spine,
)
from regionlens.operators.joins import keep_matches, look_up, look_up_common, look_up_renamed, stack_extracts
from regionlens.operators.labels import (
    county_list_label,
    dedupe_labels,
    dominant_city_label,
    label_chain,
    use_latest_name,
)
from regionlens.operators.ranking import ascending, descending, ordinal
from regionlens.plans.facts import Tables, year_of
from regionlens.plans.registry import query
from regionlens.session import materialize

# The order priorities, most urgent first, with the names used for columns and labels.
PRIORITIES = [
    ("1-URGENT", "urgent"),
    ("2-HIGH", "high"),
    ("3-MEDIUM", "medium"),
    ("4-NOT SPECIFIED", "not_specified"),
    ("5-LOW", "low"),
]


@query("distinct_pairs", "SELECT DISTINCT o_custkey, o_orderpriority FROM orders")
def distinct_pairs(t: Tables) -> DataFrame:
    return t.read("orders", "o_custkey", "o_orderpriority").distinct()


@query(
    "freq_sorted",
    """WITH f AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2)
    SELECT *, row_number() OVER (ORDER BY n DESC, o_custkey, o_orderpriority) AS rank FROM f""",
)
def freq_sorted(t: Tables) -> DataFrame:
    """Frequency table, most frequent first, ties by key."""
    counts = frequencies(t.read("orders"), "o_custkey", "o_orderpriority")
    return ordinal(counts, [descending("n"), ascending("o_custkey"), ascending("o_orderpriority")], name="rank")


@query(
    "audit_multi_name",
    """WITH p AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders)
    SELECT o_custkey, count(*) AS names FROM p GROUP BY o_custkey HAVING count(*) > 1""",
)
def audit_multi_name(t: Tables) -> DataFrame:
    """Customers under more than one name, most names first."""
    audit = units_with_many_names(t.read("orders"), "o_custkey", "o_orderpriority")
    return audit.orderBy(descending("names"), ascending("o_custkey"))


def crosswalk(t: Tables) -> DataFrame:
    """Nations outside the first region, as the crosswalk leaves out one state."""
    return t.read("nation", "n_nationkey", "n_name", "n_regionkey").where(F.col("n_regionkey") != 0)


@query(
    "join_inner_crosswalk",
    """SELECT s_suppkey, s_name, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
    LEFT JOIN region ON n_regionkey = r_regionkey WHERE n_regionkey <> 0""",
)
def join_inner_crosswalk(t: Tables) -> DataFrame:
    suppliers = t.read("supplier", "s_suppkey", "s_name", "s_nationkey").withColumnRenamed("s_nationkey", "n_nationkey")
    placed = keep_matches(suppliers, crosswalk(t), "n_nationkey")
    regions = t.read("region", "r_regionkey", "r_name").withColumnRenamed("r_regionkey", "n_regionkey")
    return look_up(placed, regions, "n_regionkey").select("s_suppkey", "s_name", "n_name", "r_name")


@query(
    "join_left_lookup",
    """WITH x AS (SELECT * FROM nation WHERE n_regionkey <> 0)
    SELECT c_custkey AS custkey, c_name AS name, x.n_name AS zone, x.n_name AS name_right, r_name AS region
    FROM customer LEFT JOIN x ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""",
)
def join_left_lookup(t: Tables) -> DataFrame:
    """One lookup on the shared column, one on differently named keys with a clashing column."""
    customers = t.read("customer", "c_custkey", "c_name", "c_nationkey").toDF("custkey", "name", "nationkey")
    zones = crosswalk(t).toDF("nationkey", "zone", "regionkey")
    named = look_up_common(customers, zones)
    again = crosswalk(t).select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    clashing = look_up_renamed(named, again, {"nationkey": "id"})
    regions = t.read("region", "r_regionkey", "r_name").toDF("regionkey", "region")
    return look_up(clashing, regions, "regionkey").select("custkey", "name", "zone", "name_right", "region")


@query(
    "rename_to_latest_name",
    """WITH o AS (SELECT o_orderkey, o_custkey, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority FROM orders),
    c AS (SELECT o_custkey, year, o_orderpriority, count(*) AS n FROM o GROUP BY 1, 2, 3),
    r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY year DESC, n DESC, o_orderpriority) AS place FROM c)
    SELECT o_orderkey, o_custkey, year, r.o_orderpriority AS name FROM o JOIN (SELECT o_custkey, o_orderpriority FROM r WHERE place = 1) r USING (o_custkey)""",
)
def rename_to_latest_name(t: Tables) -> DataFrame:
    orders = t.read("orders").select(
        "o_orderkey", "o_custkey", year_of("o_orderdate").alias("year"), F.col("o_orderpriority").alias("name")
    )
    return use_latest_name(orders, "o_custkey", "name", "year")


@query(
    "year_spine",
    """WITH y AS (SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS orders FROM orders GROUP BY 1, 2),
    b AS (SELECT o_custkey, min(year) AS lo, max(year) AS hi FROM y GROUP BY 1),
    s AS (SELECT o_custkey, CAST(unnest(range(lo, hi + 1)) AS INTEGER) AS year FROM b)
    SELECT o_custkey, year, orders FROM s LEFT JOIN y USING (o_custkey, year)""",
)
def spine(t: Tables) -> DataFrame:
    """Orders per customer and year, with a row for the years in between that have none."""
    yearly = t.read("orders").groupBy("o_custkey", year_of("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("orders"))
    return year_spine(yearly, ["o_custkey"], "orders")


@query(
    "union_yearly_extracts",
    """SELECT source, year, count(*) AS n, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM (
      SELECT 'ordered' AS source, CAST(year(o_orderdate) AS INTEGER) AS year, o_totalprice AS amount FROM orders
      UNION ALL SELECT 'shipped', CAST(year(l_shipdate) AS INTEGER), l_extendedprice FROM lineitem) GROUP BY source, year""",
)
def union_extracts(t: Tables) -> DataFrame:
    """Two dated extracts under each other, each marked with its source; every table is read once."""
    extracts = {
        "ordered": t.read("orders").select(year_of("o_orderdate").alias("year"), F.col("o_totalprice").alias("amount")),
        "shipped": t.read("lineitem").select(year_of("l_shipdate").alias("year"), F.col("l_extendedprice").alias("amount")),
    }
    exact = F.sum(F.col("amount").cast("decimal(18,2)")).cast("double")
    return stack_extracts(extracts, "source").groupBy("source", "year").agg(F.count(F.lit(1)).alias("n"), exact.alias("amount"))


def priority_flags(t: Tables) -> DataFrame:
    """A 0/1 column per order priority and customer."""
    wide = one_hot(t.read("orders"), ["o_custkey"], "o_orderpriority", [code for code, _ in PRIORITIES])
    renames = {"x1_urgent": "industry_urgent", "x2_high": "industry_high", "x3_medium": "industry_medium"}
    renames |= {"x4_not_specified": "industry_not_specified", "x5_low": "industry_low"}
    return snake_names(wide).withColumnsRenamed(renames)


ONE_HOT_SQL = "SELECT o_custkey, " + ", ".join(
    f"CAST(max(CASE WHEN o_orderpriority = '{code}' THEN 1 ELSE 0 END) AS INTEGER) AS industry_{name}" for code, name in PRIORITIES
) + " FROM orders GROUP BY o_custkey"


@query("pivot_onehot", ONE_HOT_SQL)
def pivot_onehot(t: Tables) -> DataFrame:
    return priority_flags(t)


@query(
    "first_across_pattern",
    f"WITH p AS ({ONE_HOT_SQL}) SELECT n_name AS zone, "
    + ", ".join(f"first(industry_{name} ORDER BY o_custkey) AS industry_{name}" for _, name in PRIORITIES)
    + " FROM p JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
)
def first_across_pattern(t: Tables) -> DataFrame:
    """Flags of each zone's first customer."""
    customers = t.read("customer", "c_custkey", "c_nationkey").toDF("o_custkey", "n_nationkey")
    zones = t.read("nation", "n_nationkey", "n_name").withColumnRenamed("n_name", "zone")
    placed = priority_flags(t).join(customers, "o_custkey").join(zones, "n_nationkey")
    return first_of_family(placed, ["zone"], "industry_", F.col("o_custkey"))


@query(
    "label_with_missing",
    """WITH o AS (SELECT CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderpriority END AS code FROM orders)
    SELECT CASE code WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' WHEN '5-LOW' THEN 'low' ELSE 'Missing' END AS label,
           CAST(CASE code WHEN '5-LOW' THEN 1 WHEN '3-MEDIUM' THEN 3 WHEN '2-HIGH' THEN 4 WHEN '1-URGENT' THEN 5 ELSE 7 END AS INTEGER) AS label_rank,
           count(*) AS n FROM o GROUP BY 1, 2""",
)
def label_with_missing(t: Tables) -> DataFrame:
    """Orders per labelled priority in reverse order; the unspecified one is an explicit missing level."""
    code = F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderpriority"))
    counts = t.read("orders").select(code.alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    return label_codes(counts, "code", PRIORITIES, reverse=True).select("label", "label_rank", "n")


# --- zone labels: a nation is a zone, a market segment in it a county and a city -----------------


def places(t: Tables) -> DataFrame:
    """Zone, segment and region with the customers' summed positive balances as population.

    Written once, as the labels read it several times.
    """
    customers = t.read("customer", "c_nationkey", "c_mktsegment", "c_acctbal")
    sums = customers.groupBy("c_nationkey", "c_mktsegment").agg(
        F.sum(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal").cast("decimal(12,2)"))).alias("population")
    )
    zones = t.read("nation", "n_nationkey", "n_regionkey")
    regions = t.read("region", "r_regionkey", "r_name")
    named = (
        sums.join(zones, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("n_nationkey").alias("zone_code"),
            F.concat("c_mktsegment", F.lit(", "), F.col("r_name").substr(1, 2)).alias("city"),
            F.concat("c_mktsegment", F.lit(" Co., "), F.col("r_name").substr(1, 2)).alias("county_name"),
            F.col("population").cast("double").alias("population"),
        )
    )
    return materialize(named, "places")


def cities(known: DataFrame) -> DataFrame:
    """Places of at least the mean population, as city lists leave out small places."""
    mean = known.select(F.round(F.avg("population"), 2)).scalar()
    return known.where(F.col("population") >= mean)


PLACES_SQL = """
p AS (SELECT n_nationkey AS zone_code, c_mktsegment || ', ' || r_name[1:2] AS city, c_mktsegment || ' Co., ' || r_name[1:2] AS county_name,
             CAST(sum(CASE WHEN c_acctbal > 0 THEN CAST(c_acctbal AS DECIMAL(12,2)) END) AS DOUBLE) AS population
      FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3),
big AS (SELECT * FROM p WHERE population >= (SELECT round(avg(population), 2) FROM p)),
r AS (SELECT *, row_number() OVER (PARTITION BY zone_code ORDER BY population DESC, city) AS place,
             max(population) OVER (PARTITION BY zone_code) AS top FROM big),
cl AS (SELECT zone_code, CASE WHEN max(CASE WHEN place = 1 THEN population END) >= 2 * max(CASE WHEN place = 2 THEN population END)
         THEN max(CASE WHEN place = 1 THEN city END)
         ELSE string_agg(CASE WHEN population >= 0.8::DOUBLE * top THEN city END, ' & ' ORDER BY place) END AS zone
       FROM r GROUP BY zone_code),
fl AS (SELECT zone_code, CASE WHEN count(DISTINCT county_name) = 1 THEN 'County: ' ELSE 'Counties: ' END
         || string_agg(DISTINCT county_name, ', ' ORDER BY county_name) AS zone FROM p GROUP BY zone_code),
ch AS (SELECT n_nationkey AS zone_code, coalesce(cl.zone, fl.zone, 'CZ ' || CAST(n_nationkey AS VARCHAR)) AS zone
       FROM nation LEFT JOIN cl ON n_nationkey = cl.zone_code LEFT JOIN fl ON n_nationkey = fl.zone_code)"""


@query("zone_label_dominant", f"WITH {PLACES_SQL} SELECT zone_code, zone FROM cl")
def zone_label_dominant(t: Tables) -> DataFrame:
    return dominant_city_label(cities(places(t)))


@query("zone_label_fallback", f"WITH {PLACES_SQL} SELECT zone_code, zone FROM fl")
def zone_label_fallback(t: Tables) -> DataFrame:
    return county_list_label(places(t))


def chained(t: Tables) -> DataFrame:
    zones = t.read("nation").select(F.col("n_nationkey").alias("zone_code"))
    known = places(t)
    return label_chain(zones, dominant_city_label(cities(known)), county_list_label(known))


@query("zone_label_chain", f"WITH {PLACES_SQL} SELECT zone_code, zone FROM ch")
def zone_label_chain(t: Tables) -> DataFrame:
    return chained(t)


@query(
    "dedupe_labels",
    f"""WITH {PLACES_SQL}, n AS (SELECT *, count(*) OVER (PARTITION BY zone) AS uses FROM ch)
    SELECT zone_code, CASE WHEN uses > 1 THEN zone || ' (CZ ' || CAST(zone_code AS VARCHAR) || ')' ELSE zone END AS zone FROM n""",
)
def deduped(t: Tables) -> DataFrame:
    return dedupe_labels(chained(t))
