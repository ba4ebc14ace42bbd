"""The supply and the demand fact over the star-schema test tables.

Supply: a supplier is the entity, its nation the zone, a part's brand the program code, the line
number the award level, the quantity the awards, returned lines the focus awards.
Demand: a customer is the county, its nation the zone, part size and type the occupation, the order
priority the education requirement, the quantity the postings, the positive balance the population.

Lines are summed per key before they meet a larger table, so a key that holds a large part of all
lines reaches the shuffle as a few rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regionlens.functions.numbers import first_by
from regionlens.sources.readers import read_parquet


# Columns of the star-schema tables. Declared, so that opening a table starts no job.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
        "l_shipdate timestamp_ntz"
    ),
}


class Tables:
    """Parquet tables of one folder, read on demand."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")

    def read(self, name: str, *columns: str) -> DataFrame:
        return read_parquet(self.spark, f"{self.folder}/{name}.parquet", columns, SCHEMAS[name])


def year_of(moment: str) -> Column:
    return F.year(moment)


def shaped(df: DataFrame, expressions: dict[str, str], names: Sequence[str]) -> DataFrame:
    """The asked columns of a view given as SQL expressions."""
    return df.selectExpr(*[f"{expressions[name]} AS `{name}`" for name in names])


# A returned line is in focus, an accepted one is not, for an open one it is unknown.
FOCUS_FLAG = "CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 0 END"
QUANTITY = "CAST(l_quantity AS BIGINT)"
FOCUS = f"CASE l_returnflag WHEN 'R' THEN {QUANTITY} ELSE 0 END"

# --- supply -----------------------------------------------------------------------------------

# Enrolment is the same on all rows of a unit and year; the site is known on part of a unit's rows.
LINES = {
    "unitid": "l_suppkey",
    "part_id": "l_partkey",
    "order_key": "l_orderkey",
    "year": "year(l_shipdate)",
    "award_level": "l_linenumber",
    "total": QUANTITY,
    "focus": FOCUS,
    "enrolled": "1000 + (l_suppkey * 7 + year(l_shipdate)) % 500",
    "site": "CASE WHEN l_returnflag <> 'N' THEN l_suppkey % 50 END",
}

UNITS = {
    "unitid": "s_suppkey",
    "entity": "s_name",
    "n_nationkey": "s_nationkey",
    "rural": "CASE WHEN s_acctbal >= 5000 THEN 1 WHEN s_acctbal >= 0 THEN 0 END",
    "tribal": "CASE WHEN s_acctbal < 0 THEN 1 ELSE 0 END",
    "longitude": "CASE WHEN s_suppkey % 10 <> 0 THEN round(CAST(s_suppkey * 37 % 5900 AS DOUBLE) / 100 - 125, 2) END",
    "latitude": "CASE WHEN s_suppkey % 10 <> 5 THEN round(CAST(s_suppkey * 17 % 2400 AS DOUBLE) / 100 + 25, 2) END",
}


def supply_lines(t: Tables, *names: str, when: Column | None = None) -> DataFrame:
    """Columns of the supply fact. `when` is a condition on the stored columns and reaches the scan."""
    lines = t.read("lineitem")
    return shaped(lines if when is None else lines.where(when), LINES, names)


def units(t: Tables, *attributes: str) -> DataFrame:
    """Suppliers with the attributes asked for; the zone is joined only if it is among them."""
    if "zone" not in attributes:
        return shaped(t.read("supplier"), UNITS, ["unitid", *attributes])
    own = [a for a in attributes if a != "zone"]
    nations = t.read("nation", "n_nationkey", "n_name").withColumnRenamed("n_name", "zone")
    return shaped(t.read("supplier"), UNITS, ["unitid", *own, "n_nationkey"]).join(nations, "n_nationkey").drop("n_nationkey")


def programs(t: Tables) -> DataFrame:
    return t.read("part").selectExpr("p_partkey AS part_id", "p_brand AS code", "p_name AS title")


def supply_by_unit(
    t: Tables, *extra: Column, reads: Sequence[str] = (), when: Column | None = None, only: DataFrame | None = None
) -> DataFrame:
    """Unit and year, summed before any join; `only` keeps the lines of some units."""
    lines = supply_lines(t, "unitid", "year", "total", "focus", *reads, when=when)
    if only is not None:
        lines = lines.join(only.select("unitid"), "unitid", "left_semi")
    return lines.groupBy("unitid", "year").agg(F.sum("total").alias("total"), F.sum("focus").alias("focus"), *extra)


def supply_by_entity(t: Tables, *attributes: str, enrolment: bool = False) -> DataFrame:
    """Unit and year over the whole fact, with the unit's name and attributes."""
    if enrolment:
        first = first_by(F.col("enrolled"), F.col("order_key")).alias("enrolled")
        sums = supply_by_unit(t, first, reads=["order_key", "enrolled"])
    else:
        sums = supply_by_unit(t)
    return sums.join(units(t, "entity", *attributes), "unitid")


def focus_by_program(t: Tables, with_year: bool = False) -> DataFrame:
    """Focus awards per unit, program and award level (and year).

    Lines without focus awards add nothing and are dropped at the scan. The rest is summed by numbers alone, per unit
    and part; the texts of parts and units are joined to the sums.
    """
    time = ["year"] if with_year else []
    focus_only = F.col("l_returnflag") == "R"
    lines = supply_lines(t, "unitid", "part_id", "award_level", "focus", *time, when=focus_only)
    sums = lines.groupBy("unitid", "part_id", "award_level", *time).agg(F.sum("focus").alias("focus"))
    return sums.join(programs(t), "part_id").drop("part_id").join(units(t, "entity"), "unitid")


# --- demand -----------------------------------------------------------------------------------


def residents(t: Tables, *names: str) -> DataFrame:
    """Customers as counties with the zone and population columns asked for."""
    columns = {
        "county": "c_custkey",
        "segment": "c_mktsegment",
        "population": "CASE WHEN c_acctbal > 0 THEN CAST(c_acctbal AS DECIMAL(12,2)) END",
        "zone_code": "n_nationkey",
        "zone": "n_name",
    }
    customers, nations = t.read("customer"), t.read("nation", "n_nationkey", "n_name")
    return shaped(customers.join(nations, customers["c_nationkey"] == nations["n_nationkey"]), columns, ["county", *names])


def demand_orders(t: Tables, *names: str, when: Column | None = None) -> DataFrame:
    """One row per order: its key, county and year, the education code, and the county's columns.

    The education requirement is kept as its numeric code. `when` reaches the scan of the orders.
    """
    orders = t.read("orders")
    columns = {
        "order_key": "o_orderkey",
        "county": "o_custkey",
        "year": "year(o_orderdate)",
        "ed_req": "CAST(substr(o_orderpriority, 1, 1) AS INT)",
    }
    own = ["order_key", "county", "year", *[n for n in names if n in columns]]
    dated = shaped(orders if when is None else orders.where(when), columns, own)
    return dated.join(residents(t, *[n for n in names if n not in columns]), "county")


def occupations(t: Tables) -> DataFrame:
    """Every part with the code and title of its occupation, which its size and type make."""
    return t.read("part").selectExpr(
        "p_partkey AS part_id",
        "lpad(CAST(p_size AS STRING), 2, '0') || '-' || p_type AS soc",
        "p_type || ' grade ' || CAST(p_size AS STRING) AS soc_title",
    )


def _smallest_parts(t: Tables) -> DataFrame:
    """Size and type, which make an occupation, with the smallest part that has them: the occupation's number."""
    parts = t.read("part", "p_partkey", "p_size", "p_type")
    return parts.groupBy(F.struct("p_size", "p_type").alias("_kind")).agg(F.min("p_partkey").alias("soc_id"))


def occupation_numbers(t: Tables) -> DataFrame:
    """Part and the number of its occupation, so that facts are summed by numbers; unknown sizes and types count as values."""
    parts = t.read("part", "p_partkey", "p_size", "p_type").select(F.col("p_partkey").alias("part_id"), F.struct("p_size", "p_type").alias("_kind"))
    return parts.join(_smallest_parts(t), "_kind").select("part_id", "soc_id")


def zone_names(t: Tables) -> DataFrame:
    return t.read("nation", "n_nationkey", "n_name").selectExpr("n_nationkey AS zone_code", "n_name AS zone")


def demand_by_order(t: Tables, when: Column | None = None) -> DataFrame:
    """The demand fact per order; `rows` is the number of original rows.

    Lines are summed per order first. That shuffle is the one the join needs, and an order that
    holds a large part of all lines crosses it as one row per task.
    """
    lines = t.read("lineitem").selectExpr("l_orderkey AS order_key", f"{QUANTITY} AS total", f"{FOCUS} AS focus")
    sums = lines.groupBy("order_key").agg(
        F.sum("total").alias("total"), F.sum("focus").alias("focus"), F.count(F.lit(1)).alias("rows")
    )
    return sums.join(demand_orders(t, "zone", "population", when=when), "order_key")


def demand_lines(t: Tables, *names: str, when: Column | None = None, lines: Column | None = None) -> DataFrame:
    """Every line with its order's columns and the number of its occupation: numbers only, names are joined to sums.

    `flag_key` orders by order and puts a focus line before the other lines of the order.
    """
    fact = t.read("lineitem")
    fact = (fact if lines is None else fact.where(lines)).selectExpr(
        "l_orderkey AS order_key", "l_partkey AS part_id", f"{QUANTITY} AS total", f"{FOCUS} AS focus", f"{FOCUS_FLAG} AS focus_flag"
    )
    place = F.when(F.col("focus_flag") == 1, 0).when(F.col("focus_flag") == 0, 1).otherwise(2)
    placed = fact.join(demand_orders(t, "zone_code", *names, when=when), "order_key").withColumn("flag_key", F.col("order_key") * 4 + place)
    return placed.join(occupation_numbers(t), "part_id")


def with_demand_names(sums: DataFrame, t: Tables) -> DataFrame:
    """Occupation code, title and zone in place of their numbers."""
    occupation = occupations(t).withColumnRenamed("part_id", "soc_id")
    return sums.join(occupation, "soc_id").join(zone_names(t), "zone_code").drop("soc_id", "zone_code")


# --- the same facts as SQL, row by row ----------------------------------------------------------

SUPPLY_SQL = """
units AS (
  SELECT s_suppkey AS unitid, s_name AS entity, n_name AS zone,
         CASE WHEN s_acctbal >= 5000 THEN 1 WHEN s_acctbal >= 0 THEN 0 END AS rural,
         CASE WHEN s_acctbal < 0 THEN 1 ELSE 0 END AS tribal,
         CASE WHEN s_suppkey % 10 <> 0 THEN round(CAST(s_suppkey * 37 % 5900 AS DOUBLE) / 100 - 125, 2) END AS longitude,
         CASE WHEN s_suppkey % 10 <> 5 THEN round(CAST(s_suppkey * 17 % 2400 AS DOUBLE) / 100 + 25, 2) END AS latitude
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
s AS (
  SELECT u.*, CAST(year(l_shipdate) AS INTEGER) AS year, p_brand AS code, p_name AS title, l_linenumber AS award_level,
         CAST(l_quantity AS BIGINT) AS total,
         CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) ELSE 0 END AS focus,
         CAST(1000 + (l_suppkey * 7 + year(l_shipdate)) % 500 AS BIGINT) AS enrolled,
         CASE WHEN l_returnflag <> 'N' THEN l_suppkey % 50 END AS site,
         l_orderkey, l_linenumber, l_partkey, l_suppkey
  FROM lineitem JOIN units u ON l_suppkey = u.unitid JOIN part ON l_partkey = p_partkey)"""

ENTITY_YEAR_SQL = SUPPLY_SQL + """,
ey AS (
  SELECT entity, year, CAST(sum(total) AS BIGINT) AS total, CAST(sum(focus) AS BIGINT) AS focus,
         first(enrolled ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS enrolled,
         min(zone) AS zone, min(rural) AS rural, min(tribal) AS tribal, min(unitid) AS unitid,
         min(longitude) AS longitude, min(latitude) AS latitude
  FROM s GROUP BY entity, year)"""

DEMAND_SQL = """
d AS (
  SELECT c_custkey AS county, n_nationkey AS zone_code, n_name AS zone, c_mktsegment AS segment,
         CAST(year(o_orderdate) AS INTEGER) AS year,
         lpad(CAST(p_size AS VARCHAR), 2, '0') || '-' || p_type AS soc,
         p_type || ' grade ' || CAST(p_size AS VARCHAR) AS soc_title,
         CAST(o_orderpriority[1:1] AS INTEGER) AS ed_req,
         CASE WHEN l_returnflag = 'R' THEN 1 WHEN l_returnflag = 'A' THEN 0 END AS focus_flag,
         CAST(l_quantity AS BIGINT) AS total,
         CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) ELSE 0 END AS focus,
         CASE WHEN c_acctbal > 0 THEN CAST(c_acctbal AS DECIMAL(12,2)) END AS population,
         l_orderkey, l_linenumber, l_partkey, l_suppkey
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey)"""

ZONE_YEAR_SQL = DEMAND_SQL + """,
zy AS (
  SELECT zone, year, CAST(sum(total) AS BIGINT) AS total, CAST(sum(focus) AS BIGINT) AS focus,
         CAST(sum(population) AS DOUBLE) / count(population) AS population
  FROM d GROUP BY zone, year)"""
