"""Scans, casts, code labels, display text, map classes, exports and files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionlens.functions.codes import classify_award, classify_occupation, classify_program
from regionlens.functions.mapping import STEP_BREAKS, STEP_COLOURS, pick, radius, share_class, step_bin, step_labels
from regionlens.functions.numbers import half_even, is_whole, to_int
from regionlens.functions.text import (
    comma,
    comma_tenths,
    drop_suffix,
    html_popup,
    lines,
    percent_fixed,
    percent_text,
    pretty_zone,
    strip_county_prefix,
    strip_space,
    yes_no,
)
from regionlens.operators.aggregates import percent_scaled
from regionlens.plans.demand import demand_rates, zone_year_metrics, zone_years
from regionlens.plans.facts import (
    ENTITY_YEAR_SQL,
    SUPPLY_SQL,
    ZONE_YEAR_SQL,
    Tables,
    occupations,
    supply_by_unit,
    supply_lines,
)
from regionlens.plans.registry import ORACLES, query, rounded
from regionlens.plans.supply import AWARD_SQL, FAMILY_SQL, entity_table, mapped
from regionlens.session import scratch_path
from regionlens.sources.readers import in_year, named_table, read_csv, read_partitions
from regionlens.sources.writers import (
    column_first,
    display_table,
    export_csv,
    point_geometry,
    read_features,
    readable_names,
    write_csv,
    write_features_by_year,
    write_parquet,
    write_partitions,
)

# --- scans --------------------------------------------------------------------------------------


@query(
    "scan_project_filter",
    """SELECT l_orderkey AS order_id, l_suppkey AS unitid, CAST(l_quantity AS BIGINT) AS awards
    FROM lineitem WHERE l_returnflag = 'R' AND l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01'""",
)
def scan_project_filter(t: Tables) -> DataFrame:
    """Focus rows of one year through a named table; both conditions reach the scan."""
    table = named_table(t.read("lineitem"), "lineitem_table")
    rows = table.where((F.col("l_returnflag") == "R") & in_year(F.col("l_shipdate"), 1997))
    return rows.selectExpr("l_orderkey AS order_id", "l_suppkey AS unitid", "CAST(l_quantity AS BIGINT) AS awards")


@query(
    "scan_csv_nulls",
    "SELECT c_custkey AS custkey, c_name AS name, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS balance FROM customer",
)
def scan_csv_nulls(t: Tables) -> DataFrame:
    """Customers written as CSV with `NA` for a non-positive balance, and read back."""
    path = scratch_path(t.spark, "csv-nulls")
    balance = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("balance")
    write_csv(t.read("customer").select(F.col("c_custkey").alias("custkey"), F.col("c_name").alias("name"), balance), path)
    return read_csv(t.spark, path, "custkey bigint, name string, balance double")


@query("filter_text_predicates", "SELECT p_partkey, p_name FROM part WHERE NOT contains(p_name, 'ring') AND NOT starts_with(p_name, 'red')")
def filter_text_predicates(t: Tables) -> DataFrame:
    name = F.col("p_name")
    return t.read("part", "p_partkey", "p_name").where(~name.contains("ring") & ~name.startswith("red"))


@query(
    "cast_fips_codes",
    """WITH c AS (SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 12, '0') AS padded, c_mktsegment FROM customer),
    f AS (SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN padded || 'x' WHEN 'MACHINERY' THEN padded || '.0'
                            WHEN 'FURNITURE' THEN NULL ELSE padded END AS fips FROM c)
    SELECT c_custkey, fips, CAST(trunc(TRY_CAST(fips AS DOUBLE)) AS INTEGER) AS code FROM f""",
)
def cast_fips_codes(t: Tables) -> DataFrame:
    """Zero-padded text to numbers: plain, with decimals, invalid and missing."""
    padded = F.lpad(F.col("c_custkey").cast("string"), 12, "0")
    segment = F.col("c_mktsegment")
    fips = (
        F.when(segment == "BUILDING", F.concat(padded, F.lit("x")))
        .when(segment == "MACHINERY", F.concat(padded, F.lit(".0")))
        .when(segment != "FURNITURE", padded)
    )
    return t.read("customer", "c_custkey", "c_mktsegment").select("c_custkey", fips.alias("fips")).withColumn("code", to_int(F.col("fips")))


# --- code labels --------------------------------------------------------------------------------


@query(
    "classify_program",
    f"""WITH {SUPPLY_SQL} SELECT code, CAST(sum(total) AS BIGINT) AS total, {FAMILY_SQL} AS family FROM s GROUP BY code""",
)
def classify_programs(t: Tables) -> DataFrame:
    """Awards per program code with its family."""
    by_part = supply_lines(t, "part_id", "total").groupBy("part_id").agg(F.sum("total").alias("total"))
    parts = t.read("part", "p_partkey", "p_brand").toDF("part_id", "code")
    by_code = by_part.join(parts, "part_id").groupBy("code").agg(F.sum("total").alias("total"))
    return classify_program(by_code, "code").select("code", "total", "family")


@query(
    "classify_occupation",
    """WITH o AS (SELECT lpad(CAST(p_size AS VARCHAR), 2, '0') || '-' || p_type AS soc, count(*) AS parts FROM part GROUP BY 1)
    SELECT soc, parts, CASE soc[1:2] WHEN '11' THEN 'Management Occupations' WHEN '13' THEN 'Business and Financial Operations Occupations'
      WHEN '15' THEN 'Computer and Mathematical Occupations' WHEN '17' THEN 'Architecture and Engineering Occupations'
      WHEN '19' THEN 'Life, Physical, and Social Science Occupations' WHEN '21' THEN 'Community and Social Service Occupations'
      WHEN '23' THEN 'Legal Occupations' WHEN '25' THEN 'Education, Training, and Library Occupations'
      WHEN '27' THEN 'Arts, Design, Entertainment, Sports, and Media Occupations'
      WHEN '29' THEN 'Healthcare Practitioners and Technical Occupations' WHEN '31' THEN 'Healthcare Support Occupations'
      WHEN '33' THEN 'Protective Service Occupations' WHEN '35' THEN 'Food Preparation and Serving Related Occupations'
      WHEN '37' THEN 'Building and Grounds Cleaning and Maintenance Occupations' WHEN '39' THEN 'Personal Care and Service Occupations'
      WHEN '41' THEN 'Sales and Related Occupations' WHEN '43' THEN 'Office and Administrative Support Occupations'
      WHEN '45' THEN 'Farming, Fishing, and Forestry Occupations' WHEN '47' THEN 'Construction and Extraction Occupations'
      WHEN '49' THEN 'Installation, Maintenance, and Repair Occupations' ELSE 'Other' END AS group_full FROM o""",
)
def classify_occupations(t: Tables) -> DataFrame:
    """Parts per occupation code with the full group name."""
    counts = occupations(t).groupBy("soc").agg(F.count(F.lit(1)).alias("parts"))
    return classify_occupation(counts, "soc").select("soc", "parts", "group_full")


@query(
    "classify_award_level",
    f"""SELECT l_linenumber AS award_level, count(*) AS n, {AWARD_SQL.replace("award_level", "l_linenumber")} AS award,
    CAST(CASE WHEN l_linenumber <= 5 THEN l_linenumber + 2 ELSE 8 END AS INTEGER) AS award_rank FROM lineitem GROUP BY l_linenumber""",
)
def classify_awards(t: Tables) -> DataFrame:
    counts = t.read("lineitem").groupBy(F.col("l_linenumber").alias("award_level")).agg(F.count(F.lit(1)).alias("n"))
    return classify_award(counts, "award_level")


# --- display text -------------------------------------------------------------------------------


@query(
    "clean_text",
    """SELECT p_partkey, p_name AS trimmed, p_name AS county, p_name AS zone, p_name AS place FROM part""",
)
def clean_text(t: Tables) -> DataFrame:
    """Part names decorated with whitespace, suffixes and prefixes, and cleaned again."""
    name = F.col("p_name")
    decorated = t.read("part", "p_partkey", "p_name").select(
        "p_partkey",
        F.concat(F.lit("\t "), name, F.lit(" \n")).alias("spaced"),
        F.concat(name, F.lit(" County")).alias("county_name"),
        F.concat(F.col("p_partkey").cast("string"), F.lit(" "), name, F.lit(" CZ")).alias("zone_name"),
        F.concat(F.when(F.col("p_partkey") % 2 == 0, F.lit("County: ")).otherwise(F.lit("Counties: ")), name).alias("listed"),
    )
    return decorated.select(
        "p_partkey",
        strip_space(F.col("spaced")).alias("trimmed"),
        drop_suffix(F.col("county_name"), " County").alias("county"),
        pretty_zone(F.col("zone_name")).alias("zone"),
        strip_county_prefix(F.col("listed")).alias("place"),
    )


@query(
    "format_numbers",
    """SELECT p_partkey, format('{:,}', CAST(round_even(p_retailprice * 1000, 0) AS BIGINT)) AS whole,
           format('{:,.1f}', p_retailprice) AS tenths,
           regexp_replace(regexp_replace(printf('%.2f', round_even(p_size / 51.0::DOUBLE * 100, 2)), '0+$', ''), '\\.$', '') || '%' AS percent,
           printf('%.1f%%', p_size / 51.0::DOUBLE * 100) AS fixed FROM part""",
)
def format_numbers(t: Tables) -> DataFrame:
    price, share = F.col("p_retailprice"), F.col("p_size") / F.lit(51.0)
    return t.read("part", "p_partkey", "p_retailprice", "p_size").select(
        "p_partkey",
        comma(price * 1000).alias("whole"),
        comma_tenths(price).alias("tenths"),
        percent_text(share, 2).alias("percent"),
        percent_fixed(share).alias("fixed"),
    )


@query(
    "tooltip_text",
    f"""WITH {ENTITY_YEAR_SQL}
    SELECT entity, year, 'Year: ' || year || chr(10) || 'Focus awards: ' || format('{{:,}}', focus) AS count_tip,
           'Year: ' || year || chr(10) || 'Focus %: '
             || regexp_replace(printf('%.1f', round_even(CAST(focus AS DOUBLE) / total * 100, 1)), '\\.0$', '') || '%' AS percent_tip FROM ey""",
)
def tooltip_text(t: Tables) -> DataFrame:
    share = F.col("focus_share")
    return mapped(t).select(
        "entity",
        "year",
        lines(("Year", F.col("year")), ("Focus awards", comma(F.col("focus")))).alias("count_tip"),
        lines(("Year", F.col("year")), ("Focus %", percent_text(share))).alias("percent_tip"),
    )


@query(
    "popup_text",
    f"""WITH {ENTITY_YEAR_SQL}
    SELECT entity, year, '<strong>' || entity || '</strong><br><strong>Zone:</strong> ' || zone || '<br><strong>Year:</strong> ' || year
           || '<br><strong>Total:</strong> ' || format('{{:,}}', total) || '<br><strong>Focus:</strong> ' || format('{{:,}}', focus)
           || '<br><strong>Share:</strong> ' || printf('%.1f%%', CAST(focus AS DOUBLE) / total * 100) AS popup FROM ey""",
)
def popup_text(t: Tables) -> DataFrame:
    """Popup of every entity and year. The focus count is the share of the total, as on the map."""
    focus = F.col("focus_share") * F.col("total")
    popup = html_popup(
        F.col("entity"),
        ("Zone", F.col("zone")),
        ("Year", F.col("year")),
        ("Total", comma(F.col("total"))),
        ("Focus", comma(focus)),
        ("Share", percent_fixed(F.col("focus_share"))),
    )
    return mapped(t, "zone").select("entity", "year", popup.alias("popup"))


@query(
    "flag_yes_no",
    """SELECT s_suppkey, CASE WHEN s_acctbal >= 5000 THEN 'Yes' ELSE 'No' END AS rural, CASE WHEN s_acctbal < 0 THEN 'Yes' ELSE 'No' END AS tribal
    FROM supplier""",
)
def flag_yes_no(t: Tables) -> DataFrame:
    balance = F.col("s_acctbal")
    rural, tribal = F.when(balance >= 5000, 1).when(balance >= 0, 0), F.when(balance < 0, 1).otherwise(0)
    return t.read("supplier", "s_suppkey", "s_acctbal").select("s_suppkey", yes_no(rural).alias("rural"), yes_no(tribal).alias("tribal"))


@query(
    "percent_autoscale",
    """SELECT l_orderkey, l_partkey, l_suppkey, round(CASE WHEN (SELECT max(l_discount) FROM lineitem) <= 1 THEN l_discount * 100 ELSE l_discount END, 6) AS discount,
           CASE WHEN (SELECT max(l_quantity) FROM lineitem) <= 1 THEN l_quantity * 100 ELSE l_quantity END AS quantity FROM lineitem""",
)
def percent_autoscale(t: Tables) -> DataFrame:
    """A column of shares becomes percent, a column with larger values stays."""
    rows = t.read("lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_discount", "l_quantity")
    scaled = percent_scaled(rows, {"l_discount": "discount", "l_quantity": "quantity"})
    return rounded(scaled.drop("l_discount", "l_quantity"))


@query(
    "integer_valued_columns",
    """SELECT 'l_quantity' AS "column", bool_and(l_quantity = floor(l_quantity)) AS whole FROM lineitem
    UNION ALL SELECT 'l_discount', bool_and(l_discount = floor(l_discount)) FROM lineitem
    UNION ALL SELECT 'l_extendedprice', bool_and(l_extendedprice = floor(l_extendedprice)) FROM lineitem
    UNION ALL SELECT 'l_tax', bool_and(l_tax = floor(l_tax)) FROM lineitem""",
)
def integer_valued_columns(t: Tables) -> DataFrame:
    """Which numeric columns hold whole numbers only: one pass over all of them."""
    columns = ["l_quantity", "l_discount", "l_extendedprice", "l_tax"]
    tests = t.read("lineitem", *columns).agg(*[is_whole(F.col(c)).alias(c) for c in columns])
    return tests.unpivot([], columns, "column", "whole")


# --- map ----------------------------------------------------------------------------------------

# Breaks that fit the size of the test data; the fixed ones in `mapping` are the default.
PERCENT_BREAKS = [31, 33, 34, 36]


@query(
    "classify_step_bins",
    f"""WITH {ZONE_YEAR_SQL}, v AS (SELECT zone, year, focus, CAST(focus AS DOUBLE) / total * 100 AS percent FROM zy),
    b AS (SELECT *, CAST((focus >= 1000)::INT + (focus >= 5000)::INT + (focus >= 20000)::INT + (focus >= 50000)::INT AS INTEGER) AS focus_bin,
                 CAST((percent >= 31)::INT + (percent >= 33)::INT + (percent >= 34)::INT + (percent >= 36)::INT AS INTEGER) AS percent_bin FROM v)
    SELECT zone, year, focus_bin, percent_bin,
           CASE focus_bin WHEN 0 THEN '#edf8fb' WHEN 1 THEN '#b2e2e2' WHEN 2 THEN '#66c2a4' WHEN 3 THEN '#2ca25f' ELSE '#006d2c' END AS colour,
           CASE focus_bin WHEN 0 THEN '< 1,000' WHEN 1 THEN '1,000 – 5,000' WHEN 2 THEN '5,000 – 20,000' WHEN 3 THEN '20,000 – 50,000' ELSE '≥ 50,000' END AS legend,
           CASE percent_bin WHEN 0 THEN '< 31%' WHEN 1 THEN '31% – 33%' WHEN 2 THEN '33% – 34%' WHEN 3 THEN '34% – 36%' ELSE '≥ 36%' END AS percent_legend FROM b""",
)
def classify_step_bins(t: Tables) -> DataFrame:
    """Bin, colour and legend text of every zone and year."""
    binned = demand_rates(zone_years(t)).select(
        "zone",
        "year",
        step_bin(F.col("focus"), STEP_BREAKS["focus"]).alias("focus_bin"),
        step_bin(F.col("focus_percent"), PERCENT_BREAKS).alias("percent_bin"),
    )
    return binned.withColumns(
        {
            "colour": pick(F.col("focus_bin"), STEP_COLOURS["focus"]),
            "legend": pick(F.col("focus_bin"), step_labels(STEP_BREAKS["focus"])),
            "percent_legend": pick(F.col("percent_bin"), step_labels(PERCENT_BREAKS, percent=True)),
        }
    )


@query(
    "interpolate_radius",
    f"""WITH {ENTITY_YEAR_SQL} SELECT entity, year, round(2 + 8 * least(greatest(CAST(focus AS DOUBLE) / total, 0), 1), 6) AS radius FROM ey""",
)
def interpolate_radius(t: Tables) -> DataFrame:
    return rounded(mapped(t).select("entity", "year", radius(F.col("focus_share")).alias("radius")))


@query(
    "share_class_histogram",
    f"""WITH {ENTITY_YEAR_SQL}, v AS (SELECT year, CAST(focus AS DOUBLE) / total AS share FROM ey)
    SELECT year, CASE WHEN share < 0.25 THEN 'Low < 25%' WHEN share < 0.5 THEN '25% – 50%' WHEN share < 0.75 THEN '50% – 75%' ELSE '≥ 75%' END AS share_class,
           count(*) AS n FROM v GROUP BY 1, 2""",
)
def share_class_histogram(t: Tables) -> DataFrame:
    return mapped(t).groupBy("year", share_class(F.col("focus_share")).alias("share_class")).agg(F.count(F.lit(1)).alias("n"))


# --- files --------------------------------------------------------------------------------------


@query("parquet_gzip_roundtrip", ORACLES["zone_year_metrics"])
def parquet_gzip_roundtrip(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "zone-years")
    write_parquet(zone_year_metrics(t), path)
    return t.spark.read.parquet(path)


@query("csv_roundtrip", ORACLES["zone_year_metrics"])
def csv_roundtrip(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "zone-years-csv")
    metrics = zone_year_metrics(t)
    write_csv(metrics, path)
    return read_csv(t.spark, path, ", ".join(f"`{name}` {kind}" for name, kind in metrics.dtypes))


@query(
    "partitioned_roundtrip",
    f"""WITH {SUPPLY_SQL} SELECT unitid, year, CAST(sum(total) AS BIGINT) AS total, CAST(sum(focus) AS BIGINT) AS focus
    FROM s WHERE year = 1999 GROUP BY unitid, year""",
)
def partitioned_roundtrip(t: Tables) -> DataFrame:
    """Yearly sums of every unit written by year; one year is read back from its directory."""
    path = scratch_path(t.spark, "units-by-year")
    write_partitions(supply_by_unit(t), path, "year", sort=["unitid"])
    return read_partitions(t.spark, path, year=1999)


EXPORT_NAMES = {
    "entity": "Institution",
    "zone": "Commuting Zone",
    "mean_total": "Mean Completions (per year)",
    "mean_focus": "Mean Focus Completions (per year)",
    "focus_share": "Focus%",
    "mean_enrolled": "Mean Enrollment (per year)",
    "rural": "Rural",
    "tribal": "Tribal",
}


@query(
    "export_entity_table",
    f"""WITH {ENTITY_YEAR_SQL}
    SELECT entity AS "Institution", min(zone) AS "Commuting Zone", round(avg(total), 6) AS "Mean Completions (per year)",
           round(avg(focus), 6) AS "Mean Focus Completions (per year)", round_even(avg(focus) / avg(total) * 100, 2) AS "Focus%",
           round(avg(enrolled), 6) AS "Mean Enrollment (per year)", min(rural) AS "Rural", min(tribal) AS "Tribal"
    FROM ey GROUP BY entity""",
)
def export_entity_table(t: Tables) -> DataFrame:
    """The entity table under its display names, exported as CSV and read back."""
    shown = display_table(entity_table(t), EXPORT_NAMES, ["focus_share"])
    path = export_csv(shown, scratch_path(t.spark, "entity-export"))
    return rounded(read_csv(t.spark, path, ", ".join(f"`{name}` {kind}" for name, kind in shown.dtypes)))


ZONE_NAMES = {
    "total": "Total Job Postings",
    "focus": "Focus Job Postings",
    "population": "Commuting Zone Population",
    "focus_percent": "Focus%",
    "per_1000": "Postings per 1,000 Residents",
    "per_100k": "Postings per 100,000 Residents",
}


@query(
    "export_zone_year_table",
    f"""WITH {ZONE_YEAR_SQL}
    SELECT zone AS "Commuting Zone", year, total AS "Total Job Postings", focus AS "Focus Job Postings", round(population, 6) AS "Commuting Zone Population",
           round_even(CASE WHEN total > 0 THEN CAST(focus AS DOUBLE) / total * 100 END, 2) AS "Focus%",
           round(CASE WHEN population > 0 THEN total / population * 1000 END, 6) AS "Postings per 1,000 Residents" FROM zy""",
)
def export_zone_year_table(t: Tables) -> DataFrame:
    """The zone table with its label first and those columns renamed that it has."""
    rates = demand_rates(zone_years(t), numerator="total").withColumnRenamed("per_capita", "per_1000")
    metrics = rounded(rates.withColumn("focus_percent", half_even(F.col("focus_percent"), 2)))
    return readable_names(column_first(metrics, "zone", "Commuting Zone"), ZONE_NAMES)


@query(
    "geojson_point_features",
    f"""WITH {ENTITY_YEAR_SQL}, p AS (SELECT * FROM ey WHERE longitude IS NOT NULL AND latitude IS NOT NULL)
    SELECT CAST(year AS INTEGER) AS year, row_number() OVER (PARTITION BY year ORDER BY entity, unitid) AS id, entity, zone, longitude, latitude,
           focus, CAST(focus AS DOUBLE) / total AS focus_share FROM p""",
)
def geojson_point_features(t: Tables) -> DataFrame:
    """Located entities as one GeoJSON collection of points per year, parsed back."""
    path = scratch_path(t.spark, "points")
    located = mapped(t, "zone", "longitude", "latitude").where(F.col("longitude").isNotNull() & F.col("latitude").isNotNull())
    properties = ["year", "entity", "zone", "focus", "focus_share"]
    geometry = point_geometry(F.col("longitude"), F.col("latitude"))
    write_features_by_year(located, path, geometry, properties, ["entity", "unitid"])
    schema = "id bigint, year int, entity string, zone string, focus bigint, focus_share double"
    parsed = read_features(t.spark, path, schema)
    point = F.from_json("geometry", "type string, coordinates array<double>")
    return parsed.select("properties.*", point["coordinates"][0].alias("longitude"), point["coordinates"][1].alias("latitude"))


@query(
    "geojson_zone_features",
    f"""WITH {ZONE_YEAR_SQL}
    SELECT year, row_number() OVER (PARTITION BY year ORDER BY zone) AS id, zone, n_nationkey AS zone_code, total, focus,
           CAST(n_nationkey AS DOUBLE) AS west, 'Polygon' AS kind FROM zy JOIN nation ON zone = n_name""",
)
def geojson_zone_features(t: Tables) -> DataFrame:
    """Zone metrics with the zone's polygon, which is carried as GeoJSON text, one collection per year."""
    path = scratch_path(t.spark, "zones")
    west, south = F.col("n_nationkey").cast("double"), F.lit(30.0)
    corners = [(west, south), (west + 1, south), (west + 1, south + 1), (west, south + 1), (west, south)]
    ring = F.array(*[F.array(x, y) for x, y in corners])
    shapes = t.read("nation", "n_nationkey", "n_name").select(
        F.col("n_name").alias("zone"),
        F.col("n_nationkey").alias("zone_code"),
        F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))).alias("shape"),
    )
    rows = zone_years(t).join(shapes, "zone")
    write_features_by_year(rows, path, F.col("shape"), ["year", "zone", "zone_code", "total", "focus"], ["zone"])
    schema = "id bigint, year int, zone string, zone_code int, total bigint, focus bigint"
    shape = F.from_json("geometry", "type string, coordinates array<array<array<double>>>")
    return read_features(t.spark, path, schema).select(
        "properties.*", shape["coordinates"][0][0][0].alias("west"), shape["type"].alias("kind")
    )
