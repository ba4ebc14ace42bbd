"""Questions asked of the published marts through the views, each next to the SQL that gives the same rows."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionlens.functions.codes import classify_program
from regionlens.operators.paging import store_in_order
from regionlens.operators.ranking import ascending, descending
from regionlens.plans import build, views
from regionlens.plans.facts import Tables
from regionlens.plans.publish import Published, publish_all
from regionlens.plans.raw import DEMAND_SQL, LABEL_SQL, PARTIAL_YEAR, SUPPLY_SQL, inputs, published, written_inputs
from regionlens.plans.registry import query, rounded
from regionlens.plans.supply import AWARD_SQL, FAMILY_SQL, leaders_entity_total
from regionlens.session import scratch_path
from regionlens.sources.readers import read_csv
from regionlens.sources.writers import display_table, export_csv, write_csv

# The one unit and the one zone the views below are asked about: in every test folder there is a seventh supplier.
ENTITY = "Supplier#000000007"
YEAR = "1998"
EDUCATION = [("1", "None"), ("2", "School"), ("3", "Degree"), ("4", "Master")]
EDUCATION_SQL = "CASE ed_req WHEN 1 THEN 'None' WHEN 2 THEN 'School' WHEN 3 THEN 'Degree' WHEN 4 THEN 'Master' ELSE coalesce(CAST(ed_req AS VARCHAR), 'Missing') END"
EDUCATION_RANK_SQL = "CASE WHEN ed_req BETWEEN 1 AND 4 THEN ed_req WHEN ed_req IS NULL THEN 6 ELSE 5 END"
GROUP_SQL = """CASE soc[1:2] WHEN '11' THEN 'Management' WHEN '13' THEN 'Business & Financial Ops' WHEN '15' THEN 'Computer & Math'
  WHEN '17' THEN 'Architecture & Engineering' WHEN '19' THEN 'Life/Physical/Social Sci' WHEN '21' THEN 'Community & Social Service'
  WHEN '23' THEN 'Legal' WHEN '25' THEN 'Education & Library' WHEN '27' THEN 'Arts, Media & Sports'
  WHEN '29' THEN 'Healthcare Practitioners & Tech' WHEN '31' THEN 'Healthcare Support' WHEN '33' THEN 'Protective Service'
  WHEN '35' THEN 'Food Prep & Serving' WHEN '37' THEN 'Building & Grounds Maint' WHEN '39' THEN 'Personal Care & Service'
  WHEN '41' THEN 'Sales & Related' WHEN '43' THEN 'Office & Admin Support' WHEN '45' THEN 'Farming/Fishing/Forestry'
  WHEN '47' THEN 'Construction & Extraction' WHEN '49' THEN 'Install/Maint/Repair' ELSE 'Other' END"""


def first_zone(marts: Published) -> str:
    """The key of the zone that comes first by name; one row of a small table."""
    return marts.keyed("zones").orderBy("zone").first()["zone"]


@query("built_zone_labels", f"WITH {LABEL_SQL} SELECT county, zone_code, zone FROM labels")
def built_zone_labels(t: Tables) -> DataFrame:
    raw = inputs(t)
    return build.zone_labels(raw.crosswalk, raw.cities, raw.county_names, raw.state_codes)


SUPPLY_COLUMNS = ["unitid", "entity", "year", "code", "title", "award_level", "total", "focus", "zone", "enrolled", "tribal", "rural"]


@query("published_supply", f"WITH {SUPPLY_SQL} SELECT {', '.join(SUPPLY_COLUMNS)} FROM supply")
def published_supply(t: Tables) -> DataFrame:
    return published(t).table("supply").select(SUPPLY_COLUMNS)


@query("published_demand", f"WITH {DEMAND_SQL} SELECT * REPLACE (round(population, 6) AS population) FROM demand")
def published_demand(t: Tables) -> DataFrame:
    return rounded(published(t).table("demand"))


AWARDS_SQL = SUPPLY_SQL + """,
awards AS (
  SELECT entity, year, CAST(sum(total) AS BIGINT) AS total, CAST(sum(focus) AS BIGINT) AS focus, any_value(enrolled) AS enrolled,
         any_value(zone) AS zone, any_value(rural) AS rural, any_value(tribal) AS tribal FROM supply GROUP BY entity, year)"""


@query(
    "published_entities",
    f"""WITH {AWARDS_SQL}
    SELECT entity, round(avg(total), 6) AS mean_total, round(avg(focus), 6) AS mean_focus, round(avg(enrolled), 6) AS mean_enrolled,
           any_value(zone) AS zone, any_value(rural) AS rural, any_value(tribal) AS tribal, round(avg(focus) / avg(total), 6) AS focus_share
    FROM awards GROUP BY entity""",
)
def published_entities(t: Tables) -> DataFrame:
    return rounded(published(t).table("entities"))


@query(
    "published_national",
    f"""WITH {AWARDS_SQL}
    SELECT year, round(avg(focus), 6) AS mean_focus, round(avg(focus) / avg(total), 6) AS focus_share FROM awards GROUP BY year""",
)
def published_national(t: Tables) -> DataFrame:
    return rounded(published(t).table("national_awards"))


@query(
    "published_map_zones",
    f"""WITH {DEMAND_SQL},
    residents AS (SELECT zone_code, y AS year, coalesce(sum(population), 0) AS population
                  FROM county_of JOIN people ON county_no = county CROSS JOIN range(1992, 2002) r(y) WHERE y <= {PARTIAL_YEAR - 1} GROUP BY ALL)
    SELECT zone, z.year, total, focus, zone_code, population, round(CASE WHEN total > 0 THEN CAST(focus AS DOUBLE) / total * 100 END, 6) AS focus_percent,
           round(CASE WHEN population > 0 THEN total / population * 1000 END, 6) AS per_1000
    FROM (SELECT zone, year, total, focus FROM zone_years WHERE year <= {PARTIAL_YEAR - 1}) z
    JOIN (SELECT DISTINCT zone, zone_code FROM labels JOIN people ON county_no = county) l USING (zone)
    LEFT JOIN residents r USING (zone_code, year)""",
)
def published_map_zones(t: Tables) -> DataFrame:
    return rounded(published(t).table("map_zones"))


@query(
    "view_zone_leaders",
    f"""WITH {DEMAND_SQL},
    m AS (SELECT zone, avg(CASE WHEN population > 0 THEN focus / population * 1000 END) AS mean_per_1000 FROM zone_years WHERE year <> {PARTIAL_YEAR} GROUP BY zone)
    SELECT zone, round(mean_per_1000, 6) AS mean_per_1000, row_number() OVER (ORDER BY round(mean_per_1000, 9) DESC NULLS LAST, zone) AS rank,
           regexp_replace(regexp_replace(zone, ' CZ$', ''), '^[0-9]+ ', '') || ' — ' || format('{{:,.1f}}', mean_per_1000) AS caption
    FROM m ORDER BY rank LIMIT 5""",
)
def view_zone_leaders(t: Tables) -> DataFrame:
    """A list that is shorter than the table."""
    return rounded(views.zone_leaderboard(published(t).table("zone_leaders"), "mean_per_1000", n=5))


@query(
    "view_entity_trend",
    f"""WITH {SUPPLY_SQL}
    SELECT year, CAST(sum(total) AS BIGINT) AS total, CAST(sum(focus) AS BIGINT) AS focus, CAST(sum(enrolled) AS BIGINT) AS enrolled,
           round(CAST(sum(focus) AS DOUBLE) / sum(total) * 100, 6) AS focus_percent, CAST(sum(focus) AS DOUBLE) AS value,
           'Year: ' || year || chr(10) || 'Focus Credentials: ' || format('{{:,}}', CAST(sum(focus) AS BIGINT)) AS tooltip
    FROM supply WHERE entity = '{ENTITY}' GROUP BY year""",
)
def view_entity_trend(t: Tables) -> DataFrame:
    """An unknown metric means the first one."""
    return rounded(views.trend_of_entity(published(t).keyed("supply"), ENTITY, "unknown").drop("entity"))


PROGRAMS_SQL = f"""WITH {SUPPLY_SQL},
    m AS (SELECT code, title, award_level, CAST(sum(focus) AS BIGINT) AS focus FROM supply WHERE entity = '{ENTITY}' AND year = {YEAR} GROUP BY ALL HAVING sum(focus) > 0),
    f AS (SELECT *, {FAMILY_SQL} AS family, {AWARD_SQL.replace("CASE award_level", "CASE CAST(award_level AS INTEGER)")} AS award FROM m),
    g AS (SELECT *, CAST(sum(focus) OVER (PARTITION BY family) AS BIGINT) AS group_total, max(focus) OVER (PARTITION BY family, title) AS largest FROM f)
    SELECT code, title, award_level, focus, family, award, group_total,
           CAST(dense_rank() OVER (ORDER BY group_total DESC, family) AS INTEGER) AS group_rank,
           CAST(dense_rank() OVER (PARTITION BY family ORDER BY largest DESC, title) AS INTEGER) AS item_rank,
           round(focus / CAST(sum(focus) OVER (PARTITION BY title) AS DOUBLE), 6) AS share FROM g"""
PROGRAM_COLUMNS = ["code", "title", "award_level", "focus", "family", "award", "group_total", "group_rank", "item_rank", "share"]


@query("view_entity_programs", PROGRAMS_SQL)
def view_entity_programs(t: Tables) -> DataFrame:
    """The year comes as text."""
    return rounded(views.programs_of_entity(published(t).keyed("supply"), ENTITY, YEAR).select(PROGRAM_COLUMNS))


@query("view_no_such_year", f"SELECT * FROM ({PROGRAMS_SQL}) WHERE false")
def view_no_such_year(t: Tables) -> DataFrame:
    """A year that is no number selects nothing and fails nothing."""
    return rounded(views.programs_of_entity(published(t).keyed("supply"), ENTITY, "no year").select(PROGRAM_COLUMNS))


FAMILY_FULL_SQL = """CASE lpad(regexp_replace(code, '[^0-9]', '', 'g'), 2, '0')
  WHEN '01' THEN 'Agriculture, Agriculture Operations, and Related Sciences' WHEN '03' THEN 'Natural Resources and Conservation'
  WHEN '04' THEN 'Architecture and Related Services' WHEN '05' THEN 'Area, Ethnic, Cultural, and Gender Studies'
  WHEN '09' THEN 'Communication, Journalism, and Related Programs' WHEN '10' THEN 'Communications Technologies/Technicians and Support Services'
  WHEN '11' THEN 'Computer and Information Sciences and Support Services' WHEN '12' THEN 'Personal and Culinary Services' WHEN '13' THEN 'Education'
  WHEN '14' THEN 'Engineering' WHEN '15' THEN 'Engineering Technologies/Technicians' WHEN '16' THEN 'Foreign Languages, Literatures, and Linguistics'
  WHEN '19' THEN 'Family and Consumer Sciences/Human Sciences' WHEN '22' THEN 'Legal Professions and Studies'
  WHEN '23' THEN 'English Language and Literature/Letters' WHEN '24' THEN 'Liberal Arts and Sciences, General Studies and Humanities'
  WHEN '25' THEN 'Library Science' ELSE 'Other' END"""


@query("program_family_names", f"SELECT DISTINCT p_brand AS code, {FAMILY_SQL.replace('(code,', '(p_brand,')} AS family, {FAMILY_FULL_SQL.replace('(code,', '(p_brand,')} AS family_full FROM part")
def program_family_names(t: Tables) -> DataFrame:
    """Short and full family name of every code in use."""
    return classify_program(t.read("part").selectExpr("p_brand AS code").distinct(), "code")


@query(
    "view_zone_trend",
    f"""WITH {DEMAND_SQL}
    SELECT year, total, focus, round(population, 6) AS population, round(CASE WHEN total > 0 THEN CAST(focus AS DOUBLE) / total * 100 END, 6) AS focus_percent,
           round(CASE WHEN population > 0 THEN focus / population * 1000 END, 6) AS per_capita, round(CASE WHEN population > 0 THEN focus / population * 1000 END, 6) AS value
    FROM zone_years WHERE zone = (SELECT min(zone) FROM zone_years) AND year <> {PARTIAL_YEAR}""",
)
def view_zone_trend(t: Tables) -> DataFrame:
    marts = published(t)
    trend = views.trend_of_zone(marts.keyed("demand"), first_zone(marts), "per_capita", PARTIAL_YEAR)
    return rounded(trend.drop("zone", "tooltip"))


@query(
    "view_zone_occupations",
    f"""WITH {DEMAND_SQL},
    o AS (SELECT soc, soc_title, ed_req, CAST(sum(total) AS BIGINT) AS total FROM demand
          WHERE zone = (SELECT min(zone) FROM zone_years) AND focus_flag = 1 AND year <> {PARTIAL_YEAR} AND soc_title IS NOT NULL GROUP BY ALL),
    g AS (SELECT *, {GROUP_SQL} AS "group" FROM o),
    w AS (SELECT *, CAST(sum(total) OVER (PARTITION BY soc_title) AS BIGINT) AS title_total, CAST(sum(total) OVER (PARTITION BY "group") AS BIGINT) AS group_total,
                 {EDUCATION_SQL} AS education, {EDUCATION_RANK_SQL} AS place FROM g),
    r AS (SELECT *, row_number() OVER (ORDER BY title_total DESC, soc_title, place, soc) AS rank FROM w)
    SELECT soc, soc_title, total, "group", education, title_total, group_total, rank,
           CAST(dense_rank() OVER (ORDER BY group_total DESC, "group") AS INTEGER) AS group_rank,
           CAST(dense_rank() OVER (PARTITION BY "group" ORDER BY title_total DESC, soc_title) AS INTEGER) AS item_rank
    FROM r WHERE rank <= 10""",
)
def view_zone_occupations(t: Tables) -> DataFrame:
    marts = published(t)
    shown = views.occupations_of_zone(marts.keyed("demand"), first_zone(marts), EDUCATION, n=10, partial_year=PARTIAL_YEAR)
    return shown.select("soc", "soc_title", "total", "group", "education", "title_total", "group_total", "rank", "group_rank", "item_rank")


@query(
    "view_find_entity",
    f"""WITH {SUPPLY_SQL},
    y AS (SELECT year, unitid, entity, zone, CAST(sum(total) AS BIGINT) AS total, CAST(sum(focus) AS BIGINT) AS focus FROM supply GROUP BY ALL)
    SELECT entity, unitid, year, total, focus, zone FROM y WHERE year = {YEAR} AND regexp_matches(entity, '(?i)SUPPLIER.*[37]$') ORDER BY entity, unitid LIMIT 1""",
)
def view_find_entity(t: Tables) -> DataFrame:
    found = views.find_entity(published(t).table("map_entities"), "SUPPLIER.*[37]$", YEAR)
    return found.select("entity", "unitid", "year", "total", "focus", "zone")


@query(
    "latest_programs_stored",
    f"""WITH {SUPPLY_SQL}, last AS (SELECT entity, max(year) AS year FROM supply GROUP BY entity)
    SELECT entity, year, code, title, award_level, CAST(sum(focus) AS BIGINT) AS focus FROM supply JOIN last USING (entity, year)
    GROUP BY ALL HAVING sum(focus) > 0""",
)
def latest_programs_stored(t: Tables) -> DataFrame:
    """Every entity's programs in its own last year; of the fact only the folders from the smallest last year on are read."""
    marts = published(t)
    return views.latest_programs(marts.keyed("supply"), marts.keyed("awards_by_year"))


@query(
    "latest_occupations_stored",
    f"""WITH {DEMAND_SQL}, last AS (SELECT zone, max(year) AS year FROM demand WHERE year <> {PARTIAL_YEAR} GROUP BY zone),
    s AS (SELECT zone, year, soc_title, ed_req, CAST(sum(total) AS BIGINT) AS total FROM demand JOIN last USING (zone, year)
          WHERE focus_flag = 1 AND soc_title IS NOT NULL GROUP BY ALL),
    w AS (SELECT *, CAST(sum(total) OVER (PARTITION BY zone, soc_title) AS BIGINT) AS title_total, {EDUCATION_SQL} AS education, {EDUCATION_RANK_SQL} AS place FROM s),
    r AS (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY title_total DESC, soc_title, place, ed_req) AS rank FROM w)
    SELECT zone, year, soc_title, ed_req, total, title_total, education, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""",
)
def latest_occupations_stored(t: Tables) -> DataFrame:
    """Every zone's first occupations in its own last complete year."""
    marts = published(t)
    shown = views.latest_occupations(marts.keyed("demand"), marts.keyed("postings_by_year"), EDUCATION, partial_year=PARTIAL_YEAR)
    return marts.with_texts(shown.drop("education_rank"))


@query(
    "republished_year",
    """WITH y AS (SELECT DISTINCT CAST(year(l_shipdate) AS INTEGER) AS year FROM lineitem),
    d AS (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    by_year AS (
      SELECT m AS mart, 'year=' || year AS part, CASE WHEN year = 1996 THEN 2 ELSE 1 END AS version
      FROM y CROSS JOIN (VALUES ('supply'), ('awards_by_year'), ('map_entities')) v(m)
      UNION ALL SELECT m, 'year=' || year, 1 FROM d CROSS JOIN (VALUES ('demand'), ('postings_by_year'), ('zone_years')) v(m))
    SELECT * FROM by_year
    UNION ALL SELECT m, '', version FROM (VALUES ('national_awards', 2), ('entities', 2), ('national_postings', 1), ('zones', 1), ('zone_leaders', 1), ('map_zones', 1)) v(m, version)""",
)
def republished_year(t: Tables) -> DataFrame:
    """What a second run writes after the awards of one year have doubled: that year's folders and the tables over all years."""
    root = scratch_path(t.spark, "republished")
    publish_all(t.spark, root, written_inputs(t), PARTIAL_YEAR, PARTIAL_YEAR - 1)
    doubled = F.when(F.col("year") == 1996, F.col("total") * 2).otherwise(F.col("total"))
    again = publish_all(t.spark, root, written_inputs(t, lambda completions: completions.withColumn("total", doubled)), PARTIAL_YEAR, PARTIAL_YEAR - 1)
    rows = [(mart, part, int(run.split("-")[0])) for mart, part, run, _ in again.manifest()]
    return t.spark.createDataFrame(rows, "mart string, part string, version int")


@query(
    "prepared_leaders",
    f"""WITH {AWARDS_SQL}, m AS (SELECT entity, avg(focus) AS mean_focus FROM awards GROUP BY entity)
    SELECT entity, round(mean_focus, 6) AS mean_focus, row_number() OVER (ORDER BY round(mean_focus, 9) DESC, entity) AS rank,
           entity || ' — ' || format('{{:,}}', CAST(round_even(mean_focus, 0) AS BIGINT)) AS caption
    FROM m ORDER BY rank LIMIT 150""",
)
def prepared_leaders(t: Tables) -> DataFrame:
    """The list of all entities is prepared as CSV, and the leaderboard cuts it instead of computing it."""
    path = scratch_path(t.spark, "leaders")
    write_csv(published(t).table("entities").select("entity", "mean_focus"), path)
    return leaders_entity_total(t, path)


@query(
    "exported_zone_years",
    f"""WITH {DEMAND_SQL}
    SELECT zone AS "Commuting Zone", year AS "Year", total AS "Total Job Postings", focus AS "Focus Job Postings",
           round(population, 6) AS "Commuting Zone Population", round_even(CASE WHEN total > 0 THEN CAST(focus AS DOUBLE) / total END * 100, 2) AS "Focus%",
           round(CASE WHEN population > 0 THEN focus / population * 1000 END, 6) AS "Focus Postings per 1,000 Residents", 'date=2024-03-01' AS day
    FROM zone_years""",
)
def exported_zone_years(t: Tables) -> DataFrame:
    """The zone table as a dated CSV file with shares times 100, read back."""
    names = {
        "zone": "Commuting Zone", "year": "Year", "total": "Total Job Postings", "focus": "Focus Job Postings",
        "population": "Commuting Zone Population", "focus_share": "Focus%", "per_1000": "Focus Postings per 1,000 Residents",
    }
    shown = display_table(published(t).table("zone_years"), names, percent=["focus_share"])
    path = export_csv(shown, scratch_path(t.spark, "export"), date(2024, 3, 1))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shown.schema)
    return rounded(read_csv(t.spark, path, schema)).withColumn("day", F.lit(path.rsplit("/", 1)[1]))


@query(
    "page_far_down",
    """SELECT o_orderkey, o_custkey, o_totalprice, row FROM (
      SELECT *, row_number() OVER (ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS row FROM orders) WHERE row BETWEEN 991 AND 1000""",
)
def page_far_down(t: Tables, number: int = 100) -> DataFrame:
    """A page deep in a table that is stored in its sort order."""
    orders = t.read("orders", "o_orderkey", "o_custkey", "o_totalprice")
    stored = store_in_order(orders, [descending("o_totalprice"), ascending("o_orderkey")], scratch_path(t.spark, "sorted"), slice_rows=250)
    return stored.page(number)
