"""Questions about awards: trends, summaries, program mixes, leaderboards, search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionlens.functions.codes import classify_award, classify_program
from regionlens.functions.numbers import first_by, ratio, ratio_or_zero, sum_or_zero
from regionlens.functions.text import comma, percent_text
from regionlens.operators.aggregates import (
    against_national,
    map_entities,
    mix,
    national_supply,
    summarise_entities,
    supply_rates,
    yearly_supply,
)
from regionlens.operators.joins import look_up
from regionlens.operators.ranking import (
    ascending,
    descending,
    group_total,
    leaderboard,
    order_by_summary,
    ordinal,
    page,
    rank_groups_and_items,
    share_of_group,
)
from regionlens.plans.facts import (
    ENTITY_YEAR_SQL,
    SUPPLY_SQL,
    Tables,
    focus_by_program,
    supply_by_entity,
    supply_by_unit,
    supply_lines,
    units,
)
from regionlens.plans.registry import query, rounded
from regionlens.session import materialize
from regionlens.sources.readers import in_year, read_csv, read_or_build, resolve_column, year_choice

LEADERS = 150


def entity_years(t: Tables, enrolment: bool = False, attributes: tuple[str, ...] = ()) -> DataFrame:
    """Entity and year; units that share a name are one entity."""
    carried = [first_by(F.col(a), F.col("unitid")).alias(a) for a in attributes]
    if enrolment:
        carried.append(first_by(F.col("enrolled"), F.col("unitid")).alias("enrolled"))
    return yearly_supply(supply_by_entity(t, *attributes, enrolment=enrolment), extra=carried)


@query(
    "entity_trend",
    f"""WITH {ENTITY_YEAR_SQL}
    SELECT entity, year, CAST(sum(total) AS BIGINT) AS total, CAST(sum(focus) AS BIGINT) AS focus, CAST(sum(enrolled) AS BIGINT) AS enrolled,
           round(CAST(sum(focus) AS DOUBLE) / sum(total) * 100, 6) AS focus_percent
    FROM s GROUP BY entity, year""",
)
def entity_trend(t: Tables, entity: str | None = None) -> DataFrame:
    """Yearly series of every entity. For one entity its units are found first and their lines alone summed."""
    names = units(t, "entity")
    only = None if entity is None else names.where(F.col("entity") == entity)
    sums = supply_by_unit(t, F.sum("enrolled").alias("enrolled"), reads=["enrolled"], only=only)
    yearly = yearly_supply(sums.join(names if only is None else only, "unitid"), extra=[sum_or_zero(F.col("enrolled")).alias("enrolled")])
    return rounded(supply_rates(yearly))


@query(
    "national_avg_supply",
    f"""WITH {ENTITY_YEAR_SQL}
    SELECT year, round(avg(total), 6) AS mean_total, round(avg(focus), 6) AS mean_focus,
           round(avg(enrolled), 6) AS mean_enrolled, round(avg(focus) / avg(total), 6) AS focus_share
    FROM ey GROUP BY year""",
)
def national_avg_supply(t: Tables) -> DataFrame:
    return rounded(national_supply(entity_years(t, enrolment=True)))


@query(
    "entity_summary",
    f"""WITH {ENTITY_YEAR_SQL}
    SELECT entity, round(avg(total), 6) AS mean_total, round(avg(focus), 6) AS mean_focus,
           round(avg(enrolled), 6) AS mean_enrolled, round(avg(focus) / avg(total), 6) AS focus_share,
           min(zone) AS zone, min(rural) AS rural, min(tribal) AS tribal
    FROM ey GROUP BY entity""",
)
def entity_summary(t: Tables) -> DataFrame:
    return rounded(entity_table(t))


def entity_table(t: Tables) -> DataFrame:
    """Every entity with its attributes, means over years and focus share.

    Attributes are carried as numbers, the zone as its code, which gets its name at the end.
    """
    attributes = ("n_nationkey", "rural", "tribal")
    zones = t.read("nation", "n_nationkey", "n_name").withColumnRenamed("n_name", "zone")
    table = summarise_entities(entity_years(t, True, attributes), attributes)
    return look_up(table, zones, "n_nationkey").drop("n_nationkey")


@query(
    "map_entity_year",
    f"""WITH {SUPPLY_SQL}
    SELECT year, unitid, entity, min(zone) AS zone, min(latitude) AS latitude, min(longitude) AS longitude,
           first(site ORDER BY l_orderkey) FILTER (WHERE site IS NOT NULL) AS site,
           CAST(sum(total) AS BIGINT) AS total, CAST(sum(focus) AS BIGINT) AS focus,
           round(CAST(sum(focus) AS DOUBLE) / sum(total), 6) AS focus_share
    FROM s GROUP BY year, unitid, entity""",
)
def map_entity_year(t: Tables) -> DataFrame:
    """Map table with, per unit and year, the first known site."""
    lines = supply_lines(t, "year", "unitid", "order_key", "site", "total", "focus")
    sums = map_entities(lines, F.col("order_key"), ["site"], ["year", "unitid"])
    return rounded(sums.join(units(t, "entity", "zone", "latitude", "longitude"), "unitid"))


def mapped(t: Tables, *attributes: str) -> DataFrame:
    """Map table without the program: year, unit, name, sums, share and the attributes asked for."""
    yearly = supply_by_unit(t).withColumn("focus_share", ratio(F.col("focus"), F.col("total")))
    return yearly.join(units(t, "entity", *attributes), "unitid")


@query(
    "row_id_per_year",
    f"""WITH {ENTITY_YEAR_SQL}
    SELECT year, entity, unitid, row_number() OVER (PARTITION BY year ORDER BY entity, unitid) AS id FROM ey""",
)
def row_id_per_year(t: Tables) -> DataFrame:
    active = supply_lines(t, "year", "unitid").distinct()
    rows = active.join(units(t, "entity"), "unitid").select("year", "entity", "unitid")
    return ordinal(rows, [ascending("entity"), ascending("unitid")], ["year"], "id")


@query(
    "distinct_sorted_by_year",
    f"""WITH {SUPPLY_SQL}, names AS (SELECT DISTINCT year, entity FROM s)
    SELECT year, entity, row_number() OVER (PARTITION BY year ORDER BY entity) AS position FROM names""",
)
def distinct_sorted_by_year(t: Tables, year: int | str | None = None) -> DataFrame:
    """The choice list of every year, or of the year a text or number parameter names."""
    active = supply_lines(t, "unitid", "year").distinct().where(year_choice(year))
    names = active.join(units(t, "entity"), "unitid").select("year", "entity").distinct()
    return ordinal(names.where(F.col("entity").isNotNull()), [ascending("entity")], ["year"], "position")


@query(
    "search_entity_regex",
    f"""WITH {ENTITY_YEAR_SQL}
    SELECT entity, zone, year, total, focus FROM ey
    WHERE regexp_matches(entity, '(?i)SUPPLIER#0+[37]$') AND year = 1998 ORDER BY entity LIMIT 1""",
)
def search_entity_regex(t: Tables, term: str = "SUPPLIER#0+[37]$", year: int = 1998, literal: bool = False) -> DataFrame:
    """First entity of the year whose name matches, ignoring case; no row if there is none."""
    name = F.col("entity")
    match = F.lower(name).contains(term.lower()) if literal else name.rlike(f"(?i){term}")
    found = units(t, "entity", "zone").where(match)
    lines = supply_lines(t, "unitid", "year", "total", "focus", when=in_year(F.col("l_shipdate"), year)).join(found, "unitid")
    sums = lines.groupBy("entity", "zone", "year").agg(sum_or_zero(F.col("total")).alias("total"), sum_or_zero(F.col("focus")).alias("focus"))
    return sums.orderBy(ascending("entity"), ascending("zone")).limit(1)


@query(
    "trend_vs_national",
    f"""WITH {ENTITY_YEAR_SQL},
    nat AS (SELECT year, avg(focus) AS value FROM ey GROUP BY year),
    span AS (SELECT entity, min(year) AS lo, max(year) AS hi FROM ey GROUP BY entity)
    SELECT entity, year, 'entity' AS series, round(CAST(focus AS DOUBLE), 6) AS value FROM ey
    UNION ALL
    SELECT entity, year, 'national', round(value, 6) FROM span JOIN nat ON year BETWEEN lo AND hi""",
)
def trend_vs_national(t: Tables) -> DataFrame:
    """Both series from one pass over the fact: the yearly sums are written once."""
    yearly = materialize(entity_years(t), "entity-years")
    return rounded(against_national(yearly, national_supply(yearly), "entity", "focus", "mean_focus"))


def program_mix(t: Tables, year: int | str | None = None) -> DataFrame:
    """Focus awards per entity, program and level, positive sums only, for one year or all."""
    chosen = focus_by_program(t, with_year=year is not None).where(year_choice(year))
    return mix(chosen, ["entity", "code", "title", "award_level"])


MIX_SQL = SUPPLY_SQL + """,
mix AS (
  SELECT entity, code, title, award_level, CAST(sum(focus) AS BIGINT) AS focus
  FROM s GROUP BY entity, code, title, award_level HAVING sum(focus) > 0)"""

# The families and awards the test codes can have, for the SQL side.
FAMILY_SQL = """CASE lpad(regexp_replace(code, '[^0-9]', '', 'g'), 2, '0')
  WHEN '01' THEN 'Agriculture' WHEN '03' THEN 'Nat Resources' WHEN '04' THEN 'Architecture' WHEN '05' THEN 'Area/Eth/Cult'
  WHEN '09' THEN 'Comm & Journ' WHEN '10' THEN 'Comm Tech' WHEN '11' THEN 'CS/Info Sci' WHEN '12' THEN 'Culinary & Pers'
  WHEN '13' THEN 'Education' WHEN '14' THEN 'Engr' WHEN '15' THEN 'Eng Tech' WHEN '16' THEN 'Lang & Ling'
  WHEN '19' THEN 'Family & Cons' WHEN '22' THEN 'Legal Studies' WHEN '23' THEN 'English' WHEN '24' THEN 'Liberal Arts'
  WHEN '25' THEN 'Library Sci' ELSE 'Other' END"""
AWARD_SQL = """CASE award_level WHEN 1 THEN '<1 Year Certificate' WHEN 2 THEN '1–2 Year Cert' WHEN 3 THEN 'Associate'
  WHEN 4 THEN '2–4 Year Cert' WHEN 5 THEN 'Bachelor''s' ELSE 'Other' END"""


@query(
    "program_award_mix",
    f"""WITH {MIX_SQL}
    SELECT entity, code, title, award_level, focus, {AWARD_SQL} AS award, {FAMILY_SQL} AS family FROM mix""",
)
def program_award_mix(t: Tables, year: int | str | None = None) -> DataFrame:
    labelled = classify_award(classify_program(program_mix(t, year), "code"), "award_level")
    return labelled.select("entity", "code", "title", "award_level", "focus", "award", "family")


@query(
    "share_within_group",
    f"""WITH {MIX_SQL}
    SELECT entity, code, title, award_level, focus,
           round(focus / CAST(sum(focus) OVER (PARTITION BY entity, title) AS DOUBLE), 6) AS share FROM mix""",
)
def share_within_group(t: Tables) -> DataFrame:
    return rounded(share_of_group(program_mix(t), "focus", ["entity", "title"]))


@query(
    "window_group_totals",
    f"""WITH {MIX_SQL}, f AS (SELECT *, {FAMILY_SQL} AS family FROM mix)
    SELECT entity, code, title, award_level, focus, family,
           CAST(sum(focus) OVER (PARTITION BY entity, family) AS BIGINT) AS family_total FROM f""",
)
def window_group_totals(t: Tables) -> DataFrame:
    labelled = classify_program(program_mix(t), "code").drop("family_full")
    return group_total(labelled, "focus", ["entity", "family"], "family_total")


@query(
    "rank_groups_items",
    f"""WITH {MIX_SQL}, f AS (SELECT *, {FAMILY_SQL} AS family FROM mix),
    g AS (SELECT entity, family, sum(focus) AS group_total FROM f GROUP BY entity, family),
    gr AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY group_total DESC, family) AS group_rank FROM g),
    i AS (SELECT entity, family, title, max(focus) AS largest FROM f GROUP BY entity, family, title),
    ir AS (SELECT *, row_number() OVER (PARTITION BY entity, family ORDER BY largest DESC, title) AS item_rank FROM i)
    SELECT entity, code, title, award_level, focus, family, CAST(group_total AS BIGINT) AS group_total,
           CAST(group_rank AS INTEGER) AS group_rank, CAST(item_rank AS INTEGER) AS item_rank
    FROM f JOIN gr USING (entity, family) JOIN ir USING (entity, family, title)""",
)
def rank_groups_items(t: Tables) -> DataFrame:
    labelled = classify_program(program_mix(t), "code").drop("family_full")
    return rank_groups_and_items(labelled, "family", "title", "focus", ["entity"])


@query(
    "reorder_by_mean_median",
    f"""WITH {MIX_SQL},
    v AS (SELECT entity, title, avg(focus) AS mean_value, median(CAST(focus AS DOUBLE)) AS median_value FROM mix GROUP BY entity, title)
    SELECT entity, title, round(mean_value, 6) AS mean_value, round(median_value, 6) AS median_value,
           CAST(row_number() OVER (PARTITION BY entity ORDER BY mean_value, title) AS INTEGER) AS mean_order,
           CAST(row_number() OVER (PARTITION BY entity ORDER BY median_value, title) AS INTEGER) AS median_order FROM v""",
)
def reorder_by_mean_median(t: Tables) -> DataFrame:
    return rounded(order_by_summary(materialize(program_mix(t), "program-mix"), "title", "focus", ["entity"]))


@query(
    "mix_item_counts",
    f"""WITH {MIX_SQL}, f AS (SELECT *, {FAMILY_SQL} AS family FROM mix)
    SELECT entity, count(DISTINCT title) AS items, count(DISTINCT family) AS groups FROM f GROUP BY entity""",
)
def mix_item_counts(t: Tables) -> DataFrame:
    pairs = classify_program(program_mix(t), "code").select("entity", "title", "family").distinct()
    return pairs.groupBy("entity").agg(F.count_distinct("title").alias("items"), F.count_distinct("family").alias("groups"))


@query(
    "latest_year_mix",
    f"""WITH {SUPPLY_SQL}, last AS (SELECT entity, max(year) AS year FROM s GROUP BY entity)
    SELECT entity, year, code, award_level, CAST(sum(focus) AS BIGINT) AS focus
    FROM s JOIN last USING (entity, year) GROUP BY entity, year, code, award_level HAVING sum(focus) > 0""",
)
def latest_year_mix(t: Tables) -> DataFrame:
    """Each entity's mix in its own last year, which is the last with any award, focus or not.

    Both sides are sums, so the join sees an entity at most once per program, level and year.
    """
    last = supply_by_entity(t).groupBy("entity").agg(F.max("year").alias("year"))
    sums = mix(focus_by_program(t, with_year=True), ["entity", "year", "code", "award_level"])
    return sums.join(last, ["entity", "year"])


def entity_means(t: Tables) -> DataFrame:
    return summarise_entities(entity_years(t))


LEADERS_SQL = ENTITY_YEAR_SQL + """,
m AS (SELECT entity, avg(total) AS mean_total, avg(focus) AS mean_focus, avg(focus) / avg(total) AS focus_share FROM ey GROUP BY entity)"""


@query(
    "leaders_entity_total",
    f"""WITH {LEADERS_SQL}
    SELECT entity, round(mean_focus, 6) AS mean_focus, CAST(row_number() OVER (ORDER BY mean_focus DESC, entity) AS BIGINT) AS rank,
           entity || ' — ' || format('{{:,}}', CAST(round_even(mean_focus, 0) AS BIGINT)) AS caption
    FROM m ORDER BY rank LIMIT {LEADERS}""",
)
def leaders_entity_total(t: Tables, prepared: str | None = None) -> DataFrame:
    """Top entities by mean focus awards, from a list prepared earlier if there is one."""
    if prepared is None:
        source = entity_means(t)
    else:
        source = read_or_build(lambda: read_csv(t.spark, prepared, "entity string, mean_focus double"), lambda: entity_means(t))
    return rounded(leaderboard(source, "entity", "mean_focus", comma(F.col("mean_focus")), LEADERS))


@query(
    "leaders_entity_pct",
    f"""WITH {LEADERS_SQL}
    SELECT entity, round(focus_share, 6) AS focus_share, CAST(row_number() OVER (ORDER BY focus_share DESC, entity) AS BIGINT) AS rank,
           entity || ' — ' || regexp_replace(printf('%.1f', round_even(focus_share * 100, 1)), '\\.0$', '') || '%' AS caption
    FROM m ORDER BY rank LIMIT {LEADERS}""",
)
def leaders_entity_pct(t: Tables) -> DataFrame:
    """Top entities by focus share; the share is added where the table has none."""
    means = entity_means(t).drop("focus_share")
    return rounded(leaderboard(with_share(means), "entity", "focus_share", percent_text(F.col("focus_share")), LEADERS))


def with_share(df: DataFrame, total: str = "mean_total", focus: str = "mean_focus", share: str = "focus_share") -> DataFrame:
    """Add the share column if the table lacks it: 0 for no awards, null for unknown ones."""
    return df if share in df.columns else df.withColumn(share, ratio_or_zero(F.col(focus), F.col(total)))


@query(
    "paged_table",
    f"""WITH {LEADERS_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY focus_share DESC, entity) AS row FROM m)
    SELECT entity, round(mean_total, 6) AS mean_total, round(mean_focus, 6) AS mean_focus, round(focus_share, 6) AS focus_share,
           CAST(row AS BIGINT) AS row FROM r WHERE row BETWEEN 11 AND 20""",
)
def paged_table(t: Tables, number: int = 2) -> DataFrame:
    return rounded(page(entity_means(t), [descending("focus_share"), ascending("entity")], number))


@query(
    "resolve_column_metric",
    f"""WITH {ENTITY_YEAR_SQL}
    SELECT year, round(avg(focus) / avg(total), 6) AS value FROM ey GROUP BY year""",
)
def resolve_column_metric(t: Tables) -> DataFrame:
    """The share column of a national table, found under any of the names the caller lists."""
    table = national_supply(entity_years(t)).withColumnsRenamed({"focus_share": "Share_Of_Focus", "mean_focus": "Mean_Focus"})
    column = resolve_column(table, ["focus_share", "share_of_focus"])
    if column is None:
        raise ValueError("no share column")
    return rounded(table.select("year", F.col(column).alias("value")))
