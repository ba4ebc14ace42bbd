"""Batch build: from the raw inputs to zone labels, the two facts and the map tables.

Each function returns a lazy DataFrame over the schemas in `regionlens.sources.schemas`; write the
results as Parquet between steps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionlens.functions.codes import state_table
from regionlens.functions.numbers import first_by, ratio, sum_or_zero, to_int
from regionlens.functions.text import drop_suffix, strip_space
from regionlens.operators.aggregates import (
    lead_zones,
    map_entities,
    national_demand,
    national_supply,
    one_hot,
    roll_up_postings,
    snake_names,
    summarise_entities,
    summarise_zones,
    with_focus,
    yearly_demand,
    yearly_supply,
    zone_population,
)
from regionlens.operators.joins import keep_matches, look_up, sorted_side
from regionlens.operators.labels import (
    county_list_label,
    dedupe_labels,
    dominant_city_label,
    label_chain,
    largest_zone_per_label,
    use_latest_name,
)
from regionlens.session import materialize

# The state whose counties have no zone, the word that marks an unknown county.
SKIPPED_STATE = "02"
UNKNOWN = "Unknown"


def county_zones(crosswalk: DataFrame) -> DataFrame:
    kept = crosswalk.where(~F.col("geoid").startswith(SKIPPED_STATE))
    return kept.select(to_int(F.col("geoid")).alias("county"), "zone_code")


def named_cities(cities: DataFrame, counties: DataFrame) -> DataFrame:
    """Cities of known counties with their zone and `city, ST`."""
    placed = keep_matches(cities.withColumn("county", to_int(F.col("county_fips"))), sorted_side(counties), "county")
    states = state_table(cities.sparkSession)
    full = F.coalesce(F.concat("city", F.lit(", "), "state_abbrev"), F.col("city"))
    return look_up(placed, states, "state_name").select("zone_code", full.alias("city"), "population")


def named_counties(names: DataFrame, state_codes: DataFrame) -> DataFrame:
    """County number and `Name Co., ST`."""
    states = state_codes.select(to_int(F.col("state_code")).alias("_state"), F.col("state").alias("_abbrev")).distinct()
    clean = drop_suffix(F.col("name"), " County")
    full = F.coalesce(F.concat(clean, F.lit(" Co., "), F.col("_abbrev")), clean)
    return look_up(names.withColumn("_state", to_int(F.col("state_fips"))), states, "_state").select(
        to_int(F.col("geoid")).alias("county"), full.alias("county_name")
    )


def zone_names(counties: DataFrame, cities: DataFrame, names: DataFrame, state_codes: DataFrame) -> DataFrame:
    """Zone code and the zone's unique label."""
    by_city = dominant_city_label(named_cities(cities, counties))
    by_county = county_list_label(look_up(counties, sorted_side(named_counties(names, state_codes)), "county"))
    return dedupe_labels(label_chain(counties, by_city, by_county))


# Bytes of label text that a task attaches to counties.
LABEL_BYTES = 256 << 20


def zone_labels(
    crosswalk: DataFrame, cities: DataFrame, names: DataFrame, state_codes: DataFrame, label_bytes: int = LABEL_BYTES
) -> DataFrame:
    """County, zone code and the zone's unique label.

    A label names many cities where a zone has many, and every county carries it, so the rows are far larger than what
    they are made from. The labels are written once, one row per zone; the counties are dealt out by what they will weigh.
    """
    counties = county_zones(crosswalk)
    written = materialize(zone_names(counties, cities, names, state_codes), "zone-names")
    per_zone = counties.groupBy("zone_code").agg(F.count(F.lit(1)).alias("_rows")).join(written, "zone_code")
    weight = per_zone.agg(F.sum(F.col("_rows") * F.octet_length("zone"))).first()[0] or 0
    if weight > label_bytes:
        counties = counties.repartition(-(-weight // label_bytes), "county")
    return look_up(counties, written, "zone_code").select("county", "zone_code", "zone")


def supply_fact(completions: DataFrame, labels: DataFrame) -> DataFrame:
    """Awards per institution, year, program and level, under the institution's latest name."""
    return zoned_completions(renamed_completions(completions), labels)


def renamed_completions(completions: DataFrame) -> DataFrame:
    renamed = use_latest_name(completions, "unitid", "entity", "year")
    return renamed.withColumns({"title": strip_space(F.col("title")), "county": to_int(F.col("county"))})


def zoned_completions(renamed: DataFrame, labels: DataFrame) -> DataFrame:
    return look_up(renamed, sorted_side(labels.select("county", "zone")), "county").drop("county")


def map_supply(supply: DataFrame) -> DataFrame:
    """Institution and year for the map: place, totals, focus share.

    Summed first with the zone among the keys, as a text among the values would make Spark sort the
    whole fact; the first known place is then taken from a row per institution, year and zone.
    """
    known = F.when(F.col("longitude").isNotNull(), F.col("latitude"))  # a place is a pair, never one number of each of two
    place = [F.min(known).alias("latitude"), F.min_by("longitude", known).alias("longitude")]
    sums = supply.groupBy("year", "unitid", "entity", "zone").agg(
        sum_or_zero(F.col("total")).alias("total"), sum_or_zero(F.col("focus")).alias("focus"), *place
    )
    return map_entities(sums, F.struct("zone")).orderBy(F.asc_nulls_last("year"), F.asc_nulls_last("entity"))


def occupation_flags(occupations: DataFrame, industries: Sequence[str], no_industry: str = "none") -> DataFrame:
    """Occupation table with a 0/1 column `industry_…` per listed industry, without the title.

    `no_industry` stands for none of them; any other unlisted industry is an error.
    """
    ids = ["soc", "ed_req", "focus_flag"]
    named = occupations.withColumn("industry", F.nullif(F.col("industry"), F.lit(no_industry)))
    wide = snake_names(one_hot(named, ids, "industry", industries))
    return wide.withColumnsRenamed({c: f"industry_{c}" for c in wide.columns if c not in ids})


def county_population(population: DataFrame) -> DataFrame:
    return population.select(to_int(F.col("geoid")).alias("county"), "year", "population")


def demand_rows(
    postings: DataFrame, labels: DataFrame, occupations: DataFrame, population: DataFrame, industries: Sequence[str]
) -> DataFrame:
    """Postings per county, year and occupation with what the other inputs say about them."""
    return populated_postings(described_postings(zoned_postings(postings, labels), occupations, industries), population)


def zoned_postings(postings: DataFrame, labels: DataFrame) -> DataFrame:
    known = postings.where(~F.col("county_name").contains(UNKNOWN))
    return look_up(known, sorted_side(labels.select("county", "zone")), "county")


def described_postings(zoned: DataFrame, occupations: DataFrame, industries: Sequence[str]) -> DataFrame:
    return look_up(zoned, occupation_flags(occupations, industries), "soc")


def populated_postings(described: DataFrame, population: DataFrame) -> DataFrame:
    return look_up(described, sorted_side(county_population(population)), ["county", "year"])


def occupation_titles(occupations: DataFrame) -> DataFrame:
    return occupations.groupBy("soc").agg(F.min("soc_title").alias("soc_title"))


def demand_of_rows(rows: DataFrame, titles: DataFrame) -> DataFrame:
    """Postings per zone, year and occupation; the title is joined to the sums."""
    return look_up(roll_up_postings(rows, F.col("county")), titles, "soc")


def demand_fact(
    postings: DataFrame, labels: DataFrame, occupations: DataFrame, population: DataFrame, industries: Sequence[str]
) -> DataFrame:
    """Postings per zone, year and occupation."""
    return demand_of_rows(demand_rows(postings, labels, occupations, population, industries), occupation_titles(occupations))


def map_zones(demand: DataFrame, labels: DataFrame, population: DataFrame, max_year: int | None = None) -> DataFrame:
    """Zone code and year for the map: totals, percent, population sum, total postings per 1,000; years up to `max_year` if given."""
    return zones_on_map(yearly_postings(demand), labels, population, max_year)


def zones_on_map(yearly: DataFrame, labels: DataFrame, population: DataFrame, max_year: int | None = None) -> DataFrame:
    """The same from the yearly sums of the zones."""
    shown = F.lit(True) if max_year is None else F.col("year") <= max_year
    placed = look_up(county_population(population), sorted_side(labels), "county").where(F.col("zone_code").isNotNull())
    residents = zone_population(placed, max_year, ["zone_code"])
    unique = largest_zone_per_label(placed.where(shown))
    yearly = yearly.where(shown).drop("population")
    joined = look_up(keep_matches(yearly, unique, "zone"), residents, ["zone_code", "year"])
    return joined.withColumns(
        {
            "focus_percent": ratio(F.col("focus"), F.col("total"), 100),
            "per_1000": ratio(F.col("total"), F.col("population"), 1000),
        }
    )


# --- marts from the two facts -------------------------------------------------------------------


def yearly_awards(supply: DataFrame) -> DataFrame:
    """Institution and year: sums, and enrolment, flags and zone of the first unit under that name.

    The zone is a key of the first sum and units are numbers, so that the pass over the fact stays in
    hash tables.
    """
    carried = ("enrolled", "rural", "tribal")
    of_unit = [first_by(F.col(c), F.col("unitid")).alias(c) for c in carried]
    sums = yearly_supply(supply, ["entity", "zone"], [*of_unit, F.min("unitid").alias("unit")])
    of_name = [first_by(F.col(c), F.col("unit")).alias(c) for c in (*carried, "zone")]
    return yearly_supply(sums, ["entity"], of_name)


def national_awards(supply: DataFrame) -> DataFrame:
    """The published national table of awards: mean focus awards and focus share per year."""
    return national_supply(yearly_awards(supply)).select("year", "mean_focus", "focus_share")


def institution_table(supply: DataFrame) -> DataFrame:
    """Every institution with its zone, flags and means over years."""
    return summarise_entities(yearly_awards(supply), ["zone", "rural", "tribal"])


def yearly_postings(demand: DataFrame) -> DataFrame:
    """Zone and year: postings, focus postings and the mean of the occupations' populations."""
    return yearly_demand(with_focus(demand))


def national_postings(demand: DataFrame, numerator: str = "focus") -> DataFrame:
    """The published national table of postings."""
    return national_demand(yearly_postings(demand), numerator=numerator)


def zone_year_table(demand: DataFrame) -> DataFrame:
    """Zone and year with focus share and focus postings per 1,000 residents."""
    return with_zone_rates(yearly_postings(demand))


def with_zone_rates(yearly: DataFrame) -> DataFrame:
    return yearly.withColumns(
        {
            "focus_share": ratio(F.col("focus"), F.col("total")),
            "per_1000": ratio(F.col("focus"), F.col("population"), 1000),
        }
    )


def zone_table(demand: DataFrame) -> DataFrame:
    """Every zone with its means over years."""
    return summarise_zones(yearly_postings(demand))


def zone_leaders(demand: DataFrame, partial_year: int | None = None) -> DataFrame:
    """Mean focus postings, share and rate of every zone, without a year that is not complete."""
    complete = demand if partial_year is None else demand.where(F.col("year") != partial_year)
    return lead_zones(yearly_postings(complete))
