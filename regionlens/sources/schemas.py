"""Columns of the input tables, so that no reader has to infer them."""

from __future__ import annotations

CROSSWALK = "geoid string, zone_code int"
CITIES = "city string, state_name string, county_fips string, population double"
COUNTY_NAMES = "geoid string, name string, state_fips string"
STATE_CODES = "state_code string, state string"
ZONE_LABELS = "county int, zone_code int, zone string"

COMPLETIONS = (
    "unitid bigint, entity string, industry int, year int, state string, tribal int, rural int, code string, "
    "title string, county string, award_level string, total bigint, focus bigint, enrolled bigint, "
    "ft_enrolled bigint, web string, latitude double, longitude double"
)
POSTINGS = "county int, county_name string, year int, soc string, total bigint"
OCCUPATIONS = "soc string, soc_title string, ed_req int, focus_flag int, industry string"
POPULATION = "geoid string, population double, margin double, year int"

ENTITY_TABLE = (
    "entity string, zone string, mean_total double, mean_focus double, focus_share double, "
    "mean_enrolled double, rural int, tribal int"
)
ZONE_YEAR_TABLE = "zone string, year int, total bigint, focus bigint, population double, focus_share double, per_1000 double"
NATIONAL_SUPPLY = "year int, mean_focus double, focus_share double"
NATIONAL_DEMAND = "year int, mean_total double, mean_focus double, focus_share double, mean_population double, per_1000 double"
