"""Zone labels, canonical names and unique label-to-zone maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regionlens.functions.numbers import count_values
from regionlens.operators.skew import hot_keys, look_up_spread
from regionlens.session import materialize

# Fixed value: cities with at least this part of the largest population share the label.
SHARE_OF_LARGEST = 0.8
# Labels of more characters stand in facts under a key that begins with as many of them.
KEY_CHARS = 40


def dominant_city_label(
    cities: DataFrame, zone: str = "zone_code", city: str = "city", population: str = "population",
    share: float = SHARE_OF_LARGEST, name: str = "zone",
) -> DataFrame:
    """Label a zone by its largest city, or by all cities of nearly the same size, largest first.

    The rule names one city when it is at least twice the second, else every city with
    `share` of the largest. For a positive largest population the second half already gives a single
    city in that case, so only zones without a positive population need the first half. Cities that
    can be in the label are kept before anything is collected; unknown populations do not count.
    """
    known = cities.where(F.col(population).isNotNull() & F.col(zone).isNotNull())
    row = F.struct((-F.col(population)).alias("p"), F.col(city).alias("c"))
    largest = known.groupBy(zone).agg(
        F.max(population).alias("_largest"), F.min(row)["c"].alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    compared = look_up_spread(known, largest.drop("_rows"), zone, hot_keys(largest, zone, "_rows"), [city, population])
    positive = F.col("_largest") > 0
    near = compared.where(
        F.when(positive, F.col(population) >= F.col("_largest") * share).otherwise(F.col(city) == F.col("_first"))
    ).select(zone, "_first", positive.alias("_positive"), row.alias("_row"))
    together = near.groupBy(zone, "_first", "_positive").agg(F.array_sort(F.collect_list("_row")).alias("_rows"))
    joined = F.array_join(F.transform("_rows", lambda r: r["c"]), " & ")
    return together.select(zone, F.when(F.col("_positive"), joined).otherwise(F.col("_first")).alias(name))


def county_list_label(
    counties: DataFrame, zone: str = "zone_code", county: str = "county_name", name: str = "zone"
) -> DataFrame:
    """`County: a` or `Counties: a, b` from the sorted names of a zone's counties.

    Names are reduced to distinct ones before they are collected, so a group holds the counties of
    one zone and not the rows that mention them.
    """
    distinct = counties.select(zone, county).distinct()
    listed = distinct.groupBy(zone).agg(
        count_values(F.col(county)).alias("_n"),
        F.array_join(F.array_sort(F.collect_set(county)), ", ").alias("_names"),
    )
    known = F.when(F.col("_names") != "", F.col("_names"))
    return listed.select(
        zone,
        F.when(F.col("_n") == 1, F.concat(F.lit("County: "), known))
        .otherwise(F.concat(F.lit("Counties: "), known))
        .alias(name),
    )


def label_chain(zones: DataFrame, by_city: DataFrame, by_county: DataFrame, zone: str = "zone_code", name: str = "zone") -> DataFrame:
    """City label, else county label, else the zone code."""
    return (
        zones.select(zone).distinct()
        .join(by_city.select(zone, F.col(name).alias("_city")), zone, "left")
        .join(by_county.select(zone, F.col(name).alias("_county")), zone, "left")
        .select(
            zone,
            F.coalesce("_city", "_county", F.concat(F.lit("CZ "), F.col(zone).cast("string"))).alias(name),
        )
    )


def dedupe_labels(labels: DataFrame, zone: str = "zone_code", name: str = "zone") -> DataFrame:
    """Append ` (CZ code)` where several zones share a label. A label most zones share is spread out."""
    uses = labels.groupBy(name).agg(F.count(F.lit(1)).alias("_uses"))
    counted = look_up_spread(labels, uses, name, hot_keys(uses, name, "_uses"), [zone])
    tagged = F.concat(F.col(name), F.lit(" (CZ "), F.col(zone).cast("string"), F.lit(")"))
    return counted.select(zone, F.when(F.col("_uses") > 1, tagged).otherwise(F.col(name)).alias(name))


def short_keys(labels: DataFrame, name: str = "zone", key: str = "_key", chars: int = KEY_CHARS) -> DataFrame:
    """Give every label a key of bounded length that sorts as the label does; a short label is its own key.

    The key of a long one is its beginning, its place among the labels that begin so, and a hash of the whole, which
    changes when the label does. Equal labels have equal keys. `labels` has a row per zone, so a task can order the
    labels with one beginning.
    """
    text = F.col(name)
    alike = Window.partitionBy(text.substr(1, chars)).orderBy(name)
    place = F.lpad(F.dense_rank().over(alike).cast("string"), 10, "0")
    long_key = F.concat(text.substr(1, chars), place, F.sha2(text, 256).substr(1, 32))
    return labels.withColumn(key, F.when(F.length(text) > chars, long_key).otherwise(text))


def latest_names(df: DataFrame, unit: str, name: str, when: str, rows: str | None = None) -> DataFrame:
    """Per unit, its most frequent name in its latest year; ties by name.

    One aggregate over counts: the smallest of (-year, -count, name), so no unit is sorted in a task.
    `rows` names a column for the number of rows of the unit.
    """
    counts = df.groupBy(unit, when, name).agg(F.count(F.lit(1)).alias("_n"))
    key = F.struct((-F.col(when)).alias("y"), (-F.col("_n")).alias("n"), F.col(name).isNull().alias("u"), F.col(name).alias("v"))
    extra = [F.sum("_n").alias(rows)] if rows else []
    return counts.groupBy(unit).agg(F.min(F.when(F.col(when).isNotNull(), key))["v"].alias(name), *extra)


def use_latest_name(df: DataFrame, unit: str, name: str, when: str) -> DataFrame:
    """Every row under the latest name of its unit. Units with very many rows are spread out.

    The names are written once, one row per unit: the lookup and the hot units both come from them.
    """
    names = materialize(latest_names(df, unit, name, when, "_rows"), "latest-names")
    canonical = names.select(unit, F.col(name).alias("_latest"))
    others = [c for c in df.columns if c != unit]
    renamed = look_up_spread(df, canonical, unit, hot_keys(names, unit, "_rows"), others)
    return renamed.select(*[F.col("_latest").alias(name) if c == name else F.col(c) for c in df.columns])


def largest_zone_per_label(population: DataFrame, zone: str = "zone_code", label: str = "zone", value: str = "population") -> DataFrame:
    """Each label with the zone of the largest summed population; ties by zone."""
    totals = population.where(F.col(label).isNotNull()).groupBy(zone, label).agg(F.coalesce(F.sum(value), F.lit(0)).alias("_sum"))
    key = F.struct((-F.col("_sum")).alias("s"), F.col(zone).alias("z"))
    return totals.groupBy(label).agg(F.min(key)["z"].alias(zone))
