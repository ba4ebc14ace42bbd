"""Grouped summaries of the supply and the demand fact.

A fact has the measures `total` and `focus` (the part of `total` in the focus sector). The demand
fact also has `population`. Facts may come pre-aggregated: `weight` then names the column that says
how many original rows a row stands for, so that means stay means over original rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionlens.functions.numbers import (
    first_by,
    first_known_by,
    flagged,
    ratio,
    sum_or_zero,
    weighted_mean,
)


def with_focus(df: DataFrame, total: str = "total", flag: str = "focus_flag") -> DataFrame:
    return df.withColumn("focus", flagged(F.col(total), F.col(flag)))


def yearly_supply(supply: DataFrame, unit: Sequence[str] = ("entity",), extra: Sequence[Column] = ()) -> DataFrame:
    """Unit and year: total and focus awards, and whatever else `extra` adds."""
    return supply.groupBy(*unit, "year").agg(
        sum_or_zero(F.col("total")).alias("total"),
        sum_or_zero(F.col("focus")).alias("focus"),
        *extra,
    )


def yearly_demand(demand: DataFrame, unit: Sequence[str] = ("zone",), weight: str | None = None) -> DataFrame:
    """Unit and year: total and focus postings and the mean population."""
    population = F.avg("population") if weight is None else weighted_mean(F.col("population"), F.col(weight))
    return demand.groupBy(*unit, "year").agg(
        sum_or_zero(F.col("total")).alias("total"),
        sum_or_zero(F.col("focus")).alias("focus"),
        population.cast("double").alias("population"),
    )


def supply_rates(yearly: DataFrame) -> DataFrame:
    return yearly.withColumn("focus_percent", ratio(F.col("focus"), F.col("total"), 100))


def demand_rates(yearly: DataFrame, per: float = 1000, numerator: str = "focus") -> DataFrame:
    """Focus percent and postings per `per` residents. The numerator is the focus or the total."""
    return yearly.withColumns(
        {
            "focus_percent": ratio(F.col("focus"), F.col("total"), 100),
            "per_capita": ratio(F.col(numerator), F.col("population"), per),
        }
    )


def national_supply(yearly: DataFrame) -> DataFrame:
    """Mean over entities per year; the share is the ratio of the two means."""
    means = yearly.groupBy("year").agg(
        F.avg("total").alias("mean_total"),
        F.avg("focus").alias("mean_focus"),
        *_mean_enrolment(yearly),
    )
    return means.withColumn("focus_share", ratio(F.col("mean_focus"), F.col("mean_total")))


def national_demand(yearly: DataFrame, per: float = 1000, numerator: str = "focus") -> DataFrame:
    """Mean over zones per year, then ratios of means."""
    means = yearly.groupBy("year").agg(
        F.avg("total").alias("mean_total"),
        F.avg("focus").alias("mean_focus"),
        F.avg("population").alias("mean_population"),
    )
    return means.withColumns(
        {
            "focus_share": ratio(F.col("mean_focus"), F.col("mean_total")),
            "per_1000": ratio(F.col(f"mean_{numerator}"), F.col("mean_population"), per),
        }
    )


def _mean_enrolment(yearly: DataFrame) -> list[Column]:
    return [F.avg("enrolled").alias("mean_enrolled")] if "enrolled" in yearly.columns else []


def summarise_entities(yearly: DataFrame, attributes: Sequence[str] = ()) -> DataFrame:
    """Entity: means over years, ratio of means, attributes of its first year."""
    means = yearly.groupBy("entity").agg(
        F.avg("total").alias("mean_total"),
        F.avg("focus").alias("mean_focus"),
        *_mean_enrolment(yearly),
        *[first_by(F.col(a), F.col("year")).alias(a) for a in attributes],
    )
    return means.withColumn("focus_share", ratio(F.col("mean_focus"), F.col("mean_total")))


def summarise_zones(yearly: DataFrame, per: float = 1000, numerator: str = "total") -> DataFrame:
    """Zone: means over years, ratios of means."""
    means = yearly.groupBy("zone").agg(
        F.avg("population").alias("mean_population"),
        F.avg("total").alias("mean_total"),
        F.avg("focus").alias("mean_focus"),
    )
    return means.withColumns(
        {
            "focus_share": ratio(F.col("mean_focus"), F.col("mean_total")),
            "per_1000": ratio(F.col(f"mean_{numerator}"), F.col("mean_population"), per),
        }
    )


def lead_zones(yearly: DataFrame, per: float = 1000) -> DataFrame:
    """Zone: mean focus postings, and means over years of the yearly ratios."""
    return yearly.groupBy("zone").agg(
        F.avg("focus").alias("mean_focus"),
        F.avg(ratio(F.col("focus"), F.col("total"))).alias("mean_share"),
        F.avg(ratio(F.col("focus"), F.col("population"), per)).alias("mean_per_1000"),
    )


def map_entities(
    supply: DataFrame, key: Column, attributes: Sequence[str] = ("zone", "latitude", "longitude"),
    unit: Sequence[str] = ("year", "unitid", "entity"),
) -> DataFrame:
    """Year and entity: first known attributes in key order, totals and the focus share."""
    sums = supply.groupBy(*unit).agg(
        *[first_known_by(F.col(a), key).alias(a) for a in attributes],
        sum_or_zero(F.col("total")).alias("total"),
        sum_or_zero(F.col("focus")).alias("focus"),
    )
    return sums.withColumn("focus_share", ratio(F.col("focus"), F.col("total")))


def roll_up_postings(
    postings: DataFrame, key: Column, first: Sequence[str] | Mapping[str, Column] = ("ed_req", "focus_flag"),
    family: str = "industry_", weight: str | None = None, mean: Column | None = None,
) -> DataFrame:
    """County rows to zone, year and occupation: sum, mean population, first attributes in key order.

    Columns that start with `family` are taken along the same way. Rows without a zone are dropped
    and an unknown focus flag becomes 0. Attributes are numeric codes and the key one number, which
    keeps the aggregation in hash tables; text that depends on the occupation is looked up afterwards.
    Attributes may have keys of their own, and `mean` may give the mean population of rows that are sums already.
    """
    keys = first if isinstance(first, Mapping) else {c: key for c in first}
    carried = {**keys, **{c: key for c in postings.columns if c.startswith(family)}}
    if mean is not None:
        population = mean
    else:
        population = F.avg("population") if weight is None else weighted_mean(F.col("population"), F.col(weight))
    rolled = (
        postings.where(F.col("zone").isNotNull())
        .groupBy("zone", "year", "soc")
        .agg(
            population.cast("double").alias("population"),
            sum_or_zero(F.col("total")).alias("total"),
            *[first_by(F.col(c), own).alias(c) for c, own in carried.items()],
        )
    )
    return rolled.fillna({"focus_flag": 0}) if "focus_flag" in carried else rolled


def zone_population(population: DataFrame, max_year: int | None, unit: Sequence[str] = ("zone",)) -> DataFrame:
    """Sum of county populations per zone and year, up to a last year."""
    known = population.where(F.col(unit[0]).isNotNull())
    if max_year is not None:
        known = known.where(F.col("year") <= max_year)
    return known.groupBy(*unit, "year").agg(sum_or_zero(F.col("population")).alias("population"))


def mix(df: DataFrame, by: Sequence[str], value: str = "focus", positive: bool = True) -> DataFrame:
    """Sum per combination; positive sums only, or all of them."""
    sums = df.groupBy(*by).agg(sum_or_zero(F.col(value)).alias(value))
    return sums.where(F.col(value) > 0) if positive else sums


def frequencies(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def units_with_many_names(df: DataFrame, unit: str, name: str) -> DataFrame:
    """Units that appear under more than one name, with the number of names (an unknown one counts)."""
    return df.select(unit, name).distinct().groupBy(unit).agg(F.count(F.lit(1)).alias("names")).where(F.col("names") > 1)


def one_hot(df: DataFrame, ids: Sequence[str], category: str, values: Sequence[str]) -> DataFrame:
    """A 0/1 column per listed category, in one aggregation. A category outside the list is an error; null has no column."""
    known = F.col(category).isNull() | F.col(category).isin(*values)
    unlisted = F.concat(F.lit(f"{category} is not listed: "), F.col(category))
    checked = F.when(known, F.col(category)).otherwise(F.raise_error(unlisted))
    flags = [F.coalesce(F.max((F.col("_category") == v).cast("int")), F.lit(0)).alias(v) for v in values]
    return df.withColumn("_category", checked).groupBy(*ids).agg(*flags)


def snake_names(df: DataFrame) -> DataFrame:
    """Column names in lower case with underscores; a leading digit gets an `x` before it."""

    def clean(name: str) -> str:
        text = "".join(c if c.isalnum() else "_" for c in name.lower())
        text = "_".join(part for part in text.split("_") if part)
        return f"x{text}" if text[:1].isdigit() else text

    return df.withColumnsRenamed({c: clean(c) for c in df.columns})


def first_of_family(df: DataFrame, by: Sequence[str], family: str, key: Column) -> DataFrame:
    """First value, in key order, of every column whose name starts with `family`."""
    chosen = [c for c in df.columns if c.startswith(family)]
    return df.groupBy(*by).agg(*[first_by(F.col(c), key).alias(c) for c in chosen])


def year_spine(df: DataFrame, unit: Sequence[str], value: str) -> DataFrame:
    """Every year from the unit's first to its last, null where the unit has no row."""
    bounds = df.groupBy(*unit).agg(F.min("year").alias("_from"), F.max("year").alias("_to"))
    years = bounds.where(F.col("_from").isNotNull()).select(*unit, F.explode(F.sequence("_from", "_to")).alias("year"))
    return years.join(df.select(*unit, "year", value), [*unit, "year"], "left")


def against_national(trend: DataFrame, national: DataFrame, unit: str, metric: str, national_metric: str) -> DataFrame:
    """The unit's series and, over the unit's own years, the national one, as long rows."""
    bounds = trend.groupBy(unit).agg(F.min("year").alias("_from"), F.max("year").alias("_to"))
    spans = bounds.select(unit, F.explode(F.sequence("_from", "_to")).alias("year"))
    benchmark = spans.join(national.select("year", F.col(national_metric).cast("double").alias("value")), "year")
    own = trend.select(unit, "year", F.lit(unit).alias("series"), F.col(metric).cast("double").alias("value"))
    return own.unionByName(benchmark.select(unit, "year", F.lit("national").alias("series"), "value"))


def column_facts(df: DataFrame, facts: Mapping[str, Column]) -> dict[str, Column]:
    """Aggregates over a whole table as scalars to be used beside its rows.

    However many there are, they are the fields of one row of one scan.
    """
    row = df.agg(F.struct(*[fact.alias(name) for name, fact in facts.items()]).alias("_facts")).scalar()
    return {name: row.getField(name) for name in facts}


def percent_scaled(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Each column, under its new name, times 100 if no value of the whole column is above 1."""
    largest = column_facts(df, {c: F.max(c) for c in names})
    return df.withColumns({name: F.when(largest[c] <= 1, F.col(c) * 100).otherwise(F.col(c)) for c, name in names.items()})


def percent_scaled_by_value(value: Column) -> Column:
    """Times 100 for each single value of at most 1."""
    return F.when(value <= 1, value * 100).otherwise(value)
