"""The interactive questions, asked of the facts and marts that `regionlens.plans.build` makes.

A view takes DataFrames and plain arguments and returns a lazy DataFrame. A filter on an entity, a
zone or a year is applied to the fact itself, so it reaches the scan; write the facts sorted by
entity or zone within a year (`write_partitions(..., sort=[...])`) and it skips most of the files.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionlens.functions.codes import classify_award, classify_occupation, classify_program, label_codes
from regionlens.functions.numbers import half_even, is_whole, ratio_or_zero, sum_or_zero
from regionlens.functions.text import comma, comma_tenths, html_popup, lines, percent_fixed, percent_text, plain_number, pretty_zone, yes_no
from regionlens.operators.aggregates import against_national, column_facts, demand_rates, mix, percent_scaled, supply_rates, with_focus, yearly_demand, yearly_supply
from regionlens.operators.joins import rows_of_latest
from regionlens.operators.ranking import (
    ascending,
    descending,
    group_total,
    leaderboard,
    order_groups_and_items,
    rank_groups_and_items,
    share_of_group,
    top_rows,
    top_rows_per_group,
)
from regionlens.sources.readers import resolve_column, year_choice

# The metrics a caller can choose. Any other choice means the first.
SUPPLY_METRICS = {"focus": "focus", "percent": "focus_percent"}
DEMAND_METRICS = {"focus": "focus", "percent": "focus_percent", "per_capita": "per_capita"}

# The columns of this engine's own national tables; other tables name theirs in an argument.
NATIONAL_COLUMNS: dict[str, Sequence[str]] = {"focus": ["mean_focus"], "percent": ["focus_share"], "per_capita": ["per_1000"]}


def metric_of(choices: dict[str, str], metric: str | None) -> str:
    return metric if metric in choices else next(iter(choices))


def name_choices(mapped: DataFrame, year: int | str, name: str = "entity") -> DataFrame:
    """Sorted distinct names of a year, unknown ones left out."""
    return mapped.where(year_choice(year) & F.col(name).isNotNull()).select(name).distinct().orderBy(name)


def find_entity(mapped: DataFrame, term: str, year: int | str, literal: bool = False) -> DataFrame:
    """First entity of the year whose name matches, with its popup; no row if none does."""
    name = F.col("entity")
    match = F.lower(name).contains(term.lower()) if literal else name.rlike(f"(?i){term}")
    found = mapped.where(year_choice(year) & match).orderBy(ascending("entity"), ascending("unitid")).limit(1)
    popup = html_popup(
        name,
        ("Zone", F.col("zone")),
        ("Year", F.col("year")),
        ("Total Completions", comma(F.col("total"))),
        ("Focus Completions", comma(F.col("focus_share") * F.col("total"))),
        ("Focus Percentage", percent_fixed(F.col("focus_share"))),
    )
    return found.withColumn("popup", popup)


def trend_of_entity(supply: DataFrame, entity: str, metric: str | None = None) -> DataFrame:
    """Awards, enrolment and focus awards of an entity by year, the chosen metric and its tooltip."""
    chosen = metric_of(SUPPLY_METRICS, metric)
    enrolled = sum_or_zero(F.col("enrolled")).alias("enrolled")
    yearly = supply_rates(yearly_supply(supply.where(F.col("entity") == entity), extra=[enrolled]))
    tips = {
        "focus": lines(("Year", F.col("year")), ("Focus Credentials", comma(F.col("focus")))),
        "percent": lines(("Year", F.col("year")), ("Focus %", percent_text(F.col("focus_percent") / 100))),
    }
    return yearly.withColumns({"value": F.col(SUPPLY_METRICS[chosen]).cast("double"), "tooltip": tips[chosen]})


def trend_of_zone(
    demand: DataFrame, zone: str, metric: str | None = None, partial_year: int | None = None, per: float = 1000
) -> DataFrame:
    """Postings, focus postings and rates of a zone by year, the chosen metric and its tooltip."""
    chosen = metric_of(DEMAND_METRICS, metric)
    rows = demand.where(F.col("zone") == zone)
    if partial_year is not None:
        rows = rows.where(F.col("year") != partial_year)
    yearly = demand_rates(yearly_demand(with_focus(rows)), per)
    tips = {
        "focus": lines(("Year", F.col("year")), ("Focus Postings", comma(F.col("focus")))),
        "percent": lines(("Year", F.col("year")), ("Focus %", percent_text(F.col("focus_percent") / 100))),
        "per_capita": lines(("Year", F.col("year")), (f"Per {per:,.0f}", comma(F.col("per_capita")))),
    }
    return yearly.withColumns({"value": F.col(DEMAND_METRICS[chosen]).cast("double"), "tooltip": tips[chosen]})


def national_series(national: DataFrame, metric: str | None, names: Mapping[str, Sequence[str]] = NATIONAL_COLUMNS) -> DataFrame:
    """Year and value of the metric, under the first of its `names` that the table has; shares become percent."""
    chosen = metric if metric in names else "focus"
    column = resolve_column(national, names[chosen])
    if column is None:
        raise ValueError(f"the national table has no column for {chosen}: {', '.join(names[chosen])}")
    known = national.where(F.col("year").isNotNull())
    series = known.select("year", F.col(column).cast("double").alias("value"))
    return percent_scaled(series, {"value": "value"}) if chosen == "percent" else series


def with_benchmark(
    trend: DataFrame, national: DataFrame, unit: str, metric: str | None, names: Mapping[str, Sequence[str]] = NATIONAL_COLUMNS
) -> DataFrame:
    """A trend next to the national series over the trend's own years, as long rows."""
    return against_national(trend, national_series(national, metric, names), unit, "value", "value")


def programs_of_entity(supply: DataFrame, entity: str, year: int | str | None = None) -> DataFrame:
    """Focus awards by program and level: family, ranks, share in the program and tooltip."""
    rows = supply.where((F.col("entity") == entity) & year_choice(year))
    sums = mix(rows, ["code", "title", "award_level"])
    labelled = classify_award(classify_program(sums, "code"), "award_level")
    ranked = rank_groups_and_items(labelled, "family", "title", "focus")
    tooltip = lines(
        ("Field", F.col("family_full")), ("Program", F.col("title")), ("Award Level", F.col("award")), ("Credentials", comma(F.col("focus")))
    )
    return share_of_group(ranked, "focus", ["title"]).withColumn("tooltip", tooltip)


def occupations_of_zone(
    demand: DataFrame, zone: str, labels: list[tuple[str, str]], year: int | str | None = None,
    n: int | None = 10, partial_year: int | None = None,
) -> DataFrame:
    """The first `n` rows (occupation and education) of a zone by occupation total; all for `n=None`.

    Totals are taken before the cut; `group_rank` and `item_rank` order the groups shown by their total and the
    occupations of a group by theirs. Unknown education is the explicit level `Missing`.
    """
    rows = demand.where((F.col("zone") == zone) & (F.col("focus_flag") == 1) & year_choice(year))
    if partial_year is not None:
        rows = rows.where(F.col("year") != partial_year)
    sums = rows.groupBy("soc", "soc_title", "ed_req").agg(sum_or_zero(F.col("total")).alias("total"))
    known = sums.where(F.col("soc").isNotNull() & F.col("soc_title").isNotNull())
    labelled = label_codes(classify_occupation(known, "soc"), "ed_req", labels, "education", "education_rank")
    totals = group_total(group_total(labelled, "total", ["soc_title"], "title_total"), "total", ["group"], "group_total")
    order = [descending("title_total"), ascending("soc_title"), ascending("education_rank"), ascending("soc")]
    tooltip = lines(
        ("SOC Group", F.col("group_full")), ("Occupation", F.col("soc_title")), ("Education", F.col("education")), ("Postings", comma(F.col("total")))
    )
    shown = top_rows(totals, order, n).withColumn("tooltip", tooltip)
    return order_groups_and_items(shown, "group", "soc_title", names=("group_total", "title_total"))


def latest_programs(supply: DataFrame, years: DataFrame, entity: str | None = None) -> DataFrame:
    """Focus awards by program and level in the last year with any award, of one entity or of every one.

    `years`: the yearly sums of the entities, which tell the last year without a pass over the fact.
    """
    rows = rows_of_latest(supply, "entity", "year", years.select("entity", "year"), entity)
    return mix(rows, ["entity", "year", "code", "title", "award_level"])


def latest_occupations(
    demand: DataFrame, years: DataFrame, labels: list[tuple[str, str]], zone: str | None = None, n: int | None = 10, partial_year: int | None = None
) -> DataFrame:
    """The first `n` rows (occupation and education) of the last complete year, of one zone or of every one.

    `years`: the yearly sums of the zones. Unknown education is the explicit level `Missing`.
    """
    known = years.select("zone", "year")
    known = known if partial_year is None else known.where(F.col("year") != partial_year)
    rows = rows_of_latest(demand, "zone", "year", known, zone).where((F.col("focus_flag") == 1) & F.col("soc_title").isNotNull())
    sums = rows.groupBy("zone", "year", "soc_title", "ed_req").agg(sum_or_zero(F.col("total")).alias("total"))
    totals = group_total(label_codes(sums, "ed_req", labels, "education", "education_rank"), "total", ["zone", "soc_title"], "title_total")
    order = [descending("title_total"), ascending("soc_title"), ascending("education_rank"), ascending("ed_req")]
    return top_rows_per_group(totals, order, ["zone"], n)


def entity_leaders(table: DataFrame, metric: str, n: int | None = 150) -> DataFrame:
    """Top entities by `mean_focus` or `focus_share`, which is added to a table without it."""
    if "focus_share" not in table.columns:
        table = table.withColumn("focus_share", ratio_or_zero(F.col("mean_focus"), F.col("mean_total")))
    value = F.col(metric)
    return leaderboard(table, "entity", metric, percent_text(value) if metric == "focus_share" else comma(value), n)


# How the zone leaderboards show their metric.
LEADER_TEXT = {"mean_focus": comma, "mean_share": percent_text, "mean_per_1000": comma_tenths}


def zone_leaderboard(leaders: DataFrame, metric: str, n: int | None = 150) -> DataFrame:
    text: Column = LEADER_TEXT[metric](F.col(metric))
    return leaderboard(leaders, "zone", metric, text, n, pretty_zone(F.col("zone")))


def entity_display(table: DataFrame) -> DataFrame:
    """The entity table as shown: text with separators, percent text, and the number to sort by."""
    percent = F.col("focus_share") * 100
    return table.select(
        F.col("entity").alias("Institution"),
        F.col("zone").alias("Commuting Zone"),
        comma(F.col("mean_total")).alias("Mean Completions (per year)"),
        comma(F.col("mean_focus")).alias("Mean Focus Completions (per year)"),
        percent_text(F.col("focus_share"), 2).alias("Focus%"),
        comma(F.col("mean_enrolled")).alias("Mean Enrollment (per year)"),
        yes_no(F.col("rural")).alias("Rural"),
        yes_no(F.col("tribal")).alias("Tribal"),
        percent.alias("Focus%_num"),
    )


def zone_display(table: DataFrame) -> DataFrame:
    """The zone-year table as shown."""
    return table.select(
        F.col("zone").alias("Commuting Zone"),
        F.col("year").alias("Year"),
        comma(F.col("total")).alias("Total Job Postings"),
        comma(F.col("focus")).alias("Focus Job Postings"),
        comma(F.col("population")).alias("Commuting Zone Population"),
        percent_text(F.col("focus_share"), 2).alias("Focus%"),
        half_even(F.col("per_1000"), 1).alias("Focus Postings per 1,000 Residents"),
        (F.col("focus_share") * 100).alias("Focus%_num"),
    )


def shown_numbers(table: DataFrame, percent: Sequence[str] = ()) -> DataFrame:
    """Numeric columns of any table as text: shares as percent, whole columns with separators, others to two digits.

    Whether a column is whole, or a share that needs scaling, is decided over the whole column. One extra pass answers
    for all columns.
    """
    kinds = ("int", "bigint", "float", "double", "decimal")
    numeric = [name for name, kind in table.dtypes if kind.startswith(kinds)]
    if not numeric:
        return table
    facts = column_facts(table, {c: F.max(c) <= 1 if c in percent else is_whole(F.col(c)) for c in numeric})

    def text(column: str) -> Column:
        value = F.col(column)
        if column in percent:
            return F.concat(plain_number(F.when(facts[column], value * 100).otherwise(value), 2), F.lit("%"))
        return F.when(facts[column], comma(value)).otherwise(plain_number(value.cast("double"), 2))

    return table.withColumns({c: text(c) for c in numeric})


def trend_title(zone: Column) -> Column:
    return F.concat(F.lit("Focus Job Postings — "), pretty_zone(zone))
