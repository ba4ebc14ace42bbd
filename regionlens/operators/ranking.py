"""Ranks, leaderboards, shares and pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from regionlens.functions.text import caption
from regionlens.session import materialize


def descending(column: str) -> Column:
    """Largest first, unknown last."""
    return F.col(column).desc_nulls_last()


def ascending(column: str) -> Column:
    """Smallest first, unknown last."""
    return F.col(column).asc_nulls_last()


# Offsets, of about 50 bytes, that are sent to every task; more of them meet the rows through an exchange.
BROADCAST_OFFSETS = 200_000


def ordinal(
    df: DataFrame, order: Sequence[Column], by: Sequence[str] = (), name: str = "ordinal", size: str | None = None
) -> DataFrame:
    """Number the rows 1..n inside each `by` group, under a total order, for groups of any size.

    A plain `row_number` puts a whole group into one task. Here the rows are range-partitioned and
    sorted by group and order, so a large group spans many slices, and every row gets its place in
    its slice. The slices are written once, as places and offsets have to see the same boundaries;
    calling this runs that job. What is joined back is one row per slice and group in it: where that slice
    starts and where the group starts. `size` names a column for the number of rows in the group.
    """
    place = F.monotonically_increasing_id()
    keys = [*[F.col(c) for c in by], *order]
    # The id holds the slice above bit 33 and the place in the slice below. A struct key lets a null
    # group match itself.
    group, slice_of, inside = F.struct(F.lit(0).alias("_"), *by), F.shiftright("_place", 33), F.col("_place").bitwiseAND(F.lit(2**33 - 1))
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_place", place)
    seen = Observation()
    counted = [F.approx_count_distinct(group).alias("groups"), F.max(slice_of).alias("slices")]
    sliced = materialize(ranged.observe(seen, *counted), "ordinal")
    parts = sliced.groupBy(group.alias("_group"), slice_of.alias("_slice")).agg(
        F.count(F.lit(1)).alias("_rows"), F.min(inside).alias("_from")
    )
    slices = parts.groupBy("_slice").agg(F.sum("_rows").alias("_slice_rows"))
    # One row per slice: as many as the exchange has partitions.
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = slices.select("_slice", F.coalesce(F.sum("_slice_rows").over(before), F.lit(0)).alias("_start"))
    placed = parts.join(F.broadcast(starts), "_slice")
    whole = Window.partitionBy("_group")
    offsets = placed.select(
        "_group",
        "_slice",
        (F.col("_start") - F.min(F.col("_start") + F.col("_from")).over(whole) + 1).alias("_shift"),
        F.sum("_rows").over(whole).alias("_size"),
    )
    # A slice begins at most one group that another one has begun, so there are at most as many offsets as both
    # together. The write has counted them; the sketch is off by a twentieth.
    if not by or 1.5 * seen.get["groups"] + (seen.get["slices"] or 0) < BROADCAST_OFFSETS:
        offsets = F.broadcast(offsets)
    numbered = sliced.withColumns({"_group": group, "_slice": slice_of}).join(offsets, ["_group", "_slice"])
    extra = [F.col("_size").alias(size)] if size else []
    return numbered.select(*df.columns, (inside + F.col("_shift")).alias(name), *extra)


def rank_in_domain(df: DataFrame, order: Sequence[Column], by: Sequence[str], name: str) -> DataFrame:
    """Rank within groups whose size is bounded by a code table, so that one task can hold a group."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


# Rows that one task may hold and number; longer lists are numbered in parallel.
LISTED = 10_000


def top_rows(df: DataFrame, order: Sequence[Column], n: int | None, name: str = "rank") -> DataFrame:
    """The first `n` rows in order with their rank, a `bigint`; all rows for `n=None`.

    For a short list Spark keeps the best of every partition and merges those; its rows are
    numbered in one task. A longer one is cut from all rows, which are numbered in parallel.
    """
    if n is None:
        return ordinal(df, order, name=name)
    if n > LISTED:
        return ordinal(df, order, name=name).where(F.col(name) <= n)
    return df.orderBy(*order).limit(n).withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))


def page(df: DataFrame, order: Sequence[Column], number: int, size: int = 10, name: str = "row") -> DataFrame:
    """Page `number` (from 1) of a sorted table, with row numbers. To turn many pages store the order: `operators/paging.py`."""
    first, last = (number - 1) * size + 1, number * size
    return top_rows(df, order, last, name).where(F.col(name) >= first)


def group_total(df: DataFrame, value: str, by: Sequence[str], name: str) -> DataFrame:
    """Total of the row's group. `df` is aggregated, so a group holds at most a code table's rows."""
    return df.withColumn(name, F.sum(value).over(Window.partitionBy(*by)))


def share_of_group(df: DataFrame, value: str, by: Sequence[str], name: str = "share") -> DataFrame:
    """Part of the group total each row holds; null where the total is not positive."""
    total = F.sum(value).over(Window.partitionBy(*by))
    return df.withColumn("_total", total).withColumn(
        name, F.when(F.col("_total") > 0, F.col(value) / F.col("_total"))
    ).drop("_total")


def rank_groups_and_items(
    df: DataFrame, group: str, item: str, value: str, by: Sequence[str] = ()
) -> DataFrame:
    """Order groups by total and items inside a group by their largest single value, both descending.

    `df` is aggregated: inside a `by` key it holds a row per combination of codes. It is partitioned
    once by that key, which serves all four windows.
    """
    inside = Window.partitionBy(*by, group)
    ranked = df.repartition(*by) if by else df
    ranked = ranked.withColumns(
        {
            "group_total": F.sum(value).over(inside),
            "_largest": F.max(value).over(Window.partitionBy(*by, group, item)),
        }
    )
    return ranked.withColumns(
        {
            "group_rank": F.dense_rank().over(Window.partitionBy(*by).orderBy(descending("group_total"), ascending(group))),
            "item_rank": F.dense_rank().over(inside.orderBy(descending("_largest"), ascending(item))),
        }
    ).drop("_largest")


def _attach(df: DataFrame, small: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join on keys that may be null on both sides."""
    other = small.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return df.join(other, same).drop(*[f"_right_{k}" for k in keys])


def order_groups_and_items(
    df: DataFrame, group: str, item: str, by: Sequence[str] = (), names: tuple[str, str] = ("group_total", "item_total")
) -> DataFrame:
    """Place of a row's group among the groups that `df` shows and of its item in the group, larger totals first, ties by name.

    `df` has the totals, which may come from more rows than it shows. Ranked are one row per group and one per
    item, both bounded by code tables; the places are joined back.
    """
    ranks = [(list(by), group, names[0], "group_rank"), ([*by, group], item, names[1], "item_rank")]
    out = df
    for inside, column, total, name in ranks:
        shown = df.select(*inside, column, total).distinct()
        order = Window.partitionBy(*inside).orderBy(descending(total), ascending(column))
        out = _attach(out, shown.withColumn(name, F.dense_rank().over(order)).drop(total), [*inside, column])
    return out


# A sketch knows a value's place among n to n / SKETCH; the median is looked for between places on both sides of it.
SKETCH = 10_000


def mean_and_median(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean and exact median of the known values of each key, `mean_value` and `median_value`.

    Two counting passes instead of a buffer of all values of a key: a sketch of bounded size gives two values with
    the median between them, then values outside are counted as two sums and values inside one by one, each
    once however often it occurs. A task sees a thousandth of a key's values. Pass a written table, as it is read twice.
    """
    margin = 4 / SKETCH
    near = F.percentile_approx(F.col(value).cast("double"), [0.5 - margin, 0.5 + margin], SKETCH)
    bounds = df.groupBy(*keys).agg(F.avg(value).alias("mean_value"), near.alias("_near"))
    placed = _attach(df, bounds, keys)
    v, low, high = F.col(value).cast("double"), F.col("_near")[0], F.col("_near")[1]
    side = F.when(v.isNull(), 2).when(v < low, -1).when(v <= high, 0).otherwise(1)
    counts = placed.select(*keys, "mean_value", side.alias("_side"), F.when(side == 0, v).alias("_v"))
    counts = counts.groupBy(*keys, "mean_value", "_side", "_v").agg(F.count(F.lit(1)).alias("_n"))
    inside = Window.partitionBy(*keys)
    upto = F.sum("_n").over(inside.orderBy("_side", "_v").rowsBetween(Window.unboundedPreceding, 0))
    counts = counts.withColumns({"_upto": upto, "_all": F.sum(F.when(F.col("_side") < 2, F.col("_n"))).over(inside)})

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("_side") == 0) & (F.col("_upto") >= place) & (F.col("_upto") - F.col("_n") < place), F.col("_v")))

    middle = (at(F.expr("(_all + 1) div 2")) + at(F.expr("(_all + 2) div 2"))) / 2
    return counts.groupBy(*keys).agg(F.max("mean_value").alias("mean_value"), middle.alias("median_value"))


def order_by_summary(df: DataFrame, item: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Place of each item when sorted by the mean and by the median of its values, ascending. Pass a written table."""
    summary = mean_and_median(df, [*by, item], value)
    summary = rank_in_domain(summary, [ascending("mean_value"), ascending(item)], by, "mean_order")
    return rank_in_domain(summary, [ascending("median_value"), ascending(item)], by, "median_order")


def top_rows_per_group(
    df: DataFrame, order: Sequence[Column], by: Sequence[str], n: int | None, name: str = "rank"
) -> DataFrame:
    """First `n` rows of every group of an aggregated table; all rows for `n=None`."""
    ranked = rank_in_domain(df, order, by, name)
    return ranked if n is None else ranked.where(F.col(name) <= n)


def top_items_per_group(
    df: DataFrame, order: Sequence[Column], by: Sequence[str], n: int | None, name: str = "rank"
) -> DataFrame:
    """All rows of the first `n` items of every group, where `order` ties only within an item."""
    ranked = df.withColumn(name, F.dense_rank().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked if n is None else ranked.where(F.col(name) <= n)


def leaderboard(
    df: DataFrame, name: str, metric: str, text: Column, n: int | None = 150, label: Column | None = None
) -> DataFrame:
    """Top `n` by a metric, ties by name, each with the caption `label — value`.

    The order uses the metric to nine digits, so that two equal means do not swap places because
    their parts were added in another order.
    """
    shown = F.col(name) if label is None else label
    order = [F.round(metric, 9).desc_nulls_last(), ascending(name)]
    ranked = top_rows(df.select(name, metric), order, n)
    return ranked.withColumn("caption", caption(shown, text))
