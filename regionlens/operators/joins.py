"""Equi-joins. Which side is broadcast is left to Spark's own size check, at planning and at run time.

The check at planning goes by the size of files, where a table may take a thirtieth of its memory. A side that grows with the
input is marked by `sorted_side`.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep_matches(left: DataFrame, right: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return left.join(right, on, "inner")


def look_up(left: DataFrame, right: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Every left row, with nulls where the right side has no match."""
    return left.join(right, on, "left")


def sorted_side(right: DataFrame) -> DataFrame:
    """The right side of a join, a table that grows with the input: never broadcast, however small its files are."""
    return right.hint("merge")


def look_up_common(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on all columns both tables have."""
    common = [c for c in left.columns if c in right.columns]
    if not common:
        raise ValueError("the tables share no column")
    return left.join(right, common, "left")


def look_up_renamed(left: DataFrame, right: DataFrame, keys: Mapping[str, str], suffix: str = "_right") -> DataFrame:
    """Left join on differently named keys. Right columns that clash get a suffix; its keys are dropped."""
    renamed = right.withColumnsRenamed(
        {c: f"{c}{suffix}" for c in right.columns if c in left.columns and c not in keys.values()}
    )
    hidden = {key: f"_right_{key}" for key in keys.values()}
    renamed = renamed.withColumnsRenamed(hidden)
    condition = None
    for mine, theirs in keys.items():
        same = F.col(mine) == F.col(hidden[theirs])
        condition = same if condition is None else condition & same
    return left.join(renamed, condition, "left").drop(*hidden.values())


def rows_of_latest(df: DataFrame, unit: str | Sequence[str], when: str, known: DataFrame | None = None, only: object = None) -> DataFrame:
    """Rows at the largest `when` of their unit, of all units or of `only` one.

    `known`: a small table with the units and their `when`s, by default `df` itself. The smallest of the maxima is
    a scalar that Spark has before it opens `df`, so that of a table stored by `when` only the folders from there
    on are read; of a single unit, only its last one.
    """
    units = [unit] if isinstance(unit, str) else list(unit)
    seen = df if known is None else known
    if only is not None:
        seen, df = seen.where(F.col(units[0]) == F.lit(only)), df.where(F.col(units[0]) == F.lit(only))
        if len(units) == 1:
            return df.where(F.col(when) == seen.select(F.max(when)).scalar())
    latest = seen.groupBy(*units).agg(F.max(when).alias(when))
    return df.where(F.col(when) >= latest.select(F.min(when)).scalar()).join(latest, [*units, when])


def stack_extracts(extracts: Mapping[object, DataFrame], tag: str) -> DataFrame:
    """Rows of same-schema extracts under each other, each marked with its tag."""
    stacked: DataFrame | None = None
    for value, frame in extracts.items():
        tagged = frame.withColumn(tag, F.lit(value))
        stacked = tagged if stacked is None else stacked.unionByName(tagged)
    if stacked is None:
        raise ValueError("no extract to stack")
    return stacked
