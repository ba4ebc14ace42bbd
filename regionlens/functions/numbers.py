"""Null-aware arithmetic and aggregate expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column, scale: float = 1.0) -> Column:
    """`numerator / denominator * scale`, null unless the denominator is positive."""
    quotient = numerator.cast("double") / denominator.cast("double")
    return F.when(denominator > 0, quotient if scale == 1.0 else quotient * F.lit(float(scale)))


def ratio_or_zero(numerator: Column, denominator: Column) -> Column:
    """A share that is 0 for a known non-positive denominator and null for an unknown one."""
    quotient = numerator.cast("double") / denominator.cast("double")
    return F.when(denominator > 0, quotient).when(denominator.isNotNull(), F.lit(0.0))


def sum_or_zero(value: Column) -> Column:
    """Sum that ignores nulls and is 0 when there is nothing to add."""
    return F.coalesce(F.sum(value), F.lit(0))


def flagged(value: Column, flag: Column) -> Column:
    """`value` where the 0/1 flag is 1, else 0. An unknown flag counts as not flagged."""
    return F.when(flag == 1, value).otherwise(F.lit(0))


def flagged_sum(value: Column, flag: Column) -> Column:
    return sum_or_zero(F.when(flag == 1, value))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Mean of `value` over rows that each stand for `weight` rows; nulls do not count."""
    rows = F.sum(F.when(value.isNotNull(), weight))
    return F.when(rows > 0, F.sum(value * weight).cast("double") / rows)


def count_values(value: Column) -> Column:
    """Distinct values, an unknown one included."""
    unknown = F.coalesce(F.max(value.isNull().cast("int")), F.lit(0))
    return F.count_distinct(value) + unknown


def first_by(value: Column, key: Column) -> Column:
    """Value of the row with the smallest key. The key has to be unique for a stable answer."""
    return F.min_by(value, key)


def first_known_by(value: Column, key: Column) -> Column:
    """First non-null value in key order; rows whose ordering is null are skipped."""
    return F.min_by(value, F.when(value.isNotNull(), key))


def to_int(value: Column) -> Column:
    """Integer from text such as `01001` or `12.0`; null where there is none."""
    return F.coalesce(value.try_cast("int"), value.try_cast("double").try_cast("int"))


def to_long(value: Column) -> Column:
    return F.coalesce(value.try_cast("bigint"), value.try_cast("double").try_cast("bigint"))


def half_even(value: Column, digits: int = 0) -> Column:
    """Nearest number with so many digits; a tie goes to the even one. What is a tie is decided on the value times 10^digits.

    `bround` goes by the shortest decimal text of a double instead: 1.6500000000000001, which is 16.5 tenths, gives 1.7 there.
    """
    if digits == 0:
        return F.bround(value, 0)
    scale = F.lit(float(10**digits))
    return F.rint(value * scale) / scale + F.lit(0.0)


def is_whole(value: Column) -> Column:
    """Aggregate: do all known values equal their floor?"""
    return F.bool_and(value == F.floor(value))
