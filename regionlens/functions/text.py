"""Cleaning and display text. Text built from a null part is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from regionlens.functions.numbers import half_even


def strip_space(value: Column) -> Column:
    """Remove every kind of whitespace at both ends."""
    return F.regexp_replace(value, r"^\s+|\s+$", "")


def drop_suffix(value: Column, suffix: str) -> Column:
    return F.when(value.endswith(suffix), value.substr(F.lit(1), F.length(value) - F.lit(len(suffix)))).otherwise(value)


def pretty_zone(value: Column) -> Column:
    """Zone name without a leading number and a trailing ` CZ`."""
    return F.regexp_replace(F.regexp_replace(value, r" CZ$", ""), r"^\d+ ", "")


# The words the county-list labels start with.
COUNTY_PREFIXES = ("Counties: ", "County: ")


def strip_county_prefix(value: Column) -> Column:
    """Label for display; the raw label stays the lookup key."""
    for prefix in COUNTY_PREFIXES:
        value = F.replace(value, F.lit(prefix), F.lit(""))
    return value


def comma(value: Column) -> Column:
    """Whole number with thousands separators, ties to even."""
    return F.format_number(F.bround(value, 0), 0)


def comma_tenths(value: Column) -> Column:
    """One decimal with thousands separators."""
    return F.format_number(value, 1)


def plain_number(value: Column, digits: int) -> Column:
    """Rounded number without trailing zeros and without an exponent."""
    text = F.when(value.isNotNull(), F.format_string(f"%.{digits}f", half_even(value, digits)))
    return F.regexp_replace(text, r"\.?0+$", "") if digits > 0 else text


def percent_text(share: Column, digits: int = 1) -> Column:
    """`0.125` as `12.5%`, trailing zeros dropped. Null in, null out."""
    return F.concat(plain_number(share * 100, digits), F.lit("%"))


def percent_fixed(share: Column) -> Column:
    """`0.125` as `12.5%`, always with one decimal; an exact tie goes to the even digit."""
    return F.concat(F.replace(F.format_number(share * 100, 1), F.lit(","), F.lit("")), F.lit("%"))


def caption(name: Column, value: Column) -> Column:
    return F.concat(name, F.lit(" — "), value)


def lines(*fields: tuple[str, Column]) -> Column:
    """Newline-separated `Label: value` text; null if any value is."""
    parts: list[Column] = []
    for position, (label, value) in enumerate(fields):
        parts += [F.lit(f"{'' if position == 0 else chr(10)}{label}: "), value.cast("string")]
    return F.concat(*parts)


def html_popup(title: Column, *fields: tuple[str, Column]) -> Column:
    """`<strong>title</strong><br><strong>Label:</strong> value<br>…`"""
    parts: list[Column] = [F.lit("<strong>"), title, F.lit("</strong>")]
    for label, value in fields:
        parts += [F.lit(f"<br><strong>{label}:</strong> "), value.cast("string")]
    return F.concat(*parts)


def yes_no(flag: Column) -> Column:
    """`Yes` for 1 or more, `No` for less or unknown."""
    return F.when(flag >= 1, F.lit("Yes")).otherwise(F.lit("No"))
