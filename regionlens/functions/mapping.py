"""Map classes: step bins, circle radius, share classes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Class breaks, colours and titles per map metric.
STEP_BREAKS = {
    "focus": [1000, 5000, 20000, 50000],
    "percent": [14, 17, 20, 25],
    "per_1000": [30, 50, 80, 120],
}
STEP_COLOURS = {
    "focus": ["#edf8fb", "#b2e2e2", "#66c2a4", "#2ca25f", "#006d2c"],
    "percent": ["#f7fcf5", "#c7e9c0", "#74c476", "#238b45", "#00441b"],
    "per_1000": ["#fff5eb", "#fdd0a2", "#f16913", "#d94801", "#8c2d04"],
}

# The four share classes of the point legend.
SHARE_BREAKS = [0.25, 0.5, 0.75]
SHARE_CLASSES = ["Low < 25%", "25% – 50%", "50% – 75%", "≥ 75%"]

# Circle radius at share 0 and at share 1.
RADIUS_RANGE = (2.0, 10.0)


def step_bin(value: Column, breaks: Sequence[float]) -> Column:
    """Number of breaks at or below the value; null stays null."""
    hits = [F.when(value >= F.lit(b), 1).otherwise(0) for b in breaks]
    total = hits[0]
    for hit in hits[1:]:
        total = total + hit
    return F.when(value.isNotNull(), total)


def pick(index: Column, choices: Sequence[str]) -> Column:
    """The choice with this zero-based index; null for a null index."""
    chosen = F.when(index == 0, F.lit(choices[0]))
    for position, choice in enumerate(choices[1:], start=1):
        chosen = chosen.when(index == position, F.lit(choice))
    return chosen


def _number(value: float) -> str:
    return f"{value:,.0f}" if float(value).is_integer() else f"{value:,}"


def step_labels(breaks: Sequence[float], percent: bool = False) -> list[str]:
    """Legend text of every bin: below the first break, between breaks, from the last on."""
    text = [_number(b) + ("%" if percent else "") for b in breaks]
    middle = [f"{low} – {high}" for low, high in zip(text, text[1:])]
    return [f"< {text[0]}", *middle, f"≥ {text[-1]}"]


def radius(share: Column, low: float = RADIUS_RANGE[0], high: float = RADIUS_RANGE[1]) -> Column:
    """Linear from `low` at 0 to `high` at 1, clamped outside; null stays null."""
    clamped = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))
    return F.when(share.isNotNull(), F.lit(low) + F.lit(high - low) * clamped)


def share_class(share: Column) -> Column:
    return pick(step_bin(share, SHARE_BREAKS), SHARE_CLASSES)
