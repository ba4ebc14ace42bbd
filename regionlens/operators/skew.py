"""Lookups for facts in which a few keys may hold much of the table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is hot when it holds more than this part of all rows, so there are fewer than 1 / HOT_SHARE.
HOT_SHARE = 0.001
SPREAD = 64
# Rows that a task takes of a table that is dealt out by their number.
TASK_ROWS = 500_000


def dealt_out(df: DataFrame, *keys: str, rows: int = TASK_ROWS) -> DataFrame:
    """The rows dealt out by `keys`, about `rows` to a task, whatever their bytes; counts `df`, a job that reads no columns of plain files.

    For keys that hardly repeat: a sum by them then needs no other shuffle and holds `rows` groups at most, and no row of
    theirs is summed in front of it in vain.
    """
    tasks = -(-df.count() // rows)
    return df.repartition(max(1, tasks), *keys)


def hot_keys(counts: DataFrame, key: str, rows: str, share: float = HOT_SHARE) -> DataFrame:
    """Keys with more than `share` of all rows, from a table with one count per key.

    At most `1 / share` keys can qualify, which bounds what is broadcast below.
    """
    total = counts.select(F.sum(rows)).scalar()
    return counts.where(F.col(key).isNotNull() & (F.col(rows) > total * share)).select(key)


def look_up_spread(
    fact: DataFrame, side: DataFrame, key: str, hot: DataFrame, spread_by: Sequence[str], spread: int = SPREAD
) -> DataFrame:
    """Left join of a fact to a table that is unique per key, with the hot keys split.

    Rows of a hot key get one of `spread` salts from a hash of `spread_by`, and the one row the side
    has for that key is repeated per salt. All other rows keep salt 0. The result is that of the plain
    join. Runtime skew handling only sees joins whose two inputs are plain shuffles; this form also
    covers a side that is itself an aggregate.
    """
    marks = F.broadcast(hot.select(F.col(key).alias("_hot")))
    is_hot = F.col("_hot").isNotNull()
    salt = F.when(is_hot, F.pmod(F.xxhash64(*spread_by), F.lit(spread)).cast("int")).otherwise(0)
    salted = fact.join(marks, F.col(key) == F.col("_hot"), "left").withColumn("_salt", salt).drop("_hot")
    last = F.when(is_hot, F.lit(spread - 1)).otherwise(0)
    copies = (
        side.join(marks, F.col(key) == F.col("_hot"), "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), last)))
        .drop("_hot")
    )
    return salted.join(copies, [key, "_salt"], "left").drop("_salt")
