"""Table scans. Every reader stays lazy; filters and column choice reach the files through Catalyst."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema: str, multiline: bool = False) -> DataFrame:
    """CSV with a header, `NA` and the empty field as null, columns as declared, quotes doubled inside quotes.

    `multiline`: fields may hold line breaks; each file is then read by one task.
    """
    reader = spark.read.schema(schema).option("header", True).option("nullValue", "NA").option("escape", '"')
    return reader.option("multiLine", multiline).csv(path)


def read_parquet(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, schema: str | None = None
) -> DataFrame:
    """Parquet scan. With a schema no file is opened before the query runs."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    df = reader.parquet(path)
    return df.select(*columns) if columns else df


def read_partitions(spark: SparkSession, path: str, **values: object) -> DataFrame:
    """A directory written by partition; each `column=value` filter prunes directories."""
    df = spark.read.parquet(path)
    for column, value in values.items():
        df = df.where(F.col(column) == F.lit(value))
    return df


def path_exists(spark: SparkSession, path: str) -> bool:
    """Is there anything under this path, in whatever file system it names?"""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def named_table(df: DataFrame, name: str) -> DataFrame:
    """Register `df` under a name and return the handle to it."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def read_or_build(read: Callable[[], DataFrame], build: Callable[[], DataFrame]) -> DataFrame:
    """A table prepared earlier if it is there, else the same table computed now."""
    try:
        return read()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return build()


def resolve_column(df: DataFrame, candidates: Sequence[str]) -> str | None:
    """First candidate the table has, whatever its case; the table's own spelling is returned."""
    present = {name.lower(): name for name in reversed(df.columns)}
    return next((present[c.lower()] for c in candidates if c.lower() in present), None)


def _start_of(year: int) -> Column:
    return F.lit(f"{year:04d}-01-01").cast("timestamp_ntz")


def in_year(moment: Column, year: int) -> Column:
    """Is the moment in this year? Written as a range so that it can be pushed into the scan."""
    return (moment >= _start_of(year)) & (moment < _start_of(year + 1))


def before_year(moment: Column, year: int) -> Column:
    return moment < _start_of(year)


def outside_year(moment: Column, year: int) -> Column:
    return (moment < _start_of(year)) | (moment >= _start_of(year + 1))


def year_choice(choice: str | int | None, column: str = "year", everything: str = "All Years") -> Column:
    """Predicate for a year picked by the user: no filter for all years, nothing for bad input."""
    if choice is None or choice == everything:
        return F.lit(True)
    try:
        return F.col(column) == F.lit(int(choice))
    except ValueError:
        return F.lit(False)
