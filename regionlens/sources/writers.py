"""Sinks. All of them write in parallel; a hot partition value is spread over several files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regionlens.functions.numbers import half_even
from regionlens.operators.ranking import ascending, ordinal


def write_parquet(df: DataFrame, path: str, compression: str = "gzip") -> None:
    df.write.option("compression", compression).parquet(path)


def write_partitions(
    df: DataFrame, path: str, *keys: str, sort: Sequence[str] = (), find: Sequence[str] = (),
    row_group_bytes: int = 32 << 20, distinct: int = 100_000,
) -> None:
    """Directory per key value. `rebalance` sizes the files: small values share a task and a value
    that holds much of the table is split over several.

    Rows are sorted, so the statistics of row groups skip by `sort` columns. A scan for one value of a `find` column
    skips row groups by their bloom filters, whatever the order; `distinct` is how many values a row group may hold.
    """
    spread = df.hint("rebalance", *keys)
    if sort:
        spread = spread.sortWithinPartitions(*keys, *sort)
    writer = spread.write.option("parquet.block.size", row_group_bytes).partitionBy(*keys)
    for column in find:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true").option(f"parquet.bloom.filter.expected.ndv#{column}", distinct)
    writer.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; null is written as `NA`, a quote inside a field is doubled."""
    df.write.option("header", True).option("nullValue", "NA").option("escape", '"').csv(path)


def display_table(df: DataFrame, names: Mapping[str, str], percent: Sequence[str] = ()) -> DataFrame:
    """Columns in display order under their readable names; shares as percent with two digits."""
    columns = [
        (half_even(F.col(source) * 100, 2) if source in percent else F.col(source)).alias(target)
        for source, target in names.items()
    ]
    return df.select(*columns)


def readable_names(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename the columns that are present, matched without regard to case."""
    wanted = {source.lower(): target for source, target in names.items()}
    return df.withColumnsRenamed({c: wanted[c.lower()] for c in df.columns if c.lower() in wanted})


def column_first(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    rest = [c for c in df.columns if c != column]
    return df.select(F.col(column).alias(name or column), *rest)


def export_csv(df: DataFrame, folder: str, day: date | None = None) -> str:
    """CSV export below a folder named after its day. Returns the path."""
    path = f"{folder.rstrip('/')}/date={(day or date.today()).isoformat()}"
    write_csv(df, path)
    return path


def point_geometry(longitude: Column, latitude: Column) -> Column:
    """GeoJSON text of a point."""
    return F.to_json(F.struct(F.lit("Point").alias("type"), F.array(longitude, latitude).alias("coordinates")))


def feature(geometry: Column, properties: Sequence[str]) -> Column:
    """GeoJSON text of one feature. `geometry` is already GeoJSON text and is carried unchanged; an unknown one is `null`."""
    fields = F.to_json(F.struct(*properties), {"ignoreNullFields": "false"})
    return F.concat(
        F.lit('{"type":"Feature","geometry":'), F.coalesce(geometry, F.lit("null")), F.lit(',"properties":'), fields, F.lit("}")
    )


def write_features_by_year(
    df: DataFrame, path: str, geometry: Column, properties: Sequence[str], order: Sequence[str], year: str = "year"
) -> None:
    """One FeatureCollection per year, written in parallel.

    Features are numbered inside the year, and only the first and the last line of a year carry the
    brackets of the collection. The part files of a year, read in name order, are one valid document
    however many there are.
    """
    numbered = ordinal(df, by=[year], order=[ascending(c) for c in order], name="id", size="_last")
    line = F.concat(
        F.when(F.col("id") == 1, F.lit('{"type":"FeatureCollection","features":[')).otherwise(F.lit("")),
        feature(geometry, ["id", *properties]),
        F.when(F.col("id") == F.col("_last"), F.lit("]}")).otherwise(F.lit(",")),
    )
    rows = numbered.select(F.col(year).alias("file_year"), "id", line.alias("value"))
    spread = rows.repartitionByRange("file_year", "id").sortWithinPartitions("file_year", "id")
    spread.select("value", "file_year").write.partitionBy("file_year").text(path)


def read_features(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Features written by year, parsed back: `file_year`, the raw geometry and the properties."""
    text = spark.read.text(path)
    opened = F.regexp_replace("value", r'^\{"type":"FeatureCollection","features":\[', "")
    bare = F.regexp_replace(opened, r"(,|\]\})$", "")
    parsed = text.select("file_year", bare.alias("_text"))
    return parsed.select(
        "file_year",
        F.get_json_object("_text", "$.geometry").alias("geometry"),
        F.from_json(F.get_json_object("_text", "$.properties"), schema).alias("properties"),
    )

