"""Pages of a table that is stored in its sort order, so that a page far down costs what the first one does."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from regionlens.operators.ranking import ordinal

# Rows of a stored slice.
SLICE_ROWS = 1_000_000
# Slices of a table, whatever its size: a folder and a file each take time to make and to list.
SLICES = 1_000


@dataclass(frozen=True)
class SortedTable:
    """Rows 1..n in order below `path`, a folder per `slice_rows` of them; the row number is column `row`."""

    spark: SparkSession
    path: str
    schema: str
    slice_rows: int
    row: str

    def rows(self, first: int, last: int) -> DataFrame:
        """Rows `first` to `last`. Which slices hold them follows from the numbers, so no other folder is opened."""
        stored = self.spark.read.schema(f"{self.schema}, _slice bigint").parquet(self.path)
        slices = F.col("_slice").between((first - 1) // self.slice_rows, (last - 1) // self.slice_rows)
        return stored.where(slices & F.col(self.row).between(first, last)).drop("_slice")

    def page(self, number: int, size: int = 10) -> DataFrame:
        """Page `number`, from 1; without rows behind the last one."""
        return self.rows((number - 1) * size + 1, number * size)


def store_in_order(df: DataFrame, order: Sequence[Column], path: str, slice_rows: int = SLICE_ROWS, row: str = "row", slices: int = SLICES) -> SortedTable:
    """Number all rows under a total order, in parallel, and write them in slices of equal size.

    A slice has `slice_rows` rows, or more where these would make more than `slices` of them.

    The rows are exchanged once, by range. A task writes the slices its range lies in, sorted, so a slice
    has as few files as ranges it spans, and their statistics skip to a page inside it.
    """
    if {row, "_slice", "_size"} & set(df.columns):
        raise ValueError(f"the table has a column {row}, _slice or _size already")
    numbered = ordinal(df, order, name=row, size="_size")
    in_slice = F.greatest(F.lit(slice_rows), F.ceil(F.col("_size") / slices))
    sliced = numbered.withColumn("_slice", F.floor((F.col(row) - 1) / in_slice).cast("long")).drop("_size")
    written = Observation()
    counted = sliced.observe(written, F.count(F.lit(1)).alias("rows"))
    counted.sortWithinPartitions("_slice", row).write.partitionBy("_slice").parquet(path)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.drop("_size").schema)
    return SortedTable(df.sparkSession, path, schema, max(slice_rows, -(-written.get["rows"] // slices)), row)
