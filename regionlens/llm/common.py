"""Tables, the shared scratch folder, code on the executors, and connected components."""

from __future__ import annotations

import ctypes
import io
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regionlens.llm.words import forget
from regionlens.session import materialize

SHIPPED: set[str] = set()
#: Text bytes that a task handles at a time, whatever the size of the batches it gets.
SLICE_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers, once per application, so that they import it like the driver does."""
    context = spark.sparkContext
    if context.applicationId in SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, path.relative_to(root.parent))
    folder = tempfile.mkdtemp(prefix="regionlens-code-")
    target = Path(folder) / "regionlens.zip"
    target.write_bytes(packed.getvalue())
    context.addPyFile(str(target))
    SHIPPED.add(context.applicationId)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written(df: DataFrame, label: str, result: bool = False) -> DataFrame:
    """`df` written once to the folder of `spark.checkpoint.dir` and read back: its lineage is cut, a lost executor costs nothing."""
    return materialize(df, f"llm-{label}", result=result)


def give_back() -> None:
    """Return freed memory to the system, and what is kept for speed. Workers are reused, and all that an earlier stage left still counts as theirs."""
    forget()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
    if trim is not None:
        trim(0)


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that `df` doesn't have in any spelling: `wanted` with as many underscores behind as it takes."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about `limit` text bytes (one row at least), so that long texts don't add up in memory."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        start, size = 0, 0
        for i, n in enumerate(lengths):
            if i > start and size + n > limit:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if start < len(lengths):
            yield batch.slice(start)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (u, v): the smallest node that links lead to.

    Large-star and small-star rounds over written tables until only stars are left. A node with very many
    links is reduced by a partial minimum; its links stay spread over the tasks of the join.
    """
    edges = written(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    if edges.isEmpty():
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m"))
        edges = written(small.distinct(), "small-star")
        again = edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").select("u")
        again = again.union(edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u"))
        if again.isEmpty():
            break  # every node has one link, to a node that has none: all links are stars
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
