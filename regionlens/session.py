"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, app: str = "regionlens") -> SparkSession:
    """A session for tests and the benchmark. A cluster brings its own settings."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


_LOCAL_FOLDERS: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it in `spark.checkpoint.dir`.

    Only a local master may fall back to a folder of its own, one per application.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if context.applicationId not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="regionlens-")
    return _LOCAL_FOLDERS[context.applicationId]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing has used yet."""
    return f"{scratch_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


# Paths of the passing tables, a list for each open scope.
_PASSING: ContextVar[tuple[list[str], ...]] = ContextVar("passing", default=())
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """What `materialize` writes inside is removed at the end, but for results: these belong to the scope around, if any.

    For steps that end with a written result; nothing lazy that reads the other tables may leave the scope.
    """
    paths: list[str] = []
    token = _PASSING.set((*_PASSING.get(), paths))
    try:
        yield
    finally:
        _PASSING.reset(token)
        for path in paths:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that runs inside go when it ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def materialize(df: DataFrame, label: str, row_group_bytes: int | None = None, result: bool = False) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    The result no longer depends on its lineage, so a lost executor cannot change it, and its
    consumers scan only the columns they need. A writer holds a row group in memory; wide facts name a smaller one.
    `result`: outlives the scope of `passing_tables` it is written in.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    scopes = _PASSING.get()[: -1 if result else None]
    if scopes:
        scopes[-1].append(path)
    writer = df.write if row_group_bytes is None else df.write.option("parquet.block.size", row_group_bytes)
    with shuffles_removed(spark):
        writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stepwise(
    spark: SparkSession, label: str, first: Callable[[], DataFrame], *steps: Callable[[DataFrame], DataFrame], row_group_bytes: int | None = None
) -> DataFrame:
    """What the last step makes, written. Each step takes the table that the one before has written, the first one what `first` gives.

    The table before and the shuffle files of a step go as soon as its own table is there, so the disk holds two tables and the
    shuffles of one step, not those of all joins of a long plan.
    """

    def run(k: int) -> DataFrame:
        with passing_tables(spark):
            before = run(k - 1) if k else first()
            return materialize(steps[k](before), f"{label}-{k}", row_group_bytes, result=True)

    return run(len(steps) - 1)
