"""Sharding on a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only.

Every shard owns `vnodes` points of a ring of `CELLS` equal cells; a key belongs to the first point clockwise of the
cell that its hash falls into. Loads are bounded: of n rows a shard takes n / shards, rounded up for the first
n mod shards of them and down for the others. Rows beyond that continue clockwise to the next shard with room, so
the counts are at most one apart, whatever the data, and only overflowing rows are away from the shard of their key.

Decisions are made on counts per cell (`CELLS` numbers at most, a fixed parameter and no matter of the data): a first
pass fills every shard with its own cells in ring order; a second one walks the overflow clockwise. Rows then find
their shard by their place in the cell. No row is compared with another outside its own cell's sub-range.

Law: `rows`. Equal texts need not share a shard. Null texts have no bytes (size 16, crc32 of nothing). Rows with a
null doc_id form a key of their own; repeated rows count each. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regionlens.llm.common import written

#: Equal cells of the ring; all points lie on cell borders.
CELLS = 4096
#: Rows wanted in a sub-range of a cell, within which places are numbered.
RUN = 20_000


def key_hash(key: Column) -> Column:
    """60 bits of the md5 of a key as text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null")).cast("binary")), 1, 15), 16, 10).cast("long")


def ring(spark, shards: int, vnodes: int) -> DataFrame:
    """(cell, owners): for every cell all shards in the order in which their points come clockwise."""
    points = (
        spark.range(shards * vnodes)
        .select((F.col("id") % shards).cast("int").alias("shard"), F.floor(F.col("id") / shards).alias("copy"))
        .select("shard", (key_hash(F.concat_ws("#", F.col("shard"), F.col("copy"))) % CELLS).cast("int").alias("at"))
    )
    # a shard's distance from a cell: cells to the nearest of its points, going clockwise
    cells = F.explode(F.sequence(F.lit(0), F.lit(CELLS - 1))).alias("cell")
    nearest = points.groupBy("shard").agg(F.sort_array(F.collect_set("at")).alias("at")).select("shard", "at", cells)
    away = F.coalesce(F.array_min(F.filter("at", lambda a: a >= F.col("cell"))), F.col("at")[0] + CELLS) - F.col("cell")
    order = F.sort_array(F.collect_list(F.struct(away.alias("away"), F.xxhash64("cell", "shard").alias("tie"), "shard")))
    return nearest.groupBy("cell").agg(order.alias("o")).select("cell", F.col("o.shard").alias("owners"))


def allot(counts: DataFrame, owners: DataFrame, shards: int) -> DataFrame:
    """(cell, shard, start, stop): which places of a cell go to which shard.

    `counts` has (cell, n). Works on one row per cell and folds the overflow clockwise, cell after cell.
    """
    cells = counts.join(owners, "cell").select("cell", F.col("n").cast("long"), "owners")
    total = counts.agg(F.sum("n")).first()[0] or 0
    room = F.lit(total // shards) + F.when(F.col("owner") < total % shards, 1).otherwise(0)
    before = Window.partitionBy("owner").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    own = (
        cells.withColumn("owner", F.col("owners")[0])
        .withColumn("room", room.cast("long"))
        .withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")))
        .withColumn("kept", F.greatest(F.lit(0).cast("long"), F.least("n", F.col("room") - F.col("ahead"))))
    )
    # one row: the rooms left by shard, and the cells that overflow in ring order
    taken = own.groupBy("owner").agg(F.sum("kept").alias("kept"))
    left = (
        counts.sparkSession.range(shards)
        .select(F.col("id").cast("int").alias("owner"))
        .join(F.broadcast(taken), "owner", "left")  # one row a shard
        .groupBy()
        .agg(F.sort_array(F.collect_list(F.struct("owner", (room - F.coalesce("kept", F.lit(0))).cast("long").alias("left")))).alias("l"))
        .select(F.lit(1).alias("one"), F.col("l.left").alias("left"))
    )
    over = own.where("kept < n").groupBy().agg(F.sort_array(F.collect_list(F.struct("cell", "kept", (F.col("n") - F.col("kept")).alias("more"), "owners"))).alias("cells"), F.lit(1).alias("one"))
    part = "struct<cell:int,shard:int,start:bigint,stop:bigint>"
    # state: rooms left, pieces so far. For one cell: walk its owners, at each take what fits.
    walk = f"""
        aggregate(cells, named_struct('left', left, 'parts', cast(array() as array<{part}>)), (s, c) ->
          aggregate(c.owners, named_struct('left', s.left, 'parts', s.parts, 'at', c.kept, 'more', c.more), (w, o) ->
            if(w.more = 0 or w.left[o] = 0, w, named_struct(
              'left', transform(w.left, (x, i) -> if(i = o, x - least(x, w.more), x)),
              'parts', concat(w.parts, array(cast(named_struct('cell', c.cell, 'shard', o, 'start', w.at, 'stop', w.at + least(w.left[o], w.more)) as {part}))),
              'at', w.at + least(w.left[o], w.more),
              'more', w.more - least(w.left[o], w.more))),
            w -> named_struct('left', w.left, 'parts', w.parts)),
          s -> s.parts)"""
    moved = over.join(left, "one").select(F.inline(F.expr(walk)))  # one row each
    return own.where("kept > 0").select("cell", F.col("owner").alias("shard"), F.lit(0).cast("long").alias("start"), F.col("kept").alias("stop")).union(moved)


def shard_documents(docs: DataFrame, shards: int = 40, vnodes: int = 64, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, home_shard) of every row of `docs`.

    `home_shard` is the shard of the key alone, before bounds. Slots number a shard's rows from 0 without gaps, in
    the order of its cells. `grown_shard` is null: the law is `rows`.
    """
    spark = docs.sparkSession
    body = F.col(text).cast("string").cast("binary")
    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(body), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(body, F.lit(b""))).alias("text_crc32"),
    ).withColumn("h", key_hash(F.col("doc_id")))
    # rows of one key share its hash: their content tells them apart, so that a repeated key is no single run
    rows = rows.withColumn("cell", (F.col("h") % CELLS).cast("int")).withColumn("r", F.xxhash64("h", "text_crc32", "size", F.lit(1)))
    rows = written(rows, "ring-rows")
    n = rows.count()
    runs = max(1, min(1 << 20, -(-n // (CELLS * RUN))))
    rows = rows.withColumn("run", F.pmod(F.shiftright("r", 8), F.lit(runs)).cast("int"))
    runs_of = rows.groupBy("cell", "run").agg(F.count("*").alias("n"))
    in_cell = Window.partitionBy("cell").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs_of = written(runs_of.withColumn("first", F.coalesce(F.sum("n").over(in_cell), F.lit(0).cast("long"))), "ring-runs")
    owners = ring(spark, shards, vnodes)
    pieces = allot(runs_of.groupBy("cell").agg(F.sum("n").alias("n")), owners, shards)
    base = Window.partitionBy("shard").orderBy("cell", "start").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("base", F.coalesce(F.sum(F.col("stop") - F.col("start")).over(base), F.lit(0).cast("long")))
    pieces = pieces.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("start", "stop", "shard", "base"))).alias("pieces"))
    pieces = written(pieces.join(owners.select("cell", F.col("owners")[0].alias("home_shard")), "cell"), "ring-pieces")
    place = F.col("first") + F.row_number().over(Window.partitionBy("cell", "run").orderBy("r", "h", "doc_id")) - 1
    placed = rows.join(F.broadcast(pieces), "cell") if runs == 1 else rows.join(pieces, "cell")  # CELLS rows at most
    placed = placed.join(runs_of.select("cell", "run", "first"), ["cell", "run"]).withColumn("place", place.cast("long"))
    piece = F.filter("pieces", lambda p: (p["start"] <= F.col("place")) & (F.col("place") < p["stop"]))[0]
    return placed.withColumn("piece", piece).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("piece.shard").cast("int").alias("shard"),
        (F.col("piece.base") + F.col("place") - F.col("piece.start")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("home_shard").cast("int").alias("home_shard"),
    )
