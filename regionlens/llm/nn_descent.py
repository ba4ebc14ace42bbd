"""Near-duplicate vectors by NN-descent.

1. Equal vectors are one node, with the number of its rows.
2. Start: random sign projections deal the nodes into small blocks, several times over; every block gives each member its
   best neighbours there. A block that a dense region overfills is split by the nodes' hash.
3. Rounds: the neighbours of a node, in both directions, meet and are compared with each other; lists keep their
   best `width` entries. The rounds end when few lists change. A node that very many others point to is a hot
   centre: its block is split by hash, each part together with the hub's own neighbours.
4. Audit: a bounded sample of nodes is compared with all others; while recall of its threshold links is under
   `RECALL`, the lists are widened and refined again.
5. Pairs are checked in double precision; those of `threshold` or more are the links. Where a list is saturated (all of
   it links), it is enlarged to all members of its component, compared block by block; only counts leave the blocks.

Vectors that are null or zero, or hold null or non-finite components, and rows without id, link with nothing. Vectors of
different lengths don't link. Repeated rows count as vectors of their own. An empty table gives no rows. Other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionlens.llm.common import components, ship, written

WIDTH = 10
TABLES = 8
BLOCK = 64
ROUNDS = 4
#: Share of list entries that may change in the last round.
CALM = 0.01
RECALL = 0.95
AUDITED = 256
#: Members of a component that are compared with as many others at a time.
TILE = 512
#: Slack of single precision when candidates are kept for the exact check.
SLACK = 1e-4


def grouped(df: DataFrame, keys: list[str], partitions_by: list[str], work: Callable, schema: str) -> DataFrame:
    """`work` on every group of rows as a dict of arrays; groups come sorted, many to a batch, and may span batches."""
    columns = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def firsts(table: pa.Table) -> np.ndarray:
            change = np.zeros(table.num_rows, bool)
            change[0] = True
            for k in keys:
                values = table.column(k).to_numpy()
                change[1:] |= values[1:] != values[:-1]
            return np.flatnonzero(change)

        def groups(table: pa.Table, starts: np.ndarray, last: bool):
            blobs = {c: table.column(c).to_pylist() for c in columns if pa.types.is_binary(table.schema.field(c).type)}
            plain = {c: table.column(c).to_numpy() for c in columns if c not in blobs}
            ends = np.append(starts[1:], table.num_rows) if last else starts[1:]
            for a, b in zip(starts.tolist(), ends.tolist()):  # vectors of a group are equally long
                vectors = {c: np.frombuffer(b"".join(v[a:b]), np.float64 if c == "exact" else np.float32).reshape(b - a, -1) for c, v in blobs.items()}
                yield vectors | {c: v[a:b] for c, v in plain.items()}

        def results(table: pa.Table, starts: np.ndarray, last: bool):
            out = [r for g in groups(table, starts, last) if (r := work(g)) is not None and len(r[0])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            starts = firsts(table)
            yield from results(table, starts, False)
            held = table.slice(int(starts[-1]))
        if held is not None:
            yield from results(held, firsts(held), True)

    names = [f.split()[0] for f in schema.split(", ")]
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(parts, *partitions_by).sortWithinPartitions(*keys).mapInArrow(run, schema)


def best_pairs(width: int) -> Callable:
    """For a block of nodes: for each the best others, as far as they beat the worst entry of its list (`bar`)."""

    def work(group: dict) -> tuple | None:
        node, first = np.unique(group["node"], return_index=True)
        if len(node) < 2:
            return None
        vectors, bar = group["vec"][first], group["bar"][first]
        alike = vectors @ vectors.T
        np.fill_diagonal(alike, -2)
        k = min(width, len(node) - 1)
        top = np.argpartition(-alike, k - 1, axis=1)[:, :k]
        value = np.take_along_axis(alike, top, axis=1)
        keep = value > bar[:, None]
        u = np.repeat(node, k).reshape(-1, k)[keep]
        return u, node[top][keep], value[keep].astype(np.float32)

    return work


def best_lists(pairs: DataFrame, width: int) -> DataFrame:
    """(u, v, sim): the best `width` entries of every node's list."""
    entry = F.struct((-F.col("sim")).alias("far"), "v", "sim")
    lists = pairs.groupBy("u", "v").agg(F.max("sim").alias("sim")).groupBy("u").agg(F.slice(F.sort_array(F.collect_list(entry)), 1, width).alias("l"))
    return lists.select("u", F.explode("l").alias("e")).select("u", "e.v", "e.sim")


def distinct_vectors(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, node) of all rows, and through `node` their vectors; node is null where a row can't link."""
    values = F.col(embedding).cast("array<double>")
    good = F.col(vec_id).isNotNull() & values.isNotNull() & (F.size(values) > 0)
    good = good & F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(values, lambda x: x != 0)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), values.alias("exact"), good.alias("good"))
    return rows.select("vec_id", F.when(F.coalesce("good", F.lit(False)), F.xxhash64("exact")).alias("node"), "exact")


def packed(nodes: DataFrame) -> DataFrame:
    """(node, dim, vec, exact): unit vectors in single precision, and the given ones in double precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            exact = [np.array(v, np.float64) for v in batch.column("exact").to_pylist()]
            unit = [v / np.abs(v).max() for v in exact]
            unit = [v / np.linalg.norm(v) for v in unit]
            dims = pa.array([len(v) for v in unit], pa.int32())
            blobs = (pa.array([v.astype(kind).tobytes() for v in unit], pa.binary()) for kind in (np.float32, np.float64))
            yield pa.RecordBatch.from_arrays([batch.column("node"), dims, *blobs], ["node", "dim", "vec", "exact"])

    return nodes.select("node", "exact").mapInArrow(run, "node long, dim int, vec binary, exact binary")


def start_blocks(nodes: DataFrame, bits: int, tables: int) -> DataFrame:
    """(table, bucket, node, vec): the signs of random projections, `tables` times over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            dims, node, vec = (batch.column(c).to_pylist() for c in ("dim", "node", "vec"))
            out: list[tuple] = []
            for d, n, v in zip(dims, node, vec):
                if d not in planes:
                    planes[d] = np.random.default_rng(1000 + d).normal(size=(d, tables * bits)).astype(np.float32)
                signs = (np.frombuffer(v, np.float32) @ planes[d] > 0).reshape(tables, bits)
                buckets = signs @ (1 << np.arange(bits, dtype=np.int64)) + (d << 40)
                out += [(t, int(b), n, v) for t, b in enumerate(buckets)]
            if out:
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["table", "bucket", "node", "vec"])

    return nodes.select("node", "dim", "vec").mapInArrow(run, "table int, bucket long, node long, vec binary")


def start_lists(nodes: DataFrame, n: int, width: int) -> DataFrame:
    bits = max(1, (max(1, n // (BLOCK // 2))).bit_length())
    blocks = written(start_blocks(nodes, bits, TABLES), "vector-blocks")
    sizes = blocks.groupBy("table", "bucket").agg(F.ceil(F.count("*") / F.lit(2 * BLOCK)).cast("int").alias("parts"))
    salt = F.pmod(F.xxhash64("node", "table"), F.col("parts")).cast("int")
    blocks = blocks.join(written(sizes, "vector-block-sizes"), ["table", "bucket"]).select("table", "bucket", salt.alias("salt"), "node", "vec", F.lit(-2.0).cast("float").alias("bar"))
    found = grouped(blocks, ["table", "bucket", "salt"], ["table", "bucket", "salt"], best_pairs(width), "u long, v long, sim float")
    return written(best_lists(found, width), "vector-lists")


def refine(lists: DataFrame, nodes: DataFrame, width: int, turn: int) -> DataFrame:
    """One round: the neighbours of every node, in both directions, are compared with each other."""
    bars = lists.groupBy("u").agg(F.when(F.count("*") >= width, F.min("sim")).otherwise(F.lit(-2.0)).cast("float").alias("bar"))
    members = nodes.select("node", "vec").join(bars.withColumnRenamed("u", "node"), "node", "left").withColumn("bar", F.coalesce("bar", F.lit(-2.0).cast("float")))
    members = written(members, "vector-members")
    pointed = lists.groupBy("v").agg(F.ceil(F.count("*") / F.lit(2.0 * BLOCK)).cast("int").alias("parts")).withColumnRenamed("v", "center")
    pointed = written(pointed, "vector-centers")
    back = lists.select(F.col("v").alias("center"), F.col("u").alias("node")).join(pointed, "center")
    back = back.select("center", F.pmod(F.xxhash64("node", F.lit(turn)), F.col("parts")).cast("int").alias("salt"), "node")
    ahead = lists.select(F.col("u").alias("center"), F.col("v").alias("node")).join(pointed, "center", "left")
    ahead = ahead.select("center", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("salt"), "node")
    meetings = written(back.union(ahead), "vector-meetings")
    blocks = meetings.join(members, "node").select("center", "salt", "node", "vec", "bar")
    found = grouped(blocks, ["center", "salt"], ["center", "salt"], best_pairs(width), "u long, v long, sim float")
    return written(best_lists(lists.union(found), width), "vector-lists")


def descend(lists: DataFrame, nodes: DataFrame, n: int, width: int) -> DataFrame:
    for turn in range(ROUNDS):
        better = refine(lists, nodes, width, turn)
        changed = better.join(lists.select("u", "v"), ["u", "v"], "left_anti").count()
        lists = better
        if changed <= CALM * n * width:
            break
    return lists


def recall_of(lists: DataFrame, nodes: DataFrame, threshold: float, width: int) -> float:
    """Of the links that a sample of nodes really has (at most `width` count for each), the share in its lists."""
    sample = nodes.orderBy(F.xxhash64("node")).limit(AUDITED).select("node", "vec").collect()
    ids = np.array([r["node"] for r in sample], np.int64)
    queries = [np.frombuffer(r["vec"], np.float32) for r in sample]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [], []
            for node, vec in zip(batch.column("node").to_pylist(), batch.column("vec").to_pylist()):
                vec = np.frombuffer(vec, np.float32)
                for i, q in enumerate(queries):
                    if len(q) == len(vec) and ids[i] != node and float(q @ vec) >= threshold:
                        us.append(ids[i])
                        vs.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    def fast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if len({len(q) for q in queries}) != 1:
            yield from run(batches)
            return
        matrix = np.stack(queries)
        for batch in batches:
            good = [i for i, v in enumerate(batch.column("vec").to_pylist()) if len(v) == 4 * matrix.shape[1]]
            if not good:
                continue
            node = np.array(batch.column("node").to_pylist(), np.int64)[good]
            vectors = np.frombuffer(b"".join([batch.column("vec")[i].as_py() for i in good]), np.float32).reshape(len(good), -1)
            q, m = np.nonzero(matrix @ vectors.T >= threshold)
            other = ids[q] != node[m]
            yield pa.RecordBatch.from_arrays([pa.array(ids[q][other]), pa.array(node[m][other])], ["u", "v"])

    true = written(nodes.select("node", "vec").mapInArrow(fast, "u long, v long"), "vector-audit")
    wanted = true.groupBy("u").agg(F.least(F.count("*"), F.lit(width)).alias("n"))
    hits = true.join(lists.select("u", "v"), ["u", "v"]).count()
    total = wanted.agg(F.sum("n")).first()[0] or 0
    return hits / total if total else 1.0


def exact_links(lists: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(u, v), u < v: pairs of the lists whose cosine in double precision reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [len(x) == len(y) and float(np.frombuffer(x) @ np.frombuffer(y)) >= threshold for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    pairs = lists.where(F.col("sim") >= threshold - SLACK).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    exact = nodes.select("node", "exact")
    pairs = pairs.join(exact.withColumnsRenamed({"node": "u", "exact": "x"}), "u").join(exact.withColumnsRenamed({"node": "v", "exact": "y"}), "v")
    return pairs.select("u", "v", "x", "y").mapInArrow(run, "u long, v long")


def enlarged_counts(members: DataFrame, threshold: float) -> DataFrame:
    """(node, n): for all members (component, node, rows, exact), the rows of the other members that link with it."""
    tiles = members.groupBy("component").agg(F.ceil(F.count("*") / F.lit(float(TILE))).cast("int").alias("tiles"))
    tiled = members.join(written(tiles, "vector-tiles"), "component").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    tiled = written(tiled, "vector-members-tiled")
    every = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    ask = tiled.select("component", "tile", every, "node", "rows", "exact", F.lit(1).alias("asks"))
    tell = tiled.select("component", every.alias("tile"), F.col("tile").alias("other"), "node", "rows", "exact", F.lit(0).alias("asks"))

    def work(group: dict) -> tuple | None:
        asks = group["asks"] == 1
        vectors, others = group["exact"][asks], group["exact"][~asks]
        links = vectors @ others.T >= threshold
        links &= group["node"][asks][:, None] != group["node"][~asks][None, :]
        return group["node"][asks], links @ group["rows"][~asks]

    keys = ["component", "tile", "other"]
    counts = grouped(ask.union(tell), keys, keys, work, "node long, n long")
    return counts.groupBy("node").agg(F.sum("n").alias("n"))


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = 0.95, width: int = WIDTH) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of `vectors`."""
    spark = vectors.sparkSession
    ship(spark)
    rows = distinct_vectors(vectors, vec_id, embedding)
    ids = written(rows.select("vec_id", "node"), "vector-ids")
    same = ids.where("node is not null").groupBy("node").agg(F.count("*").alias("rows"), F.min("vec_id").alias("least"))
    same = written(same, "vector-rows")
    nodes = written(packed(rows.where("node is not null").dropDuplicates(["node"])), "vectors")
    n = nodes.count()
    lists = descend(start_lists(nodes, n, width), nodes, n, width)
    for _ in range(2):
        if recall_of(lists, nodes, threshold, width) >= RECALL:
            break
        width *= 2
        lists = descend(written(best_lists(lists.union(start_lists(nodes, n, width)), width), "vector-lists"), nodes, n, width)
    links = written(exact_links(lists, nodes, threshold), "vector-links")
    labels = written(components(links), "vector-components")

    full = lists.where(F.col("sim") >= threshold).groupBy("u").agg(F.count("*").alias("n")).where(F.col("n") >= width)
    saturated = written(labels.join(full, F.col("node") == F.col("u")).select("component").distinct(), "vector-saturated")
    dense = written(labels.join(saturated, "component", "left_semi"), "vector-dense")
    members = dense.join(same, "node").join(nodes.select("node", "exact"), "node").select("component", "node", "rows", "exact")
    both = links.union(links.select("v", "u")).toDF("node", "other")
    sparse = both.join(dense, "node", "left_anti").join(same.select(F.col("node").alias("other"), "rows"), "other").groupBy("node").agg(F.sum("rows").alias("n"))
    counts = written(enlarged_counts(members, threshold).union(sparse), "vector-counts")

    classes = same.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = written(classes.groupBy("component").agg(F.min("least").alias("component_id")), "vector-classes")
    result = classes.join(least, "component").join(counts, "node", "left").select("node", "component_id", (F.coalesce("n", F.lit(0)) + F.col("rows") - 1).alias("links"))
    result = ids.join(written(result, "vector-results"), "node", "left")
    component = F.coalesce("component_id", "vec_id")
    return result.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
