"""Near-duplicate documents by an n-gram Jaccard join with rare-first prefix filtering.

A document is the set of its distinct word shingles. Two sets link when 100 * intersection >= percent * union.

1. Equal sets are one node from the start (`set_key`), so exact copies, however many, are one set in all that follows.
2. Document frequencies. Shingles that fill a fair share of a task are summed first and kept as a short list of
   heavy ones (at most `HEAVY` by construction, for they hold a share of all shingles each). All others are sent to
   their hash range as packed arrays, about four bytes each, are counted there, and only those that occur in two
   nodes or more come back. A shingle of one node can't be shared, so no later step carries it.
3. Rare first: a node orders its shingles by frequency (unshared ones first) and indexes its prefix of
   n - ceil(t n) + 1 shingles. Nodes that link share an n-gram of their prefixes.
4. Nodes meet in the buckets of prefix n-grams. Length, positional and suffix filters cut pairs in the join; every pair
   left is verified once. The suffix filter bounds how far two sets differ at least: unshared shingles always
   do, and so does one of every hash class whose sizes are even in one set and odd in the other; the parities of
   256 classes travel with the n-gram. First come star rounds: a few hub nodes of a bucket, above all those with the
   fewest shingles of their own, are compared with its other members, which joins near-copies of one text in a linear
   number of pairs. The last round compares all pairs of a bucket whose nodes are not connected yet, so no link
   between components is lost.

Components are the result, therefore pairs inside a component need no verification. All joins read written tables by
plain keys, so the skew join can split a hot bucket, a hub or the copies of a text.

Words are lower-cased A-Z and split at ASCII white space. Null or empty texts: no shingles, linked with nothing, their own
component. Repeated rows share a node. A null doc_id stays in the result with the component of its text, or null
if it has none. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionlens.llm.common import components, free_name, ship, slices, written
from regionlens.llm.words import mix, shingle_sets
from regionlens.session import passing_tables

#: A shingle is heavy if it makes up more than 1 / HEAVY of all shingles: there are at most HEAVY of them.
HEAVY = 1 << 19
#: Least number of a task's documents that makes it report a shingle as possibly heavy.
LOCALLY_HEAVY = 16
#: Shingles wanted in a hash range.
RANGE = 1_500_000
#: Documents packed together at most; their places fit 16 bits.
CHUNK = 8192
CHUNK_SHINGLES = 4_000_000
#: Star rounds at most, and the size from which a bucket takes part; all other pairs are left to the last round.
STAR_ROUNDS = 2
LARGE_BUCKET = 24
#: Columns of 64 parities each.
PARITY = ("odd0", "odd1", "odd2", "odd3")
_CODEC = pa.Codec("zstd", compression_level=1)


def pack(values: np.ndarray) -> bytes:
    """An array of 16, 32 or 64-bit numbers, byte plane by byte plane, compressed."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.dtype.itemsize).T.tobytes()
    return bytes([values.dtype.itemsize]) + len(raw).to_bytes(8, "little") + _CODEC.compress(raw, asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    width, size = data[0], int.from_bytes(data[1:9], "little")
    kind = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}[width]
    if not size:
        return np.zeros(0, kind)
    raw = np.frombuffer(_CODEC.decompress(data[9:], size, asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).ravel()


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return n - -(-percent * n // 100) + 1


def row_key(doc_id: str, text: str):
    """What names a row in both passes: its id, or the hash of its text if it has none."""
    return F.coalesce(F.col(doc_id).cast("long"), F.xxhash64(F.col(text).cast("string")))


def document_sets(rows: DataFrame, width: int) -> DataFrame:
    """(row, doc_id, n_shingles, node) for every row, and rows (shingle, many) of shingles that a task met often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "doc_id", "n_shingles", "node", "shingle", "many"]
        seen: set[int] = set()
        pending: list[np.ndarray] = []
        size = 0

        def report() -> pa.RecordBatch:
            values = np.sort(np.concatenate(pending)) if pending else np.zeros(0, np.uint64)
            first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
            many = np.diff(np.append(first, len(values)))
            often = many >= LOCALLY_HEAVY
            empty = pa.nulls(int(often.sum()), pa.int64())
            return pa.RecordBatch.from_arrays([empty] * 4 + [pa.array(values[first[often]].view(np.int64)), pa.array(many[often].astype(np.int64))], names)

        for batch in slices(batches):
            sets = shingle_sets(batch.column("text"), width)
            nodes = [node_of(s) if len(s) else None for s in sets]
            for node, one in zip(nodes, sets):
                if node is not None and node not in seen:
                    seen.add(node)
                    pending.append(one)
                    size += len(one)
            empty = pa.nulls(len(sets), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64()), empty, empty], names)
            if size > 2 * CHUNK_SHINGLES:
                yield report()
                pending, size = [], 0
                seen.clear()
        yield report()

    return rows.mapInArrow(run, "row long, doc_id long, n_shingles long, node long, shingle long, many long")


def node_of(shingles: np.ndarray) -> int:
    """One number for equal sets."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def packed_requests(texts: DataFrame, width: int, bits: int, heavy) -> DataFrame:
    """The shingles of chunks of nodes, packed: one row for each hash range, and one in range -1.

    The latter names the chunk's nodes and their sizes, and holds the heavy shingles with their frequencies. A key
    is the top `bits` + 32 bits of a shingle; the other rows hold the last 32 of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy_values, heavy_many = heavy.value
        names = ["range", "chunk", "keys", "places", "df", "nodes", "sizes"]
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        nodes: dict[int, np.ndarray] = {}

        def flush() -> pa.RecordBatch:
            ids, sets = np.array(list(nodes), np.int64), list(nodes.values())
            sizes = np.array([len(s) for s in sets], np.uint64)
            values = np.concatenate(sets)
            places = np.repeat(np.arange(len(sets), dtype=np.uint16), sizes.astype(np.int64))
            order = np.argsort(values, kind="stable")
            values, places = values[order], places[order]
            keys = values >> np.uint64(32 - bits)
            chunk = node_of(ids)
            known, df = np.zeros(len(values), bool), np.zeros(0, np.uint32)
            if len(heavy_values):
                at = np.minimum(np.searchsorted(heavy_values, values), len(heavy_values) - 1)
                known = heavy_values[at] == values
                df = heavy_many[at[known]]
            rows = [(-1, chunk, pack(keys[known]), pack(places[known]), pack(df), pack(ids.view(np.uint64)), pack(sizes))]
            keys, places = keys[~known], places[~known]
            part = (keys >> np.uint64(32)).astype(np.int64)
            bounds = np.flatnonzero(np.diff(part, prepend=-1, append=1 << 40))
            low = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            for a, b in zip(bounds[:-1], bounds[1:]):
                rows.append((int(part[a]), chunk, pack(low[a:b]), pack(places[a:b]), None, None, None))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        size = 0
        for batch in slices(batches):
            for wanted, one in zip(batch.column("node").to_pylist(), shingle_sets(batch.column("text"), width)):
                if wanted in nodes or not len(one) or node_of(one) != wanted:
                    continue  # a repeated row, or another text under the same id
                nodes[wanted] = one
                size += len(one)
                if len(nodes) >= CHUNK or size >= CHUNK_SHINGLES:
                    yield flush()
                    nodes, size = {}, 0
        if nodes:
            yield flush()

    return texts.mapInArrow(run, "range int, chunk long, keys binary, places binary, df binary, nodes binary, sizes binary")


def count_range(table: pa.Table) -> pa.Table:
    """For one hash range: the shingles of two nodes or more, with their frequency, to be sent back to their chunks."""
    rows = table.select(["range", "chunk", "keys", "places"]).to_pylist()
    values = [unpack(r["keys"]) for r in rows]
    every = np.sort(np.concatenate(values))
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    many = np.diff(np.append(first, len(every)))
    shared, df = every[first[many > 1]], many[many > 1].astype(np.uint32)
    out = []
    for row, own in zip(rows, values):
        if not len(shared):
            break
        at = np.minimum(np.searchsorted(shared, own), len(shared) - 1)
        hit = shared[at] == own
        if hit.any():
            keys = (np.uint64(row["range"]) << np.uint64(32)) | own[hit].astype(np.uint64)
            out.append((row["chunk"], pack(keys), pack(unpack(row["places"])[hit]), pack(df[at[hit]])))
    columns = list(zip(*out)) if out else [[]] * 4
    empty = pa.nulls(len(out), pa.binary())
    return pa.Table.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[1:]), empty, empty], ["chunk", "keys", "places", "df", "nodes", "sizes"])


def assembler(percent: int):
    """For one chunk: its nodes with their shared shingles (`tokens`), and those of the prefix, rarest first (`head`)."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        own = next(r for r in rows if r["nodes"] is not None)
        nodes, sizes = unpack(own["nodes"]).view(np.int64), unpack(own["sizes"]).astype(np.int64)
        rows = [r for r in rows if r["nodes"] is None or r is own]
        keys = np.concatenate([unpack(r["keys"]).astype(np.uint64) for r in rows])
        places = np.concatenate([unpack(r["places"]) for r in rows])
        df = np.concatenate([unpack(r["df"]) for r in rows])
        order = np.lexsort((keys, df, places))
        keys, places = keys[order], places[order]
        bounds = np.searchsorted(places, np.arange(len(nodes) + 1))
        alone = sizes - np.diff(bounds)
        prefix = prefix_length(sizes, percent) - alone
        keep = np.flatnonzero(prefix > 0)  # a node whose prefix is all unshared links with nothing
        tokens = [np.sort(keys[bounds[i] : bounds[i + 1]]).tobytes() for i in keep]
        head = [keys[bounds[i] : bounds[i] + prefix[i]].tobytes() for i in keep]
        odd = [np.packbits(np.bincount((mix(keys[bounds[i] : bounds[i + 1]]) % np.uint64(64 * len(PARITY))).astype(np.int64), minlength=64 * len(PARITY)) & 1).view(np.int64) for i in keep]
        odd = np.array(odd, np.int64).reshape(-1, len(PARITY))
        columns = [pa.array(nodes[keep]), pa.array(sizes[keep]), pa.array(alone[keep]), *(pa.array(odd[:, k]) for k in range(len(PARITY))), pa.array(head, pa.binary()), pa.array(tokens, pa.binary())]
        return pa.Table.from_arrays(columns, ["node", "n", "alone", *PARITY, "head", "tokens"])

    return run


def postings(nodes: DataFrame) -> DataFrame:
    """(token, node, n, alone, at, parities): the prefix n-grams of every node and their places in its order."""
    names = ["node", "n", "alone", *PARITY]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = [np.frombuffer(h, np.int64) for h in batch.column("head").to_pylist()]
            if not heads:
                continue
            many = np.array([len(h) for h in heads])
            own = {c: np.repeat(batch.column(c).to_numpy(), many) for c in names}
            at = own["alone"] + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            columns = [np.concatenate(heads), *own.values(), at]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["token", *names, "at"])

    return nodes.select(*names, "head").mapInArrow(run, ", ".join(f"{c} long" for c in ("token", *names, "at")))


def may_link(percent: int):
    """Length, positional and suffix filter for a pair `a`, `b` that shares the n-gram at the places a.at and b.at."""
    a_n, b_n, a_at, b_at = F.col("a.n"), F.col("b.n"), F.col("a.at"), F.col("b.at")
    length = F.least(a_n, b_n) * 100 >= F.greatest(a_n, b_n) * percent
    # all that follows in the shorter rest, and what both have before
    position = (F.least(a_n - a_at, b_n - b_at) + F.least(a_at, b_at)) * (100 + percent) >= (a_n + b_n) * percent
    # how far they differ at least, against how far linked sets may: a.n + b.n - 2 * overlap
    differ = F.col("a.alone") + F.col("b.alone")
    for c in PARITY:
        differ = differ + F.bit_count(F.col(f"a.{c}").bitwiseXOR(F.col(f"b.{c}")))
    return length & position & (differ * (100 + percent) <= (a_n + b_n) * (100 - percent))


def ordered_pairs(joined: DataFrame) -> DataFrame:
    return joined.select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v")).distinct()


def verify(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) that link, by the intersection of their shared shingles."""

    def links(n: int, m: int, x: np.ndarray, y: np.ndarray) -> bool:
        need = -(-percent * (n + m) // (100 + percent))
        if min(len(x), len(y)) < need:
            return False
        same = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
        return 100 * same >= percent * (n + m - same)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = (batch.column(c).to_pylist() for c in ("n", "m"))
            sets = ([np.frombuffer(t.as_buffer(), np.uint64) for t in batch.column(c)] for c in ("x", "y"))
            keep = [links(n, m, x, y) for n, m, x, y in zip(*sizes, *sets)]
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    left = nodes.select(F.col("node").alias("u"), "n", F.col("tokens").alias("x"))
    right = nodes.select(F.col("node").alias("v"), F.col("n").alias("m"), F.col("tokens").alias("y"))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "n", "m", "x", "y").mapInArrow(run, "u long, v long")


def connect(nodes: DataFrame, percent: int) -> DataFrame:
    """(node, component) of all nodes with links, from the prefix n-grams of `nodes`."""
    posts = postings(nodes)
    shared = posts.groupBy("token").agg(F.count("*").alias("many")).where("many > 1").select("token")
    posts = written(posts.join(shared, "token"), "postings")
    links, labels, verified, quiet = None, None, None, False
    for turn in range(STAR_ROUNDS + 1):
        live = posts.withColumn("comp", F.col("node"))
        if labels is not None:
            live = posts.join(labels, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
        one = F.struct("node", "n", "alone", *PARITY, "at", "comp")
        seed = F.lit(turn)
        hubs = [F.min_by(one, F.xxhash64("node", seed)), F.min_by(one, F.struct("alone", F.xxhash64("node", seed)))]
        hubs += [F.min_by(one, F.struct("alone", F.xxhash64("comp", seed))), F.min_by(one, F.xxhash64("comp", seed))]
        stats = live.groupBy("token").agg(F.count("*").alias("many"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.array(*hubs).alias("hubs"))
        stats = written(stats.where("low <> high").drop("low", "high"), "buckets")
        live = written(live.join(stats.select("token"), "token", "left_semi"), "live")
        large = turn < STAR_ROUNDS and not quiet and not stats.where(F.col("many") >= LARGE_BUCKET).isEmpty()
        if large:
            b = stats.where(F.col("many") >= LARGE_BUCKET).select("token", F.explode("hubs").alias("hub")).select("token", "hub.*").distinct().alias("b")
            pairs = live.alias("a").join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.comp") != F.col("b.comp")) & may_link(percent))
        else:
            major = stats.select("token", F.col("hubs")[0]["comp"].alias("major"))
            a = live.join(major, "token").where("comp <> major").alias("a")
            once = (F.col("b.comp") == F.col("a.major")) | (F.col("a.node") < F.col("b.node"))
            pairs = a.join(live.alias("b"), (F.col("a.token") == F.col("b.token")) & (F.col("a.comp") != F.col("b.comp")) & once & may_link(percent))
        pairs = ordered_pairs(pairs)
        if verified is not None:
            pairs = pairs.join(verified, ["u", "v"], "left_anti")
        pairs = written(pairs, "candidates")
        verified = pairs if verified is None else verified.union(pairs)
        found = written(verify(pairs, nodes, percent), "links")
        quiet = found.isEmpty()
        links = found if links is None else links.union(found)
        labels = written(components(links), "components")
        if not large:
            return labels


def near_duplicate_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(row, doc_id, n_shingles, node, component, component_id, keeper) of every row of `docs`.

    `component` names the class also where it has no id, `component_id` is its smallest doc_id, and `keeper` is the
    `row` (see `row_key`) of the document that stands for it.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(row_key(doc_id, text).alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    sets = written(document_sets(rows, width), "sets")
    kept = sets.where("many is null").select("row", "doc_id", "n_shingles", "node")
    with passing_tables(spark):
        classes = _written_classes(rows, sets, kept, width, percent)
    full = kept.where("node is not null").join(classes, "node")
    empty = kept.where("node is null").withColumns({"component": F.lit(None).cast("long"), "component_id": F.col("doc_id"), "keeper": F.col("row")})
    columns = ["row", "doc_id", "n_shingles", "node", "component", "component_id", "keeper"]
    return full.select(columns).union(empty.select(columns))


def _written_classes(rows: DataFrame, sets: DataFrame, kept: DataFrame, width: int, percent: int) -> DataFrame:
    """(node, component, component_id, keeper) of every node."""
    spark = rows.sparkSession
    named = kept.where("node is not null").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "row")).alias("first"), F.max("n_shingles").alias("n"), F.min("doc_id").alias("doc_id"))
    named = written(named.select("node", "n", "doc_id", F.col("first.row").alias("row"), F.col("first.unnamed").alias("unnamed")), "nodes")
    total = named.agg(F.sum("n")).first()[0] or 0
    bits = max(0, min(31, (total // RANGE).bit_length()))
    often = sets.where("many is not null").groupBy("shingle").agg(F.sum("many").alias("many")).where(F.col("many") > max(64, total // HEAVY))
    often = often.toPandas()  # HEAVY rows at most: each makes up a share of 1 / HEAVY
    values = often["shingle"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(values)
    heavy = spark.sparkContext.broadcast((values[order], often["many"].to_numpy(np.int64)[order].astype(np.uint32)))

    texts = rows.join(named.select("row", "node"), "row").select("node", "text")
    requests = written(packed_requests(texts, width, bits, heavy), "requests")
    answer = "chunk long, keys binary, places binary, df binary, nodes binary, sizes binary"
    answers = requests.where("range >= 0").select("range", "chunk", "keys", "places").groupBy("range").applyInArrow(count_range, answer)
    chunks = requests.where("range < 0").select("chunk", "keys", "places", "df", "nodes", "sizes").union(answers)
    nodes = written(chunks.groupBy("chunk").applyInArrow(assembler(percent), ", ".join(["node long, n long, alone long", *(f"{c} long" for c in PARITY), "head binary, tokens binary"])), "node-sets")

    labels = connect(nodes, percent)
    classes = named.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    classes = written(classes, "node-classes")
    least = classes.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.min(F.struct("unnamed", "row")).alias("first"))
    return written(classes.select("node", "component").join(least.select("component", "component_id", F.col("first.row").alias("keeper")), "component"), "classes", result=True)


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that stand for their class, one for each, with all columns of `docs`.

    Documents without words stay, one for each id (rows without id: one for each text).
    """
    own = free_name(docs, "_row")
    keepers = near_duplicate_classes(docs, doc_id, text).select(F.col("keeper").alias(own)).distinct()
    keyed = docs.withColumn(own, row_key(doc_id, text))
    return keyed.join(keepers, own).dropDuplicates([own]).select(docs.columns)
