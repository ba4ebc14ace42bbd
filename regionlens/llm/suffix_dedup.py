"""Removal of repeated passages by a column-wise Burrows-Wheeler transform of many strings.

A byte goes if it is covered by a `length`-byte string that also starts in a document with a smaller id.

1. Cutting. Every window of `length` bytes has a minimiser: the smallest hash of its `SEED`-byte strings. Runs of windows
   with one minimiser make short strings (`length` + `length` - `SEED` bytes at most), and equal windows always lie
   in strings of the same minimiser. Minimisers of a single document can't repeat across documents: their
   counts are taken in hash ranges, packed at about four bytes each, and only strings with a shared one go on.
2. Column-wise construction. Strings are dealt out by minimiser to groups of bounded size. In a group all strings are
   inserted together, one symbol of each per round from their ends, as in the construction for read collections:
   a new suffix lands where the last-to-first mapping puts it, and its common prefix with its neighbours is one more
   than the least common prefix between the two places before. Transform and common prefixes live in a
   sequential file, read and rewritten once a round.
   A string that agrees with no other one around its minimiser is settled without it.
3. Classes. Suffixes with a common prefix of `length` or more are one class; its smallest document keeps the string,
   all others lose it. The result goes back to the documents as spans.

A minimiser of very many documents is split: its windows become strings of their own, dealt out by their content.
Exact copies of a whole text are settled by their hash first; equal strings of a chunk travel once.

Null texts count as empty. A null id counts as larger than all others: such rows lose what any document with an id has,
and never take from each other. Rows that repeat an id don't take from each other either. Texts shorter than
`length` bytes stay whole. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import io
import tempfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regionlens.llm.common import free_name, give_back, ship, slices, written
from regionlens.llm.jaccard_join import count_range, node_of, pack, unpack
from regionlens.llm.words import mix, text_bytes
from regionlens.session import passing_tables

SEED = 16
#: Minimisers wanted in a hash range, strings wanted in a group.
RANGE = 1_500_000
GROUP = 25_000
#: Documents of a minimiser beyond which its windows are dealt out one by one.
HOT = 40_000
CHUNK = 8192
CHUNK_BYTES = 24 << 20
#: Text bytes whose strings a task holds at a time, and that it hashes at a time.
STRING_BYTES = 8 << 20
HASHED_BYTES = 1 << 20
NO_ID = (1 << 63) - 1


def seed_hashes(data: np.ndarray) -> np.ndarray:
    """The hash of the `SEED` bytes from every byte on, from hashes of powers of two."""
    h, width, done, covered = mix(np.arange(256, dtype=np.uint64))[data], 1, None, 0
    want = SEED
    while want:
        if want & 1:
            if done is None:
                done, covered = h, width
            else:
                n = len(h) - covered
                done, covered = mix(done[:n] * np.uint64(0x9E3779B97F4A7C15) + h[covered : covered + n]), covered + width
        want >>= 1
        if want:
            h = mix(h[:-width] * np.uint64(0x9E3779B97F4A7C15) + h[width:])
            width *= 2
    return done


def minimisers(column: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes and bounds of the texts, and for every run of windows its text, first byte, number of windows and minimiser."""
    data, offsets = text_bytes(column)
    none = np.zeros(0, np.int64)
    many = np.maximum(np.diff(offsets) - length + 1, 0)
    if not many.sum():
        return data, offsets, none, none, none, np.zeros(0, np.uint64)
    span, low, width = length - SEED + 1, seed_hashes(data), 1
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if span > width:
        low = np.minimum(low[: -(span - width)], low[span - width :])
    inside = np.zeros(len(low) + 1, np.int8)
    some = np.flatnonzero(many)
    np.add.at(inside, offsets[some], 1)
    np.add.at(inside, offsets[some] + many[some], -1)
    inside = np.cumsum(inside[:-1]).astype(bool)
    new = np.empty(len(low), bool)
    new[0] = True
    np.not_equal(low[1:], low[:-1], out=new[1:])
    new[offsets[some]] = True
    starts = np.flatnonzero(new & inside)
    text = np.searchsorted(offsets, starts, side="right") - 1
    ends = np.minimum(np.append(starts[1:], len(low)), offsets[text] + many[text])
    pieces = -(-(ends - starts) // span)  # one minimiser over a long run: cut it
    if (pieces > 1).any():
        step = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first, ends, text = np.repeat(starts, pieces), np.repeat(ends, pieces), np.repeat(text, pieces)
        starts = first + step * span
        ends = np.minimum(ends, starts + span)
    return data, offsets, text, starts, ends - starts, mix(low[starts])  # smallest hashes crowd in the lowest ranges


def requests(rows: DataFrame, length: int, bits: int) -> DataFrame:
    """The minimisers of chunks of documents, packed by hash range; range -1 names the documents of a chunk."""
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        idents: list[int] = []
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            ids = np.array(idents, np.int64)
            keys, places = (np.concatenate([f[k] for f in found]) for k in (0, 1))
            found.clear()
            order = np.lexsort((places, keys))
            keys, places = keys[order], places[order]
            first = np.ones(len(keys), bool)
            first[1:] = (keys[1:] != keys[:-1]) | (places[1:] != places[:-1])
            keys, places = keys[first] >> np.uint64(32 - bits), places[first]
            chunk = node_of(ids)
            part = (keys >> np.uint64(32)).astype(np.int64)
            bounds = np.flatnonzero(np.diff(part, prepend=-1, append=1 << 40))
            out = [(-1, chunk, None, None, pack(ids.view(np.uint64)))]
            for a, b in zip(bounds[:-1], bounds[1:]):
                out.append((int(part[a]), chunk, pack((keys[a:b] & np.uint64(0xFFFFFFFF)).astype(np.uint32)), pack(places[a:b]), None))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["range", "chunk", "keys", "places", "idents"])

        size = 0
        for batch in slices(batches, limit=HASHED_BYTES):
            data, _, text, _, _, key = minimisers(batch.column("text"), length)
            if len(idents) + batch.num_rows > CHUNK or size + len(data) > CHUNK_BYTES:
                if idents:
                    yield flush()
                idents, found, size = [], [], 0
            found.append((key, (text + len(idents)).astype(np.uint16)))  # below CHUNK
            idents += batch.column("ident").to_pylist()
            size += len(data)
        if idents:
            yield flush()

    return rows.mapInArrow(run, "range int, chunk long, keys binary, places binary, idents binary")


def shared_keys(table: pa.Table) -> pa.Table:
    """For one chunk: the shared minimisers of each document that has some, with the number of their documents."""
    give_back()
    rows = table.to_pylist()
    idents = unpack(next(r["idents"] for r in rows if r["idents"] is not None)).view(np.int64)
    rows = [r for r in rows if r["keys"] is not None]
    if not rows:
        return pa.Table.from_arrays([pa.array([], pa.int64()), pa.array([], pa.binary()), pa.array([], pa.binary())], ["ident", "keys", "df"])
    keys, places, df = (np.concatenate([unpack(r[c]) for r in rows]) for c in ("keys", "places", "df"))
    order = np.lexsort((keys, places))
    keys, places, df = keys[order], places[order], df[order]
    bounds = np.searchsorted(places, np.arange(len(idents) + 1))
    some = np.flatnonzero(np.diff(bounds))
    return pa.Table.from_arrays(
        [pa.array(idents[some]), pa.array([keys[bounds[i] : bounds[i + 1]].tobytes() for i in some], pa.binary()), pa.array([df[bounds[i] : bounds[i + 1]].tobytes() for i in some], pa.binary())],
        ["ident", "keys", "df"],
    )


def shared_strings(texts: DataFrame, length: int, bits: int, groups: int, hot: int) -> DataFrame:
    """Rows of two kinds: the distinct strings of a chunk for one group, and (group -1) where the chunk's documents have them."""
    names = ["group", "chunk", "strings", "lengths", "number", "low", "high", "idents", "places", "starts"]
    kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        idents: list[int] = []
        ranks: list[int] = []
        strings: dict[bytes, int] = {}
        group_of: list[int] = []
        low: list[int] = []
        high: list[int] = []
        numbers: list[int] = []  # of each occurrence the string and the first byte, by text
        begins: list[int] = []
        counts: list[int] = []

        def add(start: int, string: bytes, key: int, rank: int) -> None:
            n = strings.setdefault(string, len(low))
            if n == len(low):
                group_of.append(key % groups)
                low.append(rank)
                high.append(rank)
            elif rank < low[n]:
                low[n] = rank
            elif rank > high[n]:
                high[n] = rank
            numbers.append(n)
            begins.append(start)

        def flush() -> pa.RecordBatch:
            ids = np.array(idents, np.int64)
            chunk = node_of(ids)
            every = list(strings)
            group = np.array(group_of, np.int64)
            order = np.argsort(group, kind="stable")
            lengths = np.array([len(s) for s in every], np.uint8)
            lows, highs = np.array(low, np.int64).view(np.uint64), np.array(high, np.int64).view(np.uint64)
            places = np.repeat(np.arange(len(counts), dtype=np.uint16), np.diff(counts, prepend=0))
            out = [(-1, chunk, None, None, pack(np.array(numbers, np.uint32)), pack(np.array(ranks, np.int64).view(np.uint64)), None, pack(ids.view(np.uint64)), pack(places), pack(np.array(begins, np.uint32)))]
            bounds = np.flatnonzero(np.diff(group[order], prepend=-1, append=1 << 40))
            for a, b in zip(bounds[:-1], bounds[1:]):
                own = order[a:b]
                body = pack(np.frombuffer(b"".join([every[i] for i in own]), np.uint8))
                out.append((int(group[own[0]]), chunk, body, pack(lengths[own]), pack(own.astype(np.uint32)), pack(lows[own]), pack(highs[own]), None, None, None))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

        size = 0
        for batch in slices(batches, limit=HASHED_BYTES):
            if len(idents) + batch.num_rows > CHUNK or size > STRING_BYTES:
                if idents:
                    yield flush()
                idents, ranks, strings, group_of, low, high, numbers, begins, counts, size = [], [], {}, [], [], [], [], [], [], 0
            data, offsets, text, starts, windows, key = minimisers(batch.column("text"), length)
            whole = data.tobytes()
            key = key >> np.uint64(32 - bits)
            bounds = np.searchsorted(text, np.arange(batch.num_rows + 1))
            columns = (batch.column(c).to_pylist() for c in ("ident", "rank", "keys", "df"))
            for i, (ident, rank, known, df) in enumerate(zip(*columns)):
                idents.append(ident)
                ranks.append(rank)
                known, df = np.frombuffer(known, np.uint64), np.frombuffer(df, np.uint32)
                a, b, base = bounds[i], bounds[i + 1], int(offsets[i])
                at = np.minimum(np.searchsorted(known, key[a:b]), len(known) - 1)
                some = np.flatnonzero(known[at] == key[a:b])
                first = starts[a + some]
                stop = first + windows[a + some] + length - 1
                for start, end, own, many in zip(first.tolist(), stop.tolist(), key[a + some].tolist(), df[at[some]].tolist()):
                    if many > hot:
                        for s in range(start, end - length + 1):
                            string = whole[s : s + length]
                            add(s - base, string, int.from_bytes(hashlib.blake2b(string, digest_size=7).digest(), "little"), rank)
                        continue
                    string = whole[start:end]
                    n = strings.get(string)
                    if n is None:
                        add(start - base, string, own * 0x9E3779B1 >> 7, rank)
                        continue
                    if rank < low[n]:
                        low[n] = rank
                    elif rank > high[n]:
                        high[n] = rank
                    numbers.append(n)
                    begins.append(start - base)
                counts.append(len(numbers))
            size += len(data)
        if idents:
            yield flush()

    return texts.mapInArrow(run, "group int, chunk long, strings binary, lengths binary, number binary, low binary, high binary, idents binary, places binary, starts binary")


def insert_columns(body: np.ndarray, lengths: np.ndarray, folder: str) -> tuple[np.ndarray, np.ndarray]:
    """Transform and common prefixes of a collection, built column by column in a file of `folder`.

    `body` holds the strings behind each other; their bytes are 0 to 254, as in UTF-8. Symbols are bytes + 1, and 0 marks
    the beginning of a string. The first entries are the empty suffixes, in the strings' order.
    """
    last = np.cumsum(lengths) - 1
    begins = (body[last] + 1).astype(np.uint8)
    with open(Path(folder, "columns"), "w+b", buffering=0) as file:  # a symbol and a common prefix for each suffix, in order
        return _columns(body, lengths, last, begins, file)


def _columns(body: np.ndarray, lengths: np.ndarray, last: np.ndarray, begins: np.ndarray, file: io.FileIO) -> tuple[np.ndarray, np.ndarray]:
    size = len(begins)

    def rewrite(record: np.ndarray) -> None:  # the file only grows
        file.seek(0)
        file.write(record)

    def reread() -> np.ndarray:
        record = np.empty(size, np.uint16)
        file.seek(0)
        file.readinto(record)
        return record

    rewrite(begins.astype(np.uint16))
    counts = np.bincount(begins, minlength=256)
    active, place = np.arange(len(lengths)), np.arange(len(lengths))  # strings in the order of their latest suffixes
    for column in range(1, int(lengths.max()) + 1):
        record = reread()
        bwt, lcp = record.astype(np.uint8), (record >> 8).astype(np.uint8)  # the low byte and the high one
        order = np.argsort(bwt, kind="stable")  # places by symbol: where the mapping comes from
        symbol = bwt[place]
        by = np.argsort(symbol, kind="stable")  # places ascend, so this is also the order of the new suffixes
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        at = rank[place].astype(np.int64)
        # common prefixes with the neighbours: one more than the least between the places they come from
        before, after = order[at - 1], order[np.minimum(at + 1, len(order) - 1)]
        joins = (at > 0) & (bwt[before] == symbol)
        joined = (at + 1 < len(order)) & (bwt[after] == symbol)
        own = np.zeros(len(place), np.uint16)
        own[joins] = _least(lcp, before[joins] + 1, place[joins] + 1) + 1
        follower = np.zeros(len(place), np.uint16)
        follower[joined] = _least(lcp, place[joined] + 1, after[joined] + 1) + 1
        new = at[by] - counts[0] + len(lengths)  # beginnings have no longer suffix; the empty suffixes come before all others
        own, follower, active = own[by], follower[by], active[by]
        left = lengths[active] > column
        previous = np.zeros(len(active), np.uint8)
        previous[left] = body[last[active[left]] - column] + 1
        old = np.ones(len(record) + len(new), bool)
        old[new] = False
        grown = np.empty(len(old), np.uint16)
        grown[old] = record
        behind = new + 1
        inside = behind < len(old)
        grown[behind[inside]] = (grown[behind[inside]] & 0xFF) | (follower[inside] << 8)
        grown[new] = previous | (own << 8)
        rewrite(grown)
        size = len(grown)
        counts += np.bincount(previous, minlength=256)
        active, place = active[left], new[left]
    record = reread()
    return (record & 0xFF).astype(np.uint8), (record >> 8).astype(np.uint8)


def _least(values: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The least value of each range, none of them empty. The ranges begin or end in ascending order, else what lies between them costs time."""
    if not len(first):
        return np.zeros(0, values.dtype)
    bounds = np.empty(2 * len(first), np.int64)
    bounds[0::2], bounds[1::2] = first, stop
    return np.minimum.reduceat(np.append(values, values[-1:]), bounds)[0::2]


def window_minima(body: np.ndarray, lengths: np.ndarray, low: np.ndarray, length: int) -> np.ndarray:
    """For every window of every string, in order, the smallest `low` of the strings that hold it."""
    with tempfile.TemporaryDirectory() as folder:
        bwt, lcp = insert_columns(body, lengths, folder)
    order = np.argsort(bwt, kind="stable")
    step = np.empty(len(bwt), np.int64)
    step[order] = np.arange(len(bwt))
    step += len(lengths) - int((bwt == 0).sum())  # from a suffix to the one that is a symbol longer
    kind = np.cumsum(lcp < length)
    windows = lengths - length + 1
    first = np.cumsum(windows) - windows
    kinds = np.empty(int(windows.sum()), np.int64)
    active, place = np.arange(len(lengths)), np.arange(len(lengths))
    for column in range(1, int(lengths.max()) + 1):
        place = step[place]
        if column >= length:
            kinds[first[active] + lengths[active] - column] = kind[place]
        left = lengths[active] > column
        active, place = active[left], place[left]
    best = np.full(int(kind[-1]) + 1, NO_ID, np.int64)
    np.minimum.at(best, kinds, np.repeat(low, windows))
    return best[kinds]


def related(body: np.ndarray, lengths: np.ndarray, length: int) -> np.ndarray:
    """Which strings may have a window in common with another one.

    Equal windows have one minimiser, at the same place. Of the `length` - `SEED` bytes around it at least half lie on one
    side, so the strings also agree in the `SEED` bytes that begin half as many bytes before the minimiser or behind its start.
    """
    ends = np.cumsum(lengths)
    begin, half = ends - lengths, -(-(length - SEED) // 2)
    seeds = seed_hashes(body)
    key = _least(seeds, begin, ends - SEED + 1)
    own = np.repeat(np.arange(len(lengths)), lengths)[: len(seeds)]
    at = np.flatnonzero(seeds == key[own])
    at = at[at + SEED <= ends[own[at]]]  # a minimiser may come several times
    out = np.zeros(len(lengths), bool)
    for move in (-half, half):
        inside = at[(at + move >= begin[own[at]]) & (at + move + SEED <= ends[own[at]])]
        _, inverse, counts = np.unique(mix(seeds[inside] * np.uint64(0x9E3779B97F4A7C15) + seeds[inside + move]), return_inverse=True, return_counts=True)
        out[own[inside[counts[inverse] > 1]]] = True
    return out


def settled_minima(strings: list[bytes], low: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window of every string the smallest `low` of the strings that hold it, and where a string's windows begin.

    A string that agrees with no other one around its minimiser is settled: nobody else has its windows. The transform is
    built over the others.
    """
    lengths = np.array([len(s) for s in strings], np.int64)
    windows = lengths - length + 1
    first = np.cumsum(windows) - windows
    minima = np.repeat(low, windows)
    some = related(np.frombuffer(b"".join(strings), np.uint8), lengths, length)
    if some.any():
        body = np.frombuffer(b"".join([strings[i] for i in np.flatnonzero(some)]), np.uint8)
        minima[np.repeat(some, windows)] = window_minima(body, lengths[some], low[some], length)
    return minima, first


def resolver(length: int):
    """For one group: which strings of which chunk have windows with a smaller document, and the documents."""

    def run(table: pa.Table) -> pa.Table:
        give_back()
        rows = table.to_pylist()
        known: dict[bytes, int] = {}
        low: list[int] = []
        own: list[tuple] = []
        for row in rows:
            body, lengths = unpack(row["strings"]).tobytes(), unpack(row["lengths"]).astype(np.int64)
            lows, highs = unpack(row["low"]).view(np.int64), unpack(row["high"]).view(np.int64)
            ends = np.cumsum(lengths).tolist()
            numbers = []
            for a, b, least in zip([0, *ends[:-1]], ends, lows.tolist()):
                n = known.setdefault(body[a:b], len(known))
                if n == len(low):
                    low.append(least)
                elif least < low[n]:
                    low[n] = least
                numbers.append(n)
            own.append((row["chunk"], unpack(row["number"]), np.array(numbers, np.int64), highs, lengths - length + 1))
        minima, first = settled_minima(list(known), np.array(low, np.int64), length)
        least = np.minimum.reduceat(minima, first)
        out = []
        for chunk, number, strings, highs, windows in own:
            some = np.flatnonzero(least[strings] < highs)
            if len(some):
                n = windows[some]
                at = np.repeat(first[strings[some]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                out.append((chunk, pack(number[some]), pack(n.astype(np.uint8)), pack(minima[at].view(np.uint64))))
        columns = list(zip(*out)) if out else [[]] * 4
        empty = pa.nulls(len(out), pa.binary())
        return pa.Table.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[1:]), empty, empty, empty], ["chunk", "number", "windows", "minima", "idents", "places", "starts"])

    return run


def span_finder(length: int):
    """For one chunk: the maximal runs of bytes that each document loses, as pairs of bounds."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        own = next(r for r in rows if r["idents"] is not None)
        idents = unpack(own["idents"]).view(np.int64)
        place, start, string = (unpack(own[c]).astype(np.int64) for c in ("places", "starts", "number"))
        ranks = unpack(own["minima"]).view(np.int64)
        rows = [r for r in rows if r["windows"] is not None]
        empty = pa.Table.from_arrays([pa.array([], pa.int64()), pa.array([], pa.binary())], ["ident", "spans"])
        if not rows:
            return empty
        number = np.concatenate([unpack(r["number"]) for r in rows]).astype(np.int64)
        windows = np.concatenate([unpack(r["windows"]) for r in rows]).astype(np.int64)
        minima = np.concatenate([unpack(r["minima"]) for r in rows]).view(np.int64)
        first = np.cumsum(windows) - windows
        entry = np.full(int(max(number.max(), string.max())) + 1, -1, np.int64)
        entry[number] = np.arange(len(number))
        e = entry[string]
        place, start, e = place[e >= 0], start[e >= 0], e[e >= 0]
        n = windows[e]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        gone = minima[np.repeat(first[e], n) + step] < ranks[np.repeat(place, n)]
        place, at = np.repeat(place, n)[gone], (np.repeat(start, n) + step)[gone]
        if not len(at):
            return empty
        order = np.lexsort((at, place))
        place, at = place[order], at[order]
        new = np.ones(len(at), bool)
        new[1:] = (place[1:] != place[:-1]) | (at[1:] > at[:-1] + length)
        begins = np.flatnonzero(new)
        ends = np.append(begins[1:], len(at)) - 1
        owner, pairs = place[begins], np.stack([at[begins], at[ends] + length], axis=1)
        bounds = np.searchsorted(owner, np.arange(len(idents) + 1))
        some = np.flatnonzero(np.diff(bounds))
        return pa.Table.from_arrays([pa.array(idents[some]), pa.array([pairs[bounds[i] : bounds[i + 1]].tobytes() for i in some], pa.binary())], ["ident", "spans"])

    return run


def keyed(docs: DataFrame, doc_id: str, text: str):
    return docs.select(
        F.xxhash64(F.col(doc_id).cast("long"), F.col(text).cast("string"), F.lit(5)).alias("ident"),
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("rank"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )


def find_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 50, hot: int = HOT) -> DataFrame:
    """(ident, spans) of the documents that lose bytes; spans are pairs of 64-bit bounds in the UTF-8 bytes."""
    spark = docs.sparkSession
    ship(spark)
    with passing_tables(spark):
        return _written_spans(docs, doc_id, text, length, hot)


def _written_spans(docs: DataFrame, doc_id: str, text: str, length: int, hot: int) -> DataFrame:
    rows = keyed(docs, doc_id, text)
    sizes = written(rows.select("ident", "rank", F.octet_length("text").alias("size"), F.md5(F.col("text").cast("binary")).alias("content")), "texts")
    total = sizes.agg(F.sum("size")).first()[0] or 0
    bits = max(0, min(31, (total * 2 // (length - SEED + 2) // RANGE).bit_length()))
    least = sizes.where(F.col("size") >= length).groupBy("content").agg(F.min("rank").alias("least"), F.count("*").alias("many")).where("many > 1")
    copies = written(sizes.join(least, "content").where("rank > least").select("ident", F.col("size").cast("long").alias("size")).distinct(), "copies")

    asked = written(requests(rows.where(F.octet_length("text") >= length).select("ident", "text"), length, bits), "minimisers")
    schema = "chunk long, keys binary, places binary, df binary, nodes binary, sizes binary"
    answers = asked.where("range >= 0").select("range", "chunk", "keys", "places").groupBy("range").applyInArrow(count_range, schema)
    both = answers.select("chunk", "keys", "places", "df", F.col("nodes").alias("idents")).union(asked.where("range < 0").select("chunk", "keys", "places", F.lit(None).cast("binary").alias("df"), "idents"))
    shared = written(both.groupBy("chunk").applyInArrow(shared_keys, "ident long, keys binary, df binary"), "shared").dropDuplicates(["ident"])
    strings = shared.join(copies.select("ident"), "ident", "left_anti")
    many = strings.agg(F.sum(F.octet_length("keys") / 8)).first()[0] or 0
    groups = max(1, -(-int(many) // GROUP))
    texts = rows.select("ident", "rank", "text").join(strings, "ident")
    # repeated rows have one ident and one result
    pieces = written(shared_strings(texts, length, bits, groups, hot), "strings")
    result = "chunk long, number binary, windows binary, minima binary, idents binary, places binary, starts binary"
    found = pieces.where("group >= 0").select("group", "chunk", "strings", "lengths", "number", "low", "high").groupBy("group").applyInArrow(resolver(length), result)
    places = pieces.where("group < 0").select("chunk", "number", F.lit(None).cast("binary").alias("windows"), F.col("low").alias("minima"), "idents", "places", "starts")
    spans = found.union(places).groupBy("chunk").applyInArrow(span_finder(length), "ident long, spans binary")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [np.array([0, n], np.int64).tobytes() for n in batch.column("size").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("ident"), pa.array(pairs, pa.binary())], ["ident", "spans"])

    return written(spans.union(copies.mapInArrow(whole, "ident long, spans binary")).dropDuplicates(["ident"]), "spans", result=True)


def kept_bytes(text: bytes, spans: bytes | None) -> tuple[bytes, int, int]:
    """What stays of a text, how many bytes go, and in how many runs."""
    if not spans:
        return text, 0, 0
    pairs = np.frombuffer(spans, np.int64).reshape(-1, 2)
    parts, at = [], 0
    for a, b in pairs.tolist():
        parts.append(text[at:a])
        at = b
    parts.append(text[at:])
    return b"".join(parts), int((pairs[:, 1] - pairs[:, 0]).sum()), len(pairs)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 50, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of `docs`."""
    spans = find_spans(docs, doc_id, text, length, hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        for batch in slices(batches):
            texts = [t.encode() for t in batch.column("text").to_pylist()]
            kept = [kept_bytes(t, s) for t, s in zip(texts, batch.column("spans").to_pylist())]
            numbers = [pa.array(c, pa.int64()) for c in ([len(t) for t in texts], [k[1] for k in kept], [k[2] for k in kept])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *numbers, pa.array([hashlib.sha256(k[0]).hexdigest() for k in kept], pa.string())], names)

    rows = keyed(docs, doc_id, text).join(spans, "ident", "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cut_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: str = "n_chars", length: int = 50) -> DataFrame:
    """`docs` with all rows and columns, repeated passages cut from the text and `size`, if there, set to the characters left.

    A character that a cut goes through is dropped. Rows that lose nothing keep their text and size as they are.
    """
    ident, spans, cut, body = (free_name(docs, n) for n in ("_ident", "_spans", "_cut", "_text"))
    found = find_spans(docs, doc_id, text, length).select(F.col("ident").alias(ident), F.col("spans").alias(spans))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, body):
            pairs = zip(batch.column(body).to_pylist(), batch.column(spans).to_pylist())
            kept = [kept_bytes(t.encode(), s)[0].decode(errors="ignore") if s else t for t, s in pairs]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(kept, pa.string())], [*batch.schema.names[:-2], body])

    others = [c for c in docs.columns if c != text]
    key = F.xxhash64(F.col(doc_id).cast("long"), F.col(text).cast("string"), F.lit(5))
    rows = docs.withColumn(ident, key).join(found, ident, "left")
    rows = rows.select(*others, F.col(spans).isNotNull().alias(cut), F.col(text).cast("string").alias(body), spans)
    schema = T.StructType([*rows.schema.fields[:-2], T.StructField(body, T.StringType())])
    rows = rows.mapInArrow(run, schema)
    if size in others:
        left = F.length(body).cast(docs.schema[size].dataType)
        rows = rows.withColumn(size, F.when(F.col(cut), left).otherwise(F.col(size)))
    return rows.withColumnRenamed(body, text).select(docs.columns)
