"""Best-fit packing of token sequences with certified partitions.

Texts become token ids (`Encoder`); longer ones are cut into pieces of the capacity. Pieces of full length are
sequences by themselves. The others are dealt out to partitions of about `GROUP` pieces, each packed by best-fit
decreasing. Dual feasible functions give every partition a lower bound of its bin count; a partition that meets
it is certified. Partitions with a gap give up all bins that aren't full, certified ones the emptiest bin (the
remainder that rounding leaves), and what they give up is dealt out to fewer partitions and packed again, until a
single partition is left or a round saves nothing. Only lengths and row numbers are shuffled, never ids or texts.

Null and empty texts are one piece that holds the end id alone; repeated rows are pieces of their own; a null doc_id
stays null. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from regionlens.llm.common import ship, slices, written
from regionlens.llm.token_counts import byte_letters

#: Pieces wanted in a partition.
GROUP = 50_000
#: Exchange rounds at most; more of them never change which pieces are placed, only how tightly.
ROUNDS = 6
#: Words and chunks in a generation of what a worker remembers: memory and time depend on it, results don't.
REMEMBERED = 300_000
_LOADED: dict[str, Encoder] = {}


class Encoder:
    """Ids of whole texts for a lower-casing BPE with word ends, word by word: its merges never cross white space."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cut = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        letters = {b: c for c, b in byte_letters().items()}
        self.letters = [letters[b] for b in range(256)]
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            spelt = word if word.isascii() and word.isprintable() else "".join([self.letters[b] for b in word.encode()])
            ids = np.array([t.id for t in self.model.tokenize(spelt)], "<u4").tobytes()
            if len(self.words) >= REMEMBERED:
                self.words.clear()
            self.words[word] = ids
        return ids

    def chunk(self, chunk: str) -> bytes:
        ids = self.older.get(chunk)
        if ids is None:
            latin = max(chunk) < "ɐ"  # beyond it, the library's own tables of letters decide
            ids = b"".join(map(self.word, self.cut(chunk))) if latin and len(chunk) < 1000 else self.whole(chunk)
        if len(chunk) < 100:
            if len(self.chunks) >= REMEMBERED:
                self.older = dict(self.chunks)
                self.chunks.clear()
            self.chunks[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit numbers."""
        plain = text if text.isascii() else unicodedata.normalize("NFC", text)
        # special strings, the separators that only Python takes for white space, and the one letter that lower-cases by its place
        if any(s in plain for s in self.special) or any(c in plain for c in "\x1c\x1d\x1e\x1fΣ"):
            return self.whole(text)
        known = self.chunks
        return b"".join([known.get(c) or self.chunk(c) for c in plain.lower().split()])


def cut_pieces(docs: DataFrame, capacity: int, path: str, end_id: int, text: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _LOADED:
            _LOADED[path] = Encoder(path)
        encode, end, width = _LOADED[path].encode, np.array([end_id], "<u4").tobytes(), 4 * capacity
        for batch in slices(batches):
            out: list[tuple] = []
            for doc, value in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = encode(value or "") + end
                for piece, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    out.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = zip(*out) if out else [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each length, longest first, each into the fullest bin that still takes it."""
    bins = np.empty(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by room left
    rooms = 0  # bit r: there is a bin with room r
    count = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, count
            count += 1
        bins[i] = b
        left = room - size
        if left:
            open_bins[left].append(b)
            rooms |= 1 << left
    return bins


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs, by dual feasible functions: thresholds, and rounded multiples."""
    if not len(lengths):
        return 0
    sizes = np.arange(capacity + 1)
    many = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    best = -(-int((many * sizes).sum()) // capacity)
    total, weight = np.cumsum(many), np.cumsum(many * sizes)
    for e in range(1, capacity // 2 + 1):  # over capacity - e counts whole, under e counts nothing
        large = int(total[capacity] - total[capacity - e])
        middle = int(weight[capacity - e] - weight[e - 1])
        best = max(best, large + -(-middle // capacity))
    for k in range(1, 21):  # multiples of 1 / (k + 1) stay, all else is rounded down to a multiple of 1 / k
        scaled = (k + 1) * sizes
        value = np.where(scaled % capacity == 0, sizes * k, (scaled // capacity) * capacity)  # times k * capacity
        best = max(best, -(-int((many * value).sum()) // (k * capacity)))
    return best


def pack_group(length: np.ndarray, capacity: int, give_up: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Bins, offsets in them, whether a piece is given up, and whether the bin count is certified."""
    bins = best_fit_decreasing(length, capacity)
    order = np.lexsort((-length, bins))
    sums = np.cumsum(length[order]) - length[order]
    first = np.flatnonzero(np.diff(bins[order], prepend=-1))
    offset = np.empty(len(length), np.int64)
    offset[order] = sums - np.repeat(sums[first], np.diff(np.append(first, len(length))))
    fill = np.bincount(bins, weights=length)
    certified = len(fill) == lower_bound(length, capacity)
    given = np.zeros(len(length), bool)
    if give_up and len(fill):
        given = bins == np.argmin(fill) if certified else fill[bins] < capacity
        if certified and fill.min() == capacity:
            given[:] = False
    return bins, offset, given, certified


def _packer(capacity: int, turn: int, final: bool):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("uid")
        bins, offset, given, certified = pack_group(frame["length"].to_numpy(), capacity, not final)
        sequence = (turn << 58) + (int(frame["part"].iloc[0]) << 24) + bins
        return frame[["uid", "length"]].assign(sequence_id=sequence, offset=offset, given=given, certified=certified)

    return run


def pack_pieces(pieces: DataFrame, capacity: int, group: int = GROUP) -> DataFrame:
    """(uid, sequence_id, offset) for pieces (uid, length) shorter than the capacity, each once."""
    ship(pieces.sparkSession)
    placed, pool, last = None, pieces, None
    for turn in range(ROUNDS):
        n = pool.count()
        groups = max(1, -(-n // group))
        final = groups == 1 or n == last or turn == ROUNDS - 1

        part = F.pmod(F.xxhash64("uid", F.lit(turn)), F.lit(groups)).alias("part")
        packed = pool.select("uid", "length", part).groupBy("part").applyInPandas(_packer(capacity, turn, final), "uid long, length long, sequence_id long, offset long, given boolean, certified boolean")
        packed = written(packed, f"packed-{turn}")
        done = packed.where("not given")
        placed = done if placed is None else placed.union(done)
        if final:
            break
        last, pool = n, packed.where("given").select("uid", "length")
    return placed.select("uid", "sequence_id", "offset")


def pack_documents(docs: DataFrame, capacity: int = 2048, path: str | None = None, end_id: int = 0, text: str = "text", group: int = GROUP) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every row of `docs`.

    Sequences of the first rounds have ids from 0 on; a piece of full length is a sequence with a negative id.
    """
    pieces = cut_pieces(docs, capacity, path or public_tokenizers.path("word_bpe_49k.json"), end_id, text)
    pieces = written(pieces.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    full = pieces.where(F.col("length") == capacity).select(*columns, (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    short = pieces.where(F.col("length") < capacity)
    placed = pack_pieces(short.select("uid", "length"), capacity, group)
    return full.union(short.join(placed, "uid").select(*columns, "sequence_id", "offset"))
