"""Fill-in-middle samples: documents cut at two token bounds and written as prefix, suffix and middle.

Tokens are runs of other characters with the white space before them; white space at the end of a text is a token of
its own. Cutting needs the number of tokens first and then the places of two of them. Both come from chunks:

1. A rolling hash over the bytes ends a chunk wherever its upper bits are zero, so that copies and near-copies are
   cut into the same chunks. Chunks have `SMALLEST` to `LARGEST` bytes (the last one of a text may be shorter).
2. What a chunk adds is summed up in a few numbers: token ends inside it, whether its first and last byte belong to a
   token, and its code points. The summary is remembered under the chunk's content itself, so that a chunk is only taken
   for another one if all its bytes are the same.
3. Summaries combine: a token ends between two chunks if the left one ends inside a token and the right one begins
   with white space. Running sums give the count of a document and the chunk that holds a cut; only that chunk is read.

A worker remembers at most `REMEMBERED` bytes of chunks besides those of the slice at hand. Texts are read whole and once; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionlens.llm.common import ship, slices
from regionlens.llm.words import mix, text_bytes

#: Bytes of a chunk: about 2 ** BITS more than the smallest on average.
SMALLEST, BITS, LARGEST = 64, 8, 2048
#: Bytes that the rolling hash sees.
WINDOW = 32
REMEMBERED = 24 << 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

_BLANK = frozenset(b" \t\n\x0b\x0c\r")
_RUN = re.compile(rb"[^\x20\x09-\x0D]+")
_INNER_BYTES = bytes(range(0x80, 0xC0))  # second and later bytes of a character
_GEAR = (mix(np.arange(256, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def chunk_ends(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sorted ends of the chunks of all texts, whose bytes lie behind each other in `data`."""
    rolled = _GEAR[data]
    width = 1
    while width < WINDOW:  # hashes of twice the width from two of this width
        rolled[width:] += rolled[:-width] << np.uint32(width)
        width *= 2
    found = np.flatnonzero(rolled >> np.uint32(32 - BITS) == 0) + 1
    bounds = offsets[np.searchsorted(offsets, found, side="right") - 1]
    found = found[found - bounds >= SMALLEST]
    found = found[np.diff(found, prepend=-SMALLEST) >= SMALLEST]
    ends = np.union1d(found, offsets)
    steps = -(-np.diff(ends, prepend=0) // LARGEST)
    if (steps > 1).any():  # no bound for long: one every LARGEST bytes
        first = np.append(0, ends[:-1])
        inside = np.arange(steps.sum()) - np.repeat(np.cumsum(steps) - steps, steps) + 1
        cut = np.minimum(np.repeat(first, steps) + inside * LARGEST, np.repeat(ends, steps))
        ends = np.union1d(cut, offsets)
    return ends[ends > 0]


class Summaries:
    """Token ends inside a chunk, begins in a token, ends in a token, code points; remembered by content."""

    def __init__(self, limit: int = REMEMBERED) -> None:
        self.limit, self.size = limit, 0
        self.known: dict[bytes, tuple[int, bool, bool, int]] = {}

    def of(self, chunk: bytes) -> tuple[int, bool, bool, int]:
        known = self.known.get(chunk)
        if known is None:
            runs, opens = len(chunk.split()), chunk[-1] not in _BLANK
            known = (runs - opens, chunk[0] not in _BLANK, opens, len(chunk.translate(None, _INNER_BYTES)))
            self.known[chunk] = known
            self.size += len(chunk)
        return known

    def forget(self) -> None:
        if self.size > self.limit:
            self.known.clear()
            self.size = 0


class Cutter:
    """Counts the tokens of the texts of a column and finds where a token ends."""

    def __init__(self, column: pa.Array, memory: Summaries) -> None:
        data, self.offsets = text_bytes(column)
        self.whole = data.tobytes()
        self.ends = chunk_ends(data, self.offsets)
        self.starts = np.append(0, self.ends[:-1])
        memory.forget()
        rows = [memory.of(self.whole[a:b]) for a, b in zip(self.starts.tolist(), self.ends.tolist())]
        table = np.array(rows, np.int64).reshape(-1, 4)
        self.closed, begins, opens, chars = table.T
        last = np.isin(self.ends, self.offsets)
        follows = np.append(begins[1:], 0).astype(bool)
        between = opens.astype(bool) & (last | ~follows)
        self.total = np.cumsum(self.closed + between)  # token ends up to the end of each chunk
        self.chars = np.cumsum(chars)
        #: Chunks before each text, and the sums up to there.
        self.first = np.searchsorted(self.ends, self.offsets, side="right")
        self.base = np.append(0, self.total)[self.first]
        self.base_chars = np.append(0, self.chars)[self.first]
        tail = np.zeros(len(self.offsets) - 1, np.int64)
        some = np.flatnonzero(np.diff(self.offsets))
        tail[some] = 1 - opens[self.first[some + 1] - 1]
        self.counts = np.diff(self.base) + tail

    def text(self, row: int) -> bytes:
        return self.whole[self.offsets[row] : self.offsets[row + 1]]

    def place(self, row: int, k: int) -> tuple[int, int]:
        """The bytes and the code points of the first `k` tokens of a text."""
        if k == 0:
            return 0, 0
        if k == self.counts[row]:
            return int(self.offsets[row + 1] - self.offsets[row]), int(self.base_chars[row + 1] - self.base_chars[row])
        chunk = int(np.searchsorted(self.total, self.base[row] + k))
        start, before = int(self.starts[chunk]), int(chunk > 0 and self.total[chunk - 1])
        inside = int(self.base[row]) + k - before
        body = self.whole[start : self.ends[chunk]]
        if inside <= self.closed[chunk]:
            body = body[: next(islice(_RUN.finditer(body), inside - 1, None)).end()]
        chars = int(chunk > 0 and self.chars[chunk - 1]) + len(body.translate(None, _INNER_BYTES))
        return start + len(body) - int(self.offsets[row]), chars - int(self.base_chars[row])


def draws(seed: int, ident: int | None) -> list[int]:
    """Four numbers that the seed and the id decide."""
    digest = hashlib.sha256(f"{seed}:{'' if ident is None else ident}".encode()).hexdigest()
    return [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]


def fill_in_middle(
    docs: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row of `docs`, repeated rows included.

    `rate` percent of the documents are cut at two token bounds, `spm_rate` percent of these in the form `spm`, else
    `psm`. Documents that are empty, hold a marker or are not drawn are `plain`: the output is the text, and the
    lengths of the parts are null. A null text counts as empty; a null id draws as the empty string and stays null.
    Other columns of `docs` are not read.
    """
    ship(docs.sparkSession)
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Summaries()
        for batch in slices(batches):
            cutter = Cutter(batch.column("text"), memory)
            rows = []
            for i, (ident, n) in enumerate(zip(batch.column("doc_id").to_pylist(), cutter.counts.tolist())):
                body = cutter.text(i)
                h1, h2, h3, h4 = draws(seed, ident)
                if not body or h3 % 100 >= rate or p in body or s in body or m in body:
                    rows.append((ident, n, "plain", None, None, body))
                    continue
                low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
                (a, before), (b, upto) = cutter.place(i, low), cutter.place(i, high)
                parts = (s, body[b:], p, body[:a], m, body[a:b]) if h4 % 100 < spm_rate else (p, body[:a], s, body[b:], m, body[a:b])
                rows.append((ident, n, "spm" if parts[0] is s else "psm", before, upto - before, b"".join(parts)))
            *columns, output = zip(*rows) if rows else [()] * 6
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(output, pa.binary()).cast(pa.string())], names)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. No part holds a marker, so the markers alone tell the parts."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    spm = F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "spm", spm).when(form == "psm", F.concat(parts[1], parts[3], parts[2])).otherwise(output)


def digests(samples: DataFrame) -> DataFrame:
    """Samples with the digest of the output and of the text rebuilt from it in place of the output."""
    rows = samples.withColumn("restored", restored(F.col("output"), F.col("form")))
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"),
    )


SQL = r"""
WITH texts AS (
    SELECT doc_id, coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens,
        sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest
    FROM documents),
drawn AS (
    SELECT doc_id, text, tokens, len(tokens) AS n,
        CAST('0x' || substr(digest, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(digest, 9, 8) AS BIGINT) AS h2,
        CAST('0x' || substr(digest, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(digest, 25, 8) AS BIGINT) AS h4
    FROM texts),
formed AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50
            THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
    FROM drawn),
cut AS (
    SELECT *, array_to_string(list_slice(tokens, 1, low), '') AS prefix,
        array_to_string(list_slice(tokens, low + 1, high), '') AS middle,
        array_to_string(list_slice(tokens, high + 1, n), '') AS suffix
    FROM formed)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
    CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
        ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM cut
"""
