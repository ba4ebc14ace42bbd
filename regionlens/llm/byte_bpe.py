"""Byte-level BPE by recursive queries over token positions, and decoding by ordered aggregation.

A text is cut into words by the vocabulary's pattern; merges never cross words, so each distinct word of a partition is
encoded once. A word that is a vocabulary entry is that token. All others start as one row per byte (word, place,
token). In every round the rows join the merge table with their next token, each word contracts its pair of least rank,
the leftmost one first, and words without a pair in the table drop out. The rows of a word's last round are its tokens.

One round may contract several places of a word at once only where that is the same as one after the other: all
places of the pair of least rank, from the left and without overlap, if no pair with the merged token ranks below it.
The other merges of the table are marked `alone` and contract one place a round.

The queries run in an in-memory DuckDB of the Python worker: no server, no file. What a query holds is bounded by `ROWS`
rows over all its rounds; longer words get fewer rounds a query and go on in the next one.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import islice
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regionlens.llm.common import ship, slices

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Words a worker remembers; bytes of new words in a query; rows of a query over all its rounds; tokens decoded in a query.
REMEMBERED, WORD_BYTES, ROWS, DECODED = 450_000, 600_000, 12_000_000, 300_000
#: Text bytes whose new words are encoded together, as a round costs much the same for few words; text bytes of a batch that is handed on.
GROUP, SLICE = 8 << 20, 2 << 20
#: Some bytes three times in a row; words longer than LOOKED_AT are taken to have such a place without a search.
THRICE, LOOKED_AT = re.compile(rb"(.+?)\1\1", re.DOTALL), 48

_PAIRS = """
WITH RECURSIVE state AS (
    SELECT word, place, token, 0 AS round FROM fresh
    UNION ALL
    (WITH paired AS MATERIALIZED (
        SELECT s.word, s.place, s.token, s.round, s.behind, s.token = s.next AS twin, m.merged, m.alone
        FROM (SELECT *, lead(place) OVER own AS behind, CASE WHEN lead(word) OVER own = word THEN lead(token) OVER own END AS next
              FROM state WHERE round < $rounds WINDOW own AS (ORDER BY place)) s
        LEFT JOIN merges m ON m.pair = CAST(s.token AS BIGINT) * $size + s.next),
    best AS (
        SELECT word, min(merged) AS least, min(CAST(merged AS BIGINT) * 4294967296 + place) % 4294967296 AS leftmost
        FROM paired WHERE merged IS NOT NULL GROUP BY word),
    hits AS MATERIALIZED (
        SELECT word, place, behind, token, round, merged, twin, coalesce(merged = least AND (NOT alone OR place = leftmost), false) AS hit
        FROM paired JOIN best USING (word))
"""
_LAST = """
SELECT word, last = $rounds AS open, list(token ORDER BY place) AS ids
FROM state JOIN (SELECT word, max(round) AS last FROM state GROUP BY word) USING (word)
WHERE round = last GROUP BY word, last
"""
#: A hit takes in the row behind it. Hits can only overlap where a token stands three times in a row.
MERGE = _PAIRS + """
    SELECT word, place, CASE WHEN hit THEN merged ELSE token END, round + 1
    FROM hits ANTI JOIN (SELECT behind AS place FROM hits WHERE hit) USING (place)))
""" + _LAST
#: For words with such places: of hits in a row the first, third, ... contract.
MERGE_RUNS = _PAIRS + """
    , islands AS (SELECT place, behind - place AS step, place - (behind - place) * row_number() OVER (ORDER BY place) AS island FROM hits WHERE hit AND twin),
    skipped AS (SELECT place FROM (SELECT place, row_number() OVER (PARTITION BY island, step ORDER BY place) AS i FROM islands) WHERE i % 2 = 0),
    taken AS MATERIALIZED (SELECT place, behind FROM hits WHERE hit AND place NOT IN (SELECT place FROM skipped))
    SELECT word, place, CASE WHEN hit AND place NOT IN (SELECT place FROM skipped) THEN merged ELSE token END, round + 1
    FROM hits WHERE place NOT IN (SELECT behind FROM taken)))
""" + _LAST

DECODE = """
SELECT row, string_agg(hex, '' ORDER BY place) AS hex, count(*) - count(hex) AS unknown
FROM tokens LEFT JOIN vocabulary USING (id) GROUP BY row
"""


def ranks_of(path: str) -> dict[bytes, int]:
    """A rank file: base64 of a token's bytes and its rank on each line."""
    lines = map(bytes.split, Path(path).read_bytes().splitlines())
    return {base64.b64decode(token): int(rank) for token, rank in filter(None, lines)}


def merge_table(ranks: dict[bytes, int]) -> tuple[pa.Table, int]:
    """(pair, merged, alone) for all two tokens that make a third one, and the number that a pair counts its first token by."""
    size = max(ranks.values(), default=0) + 1
    found = [
        (ranks[token[:i]], ranks[token[i:]], rank)
        for token, rank in ranks.items() for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks
    ]
    left, right, merged = np.array(found, np.int64).reshape(-1, 3).T
    least = np.full(size, size)  # of the pairs that a token is part of
    np.minimum.at(least, left, merged)
    np.minimum.at(least, right, merged)
    columns = [pa.array(left * size + right), pa.array(merged.astype(np.int32)), pa.array(least[merged] <= merged)]
    return pa.Table.from_arrays(columns, ["pair", "merged", "alone"]), size


class Numbers(dict):
    """Words by number, in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


class Codec:
    """Encodes and decodes with one rank file in an in-memory database."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN) -> None:
        self.ranks = ranks_of(path)
        self.cut = regex.compile(pattern).findall
        merges, self.size = merge_table(self.ranks)
        self.width = np.zeros(self.size, np.int64)
        self.width[list(self.ranks.values())] = list(map(len, self.ranks))
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.words, self.known = Numbers(), []  # words by number, and the tokens of each number as 32-bit numbers
        self.base = duckdb.connect(":memory:")
        self.base.execute("SET threads = 1; SET memory_limit = '512MB'; SET temp_directory = ''")
        self.base.register("given", merges)
        self.base.execute("CREATE TABLE merges AS SELECT * FROM given")
        self.base.register("given", pa.table({"id": pa.array(list(self.ranks.values()), pa.int32()), "hex": [t.hex() for t in self.ranks]}))
        self.base.execute("CREATE TABLE vocabulary AS SELECT * FROM given")
        self.base.unregister("given")

    def query(self, sql: str, name: str, given: pa.Table, **values: int) -> pa.Table:
        self.base.register(name, given)
        out = self.base.sql(sql, params=values or None).to_arrow_table()
        self.base.unregister(name)
        return out

    def merged(self, words: list[bytes]) -> list[bytes]:
        """The tokens of words that are no vocabulary entries, as 32-bit numbers; long words may go on in further queries."""
        out = [b""] * len(words)
        repeating = [len(w) > LOOKED_AT or len(set(w)) + 2 <= len(w) and THRICE.search(w) is not None for w in words]
        for query, chosen in ((MERGE, False), (MERGE_RUNS, True)):
            numbers = [i for i, r in enumerate(repeating) if r == chosen]
            lengths = [len(words[i]) for i in numbers]
            tokens = self.single[np.frombuffer(b"".join(words[i] for i in numbers), np.uint8)]
            while numbers:
                width = self.width[tokens]  # places are counted in bytes, also when a word goes on
                fresh = pa.table({"word": np.repeat(np.array(numbers, np.int32), lengths), "place": np.cumsum(width) - width, "token": tokens})
                found = self.query(query, "fresh", fresh, rounds=max(2, ROWS // len(tokens)), size=self.size).combine_chunks()
                numbers, lengths, rest = [], [], []
                for batch in found.to_batches():
                    ids = batch.column("ids")
                    flat = ids.flatten().to_numpy().astype(np.int32)
                    bounds = np.append(0, np.cumsum(ids.value_lengths().to_numpy())).tolist()
                    whole = flat.tobytes()
                    for word, more, start, stop in zip(batch.column("word").to_pylist(), batch.column("open").to_pylist(), bounds, bounds[1:]):
                        if more:
                            numbers.append(word)
                            lengths.append(stop - start)
                            rest.append(flat[start:stop])
                        else:
                            out[word] = whole[4 * start : 4 * stop]
                tokens = np.concatenate(rest) if rest else tokens
        return out

    def learn(self, words: Iterable[str]) -> list[bytes]:
        """The tokens of each word as 32-bit numbers, found in queries of bounded size."""
        out: list[bytes] = []
        rest: list[tuple[int, bytes]] = []
        size = 0

        def flush() -> None:
            for (i, _), ids in zip(rest, self.merged([body for _, body in rest])):
                out[i] = ids

        for i, word in enumerate(words):
            body = word.encode()
            rank = self.ranks.get(body)
            out.append(b"" if rank is None else np.int32(rank).tobytes())
            if rank is None:
                if rest and size + len(body) > WORD_BYTES:
                    flush()
                    rest, size = [], 0
                rest.append((i, body))
                size += len(body)
        if rest:
            flush()
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as 32-bit numbers. Words seen before are looked up."""
        numbers = [array("i", map(self.words.__getitem__, self.cut(t))) for t in texts]
        self.known += self.learn(islice(self.words, len(self.known), None))  # the new words are the last ones
        ids = np.frombuffer(b"".join(self.known), np.int32)
        many = np.fromiter(map(len, self.known), np.int64, len(self.known)) // 4
        first = np.cumsum(many) - many
        out = []
        for n in numbers:
            own = np.frombuffer(n, np.int32)
            n_ids = many[own]
            shift = first[own] - np.cumsum(n_ids) + n_ids
            out.append(ids[np.repeat(shift, n_ids) + np.arange(len(own) and n_ids.sum())].tobytes())
        if len(self.known) > REMEMBERED:  # common words are among those of any texts
            used, words = sorted(set().union(*numbers)), list(self.words)
            self.words, self.known = Numbers((words[i], k) for k, i in enumerate(used)), [self.known[i] for i in used]
        return out

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> list[bytes]:
        """The bytes of rows of ids that lie behind each other."""
        out = [b""] * len(lengths)
        tokens = pa.table({"row": np.repeat(np.arange(len(lengths), dtype=np.int32), lengths), "place": np.arange(len(ids), dtype=np.int32), "id": ids})
        found = self.query(DECODE, "tokens", tokens)
        for row, text, unknown in zip(*(found.column(c).to_pylist() for c in ("row", "hex", "unknown"))):
            if unknown:
                raise ValueError(f"{unknown} ids are not in the vocabulary")
            out[row] = bytes.fromhex(text)
        return out


@cache
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids) of every row of `docs`, repeated rows included, over its whole text and without special tokens.

    Null and empty texts have an empty array; a null id stays null. Other columns of `docs` are not read.
    `path`: the rank file, on every executor.
    """
    ship(docs.sparkSession)
    file = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(file)
        for group in slices(batches, limit=GROUP):
            encoded = iter(own.encode(pc.fill_null(group.column("text"), "").to_pylist()))
            for batch in slices(iter([group]), limit=SLICE):
                ids = list(islice(encoded, batch.num_rows))
                bounds = np.cumsum([0, *map(len, ids)]) // 4
                flat = np.frombuffer(b"".join(ids), np.int32)
                arrays = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), arrays], ["doc_id", "ids"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """All rows and columns of `encoded` with the bytes that their ids stand for in a new column; null ids give no bytes.

    An id that the vocabulary doesn't have, a null one too, is an error.
    """
    ship(encoded.sparkSession)
    file = path or public_tokenizers.path(VOCABULARY)
    if name in encoded.columns:
        raise ValueError(f"there is a column {name} already")
    at = encoded.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(file)
        for batch in batches:
            lengths = pc.fill_null(pc.list_value_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
            start = 0
            while start < len(lengths):  # as many rows as have about DECODED tokens, one at least
                many = max(1, int(np.searchsorted(np.cumsum(lengths[start:]), DECODED, side="right")))
                part = batch.slice(start, many)
                flat = pc.list_flatten(part.column(at))
                out = own.decode(flat.to_numpy(zero_copy_only=False) if not flat.null_count else np.array([-1]), lengths[start : start + many])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], [*part.schema.names, name])
                start += many

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField(name, T.BinaryType())]))


def digests(decoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of what `encode` and `decode` give."""
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
