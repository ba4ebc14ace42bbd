"""Language identification with hyperdimensional profiles.

Every letter owns a random vector of +1 and -1 (drawn from a seed and its code point, so all tasks agree). A letter
n-gram is bound from its letters' vectors, each permuted by its place, and a document is the bundle (the sum) of its
n-gram vectors. Languages are prototypes: the bundled, normalised vectors of their training documents, less what all
languages share. A document gets the language whose prototype has the highest cosine.

Letters are lower-cased Unicode letters; everything between words counts as one gap. Whole texts are read. A text that
is null or has no letter gets `und` and score 0. Ties go to the alphabetically first language. Repeated rows and null
ids are kept as they are. Without a training row every document is `und`. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionlens.llm.common import ship, written
from regionlens.llm.words import mix

DIMENSIONS = 1024
GRAM = 3
#: Training documents for each language, about; chosen by the hash of their text.
TRAINING_DOCUMENTS = 3000
#: Languages up to which their counts are broadcast.
LANGUAGES = 10_000
#: Distinct n-gram vectors that a worker keeps before it starts afresh.
REMEMBERED = 30_000
#: Documents bundled by one matrix product.
BLOCK = 32
_TABLES: dict[str, object] = {}


def letter_vectors(codes: np.ndarray, dimensions: int) -> np.ndarray:
    """The vectors of code points; 0 is the gap between words."""
    words = -(-dimensions // 64)
    seeds = mix(codes.astype(np.uint64)[:, None] * np.uint64(1_000_003) + np.arange(words, dtype=np.uint64)[None, :])
    bits = np.unpackbits(seeds.view(np.uint8), axis=1)[:, :dimensions]
    return (bits.astype(np.int8) << 1) - 1


def gram_vectors(grams: np.ndarray, dimensions: int, width: int = GRAM) -> np.ndarray:
    """Bound vectors of n-grams (21 bits a letter): the letters' vectors, rotated by their place and multiplied."""
    out = np.ones((len(grams), dimensions), np.int8)
    for place in range(width):
        codes, which = np.unique((grams >> (21 * place)) & 0x1FFFFF, return_inverse=True)
        out *= np.roll(letter_vectors(codes, dimensions), place, axis=1)[which]
    return out


def letters_of(text: str) -> np.ndarray:
    """Code points of the letters in order, with a 0 for each gap between words, at the beginning and at the end."""
    if "letters" not in _TABLES:
        points = range(0x110000)
        _TABLES["letters"] = np.fromiter((not 0xD800 <= c < 0xE000 and chr(c).isalpha() for c in points), bool, len(points))
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    codes[~_TABLES["letters"][codes]] = 0
    keep = np.empty(len(codes), bool)
    keep[0] = True
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    return codes[keep]


def grams_of(text: str, width: int = GRAM) -> np.ndarray:
    """All letter n-grams; a lone letter between gaps makes one."""
    codes = letters_of(text)
    if len(codes) < width:
        return np.zeros(0, np.int64)
    grams = np.zeros(len(codes) - width + 1, np.int64)
    for place in range(width):
        grams |= codes[place : len(codes) - width + 1 + place] << (21 * place)
    return grams


class Bundler:
    """Bundles documents; keeps the vectors of the n-grams it has met."""

    def __init__(self, dimensions: int = DIMENSIONS) -> None:
        self.dimensions = dimensions
        self.known = np.zeros(0, np.int64)
        self.vectors = np.zeros((0, dimensions), np.float32)

    def rows_of(self, grams: np.ndarray) -> np.ndarray:
        """Places of sorted distinct n-grams in the table."""
        at = np.searchsorted(self.known, grams)
        missing = grams[(at == len(self.known)) | (self.known[np.minimum(at, len(self.known) - 1)] != grams)] if len(self.known) else grams
        if len(missing):
            if len(self.known) + len(missing) > REMEMBERED:
                self.known, self.vectors, missing = np.zeros(0, np.int64), np.zeros((0, self.dimensions), np.float32), grams
            order = np.argsort(np.concatenate([self.known, missing]), kind="stable")
            self.vectors = np.concatenate([self.vectors, gram_vectors(missing, self.dimensions).astype(np.float32)])[order]
            self.known = np.concatenate([self.known, missing])[order]
            at = np.searchsorted(self.known, grams)
        return at

    def bundle(self, texts: list[str]) -> np.ndarray:
        """The summed n-gram vectors of each text; a zero vector without letters."""
        out = np.zeros((len(texts), self.dimensions), np.float32)
        for first in range(0, len(texts), BLOCK):
            counted = [np.unique(grams_of(t), return_counts=True) for t in texts[first : first + BLOCK]]
            grams = np.unique(np.concatenate([g for g, _ in counted]))
            if not len(grams):
                continue
            counts = np.zeros((len(counted), len(grams)), np.float32)
            for i, (g, n) in enumerate(counted):
                counts[i, np.searchsorted(grams, g)] = n
            at = self.rows_of(grams)
            out[first : first + len(counted)] = counts @ self.vectors[at]
        return out


def normalised(vectors: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)


def _bundler(dimensions: int) -> Bundler:
    return _TABLES.setdefault(("bundler", dimensions), Bundler(dimensions))


def text_slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def learn_prototypes(docs: DataFrame, training: Column, text: str = "text", lang: str = "lang", documents: int = TRAINING_DOCUMENTS, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """Languages in order and their normalised prototypes, from rows where `training` holds and the language is known."""
    ship(docs.sparkSession)
    rows = docs.where(training & F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    many = written(rows.groupBy("lang").agg(F.count("*").alias("many")), "languages")
    many = F.broadcast(many) if many.count() <= LANGUAGES else many
    share = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30) * F.col("many") < documents
    rows = rows.join(many, "lang").where(share & F.col("text").isNotNull()).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in text_slices(batches):
            vectors = normalised(_bundler(dimensions).bundle(batch.column("text").to_pylist()))
            for name, vector in zip(batch.column("lang").to_pylist(), vectors):
                sums[name] = sums.get(name, 0) + vector
        for name, vector in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * dimensions), pa.array(np.arange(dimensions), pa.int32()), pa.array(vector.astype(np.float64))], ["lang", "at", "value"])

    # one vector for each language: a table of codes, however many documents there are
    summed = rows.mapInArrow(run, "lang string, at int, value double").groupBy("lang", "at").agg(F.sum("value").alias("value"))
    found = summed.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("v")).orderBy("lang").select("lang", "v.value").collect()
    names = [r["lang"] for r in found]
    if not names:
        return [], np.zeros((0, dimensions), np.float32)
    prototypes = normalised(np.array([r["value"] for r in found]))
    if len(names) > 1:
        prototypes = prototypes - prototypes.mean(axis=0)
    return names, normalised(prototypes).astype(np.float32)


def identify(docs: DataFrame, names: list[str], prototypes: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row of `docs`; the score is the cosine, moved to 0 to 1."""
    ship(docs.sparkSession)
    dimensions = prototypes.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            vectors = normalised(_bundler(dimensions).bundle([t or "" for t in batch.column("text").to_pylist()]))
            found = vectors.any(axis=1) if names else np.zeros(len(vectors), bool)
            likeness = vectors @ prototypes.T if names else np.zeros((len(vectors), 1))
            best = likeness.argmax(axis=1)
            score = np.where(found, np.clip((likeness.max(axis=1) + 1) / 2, 0, 1), 0.0)
            labels = [names[b] if f else "und" for b, f in zip(best, found)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(labels, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(doc_id: str, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text falls into one part; a null id is in none."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary")) % parts == part, F.lit(False))


def predict_languages(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learned from the documents that are not held out, applied to all."""
    names, prototypes = learn_prototypes(docs, ~held_out("doc_id", 4, 2))
    out = identify(docs, names, prototypes)
    return out.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")
