"""Toxicity by a convolutional text classifier, trained in numpy, with thresholds calibrated by language.

Words are lower-cased (A-Z), stripped of punctuation at their ends and hashed into embedding tables: one for the
whole word, others for its first bytes, so that forms of a stem share weight. Filters of several widths run over the
summed embeddings of the whole text, their largest responses are pooled, and a logistic layer gives a probability.
Gradients only flow through the pooled places, so training is cheap. It runs on all labelled rows: they are dealt out to
parts of bounded size by the hash of id and text, in every epoch each part goes on from the same classifier in a task of its
own, and what the parts have made of it is averaged, each row of a table over the parts that met it.

Every fifth text of a part is kept out of training to choose a threshold for each language. The language is guessed from the
text by a hashed word table of the same texts, never taken from a column. A probability is then bent so that its
language's threshold becomes `CUT`: score >= CUT means toxic in every language.

Null and empty texts, and texts without words, get the score 0. Repeated rows and null ids are kept.
Without both labels among the texts every score is 0. An empty table gives no rows.
"""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionlens.llm.common import give_back, ship, slices, written
from regionlens.llm.language_id import held_out
from regionlens.llm.words import byte_values, mix, powers, text_bytes, word_spans
from regionlens.operators.joins import sorted_side
from regionlens.session import passing_tables, shuffles_removed

CUT = 0.7
#: Words of a part of the labelled texts, about: what a task holds while it trains.
PART_WORDS = 3_000_000
#: Rows of an embedding table that are averaged together, and steps of a probability that thresholds can tell apart.
BLOCK_ROWS, STEPS = 1 << 13, 1 << 16
WORD_ROWS, HEAD_ROWS, HEAD_BYTES = 1 << 16, 1 << 16, (5, 6)
DIMENSIONS, FILTERS, WIDTHS = 12, 8, (1, 2, 3)
EPOCHS, BATCH, RATE = 8, 32, 0.15
#: Text bytes that are scored at a time; features and answers take some sixty times as much.
SCORED_BYTES = 1 << 20
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True


def word_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every word its row in the word table and its rows in the table of beginnings; for each text the bounds of its words."""
    data, offsets = text_bytes(column)
    starts, ends, bounds = word_spans(data, offsets)
    if not len(starts):
        return np.zeros(0, np.int32), np.zeros((0, len(HEAD_BYTES)), np.int32), bounds
    for _ in range(3):
        ends = np.where((ends - starts > 1) & _PUNCTUATION[data[ends - 1]], ends - 1, ends)
    starts = np.where((ends - starts > 1) & _PUNCTUATION[data[starts]], starts + 1, starts)
    power, inverse = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(byte_values()[data] * power[: len(data)], out=sums[1:])
    word = mix((sums[ends] - sums[starts]) * inverse[starts]) % np.uint64(WORD_ROWS)
    heads = [mix((sums[np.minimum(ends, starts + n)] - sums[starts]) * inverse[starts] + np.uint64(n)) % np.uint64(HEAD_ROWS) for n in HEAD_BYTES]
    return word.astype(np.int32), np.stack(heads, axis=1).astype(np.int32), bounds


@dataclass
class Classifier:
    """Embeddings, filters, and the calibration by language."""

    word: np.ndarray
    head: np.ndarray
    filters: dict[int, np.ndarray]  # by width: (width, dimensions, filters)
    bias: dict[int, np.ndarray]
    out: np.ndarray
    shift: float
    languages: list[str] = field(default_factory=list)
    language_table: np.ndarray | None = None  # (word rows, languages): log odds
    thresholds: np.ndarray | None = None
    empty: bool = False

    def embedded(self, word: np.ndarray, head: np.ndarray) -> np.ndarray:
        out = self.word[word]
        for k in range(head.shape[1]):
            out += self.head[head[:, k]]
        return out

    def pooled(self, word: np.ndarray, head: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The largest responses of all filters in each text, 0 at least."""
        texts, pad = len(bounds) - 1, max(WIDTHS) - 1
        result = np.zeros((texts, FILTERS * len(WIDTHS)), np.float32)
        some = np.flatnonzero(np.diff(bounds) > 0)
        if not len(some):
            return result
        many = np.diff(bounds)[some]
        place = np.arange(many.sum()) + np.repeat(np.arange(len(some)) * pad, many)  # with `pad` zero rows behind each text
        rows = np.zeros((int(many.sum()) + pad * len(some), DIMENSIONS), np.float32)
        rows[place] = self.embedded(word, head)
        first = np.cumsum(many) - many
        for j, width in enumerate(WIDTHS):
            answer = rows[place] @ self.filters[width][0]
            for k in range(1, width):
                answer += rows[place + k] @ self.filters[width][k]
            result[some, j * FILTERS : (j + 1) * FILTERS] = np.maximum(np.maximum.reduceat(answer, first) + self.bias[width], 0)
        return result

    def probabilities(self, word: np.ndarray, head: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.pooled(word, head, bounds) @ self.out + self.shift).astype(np.float64)))

    def language_of(self, word: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The likeliest language of each text; 0 without words."""
        sums = np.zeros((len(word) + 1, len(self.languages)))
        np.cumsum(self.language_table[word], axis=0, out=sums[1:])
        return (sums[bounds[1:]] - sums[bounds[:-1]]).argmax(axis=1)

    def scores(self, word: np.ndarray, head: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        if self.empty:
            return np.zeros(len(bounds) - 1)
        p, t = self.probabilities(word, head, bounds), self.thresholds[self.language_of(word, bounds)]
        bent = np.clip(np.where(p < t, CUT * p / t, CUT + (1 - CUT) * (p - t) / (1 - t)), 0, 1)
        return np.where(np.diff(bounds) > 0, bent, 0.0)


@dataclass
class Course:
    """A classifier in training, and the squared gradients of its parameters so far."""

    model: Classifier
    seen: dict[str, np.ndarray]
    dense: dict[str, np.ndarray]
    shift_seen: float = 1e-3

    def arrays(self) -> dict[str, np.ndarray]:
        """The small parameters, which every part changes."""
        model = self.model
        return {**{f"filters {w}": model.filters[w] for w in WIDTHS}, **{f"bias {w}": model.bias[w] for w in WIDTHS}, "out": model.out}

    def vector(self) -> np.ndarray:
        """The small parameters and their squared gradients, one behind the other."""
        flat = [*(a.ravel() for a in self.arrays().values()), *(self.dense[k].ravel() for k in self.arrays())]
        return np.concatenate([*flat, [self.model.shift, self.shift_seen]]).astype(np.float64)

    def take(self, vector: np.ndarray) -> None:
        at = 0
        for array in (*self.arrays().values(), *(self.dense[k] for k in self.arrays())):
            array[...] = vector[at : at + array.size].reshape(array.shape)
            at += array.size
        self.model.shift, self.shift_seen = float(vector[at]), float(vector[at + 1])


def begin(draw: np.random.Generator) -> Course:
    normal = lambda *shape, scale: draw.normal(0, scale, shape).astype(np.float32)
    model = Classifier(
        normal(WORD_ROWS, DIMENSIONS, scale=0.1),
        normal(HEAD_ROWS, DIMENSIONS, scale=0.1),
        {w: normal(w, DIMENSIONS, FILTERS, scale=0.3) for w in WIDTHS},
        {w: np.zeros(FILTERS, np.float32) for w in WIDTHS},
        normal(FILTERS * len(WIDTHS), scale=0.3),
        0.0,
    )
    course = Course(model, {"word": np.full(WORD_ROWS, 1e-3, np.float32), "head": np.full(HEAD_ROWS, 1e-3, np.float32)}, {})
    course.dense = {k: np.full(a.shape, 1e-3, np.float32) for k, a in course.arrays().items()}
    return course


def train(course: Course, texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weight: np.ndarray, order: np.ndarray, rate: float) -> None:
    """One epoch over the texts in `order`, given as (word rows, head rows); `course` is changed in place."""
    model = course.model

    def step(name: str, array: np.ndarray, gradient: np.ndarray) -> None:
        course.dense[name] += gradient**2
        array -= rate * gradient / np.sqrt(course.dense[name])

    for at in range(0, len(order), BATCH):
        batch = [i for i in order[at : at + BATCH] if len(texts[i][0])]
        if not batch:
            continue
        many = np.array([len(texts[i][0]) for i in batch])
        bounds = np.concatenate([[0], np.cumsum(many)])
        word, head = (np.concatenate([texts[i][k] for i in batch]) for k in (0, 1))
        rows = np.concatenate([model.embedded(word, head), np.zeros((2, DIMENSIONS), np.float32)])
        end = np.repeat(bounds[1:], many)
        chosen, pooled = {}, []
        for width in WIDTHS:
            answer = np.zeros((len(word), FILTERS), np.float32)
            for k in range(width):
                inside = (np.arange(len(word)) + k < end)[:, None]
                answer += np.where(inside, rows[k : len(word) + k] @ model.filters[width][k], 0)
            best = np.stack([answer[a:b].argmax(axis=0) + a for a, b in zip(bounds[:-1], bounds[1:])])
            chosen[width] = best
            pooled.append(answer[best, np.arange(FILTERS)] + model.bias[width])
        raw = np.concatenate(pooled, axis=1)
        hidden = np.maximum(raw, 0)
        p = 1 / (1 + np.exp(-(hidden @ model.out + model.shift)))
        error = ((p - labels[batch]) * weight[batch] / len(batch)).astype(np.float32)
        back = error[:, None] * model.out * (raw > 0)
        step("out", model.out, hidden.T @ error)
        course.shift_seen += float(error.sum()) ** 2
        model.shift -= rate * float(error.sum()) / course.shift_seen**0.5
        touched, slopes = [], []
        for j, width in enumerate(WIDTHS):
            part = back[:, j * FILTERS : (j + 1) * FILTERS]
            gradient = np.zeros_like(model.filters[width])
            for k in range(width):
                place = chosen[width] + k
                inside = place < bounds[1:][:, None]
                place = np.minimum(place, len(word) - 1)
                g = np.where(inside, part, 0)
                gradient[k] = np.einsum("bfd,bf->df", rows[place], g)
                touched.append(place.ravel())
                slopes.append((g[:, :, None] * model.filters[width][k].T[None]).reshape(-1, DIMENSIONS))
            step(f"filters {width}", model.filters[width], gradient)
            step(f"bias {width}", model.bias[width], part.sum(axis=0))
        touched, slopes = np.concatenate(touched), np.concatenate(slopes)
        for name, rows_of, table in (("word", word[:, None], model.word), ("head", head, model.head)):
            ids, which = np.unique(rows_of[touched].ravel(), return_inverse=True)
            total = np.zeros((len(ids), DIMENSIONS), np.float32)
            np.add.at(total, which, np.repeat(slopes, rows_of.shape[1], axis=0))
            course.seen[name][ids] += (total**2).mean(axis=1)
            table[ids] -= rate * total / np.sqrt(course.seen[name][ids])[:, None]


@dataclass
class Part:
    """The labelled texts of one part, in an order of its own that does not depend on how they arrive."""

    number: int
    texts: list[tuple[np.ndarray, np.ndarray]]
    labels: np.ndarray
    languages: list[str]

    @classmethod
    def of(cls, batches: Iterator[pa.RecordBatch]) -> Part | None:
        rows = [r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("word", "toxic", "lang", "head", "part")))]
        if not rows:
            return None
        rows.sort(key=lambda r: r[:3])
        rows = [rows[i] for i in np.random.default_rng(11).permutation(len(rows))]
        numbers = lambda data: np.frombuffer(data, "<u2").astype(np.int32)
        texts = [(numbers(r[0]), numbers(r[3]).reshape(-1, len(HEAD_BYTES))) for r in rows]
        return cls(rows[0][4], texts, np.array([r[1] for r in rows], np.int64), [r[2] for r in rows])

    @property
    def calibrating(self) -> np.ndarray:
        return np.arange(len(self.texts)) % 5 == 4


SPARSE = "block int, part int, ids binary, values binary"


def _sparse(rows: list[tuple[int, int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    packed = [(block, part, ids.astype("<u4").tobytes(), np.ascontiguousarray(values).tobytes()) for block, part, ids, values in rows]
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in packed], kind) for k, kind in enumerate(kinds)], ["block", "part", "ids", "values"])


def _combined(rows: DataFrame, blocks: int, kind: Callable[[int], str], mean: bool) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each block its ids and the sum or the mean of their values over the parts that have them.

    The parts of a block are added in their order in one task, a row at a time, so the result is the same in every run.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total, many = -1, np.zeros((0, 1)), np.zeros(0, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                block, ids = batch.column("block")[i].as_py(), np.frombuffer(batch.column("ids")[i].as_buffer(), "<u4")
                if not len(ids):
                    continue
                values = np.frombuffer(batch.column("values")[i].as_buffer(), kind(block)).reshape(len(ids), -1)
                short = int(ids.max()) + 1 - len(many)
                if short > 0:
                    total = np.concatenate([total if len(many) else np.zeros((0, values.shape[1])), np.zeros((short, values.shape[1]))])
                    many = np.concatenate([many, np.zeros(short, np.int64)])
                total[ids] += values  # no id comes twice in a row
                many[ids] += 1
        ids = np.flatnonzero(many)
        if len(ids):
            yield _sparse([(block, 0, ids, (total[ids] / many[ids][:, None] if mean else total[ids]).astype(kind(block)))])

    dealt = rows.repartitionById(blocks, "block").sortWithinPartitions("part")  # a block to a task
    with shuffles_removed(rows.sparkSession):
        found = dealt.mapInArrow(run, SPARSE).collect()  # as large as the tables, whatever the number of parts
    out = {}
    for r in found:
        ids = np.frombuffer(r["ids"], "<u4")
        out[r["block"]] = ids, np.frombuffer(r["values"], kind(r["block"])).reshape(len(ids), -1)
    return out


def _calibrated(model: Classifier, steps: list[tuple]) -> None:
    """For each language the threshold with the fewest errors, in the middle of its gap, drawn towards that of all languages.

    `steps`: language, step of the probability, toxic and clean texts there, least and largest probability.
    """

    def best(own: list[tuple]) -> float:
        at = sorted({s[1] for s in own})
        place = {n: i for i, n in enumerate(at)}
        toxic, clean = np.zeros(len(at)), np.zeros(len(at))
        least, largest = np.ones(len(at)), np.zeros(len(at))
        for _, n, bad, good, low, high in own:
            i = place[n]
            toxic[i] += bad
            clean[i] += good
            least[i], largest[i] = min(least[i], low), max(largest[i], high)
        errors = np.concatenate([[0], np.cumsum(toxic)]) + np.concatenate([np.cumsum(clean[::-1])[::-1], [0]])
        cuts = np.flatnonzero(errors == errors.min())
        middle = cuts[len(cuts) // 2]
        low, high = largest[middle - 1] if middle else 0.0, least[middle] if middle < len(at) else 1.0
        return float(np.clip((low + high) / 2, 0.05, 0.95))

    if not steps:
        model.thresholds = np.full(len(model.languages), 0.5)
        return
    general = best(steps)
    cuts = []
    for i in range(len(model.languages)):
        own = [s for s in steps if s[0] == i]
        trust = min(1.0, sum(s[2] for s in own) / 20)
        cuts.append(trust * best(own) + (1 - trust) * general if own else general)
    model.thresholds = np.array(cuts)


def _joined(texts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    bounds = np.concatenate([[0], np.cumsum([len(t[0]) for t in texts])]).astype(np.int64)
    return np.concatenate([t[0] for t in texts]), np.concatenate([t[1] for t in texts]), bounds


def labelled_features(docs: DataFrame, labels: DataFrame, training: Column, text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, toxic, lang, word, head) of every labelled row where `training` holds; rows of one id and text count once."""
    marks = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.where(training & F.col(text).isNotNull() & F.col("doc_id").isNotNull())
    rows = rows.select("doc_id", F.xxhash64(F.col(text).cast("string")).alias("content"), F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"))
    rows = rows.join(sorted_side(marks), "doc_id").dropDuplicates(["doc_id", "content"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in slices(batches, limit=SCORED_BYTES):
            word, head, bounds = word_features(batch.column("text"))
            parts = [(word[a:b].astype("<u2").tobytes(), head[a:b].astype("<u2").tobytes()) for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "toxic", "lang")), *(pa.array([p[k] for p in parts], pa.binary()) for k in (0, 1))], ["key", "toxic", "lang", "word", "head"])

    keyed = rows.select(F.xxhash64("doc_id", "content").alias("key"), "toxic", "lang", "text")
    return keyed.mapInArrow(run, "key long, toxic int, lang string, word binary, head binary")


def fit(docs: DataFrame, labels: DataFrame, training: Column, text: str = "text", lang: str = "lang", part_words: int = PART_WORDS, seed: int = 7) -> Classifier:
    """Train on all labelled rows where `training` holds, in parts of about `part_words` words."""
    ship(docs.sparkSession)
    with passing_tables(docs.sparkSession):
        features = written(labelled_features(docs, labels, training, text, lang), "labelled")
        return _fitted(features, part_words, seed)


def _fitted(features: DataFrame, part_words: int, seed: int) -> Classifier:
    context = features.sparkSession.sparkContext
    draw = np.random.default_rng(seed)
    course = begin(draw)
    model, state = course.model, draw.bit_generator.state
    words, kinds = features.agg(F.sum(F.octet_length("word") / 2), F.count_distinct("toxic")).first()
    if kinds < 2:
        model.empty = True
        return model
    parts = max(1, -(-int(words) // part_words))
    names = model.languages = sorted(r["lang"] for r in features.select("lang").distinct().collect())
    dealt = features.select(F.pmod("key", F.lit(parts)).cast("int").alias("part"), "toxic", "lang", "word", "head").repartitionById(parts, "part")
    numbers = {name: i for i, name in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """By language how often a text has a word, at most 10 times each, and in the block behind them the texts to train on of each label."""
        give_back()
        part = Part.of(batches)
        if part is None:
            return
        texts_of: dict[str, list[int]] = {}
        for i, name in enumerate(part.languages):
            texts_of.setdefault(name, []).append(i)
        for name, own in texts_of.items():  # one language at a time, however many there are
            counts = np.zeros(WORD_ROWS)
            for i in own:
                ids, many = np.unique(part.texts[i][0], return_counts=True)
                counts[ids] += np.minimum(many, 10)
            ids = np.flatnonzero(counts)
            yield _sparse([(numbers[name], 0, ids, counts[ids])])
        marks = np.bincount(part.labels[~part.calibrating], minlength=2).astype(np.float64)
        yield _sparse([(len(numbers), 0, np.arange(2), marks)])

    found = _combined(dealt.mapInArrow(count, SPARSE), len(names) + 1, lambda _: "<f8", False)
    clean, toxic = found[len(names)][1][:, 0].tolist()
    table = np.full((WORD_ROWS, len(names)), 0.1)
    for i in range(len(names)):
        if i in found:
            table[found[i][0], i] += found[i][1][:, 0]
    model.language_table = np.log(table / table.sum(axis=0)).astype(np.float32)

    tables = WORD_ROWS // BLOCK_ROWS, (WORD_ROWS + HEAD_ROWS) // BLOCK_ROWS
    kind = lambda block: "<f4" if block < tables[1] else "<f8"
    for epoch in range(EPOCHS):
        shared = context.broadcast(course)  # of fixed size
        rate = RATE * (1 - epoch / EPOCHS)

        def go_on(batches: Iterator[pa.RecordBatch], epoch: int = epoch, rate: float = rate, shared=shared) -> Iterator[pa.RecordBatch]:
            give_back()
            part = Part.of(batches)
            if part is None:
                return
            was, own = shared.value, copy.deepcopy(shared.value)
            bits = np.random.PCG64()
            bits.state = state
            draw = np.random.Generator(bits.jumped(part.number))
            chosen = np.flatnonzero(~part.calibrating)
            weight = np.where(part.labels == 1, 0.5 / max(1, toxic), 0.5 / max(1, clean)) * (toxic + clean)
            for _ in range(epoch + 1):
                order = draw.permutation(chosen)
            train(own, part.texts, part.labels, weight, order, rate)
            rows = []
            for first, name in ((0, "word"), (tables[0], "head")):
                now, before = (np.column_stack([getattr(c.model, name), c.seen[name]]) for c in (own, was))
                ids = np.flatnonzero((now != before).any(axis=1))
                for block in np.unique(ids // BLOCK_ROWS):
                    some = ids[ids // BLOCK_ROWS == block]
                    rows.append((first + int(block), part.number, some % BLOCK_ROWS, now[some]))
            small = own.vector()
            yield _sparse([*rows, (tables[1], part.number, np.arange(len(small)), small)])

        for block, (ids, values) in _combined(dealt.mapInArrow(go_on, SPARSE), tables[1] + 1, kind, True).items():
            if block == tables[1]:
                course.take(values[:, 0])
            else:
                name, at = ("word", block) if block < tables[0] else ("head", block - tables[0])
                getattr(model, name)[ids + at * BLOCK_ROWS] = values[:, :-1]
                course.seen[name][ids + at * BLOCK_ROWS] = values[:, -1]
        shared.destroy()

    shared = context.broadcast(model)

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        part = Part.of(batches)
        some = np.flatnonzero(part.calibrating) if part is not None else []
        if not len(some):
            return
        word, head, bounds = _joined([part.texts[i] for i in some])
        p, language = shared.value.probabilities(word, head, bounds), shared.value.language_of(word, bounds)
        yield pa.RecordBatch.from_arrays([pa.array(language, pa.int32()), pa.array(p, pa.float64()), pa.array(part.labels[some], pa.int32())], ["language", "p", "toxic"])

    rows = dealt.mapInArrow(answers, "language int, p double, toxic int")
    with shuffles_removed(features.sparkSession):
        steps = rows.groupBy("language", F.floor(F.col("p") * STEPS).cast("int").alias("step")).agg(
            F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"), F.min("p").alias("least"), F.max("p").alias("largest")
        )
        _calibrated(model, [tuple(r) for r in steps.collect()])  # at most `STEPS` rows for each language
    shared.destroy()
    return model


def score(docs: DataFrame, model: Classifier, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of every row of `docs`, over its whole text."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # tables of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in slices(batches, limit=SCORED_BYTES):
            scores = shared.value.scores(*word_features(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double").withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted): learned from labelled documents that are not held out, applied to all."""
    model = fit(docs, labels, ~held_out("doc_id", 3, 1))
    return score(docs, model).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `docs` whose text is not predicted toxic, with all their columns, in one pass over the table."""
    spark = docs.sparkSession
    model = fit(docs, labels, ~held_out("doc_id", 3, 1))
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for whole in batches:
            named = whole.rename_columns([f"c{i}" for i in range(whole.num_columns)])
            for batch in slices(iter([named]), f"c{at}", SCORED_BYTES):
                keep = shared.value.scores(*word_features(batch.column(f"c{at}"))) < CUT
                yield batch.filter(pa.array(keep)).rename_columns(whole.schema.names)

    return docs.mapInArrow(run, docs.schema)
