"""Held-out accuracy of the two models, and their rules for odd rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from regionlens.llm import toxicity
from regionlens.llm.language_id import Bundler, gram_vectors, grams_of, held_out, identify, learn_prototypes, predict_languages
from regionlens.llm.toxicity import drop_toxic, score_documents, word_features


def test_bundle_is_the_sum_of_bound_vectors():
    text = "Ab, abab! Über"
    by_hand = np.zeros(1024)
    for gram in grams_of(text):
        by_hand += gram_vectors(np.array([gram]), 1024)[0]
    assert np.array_equal(Bundler().bundle([text, "", "12 !"])[0], by_hand.astype(np.float32))
    assert not Bundler().bundle(["", "12 !"]).any()


def test_rare_vectors_are_nearly_orthogonal():
    a = gram_vectors(np.unique(grams_of("the quick brown fox jumps")), 1024).astype(float)
    likeness = a @ a.T / 1024
    assert np.abs(likeness - np.eye(len(a))).max() < 0.2


def test_languages_held_out(spark, folder):
    docs = spark.read.parquet(f"{folder.replace('sf0.001', 'sf0.01')}/documents.parquet")
    out = predict_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(out) > 200 and (out["lang"] == out["lang_pred"]).mean() > 0.97
    assert out["score"].between(0, 1).all()


def test_languages_odd_rows(documents):
    rows = [(i, "the cat and the hat", "en") for i in range(8)] + [(i, "der Hund und die Katze", "de") for i in range(8, 16)]
    odd = [(100, None, "en"), (101, "", "de"), (102, "12 !!", "en"), (None, "the hat", None)]
    out = {r["doc_id"]: r for r in predict_languages(documents(rows + odd)).collect()}
    assert [out[i]["lang_pred"] for i in (100, 101, 102)] == ["und"] * 3
    assert out[None]["lang_pred"] == "en" and out[3]["lang_pred"] == "en" and out[12]["lang_pred"] == "de"
    assert predict_languages(documents([])).count() == 0
    names, prototypes = learn_prototypes(documents(odd[:2]), F.lit(False))
    assert [r["lang_pred"] for r in identify(documents(rows[:1]), names, prototypes).collect()] == ["und"]


def test_held_out_part(spark):
    import zlib

    rows = spark.range(50).select(F.col("id").alias("doc_id"), held_out("id", 4, 2).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)


def toxic_rows(words, n, seed=1):
    draw = np.random.default_rng(seed)
    rows, labels = [], []
    for i in range(n):
        body = [words[j] for j in draw.integers(0, 400, 40)]
        bad = bool(i % 4 == 0)
        if bad:
            body[int(draw.integers(0, 40))] = ["zzbad", "zzugly", "zznasty"][int(draw.integers(0, 3))] + ","
        rows.append((i, " ".join(body)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_held_out(spark, documents, words):
    rows, labels = toxic_rows(words, 900)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = score_documents(documents(rows), marks).join(marks, "doc_id").where("held_out").toPandas()
    assert len(out) > 200
    assert out.loc[out["toxic"] == 1, "predicted"].mean() > 0.9 and out.loc[out["toxic"] == 0, "predicted"].mean() < 0.05
    assert ((out["score"] >= 0.7) == (out["predicted"] == 1)).all()
    kept = {r["doc_id"] for r in drop_toxic(documents(rows), marks).collect()}
    gone = set(range(900)) - kept
    assert len(gone) > 150 and sum(i % 4 == 0 for i in gone) > 0.9 * len(gone)
    assert drop_toxic(documents(rows), marks).columns == documents(rows).columns


def test_toxicity_odd_rows(spark, documents, words):
    rows, labels = toxic_rows(words, 300)
    marks = spark.createDataFrame([*labels, (None, None, None), (5, 1, None)], "doc_id long, quality int, toxic int")
    odd = [(1000, None), (1001, ""), (1002, "  \n"), (None, "zzbad thing"), (1003, "w " * 50_000)]
    out = {r["doc_id"]: r for r in score_documents(documents(rows + odd), marks).collect()}
    assert out[1000]["score"] == out[1001]["score"] == out[1002]["score"] < 0.7
    assert score_documents(documents([]), marks).count() == 0
    none = score_documents(documents(rows[:3]), marks.where("false")).collect()
    assert [r["score"] for r in none] == [0.0] * 3


def test_word_features_ignore_case_and_punctuation():
    word, head, bounds = word_features(pa.array(["Idiot, x", "(idiot) X!", None]))
    assert word[0] == word[2] and word[1] == word[3] and bounds.tolist() == [0, 2, 4, 4] and head.shape == (4, 2)


def test_texts_are_scored_in_small_slices(spark, documents, monkeypatch):
    """Features take some sixty times the bytes of a slice, so slices are small; a slice of few bytes gives the scores of a whole batch."""
    assert toxicity.SCORED_BYTES <= 1 << 20
    texts = [(i, f"kind words {i % 7} about bread" if i % 2 else f"you vile rotten {i % 7} fool") for i in range(400)]
    docs = documents(texts, clashing=False)
    labels = spark.createDataFrame([(i, 1 - i % 2) for i, _ in texts], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.lit(True))
    monkeypatch.setattr(toxicity, "SCORED_BYTES", 50)
    small = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    monkeypatch.setattr(toxicity, "SCORED_BYTES", 1 << 30)
    whole = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert len(small) == 400 and all(abs(small[i] - whole[i]) < 1e-6 for i in small)


def test_every_labelled_row_trains(spark, documents, words):
    """7,000 clean rows, of which 40 have a language of their own: all of them are known to the classifier, also if many parts train."""
    rows, labels = [], []
    for i in range(7300):
        own = f"l{i:04d}" if i < 7000 and i % 175 == 0 else "en"
        rows.append((i, " ".join(words[(i * 7 + k * 13) % 900] for k in range(6)) + (" zzbad" if i >= 7000 else ""), own))
        labels.append((i, int(i >= 7000)))
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    docs = documents([*rows, *rows[:50]], clashing=False)  # repeated rows count once
    assert toxicity.labelled_features(docs, marks, F.lit(True)).count() == 7300
    many = toxicity.fit(docs, marks, F.lit(True), part_words=15_000)
    assert len(many.languages) == 41
    assert np.array_equal(many.word, toxicity.fit(docs.repartition(3), marks, F.lit(True), part_words=15_000).word)
    out = toxicity.score(docs, many).groupBy((F.col("doc_id") >= 7000).alias("bad")).agg(F.avg("predicted").alias("share")).collect()
    shares = {r["bad"]: r["share"] for r in out}
    assert shares[True] > 0.9 and shares[False] < 0.05
