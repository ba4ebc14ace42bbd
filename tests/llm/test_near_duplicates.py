"""Similarity joins, vectors and repeated passages against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from regionlens.llm import suffix_dedup
from regionlens.llm.common import components
from regionlens.llm.jaccard_join import drop_near_duplicates, near_duplicate_classes, pack, unpack
from regionlens.llm.nn_descent import near_duplicates
from regionlens.llm.suffix_dedup import cut_repeats, kept_bytes, remove_repeats, window_minima
from regionlens.llm.words import shingle_sets, word_hashes

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def brute_sets(texts):
    out = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().translate(LOWER))
        out.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    return out


def classes(links, ids):
    parent = {i: i for i in ids}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return {i: find(i) for i in ids}


def mutated(draw, words, base, edits):
    body = list(base)
    for _ in range(edits):
        body[draw.randrange(len(body))] = draw.choice(words)
    return body


@pytest.fixture(scope="module")
def near_copies(words):
    draw = random.Random(3)
    rows, n = [], 0
    line = " ".join(words[:6])
    for group in (1, 1, 2, 3, 8, 60):
        base = [draw.choice(words) for _ in range(draw.randint(30, 200))]
        for k in range(group):
            body = mutated(draw, words, base, draw.randint(0, 4))
            rows.append((n, line + ". " + " ".join(body).upper() if k % 7 == 3 else line + ". " + " ".join(body)))
            n += 1
    rows += [(n + i, rows[40][1]) for i in range(10)]
    draw.shuffle(rows)
    return rows


def test_components(spark):
    draw = random.Random(1)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 430)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    expected = classes(edges, {x for e in edges for x in e})
    assert found == {k: v for k, v in expected.items() if any(k in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_words_and_shingles():
    texts = pa.array(["The cat\tsat on THE mat", "", None, "a", "é É\n\n x", " the CAT sat on the mat "])
    hashes, bounds = word_hashes(texts)
    assert bounds.tolist() == [0, 6, 6, 6, 7, 10, 16] and hashes[0] == hashes[4] and hashes[7] != hashes[8]
    sets = shingle_sets(texts)
    assert [len(s) for s in sets] == [2, 0, 0, 1, 1, 2] and np.array_equal(sets[0], sets[5])


@pytest.mark.parametrize("kind", [np.uint8, np.uint16, np.uint32, np.uint64])
def test_packed_arrays(kind):
    values = np.random.default_rng(0).integers(0, np.iinfo(kind).max, 1000, dtype=kind)
    assert np.array_equal(unpack(pack(values)), values) and not len(unpack(pack(values[:0])))


def test_jaccard_join(documents, near_copies):
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicate_classes(documents(near_copies)).collect()}
    ids, sets = [i for i, _ in near_copies], brute_sets(t for _, t in near_copies)
    links = [(ids[i], ids[j]) for i in range(len(ids)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    expected = classes(links, ids)
    assert found == {i: (len(s), expected[i]) for i, s in zip(ids, sets)}
    kept = drop_near_duplicates(documents(near_copies))
    assert {r["doc_id"] for r in kept.collect()} == set(expected.values()) and kept.columns == documents(near_copies).columns


def test_jaccard_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    ids, sets = [i for i, _ in rows], brute_sets(t for _, t in rows)
    links = [(ids[i], ids[j]) for i in range(len(ids)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    assert {r["doc_id"]: r["component_id"] for r in near_duplicate_classes(docs).collect()} == classes(links, ids)


def test_jaccard_odd_rows(documents):
    text = "one two three four five six seven"
    rows = [(5, text), (3, text.upper()), (3, text), (None, text), (None, "alone here"), (9, None), (8, ""), (7, "short"), (6, "Short ")]
    out = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_duplicate_classes(documents(rows)).collect()), key=str)
    assert out == sorted([(5, 3, 3), (3, 3, 3), (3, 3, 3), (None, 3, 3), (None, 1, None), (9, 0, 9), (8, 0, 8), (7, 1, 6), (6, 1, 6)], key=str)
    assert near_duplicate_classes(documents([])).count() == 0
    assert sorted(str(r["doc_id"]) for r in drop_near_duplicates(documents(rows)).collect()) == ["3", "6", "8", "9", "None"]


def brute_repeats(rows, length):
    first, out = {}, []
    for i, t in rows:
        b, rank = (t or "").encode(), 1 << 62 if i is None else i
        for k in range(len(b) - length + 1):
            first[b[k : k + length]] = min(rank, first.get(b[k : k + length], rank))
    for i, t in rows:
        b, rank = (t or "").encode(), 1 << 62 if i is None else i
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < rank:
                gone[k : k + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=str)


def test_windows_of_a_group():
    draw = np.random.default_rng(2)
    for _ in range(30):
        strings = list({bytes(draw.integers(97, 100, draw.integers(5, 14)).astype(np.uint8)) for _ in range(draw.integers(1, 40))})
        low = draw.integers(0, 50, len(strings))
        least: dict[bytes, int] = {}
        for s, v in zip(strings, low):
            for k in range(len(s) - 4):
                least[s[k : k + 5]] = min(v, least.get(s[k : k + 5], 99))
        found = window_minima(np.frombuffer(b"".join(strings), np.uint8), np.array([len(s) for s in strings]), low, 5)
        assert found.tolist() == [least[s[k : k + 5]] for s in strings for k in range(len(s) - 4)]


@pytest.mark.parametrize("hot", [40_000, 1])
def test_repeats(documents, near_copies, hot):
    odd = [(None, near_copies[3][1]), (None, near_copies[3][1]), (900, None), (901, ""), (902, "é" * 24), (903, "é" * 30), (904, "x" + "é" * 40), (905, "a" * 300), (906, "b" + "a" * 260 + "c"), (905, "a" * 300)]
    rows = near_copies + odd
    out = sorted((tuple(r) for r in remove_repeats(documents(rows), hot=hot).collect()), key=str)
    assert out == brute_repeats(rows, 50)


def test_repeats_table(spark, folder, documents):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted((tuple(r) for r in remove_repeats(docs).collect()), key=str) == brute_repeats(rows, 50)
    cut = cut_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == len(rows)
    left = {i: n - gone for i, n, gone, _, _ in brute_repeats(rows, 50)}
    for r in cut.collect():
        assert len(r["text"].encode()) <= left[r["doc_id"]] and r["n_chars"] == len(r["text"])
    assert remove_repeats(documents([])).count() == 0


def test_kept_bytes():
    spans = np.array([[1, 3], [5, 6]], np.int64).tobytes()
    assert kept_bytes(b"abcdefg", spans) == (b"adeg", 3, 2) and kept_bytes(b"abc", None) == (b"abc", 0, 0)


@pytest.fixture(scope="module")
def vectors():
    draw = np.random.default_rng(4)
    base = draw.normal(size=(500, 16))
    dense = base[0] + draw.normal(scale=0.02, size=(90, 16))
    pairs = base[1:60] + draw.normal(scale=0.1, size=(59, 16))
    every = np.concatenate([base, dense, pairs, base[5:6], base[5:6] * 3])
    return [(int(i), [float(x) for x in np.float32(v)], 0) for i, v in zip(draw.permutation(len(every)), every)]


def test_nn_descent(spark, vectors):
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS node", "'x' AS least")
    out = {r["vec_id"]: r for r in near_duplicates(frame).collect()}
    ids = [v[0] for v in vectors]
    matrix = np.array([v[1] for v in vectors])
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    alike = matrix @ matrix.T >= 0.95
    np.fill_diagonal(alike, False)
    expected = classes([(ids[i], ids[j]) for i, j in zip(*np.nonzero(alike))], ids)
    degree = dict(zip(ids, alike.sum(axis=1).tolist()))
    assert all(out[i]["n_links"] <= degree[i] for i in ids)
    assert sum(out[i]["n_links"] for i in ids) >= 0.97 * sum(degree.values())
    assert sum(out[i]["component_id"] == expected[i] for i in ids) >= 0.97 * len(ids)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in out.values())


def test_nn_descent_odd_rows(spark):
    schema = "vec_id long, embedding array<float>, label int"
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [0.0, 0.0], 0), (4, None, 0), (5, [nan, 1.0], 0), (6, [None, 1.0], 0), (7, [inf, 0.0], 0), (8, [1.0], 0), (None, [1.0, 0.0], 0), (9, [], 0), (10, [0.0, 1.0], None)]
    out = sorted((tuple(r) for r in near_duplicates(spark.createDataFrame(rows, schema)).collect()), key=str)
    expected = [(1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), (None, 0, None, None)] + [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10)]
    assert out == sorted(expected, key=str)
    assert near_duplicates(spark.createDataFrame([], schema)).count() == 0


def test_only_related_strings_are_built(monkeypatch):
    """Strings with one minimiser that differ on both sides of it have no window in common; whatever the strings, the minima stay those of brute force."""
    draw = np.random.default_rng(3)
    letters = lambda n, kinds=26: bytes(draw.integers(97, 97 + kinds, n, np.uint8))
    built = []
    build = suffix_dedup.window_minima
    monkeypatch.setattr(suffix_dedup, "window_minima", lambda body, lengths, low, length: built.append(len(lengths)) or build(body, lengths, low, length))
    seed = min((letters(16) for _ in range(20_000)), key=lambda s: int(suffix_dedup.seed_hashes(np.frombuffer(s, np.uint8))[0]))  # the minimiser of nearly all strings
    alone = [letters(30) + seed + letters(30) for _ in range(50)]
    suffix_dedup.settled_minima(alone, np.arange(50), 50)
    assert not built
    for length in (50, 21, 17):
        parts = [letters(60) for _ in range(4)] + [(letters(n, 2) * 60)[:90] for n in (1, 2, 3, 7)] + [letters(60, 2)]
        texts = [b"".join([parts[i][int(draw.integers(0, 30)) :] + letters(int(draw.integers(0, 9)), 2) for i in draw.integers(0, len(parts), 12)]) for _ in range(25)]
        data, _, _, starts, windows, _ = suffix_dedup.minimisers(pa.array([t.decode() for t in texts]), length)
        strings = sorted({data[a : a + n + length - 1].tobytes() for a, n in zip(starts.tolist(), windows.tolist())})  # runs of windows with one minimiser
        low = draw.permutation(len(strings)).astype(np.int64)
        best: dict[bytes, int] = {}
        for s, n in zip(strings, low.tolist()):
            for at in range(len(s) - length + 1):
                best[s[at : at + length]] = min(n, best.get(s[at : at + length], n))
        minima, first = suffix_dedup.settled_minima(strings, low, length)
        assert minima.tolist() == [best[s[at : at + length]] for s in strings for at in range(len(s) - length + 1)]
        assert first[-1] + len(strings[-1]) - length + 1 == len(minima)
    assert built
