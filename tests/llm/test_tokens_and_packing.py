"""Token counts against the library, packing against its rules, sharding against its law."""

from __future__ import annotations

import zlib
from functools import cache

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from regionlens.llm.hash_ring import shard_documents
from regionlens.llm.packing import Encoder, best_fit_decreasing, lower_bound, pack_documents, pack_group
from regionlens.llm.token_counts import Counter, add_token_counts, whole_tokens

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "a", "  a", "a  ", "a \n b\n\n c", "<|endoftext|>", "x<|endoftext|> y", "It's 12,5% of I'M", "日本語 😀 é é", "ΣΟΔΟΣ Σ", "a\x1cb\x00c", " x y", "z" * 5000, "THE!! END?!"]


@pytest.fixture(scope="module")
def counter():
    return Counter(BYTES), Tokenizer.from_file(BYTES)


@pytest.fixture(scope="module")
def encoder():
    return Encoder(WORDS), Tokenizer.from_file(WORDS)


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(counter, encoder, text):
    assert counter[0].count(text) == len(counter[1].encode(text, add_special_tokens=False).ids)
    assert np.frombuffer(encoder[0].encode(text), "<u4").tolist() == encoder[1].encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab cÉéßσΣ'’sS \n\t .,!?0129日😀|<>"), max_size=60))
def test_any_text(text):
    for own, library in ((_counter(), _library(BYTES)), (_encoder(), _library(WORDS))):
        ids = library.encode(text, add_special_tokens=False).ids
        assert (own.count(text) if isinstance(own, Counter) else len(own.encode(text)) // 4) == len(ids)


@cache
def _counter():
    return Counter(BYTES)


@cache
def _encoder():
    return Encoder(WORDS)


@cache
def _library(path):
    return Tokenizer.from_file(path)


def test_whole_tokens_are_single(counter):
    some = sorted(whole_tokens(counter[1]))[::50]
    assert all(len(counter[1].encode(s, add_special_tokens=False).ids) == 1 for s in some)
    assert len(whole_tokens(counter[1])) > 49_000


def test_counts_of_a_table(spark, documents, folder):
    rows = documents([(1, "some text"), (1, "some text"), (None, "x"), (2, None), (3, "")])
    out = sorted((tuple(r) for r in add_token_counts(rows).collect()), key=str)
    assert out == sorted([(1, 9, 2, False), (1, 9, 2, False), (None, 1, 1, False), (2, 0, 0, False), (3, 0, 0, False)], key=str)
    assert add_token_counts(documents([])).count() == 0
    library = _library(BYTES)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in add_token_counts(docs).collect():
        n = len(library.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_tokens"], r["over_limit"], r["n_bytes"]) == (n, n > 1024, len(texts[r["doc_id"]].encode()))


def check_packing(rows, capacity):
    """Offsets without gaps, nothing too full, every piece once."""
    sequences: dict[int, list] = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


@pytest.mark.parametrize("group", [50_000, 40])
def test_packing_of_a_table(spark, folder, group):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = pack_documents(docs, group=group).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    library, parts = _library(WORDS), {}
    for r in rows:
        parts.setdefault(r["doc_id"], []).append(r)
    assert set(parts) == set(texts)
    for doc, pieces in parts.items():
        ids = np.array(library.encode(texts[doc], add_special_tokens=False).ids + [0], "<u4")
        pieces.sort(key=lambda r: r["piece"])
        assert [r["start"] for r in pieces] == list(range(0, len(ids), 2048))
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in pieces)
        assert sum(r["length"] for r in pieces) == len(ids)
    used, least = check_packing(rows, 2048), lower_bound(np.array([r["length"] for r in rows]), 2048)
    assert least <= used <= least + (1 if group > 1000 else 3)


def test_packing_odd_rows(documents):
    rows = pack_documents(documents([(1, "a b"), (1, "a b"), (None, None), (2, "")]), capacity=4).collect()
    assert sorted((str(r["doc_id"]), r["length"]) for r in rows) == [("1", 3), ("1", 3), ("2", 1), ("None", 1)]
    assert check_packing(rows, 4) == 2
    assert pack_documents(documents([])).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_bounds_hold(lengths):
    lengths = np.array(lengths)
    bins = best_fit_decreasing(lengths, 20)
    assert np.bincount(bins, weights=lengths).max() <= 20

    def optimum(items, rooms):  # exhaustive
        if not items:
            return len(rooms)
        best = len(rooms) + len(items)
        for i in range(len(rooms)):
            if rooms[i] >= items[0] and rooms[i] not in rooms[:i]:
                best = min(best, optimum(items[1:], rooms[:i] + [rooms[i] - items[0]] + rooms[i + 1 :]))
        return min(best, optimum(items[1:], [*rooms, 20 - items[0]]))

    exact = optimum(sorted(lengths.tolist(), reverse=True), [])
    assert lower_bound(lengths, 20) <= exact <= len(set(bins.tolist()))


def test_gap_partitions_give_up_their_open_bins():
    bins, offset, given, certified = pack_group(np.array([12, 12, 9, 8, 7, 2]), 20, True)
    assert given.any() and len(set(bins.tolist())) >= 3


def test_ring(spark, documents, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = shard_documents(docs, shards=40).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    slots: dict[int, list] = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
        body = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(body) + 16, zlib.crc32(body), "rows", None)
    sizes = [len(s) for s in slots.values()]
    assert len(rows) == len(texts) and set(slots) <= set(range(40)) and max(sizes) - min(sizes) <= 1 and len(sizes) == 40
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sum(r["shard"] != r["home_shard"] for r in rows) < 0.4 * len(rows)  # five rows a shard


def test_ring_hot_key_and_odd_rows(documents):
    rows = [(7, f"text {i % 3}") for i in range(90)] + [(None, None), (None, "x"), (8, "")]
    out = shard_documents(documents(rows), shards=4, vnodes=8).collect()
    counts = [sum(r["shard"] == s for r in out) for s in range(4)]
    assert sorted(counts) == [23, 23, 23, 24]
    assert shard_documents(documents([])).count() == 0
