"""Fill-in-middle against the pattern, source divergence against exact fractions, byte-level BPE against the library."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import string
from base64 import b64encode
from collections import Counter
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from regionlens.llm import byte_bpe, fill_in_middle, source_divergence
from regionlens.llm.queries import QUERIES

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
LONG = " ".join(f"wört{i % 977}\n\t" for i in range(60_000)) + "x" * 9000 + " " * 9000
ODD = [None, "", " ", "a", " a ", "a\n\nb  ", "日本 語\x85é", "has <P> in it", "<S>", "x" * 5000, "\t" * 5000, LONG]


def sample(ident, text, seed=42):
    """A document by the rules, token by token."""
    text = text or ""
    tokens = TOKEN.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if ident is None else ident}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(tokens)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return ident, n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(t) for t in (tokens[:low], tokens[low:high], tokens[high:]))
    if h[3] % 100 < 80:
        return ident, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return ident, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def key(row):
    return tuple((x is None, x) for x in row)


def test_middle_of_odd_texts(documents):
    rows = [(i, t) for i in range(40) for t in ODD[:-1]] + [(i, LONG) for i in range(6)] + [(None, "a b c"), (None, None), (3, "a"), (3, "a")]
    out = fill_in_middle.fill_in_middle(documents(rows))
    assert sorted(map(tuple, out.collect()), key=key) == sorted((sample(*r) for r in rows), key=key)
    again = out.select(fill_in_middle.restored(out["output"], out["form"])).collect()
    assert Counter(r[0] for r in again) == Counter(t or "" for _, t in rows)
    assert {r["form"] for r in out.collect()} == {"plain", "spm", "psm"}
    assert fill_in_middle.fill_in_middle(documents([])).count() == 0


def test_middle_of_a_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = {}
    for r in docs.collect():
        *head, output = sample(r["doc_id"], r["text"])
        want[r["doc_id"]] = (*head, *(hashlib.sha256(t.encode()).hexdigest() for t in (output, r["text"] or "")))
    assert {r["doc_id"]: tuple(r) for r in QUERIES["op11_fill_in_middle"](spark, folder).collect()} == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab cé日\n\t"), max_size=400), min_size=1, max_size=5), st.integers(0, 50))
def test_cuts_anywhere(texts, k):
    cutter = fill_in_middle.Cutter(pa.array(texts), _memory())
    for i, text in enumerate(texts):
        tokens = TOKEN.findall(text)
        assert cutter.counts[i] == len(tokens)
        part = "".join(tokens[: min(k, len(tokens))])
        assert cutter.place(i, min(k, len(tokens))) == (len(part.encode()), len(part))


@cache
def _memory():
    return fill_in_middle.Summaries(limit=20_000)


def test_chunks_follow_the_content():
    """A passage is cut alike wherever it stands, and its chunks are read once."""
    draw = random.Random(1)
    passage = "".join(draw.choice("abcdefghij ") for _ in range(20_000))
    data = np.frombuffer(("some words before " + passage + passage).encode(), np.uint8)
    ends = fill_in_middle.chunk_ends(data, np.array([0, len(data)]))
    first, second = ({int(e) - at for e in ends if at + 300 < e < at + len(passage)} for at in (18, 18 + len(passage)))
    assert len(first & second) > 0.9 * len(first) > 20
    gaps = np.diff(ends, prepend=0)
    assert gaps.max() <= fill_in_middle.LARGEST and gaps[:-1].min() >= fill_in_middle.SMALLEST
    memory = fill_in_middle.Summaries()
    fill_in_middle.Cutter(pa.array([passage]), memory)
    seen = memory.size
    fill_in_middle.Cutter(pa.array([passage]), memory)
    assert memory.size == seen


def divergences(rows, least, shown=10):
    """The report by its definition: all terms of all pairs."""
    rows = [tuple(x or "" for x in r) for r in rows]
    cut = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    docs = [(lang, source, Counter(t.translate(lower) for t in cut.findall(text))) for text, lang, source in rows]
    out = []
    for lang in {r[0] for r in docs}:
        df = Counter(t for g, _, c in docs if g == lang for t in c)
        kept = sorted(t for t, n in df.items() if n >= least)
        sources = sorted({s for g, s, _ in docs if g == lang})

        def shares(of):
            total = Counter()
            for g, s, c in docs:
                if g == lang and s in of:
                    total.update(c)
            n = sum(total[t] for t in kept)
            return {t: 1 + 10**9 * (total[t] + 2) // (n + 2 * len(kept)) for t in kept}, total

        q, _ = shares(sources)
        own = {s: shares([s]) for s in sources}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s, (p, counts) in own.items():
            pairs = [(o, sum(f(p[t], own[o][0][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, f(p[t], q[t])) for t in kept if counts[t] and p[t] > q[t]]
            for part, found, n in (("pair", pairs, None), ("term", terms, shown)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(found[:n])]
    return sorted(out)


@pytest.mark.parametrize("held", [200_000, 50])
def test_divergence(spark, words, monkeypatch, held):
    monkeypatch.setattr(source_divergence, "HELD", held)  # only seen in this process; the workers keep theirs
    draw = random.Random(3)
    rows = [(" ".join(draw.choice(words[: 40 + 10 * s]) for _ in range(30)), draw.choice(["en", "Ünï", None]), f"s{s}") for s in range(4) for _ in range(40)]
    rows += [rows[0]] * 60 + [(rows[0][0], "en", None), (None, "en", "empty"), ("", None, None), ("1 2 3 !", "de", "x"), ("once", "de", "y"), ("É É é B b", "fr", "z")]
    rows += [("Word " * 3 + "日本 \x85x", "fr", s) for s in ("z", "w") for _ in range(5)]
    frame = spark.createDataFrame([(*r, 1, "t") for r in rows], "text string, lang string, source string, digest int, term string")
    for least in (10, 1):
        assert sorted(map(tuple, source_divergence.audit(frame, least=least).collect())) == divergences(rows, least)
    assert source_divergence.audit(frame.limit(0)).count() == 0


def test_divergence_of_long_texts(documents):
    rows = [(i, "tail " * 200_000 + "x" * 100_000, "en") for i in range(3)] + [(9, "other tail", "en")]
    frame = documents(rows).selectExpr("text", "lang", "CASE WHEN doc_id = 9 THEN 'b' ELSE 'a' END AS source")
    full = [(t, "en", "b" if i == 9 else "a") for i, t, _ in rows]
    assert sorted(map(tuple, source_divergence.audit(frame, least=1).collect())) == divergences(full, 1)


PATH = public_tokenizers.path(byte_bpe.VOCABULARY)


@cache
def own():
    return byte_bpe.Codec(PATH)


@cache
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks_of(PATH), special_tokens={})


def encoded(codec, texts):
    return [np.frombuffer(b, np.int32).tolist() for b in codec.encode(texts)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aab  cthe Éßσ'’sS\n\t.,!0129日本😀ไ่<|>"), max_size=60), max_size=8))
def test_encoding_of_any_text(texts):
    ids = encoded(own(), texts)
    assert ids == [library().encode_ordinary(t) for t in texts]
    flat = np.array([i for one in ids for i in one], np.int32)
    assert own().decode(flat, np.array(list(map(len, ids)), np.int64)) == [t.encode() for t in texts]


def test_long_words(monkeypatch):
    """Words of thousands of letters, also over several queries of few rounds."""
    long = ["z" * 5000, "thethe" * 300, "ab" * 700, "日本" * 800, "qwxk" * 500, "a" * 7]
    want = [library().encode_ordinary(t) for t in long]
    assert encoded(own(), long) == want
    monkeypatch.setattr(byte_bpe, "ROWS", 40_000)
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 0)
    assert encoded(own(), [*long, ""]) == [*want, []]


def test_contraction_order(tmp_path):
    """Hits in a row overlap, a merged token can rank before its own parts, ties go left."""
    ranks = {bytes([b]): 1000 + b for b in range(256)} | {b"aa": 5, b"ab": 3, b"aab": 1, b"bb": 7, b"abb": 6}
    file = tmp_path / "ranks"
    file.write_bytes(b"".join(b64encode(t) + b" %d\n" % r for t, r in ranks.items()))
    small = byte_bpe.Codec(str(file))
    exact = tiktoken.Encoding("small", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    texts = ["".join(t) for n in range(1, 10) for t in itertools.product("ab", repeat=n)]
    assert encoded(small, texts) == [exact.encode_ordinary(t) for t in texts]


def test_bpe_of_a_table(spark, documents, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    out = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op13_byte_bpe"](spark, folder).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = {i: library().encode_ordinary(t) for i, t in texts.items()}
    assert out == {i: (len(ids), sha(",".join(map(str, ids)).encode()), sha(texts[i].encode())) for i, ids in want.items()}

    rows = [(1, "a b"), (1, "a b"), (None, "x"), (2, None), (3, ""), (4, LONG)]
    coded = byte_bpe.decode(byte_bpe.encode(documents(rows))).collect()
    assert sorted((str(r["doc_id"]), bytes(r["decoded"])) for r in coded) == sorted((str(i), (t or "").encode()) for i, t in rows)
    assert all(r["ids"] == library().encode_ordinary(bytes(r["decoded"]).decode()) for r in coded)
    assert byte_bpe.encode(documents([])).count() == 0
    odd = spark.createDataFrame([(1, None, "k"), (2, [], "k")], "row long, ids array<int>, hex string")
    assert [(r["row"], bytes(r["decoded"]), r["hex"]) for r in byte_bpe.decode(odd).collect()] == [(1, b"", "k"), (2, b"", "k")]
    with pytest.raises(Exception, match="not in the vocabulary"):
        byte_bpe.decode(spark.createDataFrame([([99_999_999],)], "ids array<int>")).collect()


def test_counts_of_terms_cross_one_exchange(documents):
    """All sources of a term meet where its counts are added, so the sums of a language need no exchange of their own."""
    docs = documents([(i, f"one two three{i % 3}", "en") for i in range(30)], clashing=False)
    counts = source_divergence.count_terms(source_divergence.collapse(docs))
    of_term = Window.partitionBy("lang", "term")
    plan = counts.withColumn("all", F.sum("docs").over(of_term))._jdf.queryExecution().executedPlan().toString()
    below = plan[: plan.index("MapInArrow")] if "MapInArrow" in plan else plan[: plan.index("PythonMapInArrow")]
    assert below.count("Exchange") == 1


def test_numbers_of_words_last_over_calls(monkeypatch):
    """Words keep their numbers from call to call, also after a call that failed before it had learned them."""
    codec = byte_bpe.Codec(PATH)
    texts = ["qzxv unseenword qzxv", "", "yet anotherunseen qzxv"]
    with monkeypatch.context() as broken:
        broken.setattr(codec, "merged", lambda words: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            codec.encode(["brokenunseen qzxv", *texts])
    fresh = byte_bpe.Codec(PATH)
    assert codec.encode(texts) == fresh.encode(texts) and len(codec.words) == len(codec.known)
    monkeypatch.setattr(fresh, "merged", lambda words: 1 / 0)
    assert fresh.encode(texts[::-1]) == codec.encode(texts[::-1])  # nothing is left to learn
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 2)
    assert codec.encode(["and more unseenwords"]) and codec.encode(texts) == fresh.encode(texts)
