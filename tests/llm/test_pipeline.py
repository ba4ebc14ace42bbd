"""The pipeline stage by stage against brute force over what each stage was given."""

from __future__ import annotations

from pathlib import Path

import corpus_pipeline
import numpy as np
import pyarrow as pa
from __spark_entry__ import oracle_sql, queries
from regionlens.llm import jaccard_join, suffix_dedup, words
from regionlens.llm.common import give_back, table, written
from regionlens.llm.queries import ORACLES, QUERIES
from regionlens.session import SHUFFLE_CLEANUP, passing_tables, scratch_root
from test_near_duplicates import brute_repeats, brute_sets, classes


def test_registered():
    assert len([q for q in QUERIES if q.startswith("op")]) == 13 and "pipeline" in QUERIES
    assert set(QUERIES) <= set(queries()) and set(ORACLES) <= set(oracle_sql())


def test_stages(spark, folder):
    docs = table(spark, folder, "documents")
    columns, given = docs.columns, docs
    results = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, folder), f"test-{name}")
        results[name] = docs
    assert all(results[n].columns == columns for n, _ in corpus_pipeline.STAGES[:-1])
    rows = lambda df: [(r["doc_id"], r["text"]) for r in df.collect()]

    clean = rows(results["toxicity"])
    assert {i for i, _ in clean} <= {i for i, _ in rows(given)} and len(clean) > 0.8 * given.count()
    ids, sets = [i for i, _ in clean], brute_sets(t for _, t in clean)
    links = [(ids[i], ids[j]) for i in range(len(ids)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    single = rows(results["near_duplicates"])
    assert sorted(i for i, _ in single) == sorted(set(classes(links, ids).values()))
    cut = {r["doc_id"]: r for r in results["repeated_passages"].collect()}
    for i, n, gone, _, _ in brute_repeats(single, 50):
        assert n - gone - 6 <= len(cut[i]["text"].encode()) <= n - gone and cut[i]["n_chars"] == len(cut[i]["text"])
    free = {i for i, _ in rows(results["decontamination"])}
    assert free <= set(cut)
    packed = results["packing"].collect()
    assert {r["doc_id"] for r in packed} == free
    again = corpus_pipeline.run(spark, folder)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, again.select(key).collect())) == sorted(tuple(r[c] for c in key) for r in packed)


def test_workers_give_back_what_they_keep():
    first, inverse = (a.copy() for a in words.powers(1000))
    give_back()
    assert "powers" not in words._STATE and "inverse" not in words._STATE
    assert (words.powers(1000)[0] == first).all() and (words.powers(1000)[1] == inverse).all()


def test_minimisers_spread_over_the_hash_ranges():
    """Nearly all smallest hashes begin with zeros, so that one range, and one task, would get them all."""
    letters = np.random.default_rng(1).integers(97, 123, 200_000).astype(np.uint8).tobytes().decode()
    key = suffix_dedup.minimisers(pa.array([letters]), 50)[-1]
    share = np.bincount((key >> np.uint64(60)).astype(int), minlength=16) / len(key)
    assert len(key) > 5000 and share.max() < 0.1


def test_only_results_stay_on_disk(spark, folder):
    """A stage's working tables go when its result is written; before, all of them stayed to the end of the pipeline."""
    docs, root = table(spark, folder, "documents"), Path(scratch_root(spark))
    before = set(root.iterdir())
    left = lambda: sorted(p.name.rsplit("-", 1)[0] for p in set(root.iterdir()) - before)
    assert suffix_dedup.find_spans(docs).count() > 0 and left() == ["llm-spans"]
    assert jaccard_join.drop_near_duplicates(docs).count() > 0 and left() == ["llm-classes", "llm-sets", "llm-spans"]


def test_passing_tables_go_also_after_a_failure(spark):
    setting = spark.conf.get(SHUFFLE_CLEANUP, None)
    kept = []
    try:
        with passing_tables(spark):
            with passing_tables(spark):
                kept.append(written(spark.range(3), "passing"))
                kept.append(written(spark.range(4), "inner-result", result=True))
            assert kept[1].count() == 4
            assert not list(Path(scratch_root(spark)).glob("llm-passing-*"))
            raise ValueError
    except ValueError:
        pass
    stays = [p.name for p in Path(scratch_root(spark)).glob("llm-*")]
    assert not any("passing" in n or "inner-result" in n for n in stays)
    assert spark.conf.get(SHUFFLE_CLEANUP, None) == setting
