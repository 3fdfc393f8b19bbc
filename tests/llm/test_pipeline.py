import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from llm_helpers import brute_force, contamination, fill, texts

import corpus_pipeline
from basalt.llm import mixing, quality, queries


def tables(spark, sf):
    return (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels", "benchmark"))


def walked(trees, row):
    total = trees.base
    for node in trees.roots:
        while trees.left[node] != node:
            node = trees.left[node] if row[trees.feature[node]] <= trees.threshold[node] else trees.right[node]
        total += trees.value[node]
    return 1 / (1 + np.exp(-total))


def test_stages_against_a_model(spark, sf):
    """What each stage keeps, found without the operators' joins."""
    docs, labels, bench = tables(spark, sf)
    stage = [f for _, f in corpus_pipeline.STAGES]
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    by_id = texts(docs)
    trees = quality.fit(docs, labels)
    good = {d: t for d, t in by_id.items() if walked(trees, quality.statistics(pa.array([t]))[0]) >= 0.3}
    first = stage[0](spark, docs, sf).cache()
    assert ids(first) == sorted(good) and first.columns == docs.columns and 0 < len(good) < len(by_id)
    classes = brute_force(good)
    second = stage[1](spark, first, sf).cache()
    single = {d: t for d, t in good.items() if classes[d][0] == d}
    assert ids(second) == sorted(single) and second.columns == docs.columns and len(single) < len(good)
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    clean = {d: t for d, t in single.items() if not contamination(t, items)[4]}
    third = stage[2](spark, second, sf).cache()
    assert ids(third) == sorted(clean) and third.columns == docs.columns and len(clean) < len(single)
    source = {r["doc_id"]: r["source"] for r in third.collect()}
    size = {d: len(t.split()) for d, t in clean.items()}
    per = defaultdict(int)
    for d, n in size.items():
        per[source[d]] += n
    want = fill(per, {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(sorted(per, key=lambda s: (s is None, s or "")))}, 3)
    fourth = stage[3](spark, third, sf).cache()
    copies = Counter(ids(fourth))
    for s, n in want.items():
        own = {d for d in clean if source[d] == s}
        assert abs(sum(copies[d] * size[d] for d in own) - n) <= max(size[d] for d in own)
    assert max(copies.values()) <= 3 and set(copies) <= set(clean) and fourth.columns == docs.columns
    last = stage[4](spark, fourth, sf).collect()
    order, by_source = [], defaultdict(list)
    for d, n in copies.items():
        by_source[source[d]] += [(hashlib.md5(f"17:{d}".encode()).hexdigest(), d)] * n
    for s, rows in by_source.items():
        order += [((2 * k + 1) / (2 * len(rows)), s is None, s or "", d) for k, (_, d) in enumerate(sorted(rows))]
    places = sorted((d, k * 24 // len(order)) for k, (*_, d) in enumerate(sorted(order)))
    assert sorted((r["doc_id"], r["shard"]) for r in last) == places and len({(r["shard"], r["slot"]) for r in last}) == len(last)
    assert all(r["text"] == by_id[r["doc_id"]] for r in last)
    assert Counter(r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect()) == copies


@pytest.mark.parametrize("k", range(5))
def test_stages_with_odd_rows(spark, sf, docs, empty, odd_ids, k):
    """Nulls, empty texts, repeated rows, clashing names, empty tables."""
    stage = corpus_pipeline.STAGES[k][1]
    got = stage(spark, docs, sf)
    if k < 4:
        assert got.columns == docs.columns and got.schema == docs.schema
    assert got.count() <= 3 * docs.count() and stage(spark, empty, sf).collect() == []
    some = {r["text"] for r in got.select("text").collect()}
    assert some <= {r["text"] for r in docs.select("text").collect()}
    rows = Counter((r["doc_id"], r["text"]) for r in stage(spark, odd_ids, sf).collect())
    assert set(rows) <= {(None, "a b c d e f g"), (1, "same text here now yes"), (2, None)}
    if k == 1:
        assert len(rows) == 3 and set(rows.values()) == {1}
    if k in (2, 4):
        assert set(rows.values()) == {2}


def test_empty_pipeline(spark, sf, tmp_path):
    for name, df in zip(("documents", "labels", "benchmark"), tables(spark, sf), strict=True):
        df.where("false").write.parquet(f"file://{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").collect() == []


def test_registered():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 11)] and set(queries.oracle_sql()) <= set(names)
