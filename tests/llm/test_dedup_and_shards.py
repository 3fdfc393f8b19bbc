import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from llm_helpers import brute_force, shingled, texts, words

from basalt.llm import exact_dedup, lines, links, near, sharding
from basalt.llm.words import blocks


def test_radix_groups(docs, empty, odd_ids):
    groups = defaultdict(list)
    for d, t in texts(docs).items():
        groups[t].append(d)
    want = {d: (max(g), len(g), d == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for d in g}
    for widths in ({}, {"first": 2, "growth": 3, "widest": 50}):
        got = {r[0]: tuple(r)[1:] for r in exact_dedup.radix_groups(docs, **widths).collect()}
        assert got == want
    assert exact_dedup.radix_groups(empty).collect() == []
    got = sorted((tuple(r)[:4] for r in exact_dedup.radix_groups(odd_ids).collect()), key=repr)
    assert got == sorted([(None, None, 2, True)] * 2 + [(1, 1, 2, True)] * 2 + [(2, 2, 2, True)] * 2, key=repr)


def test_interleave(docs, empty, odd_ids):
    got = sharding.interleave(docs).collect()
    rows = {r["doc_id"]: r for r in docs.select("doc_id", "text", "source").collect()}
    by_source = defaultdict(list)
    for d, r in rows.items():
        by_source[r["source"]].append(d)
    order = []
    for s, ids in by_source.items():
        ids.sort(key=lambda d: hashlib.md5(f"17:{d}".encode()).hexdigest())
        order += [((2 * k + 1) / (2 * len(ids)), s is None, s or "", hashlib.md5(f"17:{d}".encode()).hexdigest(), d) for k, d in enumerate(ids)]
    place = {x[-1]: k for k, x in enumerate(sorted(order))}
    n = len(place)
    for r in got:
        raw = (rows[r["doc_id"]]["text"] or "").encode()
        k = place[r["doc_id"]]
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
        assert r["shard"] == k * 24 // n and r["slot"] == k - -(-r["shard"] * n // 24)
    counts = Counter(r["shard"] for r in got)
    assert len(got) == n and max(counts.values()) - min(counts.values()) <= 1
    assert sharding.interleave(empty).collect() == []
    few = sharding.interleave(odd_ids).collect()
    assert len({(r["shard"], r["slot"]) for r in few}) == 6
    whole = sharding.placed(docs)
    assert whole.columns == [f"docs_{c}" if c in sharding.PLACED else c for c in docs.columns] + sharding.PLACED
    of = {r["doc_id"]: (r["shard"], r["slot"]) for r in got}
    assert {(r["doc_id"], r["text"]): (r["shard"], r["slot"]) for r in whole.collect()} == {(d, rows[d]["text"]): s for d, s in of.items()}
    assert sharding.placed(empty).collect() == [] and len({(r["shard"], r["slot"]) for r in sharding.placed(odd_ids).collect()}) == 6


def test_near_duplicates(spark, docs, empty, odd_ids, monkeypatch):
    by_id = texts(docs)
    base = [f"b{k}" for k in range(200)]
    for k in range(40):  # a large group of near copies
        by_id[1000 + k] = " ".join([*base[:k], f"new{k}", *base[k + 1 :]])
    df = spark.createDataFrame(list(by_id.items()), "doc_id long, text string").repartition(3)
    want = brute_force(by_id)
    assert max(x[1] for x in want.values()) >= 39
    assert {r[0]: tuple(r)[1:4] for r in near.similar(df).collect()} == want
    for module in ("near", "links"):  # the same in many blocks
        monkeypatch.setattr(f"basalt.llm.{module}.BLOCK_ROWS", 7)
    assert {r[0]: tuple(r)[1:4] for r in near.similar(df).collect()} == want
    monkeypatch.undo()
    assert near.similar(empty).collect() == []
    got = sorted((tuple(r)[:4] for r in near.similar(odd_ids).collect()), key=repr)
    assert got == sorted([(None, None, 0, 2)] * 2 + [(1, 1, 0, 2)] * 2 + [(2, 2, 0, 2)] * 2, key=repr)
    kept = near.representatives(docs)
    classes = brute_force(texts(docs))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for c, _, _ in classes.values()}) and kept.columns == docs.columns
    assert near.representatives(odd_ids).count() == 3
    near_copies = [" ".join([*base[:k], f"new{k}", *base[k + 1 :]]) for k in range(6)]
    other = " ".join(f"other{k}" for k in range(30))
    for ids in ([None] * 6, [4] * 6, [None, None, 4, 4, 5, 5]):  # different texts of a class without ids, or with the same
        twice = spark.createDataFrame([*zip(ids, near_copies, strict=True)] * 2 + [(None, other)], "doc_id long, text string")
        left = near.representatives(twice).collect()
        assert sorted([r["text"] == other for r in left]) == [False, True]
        assert [r["doc_id"] for r in left if r["text"] != other] == [min((i for i in ids if i is not None), default=None)]


def test_links_with_empty_blocks(spark, monkeypatch):
    base = [f"b{k}" for k in range(60)]
    by_id = {10 * g + k: " ".join([f"g{g}", *base, *([f"new{k}"] if k else [])]) for g in range(8) for k in range(2 + g % 2)}
    by_id = {d: t.replace("b", f"b{d // 10}x") for d, t in by_id.items()}
    df = spark.createDataFrame(list(by_id.items()), "doc_id long, text string")
    want = brute_force(by_id)
    assert {x[1] for x in want.values()} == {1, 2}
    monkeypatch.setattr("basalt.llm.links.BLOCK_BYTES", 200)  # more blocks than nodes, so that most are empty
    assert {r[0]: tuple(r)[1:4] for r in near.similar(df).collect()} == want


def test_bands_follow_the_threshold(spark):
    assert [near.band_rows(t) for t in (1.0, 0.8, 0.6, 0.5, 0.2)] == [4, 4, 2, 2, 1]
    for t in (0.0, 0.05, 1.5):
        with pytest.raises(ValueError, match="can't be told"):
            near.band_rows(t)
    base = [f"b{k}" for k in range(60)]
    df = spark.createDataFrame([(k, " ".join([*base[k:], *[f"n{k}x{j}" for j in range(k)]])) for k in range(0, 18, 3)], "doc_id long, text string")
    by_id = texts(df)
    got = {r["doc_id"]: r["n_links"] for r in near.similar(df, threshold=0.6).collect()}
    sets = {d: shingled(t) for d, t in by_id.items()}
    assert got == {d: sum(5 * len(s & u) >= 3 * len(s | u) for e, u in sets.items() if e != d) for d, s in sets.items()} and max(got.values()) > 2


def test_overlaps():
    rng = np.random.default_rng(3)
    for _ in range(60):
        sets = [np.unique(rng.integers(0, 12, rng.integers(0, 12))) for _ in range(rng.integers(1, 20))]
        block = rng.integers(0, 2, len(sets))
        begin = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
        flat = np.concatenate(sets).astype(np.int64)
        for own in (None, block if block.min() != block.max() else None):
            got = sorted((min(i, j), max(i, j)) for i, js in links.overlaps(flat, begin, own, 0.6) for j in js.tolist())
            want = [(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if len(sets[i]) and len(sets[j]) and 5 * len(np.intersect1d(sets[i], sets[j])) >= 3 * len(np.union1d(sets[i], sets[j])) and (own is None or own[i] != own[j])]
            assert got == want


def test_posterior():
    least = [near.least_matches(n) for n in range(16, 97, 16)]
    assert least == sorted(least) and 0 < least[0] < 0.8 * 16 and least[-1] < 0.8 * 96


def brute_force_lines(by_id):
    first, where = {}, defaultdict(list)
    for d in sorted(by_id):
        for k, line in enumerate(by_id[d].split("\n") if by_id[d] else []):
            s = frozenset(words(line))
            if s:
                first.setdefault(s, (d, k))
                where[d].append((k, s))
    linked = {s: [u for u in first if u != s and 5 * len(s & u) >= 4 * len(s | u)] for s in first}
    least = {s: min([first[s], *(first[u] for u in linked[s])]) for s in first}
    return {d: ([k for k, s in where[d] if (d, k) > least[s]], sum(len(linked[s]) for _, s in where[d])) for d in by_id}


def test_lines(docs, empty, odd_ids, monkeypatch):
    by_id = texts(docs)
    want = brute_force_lines(by_id)
    assert sum(len(r) for r, _ in want.values()) > 10
    got = lines.matches(docs)
    assert {r["doc_id"]: (r["removed_lines"], r["n_links"]) for r in got.collect()} == want
    assert {r["doc_id"]: r["n_lines"] for r in got.collect()} == {d: len(t.split("\n")) if t else 0 for d, t in by_id.items()}
    left = {r["doc_id"]: r["text"] for r in lines.strip(docs, got).collect()}
    for d, t in by_id.items():
        assert (left[d] or "") == "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[d][0])
    monkeypatch.setattr("basalt.llm.lines.HOT_ROWS", 3)
    monkeypatch.setattr("basalt.llm.lines.BLOCK_ROWS", 2)
    monkeypatch.setattr("basalt.llm.lines.LARGE_ROWS", 1)
    monkeypatch.setattr("basalt.llm.links.BLOCK_ROWS", 2)
    assert {r["doc_id"]: (r["removed_lines"], r["n_links"]) for r in lines.matches(docs).collect()} == want
    monkeypatch.undo()
    assert lines.matches(empty).collect() == []
    assert sorted(((r["doc_id"], r["n_removed"]) for r in lines.matches(odd_ids).collect()), key=repr) == sorted([(None, 0)] * 2 + [(1, 0)] * 2 + [(2, 0)] * 2, key=repr)


def test_sets_of_more_than_2_20_lines():
    n = (1 << 20) + 50
    b = next(blocks(pa.array(["".join(f"a{k % 7} b{k % 11}\n" for k in range(n))])))
    s = lines.Sets(b, (np.arange(1 << 20) % 4096).astype(np.uint16))
    assert s.number.tolist() == list(range(n)) and (np.diff(s.at) == 2).all()
    assert len(set(zip(s.lo.tolist(), s.hi.tolist(), strict=True))) == 77


def test_lines_of_texts_with_equal_ids(spark):
    rows = []
    for d in (None, 5):
        for g in range(12):
            x = f"d{d}g{g}"
            rows += [(d, "\n".join([" ".join(f"{x}w{k}" for k in range(9)), f"only {x}"])), (d, "\n\n" + " ".join(f"{x}w{k}" for k in range(10)))]
    rows += [(9, " ".join(f"dNoneg3w{k}" for k in range(9)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in lines.matches(df).collect()), key=repr)
    want = [r for d in (None, 5) for _ in range(12) for r in ((d, 2, 0, 1, []), (d, 3, 1, 1, [2]))]
    assert got == sorted([*want, (9, 1, 1, 1, [0])], key=repr)
