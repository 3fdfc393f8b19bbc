"""An n-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of five-word shingles. Equal texts are one node from the start. 96 MinHash values per node
in 24 bands of 4 make candidates: a pair of similarity 0.8 shares no band once in 300,000 pairs (lower thresholds get more
bands of fewer values). Within a bucket
pairs are compared 16 values at a time and dropped as soon as the posterior probability that their
similarity reaches the threshold (uniform prior) is below TOLERANCE. Components of what is left are
verified exactly, all pairs of a component, on the words' bytes: see links.py.

Skew: a bucket with many rows is cut into blocks, and blocks meet pairwise in cells of their own; a task holds a
cell. Only rows of shared buckets carry signatures. Texts of documents that are in a component move to its cells.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, freeing, join_on, table
from .links import BLOCK_ROWS, KEY, across, components, dealt, fixed, grouped, spanning, stars_of, verify
from .words import NO_WORD, blocks, shingles

WORDS, THRESHOLD, TOLERANCE = 5, 0.8, 1e-6
HASHES, STEP, MISS = 96, 16, 1e-5

_rng = np.random.Generator(np.random.PCG64(96))
_XOR = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_MUL, _MUL2 = (_rng.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1) for _ in range(2))


def minhash(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """HASHES minima for each set of 64-bit hashes; begin: where the sets start, none of them empty."""
    x = (values >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(begin), HASHES), dtype=np.uint32)
    for k in range(HASHES):
        h = (x ^ _XOR[k]) * _MUL[k]
        h ^= h >> np.uint32(15)
        h *= _MUL2[k]
        out[:, k] = np.minimum.reduceat(h, begin)
    return out


def _signatures(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, those from it on that have words, their minima). A long text comes in parts, each with the last words of the one before."""
    held, least = np.zeros(0, np.uint64), None
    for b in blocks(column, cut=NO_WORD):
        if not b.skip and not b.rest:
            values, at = shingles(b.hashes, b.at, WORDS)
            some = np.flatnonzero(np.diff(at))
            if len(some):
                yield b.lo, some, minhash(values, at[:-1][some])
            continue
        if not b.skip:
            held, least = b.hashes[:0], None
        words = np.concatenate([held, b.hashes])
        if len(words) >= WORDS or not b.rest and least is None and len(words):
            mins = minhash(shingles(words, np.array([0, len(words)]), WORDS)[0], np.array([0]))
            least = mins if least is None else np.minimum(least, mins)
        held = words[-(WORDS - 1) :]
        if not b.rest and least is not None:
            yield b.lo, np.array([0]), least


def least_matches(n: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """The fewest matches among n values with which P(similarity >= threshold) is at least tolerance.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), whose tail is that of a binomial of n + 1 draws.
    """
    tail = 0.0
    for m in range(n + 1):
        tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if tail >= tolerance:
            return m
    return n


def band_rows(threshold: float) -> int:
    """Values in a band: the most with which a pair at threshold shares no band at a chance of at most MISS."""
    for rows in (4, 3, 2, 1):
        if 0 < threshold <= 1 and (1 - threshold**rows) ** (HASHES // rows) <= MISS:
            return rows
    raise ValueError(f"candidates of similarity {threshold} can't be told from {HASHES} values")


def _digest(text: Column) -> Column:
    return F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 2 * KEY))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), _digest(text).alias("node"), text.alias("text"))


def _signed(rows: DataFrame, per_band: int) -> DataFrame:
    """doc_id, node, keys (a 64-bit key per band), sig (16 bits of each value). keys and sig are null without words."""
    schema = rows.drop("text").schema.add("keys", "binary").add("sig", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys: list[bytes | None] = [None] * len(batch)
            sigs = keys.copy()
            for lo, some, mins in _signatures(batch.column(2)):
                key, sig = mins.astype("<u4").tobytes(), mins.astype("<u2").tobytes()
                for i, r in enumerate(some.tolist()):
                    keys[lo + r] = key[i * 4 * HASHES : (i + 1) * 4 * HASHES]
                    sigs[lo + r] = sig[i * 2 * HASHES : (i + 1) * 2 * HASHES]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], names=schema.names)

    width = 4 * per_band
    band = F.transform(F.sequence(F.lit(0), F.lit(HASHES // per_band - 1)), lambda k: F.xxhash64(k, F.substring(F.col("keys"), k * width + 1, F.lit(width))))
    out = rows.mapInArrow(freeing(run), schema)
    return out.withColumn("keys", F.when(F.col("keys").isNotNull(), band))


def _candidates(ws: Workspace, nodes: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """Spanning edges (a, b) of the pairs that share a bucket and outlast the pruning. Bucket sizes are saved, so that their join can be split."""
    at = nodes.where("keys is not null").select("node", F.explode("keys").alias("key"))
    shared = at.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = ws.save(shared.select("key", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks")), "shared")
    members = at.join(shared, "key").join(nodes.select("node", "sig"), "node").select("key", "node", "sig", "blocks")
    cells = dealt(members, ["key"], "blocks").select("key", "cell", "block", "node", "sig")
    steps = [(n, least_matches(n, threshold, tolerance)) for n in range(STEP, HASHES + 1, STEP)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in grouped(batches, 2):
            node, cell, block = fixed(t.column(3), KEY), t.column(1).to_numpy(), t.column(2).to_numpy()
            sig = fixed(t.column(4), 2 * HASHES).view("<u2")
            heads, tails = [], []
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if hi - lo < 2:
                    continue
                own = sig[lo:hi]

                def alike(i: int, js: np.ndarray, own: np.ndarray = own) -> np.ndarray:
                    same, done = np.zeros(len(js), dtype=np.int64), 0
                    for n, least in steps:
                        same = same + (own[js, done:n] == own[i, done:n]).sum(axis=1)
                        ok = same >= least
                        js, same, done = js[ok], same[ok], n
                    return js

                h, g = stars_of([node[k].tobytes() for k in range(lo, hi)], spanning(hi - lo, block[lo:hi], across(int(cell[lo])), alike))
                heads += h
                tails += g
            if heads:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in (heads, tails)], names=["a", "b"])

    return cells.mapInArrow(freeing(run), "a binary, b binary")


def similar(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, class_id, n_links, n_copies, node, head.

    n_links counts the different texts whose sets of five-word shingles have a Jaccard similarity of at least
    threshold with this one's; n_copies the rows with this very text, itself included; class_id is the smallest doc_id
    that links and copies lead to (null if all are); head is the node of one text with that id, the same for the whole
    class. A text with fewer than five words is one shingle. Texts
    without words, null and empty ones among them, have no links, but equal ones are copies; null counts as
    empty. Repeated rows are copies. An empty table gives no rows; other columns are not read.
    """
    per_band = band_rows(threshold)
    ws = Workspace(docs.sparkSession, "near")
    rows = _rows(docs, id_col, text_col)
    signed = ws.save(_signed(rows, per_band), "signed")
    nodes = signed.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n_copies"), F.first("keys").alias("keys"), F.first("sig").alias("sig"))
    nodes = ws.save(nodes, "nodes")
    edges = ws.save(_candidates(ws, nodes, threshold, tolerance), "candidates")
    inside = ws.save(components(ws, edges, "groups"), "inside")
    wanted = inside.join(nodes.select("node", F.col("rep").alias("doc_id")), "node")
    texts = ws.save(join_on(rows, wanted, ["node", "doc_id"]).dropDuplicates(["node"]).select("node", "root", "text"), "texts")
    counts, links = verify(ws, texts.withColumns({"doc": F.lit(0).cast("long"), "line": F.lit(0).cast("long")}), WORDS, threshold, "verified")
    root = components(ws, links, "classes")
    found = ws.save(counts.drop("first").join(root, "node", "left"), "found")
    classes = nodes.select("node", "rep", "n_copies").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = ws.save(classes, "classed")
    of = classes.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "node")).alias("least"))
    of = ws.save(of.select("root", F.col("least.rep").alias("class_id"), F.col("least.node").alias("head")), "heads")
    classes = ws.save(classes.join(of, "root").select("node", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies", "head"), "result")
    for x in ("shared", "candidates", "inside", "texts", "verified", "found", "nodes", "classed", "heads"):
        ws.drop(x)
    return signed.select("doc_id", "node").join(classes, "node").select("doc_id", "class_id", "n_links", "n_copies", "node", "head")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents with one row of each class, with all its columns: that of the smallest id.

    Should that id repeat, or all ids of a class be null, the text with the smallest digest decides, and of equal texts any row. Null texts
    count as empty; empty ones, and others without words, are alike only where they are equal, so that one of each
    stays. Whole texts count, of any length. An empty table stays empty; other columns, whatever their names, go along.
    """
    near = similar(docs, id_col=id_col, text_col=text_col, **options)
    keep = near.where(F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("node") == F.col("head"))).select("doc_id", "node").distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("doc_id"), _digest(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("node"))
    return join_on(rows, keep, ["node", "doc_id"], "left_semi").dropDuplicates(["node", "doc_id"]).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(table(spark, sf_dir, "documents")).drop("node", "head")


SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents),
r AS (
  SELECT t, MIN(doc_id) AS rep, COUNT(*) AS n_copies,
         regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM d GROUP BY t),
s AS (
  SELECT DISTINCT rep, array_to_string(w[k:k + 4], ' ') AS g
  FROM (SELECT rep, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM r WHERE len(w) > 0)),
n AS (SELECT rep, COUNT(*) AS n FROM s GROUP BY rep),
p AS (SELECT x.rep AS a, y.rep AS b, COUNT(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.rep <> y.rep GROUP BY x.rep, y.rep),
l AS (SELECT a, b FROM p JOIN n na ON na.rep = a JOIN n nb ON nb.rep = b WHERE 5 * c >= 4 * (na.n + nb.n - c)),
reach AS (SELECT rep AS a, rep AS b FROM r UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b),
cls AS (SELECT a, MIN(b) AS class_id FROM reach GROUP BY a),
cnt AS (SELECT a, COUNT(*) AS n_links FROM l GROUP BY a)
SELECT d.doc_id, class_id, coalesce(n_links, 0) AS n_links, n_copies
FROM d JOIN r ON r.t = d.t JOIN cls ON cls.a = r.rep LEFT JOIN cnt ON cnt.a = r.rep
"""
