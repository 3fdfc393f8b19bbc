"""Mixing sources to target weights by the cube method.

A source with target T and size S takes every document floor(T / S) times, and the remaining fraction as an
inclusion probability. The flight phase moves probabilities along the null space of the constraints (token
total, document total): three undecided documents at a time, until one of them is at 0 or 1. It runs in
buckets of a source, in parallel; each leaves two undecided documents at most, which fly again in buckets of
their own until a source has one; the landing phase rounds its last two so that the token total is met best.

Skew: the rows of a source are ranked in a seeded order, by a range sort, and cut into buckets of bucket_rows ranks; so no
bucket has more, however large the source is and however often an id or a whole row repeats.
Only ids, hashes and sizes are shuffled, never text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, freeing, join_on, numbered_rows, place, ranked, table
from .words import count_runs

WEIGHTS, MOST, BUCKET_ROWS, SEED = (5, 2, 1), 3, 2_000, 8
_IN_WORD = np.ones(256, dtype=bool)
_IN_WORD[[0x20, *range(0x09, 0x0E)]] = False


def flight(p: np.ndarray, size: np.ndarray, rand: np.random.Generator) -> np.ndarray:
    """Probabilities after the flight phase: sums of p and of p * size stay, at most two are left inside (0, 1)."""
    p, s, alive, todo = p.astype(float).tolist(), size.astype(float).tolist(), [], iter(range(len(p)))
    draws = iter(rand.random(len(p) + 3).tolist())
    while True:
        while len(alive) < 3 and (i := next(todo, None)) is not None:
            if 0 < p[i] < 1:
                alive.append(i)
        if len(alive) < 2:
            break
        if len(alive) == 3:
            a, b, c = (s[i] for i in alive)
            move = (c - b, a - c, b - a)
            if not any(move):
                move = (1.0, -1.0, 0.0)
        elif s[alive[0]] == s[alive[1]]:
            move = (1.0, -1.0)
        else:
            break
        largest = max(map(abs, move))
        pairs = [(i, m / largest) for i, m in zip(alive, move, strict=True) if m]
        up = min((1 - p[i]) / m if m > 0 else p[i] / -m for i, m in pairs)
        down = min(p[i] / m if m > 0 else (1 - p[i]) / -m for i, m in pairs)
        step = up if next(draws) * (up + down) < down else -down
        for i, m in pairs:
            x = p[i] + step * m
            p[i] = 0.0 if x < 1e-9 else 1.0 if x > 1 - 1e-9 else x
        if all(0 < p[i] < 1 for i in alive):  # rounding kept the limiting one inside
            near = min(alive, key=lambda i: min(p[i], 1 - p[i]))
            p[near] = round(p[near])
        alive = [i for i in alive if 0 < p[i] < 1]
    return np.array(p)


def landing(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The last two, rounded so that first tokens and then documents are nearest to what was asked."""
    p = p.copy()
    left = np.flatnonzero((p > 0) & (p < 1))
    best = min(range(1 << len(left)), key=lambda k: (abs(sum(size[i] * ((k >> j & 1) - p[i]) for j, i in enumerate(left))), abs(sum((k >> j & 1) - p[i] for j, i in enumerate(left))), k))
    for j, i in enumerate(left):
        p[i] = best >> j & 1
    return p


def _flown(land: bool, seed: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank", kind="stable")
        first = rows.iloc[0]
        name = f"{seed}|{first['source']}|{first['bucket']}|{land}"
        size = rows["size"].to_numpy()
        p = flight(rows["p"].to_numpy(), size, np.random.Generator(np.random.PCG64(zlib.crc32(name.encode()))))
        return rows.assign(p=landing(p, size) if land else p)

    return run


def sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, hash_col: str) -> DataFrame:
    """doc_id, source, size (runs of other than ASCII white space; null: 0), mix (a seeded hash of id and text that orders rows)."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(F.lit(seed), F.col(hash_col), text).alias("mix"), text.alias("text"))
    schema = rows.drop("text").schema.add("size", "long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(count_runs(b.column(3), _IN_WORD))], names=schema.names)

    return rows.mapInArrow(freeing(count), schema)


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, docs, source_size, target. One row per source; windows run over these rows alone.

    With caps c and weights w the water level is the largest (total - caps below) / weights from here on, over
    sources by c / w: below it a source is full, above it gets level * w.
    """
    per = rows.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("size").alias("source_size"))
    nth = (F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1) % len(weights)
    per = per.withColumn("w", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (nth + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size").cast("double") * most)
    order = Window.orderBy(F.col("cap") / F.col("w"), F.asc_nulls_last("source"))
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    below = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    beyond = F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    total = F.sum(F.col("source_size").cast("double")).over(whole)
    per = per.withColumn("level", (total - below) / beyond)
    return per.select("source", "docs", "source_size", F.least("cap", F.max("level").over(whole) * F.col("w")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED, bucket_rows: int = BUCKET_ROWS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", hash_col: str | None = None) -> DataFrame:
    """One row per input row: doc_id, size, source, source_size, target, copies, taken = copies * size.

    Null texts have size 0, null sources are one source. A source without words has target 0 and is taken 0
    times. Runs agree: order and draws come from hashes of text and doc_id (or hash_col, if given). Rows that repeat an id, null
    or not, are rows of their own; equal ones are interchangeable. An empty table gives no rows. Other columns are not read.
    """
    ws = Workspace(docs.sparkSession, "mix")
    rows = ws.save(sizes(docs, id_col, text_col, source_col, seed, hash_col or id_col), "sizes")
    per = ws.save(targets(rows, weights, most), "targets")
    order = ["mix", "size", *([] if hash_col else ["doc_id"]), "place"]
    rows = ranked(numbered_rows(ws, rows.withColumn("place", place()), [F.asc_nulls_last("source"), *order], "ordered"), "source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = join_on(rows.drop("of"), per, ["source"]).withColumn("rate", rate)
    rows = rows.withColumns({"whole": F.floor(F.col("rate") + 1e-12), "bucket": F.expr(f"rank div {bucket_rows}")})
    rows = rows.select("doc_id", "source", "rank", "size", "source_size", "target", "whole", F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0)).alias("p"), "bucket")
    largest = per.agg(F.max("docs")).first()[0] or 0
    inside = (F.col("p") > 0) & (F.col("p") < 1)
    level, out = 0, None
    while True:
        last = level and largest <= bucket_rows
        flown = rows.groupBy("source", "bucket").applyInPandas(_flown(bool(last), seed + level), rows.schema)
        if last:
            break
        flown = ws.save(flown, f"flown{level}")
        done = flown.where(~inside)
        out = done if out is None else out.unionByName(done)
        level, largest = level + 1, 2 * -(-largest // bucket_rows)  # a bucket leaves two rows at most
        buckets = -(-largest // bucket_rows)
        rows = flown.where(inside).withColumn("bucket", F.pmod(F.xxhash64(F.lit(level), "rank"), F.lit(buckets)))
    out = out.unionByName(flown).withColumn("copies", (F.col("whole") + F.col("p")).cast("long"))
    return out.select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The documents themselves, all columns, each row as often as the mix takes it: none, once, or up to `most` times.

    Reads the columns doc_id, text and source, which may hold nulls; rows that repeat, in part or as a whole, are rows of their own
    and told apart by their place. Empty texts count 0 words and are taken by the same chance as any other of their source. An empty
    table stays empty; other columns, whatever their names, go along.
    """
    ws = Workspace(docs.sparkSession, "mixed")
    held = ws.save(docs.select(F.struct("*").alias("row")).withColumn("uid", F.monotonically_increasing_id()), "rows")
    flat = held.select("uid", F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"), F.col("row.source").alias("source"))
    taken = mix(flat, id_col="uid", hash_col="doc_id", **options).where("copies > 0").select(F.col("doc_id").alias("uid"), "copies")
    out = held.join(taken, "uid").select("row", F.explode(F.expr("sequence(1, copies)")))
    return out.select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
