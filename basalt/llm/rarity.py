"""How often words occur over all documents, in a fixed table of 2^20 buckets of their hashes.

Filters that order words by rarity are exact under any order, so that a bucket which words share only makes them weaker.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import freeing
from .words import NO_WORD, blocks

BUCKETS, CHUNK_BUCKETS = 1 << 20, 1 << 12


def bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(44)).astype(np.int64)


def bucket_counts(texts: DataFrame, seed: int = 0) -> np.ndarray:
    """Words of the one column of texts by bucket, whatever the corpus 2^20 numbers, in one scan.

    Each task sums its own; rows of 2^12 buckets are shuffled, one per task and chunk, and summed up in 256 groups.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for b in blocks(batch.column(0), seed=seed, cut=NO_WORD):
                n += np.bincount(bucket(b.hashes), minlength=BUCKETS)
        parts = n.astype("<u4" if n.max() < 1 << 32 else "<u8").reshape(-1, CHUNK_BUCKETS)
        some = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([parts[k].tobytes() for k in some], pa.binary())], names=["chunk", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = sums.setdefault(k, np.zeros(CHUNK_BUCKETS, dtype=np.int64))
                own += np.frombuffer(v, f"<u{len(v) // CHUNK_BUCKETS}").astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([v.astype("<i8").tobytes() for v in sums.values()], pa.binary())], names=["chunk", "n"])

    out = np.zeros((BUCKETS // CHUNK_BUCKETS, CHUNK_BUCKETS), dtype=np.int64)
    rows = texts.mapInArrow(freeing(count), "chunk long, n binary").repartition("chunk").mapInArrow(freeing(add), "chunk long, n binary")
    for r in rows.collect():  # 256 rows of 32 KB, whatever the corpus
        out[r["chunk"]] += np.frombuffer(r["n"], "<i8")
    return out.ravel()
