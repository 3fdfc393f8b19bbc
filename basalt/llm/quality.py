"""A quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are counted with numpy over Arrow buffers, whole texts, nothing else of a row. The trees are
trained on the driver from a sample of at most about TRAIN_ROWS labelled rows, chosen by a hash of doc_id, and
flattened into arrays; scoring walks all rows of a batch down a tree at once. Documents are never shuffled: the sampled
ids are broadcast to the scan, the sample's statistics (a few hundred bytes a row) move, and scoring runs where a
document is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import Workspace, freeing, ship, table
from .words import CHUNK, blocks, shingles, span_hashes

TRAIN_ROWS, FOLDS, THRESHOLD = 30_000, 5, 0.3

#: classes of bytes whose shares are statistics
_CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", "\t\r\x0b\x0c", ".", ",", "!", "?", "#", "$", "%", "&", "*", "|", "<>", "/\\", "@", ":;", "'\"", "()[]{}", "-_", "=+~^`"]
_CLASS = np.full(256, len(_CLASSES), dtype=np.int64)  # other control characters
for _k, _c in enumerate(_CLASSES):
    _CLASS[np.frombuffer(_c.encode(), np.uint8)] = _k
_CLASS[128:192] = len(_CLASSES) + 1  # later bytes of a character
_CLASS[192:] = len(_CLASSES) + 2  # a character beyond ASCII
_KINDS = len(_CLASSES) + 3
FEATURES = [*(f"share_{k}" for k in range(_KINDS)), "log_bytes", "log_words", "word_bytes", "word_bytes_sd", "short_words", "long_words", "distinct_words", "top_word", "distinct_shingles", "log_lines", "line_bytes", "distinct_lines", "short_lines", "bytes_per_word"]


def _repeats(values: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """How many different values each row has, and how often its most frequent one occurs there. Values are hashes, of which the row's bits are spared."""
    most, bits = np.zeros(rows, dtype=np.int64), np.uint64(rows.bit_length())
    if not len(values):
        return most, most
    key = np.sort((row.astype(np.uint64) << (np.uint64(64) - bits)) | (values >> bits))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    own = (key[first] >> (np.uint64(64) - bits)).astype(np.int64)
    there = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    most[own[there]] = np.maximum.reduceat(np.diff(np.append(first, len(key))), there)
    return np.bincount(own, minlength=rows), most


def statistics(column: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text; an empty or null text has zeros. Counted block by block, all rows of a block at once."""
    out = np.zeros((len(column), len(FEATURES)), dtype=np.float32)
    for b in blocks(column):
        rows, some = b.hi - b.lo, np.diff(b.offsets) > 0
        n = np.maximum(np.diff(b.offsets), 1).astype(np.float64)
        shares = np.zeros(rows * _KINDS)
        for lo in range(0, len(b.buf), CHUNK):  # more than one step only for a longer text
            hi = min(lo + CHUNK, len(b.buf))
            each = np.diff(b.offsets.clip(lo, hi))
            shares += np.bincount(_CLASS[b.buf[lo:hi]] + np.repeat(np.arange(rows) * _KINDS, each), minlength=rows * _KINDS)
        shares = shares.reshape(rows, _KINDS) / n[:, None]

        words = np.diff(b.at)
        many, row = np.maximum(words, 1), np.repeat(np.arange(rows), words)
        size = (b.ends - b.starts).astype(np.float64)

        def mean(x: np.ndarray, row: np.ndarray = row, many: np.ndarray = many, rows: int = rows) -> np.ndarray:
            return np.bincount(row, x, rows) / many

        average = mean(size)
        spread = np.sqrt(mean((size - average[row]) ** 2))
        distinct, most = _repeats(b.hashes, row, rows)
        shingle, first = shingles(b.hashes, b.at, 5)
        grams, _ = _repeats(shingle, np.repeat(np.arange(rows), np.diff(first)), rows)

        feeds = np.flatnonzero(b.buf == 10)
        start = np.sort(np.concatenate([b.offsets[:-1], feeds + 1]))  # a row begins with a line, even where the one before it ends in a feed
        lines = np.diff(np.searchsorted(feeds, b.offsets)) + 1
        row = np.repeat(np.arange(rows), lines)
        line = np.diff(np.append(start, len(b.buf)))
        ended = np.ones(len(line), dtype=bool)
        ended[np.cumsum(lines) - 1] = False
        line = line - ended
        different, _ = _repeats(span_hashes(b.buf, start, start + line), row, rows)
        columns = [
            np.log1p(n), np.log1p(words), average, spread, mean(size <= 3), mean(size >= 12), distinct / many, most / many, grams / np.maximum(np.diff(first), 1),
            np.log1p(lines), np.bincount(row, line, rows) / lines, different / lines, np.bincount(row, line < 20, rows) / lines, n / (words + 1),
        ]
        out[b.lo : b.hi] = np.where(some[:, None], np.column_stack([shares, *columns]), 0)
    return out


@dataclass
class Trees:
    """Boosted trees as arrays: node k of all trees splits feature[k] at threshold[k] into left[k] and right[k]; a leaf leads to itself."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def train(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: int = 5) -> Trees:
    """Newton boosting of log loss over histograms, level by level. Without rows every score is 1/2; with one label only, near that label."""
    n, m = x.shape
    up = float((y.sum() + 0.5) / (n + 1))
    base = float(np.log(up / (1 - up)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(m)]
    code = np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)]) + np.arange(m) * bins if n else np.zeros((0, m), int)
    roots: list[int] = []
    nodes: list[list[float]] = []
    total = np.full(n, base)
    for _ in range(rounds if n and 0 < y.sum() < n else 0):
        p = 1 / (1 + np.exp(-total))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
        first = len(nodes)
        roots.append(first)
        at, level = np.full(n, first), [first]
        nodes.append([0, 0.0, first, first, 0.0])
        for d in range(depth + 1):
            slot = np.full(len(nodes), -1)
            slot[level] = np.arange(len(level))
            live = np.flatnonzero(slot[at] >= 0)
            if not len(live):
                break
            key = (slot[at[live]][:, None] * (m * bins) + code[live]).ravel()
            size = len(level) * m * bins
            g, h, c = (np.bincount(key, w, size).reshape(len(level), m, bins) for w in (np.repeat(grad[live], m), np.repeat(hess[live], m), None))
            gt, ht = g[:, 0].sum(1), h[:, 0].sum(1)
            gl, hl, cl = g.cumsum(2), h.cumsum(2), c.cumsum(2)
            gr, hr, cr = gt[:, None, None] - gl, ht[:, None, None] - hl, cl[:, :, -1:] - cl
            gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - (gt**2 / (ht + l2))[:, None, None]
            gain[(cl < least) | (cr < least)] = -1
            best = gain.reshape(len(level), -1).argmax(1)
            following = []
            for i, k in enumerate(level):
                j, b = divmod(int(best[i]), bins)
                nodes[k][4] = -rate * gt[i] / (ht[i] + l2)
                if d < depth and gain[i, j, b] > 1e-3 and b < len(edges[j]):
                    kids = [len(nodes), len(nodes) + 1]
                    nodes[k][:4] = [j, float(edges[j][b]), *kids]
                    nodes += [[0, 0.0, kids[0], kids[0], 0.0], [0, 0.0, kids[1], kids[1], 0.0]]
                    following += kids
                    own = live[at[live] == k]
                    at[own] = np.where(code[own, j] - j * bins <= b, kids[0], kids[1])
            level = following
            if not level:
                break
        total += np.array([v[4] for v in nodes])[at]
    flat = np.array(nodes, dtype=np.float64).reshape(-1, 5)
    return Trees(np.array(roots, dtype=np.int64), flat[:, 0].astype(np.int64), flat[:, 1].astype(np.float32), flat[:, 2].astype(np.int64), flat[:, 3].astype(np.int64), flat[:, 4], base, depth)


def fold(id_col: str = "doc_id"):
    """crc32 of the id as text, mod FOLDS; 0 is held out. A null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Trees:
    """Trees from documents with a label outside fold 0.

    At most about train_rows labelled ids are sampled, those whose hash is under the share that this is of all. Their
    table, which this bounds, is broadcast, so that texts stay where they are read and only sampled ones are counted.
    Null labels are none; of several labels of a document the largest counts. Of rows that repeat an id one counts,
    that with the smallest statistics, so that no id collects more than a row. Without labelled rows every score is 1/2.
    """
    ws = Workspace(docs.sparkSession, "quality")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(fold("doc_id") != 0)
    schema = rows.select("doc_id").schema.add("x", ArrayType(FloatType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column(1))
            at = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(at, pa.array(x.ravel()))], names=["doc_id", "x"])

    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("y")).where("y is not null and doc_id is not null")
    marks = marks.where(fold("doc_id") != 0).groupBy("doc_id").agg((F.max("y") > 0).cast("int").alias("y"))
    n = marks.count()
    if n > train_rows:
        marks = marks.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) < int((1 << 30) * train_rows / n))
    marks = ws.save(marks, "marks")
    counted = rows.join(F.broadcast(marks.select("doc_id")), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(freeing(run), schema)
    one = counted.groupBy("doc_id").agg(F.min("x").alias("x"))
    seen = ws.save(one.join(F.broadcast(marks), "doc_id").select("x", "y", F.xxhash64("doc_id").alias("order")), "statistics")
    got = seen.toPandas().sort_values("order", kind="stable") if n else None
    for name in ("marks", "statistics"):
        ws.drop(name)
    x = np.array(got["x"].tolist(), dtype=np.float32) if got is not None and len(got) else np.zeros((0, len(FEATURES)), np.float32)
    return train(x, got["y"].to_numpy(dtype=float) if len(x) else np.zeros(0))


def score(docs: DataFrame, trees: Trees, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Null texts are scored as empty ones, whole texts of any length at once; null ids count as empty texts for held_out; repeated rows
    get the same score each. An empty table gives no rows; other columns are not read.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(trees)  # rounds x 2^depth nodes, whatever the corpus
    rows = docs.select(F.col(id_col).alias("doc_id"), (fold(id_col) == 0).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    schema = rows.select("doc_id", "held_out").schema.add("score", "double").add("predicted", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = shared.value.score(statistics(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=schema.names)

    return rows.mapInArrow(freeing(run), schema)


def keep(docs: DataFrame, trees: Trees, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of docs that score at least threshold, all columns as they are, whatever their names.

    Null texts are scored as empty ones; only the text is read, so that null and repeated ids don't matter; repeated rows stay or go
    together. An empty table stays empty.
    """
    ship(docs.sparkSession)
    shared, at = docs.sparkSession.sparkContext.broadcast(trees), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.score(statistics(batch.column(at))) >= threshold))

    return docs.mapInArrow(freeing(run), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
