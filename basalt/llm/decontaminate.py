"""Benchmark decontamination by a prefix-filtered join on exact containment of item windows.

Windows of ten item words must occur whole, so the required overlap is all of a window and its necessary prefix is one
token: its rarest, by counts over all documents. Document words that are some window's prefix token give
candidates; the positional bound places the window around the token, the length bound asks that it lies in
the document, and verification compares every word: hashes first, then bytes. A window occurs in many items or many
times in a document without cost beyond its occurrences.

The benchmark is the stated query set. It is cut into blocks of at most BLOCK_WORDS words and BLOCK_BYTES bytes (or one
longer word), the proven bound of what is broadcast at once; a worker with several blocks holds one of them and
HELD_BYTES of text at a time. Two scans read the corpus, however many blocks there are. Documents are never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import freeing, ship, table
from .rarity import bucket, bucket_counts
from .words import Block, blocks, eights, numbered, same_spans

WINDOW, BLOCK_WORDS, BLOCK_BYTES, HELD_BYTES, AT_ONCE = 10, 1 << 18, 1 << 23, 1 << 25, 1 << 20


def _ragged(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers begin[i] to begin[i] + count[i] - 1 for every i, one after the other."""
    end = np.cumsum(count)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(begin - (end - count), count)


class HashClash(Exception):
    """Two different words of a block have one hash under this seed."""


class Index:
    """Distinct windows of a block of items: their words, the items that hold them, and each window under its rarest token."""

    def __init__(self, ids: list[str], texts: list[str], window: int, counts: np.ndarray, seed: int):
        self.ids = ids
        b = next(blocks(pa.array(texts, pa.string()), chunk=1 << 62, seed=seed), None)
        at, hashes = (b.at, b.hashes) if b is not None else (np.zeros(1, np.int64), np.zeros(0, np.uint64))
        number, first = numbered(b.low, b.starts, b.ends, hashes) if len(hashes) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        vocabulary = hashes[first]
        if len(np.unique(vocabulary)) < len(vocabulary):
            raise HashClash
        size = (b.ends - b.starts)[first] if len(first) else np.zeros(0, np.int64)
        self.low = b.low[_ragged(b.starts[first], size)] if len(first) else np.zeros(0, np.uint8)
        self.word_at = np.concatenate([[0], np.cumsum(size)])

        n = np.diff(at)
        each = np.where(n >= window, n - window + 1, np.minimum(n, 1))
        start, item = _ragged(at[:-1], each), np.repeat(np.arange(len(n)), each)
        length = np.minimum(n[item], window)
        full = np.full((len(start), window + 1), -1, dtype=np.int64)
        full[:, 0] = length
        for k in range(window):
            here = length > k
            full[here, k + 1] = number[start[here] + k]
        full, which = np.unique(full, axis=0, return_inverse=True)
        which = which.ravel()
        self.size, self.numbers = full[:, 0], full[:, 1:].astype(np.int32)
        order = np.argsort(which, kind="stable")
        self.items = item[order]
        self.items_at = np.searchsorted(which[order], np.arange(len(full) + 1))
        self.hashes = vocabulary

        rarity = counts[bucket(vocabulary)]
        inside = self.numbers >= 0
        rank = np.where(inside, rarity[self.numbers] if len(rarity) else 0, np.iinfo(np.int64).max)
        offset = rank.argmin(axis=1) if len(rank) else np.zeros(0, np.int64)
        token = vocabulary[self.numbers[np.arange(len(offset)), offset]] if len(offset) else np.zeros(0, np.uint64)
        order = np.argsort(token, kind="stable")
        self.prefix = np.unique(token)
        self.lead = np.zeros(1 << 16, dtype=bool)  # of the leading 16 bits
        self.lead[(self.prefix >> np.uint64(48)).astype(np.int64)] = True
        self.begin = np.searchsorted(token[order], self.prefix)
        self.count = np.diff(np.append(self.begin, len(order)))
        self.window, self.offset = order, offset[order]

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the words that are prefix tokens, and their numbers."""
        if not len(self.prefix):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pos = np.flatnonzero(self.lead[(words >> np.uint64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.prefix, words[pos]), len(self.prefix) - 1)
        hit = self.prefix[at] == words[pos]
        return pos[hit], at[hit]

    def occurrences(self, b: Block) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window) of every occurrence in the block's rows."""
        pos, token = self.find(b.hashes)
        found, lo = [], 0
        reach = np.cumsum(self.count[token])
        while lo < len(pos):
            hi = max(lo + 1, int(np.searchsorted(reach, (reach[lo - 1] if lo else 0) + AT_ONCE, "right")))
            n = self.count[token[lo:hi]]
            post = _ragged(self.begin[token[lo:hi]], n)
            word, win = np.repeat(pos[lo:hi], n), self.window[post]
            start = word - self.offset[post]
            row = np.searchsorted(b.at, word, "right") - 1
            ok = (start >= b.at[row]) & (start + self.size[win] <= b.at[row + 1])
            start, win = start[ok], win[ok]
            for k in range(self.numbers.shape[1]):
                number = self.numbers[win, k]
                ok = (number < 0) | (b.hashes[np.minimum(start + k, len(b.hashes) - 1)] == self.hashes[number])
                start, win = start[ok], win[ok]
            found.append((start, win))
            lo = hi
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return self._compared(b, np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found]))

    def _compared(self, b: Block, start: np.ndarray, win: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those whose words have the very bytes of the window's."""
        left, right = eights(b.low), eights(self.low)
        for k in range(self.numbers.shape[1] if len(start) else 0):
            number = self.numbers[win, k]
            ok = number < 0
            some = np.flatnonzero(~ok)
            at, number = start[some] + k, number[some]
            ok[some] = same_spans(b.low, b.starts[at], b.ends[at], self.low, self.word_at[number], self.word_at[number + 1], left, right)
            start, win = start[ok], win[ok]
        return start, win


def _pieces(text: str, window: int) -> Iterator[tuple[str, int]]:
    """(part of a text, its words): windows of the parts are those of the whole, and no part exceeds a block."""
    b = next(blocks(pa.array([text])))
    n, lo = len(b.hashes), 0
    raw = text.encode()
    while lo < n:
        hi = min(n, lo + BLOCK_WORDS, max(lo + window, int(np.searchsorted(b.ends, b.starts[lo] + BLOCK_BYTES, "right"))))
        whole = lo == 0 and hi == n
        yield (text if whole else raw[b.starts[lo] : b.ends[hi - 1]].decode()), hi - lo
        lo = n if hi == n else max(lo + 1, hi - window + 1)


def _build(benchmark: DataFrame, id_col: str, text_col: str, window: int, counts: np.ndarray, seed: int) -> Iterator[Index]:
    ids, texts, words, size, some = [], [], 0, 0, False
    items = benchmark.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    for row in items.orderBy("id", "text").toLocalIterator():
        for text, n in _pieces(row["text"] or "", window):
            if ids and (words + n > BLOCK_WORDS or size + len(text) > BLOCK_BYTES):
                yield Index(ids, texts, window, counts, seed)
                ids, texts, words, size, some = [], [], 0, 0, True
            ids.append("" if row["id"] is None else row["id"])
            texts.append(text)
            words, size = words + n, size + len(text)
    if ids or not some:
        yield Index(ids, texts, window, counts, seed)


class Decontaminator:
    """Windows of a benchmark, indexed by word counts over all of docs.

    Item texts that are null or have no words have no window; null item ids count as empty ones. Items of one id
    are one item; an empty benchmark finds nothing. Words: see words.py.
    """

    def __init__(self, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", id_col: str = "item_id", item_text_col: str = "text"):
        self.text_col, self.seed = text_col, 0
        spark = docs.sparkSession
        ship(spark)
        texts = docs.select(F.col(text_col).cast("string").alias("text"))
        counts = bucket_counts(texts)
        while True:
            self.shared = []
            try:
                for index in _build(benchmark, id_col, item_text_col, window, counts, self.seed):
                    self.shared.append(spark.sparkContext.broadcast(index))
                break
            except HashClash:  # any order is right, so the counts may be those of other hashes
                for x in self.shared:
                    x.destroy()
                self.seed += 1

    def _batches(self, column: pa.Array) -> Iterator[list[Block]]:
        """Blocks of text; of several blocks of the benchmark each meets all that are held."""
        held: list[Block] = []
        for b in blocks(column, seed=self.seed):
            held.append(b)
            if len(self.shared) == 1 or sum(len(x.buf) for x in held) >= HELD_BYTES:
                yield held
                held = []
        if held:
            yield held

    def judged(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """Per row: words, hit words, items, sha256 of the items. Runs in a worker."""
        n = len(column)
        words, hit, items, sha = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), [hashlib.sha256(b"").hexdigest()] * n
        for held in self._batches(column):
            covered = [np.zeros(len(b.hashes) + 1, dtype=np.int64) for b in held]
            names: dict[int, set[str]] = {}
            for shared in self.shared:
                index = shared.value
                for b, cover in zip(held, covered, strict=True):
                    start, win = index.occurrences(b)
                    if not len(start):
                        continue
                    np.add.at(cover, start, 1)
                    np.add.at(cover, start + index.size[win], -1)
                    row = np.searchsorted(b.at, start, "right") - 1
                    pairs = np.unique(np.column_stack([row, win]), axis=0)
                    count = np.diff(index.items_at)[pairs[:, 1]]
                    of = index.items[_ragged(index.items_at[pairs[:, 1]], count)]
                    for r, i in zip(np.repeat(pairs[:, 0], count).tolist(), of.tolist(), strict=True):
                        names.setdefault(b.lo + r, set()).add(index.ids[i])
                if len(self.shared) > 1:
                    vars(shared).pop("_value", None)  # read again from the worker's disk when it is next needed
            for b, cover in zip(held, covered, strict=True):
                inside = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
                words[b.lo : b.hi] = np.diff(b.at)
                hit[b.lo : b.hi] = np.diff(inside[b.at])
            for r, found in names.items():
                items[r] = len(found)
                sha[r] = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        return words, hit, items, sha

    def report(self, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
        """One row per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

        Null and empty texts have no words and no hits; null and repeated ids and rows are judged each; whole texts are, of any
        length. An empty table gives no rows; other columns are not read.
        """
        rows = docs.select(F.col(id_col).alias("doc_id"), F.col(self.text_col).cast("string").alias("text"))
        schema = rows.select("doc_id").schema.add("n_words", "long").add("n_hit", "long").add("n_items", "long").add("items_sha256", "string").add("contaminated", "boolean")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                words, hit, items, sha = self.judged(batch.column(1))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(hit), pa.array(items), pa.array(sha, pa.string()), pa.array(hit > 0)], names=schema.names)

        return rows.mapInArrow(freeing(run), schema)

    def clean(self, docs: DataFrame) -> DataFrame:
        """The rows of docs without a hit word, all columns as they are, whatever their names.

        Null and empty texts are clean; repeated rows stay repeated; an empty table stays empty. Fields of ids are not read.
        """
        at = docs.columns.index(self.text_col)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(self.judged(batch.column(at))[1] == 0))

        return docs.mapInArrow(freeing(run), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return Decontaminator(docs, table(spark, sf_dir, "benchmark")).report(docs)


SQL = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item, n, array_to_string(w[k:k + n - 1], ' ') AS win
  FROM (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT doc_id, k, bw.n, item FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
h AS (SELECT doc_id, COUNT(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, COUNT(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN i ON i.doc_id = d.doc_id
"""
