"""Line deduplication by an exact set-similarity join.

A line is the set of its words. Lines with n words can only reach Jaccard similarity t with lines that share one of
their n - ceil(t n) + 1 rarest words, so each line is posted under these, its prefix. Lines of so few words that no
other set can be similar (n / (n + 1) < t) aren't posted. Words are ordered by counts over
the whole corpus in a fixed table of 2^20 buckets (any one order makes the filter exact; a bucket that
words share only makes it weaker). Postings of a word meet under four exact filters: length; position (what is
left of both lines after the shared word must suffice); and a 128-bit parity map of the words, whose
differing bits are a lower bound of the differing words. The components of what is left are verified on the
whole sets, words by their bytes, and a line goes if an earlier line, by (doc_id, line number), matches it. Components are chains of
what no filter ruled out; so those of more than LARGE_ROWS lines (16 blocks, up to which all pairs cost less than another
pass) are verified within the lines that met in one task first, and made anew of the links that hold.

Skew: equal lines are posted once by a task, and once after the shuffle; a word whose distinct postings exceed HOT_ROWS
is passed on and cut into blocks that meet pairwise in cells. Postings hold 64-bit ids, which only bring candidates
together; verification and results go by 128-bit keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, freeing, join_on, table
from .links import BLOCK_ROWS, KEY, components, dealt, grouped, verify
from .rarity import BUCKETS, bucket, bucket_counts
from .words import LINE_FEED, Block, blocks, mix

THRESHOLD, HOT_ROWS, LARGE_ROWS, PAIRS_AT_ONCE, SEEN = 0.8, 4096, 16 * BLOCK_ROWS, 1 << 18, 1 << 20
#: A posting has a word's hash, a line's 64-bit id, size << 32 | position, and the parity map; a line's row its document's
#: number, both halves of its key, -1 - its number in the text, and doc_id; a document's row its number, its text's hash, DOC, the number of lines and doc_id.
COLUMNS = ["token", "id", "meta", "x", "y"]
DOC = -(1 << 62)
_LO, _HI = np.uint64(0x1F83D9ABFB41BD6B), np.uint64(0x5BE0CD19137E2179)


def _line_of(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """Where lines begin in the block's bytes (a new one at each row and after each line feed), and the line of each word."""
    begin = np.unique(np.concatenate([b.offsets[:-1], np.flatnonzero(b.buf == 10) + 1]))
    return begin, np.searchsorted(begin, b.starts, "right") - 1


class Sets:
    """The word sets of a block's lines: hashes in order of rarity (then of hash), where each begins, the lines' numbers and keys."""

    def __init__(self, b: Block, rank: np.ndarray):
        begin, line = _line_of(b)
        q = rank[bucket(b.hashes)]
        packs = len(begin) <= 1 << 20  # else a line's number doesn't fit above its words' ranks
        major = (line.astype(np.uint64) << np.uint64(44)) | (q.astype(np.uint64) << np.uint64(32)) | (b.hashes >> np.uint64(32))
        order = np.argsort(major, kind="stable")
        h, m = b.hashes[order], major[order]
        if not packs or len(h) and bool(((m[1:] == m[:-1]) & (h[1:] != h[:-1])).any()):
            order = np.lexsort((b.hashes, q, line))
            h = b.hashes[order]
        line = line[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (line[1:] != line[:-1])
        self.words, line = h[new], line[new]
        first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(line) else np.zeros(0, np.int64)
        self.at = np.append(first, len(line))
        own = line[first]
        self.start, self.end = begin[own], np.append(begin, len(b.buf))[own + 1]
        self.row = np.searchsorted(b.offsets, begin[own], "right") - 1
        start = np.searchsorted(begin, b.offsets[:-1])
        self.number = own - start[self.row]
        feeds = np.searchsorted(np.flatnonzero(b.buf == 10), b.offsets)
        self.n_lines = np.diff(feeds) + (np.diff(b.offsets) > 0)
        if len(first):
            self.lo = mix(np.add.reduceat(mix(self.words ^ _LO), first)).view(np.int64)
            self.hi = mix(np.add.reduceat(mix(self.words ^ _HI), first)).view(np.int64)
        else:
            self.lo = self.hi = np.zeros(0, np.int64)


def _sets(column: pa.Array, rank: np.ndarray) -> Iterator[tuple[Block, Sets]]:
    """Blocks and their lines; a long text comes in parts of whole lines, which are numbered through."""
    before = 0
    for b in blocks(column, cut=LINE_FEED):
        s, before = Sets(b, rank), before if b.skip else 0
        s.number, s.n_lines = s.number + before, s.n_lines + before
        before += int(np.count_nonzero(b.buf == 10))
        yield b, s


def prefix_sizes(n: np.ndarray, threshold: float) -> np.ndarray:
    return n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1


def _ranks(counts: np.ndarray) -> np.ndarray:
    """12 bits that grow with the count."""
    return np.minimum(4095, 64 * np.log2(np.maximum(counts, 1))).astype(np.uint16)


def _posted(rows: DataFrame, rank, threshold: float) -> DataFrame:
    """COLUMNS: a row per document, per line with words, and per line and word of its prefix. A text's own rows go by its number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            uid, doc, text_hash = (batch.column(k).to_numpy() for k in (0, 1, 3))
            for b, s in _sets(batch.column(2), rank.value):
                n = np.diff(s.at)
                own, ids = uid[b.lo : b.hi], doc[b.lo : b.hi]
                if not b.rest:
                    yield _batch([own, text_hash[b.lo : b.hi], np.full(len(own), DOC), s.n_lines, ids])
                if not len(n):
                    continue
                yield _batch([own[s.row], s.lo, -1 - s.number, s.hi, ids[s.row]])
                ids, first = np.unique(s.lo, return_index=True)
                new = np.array([k not in seen for k in ids.tolist()], dtype=bool)
                if len(seen) < SEEN:  # beyond that lines are posted again, and dropped after the shuffle
                    seen.update(ids[new].tolist())
                fresh = np.sort(first[new])
                fresh = fresh[n[fresh] >= threshold * (n[fresh] + 1) - 1e-9]  # a word more, the nearest that another set can be
                bit = np.uint64(1) << (s.words & np.uint64(63))
                left = (s.words >> np.uint64(6)) & np.uint64(1) == 0
                x = np.bitwise_xor.reduceat(np.where(left, bit, np.uint64(0)), s.at[:-1]).view(np.int64)
                y = np.bitwise_xor.reduceat(np.where(left, np.uint64(0), bit), s.at[:-1]).view(np.int64)
                p = prefix_sizes(n[fresh], threshold)
                of = np.repeat(fresh, p)
                pos = np.arange(len(of)) - np.repeat(np.cumsum(p) - p, p)
                yield _batch([s.words[s.at[of] + pos].view(np.int64), s.lo[of], (n[of] << 32) | pos, x[of], y[of]])

    return rows.mapInArrow(freeing(run), ", ".join(f"{c} long" for c in COLUMNS))


def _batch(longs: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in longs], names=COLUMNS)


def candidates(at: np.ndarray, size: np.ndarray, pos: np.ndarray, x: np.ndarray, y: np.ndarray, block: np.ndarray | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of the same group, rows sorted by size within it, that the exact filters let through."""
    of = np.repeat(np.arange(len(at) - 1), np.diff(at))
    wide = int(size.max(initial=0)) + 2
    most = np.minimum(np.floor(size / threshold + 1e-9).astype(np.int64), wide - 1)
    last = np.searchsorted(of * wide + size, of * wide + most, "right")
    reach = np.cumsum(last - np.arange(len(of)) - 1)
    lo = 0
    while lo < len(of):
        hi = max(lo + 1, int(np.searchsorted(reach, (reach[lo - 1] if lo else 0) + PAIRS_AT_ONCE, "right")))
        n = last[lo:hi] - np.arange(lo, hi) - 1
        i = np.repeat(np.arange(lo, hi), n)
        j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + i + 1
        if block is not None:
            ok = block[i] != block[j]
            i, j = i[ok], j[ok]
        need = np.ceil(threshold / (1 + threshold) * (size[i] + size[j]) - 1e-9).astype(np.int64)
        ok = np.minimum(size[i] - pos[i], size[j] - pos[j]) >= need
        i, j, need = i[ok], j[ok], need[ok]
        apart = np.bitwise_count(x[i] ^ x[j]).astype(np.int64) + np.bitwise_count(y[i] ^ y[j])
        ok = size[i] + size[j] - apart >= 2 * need
        yield i[ok], j[ok]
        lo = hi


def stars(ids: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Edges (id, smallest id of its component) of the graph of pairs of rows, for rows whose ids differ."""
    i, j = (np.concatenate([p[k] for p in pairs]) if pairs else np.zeros(0, np.int64) for k in (0, 1))
    i, j = ids[i], ids[j]
    differ = i != j
    nodes, code = np.unique(np.concatenate([i[differ], j[differ]]), return_inverse=True)
    a, b = code[: differ.sum()], code[differ.sum() :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
        if (label == before).all():
            break
    some = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[some], nodes[label[some]]


def _met(t: pa.Table, at: np.ndarray, block: np.ndarray | None, threshold: float, place: int) -> pa.RecordBatch:
    """Edges: id, x (its star's center), y (place: where they met)."""
    ids, meta = t.column("id").to_numpy(), t.column("meta").to_numpy()
    x, y = (t.column(c).to_numpy().view(np.uint64) for c in "xy")
    a, b = stars(ids, list(candidates(at, meta >> 32, meta & 0xFFFFFFFF, x, y, block, threshold)))
    z = np.zeros(len(a), np.int64)
    return _batch([z, a, z, b, z + place])


def _place(number: int) -> int:
    """A number that no other batch of the stage has."""
    return TaskContext.get().partitionId() << 32 | number


def _tidied(t: pa.Table, at: np.ndarray) -> tuple[pa.Table, np.ndarray]:
    """Each group's rows by size, and one of those that are equal lines."""
    of = np.repeat(np.arange(len(at) - 1), np.diff(at))
    meta, ids = t.column("meta").to_numpy(), t.column("id").to_numpy()
    order = np.lexsort((ids, meta, of))
    of, ids = of[order], ids[order]
    new = np.ones(len(of), dtype=bool)
    new[1:] = (of[1:] != of[:-1]) | (ids[1:] != ids[:-1])
    return t.take(pa.array(order[new])), np.concatenate([[0], np.cumsum(np.bincount(of[new], minlength=len(at) - 1))])


def _edges(posted: DataFrame, threshold: float) -> DataFrame:
    """kind 1: an edge (id, x); 2: postings of words with more than HOT_ROWS; 0: what isn't a posting."""

    def tag(t: pa.RecordBatch | pa.Table, kind: int) -> pa.RecordBatch:
        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in t.columns]
        columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
        return pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(t), kind, np.int32))], names=[*COLUMNS, "kind"])

    def postings(batches: Iterator[pa.RecordBatch], out: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Only postings; of the word that a batch ends in, what exceeds HOT_ROWS goes to out, and so does the rest of it."""
        hot, token, held = None, None, 0
        for batch in batches:
            meta = batch.column("meta").to_numpy()
            if (meta < 0).any():
                out.append(tag(batch.filter(pa.array(meta < 0)), 0))
                batch = batch.filter(pa.array(meta >= 0))
            tokens = batch.column("token").to_numpy()
            if hot is not None:
                n = int(np.searchsorted(tokens, hot, "right"))
                out.append(tag(batch.slice(0, n), 2))
                batch, tokens = batch.slice(n), tokens[n:]
                hot = hot if not len(batch) else None
            if not len(batch):
                continue
            lo = int(np.searchsorted(tokens, tokens[-1], "left"))
            held = len(tokens) - lo + (held if token == tokens[-1] and lo == 0 else 0)
            token = tokens[-1]
            if held > HOT_ROWS:
                hot, held = token, 0
            yield batch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[pa.RecordBatch] = []
        for number, (t, at) in enumerate(grouped(postings(batches, out), 1)):
            size = np.diff(at)
            if (size > HOT_ROWS).any():
                for k in np.flatnonzero(size > HOT_ROWS):
                    out.append(tag(t.slice(int(at[k]), int(size[k])), 2))
                few = np.repeat(size <= HOT_ROWS, size)
                t, size = t.filter(pa.array(few)), size[size <= HOT_ROWS]
                at = np.concatenate([[0], np.cumsum(size)])
            if len(t):
                t, at = _tidied(t, at)
                out.append(tag(_met(t, at, None, threshold, _place(number)), 1))
            yield from out
            out.clear()
        yield from out

    cells = posted.repartition("token").sortWithinPartitions("token")
    return cells.mapInArrow(freeing(run), ", ".join(f"{c} long" for c in COLUMNS) + ", kind int")


def _hot_edges(ws: Workspace, hot: DataFrame, threshold: float) -> DataFrame:
    hot = ws.save(hot.dropDuplicates(["token", "id"]), "hot_postings")
    many = ws.save(hot.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks")), "hot_words")
    rows = hot.join(many, "token").select("token", "id", "meta", "x", "y", "blocks", F.col("id").alias("node"))
    cells = dealt(rows, ["token"], "blocks").sortWithinPartitions("token", "cell", "meta").select("token", "cell", "block", "id", "meta", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, (t, at) in enumerate(grouped(batches, 2)):
            block = t.column("block").to_numpy()
            same = np.minimum.reduceat(block, at[:-1]) == np.maximum.reduceat(block, at[:-1])
            # where a cell holds one block alone its rows meet each other, else only those of the other block
            own = np.where(np.repeat(same, np.diff(at)), np.arange(len(block)) + (1 << 32), block)
            yield _met(t, at, own, threshold, -1 - _place(number)).select(["id", "x", "y"])

    return cells.mapInArrow(freeing(run), "id long, x long, y long")


def _items(texts: DataFrame, rank) -> DataFrame:
    """node, lo, root, text, doc, line of the wanted lines (want: array of line, root and key) of each text; a line with another key than the wanted one is another text's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, want = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for b, s in _sets(batch.column(1), rank.value):
                node, lo, root, text, doc, line = [], [], [], [], [], []
                where = {(r, k): i for i, (r, k) in enumerate(zip(s.row.tolist(), s.number.tolist(), strict=True))}
                for r in range(b.hi - b.lo):
                    for w in want[b.lo + r]:
                        i = where.get((r, w["line"]))
                        if i is not None and s.lo[i] == w["lo"] and s.hi[i] == w["hi"]:
                            node.append(s.lo[i].tobytes() + s.hi[i].tobytes())
                            lo.append(w["lo"])
                            root.append(w["root"])
                            text.append(b.buf[s.start[i] : s.end[i]].tobytes())
                            doc.append(docs[b.lo + r])
                            line.append(w["line"])
                longs = {k: pa.array(v, pa.int64()) for k, v in (("lo", lo), ("root", root), ("doc", doc), ("line", line))}
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), longs["lo"], longs["root"], pa.array(text, pa.binary()), longs["doc"], longs["line"]], names=["node", "lo", "root", "text", "doc", "line"])

    return texts.select("doc_id", "text", "want").mapInArrow(freeing(run), "node binary, lo long, root long, text binary, doc long, line long")


def _refined(ws: Workspace, items: DataFrame, edges: DataFrame, threshold: float) -> DataFrame:
    """items with roots of components that are at most LARGE_ROWS lines, or else hold together by links that are verified.

    A link's lines met in some task, so that what was connected there holds both.
    """
    large = ws.save(items.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LARGE_ROWS).select("root"), "large")
    if large.isEmpty():
        return items
    inside = ws.save(items.join(large, "root"), "inside_large")
    local = edges.select(F.col("a").alias("lo"), "b", "place").union(edges.select(F.col("b").alias("lo"), "b", "place"))
    local = local.distinct().select("lo", F.xxhash64("place", "b").alias("root"))
    _, links = verify(ws, inside.drop("root").join(local, "lo").select("node", "root", "text", "doc", "line"), 1, threshold, "met_verified")
    roots = components(ws, links, "refined")
    refined = inside.drop("root").join(roots, "node").select(*items.drop("root").columns, F.xxhash64("root").alias("root"))
    return items.join(large, "root", "left_anti").unionByName(refined)


def matches(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_lines, n_removed, n_links, removed_lines.

    Lines end at line feeds and are numbered from 0. A line is removed if a line that stands earlier, by (doc_id,
    number), has a similarity of at least threshold; what was removed itself still counts as earlier. Lines
    without words stay. n_links sums over the row's lines how many different word sets each is linked to. Nulls
    are empty texts without lines; null ids come first; rows that repeat an id stand at the same place, so that none of
    them removes the other's line of the same number. Ids are integers. An empty table gives no rows.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "lines")
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text"))  # of the text, since a second reading may number rows differently
    rank = spark.sparkContext.broadcast(_ranks(bucket_counts(rows.select("text"))))  # 2 MB, whatever the corpus
    met = ws.save(_edges(_posted(rows, rank, threshold), threshold), "met")
    hot = ws.save(_hot_edges(ws, met.where("kind = 2"), threshold), "hot")
    for x in ("hot_postings", "hot_words"):
        ws.drop(x)
    edges = met.where("kind = 1").select("id", "x", "y").union(hot).toDF("a", "b", "place")
    inside = components(ws, edges.select("a", "b"), "groups")

    lines = met.where(f"kind = 0 and meta > {DOC}").select(F.col("token").alias("uid"), F.col("y").alias("doc_id"), (-1 - F.col("meta")).alias("line"), F.col("id").alias("lo"), F.col("x").alias("hi"))
    firsts = ws.save(lines.groupBy("lo", "hi").agg(F.min(F.struct("doc_id", "line", "uid")).alias("at"), F.count(F.lit(1)).alias("n")).select("lo", "hi", F.struct("at.doc_id", "at.line").alias("first"), "at.uid", "n"), "firsts")
    hashes = met.where(f"kind = 0 and meta = {DOC}").select(F.col("token").alias("uid"), F.col("id").alias("hash"))
    wanted = firsts.join(inside.withColumnRenamed("node", "lo"), "lo").groupBy("uid", "first.doc_id").agg(F.collect_list(F.struct("first.line", "root", "lo", "hi")).alias("want"))
    texts = rows.select("doc_id", "hash", "text").join(wanted.join(hashes, "uid").drop("uid"), ["doc_id", "hash"])
    items = ws.save(_items(texts, rank).dropDuplicates(["node"]), "items")
    counts, _ = verify(ws, _refined(ws, items, edges, threshold), 1, threshold, "verified")
    found = _halves(counts).select("lo", "hi", "n_links", F.struct(F.col("first.doc").alias("doc_id"), F.col("first.line").alias("line")).alias("other"))
    cut = join_on(firsts.drop("uid"), found, ["lo", "hi"], "left").where("n > 1 or n_links > 0")  # others stay
    cut = cut.select("lo", "hi", F.least("first", "other").alias("cut"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    judged = lines.join(ws.save(cut, "cut"), ["lo", "hi"])
    gone = F.struct("doc_id", "line") > F.col("cut")
    per = judged.select("uid", "n_links", F.when(gone, F.col("line")).alias("gone")).groupBy("uid").agg(F.sum("n_links").alias("n_links"), F.sort_array(F.collect_list("gone")).alias("removed_lines"))
    whole = met.where(f"kind = 0 and meta = {DOC}").select(F.col("token").alias("uid"), F.when(F.col("y") > -(1 << 63), F.col("y")).alias("doc_id"), F.col("x").alias("n_lines"))
    out = whole.join(per, "uid", "left")
    removed = F.coalesce("removed_lines", F.array().cast("array<long>"))
    return out.select("doc_id", "n_lines", F.size(removed).cast("long").alias("n_removed"), F.coalesce("n_links", F.lit(0)).alias("n_links"), removed.alias("removed_lines"))


def _halves(counts: DataFrame) -> DataFrame:
    """The key's bytes are lo and hi, little-endian."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = b"".join(batch.column(0).to_pylist())
            key = np.frombuffer(raw, "<i8").reshape(-1, KEY // 8)
            yield pa.RecordBatch.from_arrays([pa.array(key[:, 0].copy()), pa.array(key[:, 1].copy()), *batch.columns[1:]], names=["lo", "hi", *batch.schema.names[1:]])

    return counts.mapInArrow(freeing(run), "lo long, hi long, n_links long, first struct<doc: long, line: long>")


def strip(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without the removed lines of found = matches(docs). Ids must be unique; rows without id stay as they are."""
    gone = found.where("n_removed > 0").select(F.col("doc_id").alias("gone_id"), "removed_lines")
    rows = docs.select(F.struct("*").alias("row")).join(gone, F.col(f"row.{id_col}") == F.col("gone_id"), "left")
    names, at = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.columns[1:]
            texts = columns[at].to_pylist()
            for k, numbers in enumerate(batch.column(0).to_pylist()):
                if numbers:
                    left, drop = texts[k].split("\n"), set(numbers)
                    texts[k] = "\n".join(x for n, x in enumerate(left) if n not in drop)
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.select("removed_lines", *(F.col(f"row.`{c}`") for c in docs.columns)).mapInArrow(freeing(run), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"))
