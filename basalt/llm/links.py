"""Links between rows that are similar: spanning edges, connected components, and exact verification.

A similarity join over large groups must not make a row for every pair. Candidate generators therefore emit
spanning edges of the pairs that they can't rule out, a number linear in a group's rows; components of these hold every
possible link. verify() then compares all pairs of a component exactly, block against block, and emits a
count per row and, again, spanning edges only. It gets the texts themselves and numbers their words by bytes, so that no
hash decides whether words or shingles are the same. Nothing is collected to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, freeing
from .words import CHUNK, blocks, numbered, numbered_shingles, text_buffer

BLOCK_ROWS, BLOCK_BYTES, KEY = 1024, 4 << 20, 16


def fixed(column: pa.Array, width: int) -> np.ndarray:
    """A binary column whose values all have width bytes, as a matrix."""
    return text_buffer(column)[0].reshape(len(column), width)


def components(ws: Workspace, edges: DataFrame, name: str) -> DataFrame:
    """(node, root) of every node in edges (a, b); root is the component's smallest node.

    Large-star and small-star rounds until the edges are stars whose center is the smallest node. Smallest neighbours are aggregated
    before the shuffle and saved, so that both sides of a join have shuffles of their own and a hub's can be split.
    """

    def both(e: DataFrame) -> DataFrame:
        return e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def apart(e: DataFrame) -> bool:
        """Whether some node has two neighbours that are less, or one that is less and one that is more."""
        ends = e.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(e.select("b", F.lit(0), F.lit(1)))
        return not ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 or down + up > 1").isEmpty()

    now, k = ws.save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}0"), 0
    while apart(now):
        near = both(now)
        least = ws.save(near.groupBy("a").agg(F.min("b").alias("m")), f"{name}{k}large")
        least = least.select("a", F.least("a", "m").alias("m")).hint("merge")
        large = near.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = ws.save(large, f"{name}{k}stars")
        least = ws.save(large.groupBy("a").agg(F.min("b").alias("m")), f"{name}{k}small")
        small = large.join(least.hint("merge"), "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()
        k += 1
        now = ws.save(small, f"{name}{k}")
        for x in ("", "large", "stars", "small"):
            ws.drop(f"{name}{k - 1}{x}")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())


def spanning(n: int, block: np.ndarray, crossing: bool, alike: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """A label for each row, equal where pairs that are alike connect rows. alike(i, js) gives those of the js; pairs that are connected by others aren't asked."""
    label = np.arange(n)
    for i in range(n - 1):
        js = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        if crossing:
            js = js[block[js] != block[i]]
        if not len(js):
            continue
        for j in alike(i, js).tolist():
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
    return label


def stars_of(nodes: list[bytes], label: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """An edge from every node to the smallest one with its label."""
    least: dict[int, bytes] = {}
    labels = label.tolist()
    for node, k in zip(nodes, labels, strict=True):
        if k not in least or node < least[k]:
            least[k] = node
    pairs = [(node, least[k]) for node, k in zip(nodes, labels, strict=True) if node != least[k]]
    return [x for x, _ in pairs], [x for _, x in pairs]


def across(cell: int) -> bool:
    """Whether the cell is one of two blocks; that one of them may be empty doesn't show in its rows."""
    return cell >> 31 != cell & 0x7FFFFFFF


def dealt(members: DataFrame, keys: list[str], blocks: str) -> DataFrame:
    """Members in cells of two blocks of their group, so that any two meet in exactly one cell where their blocks differ or are the same.

    blocks: the column that says into how many a group is cut. Adds block and cell; a member goes to as many cells as there are blocks.
    """
    own = F.pmod(F.xxhash64(F.lit("block"), "node"), F.col(blocks))
    out = members.withColumn("block", own.cast("int")).select("*", F.explode(F.sequence(F.lit(0), (F.col(blocks) - 1).cast("int"))).alias("other"))
    cell = F.least("block", "other").cast("long") * (1 << 31) + F.greatest("block", "other")
    return out.withColumn("cell", cell).drop("other", blocks).repartition(*keys, "cell").sortWithinPartitions(*keys, "cell", "node")


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups (equal in the first columns, which rows are sorted by), and where each begins, with the end."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        t = pa.Table.from_batches([*held, batch]).combine_chunks()
        change = np.zeros(len(t) - 1, dtype=bool)
        for c in range(keys):
            column = t.column(c).combine_chunks()
            column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
            change |= ~np.asarray(pa.compute.equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False), dtype=bool)
        at = np.flatnonzero(change) + 1
        if len(at):
            last = int(at[-1])
            yield t.slice(0, last), np.concatenate([[0], at])
            held = t.slice(last).to_batches()
        else:
            held = t.to_batches()
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, np.array([0, len(t)])


def overlaps(codes: np.ndarray, begin: np.ndarray, block: np.ndarray | None, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """(i, js): for each set i later ones whose Jaccard similarity with it is at least threshold, each pair once.

    Set i has codes begin[i] to begin[i + 1], distinct small numbers. With block only pairs of different blocks (there are two) count.
    """
    size = np.diff(begin)
    order = np.lexsort((size, np.zeros(len(size), bool) if block is None else block))
    size = size[order]
    flat = codes[np.concatenate([np.arange(begin[k], begin[k + 1]) for k in order])] if len(order) else codes[:0]
    at = np.concatenate([[0], np.cumsum(size)])
    split = 0 if block is None else int(np.count_nonzero(block == block.min()))
    has = np.zeros(int(flat.max()) + 1 if len(flat) else 0, dtype=np.int32)
    limit = size / threshold + 1e-9
    for i in range(split if block is not None else len(size) - 1):
        # sizes ascend from lo on, so that similar ones stand together
        lo, hi = (i + 1, len(size)) if block is None else (split, len(size))
        hi = lo + int(np.searchsorted(size[lo:hi], limit[i], "right"))
        if block is not None:
            lo += int(np.searchsorted(size[lo:hi], size[i] * threshold - 1e-9, "left"))
        if lo >= hi or not size[i]:
            continue
        mine = flat[at[i] : at[i + 1]]
        has[mine] = 1
        met = np.concatenate([[0], np.cumsum(has[flat[at[lo] : at[hi]]])])
        has[mine] = 0
        common = np.diff(met[at[lo : hi + 1] - at[lo]])
        js = np.flatnonzero(common >= threshold * (size[i] + size[lo:hi] - common) - 1e-9) + lo
        if len(js):
            yield int(order[i]), order[js]


def _portions(at: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Groups from and to, of about CHUNK bytes or one group."""
    ends, lo = offsets[at], 0
    while lo < len(at) - 1:
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + CHUNK, "right")) - 1)
        yield lo, hi
        lo = hi


def verify(ws: Workspace, members: DataFrame, words: int, threshold: float, name: str) -> tuple[DataFrame, DataFrame]:
    """Exact links among members (node, root, text, doc and line: where the node first stands), on sets of runs of so many words.

    Returns (node, n_links, first: the earliest doc and line of a linked node) for the nodes with links, and
    edges (a, b) that span them, stars in each cell. A large component is cut into blocks of at most about BLOCK_ROWS rows
    and BLOCK_BYTES bytes, or one longer text; a task holds two of them.
    """
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    parts = F.ceil(F.greatest(F.col("n") / BLOCK_ROWS, F.col("bytes") / BLOCK_BYTES))
    sizes = ws.save(sizes.select("root", F.greatest(parts, F.lit(1)).cast("int").alias("blocks")), f"{name}sizes")  # see components
    cut = members.join(sizes, "root")
    cells = dealt(cut.select("root", "node", "text", "doc", "line", "blocks"), ["root"], "blocks").select("root", "cell", "block", "node", "text", "doc", "line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in grouped(batches, 2):
            node, cell, block = fixed(t.column(3), KEY), t.column(1).to_numpy(), t.column(2).to_numpy()
            doc, line = t.column(5).to_numpy(), t.column(6).to_numpy()
            rank = np.empty(len(t), dtype=np.int64)
            order = np.lexsort((line, doc))
            rank[order] = np.arange(len(t))
            heads, tails, links, first = [], [], np.zeros(len(t), dtype=np.int64), np.full(len(t), len(t))
            for g, h in _portions(at, text_buffer(t.column(4))[1]):
                base = int(at[g])
                b = next(blocks(t.column(4).slice(base, int(at[h]) - base), chunk=1 << 62))
                codes, begin = numbered_shingles(numbered(b.low, b.starts, b.ends, b.hashes)[0], b.at, words)
                for lo, hi in zip(at[g:h].tolist(), at[g + 1 : h + 1].tolist(), strict=True):
                    crossing = across(int(cell[lo]))
                    own = block[lo:hi] if crossing else None
                    if hi - lo < 2 or crossing and own.min() == own.max():
                        continue
                    label = np.arange(hi - lo)
                    met = False
                    for i, js in overlaps(codes, begin[lo - base : hi - base + 1], own, threshold):
                        links[lo + i] += len(js)
                        links[lo + js] += 1
                        first[lo + i] = min(first[lo + i], rank[lo + js].min())
                        first[lo + js] = np.minimum(first[lo + js], rank[lo + i])
                        met = True
                        for j in js[label[js] != label[i]].tolist():
                            if label[j] != label[i]:
                                label[label == label[j]] = label[i]
                    if met:
                        a, b = stars_of([node[k].tobytes() for k in range(lo, hi)], label)
                        heads += a
                        tails += b
            some = np.flatnonzero(links)
            a = pa.array([*(node[k].tobytes() for k in some), *heads], pa.binary())
            b = pa.array([None] * len(some) + tails, pa.binary())
            pad = np.zeros(len(heads), np.int64)
            where = order[first[some]]
            yield pa.RecordBatch.from_arrays([a, b, *(pa.array(np.concatenate([x, pad])) for x in (links[some], doc[where], line[where]))], names=["a", "b", "links", "doc", "line"])

    found = ws.save(cells.mapInArrow(freeing(run), "a binary, b binary, links long, doc long, line long"), name)
    ws.drop(f"{name}sizes")
    counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("n_links"), F.min(F.struct("doc", "line")).alias("first"))
    return counts, found.where("b is not null").select("a", "b")
