"""Token ids in binary files whose document boundaries are Elias-Fano encoded.

A file holds one segment (all numbers little-endian):

    8 bytes  magic 'BSLTEF01'
    8 x u64  partition, segment in the partition, documents n, ids m, bytes per id (2 or 4), low bits l,
             bytes of the null map, bytes of the upper bits
    n x i64  doc_id (0 where null); then the null map, one bit per document
    low      n + 1 values of l bits: the lower bits of the boundaries 0 = b_0 <= ... <= b_n = m
    upper    bit (b_i >> l) + i is set for every i
    samples  u32 for every 256th set bit: its position
    ids      m ids of 2 or 4 bytes
    1 byte   newline

Boundaries cost about 2 + log2(m / n) bits each; select(i) starts at a sample and counts bits in a bounded stretch, and
no table of 64-bit offsets exists in the file. Files are written by Spark's own writer, so its commit
protocol holds when executors or attempts are lost, and any file system that Spark reaches will do.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, freeing, table
from .words import CHUNK, LOWER, cuts, numbered, runs, span_hashes, text_buffer

MAGIC, HEAD, SAMPLE = b"BSLTEF01", struct.Struct("<8Q"), 256
SEGMENT_IDS, MEMO, END_ID = 2_000_000, 500_000, 1


class EliasFano:
    """A non-decreasing sequence of integers from 0 on."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, upper: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.upper, self.samples = n, low_bits, low, upper, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        bits = ((values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        at = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        upper = np.zeros((top >> low_bits) + n + 1, dtype=np.uint8)
        upper[at] = 1
        return cls(n, low_bits, np.packbits(bits.ravel(), bitorder="little"), np.packbits(upper, bitorder="little"), at[::SAMPLE].astype(np.uint32))

    def select(self, i: int) -> int:
        """Value i, from one sample, a stretch of the upper bits, and its lower bits."""
        byte, rank, width = int(self.samples[i // SAMPLE]) // 8, i // SAMPLE * SAMPLE, 64
        skip = int(np.unpackbits(self.upper[byte : byte + 1], bitorder="little")[: int(self.samples[i // SAMPLE]) % 8].sum())
        want = i - rank + skip
        while True:
            ones = np.flatnonzero(np.unpackbits(self.upper[byte : byte + width], bitorder="little"))
            if len(ones) > want:
                break
            width *= 2
        high = byte * 8 + int(ones[want]) - i
        first = i * self.low_bits
        bits = np.unpackbits(self.low[first // 8 : (first + self.low_bits + 7) // 8], bitorder="little")[first % 8 :][: self.low_bits]
        return (high << self.low_bits) | sum(int(b) << k for k, b in enumerate(bits))

    def values(self) -> np.ndarray:
        """All values: select, a sample's stretch of upper bits at a time."""
        out = np.empty(self.n, dtype=np.int64)
        for k in range(0, self.n, SAMPLE):
            n, start = min(SAMPLE, self.n - k), int(self.samples[k // SAMPLE])
            stop = int(self.samples[k // SAMPLE + 1]) if k + SAMPLE < self.n else len(self.upper) * 8
            ones = np.flatnonzero(np.unpackbits(self.upper[start // 8 : (stop + 7) // 8], bitorder="little")[start % 8 :])[:n]
            out[k : k + n] = start + ones - np.arange(k, k + n)
        if not self.low_bits:
            return out
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits).astype(np.int64)
        return (out << self.low_bits) | (bits << np.arange(self.low_bits)).sum(axis=1)


def pack(partition: int, number: int, doc_ids: list[int | None], bounds: np.ndarray, ids: np.ndarray) -> bytes:
    """A segment's file, without the newline that the writer adds."""
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    nulls = np.packbits(np.array([d is None for d in doc_ids], dtype=np.uint8), bitorder="little")
    ef = EliasFano.encode(bounds)
    head = HEAD.pack(partition, number, len(doc_ids), len(ids), width, ef.low_bits, len(nulls), len(ef.upper))
    docs = np.array([d or 0 for d in doc_ids], dtype="<i8")
    return b"".join([MAGIC, head, docs.tobytes(), nulls.tobytes(), ef.low.tobytes(), ef.upper.tobytes(), ef.samples.astype("<u4").tobytes(), ids.astype(f"<u{width}").tobytes()])


class Segment:
    """A file that is read back. Its document i has the ids from bounds.select(i) up to bounds.select(i + 1)."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a segment of token ids")
        self.partition, self.number, self.n, self.m, self.width, low_bits, nulls, upper = HEAD.unpack_from(data, 8)
        at = 8 + HEAD.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        self.doc_ids = take("<i8", self.n)
        self.null = np.unpackbits(take("u1", nulls), bitorder="little")[: self.n].astype(bool)
        low = take("u1", ((self.n + 1) * low_bits + 7) // 8)
        self.bounds = EliasFano(self.n + 1, low_bits, low, take("u1", upper), np.zeros(0, np.uint32))
        self.bounds.samples = take("<u4", (self.n + 1 + SAMPLE - 1) // SAMPLE)
        self.ids = take(f"<u{self.width}", self.m)

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.bounds.select(i) : self.bounds.select(i + 1)]


#: fixed value: the pre-tokenizer's pattern for which text can be cut by its bytes
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_BLANK, _LETTER, _DIGIT, _OTHER, _WHOLE = range(5)
_KIND = np.full(256, _OTHER, dtype=np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = _BLANK
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _LETTER
#: bytes that need a look at all that stands between two blanks: beyond ASCII, control, apostrophe, special tokens' '<'.
#: The letters from U+00C0 to U+00FF are spared: nothing composes with them unless such a byte follows.
_HARD = np.zeros(256, dtype=bool)
_HARD[128:] = _HARD[:9] = _HARD[14:32] = _HARD[127] = _HARD[39] = _HARD[60] = True


class Encoder:
    """Ids of many texts at once, the same as the library's own for each.

    With PATTERN, white space that is dropped, and lower case, pieces are encoded independently of each other: runs of letters,
    digits, runs of other ASCII characters, and, where hard bytes occur, all that stands between blanks. Blocks of
    text are cut into these with numpy, each distinct piece of a block (by its bytes, not its hash) is looked up in a bounded
    memo and what is new is encoded by the library. Any other tokenizer encodes whole texts.
    """

    def __init__(self, tokenizer_json: str, memo: int = MEMO):
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_str(tokenizer_json), memo
        self.memo: dict[bytes, bytes] = {}
        spec = json.loads(tokenizer_json)
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        lower = any(n.get("type") == "Lowercase" for n in (spec.get("normalizer") or {}).get("normalizers", []))
        first = steps[0]
        suffix = spec["model"].get("end_of_word_suffix")
        self.cuts = lower and bool(suffix) and first.get("pattern") == {"Regex": PATTERN} and first.get("behavior") == "Removed" and first.get("invert") is True
        if self.cuts:
            vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
            self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
            self.last[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True

    def learn(self, pieces: list[bytes], whole: np.ndarray) -> list[bytes]:
        """Ids of pieces, as bytes. Those that aren't whole are one word each and go together: a piece ends where a token ends a word."""
        texts = [p.decode("utf-8", "replace") for p in pieces]
        easy = [texts[k] for k in np.flatnonzero(~whole)]
        joined = self.tokenizer.encode_batch_fast([" ".join(easy[k : k + 500]) for k in range(0, len(easy), 500)], add_special_tokens=False)
        ids = np.concatenate([np.array(x.ids, np.uint32) for x in joined]) if joined else np.zeros(0, np.uint32)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(easy):
            raise ValueError("the tokenizer does not mark where words end")
        raw, begin = ids.tobytes(), [0, *(4 * ends).tolist()]
        out: list[bytes] = [b""] * len(pieces)
        for k, a, b in zip(np.flatnonzero(~whole).tolist(), begin[:-1], begin[1:], strict=True):
            out[k] = raw[a:b]
        hard = np.flatnonzero(whole).tolist()
        for k, x in zip(hard, self.tokenizer.encode_batch_fast([texts[k] for k in hard], add_special_tokens=False), strict=True):
            out[k] = np.array(x.ids, np.uint32).tobytes()
        if len(self.memo) + len(pieces) <= self.limit:
            self.memo.update(zip(pieces, out, strict=True))
        return out

    def encode(self, column: pa.Array, chunk: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids of some rows after each other, where each row's end) until the column's end."""
        buf, offsets = text_buffer(column)
        lo, n = 0, len(offsets) - 1
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + chunk, "right")) - 1)
            part, off = buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            if self.cuts and len(part) > chunk:  # a longer text goes in parts that end behind blanks
                ids = np.concatenate([self._block(part[a:b], np.array([0, b - a]))[0] for a, b in cuts(part, _KIND == _BLANK, chunk)])
                yield lo, ids, np.array([len(ids)])
            elif self.cuts:
                yield lo, *self._block(part, off)
            else:
                texts = [part[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                got = [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
                yield lo, np.concatenate(got), np.cumsum([len(x) for x in got])
            lo = hi

    def _block(self, part: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kind, mark = _KIND[part], _HARD[part]
        lead = np.flatnonzero((part[:-1] == 0xC3) & (part[1:] != 0x97) & (part[1:] != 0xB7))
        for k in (lead, lead + 1):
            kind[k], mark[k] = _LETTER, False
        inside = kind != _BLANK
        starts, ends = runs(inside, off)
        hard = np.concatenate([[0], np.cumsum(mark)])
        whole = hard[ends] > hard[starts]
        kind[inside] = np.where(np.repeat(whole, ends - starts), _WHOLE, kind[inside])
        new = inside.copy()
        new[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        new[starts] = True
        begin = np.flatnonzero(new)
        if not len(begin):
            return np.zeros(0, np.uint32), np.zeros(len(off) - 1, np.int64)
        end = np.append(begin[1:], len(part))
        stop = ends[np.searchsorted(starts, begin, "right") - 1]
        end = np.minimum(end, stop)
        low = LOWER[part]
        special = np.concatenate([[0], np.cumsum(part == 60)])
        for k in np.flatnonzero(special[end] > special[begin]):  # special tokens are case-sensitive
            low[begin[k] : end[k]] = part[begin[k] : end[k]]
        which, first = numbered(low, begin, end, span_hashes(low, begin, end))
        raw = low.tobytes()
        pieces = [raw[a:b] for a, b in zip(begin[first].tolist(), end[first].tolist(), strict=True)]
        got = list(map(self.memo.get, pieces))
        missing = [k for k, x in enumerate(got) if x is None]
        if missing:
            for k, x in zip(missing, self.learn([pieces[k] for k in missing], kind[begin[first[missing]]] == _WHOLE), strict=True):
                got[k] = x
        size = np.fromiter(map(len, got), np.int64, len(got)) // 4
        flat = np.frombuffer(b"".join(got), np.uint32)
        at = np.cumsum(size) - size
        each = size[which]
        upto = np.cumsum(each)
        ids = flat[np.arange(upto[-1]) + np.repeat(at[which] - (upto - each), each)]
        return ids, np.concatenate([[0], upto])[np.searchsorted(begin, off[1:])]


_encoders: dict[int, Encoder] = {}


def _encoder(tokenizer_json: str) -> Encoder:
    """One per worker process, so that later tasks find its memo."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for every core
    key = zlib.crc32(tokenizer_json.encode())
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(tokenizer_json)
    return _encoders[key]


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, segment_ids: int = SEGMENT_IDS, block_bytes: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode whole texts and write them in ascending doc_id order (nulls first; equal ids by text), a segment per file.

    The order is a range sort, so no task holds more than a range; a segment has about segment_ids ids, or ends with the
    block of about block_bytes of text, or the one longer document, in which it reaches them. Ids of documents are integers (another
    type that does not cast to long is an error); null and repeated ones are documents of their own. A null or empty text has its
    end id alone. Other columns are not read. An empty table writes no segment.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(open(tokenizer, encoding="utf-8").read())  # a vocabulary file: a few MB, whatever the corpus
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.repartitionByRange(F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, number, docs_, ids, sizes = _encoder(model.value), 0, [], [], []

        def segment() -> pa.RecordBatch:
            bounds = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
            data = pack(TaskContext.get().partitionId(), number, docs_, bounds, np.concatenate(ids))
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["data"])

        for batch in batches:
            for lo, got, ends in encoder.encode(batch.column(1), block_bytes):
                docs_ += batch.column(0).slice(lo, len(ends)).to_pylist()
                ids.append(np.insert(got, ends, end_id))
                sizes.append(np.diff(ends, prepend=0) + 1)
                if sum(map(len, ids)) >= segment_ids:
                    yield segment()
                    number, docs_, ids, sizes = number + 1, [], [], []
        if docs_:
            yield segment()

    rows.mapInArrow(freeing(run), "data binary").select(F.col("data").cast("string")).write.option("maxRecordsPerFile", 1).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of little-endian u32)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                raw = data.as_buffer()
                if not raw.size:
                    continue
                s = Segment(raw)
                bounds = s.bounds.values()
                crc = [zlib.crc32(s.ids[a:b].astype("<u4").tobytes()) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                part, number = np.full(s.n, s.partition, np.int64), np.full(s.n, s.number, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(s.doc_ids, mask=s.null), pa.array(part), pa.array(number), pa.array(bounds[:-1]), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())], names=["doc_id", "part", "number", "local", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").load(path).where("length > 0").select("content")
    return files.mapInArrow(freeing(run), "doc_id long, part long, number long, local long, n_tokens long, ids_crc32 long")


def offsets(rows: DataFrame) -> DataFrame:
    """start from the segments' own offsets: sums of segments within a partition, and of partitions (one row each)."""
    segments = rows.groupBy("part", "number").agg(F.sum("n_tokens").alias("ids"))
    parts = segments.groupBy("part").agg(F.sum("ids").alias("ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    before = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    segments = segments.select("part", "number", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("in_part"))
    rows = rows.join(segments, ["part", "number"]).join(parts, "part")
    return rows.select("doc_id", (F.col("base") + F.col("in_part") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ws = Workspace(spark, "tokens")
    write(table(spark, sf_dir, "documents"), f"{ws.path}/files", public_tokenizers.path("word_bpe_49k.json"))
    rows = ws.save(read(spark, f"{ws.path}/files"), "read")
    ws.drop("files")
    return offsets(rows)
