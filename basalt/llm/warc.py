"""WARC archives: written, read back, and assembled into one nested row per capture.

A capture is a transaction: a response (or a revisit of an equal payload), the request and the metadata
record that name it in WARC-Concurrent-To. Records are strings that Spark's own text writer puts out,
gzipped, with its commit protocol; they are read with Spark's text reader, one task per archive, and cut by their
Content-Length as they stream by, so memory holds a batch and a record but never an archive.

Skew: payloads move once, in the join that tells a page whether its payload was seen before; the
smallest page_id of a repeated payload is aggregated before its shuffle and saved, so that both sides of the join
have shuffles of their own, and no operator above it needs a key's rows together: adaptive execution splits hot payloads.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, freeing, join_on, ship, table

#: fixed values of the WARC and base32 formats
VERSION = "WARC/1.1"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BREAK = "\nWARC/1."  #: where the reader cuts; pieces are put together again
SHA256 = "X-Payload-SHA256"  #: own header of a revisit: the payload that it repeats
DATE, MIN_BYTES = "2024-01-01T00:00:00Z", 0


def base32_of_hex(digest: Column, digits: int = 40) -> Column:
    """Base32 of a hexadecimal digest, five digits (four characters) at a time."""
    out = []
    for at in range(1, digits + 1, 5):
        n = F.conv(F.substring(digest, at, 5), 16, 10).cast("int")
        out += [F.substr(F.lit(BASE32), F.shiftright(n, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    """A record but for the two empty lines after it. A header whose value is null is left out."""
    lines = [F.coalesce(F.concat(F.lit(f"{k}: "), v, F.lit("\r\n")), F.lit("")) for k, v in headers]
    length = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(F.lit(f"{VERSION}\r\n"), *lines, length, block)


def write(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES, date: str = DATE, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Three records per row: request, response or revisit, metadata.

    Payloads are equal when size and SHA-256 are; the SHA-1 that the records carry decides nothing. Of rows with equal payloads of at least min_bytes bytes, that with the smallest page_id is a response and
    others are revisits; rows that repeat that id are responses as well, and a group whose ids are all null has
    responses only. A null html is an empty payload, a null url leaves its header out; blanks and control characters in
    a url are percent-encoded. An empty table writes no record.
    """
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    # one urn per row; of the three records each appends its own suffix
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"sha1": F.sha1(F.col("payload").cast("binary")), "sha256": F.sha2(F.col("payload").cast("binary"), 256), "bytes": F.octet_length("payload")})
    ws = Workspace(pages.sparkSession, "payloads")
    first = rows.where(F.col("bytes") >= min_bytes).groupBy("sha256", "bytes").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    first = ws.save(first.where("n > 1"), "repeated")
    rows = rows.join(first, ["sha256", "bytes"], "left").withColumn("urn", F.expr("uuid()"))
    again = F.col("n").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    url = F.col("url")
    for plain in [" ", "\r", "\n", "\t", "\0"]:
        url = F.replace(url, F.lit(plain), F.lit(f"%{ord(plain):02X}"))
    rows = rows.select("page_id", url.alias("url"), "payload", base32_of_hex(F.col("sha1")).alias("sha1"), "sha256", again.alias("again"), "urn")

    def urn(kind: str) -> Column:
        return F.concat(F.lit("<urn:uuid:"), F.col("urn"), F.lit(f":{kind}>" if kind else ">"))

    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit("\r\n\r\n"))
    common = [("WARC-Target-URI", F.col("url")), ("WARC-Date", F.lit(date))]
    after = F.when(F.instr("url", "://") > 0, F.substring_index("url", "://", -1)).otherwise(F.lit(""))
    main = [
        ("WARC-Type", F.when(F.col("again"), "revisit").otherwise("response")), ("WARC-Record-ID", urn("")), *common,
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))), ("WARC-Profile", F.when(F.col("again"), REVISIT)), (SHA256, F.when(F.col("again"), F.col("sha256"))), ("Content-Type", F.lit("application/http; msgtype=response")),
    ]
    request = [("WARC-Type", F.lit("request")), ("WARC-Record-ID", urn("request")), *common, ("WARC-Concurrent-To", urn("")), ("Content-Type", F.lit("application/http; msgtype=request"))]
    metadata = [("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", urn("metadata")), *common, ("WARC-Concurrent-To", urn("")), ("Content-Type", F.lit("application/warc-fields"))]
    host = F.regexp_extract(F.coalesce(after, F.lit("")), r"^[^/?#]*", 0)
    records = F.array(
        _record(request, F.concat(F.lit("GET "), F.coalesce("url", F.lit("/")), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n"))),
        _record(main, F.when(F.col("again"), http).otherwise(F.concat(http, F.col("payload")))),
        _record(metadata, F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\n"))),
    )
    records = rows.select(F.explode(records).alias("value"))
    records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)
    ws.drop("repeated")


_HEADER = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r?\n")


class Parser:
    """Records from a stream of bytes. What isn't a whole record (a cut archive) is passed over up to the next version line."""

    def __init__(self) -> None:
        self.data, self.at = bytearray(), 0

    def feed(self, piece: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
        self.data += piece
        while True:
            start = self.data.find(b"WARC/1.", self.at)
            if start < 0:
                break
            end = self.data.find(b"\r\n\r\n", start)
            if end < 0:
                break
            head = bytes(self.data[start : end + 2])
            fields = {k.strip().lower().decode("latin-1"): v.strip().decode("utf-8", "replace") for k, v in _HEADER.findall(head.partition(b"\n")[2])}
            length = fields.get("content-length", "")
            if not length.isdigit():
                self.at = end
                continue
            last = end + 4 + int(length)
            if last > len(self.data):
                break
            self.at = last
            yield fields, bytes(self.data[end + 4 : last])
        if self.at > 1 << 20:
            del self.data[: self.at]
            self.at = 0


RECORDS = "archive long, type string, record_id string, concurrent_to string, target_uri string, date string, profile string, digest string, same_as string, content_type string, page_id string, payload_bytes long, payload_digest string, payload_sha256 string, payload binary"


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record. payload is the body of an HTTP block, or else the block (null unless payloads).

    page_id is what follows `page-id:` in a metadata record, up to the first blank, so that ids with blanks don't survive. Empty archives
    give no rows, and neither does a record that is cut off.
    """
    ship(spark)
    lines = spark.read.option("lineSep", BREAK).text(path).select(F.col("value").cast("binary"), F.xxhash64(F.col("_metadata.file_path")).alias("archive"))
    cut = BREAK.encode()

    def row(archive: int, f: dict[str, str], block: bytes) -> tuple:
        body = block.partition(b"\r\n\r\n")[2] if f.get("content-type", "").startswith("application/http") else block
        page = re.search(rb"(?m)^page-id: *(\S+)", block) if f.get("warc-type") == "metadata" else None
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        return (archive, f.get("warc-type"), f.get("warc-record-id"), f.get("warc-concurrent-to"), f.get("warc-target-uri"), f.get("warc-date"), f.get("warc-profile"), f.get("warc-payload-digest", "").removeprefix("sha1:") or None, f.get(SHA256.lower()), f.get("content-type"), page and page[1].decode("utf-8", "replace"), len(body), digest, hashlib.sha256(body).hexdigest(), body if payloads else None)

    names = [x.split()[0] for x in RECORDS.split(", ")]
    types = [{"long": pa.int64(), "binary": pa.binary()}.get(x.split()[1], pa.string()) for x in RECORDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, parser, held = None, Parser(), 0
        out: list[tuple] = []
        for batch in batches:
            for value, of in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                piece = value.as_buffer().to_pybytes()
                if of != archive:
                    archive, parser = of, Parser()
                else:
                    piece = cut + piece
                for fields, block in parser.feed(piece):
                    out.append(row(archive, fields, block))
                    held += len(block)
                if len(out) >= 2000 or held > 1 << 24:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                    out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return lines.mapInArrow(freeing(run), RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, response, request, metadata (structs; null if absent), n_requests, n_metadata.

    Records meet by the id that they have or name in WARC-Concurrent-To. Of several of a kind the one
    with the smallest record id stands in the row, and the counts tell of the others. Requests and metadata whose
    response is missing make a row with a null response. Aggregation is partial before the shuffle.
    """
    fields = ["record_id", "type", "target_uri", "date", "profile", "digest", "same_as", "content_type", "page_id", "payload_bytes", "payload_digest", "payload_sha256", "payload"]
    one = F.struct(*fields)
    main = F.col("type").isin("response", "revisit", "resource")

    def least(when: Column) -> Column:
        return F.min_by(F.when(when, one), F.when(when, F.col("record_id")))

    return records.groupBy(F.coalesce(F.when(~main, F.col("concurrent_to")), F.col("record_id")).alias("capture_id")).agg(
        least(main).alias("response"), least(F.col("type") == "request").alias("request"), least(F.col("type") == "metadata").alias("metadata"),
        F.count(F.when(F.col("type") == "request", 1)).alias("n_requests"), F.count(F.when(F.col("type") == "metadata", 1)).alias("n_metadata"),
    )


def resolve(captures: DataFrame, ws: Workspace) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: revisits get the payload of the response that they repeat.

    Which one that is tells the SHA-256 of payloads, or for a revisit without one their SHA-1. A revisit whose response is missing keeps
    the digest that it states, with null bytes; a capture without a response has nulls but for its page_id.
    """
    flat = captures.select(
        F.col("metadata.page_id").cast("long").alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.digest").alias("digest"),
        F.col("response.payload_digest").alias("actual"), F.col("response.payload_sha256").alias("sha256"), F.col("response.same_as").alias("same_as"), F.col("response.type").alias("record_type"),
    )
    flat = ws.save(flat, "captures")
    keys = flat.where("record_type = 'response'").select(F.explode(F.array("sha256", "actual")).alias("key"), "page_id", "payload_bytes")
    first = keys.groupBy("key").agg(F.min("page_id").alias("refers_to"), F.max("payload_bytes").alias("full"))
    again = flat.where("record_type = 'revisit'").withColumn("key", F.coalesce("same_as", "digest"))
    again = join_on(again, first, ["key"], "left")
    rest = flat.where("record_type is distinct from 'revisit'")
    rest = rest.select("page_id", "payload_bytes", F.col("actual").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    return rest.unionByName(again.select("page_id", F.col("full").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "warc")
    write(table(spark, sf_dir, "pages"), f"{ws.path}/archives")
    rows = resolve(assemble(read(spark, f"{ws.path}/archives", payloads=False)), ws)  # saved, but for the join of revisits
    ws.drop("archives")
    return rows


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h, MIN(page_id) OVER (PARTITION BY coalesce(html, '')) AS f FROM pages)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + CAST((CAST('0x' || substr(h, 1 + 5 * (i // 4), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = f THEN NULL ELSE f END AS refers_to
FROM p
"""
