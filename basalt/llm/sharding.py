"""Shards by proportional stratified interleaving, in DataFrame operations alone.

Rows are shuffled within their source by a seeded hash and ranked; row k of a source with n rows has the
fraction (k - 1/2) / n. In the order of fractions every stretch holds the sources in their overall
proportions, so cutting it into equal counts gives shards that all match the mixture.

Skew: no window ever runs over a source's rows. Ranks come from two range sorts: a partition's rows are
numbered in place and only counts per (source, partition), a few rows, are summed up with a window. Sort keys
contain the hash and, behind all else, a row's old place, so that a source with a third of all rows, or one row that
is a third of them, spreads over many partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, numbered_rows, place, ranked, table

SHARDS, SEED = 24, 17


def interleave(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", hash_col: str | None = None) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard, source.

    Rows are shuffled by a hash of doc_id (or of hash_col, if given).
    law is 'rows': shard sizes differ by one at most. A null text has size 8 and the checksum of no bytes; null
    sources are one source, ordered last; a null doc_id hashes as an empty string. Equal rows are
    interchangeable. Equal texts are not kept together, by decision: a group that holds a third of all rows could not lie in
    one shard under this law, and to keep smaller ones whole would move rows away from their fraction, so that shards no
    longer match the mixture. An empty table gives no rows; other columns are not read.
    """
    ws = Workspace(docs.sparkSession, "shards")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    mix = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(hash_col or id_col).cast("string"), F.lit(""))).cast("binary"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), (F.length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), mix.alias("mix"))
    rows = ws.save(rows, "rows").withColumn("place", place())
    rows = numbered_rows(ws, rows, [F.asc_nulls_last("source"), "mix", "size", "text_crc32", "doc_id", "place"], "by_source")
    rows = ranked(rows, "source")
    fraction = (F.col("rank") * 2 + 1).cast("double") / (F.col("of") * 2).cast("double")
    rows = rows.select("doc_id", "source", "size", "text_crc32", fraction.alias("fraction"))
    rows = numbered_rows(ws, rows, ["fraction", F.asc_nulls_last("source")], "by_fraction")
    ws.drop("rows")
    ws.drop("by_source")

    # one row per range: their number is bounded by spark.sql.shuffle.partitions
    parts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(whole).alias("total"))
    rows = rows.join(parts, "part").withColumn("pos", F.col("before") + F.col("idx"))
    rows = rows.withColumn("shard", F.expr(f"pos * {shards} div total"))
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.expr(f"pos - (shard * total + {shards - 1}) div {shards}").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "source",
    )


#: what placed() adds to the columns of docs
PLACED = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def placed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of docs, each with PLACED from interleave(): what a writer of shards needs.

    Rows are told apart by their place, so that repeated ones and null ids have slots of their own. Columns of docs that have a name of
    PLACED come out as docs_<name>. Texts move once, to meet their slots. An empty table stays empty.
    """
    ws = Workspace(docs.sparkSession, "placed")
    held = ws.save(docs.select(F.struct("*").alias("row")).withColumn("uid", place()), "rows")
    flat = held.select("uid", F.col(f"row.{id_col}").alias("id"), F.col(f"row.{text_col}").alias("text"), F.col(f"row.{source_col}").alias("source"))
    slots = interleave(flat, id_col="uid", hash_col="id", text_col="text", source_col="source", **options).select(F.col("doc_id").alias("uid"), *PLACED)
    own = [F.col(f"row.`{c}`").alias(f"docs_{c}" if c in PLACED else c) for c in docs.columns]
    return held.join(slots, "uid").select(*own, *PLACED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleave(table(spark, sf_dir, "documents"))
