"""Exact duplicates by distributed most-significant-digit radix partitioning.

Round r splits every open group by the next digit of its texts' bytes. Digits grow (64 bytes, 4 KiB, 256 KiB,
then 1 MiB), so that a text of L bytes takes O(log L) rounds up to 256 KiB. A group is done when it has one
row or when its texts have ended; texts that differ in length are apart from the first round on. Bytes are
compared themselves: no digest decides anything.

Skew: a group's size and its largest id are aggregated before the shuffle (one row per group and task), and
the join that hands rows their group has no operator above it that needs a key's rows together, so adaptive
execution splits the partitions of hot groups. Open texts are written once per round; texts that are alone
leave in round one, where each text crosses the network once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, table


def radix_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first: int = 64, growth: int = 64, widest: int = 1 << 20) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their UTF-8 bytes are. keep_id is the largest doc_id of the group. Nulls count as
    empty texts. Rows that repeat the kept id (the same row twice) are all marked kept; a group whose ids are
    all null has keep_id null and keeps them. An empty table gives no rows. Other columns are not read.
    """
    ws = Workspace(docs.sparkSession, "radix")
    body = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("doc_id"), body.alias("rest"))
    rows = rows.select("doc_id", F.sha2("rest", 256).alias("text_sha256"), F.length("rest").alias("path"), F.length("rest").alias("left"), "rest")
    done, width, r = [], first, 0
    while True:
        digits = rows.select("doc_id", "text_sha256", "path", "left", F.substring("rest", 1, width).alias("digit"), F.expr(f"substring(rest, {width + 1})").alias("rest"))
        groups = digits.groupBy("path", "digit").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("top")).where("n > 1")
        groups = ws.save(groups.withColumn("group", F.monotonically_increasing_id()), f"groups{r}")
        found = digits.join(groups.hint("merge"), ["path", "digit"], "left")  # never a broadcast: the groups grow with the input
        is_open = F.col("n").isNotNull() & (F.col("left") > width)
        found = ws.save(found.select("doc_id", "text_sha256", "n", "top", F.col("group").alias("path"), (F.col("left") - width).alias("left"), F.when(is_open, F.col("rest")).alias("rest")), f"rows{r}")
        done.append(found.where("n is null or left <= 0"))
        rows = found.where("n is not null and left > 0").select("doc_id", "text_sha256", "path", "left", "rest")
        ws.drop(f"groups{r}")
        if rows.isEmpty():
            break
        width, r = min(width * growth, widest), r + 1
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("top"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), keep.eqNullSafe(F.col("doc_id")).alias("kept"), "text_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return radix_groups(table(spark, sf_dir, "documents"))


SQL = """
SELECT doc_id, MAX(doc_id) OVER w AS keep_id, COUNT(*) OVER w AS group_size,
       doc_id = MAX(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

__all__ = ["SQL", "query", "radix_groups"]
