"""What the operators share: a folder that every executor sees, saved tables, and null-safe keys."""

from __future__ import annotations

import ctypes
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.storage import remove, scratch

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application: they need not have it installed."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        top = Path(__file__).resolve().parents[1]
        target = os.path.join(tempfile.mkdtemp(prefix="basalt-"), f"{top.name}.zip")
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, str(p.relative_to(top.parent)))
        spark.sparkContext.addPyFile(target)
        _shipped.add(app)


def freeing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that gives freed memory back to the system when its task ends: workers stay and wait for other tasks."""

    def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it, others need not
            if trim is not None:
                trim(0)

    return freed


class Workspace:
    """One run's tables under the shared folder. Saved tables cut lineage and outlive executors."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.path = scratch(spark, name)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str) -> None:
        """Delete a table that no returned frame reads any more."""
        remove(self.spark, f"{self.path}/{name}")

    def close(self) -> None:
        """Delete all of them, once nothing reads a returned frame any more. storage.sweep() does so for all of an application."""
        remove(self.spark, self.path)


def numbered_rows(ws: Workspace, df: DataFrame, keys: list, name: str) -> DataFrame:
    """Sorted by keys and saved, with part (number of the range) and idx (number within it).

    Ranges are as even as the keys allow: if many rows can be equal in all of them, let the last be place() of a saved table.
    """
    df = df.orderBy(*keys).withColumn("mid", F.monotonically_increasing_id())
    df = df.withColumns({"part": F.shiftright("mid", 33), "idx": F.col("mid").bitwiseAND(F.lit((1 << 33) - 1))}).drop("mid")
    return ws.save(df, name)


def place() -> Column:
    """Where a row stands in a saved table: the same whenever a lost task reads it again."""
    return F.monotonically_increasing_id()


def ranked(rows: DataFrame, group: str) -> DataFrame:
    """numbered_rows() that were sorted by group first, with rank (from 0, within the group) and of (its rows).

    Windows run over a row per group and range alone.
    """
    parts = rows.groupBy(group, "part").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("low"))
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(group, "part", "low", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy(group)).alias("of"))
    return join_on(rows, parts, [group, "part"]).withColumn("rank", F.col("idx") - F.col("low") + F.col("before")).drop("part", "idx", "low", "before")


def join_on(left: DataFrame, right: DataFrame, names: Iterable[str], how: str = "inner") -> DataFrame:
    """A join on all names in which null equals null; the result has the left side's keys."""
    names = list(names)
    right = right.withColumnsRenamed({n: f"right_{n}" for n in names})
    on = F.lit(True)
    for n in names:
        on = on & F.col(n).eqNullSafe(F.col(f"right_{n}"))
    return left.join(right, on, how).drop(*(f"right_{n}" for n in names))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
