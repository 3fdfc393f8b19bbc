"""Insert, delete and update. Each returns a frame with one row: the number of rows affected.

A statement writes new files alone: an insert those of its rows, a delete or update those that take the place of files with affected
rows; all others stay as they are. Inserted rows are evaluated once, their number is that of the written files. A condition
that is null keeps the row as it is. Keys that would repeat in a unique index are refused with DuplicateKey.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.catalog import Table


def _affected(table: Table, n: int) -> DataFrame:
    return table.spark.range(1).select(F.lit(n).cast("long").alias("affected"))


def _true(where: Column | None) -> Column:
    return F.lit(True) if where is None else F.coalesce(where, F.lit(False))


def insert(table: Table, rows: DataFrame) -> DataFrame:
    """Append rows, whose columns go by position."""
    into = table.schema()
    if len(rows.columns) != len(into):
        raise ValueError(f"{table.name} has {len(into)} columns, the rows have {len(rows.columns)}")
    rows = rows.toDF(*into.fieldNames())
    rows = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in into))
    return _affected(table, table.append(rows))


def _rewrite(table: Table, files: list[str], rows: DataFrame | None) -> int:
    """Name what rows are written to in the place of files, and tell how many rows these held. No files, no snapshot."""
    if files:
        held = table.manifest()["files"]
        new = {} if rows is None else table.stage(rows)
        table.replace(files, {n: k for n, k in new.items() if k})
        return sum(held[f] for f in files) - sum(new.values())
    return 0


def delete(table: Table, where: Column | None = None) -> DataFrame:
    """A file all of whose rows go is not even read."""
    hits = table.hits(_true(where))
    held = table.manifest()["files"]
    part = [f for f in hits if hits[f] < held[f]]
    _rewrite(table, list(hits), table.read(part).where(~_true(where)) if part else None)
    return _affected(table, sum(hits.values()))


def delete_rids(table: Table, rids: DataFrame) -> DataFrame:
    """Delete the rows that locators point to; those of files that the table no longer has point to nothing."""
    rids = rids.select("rid").distinct()
    held = table.manifest()["files"]
    named = {"/".join(r["file"].rsplit("/", 2)[1:]) for r in rids.select("rid.file").distinct().collect()}
    files = sorted(named & held.keys())
    return _affected(table, _rewrite(table, files, table.with_rid(files).join(rids, "rid", "left_anti").drop("rid") if files else None))


def update(table: Table, values: dict[str, Any], where: Column | None = None) -> DataFrame:
    """values: column to literal or expression over the old row."""
    hits = table.hits(_true(where))
    if hits:
        rows = table.read(hits)
        kinds = {f.name: f.dataType for f in rows.schema}
        new = {c: F.when(_true(where), (v if isinstance(v, Column) else F.lit(v)).cast(kinds[c])).otherwise(F.col(c)) for c, v in values.items()}
        _rewrite(table, list(hits), rows.withColumns(new))
    return _affected(table, sum(hits.values()))
