"""A catalogue of tables: Parquet folders, read-only or with snapshots, their statistics, and sorted index tables.

A table that can change is a folder of immutable data files and of manifests that name those of each snapshot; what is being
read is never touched. Row locators (file, row) hold as long as their file is named; an index follows the snapshots.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import RID
from . import storage

MOST_RUNS, MOST_NAMES = 16, 5000  #: runs of an index before they are merged; files that a fetch names one by one


def _short(file: str) -> str:
    """Folder and name of a data file, as manifests have it."""
    return "/".join(file.rsplit("/", 2)[1:])


def _rid() -> Column:
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


@dataclass(frozen=True)
class ColumnStatistics:
    distinct: int
    low: str | None
    high: str | None
    nulls: int


@dataclass(frozen=True)
class TableStatistics:
    rows: int
    columns: dict[str, ColumnStatistics] = field(default_factory=dict)


class DuplicateKey(ValueError):
    """An index that is unique would get a key twice."""


class Table:
    """A named table over one Parquet path, or a folder of data files with a manifest for each snapshot.

    A manifest, log/v000001.json and so on, names the snapshot's files with their rows. Files never change: to append is to name more
    of them, to delete or update to name others in the place of those that hold affected rows. There is one writer at a time;
    a second one's manifest is refused.
    """

    def __init__(self, spark: SparkSession, name: str, path: str, versioned: bool = False):
        self.spark, self.name, self.path, self.versioned = spark, name, path.rstrip("/"), versioned
        self.unique: dict[str, Index] = {}

    def snapshots(self) -> list[str]:
        if not self.versioned:
            return [self.path]
        return [f"{self.path}/log/{n}" for n in storage.names_in(self.spark, f"{self.path}/log") if n.startswith("v")]

    def location(self) -> str:
        """Of the current snapshot."""
        found = self.snapshots()
        if not found:
            raise LookupError(f"table {self.name} has no snapshot")
        return found[-1]

    def manifest(self) -> dict:
        """schema (as JSON) and files (name to rows) of the current snapshot."""
        return json.loads(storage.read_text(self.spark, self.location()))

    def schema(self) -> T.StructType:
        return T.StructType.fromJson(self.manifest()["schema"]) if self.versioned else self.read().schema

    def read(self, files: Iterable[str] | None = None) -> DataFrame:
        """The current snapshot, or some of its files."""
        if not self.versioned:
            return self.spark.read.parquet(self.path)
        now = self.manifest()
        schema = T.StructType.fromJson(now["schema"])
        paths = [f"{self.path}/data/{n}" for n in (now["files"] if files is None else files)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def with_rid(self, files: Iterable[str] | None = None) -> DataFrame:
        """The current snapshot with a locator of each row. Locators hold as long as a row's file is part of the table."""
        df = self.read(files)
        return df.select("*", _rid().alias("rid")) if df.inputFiles() else df.withColumn("rid", F.lit(None).cast(RID))

    def hits(self, where: Column) -> dict[str, int]:
        """How many rows of each file fit; reads the columns of the condition alone, and one row per file reaches the driver."""
        df = self.read()
        if not df.inputFiles():
            return {}
        found = df.select(where.alias("hit"), F.col("_metadata.file_path").alias("file")).where("hit").groupBy("file").agg(F.count(F.lit(1)).alias("n"))
        return {_short(r["file"]): r["n"] for r in found.collect()}

    def stage(self, df: DataFrame) -> dict[str, int]:
        """Write files that no snapshot has yet; their names and rows, which are read from their footers."""
        if not self.versioned:
            raise PermissionError(f"table {self.name} is read-only")
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        df.write.parquet(folder)
        if not any(n.endswith(".parquet") for n in storage.names_in(self.spark, folder)):
            return {}
        rows = self.spark.read.schema(df.schema).parquet(folder).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n"))
        return {_short(r["file"]): r["n"] for r in rows.collect()}

    def replace(self, gone: Iterable[str], new: dict[str, int]) -> str:
        """The next snapshot: without some files, with staged ones. A key that would repeat in a unique index is refused, and the files go."""
        gone = set(gone)
        try:
            for index in self.unique.values():
                index.admit(gone, list(new))
        except DuplicateKey:
            for folder in {n.split("/")[0] for n in new}:
                storage.remove(self.spark, f"{self.path}/data/{folder}")
            raise
        now = self.manifest()
        return self._manifest(now["schema"], {n: k for n, k in now["files"].items() if n not in gone} | new)

    def _manifest(self, schema: dict, files: dict[str, int]) -> str:
        nth = max([0, *(int(p.rpartition("/v")[2][:-5]) for p in self.snapshots())]) + 1
        path = f"{self.path}/log/v{nth:06d}.json"
        storage.write_text(self.spark, path, json.dumps({"schema": schema, "files": files}))
        return path

    def commit(self, df: DataFrame) -> str:
        """The next snapshot, of these rows alone. An empty frame truncates the table."""
        new = self.stage(df)
        if self.unique and self.snapshots():
            return self.replace(self.manifest()["files"], new)
        return self._manifest(df.schema.jsonValue(), new)

    def append(self, df: DataFrame) -> int:
        """The next snapshot with more rows, and how many. Columns go by name; no file of the table is read or rewritten."""
        if not self.snapshots():
            self.commit(df)
            return sum(self.manifest()["files"].values())
        new = self.stage(df.select(*self.schema().fieldNames()))
        self.replace([], new)
        return sum(new.values())

    def vacuum(self, keep: int = 1) -> None:
        """Delete all but the last snapshots, and the files that these don't name, once no reader needs them."""
        found = self.snapshots()
        named = {n.split("/")[0] for p in found[-keep:] for n in json.loads(storage.read_text(self.spark, p))["files"]}
        for path in found[:-keep]:
            storage.remove(self.spark, path)
        for folder in set(storage.names_in(self.spark, f"{self.path}/data")) - named:
            storage.remove(self.spark, f"{self.path}/data/{folder}")

    def analyze(self) -> TableStatistics:
        """Row count and, for each column, distinct count (approximate), bounds and nulls, in one pass."""
        df = self.read()
        plain = [f.name for f in df.schema if f.dataType.typeName() not in ("array", "map", "struct")]
        aggs = [F.count(F.lit(1)).alias("n")]
        for i, c in enumerate(plain):
            aggs += [F.approx_count_distinct(c).alias(f"d{i}"), F.min(c).cast("string").alias(f"l{i}"), F.max(c).cast("string").alias(f"h{i}"), F.count(c).alias(f"c{i}")]
        r = df.agg(*aggs).first()
        return TableStatistics(r["n"], {c: ColumnStatistics(r[f"d{i}"], r[f"l{i}"], r[f"h{i}"], r["n"] - r[f"c{i}"]) for i, c in enumerate(plain)})


class Index:
    """A side table (key, rid) sorted by key over ranges, so that row groups prune on it.

    It is a list of runs: one for the files that were there when it was built, and one more for what each refresh() finds new. Entries
    of files that the table no longer has are passed over. Null keys have no entry.
    """

    def __init__(self, table: Table, column: str, path: str, unique: bool = False):
        self.table, self.column, self.path, self.unique = table, column, path, unique
        self.at = table.location()
        self.runs: list[str] = []
        self.files: set[str] = set()
        self.gone: set[str] = set()

    @classmethod
    def build(cls, table: Table, column: str, unique: bool = False, path: str | None = None) -> Index:
        path = path or storage.scratch(table.spark, f"index-{table.name}-{column}")
        index = cls(table, column, path, unique)
        index.files = set(table.manifest()["files"]) if table.versioned else set()
        index._run(table.with_rid())
        if unique and not index.duplicates().isEmpty():
            raise DuplicateKey(f"{table.name}.{column} has duplicate keys")
        if unique:
            table.unique[column] = index
        return index

    def _run(self, rows: DataFrame) -> str:
        target = f"{self.path}/run{len(self.runs):04d}-{uuid.uuid4().hex}"
        rows = rows.select(F.col(self.column).alias("key"), "rid").where("key is not null")
        rows.repartitionByRange("key").sortWithinPartitions("key").write.parquet(target)
        self.runs.append(target)
        return target

    def refresh(self) -> None:
        """Follow the table to its current snapshot: index new files, pass over old ones. Many runs or old files are merged into one run."""
        at = self.table.location()
        if at == self.at:
            return
        now = set(self.table.manifest()["files"])
        new, self.gone = now - self.files, self.gone | (self.files - now)
        if len(self.runs) >= MOST_RUNS or len(self.gone) > max(len(now), MOST_RUNS):
            old, self.runs, self.gone, new = self.runs, [], set(), now
            self._run(self.table.with_rid())
            for path in old:
                storage.remove(self.table.spark, path)
        elif new:
            self._run(self.table.with_rid(sorted(new)))
        self.files, self.at = now, at

    def admit(self, gone: set[str], new: list[str]) -> None:
        """Refuse staged files whose keys repeat each other's, or those of the table without the files that go."""
        if not new:
            return
        self.refresh()
        keys = self.table.read(new).select(F.col(self.column).alias("key")).where("key is not null")
        twice = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
        twice = twice.unionByName(keys.join(self.rows(gone).select("key"), "key", "left_semi"))
        found = twice.first()
        if found is not None:
            raise DuplicateKey(f"{self.table.name}.{self.column} would have {found['key']!r} twice")

    def rows(self, without: Iterable[str] = ()) -> DataFrame:
        df = self.table.spark.read.parquet(*self.runs)
        gone = sorted(self.gone | set(without))
        return df.where(~F.substring_index("rid.file", "/", -2).isin(gone)) if gone else df

    def duplicates(self) -> DataFrame:
        return self.rows().groupBy(F.col("key").alias("k")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")

    def equal(self, value) -> DataFrame:
        """Locators of the rows whose key is value."""
        return self.rows().where(F.col("key") == F.lit(value)).select("rid")

    def within(self, predicate: Callable[[Column], Column]) -> DataFrame:
        """Locators of the rows whose key fits."""
        return self.rows().where(predicate(F.col("key"))).select("rid")

    def keys(self, predicate: Callable[[Column], Column]) -> DataFrame:
        """The keys themselves, duplicates kept, in order within ranges."""
        return self.rows().where(predicate(F.col("key"))).select(F.col("key").alias(self.column))

    def correlated(self, outer: DataFrame, column: str) -> DataFrame:
        """Each outer row with the locators of the rows whose key is its column."""
        return outer.join(self.rows().select("key", "rid"), outer[column] == F.col("key")).drop("key")

    def fetch(self, rids: DataFrame, columns: list[str], predicate: Callable[[Column], Column] | None = None) -> DataFrame:
        """The rows that locators point to, projected; what the locators bring along stays.

        Only files that locators name are read: these names, at most one per file of the table, come to the driver first. The predicate
        that the locators were found with, if given, goes to the scan as well, which then passes over row groups by their bounds.
        """
        base = self.table.read()
        names = [r["file"] for r in rids.select("rid.file").distinct().collect()]
        if len(names) <= MOST_NAMES:
            base = base.where(F.col("_metadata.file_path").isin(names)) if names else base.where("false")
        if predicate is not None:
            base = base.where(predicate(F.col(self.column)))
        return rids.join(base.select(*columns, _rid().alias("rid")) if base.inputFiles() else base.select(*columns, F.lit(None).cast(RID).alias("rid")), "rid").drop("rid")


class Catalog:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: dict[str, Table] = {}
        self.indexes: dict[tuple[str, str], Index] = {}

    @classmethod
    def over(cls, spark: SparkSession, folder: str, names: list[str]) -> Catalog:
        out = cls(spark)
        for n in names:
            out.register(n, f"{folder}/{n}.parquet")
        return out

    def register(self, name: str, path: str, versioned: bool = False) -> Table:
        """Names are case-insensitive."""
        self.tables[name.lower()] = t = Table(self.spark, name.lower(), path, versioned)
        return t

    def create(self, name: str, df: DataFrame, path: str | None = None) -> Table:
        """A table with snapshots, df being the first."""
        t = self.register(name, path or storage.scratch(self.spark, f"table-{name}"), versioned=True)
        t.commit(df)
        return t

    def __getitem__(self, name: str) -> Table:
        if name.lower() not in self.tables:
            raise LookupError(f"no table {name}")
        return self.tables[name.lower()]

    def index(self, table: str, column: str, unique: bool = False) -> Index:
        """An index on the current snapshot; built when it is missing, else refreshed. From then on a unique one refuses keys that repeat."""
        key = (table.lower(), column.lower())
        found = self.indexes.get(key)
        if found is None or unique and not found.unique:
            self.indexes[key] = found = Index.build(self[table], column, unique)
        found.refresh()
        return found

    def save(self, path: str) -> None:
        """The registry as a JSON file on the driver."""
        with open(path, "w", encoding="utf-8") as f:
            json.dump([{"name": t.name, "path": t.path, "versioned": t.versioned} for t in self.tables.values()], f, indent=1)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Catalog:
        out = cls(spark)
        with open(path, encoding="utf-8") as f:
            for t in json.load(f):
                out.register(**t)
        return out
