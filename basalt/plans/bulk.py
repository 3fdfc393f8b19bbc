"""A tree of bulk operators: each takes its children's results and makes a frame; run() materialises the root.

Intermediate results are frames, so Spark plans the tree as a whole; an operator that asks for it is written as a
table of the shared folder. Own map and reduce functions work on pandas batches, or on Arrow tables of many keys.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..operators.relational import tagged_union
from ..sources import storage

#: Bytes of rows that ArrowMapReduce gathers before it combines them.
GATHERED = 8 << 20


class BulkOperator:
    materialize = False

    def __init__(self, *children: BulkOperator):
        self.children = children

    def result(self, inputs: list[DataFrame]) -> DataFrame:
        raise NotImplementedError

    def frame(self) -> DataFrame:
        out = self.result([c.frame() for c in self.children])
        if self.materialize:
            path = storage.scratch(out.sparkSession, "bulk")
            out.write.parquet(path)
            out = out.sparkSession.read.schema(out.schema).parquet(path)
        return out

    def run(self) -> str:
        """Make the result a view of its own and return the view's name."""
        name = f"result_{uuid.uuid4().hex[:12]}"
        self.frame().createOrReplaceTempView(name)
        return name


class TableInput(BulkOperator):
    """A leaf over a table, or over several with the name of each row's table."""

    def __init__(self, table: DataFrame | dict[str, DataFrame], partitions: int | None = None):
        super().__init__()
        self.table, self.partitions = table, partitions

    def result(self, inputs: list[DataFrame]) -> DataFrame:
        out = tagged_union(self.table) if isinstance(self.table, dict) else self.table
        return out if self.partitions is None else out.repartition(self.partitions)


class Identity(BulkOperator):
    def result(self, inputs: list[DataFrame]) -> DataFrame:
        return inputs[0].select("*")


class Selection(BulkOperator):
    def __init__(self, child: BulkOperator, predicate):
        super().__init__(child)
        self.predicate = predicate

    def result(self, inputs: list[DataFrame]) -> DataFrame:
        return inputs[0].where(self.predicate if not hasattr(self.predicate, "column") else self.predicate.column())


class ForwardLeft(BulkOperator):
    """Two inputs in one tagged stream, of which the rows of the left one are kept."""

    def result(self, inputs: list[DataFrame]) -> DataFrame:
        both = tagged_union({"left": inputs[0], "right": inputs[1]}, "bulk_tag")
        return both.where("bulk_tag = 'left'").select(*inputs[0].columns)


class CountTuples(BulkOperator):
    def result(self, inputs: list[DataFrame]) -> DataFrame:
        return inputs[0].agg(F.count(F.lit(1)).alias("count"))


class Map(BulkOperator):
    """An own function over batches of rows."""

    def __init__(self, child: BulkOperator, function: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str):
        super().__init__(child)
        self.function, self.schema = function, schema

    def result(self, inputs: list[DataFrame]) -> DataFrame:
        return inputs[0].mapInPandas(self.function, self.schema)


class MapReduce(Map):
    """Map, then an own function for the rows of each key; combine, if given, shrinks each batch before the shuffle.

    A key's rows are one pandas frame: only for keys whose rows fit in memory. Counts and sums are better expressed
    as aggregates, which are combined before the shuffle. Each key of each batch costs a call: functions that can
    serve many keys at once belong in ArrowMapReduce.
    """

    def __init__(self, child: BulkOperator, function, schema: str, keys: list[str], reduce: Callable[[pd.DataFrame], pd.DataFrame], reduced: str, combine: Callable[[pd.DataFrame], pd.DataFrame] | None = None):
        super().__init__(child, function, schema)
        self.keys, self.reduce, self.reduced, self.combine = keys, reduce, reduced, combine

    def result(self, inputs: list[DataFrame]) -> DataFrame:
        mapped, combine, keys = super().result(inputs), self.combine, self.keys
        if combine is not None:

            def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for part in parts:
                    for _, rows in part.groupby(keys, dropna=False, sort=False):
                        yield combine(rows)

            mapped = mapped.mapInPandas(batches, self.schema)
        return mapped.groupBy(*self.keys).applyInPandas(self.reduce, self.reduced)


class ArrowMapReduce(MapReduce):
    """Map and reduce by functions of Arrow tables, of many keys a call; integers and nulls come as they are.

    reduce gets all rows of each key of a table, in no order. combine gets any rows and returns fewer ones of the mapped schema that
    stand for them: it shrinks a task's rows before the shuffle and those of a frequent key after it. Without it, only for keys
    whose rows fit in memory. The functions' columns are put in the schema's order and cast to its types.
    """

    def result(self, inputs: list[DataFrame]) -> DataFrame:
        function, combine, reduce, most = self.function, self.combine, self.reduce, GATHERED
        mapped, reduced = (to_arrow_schema(StructType.fromDDL(s)) for s in (self.schema, self.reduced))

        def typed(table: pa.Table, schema: pa.Schema) -> pa.Table:
            return table.select(schema.names).cast(schema)

        def shrunk(tables: list[pa.Table]) -> pa.Table:
            return typed(combine(pa.concat_tables(tables)), mapped)

        def before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size = [], 0
            for table in function(pa.Table.from_batches([b]) for b in batches):
                table = typed(table, mapped)
                if combine is None:
                    yield from table.to_batches()
                    continue
                held, size = [*held, table], size + table.nbytes
                if size >= most:
                    held = [shrunk(held)]
                    size = held[0].nbytes
                    if size > most // 2:
                        yield from held[0].to_batches()
                        held, size = [], 0
            if held:
                yield from shrunk(held).to_batches()

        def after(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Rows come by hash of the key; those of the last hash wait, since the next batch may go on with it."""
            held, size, limit, last = [], 0, most, None
            for batch in batches:
                if not batch.num_rows:
                    continue
                hashes = batch.column(len(mapped)).to_numpy()
                table, start = pa.Table.from_batches([batch]).select(mapped.names), 0
                if hashes[-1] != last:
                    start, last = int(np.searchsorted(hashes, hashes[-1])), hashes[-1]
                    whole = pa.concat_tables([*held, table.slice(0, start)]) if held else table.slice(0, start)
                    if whole.num_rows:
                        yield from typed(reduce(whole), reduced).to_batches()
                    held, size, limit = [], 0, most
                held.append(table.slice(start))
                size += held[-1].nbytes
                if combine is not None and size >= limit:
                    held = [shrunk(held)]
                    size = held[0].nbytes
                    limit = max(most, 2 * size)
            if held:
                yield from typed(reduce(pa.concat_tables(held)), reduced).to_batches()

        rows = inputs[0].mapInArrow(before, self.schema)
        place = f"hash_{uuid.uuid4().hex[:12]}"
        rows = rows.withColumn(place, F.xxhash64(*self.keys)).repartition(place).sortWithinPartitions(place)
        return rows.mapInArrow(after, self.reduced)


def run_tree(spark: SparkSession, root: BulkOperator) -> DataFrame:
    return spark.table(root.run())
