"""Scans, projections, filters, joins, aggregates and sorts as functions from frames to frames.

They only declare; Catalyst pushes filters and columns into scans, picks join strategies and places exchanges.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import ALWAYS_FALSE, ALWAYS_TRUE, Between, Comparison, all_of, by_selectivity

Name = str | tuple[str, str]
FUNCTIONS = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}


def _condition(p: Any) -> Column:
    return p if isinstance(p, Column) else all_of(p) if isinstance(p, list | tuple) else p.column()


def project(df: DataFrame, columns: Sequence[Name | Column]) -> DataFrame:
    """Columns by name or (name, alias), in any order, repeated at will."""
    return df.select(*(c if isinstance(c, Column) else F.col(c).alias(c.rpartition(".")[2]) if isinstance(c, str) else F.col(c[0]).alias(c[1]) for c in columns))


def filter_rows(df: DataFrame, predicate: Any) -> DataFrame:
    """Rows for which a predicate, or all of a list, is true."""
    return df.where(_condition(predicate))


def conjunction(predicates: Iterable[Any], distinct: dict[str, int] | None = None) -> list[Any]:
    """What is always true is left out, one that is always false stands for all, and the most selective comes first.

    distinct: distinct counts of columns, where statistics have them. Whatever is no comparison stays behind those that are.
    """
    parts = list(predicates)
    known = [p for p in parts if isinstance(p, Comparison | Between) and p.truth() != ALWAYS_TRUE]
    if any(p.truth() == ALWAYS_FALSE for p in known):
        return [F.lit(False)]
    return [*by_selectivity(known, distinct), *(p for p in parts if not isinstance(p, Comparison | Between))]


def scan(df: DataFrame, columns: Sequence[Name] | None = None, predicates: Iterable[Any] = (), distinct: dict[str, int] | None = None) -> DataFrame:
    """Filter on the table's own columns, the most selective predicate first, then project."""
    df = df.where(all_of(conjunction(predicates, distinct)))
    return df if columns is None else project(df, columns)


def theta_join(outer: DataFrame, inner: DataFrame, predicate: Any = None, columns: Sequence[Name | Column] | None = None) -> DataFrame:
    """Inner join on any predicate; without one the Cartesian product. Equalities in it still become a hash or merge join."""
    out = outer.crossJoin(inner) if predicate is None else outer.join(inner, _condition(predicate), "inner")
    return out if columns is None else project(out, columns)


def merge_join(left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_keys: Sequence[str], columns: Sequence[Name | Column] | None = None) -> DataFrame:
    """Inner join on equal keys by sorting both sides; duplicates multiply."""
    on = [F.col(a) == F.col(b) for a, b in zip(left_keys, right_keys, strict=True)]
    out = left.hint("merge").join(right, on, "inner")
    return out if columns is None else project(out, columns)


def equi_join(left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_keys: Sequence[str], columns: Sequence[Name | Column] | None = None, residual: Any = None) -> DataFrame:
    """Inner join on equal keys, with a residual predicate if there is one; the strategy is Spark's."""
    on = all_of([F.col(a) == F.col(b) for a, b in zip(left_keys, right_keys, strict=True)])
    out = left.join(right, on if residual is None else on & _condition(residual), "inner")
    return out if columns is None else project(out, columns)


def correlated(outer: DataFrame, inner: DataFrame, predicate: Any, columns: Sequence[Name | Column] | None = None) -> DataFrame:
    """For each outer row the inner rows that fit it: a join, since correlation by re-opening does not distribute."""
    return theta_join(outer, inner, predicate, columns)


def group_by(df: DataFrame, keys: Sequence[Name], aggregates: dict[str, tuple[str, Any]], output: Sequence[str] | None = None) -> DataFrame:
    """aggregates: alias to (function, column name or expression; '*' counts rows). Without keys one row for any input.

    sum of integers is a long, avg a double; nulls are skipped. output reorders and interleaves keys and aggregates.
    """
    named = [F.col(k) if isinstance(k, str) else F.col(k[0]).alias(k[1]) for k in keys]
    out = [FUNCTIONS[f](F.lit(1) if isinstance(c, str) and c == "*" else F.col(c) if isinstance(c, str) else c).alias(a) for a, (f, c) in aggregates.items()]
    got = df.groupBy(*named).agg(*out) if named else df.agg(*out)
    return got if output is None else got.select(*output)


def having(df: DataFrame, predicate: Any) -> DataFrame:
    """A filter above an aggregation, by its aliases."""
    return filter_rows(df, predicate)


def money_sum(c: Column | str, scale: int = 2) -> Column:
    """The sum of amounts that are rounded to scale decimals first: exact, whatever the order of additions."""
    c = F.col(c) if isinstance(c, str) else c
    return F.sum(c.cast(f"decimal(18,{scale})")).cast("double")


def sort(df: DataFrame, keys: Sequence[str | tuple[str, bool]], within_partitions: bool = False) -> DataFrame:
    """keys: name or (name, ascending). Nulls come first ascending and last descending."""
    order = [F.asc_nulls_first(k) if isinstance(k, str) else F.asc_nulls_first(k[0]) if k[1] else F.desc_nulls_last(k[0]) for k in keys]
    return df.sortWithinPartitions(*order) if within_partitions else df.orderBy(*order)


def tagged_union(inputs: dict[str, DataFrame], tag: str = "source_table") -> DataFrame:
    """Rows of several tables with the name of the one each is from; columns that a table lacks are null."""
    out = None
    for name, df in inputs.items():
        df = df.withColumn(tag, F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no inputs")
    return out
