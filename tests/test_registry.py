import glob
import os

import duckdb
import pytest

from basalt.operators import relational
from basalt.plans import registry


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        files = path if os.path.isfile(path) else f"{path}/*.parquet"
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{files}'")
    return con


def rows(frame, columns):
    def plain(v):
        return None if v is None or v != v else float(v) if isinstance(v, int | float) and not isinstance(v, bool) else str(v)

    return sorted(([plain(v) for v in r] for r in frame[columns].astype(object).to_numpy()), key=repr)


@pytest.mark.parametrize("name", list(registry.queries()))
def test_same_as_sql(spark, duck, sf, name):
    got, want = registry.queries()[name](spark, sf).toPandas(), duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(want.columns))


def plan(df):
    return df._jdf.queryExecution().toString()


def test_filters_and_columns_reach_the_scan(spark, sf):
    text = plan(registry.queries()["scan_filter_conj"](spark, sf))
    assert "PushedFilters: [IsNotNull" in text and "GreaterThan(l_suppkey,10)" in text
    assert "ReadSchema: struct<l_partkey:bigint,l_suppkey:bigint,l_quantity:double>" in text


def test_join_strategies(spark, sf):
    assert "SortMergeJoin" in plan(registry.queries()["merge_join"](spark, sf))
    for name in ("multiway_join", "mixed_equi_theta_join", "order_by_aggregate"):
        assert "CartesianProduct" not in plan(registry.queries()[name](spark, sf))


def test_sorted_output(spark, sf):
    got = [(r[0], r[1]) for r in registry.queries()["sort_multi_dir"](spark, sf).collect()]
    assert got == sorted(got, key=lambda r: (-r[0], r[1]))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["n_nationkey", "n_name", "sum_extendedprice"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_lookups_and_merge_joins_of_whole_tables(spark, sf):
    orders, customers, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("orders", "customer", "lineitem"))
    want = orders.join(customers, orders.o_custkey == customers.c_custkey).count()
    assert registry.queries()["index_correlated_lookup"](spark, sf).count() == want
    got = registry.queries()["merge_join_multi_key"](spark, sf)
    assert got.count() == items.where("l_partkey is not null and l_suppkey is not null").count() and "SortMergeJoin" in plan(got)


def sorts(df):
    return df._jdf.queryExecution().sparkPlan().toString().count("Sort ["), df._jdf.queryExecution().executedPlan().toString().count("Sort [")


def test_sort_is_left_out_where_rows_are_sorted(spark, sf):
    left, right = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("orders", "lineitem"))
    joined = relational.merge_join(left, right, ["o_orderkey"], ["l_orderkey"], ["o_orderkey", "l_quantity"])
    once = relational.sort(joined, ["o_orderkey"], within_partitions=True)
    assert sorts(joined)[1] == sorts(once)[1] == 2
    assert sorts(relational.sort(joined, ["l_quantity"], within_partitions=True))[1] == 3
    again = relational.sort(relational.sort(left, ["o_custkey"]), ["o_custkey"])
    assert sorts(again)[1] == 1


def test_bulk_map_reduce_serves_many_keys_a_call(spark, duck, sf, tmp_path):
    for path in glob.glob(f"{sf}/*.parquet"):
        if not path.endswith("/lineitem.parquet"):
            os.symlink(path, tmp_path / os.path.basename(path))
    duck.sql(
        "COPY (SELECT CASE WHEN i % 7 > 0 THEN 9007199254740993 + i % 9000 END AS l_suppkey, CASE WHEN i % 3 > 0 THEN CAST(i % 7 AS INT) END AS l_linenumber "
        f"FROM range(30000) r(i)) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)"
    )
    got = registry.queries()["bulk_map_reduce"](spark, str(tmp_path))
    want = duck.sql(registry.oracle_sql()["bulk_map_reduce"].replace("FROM lineitem", f"FROM '{tmp_path}/lineitem.parquet'")).fetchall()
    assert "FlatMapGroupsInPandas" not in plan(got)
    found = [tuple(r) for r in got.collect()]
    assert len(found) == 9001 and sum(r[2] is None for r in found) == 3000
    assert sorted(found, key=repr) == sorted(want, key=repr)
