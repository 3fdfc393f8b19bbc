"""The relational queries, built from the package's operators, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import types
from ..functions.predicates import Between, all_of, any_of, compare, compare_columns, merge_ranges
from ..operators import dml
from ..operators.relational import correlated, equi_join, filter_rows, group_by, having, money_sum, project, scan, sort, tagged_union, theta_join
from ..operators.relational import merge_join as merge
from ..sources.catalog import Catalog
from . import bulk

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]
_catalogs: dict[tuple[str, str], Catalog] = {}
_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """One per application and folder, so that an index is built once."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _catalogs:
        _catalogs[key] = Catalog.over(spark, sf_dir, TABLES)
    return _catalogs[key]


def query(sql: str):
    def add(f: Callable[[Catalog], DataFrame]):
        _queries[f.__name__] = lambda spark, sf_dir: f(catalog(spark, sf_dir))
        _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


PARTSUPP = """WITH partsupp AS (SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, CAST(SUM(l_quantity) AS INT) AS ps_availqty,
MIN(l_extendedprice) AS ps_supplycost FROM lineitem GROUP BY l_partkey, l_suppkey) """


def partsupp(c: Catalog) -> DataFrame:
    """Parts by supplier, derived from the line items."""
    return group_by(c["lineitem"].read(), [("l_partkey", "ps_partkey"), ("l_suppkey", "ps_suppkey")], {"qty": ("sum", "l_quantity"), "ps_supplycost": ("min", "l_extendedprice")}).select(
        "ps_partkey", "ps_suppkey", F.col("qty").cast("int").alias("ps_availqty"), "ps_supplycost"
    )


@query("SELECT l_tax, l_orderkey, l_tax AS l_tax2 FROM lineitem")
def scan_project(c):
    return scan(c["lineitem"].read(), ["l_tax", "l_orderkey", ("l_tax", "l_tax2")])


@query("SELECT l_partkey, l_suppkey, l_quantity FROM lineitem WHERE l_suppkey > 10 AND l_suppkey < 90 AND l_quantity >= 5")
def scan_filter_conj(c):
    predicates = merge_ranges([compare("l_suppkey", ">", 10), compare("l_suppkey", "<", 90), compare("l_quantity", ">=", 5)])
    return scan(c["lineitem"].read(), ["l_partkey", "l_suppkey", "l_quantity"], predicates)


@query(
    "SELECT 'eq' AS op, COUNT(*) AS n FROM part WHERE p_size = 10 UNION ALL SELECT 'ne', COUNT(*) FROM part WHERE p_size <> 10 UNION ALL SELECT 'lt', COUNT(*) FROM part WHERE p_size < 10 "
    "UNION ALL SELECT 'le', COUNT(*) FROM part WHERE p_size <= 10 UNION ALL SELECT 'gt', COUNT(*) FROM part WHERE p_size > 10 UNION ALL SELECT 'ge', COUNT(*) FROM part WHERE p_size >= 10"
)
def filter_each_op(c):
    ops = {"eq": "=", "ne": "<>", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}
    counts = c["part"].read().agg(*(F.count(F.when(compare("p_size", op, 10).column(), 1)).alias(n) for n, op in ops.items()))
    return counts.unpivot([], list(ops), "op", "n")


@query("SELECT p_partkey, p_size FROM part WHERE p_size < 5 OR p_brand = 'Brand#17'")
def filter_disjunction(c):
    return scan(c["part"].read(), ["p_partkey", "p_size"], [any_of([compare("p_size", "<", 5), compare("p_brand", "=", "Brand#17")])])


@query("SELECT p_partkey, p_size FROM part WHERE p_size > 10 AND p_size <= 20")
def filter_between(c):
    return scan(c["part"].read(), ["p_partkey", "p_size"], [Between("p_size", 10, 20, low_included=False)])


@query("SELECT n_nationkey, n_name FROM nation WHERE n_name > 'NATION_15' AND n_name <> 'NATION_2'")
def filter_string_order(c):
    return scan(c["nation"].read(), ["n_nationkey", "n_name"], [compare("n_name", ">", "NATION_15"), compare("n_name", "<>", "NATION_2")])


@query("SELECT x FROM (SELECT CASE WHEN p_size > 25 THEN NULL ELSE p_size END AS x FROM part) t WHERE x <> 7")
def filter_null_false(c):
    some = c["part"].read().select(F.when(~compare("p_size", ">", 25).column(), F.col("p_size")).alias("x"))
    return filter_rows(some, compare("x", "<>", 7))


@query("SELECT l_partkey, l_suppkey, l_quantity FROM lineitem WHERE l_partkey = 100")
def index_point_lookup(c):
    index = c.index("lineitem", "l_partkey")
    return index.fetch(index.equal(100), ["l_partkey", "l_suppkey", "l_quantity"], lambda k: k == 100)


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey > 23 AND o_custkey <= 43")
def index_range_lookup(c):
    index = c.index("orders", "o_custkey")
    wanted = lambda k: (k > 23) & (k <= 43)
    return index.fetch(index.within(wanted), ["o_orderkey", "o_custkey", "o_totalprice"], wanted)


@query("SELECT o_custkey FROM orders WHERE o_custkey >= 100 AND o_custkey < 150")
def index_key_scan(c):
    return c.index("orders", "o_custkey").keys(lambda k: (k >= 100) & (k < 150))


@query("SELECT o_custkey AS k, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 1")
def index_unique_check(c):
    return c.index("orders", "o_custkey").duplicates()


@query("SELECT c.c_custkey, s.s_suppkey FROM customer c, supplier s WHERE c.c_nationkey = 3 AND s.s_acctbal > c.c_acctbal")
def nl_join_theta(c):
    outer = scan(c["customer"].read(), ["c_custkey", "c_acctbal"], [compare("c_nationkey", "=", 3)])
    return theta_join(outer, scan(c["supplier"].read(), ["s_suppkey", "s_acctbal"]), compare_columns("s_acctbal", ">", "c_acctbal"), ["c_custkey", "s_suppkey"])


@query("SELECT r.r_name, n.n_name FROM region r, nation n WHERE r.r_regionkey <> n.n_regionkey")
def nl_join_not_equal(c):
    return theta_join(c["region"].read(), c["nation"].read(), compare_columns("r_regionkey", "<>", "n_regionkey"), ["r_name", "n_name"])


@query("SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n")
def cross_join(c):
    return theta_join(c["region"].read(), c["nation"].read(), None, ["r_name", "n_name"])


@query("SELECT r.r_regionkey, n.n_nationkey FROM region r, nation n WHERE r.r_regionkey = n.n_regionkey OR r.r_regionkey = n.n_nationkey")
def join_disjunctive(c):
    either = any_of([compare_columns("r_regionkey", "=", "n_regionkey"), compare_columns("r_regionkey", "=", "n_nationkey")])
    return theta_join(c["region"].read(), c["nation"].read(), either, ["r_regionkey", "n_nationkey"])


@query("SELECT c.c_name, c.c_mktsegment, o.o_orderstatus, o.o_orderpriority FROM customer c, orders o WHERE c.c_custkey = o.o_custkey AND c.c_nationkey = 7")
def index_nl_join(c):
    outer = filter_rows(c["customer"].read(), compare("c_nationkey", "=", 7))
    return equi_join(outer, c["orders"].read(), ["c_custkey"], ["o_custkey"], ["c_name", "c_mktsegment", "o_orderstatus", "o_orderpriority"])


@query("SELECT l.l_linenumber, l.l_quantity, o.o_totalprice FROM orders o, lineitem l WHERE o.o_orderkey = l.l_orderkey AND o.o_totalprice >= 400000 AND o.o_orderpriority = '1-URGENT' AND l.l_returnflag = 'A'")
def index_nl_join_filtered(c):
    outer = filter_rows(c["orders"].read(), [compare("o_totalprice", ">=", 400000), compare("o_orderpriority", "=", "1-URGENT")])
    inner = filter_rows(c["lineitem"].read(), compare("l_returnflag", "=", "A"))
    return equi_join(outer, inner, ["o_orderkey"], ["l_orderkey"], ["l_linenumber", "l_quantity", "o_totalprice"])


@query("SELECT r.r_name, n.n_name FROM region r, LATERAL (SELECT n_name FROM nation WHERE n_regionkey = r.r_regionkey) n")
def correlated_filter(c):
    return correlated(c["region"].read(), c["nation"].read(), compare_columns("n_regionkey", "=", "r_regionkey"), ["r_name", "n_name"])


@query("SELECT c.c_custkey, n.n_name FROM nation n, customer c WHERE n.n_nationkey = c.c_nationkey")
def merge_join(c):
    return merge(c["nation"].read(), c["customer"].read(), ["n_nationkey"], ["c_nationkey"], ["c_custkey", "n_name"])


@query(PARTSUPP + "SELECT l.l_orderkey, ps.ps_availqty FROM lineitem l, partsupp ps WHERE l.l_partkey = ps.ps_partkey AND l.l_suppkey = ps.ps_suppkey")
def merge_join_multi_key(c):
    return merge(c["lineitem"].read(), partsupp(c), ["l_partkey", "l_suppkey"], ["ps_partkey", "ps_suppkey"], ["l_orderkey", "ps_availqty"])


@query(
    "SELECT l.l_extendedprice, o.o_totalprice, c.c_name, p.p_name FROM lineitem l, orders o, customer c, part p WHERE p.p_partkey = l.l_partkey AND o.o_custkey = c.c_custkey "
    "AND l.l_orderkey = o.o_orderkey AND l.l_extendedprice < o.o_totalprice AND c.c_custkey < 100"
)
def mixed_equi_theta_join(c):
    customers = filter_rows(c["customer"].read(), compare("c_custkey", "<", 100))
    orders = equi_join(customers, c["orders"].read(), ["c_custkey"], ["o_custkey"])
    items = equi_join(orders, c["lineitem"].read(), ["o_orderkey"], ["l_orderkey"], residual=compare_columns("l_extendedprice", "<", "o_totalprice"))
    return equi_join(items, c["part"].read(), ["l_partkey"], ["p_partkey"], ["l_extendedprice", "o_totalprice", "c_name", "p_name"])


def _supply(c, prefix: str = "") -> DataFrame:
    """Suppliers of parts with nation and region."""
    out = equi_join(c["region"].read(), c["nation"].read(), ["r_regionkey"], ["n_regionkey"])
    out = equi_join(out, c["supplier"].read(), ["n_nationkey"], ["s_nationkey"])
    out = equi_join(out, partsupp(c), ["s_suppkey"], ["ps_suppkey"])
    return equi_join(out, c["part"].read(), ["ps_partkey"], ["p_partkey"])


@query(
    PARTSUPP + "SELECT n.n_name, s.s_name, p.p_name, p.p_brand FROM region r, nation n, supplier s, partsupp ps, part p WHERE r.r_name = 'AFRICA' AND r.r_regionkey = n.n_regionkey "
    "AND n.n_nationkey = s.s_nationkey AND ps.ps_suppkey = s.s_suppkey AND ps.ps_partkey = p.p_partkey AND p.p_brand = 'Brand#3'"
)
def multiway_join(c):
    return scan(_supply(c), ["n_name", "s_name", "p_name", "p_brand"], [compare("r_name", "=", "AFRICA"), compare("p_brand", "=", "Brand#3")])


@query("SELECT a.n_name AS a, b.n_name AS b FROM nation a, nation b WHERE a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def self_join(c):
    a, b = c["nation"].read().alias("a"), c["nation"].read().alias("b")
    return theta_join(a, b, [compare_columns("a.n_regionkey", "=", "b.n_regionkey"), compare_columns("a.n_nationkey", "<", "b.n_nationkey")], [("a.n_name", "a"), ("b.n_name", "b")])


@query(PARTSUPP + "SELECT ps_partkey, CAST(SUM(ps_availqty) AS BIGINT) AS ps_availqty FROM partsupp GROUP BY ps_partkey")
def group_single_sum(c):
    return group_by(partsupp(c), ["ps_partkey"], {"ps_availqty": ("sum", "ps_availqty")})


@query(
    "SELECT c_nationkey, COUNT(c_acctbal) AS cnt, CAST(SUM(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS total, "
    "ROUND(CAST(SUM(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) / COUNT(c_acctbal), 4) AS mean, MIN(c_acctbal) AS lo, MAX(c_acctbal) AS hi FROM customer GROUP BY c_nationkey"
)
def group_all_aggs(c):
    exact = F.col("c_acctbal").cast("decimal(18,2)")
    out = group_by(c["customer"].read(), ["c_nationkey"], {"cnt": ("count", "c_acctbal"), "sum": ("sum", exact), "lo": ("min", "c_acctbal"), "hi": ("max", "c_acctbal")})
    total = F.col("sum").cast("double")
    return out.select("c_nationkey", "cnt", total.alias("total"), F.round(total / F.col("cnt"), 4).alias("mean"), "lo", "hi")


@query("SELECT COUNT(*) AS cnt, MIN(o_totalprice) AS lo, MAX(o_orderdate) AS last_date, MIN(o_orderpriority) AS first_prio FROM orders")
def global_aggs(c):
    return group_by(c["orders"].read(), [], {"cnt": ("count", "*"), "lo": ("min", "o_totalprice"), "last_date": ("max", "o_orderdate"), "first_prio": ("min", "o_orderpriority")})


@query("SELECT COUNT(c_acctbal) AS cnt, SUM(c_acctbal) AS s, AVG(c_acctbal) AS a, MIN(c_acctbal) AS lo, MAX(c_acctbal) AS hi FROM customer WHERE c_custkey < 0")
def global_aggs_empty(c):
    none = filter_rows(c["customer"].read(), compare("c_custkey", "<", 0))
    return group_by(none, [], {"cnt": ("count", "c_acctbal"), "s": ("sum", "c_acctbal"), "a": ("avg", "c_acctbal"), "lo": ("min", "c_acctbal"), "hi": ("max", "c_acctbal")})


@query("SELECT c_nationkey, COUNT(*) AS cnt FROM customer WHERE c_nationkey < 0 GROUP BY c_nationkey")
def group_empty(c):
    return group_by(filter_rows(c["customer"].read(), compare("c_nationkey", "<", 0)), ["c_nationkey"], {"cnt": ("count", "*")})


@query("SELECT l_returnflag, ROUND(CAST(SUM(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2))) AS DOUBLE), 2) AS disc FROM lineitem GROUP BY l_returnflag")
def agg_expression(c):
    product = F.col("l_extendedprice").cast("decimal(12,2)") * F.col("l_discount").cast("decimal(4,2)")
    out = group_by(c["lineitem"].read(), ["l_returnflag"], {"disc": ("sum", product)})
    return out.select("l_returnflag", F.round(F.col("disc").cast("double"), 2).alias("disc"))


@query(
    "SELECT r.r_regionkey AS regionkey, CAST(SUM(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_totalprice FROM orders o, customer c, nation n, region r "
    "WHERE n.n_regionkey = r.r_regionkey AND c.c_nationkey = n.n_nationkey AND o.o_custkey = c.c_custkey GROUP BY r.r_regionkey HAVING sum_totalprice > 1000"
)
def having_alias(c):
    rows = equi_join(c["region"].read(), c["nation"].read(), ["r_regionkey"], ["n_regionkey"])
    rows = equi_join(rows, c["customer"].read(), ["n_nationkey"], ["c_nationkey"])
    rows = equi_join(rows, c["orders"].read(), ["c_custkey"], ["o_custkey"])
    sums = rows.groupBy(F.col("r_regionkey").alias("regionkey")).agg(money_sum("o_totalprice").alias("sum_totalprice"))
    return having(sums, compare("sum_totalprice", ">", 1000))


@query("SELECT COUNT(*) AS count FROM lineitem")
def count_tuples(c):
    return bulk.CountTuples(bulk.TableInput(c["lineitem"].read())).frame()


@query("SELECT s_nationkey, s_name, s_acctbal FROM supplier ORDER BY s_nationkey DESC, s_name ASC NULLS FIRST")
def sort_multi_dir(c):
    return sort(scan(c["supplier"].read(), ["s_nationkey", "s_name", "s_acctbal"]), [("s_nationkey", False), "s_name"])


@query("SELECT l_orderkey, l_partkey, l_quantity, l_returnflag FROM lineitem ORDER BY l_partkey, l_quantity, l_returnflag")
def sort_external(c):
    return sort(scan(c["lineitem"].read(), ["l_orderkey", "l_partkey", "l_quantity", "l_returnflag"]), ["l_partkey", "l_quantity", "l_returnflag"])


@query(
    "SELECT n.n_nationkey AS n_nationkey, n.n_name AS n_name, CAST(SUM(CAST(l.l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_extendedprice FROM lineitem l, orders o, customer c, nation n, region r "
    "WHERE n.n_regionkey = r.r_regionkey AND c.c_nationkey = n.n_nationkey AND o.o_custkey = c.c_custkey AND l.l_orderkey = o.o_orderkey AND r.r_name = 'EUROPE' "
    "GROUP BY n.n_nationkey, n.n_name HAVING sum_extendedprice > 1000 ORDER BY n_nationkey ASC, n_name DESC, sum_extendedprice ASC"
)
def order_by_aggregate(c):
    rows = equi_join(filter_rows(c["region"].read(), compare("r_name", "=", "EUROPE")), c["nation"].read(), ["r_regionkey"], ["n_regionkey"])
    rows = equi_join(rows, c["customer"].read(), ["n_nationkey"], ["c_nationkey"])
    rows = equi_join(rows, c["orders"].read(), ["c_custkey"], ["o_custkey"])
    rows = equi_join(rows, c["lineitem"].read(), ["o_orderkey"], ["l_orderkey"])
    sums = rows.groupBy("n_nationkey", "n_name").agg(money_sum("l_extendedprice").alias("sum_extendedprice"))
    return sort(having(sums, compare("sum_extendedprice", ">", 1000)), ["n_nationkey", ("n_name", False), "sum_extendedprice"])


@query("SELECT p_partkey, p_size * 2 + 1 AS a, (p_size - 3) * 4 AS b, p_retailprice / 4 AS c FROM part")
def arith_expr(c):
    size = F.col("p_size")
    return project(c["part"].read(), ["p_partkey", (size * 2 + 1).alias("a"), ((size - 3) * 4).alias("b"), (F.col("p_retailprice") / 4).alias("c")])


@query("SELECT p_partkey FROM part WHERE p_size > 2 * 5 + 3")
def const_fold(c):
    return scan(c["part"].read(), ["p_partkey"], [compare("p_size", ">", F.lit(2) * F.lit(5) + F.lit(3))])


@query(
    PARTSUPP + "SELECT r.r_name AS r_name, p.p_brand AS p_brand, s.s_name AS s_name, p.p_retailprice AS p_retailprice FROM supplier s, nation n, region r, partsupp ps, part p, "
    "(SELECT MIN(p2.p_retailprice) AS min_retail, r2.r_name AS r_name, p2.p_brand AS p_brand FROM supplier s2, nation n2, region r2, partsupp ps2, part p2 WHERE r2.r_regionkey = n2.n_regionkey "
    "AND n2.n_nationkey = s2.s_nationkey AND s2.s_suppkey = ps2.ps_suppkey AND ps2.ps_partkey = p2.p_partkey GROUP BY r2.r_name, p2.p_brand) pc "
    "WHERE r.r_regionkey = n.n_regionkey AND n.n_nationkey = s.s_nationkey AND s.s_suppkey = ps.ps_suppkey AND ps.ps_partkey = p.p_partkey "
    "AND pc.min_retail = p.p_retailprice AND pc.p_brand = p.p_brand AND pc.r_name = r.r_name"
)
def derived_table_join(c):
    rows = scan(_supply(c), ["r_name", "p_brand", "s_name", "p_retailprice"])
    least = group_by(_supply(c), [("r_name", "d_name"), ("p_brand", "d_brand")], {"min_retail": ("min", "p_retailprice")})
    return equi_join(rows, least, ["r_name", "p_brand", "p_retailprice"], ["d_name", "d_brand", "min_retail"], ["r_name", "p_brand", "s_name", "p_retailprice"])


def _copy(c: Catalog, name: str, columns: list[str]):
    """A private table with snapshots, since the sources are read-only."""
    return Catalog(c.spark).create(name, c[name].read().select(*columns))


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT r_regionkey + 100, r_name FROM region")
def insert_select(c):
    t = _copy(c, "nation", ["n_nationkey", "n_name"])
    dml.insert(t, project(c["region"].read(), [(F.col("r_regionkey") + 100).alias("k"), "r_name"]))
    return t.read()


@query("SELECT COUNT(*) AS affected FROM region")
def insert_count(c):
    return dml.insert(_copy(c, "nation", ["n_nationkey", "n_name"]), c["region"].read().select("r_regionkey", "r_name"))


@query("SELECT c_custkey, c_name FROM customer WHERE NOT (c_acctbal < 0)")
def delete_where(c):
    t = _copy(c, "customer", ["c_custkey", "c_name", "c_acctbal"])
    dml.delete(t, compare("c_acctbal", "<", 0).column())
    return t.read().select("c_custkey", "c_name")


@query("SELECT COUNT(*) AS affected FROM customer WHERE c_acctbal < 0")
def delete_count(c):
    t = _copy(c, "customer", ["c_custkey", "c_acctbal"])
    return dml.delete_rids(t, t.with_rid().where(compare("c_acctbal", "<", 0).column()).select("rid"))


@query("SELECT s_suppkey, CASE WHEN s_nationkey = 3 THEN 99 ELSE s_nationkey END AS s_nationkey FROM supplier")
def update_set_where(c):
    t = _copy(c, "supplier", ["s_suppkey", "s_nationkey"])
    dml.update(t, {"s_nationkey": 99}, all_of([compare("s_nationkey", "=", 3)]))
    return t.read()


@query("SELECT * FROM lineitem")
def identity_copy(c):
    return bulk.Identity(bulk.TableInput(c["lineitem"].read())).frame()


@query("SELECT l_orderkey, l_linenumber FROM lineitem")
def forward_left(c):
    left, right = c["lineitem"].read().select("l_orderkey", "l_linenumber"), c["orders"].read().select("o_orderkey")
    return bulk.ForwardLeft(bulk.TableInput(left), bulk.TableInput(right)).frame()


@query("SELECT * FROM lineitem WHERE l_orderkey > 200")
def bulk_selection(c):
    return bulk.Selection(bulk.TableInput(c["lineitem"].read()), compare("l_orderkey", ">", 200)).frame()


@query("SELECT 'nation' AS source_table, n_name AS name FROM nation UNION ALL SELECT 'region', r_name FROM region")
def tagged_input(c):
    names = {"nation": c["nation"].read().select(F.col("n_name").alias("name")), "region": c["region"].read().select(F.col("r_name").alias("name"))}
    return tagged_union(names).select("source_table", "name")


@query("SELECT c_custkey, o_orderkey FROM customer, orders WHERE c_custkey = o_custkey")
def index_correlated_lookup(c):
    index = c.index("orders", "o_custkey")
    return index.fetch(index.correlated(scan(c["customer"].read(), ["c_custkey"]), "c_custkey"), ["o_orderkey"])


@query(
    "SELECT o.o_orderpriority AS prio, COUNT(*) AS n, CAST(SUM(CAST(l.l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS qty FROM orders o, lineitem l "
    "WHERE o.o_orderkey = l.l_orderkey AND l.l_quantity >= 4 AND l.l_orderkey > 10 GROUP BY o.o_orderpriority HAVING n > 3 ORDER BY prio DESC"
)
def dialect_select(c):
    from .dialect import Engine

    out = Engine(c.spark, c).sql('SELECT o.o_orderpriority AS prio, COUNT(*) AS n, SUM(l.l_quantity) AS qty FROM orders o, lineitem l WHERE o.o_orderkey = l.l_orderkey AND l.l_quantity >= 8 / 2 AND l.l_orderkey > 10 AND o.o_orderpriority <> "none" GROUP BY o.o_orderpriority HAVING n > 3 ORDER BY prio DESC')
    return out.withColumn("qty", F.round("qty", 2))


@query(
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%Y-%-m-%-d %-H:%M:%S.%g') AS moment, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS parsed, "
    "rpad(o_orderpriority, 20, ' ') AS fixed, trim('  ' || o_orderstatus || ' ') AS trimmed, CAST(CAST(o_custkey AS VARCHAR) AS INT) AS cust, CAST(CAST(o_totalprice AS VARCHAR) AS DOUBLE) AS price FROM orders"
)
def text_codecs(c):
    """Values as text and back."""
    day, price = types.to_text(F.col("o_orderdate"), "DATE"), types.to_text(F.col("o_totalprice"), "DOUBLE")
    return c["orders"].read().select(
        "o_orderkey", day.alias("day"), types.to_text(F.col("o_orderdate"), "TIMESTAMP").alias("moment"), F.unix_date(types.from_text(day, "DATE")).cast("long").alias("parsed"), types.char(F.col("o_orderpriority"), 20).alias("fixed"),
        types.varchar(F.concat(F.lit("  "), "o_orderstatus", F.lit(" ")), 8).alias("trimmed"), types.from_text(types.to_text(F.col("o_custkey"), "INT"), "INT").alias("cust"), types.from_text(price, "DOUBLE").alias("price"),
    )


@query(
    "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) - 1 AS m, day(o_orderdate) AS d, CAST(o_orderkey % 24 AS INT) AS hour, CAST(o_orderkey % 60 AS INT) AS minute, CAST(o_custkey % 60 AS INT) AS second, "
    "CAST((o_custkey % 12) * 3600000 AS INT) AS offset_ms, (o_orderkey % 24) * 3600000 + (o_orderkey % 60) * 60000 + (o_custkey % 60) * 1000 - (o_custkey % 12) * 3600000 AS instant FROM orders"
)
def time_accessors(c):
    """Parts of dates and of times with offsets, the latter from text."""
    order, cust = F.col("o_orderkey"), F.col("o_custkey")
    time = types.from_text(F.format_string("%d:%02d:%02d (UTC +%d)", order % 24, order % 60, cust % 60, cust % 12), "TIME")
    rows = c["orders"].read().select("o_orderkey", "o_orderdate", time.alias("t"))
    date, t = F.col("o_orderdate"), F.col("t")
    parts = [types.date_part(date, part).alias(part[0]) for part in ("year", "month", "day")]
    parts += [types.time_part(t, part).alias(part) for part in ("hour", "minute", "second")]
    return rows.select("o_orderkey", *parts, types.time_part(t, "offset").alias("offset_ms"), types.time_instant(t).alias("instant"))


@query("SELECT l_suppkey, COUNT(*) AS n, CAST(SUM(l_linenumber) AS BIGINT) AS lines FROM lineitem GROUP BY l_suppkey")
def bulk_map_reduce(c):
    """Own map, combine and reduce functions over batches."""

    def mapped(tables):
        for t in tables:
            yield pa.table({"l_suppkey": t["l_suppkey"], "n": pa.repeat(1, len(t)), "lines": t["l_linenumber"].cast("int64")})

    def added(rows):
        return rows.group_by("l_suppkey", use_threads=False).aggregate([("n", "sum"), ("lines", "sum")]).rename_columns(["l_suppkey", "n", "lines"])

    table = bulk.TableInput(c["lineitem"].read().select("l_suppkey", "l_linenumber"))
    schema = "l_suppkey long, n long, lines long"
    return bulk.ArrowMapReduce(table, mapped, schema, ["l_suppkey"], added, schema, added).frame()


@query(
    " UNION ALL ".join(
        f"SELECT '{name}' AS op, (SELECT COUNT(*) FROM part WHERE p_size {inverse} 10) AS inverse, (SELECT COUNT(*) FROM part WHERE 10 {mirror} p_size) AS mirror"
        for name, inverse, mirror in [("eq", "<>", "="), ("ne", "=", "<>"), ("lt", ">=", ">"), ("le", ">", ">="), ("gt", "<=", "<"), ("ge", "<", "<=")]
    )
)
def predicate_algebra(c):
    """Each comparison negated, and with its sides exchanged."""
    ops = {"eq": "=", "ne": "<>", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}
    part, out = c["part"].read(), None
    for name, op in ops.items():
        p = compare("p_size", op, 10)
        row = part.agg(F.count(F.when(p.inverted().column(), 1)).alias("inverse"), F.count(F.when(p.mirrored().column(), 1)).alias("mirror")).select(F.lit(name).alias("op"), "inverse", "mirror")
        out = row if out is None else out.unionByName(row)
    return out


__all__ = ["catalog", "oracle_sql", "partsupp", "queries"]
