import io

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from basalt.functions.predicates import compare
from basalt.operators import dml
from basalt.plans import bulk
from basalt.plans.console import print_result, repl
from basalt.plans.dialect import Engine, Literal, ParseError, Select, fold, parse
from basalt.sources import storage
from basalt.sources.catalog import Catalog, DuplicateKey


@pytest.fixture
def catalog(spark):
    c = Catalog(spark)
    c.create("t", spark.createDataFrame([(1, 10, "a"), (2, None, "b"), (3, 30, None), (3, 31, 'q"x')], "id int, v int, name string"))
    return c


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_insert_delete_update(spark, catalog):
    t = catalog["T"]
    before = t.read()
    assert dml.insert(t, spark.createDataFrame([(9, 9, "z")], "x int, y int, z string")).first()["affected"] == 1
    assert t.read().count() == 5 and before.count() == 4
    assert dml.delete(t, compare("v", ">", 20).column()).first()["affected"] == 2  # a null condition keeps the row
    assert values(t.read().select("id")) == [(1,), (2,), (9,)]
    assert dml.update(t, {"v": F.col("v") + 1}, compare("v", "=", 9).column()).first()["affected"] == 1
    assert values(t.read().select("id", "v")) == [(1, 10), (2, None), (9, 10)]
    assert dml.delete(t).first()["affected"] == 3 and t.read().isEmpty()
    with pytest.raises(ValueError, match="columns"):
        dml.insert(t, spark.range(1))
    t.vacuum()
    assert len(t.snapshots()) == 1


def test_statements_touch_only_the_files_they_must(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def seen(x):
        calls.add(1)
        return x

    t = Catalog(spark).create("many", spark.range(100).select("id", (F.col("id") * 2).alias("v")).repartitionByRange(5, "id"))
    first = t.manifest()["files"]
    assert len(first) == 5 and sum(first.values()) == 100
    assert dml.insert(t, spark.range(100, 130, 1, 3).select(seen("id"), "id")).first()["affected"] == 30 and calls.value == 30
    second = t.manifest()["files"]
    assert first.items() <= second.items() and sum(second.values()) == 130
    assert dml.delete(t, F.col("id") == 7).first()["affected"] == 1
    third = t.manifest()["files"]
    assert len(second.keys() - third.keys()) == 1 and len(third.keys() - second.keys()) == 1 and sum(third.values()) == 129
    assert dml.update(t, {"v": 0}, F.col("id") >= 100).first()["affected"] == 30
    fourth = t.manifest()["files"]
    assert all(n in fourth for n in third if n not in second or n in first) and t.read().where("v = 0").count() == 31
    assert dml.delete(t, F.col("id") < 20).first()["affected"] == 19
    versions = t.snapshots()
    assert dml.delete(t, F.col("id") == -1).first()["affected"] == dml.update(t, {"v": 1}, F.col("id") == -1).first()["affected"] == 0
    assert t.snapshots() == versions
    t.vacuum()
    assert len(t.snapshots()) == 1 and t.read().count() == 110 and sorted(r.id for r in t.read().collect()) == [*range(20, 130)]


def test_fetch_reads_only_named_files(spark):
    c = Catalog(spark)
    c.create("many", spark.range(1000).select("id", (F.col("id") * 2).alias("v")).repartitionByRange(5, "id"))
    index = c.index("many", "id")
    got = index.fetch(index.equal(777), ["id", "v"], lambda k: k == 777)
    assert values(got) == [(777, 1554)]
    assert len(files_read(spark, c["many"].read())) == 1 and files_read(spark, c["many"].read()) == [5]
    assert 1 in files_read(spark, got) and 5 not in files_read(spark, got)
    assert index.fetch(index.equal(-5), ["v"]).collect() == []
    assert index.fetch(index.within(lambda k: k < 3), ["v"]).count() == 3


def files_read(spark, df):
    """numFiles of the scans of data files."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    found, todo = [], [plan]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name.endswith("QueryStageExec"):
            todo.append(node.plan())
        if name == "FileSourceScanExec":
            found.append(node.metrics().apply("numFiles").value())
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
    return found


def test_index_follows_the_table(spark, monkeypatch):
    c = Catalog(spark)
    t = c.create("t", spark.range(40).select("id", (F.col("id") % 7).alias("v")).repartitionByRange(4, "id"))
    index = c.index("t", "id")
    dml.insert(t, spark.range(100, 110).select("id", "id"))
    assert c.index("t", "id") is index and len(index.runs) == 2 and index.equal(105).count() == 1
    dml.delete(t, F.col("id") < 3)
    assert c.index("t", "id").rows().count() == 47 and index.equal(2).isEmpty() and values(index.fetch(index.equal(3), ["v"])) == [(3,)]
    monkeypatch.setattr("basalt.sources.catalog.MOST_RUNS", 2)
    dml.insert(t, spark.range(200, 201).select("id", "id"))
    assert c.index("t", "id").rows().count() == 48 and len(index.runs) == 1 and not index.gone


def test_unique_keys_are_refused(spark):
    c = Catalog(spark)
    t = c.create("t", spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "id int, name string"))
    c.index("t", "id", unique=True)
    versions = t.snapshots()
    for rows in ([(2, "x")], [(5, "x"), (5, "y")]):
        with pytest.raises(DuplicateKey, match="twice"):
            dml.insert(t, spark.createDataFrame(rows, "id int, name string"))
    with pytest.raises(DuplicateKey):
        dml.update(t, {"id": 1}, F.col("id") == 2)
    assert t.snapshots() == versions and t.read().count() == 3
    assert dml.insert(t, spark.createDataFrame([(5, "x"), (None, "y")], "id int, name string")).first()["affected"] == 2
    dml.delete(t, F.col("id") == 2)
    assert dml.insert(t, spark.createDataFrame([(2, "again")], "id int, name string")).first()["affected"] == 1
    assert dml.update(t, {"id": F.col("id") + 10}, F.col("id").isNotNull()).first()["affected"] == 3
    with pytest.raises(DuplicateKey):
        Engine(spark, c).sql('INSERT INTO t VALUES (15, "x")')
    c.create("twice", spark.createDataFrame([(1,), (1,)], "id int"))
    with pytest.raises(DuplicateKey, match="duplicate"):
        c.index("twice", "id", unique=True)


def test_shared_folder(spark, tmp_path, monkeypatch):
    class Other:
        """A session of a cluster."""

        def __init__(self, given):
            self.given, outer = given, spark
            self.sparkContext = type("C", (), {"master": "spark://x:7077", "applicationId": "other", "getConf": lambda s: {}})()
            self.conf = type("F", (), {"get": lambda s, k, d=None: d})()
            option = type("O", (), {"isDefined": lambda s: given is not None, "get": lambda s: given})()
            self._jsc = type("J", (), {"sc": lambda s: type("S", (), {"getCheckpointDir": lambda s: option})()})()
            self._jvm = outer._jvm

    with pytest.raises(RuntimeError, match="checkpoint"):
        storage.shared_dir(Other(None))
    assert storage.shared_dir(Other("hdfs://n/x/")) == "hdfs://n/x"
    path = storage.scratch(spark, "test")
    spark.range(3).write.parquet(path)
    monkeypatch.setattr(storage, "_made", {spark.sparkContext.applicationId: [path]})
    storage.sweep(spark)
    assert storage.names_in(spark, path) == []
    storage.write_text(spark, f"file://{tmp_path}/a.json", "é")
    assert storage.read_text(spark, f"file://{tmp_path}/a.json") == "é"
    with pytest.raises(FileExistsError):
        storage.write_text(spark, f"file://{tmp_path}/a.json", "b")


def test_index_fetch_and_refresh(spark, catalog):
    index = catalog.index("t", "id")
    assert values(index.fetch(index.equal(3), ["id", "v"])) == [(3, 30), (3, 31)]
    assert values(index.fetch(index.within(lambda k: (k > 1) & (k <= 2)), ["name"])) == [("b",)]
    assert values(index.keys(lambda k: k >= 2)) == [(2,), (3,), (3,)]
    assert values(index.duplicates()) == [(3, 2)]
    assert catalog.index("t", "v").rows().count() == 3  # nulls have no entry
    with pytest.raises(ValueError, match="duplicate"):
        type(index).build(catalog["t"], "id", unique=True)
    assert dml.delete_rids(catalog["t"], index.equal(3)).first()["affected"] == 2
    assert catalog.index("t", "id").equal(3).isEmpty()


def test_statistics_and_registry(spark, catalog, tmp_path):
    s = catalog["t"].analyze()
    assert s.rows == 4 and s.columns["v"].low == "10" and s.columns["v"].high == "31" and s.columns["v"].nulls == 1
    catalog.save(str(tmp_path / "c.json"))
    assert Catalog.load(spark, str(tmp_path / "c.json"))["t"].read().count() == 4
    with pytest.raises(LookupError):
        catalog["nothing"]


def test_dialect_statements(spark, catalog):
    e = Engine(spark, catalog)
    spark.range(3).createOrReplaceTempView("t")  # the session's own, which the engine leaves alone
    assert values(e.sql('SELECT a.id AS id, COUNT(*) AS n FROM t a WHERE a.v >= 10 GROUP BY a.id HAVING n > 1 ORDER BY id DESC')) == [(3, 2)]
    assert values(e.sql('select name as s from t where name = "q\\"x"')) == [('q"x',)]
    assert values(e.sql("SELECT x.m AS m FROM (SELECT MAX(v) AS m, id AS id FROM t GROUP BY id) x, t b WHERE x.id = b.id AND b.v < 11")) == [(10,)]
    assert [r.v for r in e.sql("SELECT v AS v FROM t ORDER BY v").collect()] == [None, 10, 30, 31]
    assert e.sql('INSERT INTO t VALUES (7, -2, "n"), (8, 4 - 1, "m")').first()["affected"] == 2
    assert e.sql("INSERT INTO t SELECT id + 100 AS id, v AS v, name AS name FROM t WHERE id = 1").first()["affected"] == 1
    assert e.sql("UPDATE t SET v = v * 2 WHERE t.id >= 7 AND v < 4").first()["affected"] == 2
    assert values(e.sql("SELECT id AS id, v AS v FROM t WHERE id > 6")) == [(101, 10), (7, -4), (8, 6)]
    assert e.sql("DELETE FROM t x WHERE x.id > 6").first()["affected"] == 3
    assert e.sql("SELECT * FROM t").count() == 4 and spark.table("t").count() == 3
    spark.catalog.dropTempView("t")
    assert not [x for x in spark.catalog.listTables() if x.name.startswith("basalt_")]


@pytest.mark.parametrize(
    ("sql", "kind"),
    [
        ("SELECT a FROM t WHERE a != 1", "character"), ('SELECT a FROM t WHERE a = "x', "string"), ("SELECT 1x AS a FROM t", "number"), ("SELECT a FROM", "end"),
        ("SELECT DISTINCT a FROM t", "end"), ("SELECT a FROM t WHERE a = 1 OR b = 2", "unexpected"), ("SELECT a FROM t HAVING a > 1", "unexpected"), ("SELECT a FROM t LIMIT 3", "unexpected"),
        ("SELECT a FROM t JOIN u ON a = b", "unexpected"), ("SELECT lower(a) FROM t", "unexpected"), ("SELECT a FROM (SELECT b FROM c)", "end"), ("DROP TABLE t", "unexpected"), ("SELECT a FROM t WHERE a IN (1)", "unexpected"),
    ],
)
def test_dialect_refuses(sql, kind):
    with pytest.raises(ParseError) as e:
        parse(sql)
    assert e.value.kind in (kind, "unexpected")


def test_dialect_lexing_and_folding():
    s = parse("SELECT a - 1 AS x, -1 AS y, a - -2 AS z, (a) - 3 AS w FROM t")
    assert isinstance(s, Select) and [e.sql() for e, _ in s.outputs] == ["(`a` - 1)", "-1", "(`a` - -2)", "(`a` - 3)"]
    assert fold(Literal(7), "/", Literal(2)) == Literal(3) and fold(Literal(-7), "/", Literal(2)) == Literal(-3) and fold(Literal(7), "/", Literal(2.0)) == Literal(3.5)
    assert parse("SELECT 2 * 5 + 3 AS x FROM t").outputs[0][0] == Literal(13)


def test_bulk_tree(spark, catalog):
    t = catalog["t"].read()

    def mapper(parts):
        for p in parts:
            yield pd.DataFrame({"id": p["id"], "n": 1})

    def total(rows):
        return pd.DataFrame({"id": [rows["id"].iloc[0]], "n": [rows["n"].sum()]})

    tree = bulk.MapReduce(bulk.TableInput(t, 3), mapper, "id int, n long", ["id"], total, "id int, n long", total)
    assert values(bulk.run_tree(spark, tree)) == [(1, 1), (2, 1), (3, 2)]
    kept = bulk.ForwardLeft(bulk.Identity(bulk.TableInput(t)), bulk.TableInput(spark.range(3)))
    kept.materialize = True
    assert values(bulk.run_tree(spark, bulk.CountTuples(bulk.Selection(kept, compare("id", ">", 1))))) == [(3,)]
    assert bulk.TableInput({"a": t, "b": t}).frame().where("source_table = 'b'").count() == 4
    with pytest.raises(ValueError, match="no inputs"):
        bulk.TableInput({}).frame()


@pytest.mark.parametrize("combined", [True, False])
def test_arrow_map_reduce_of_keys_that_span_batches(spark, monkeypatch, combined):
    monkeypatch.setattr(bulk, "GATHERED", 4000)
    calls = {name: spark.sparkContext.accumulator(0) for name in ("combine", "reduce")}

    def mapper(tables):
        for t in tables:
            yield pa.table({"s": t["s"], "n": pa.repeat(1, len(t)), "k": t["k"]})

    def total(name, f):
        def run(rows):
            calls[name].add(1)
            return f(rows.group_by(["k", "s"]).aggregate([("n", "sum")]).rename_columns(["k", "s", "n"]))

        return run

    def once(rows):
        return rows.append_column("calls", pa.repeat(1, len(rows)))

    # one key has half of the rows, a tenth has no k, a tenth has NaN
    k = F.when(F.col("id") % 2 == 0, 7.0).when(F.col("id") % 10 == 1, None).when(F.col("id") % 10 == 3, float("nan")).otherwise(F.col("id") % 400 * F.lit(1.0))
    rows = spark.range(0, 20000, 1, 3).select(k.alias("k"), F.when(F.col("id") % 4 > 0, (F.col("id") % 3).cast("string")).alias("s"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        tree = bulk.ArrowMapReduce(bulk.TableInput(rows), mapper, "k double, s string, n long", ["k", "s"], total("reduce", once), "calls int, k double, s string, n long", total("combine", lambda t: t) if combined else None)
        got = [tuple(r) for r in tree.frame().collect()]
        assert not bulk.ArrowMapReduce(bulk.TableInput(rows.limit(0)), mapper, "k double, s string, n long", ["k", "s"], total("reduce", once), "calls int, k double, s string, n long").frame().collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = [(1, *r) for r in rows.groupBy("k", "s").agg(F.count(F.lit(1))).collect()]
    assert len(want) > 300 and sorted(map(repr, got)) == sorted(map(repr, want))
    assert calls["reduce"].value <= 400 + 4 and (calls["combine"].value > 3) == combined


def test_console(spark, catalog):
    out = io.StringIO()
    assert print_result(catalog["t"].read().select("id", "v").orderBy("id", "v"), out) == 4
    assert out.getvalue().splitlines()[0].startswith("id") and out.getvalue().endswith("4 rows returned.\n") and "NULL" in out.getvalue()
    out = io.StringIO()
    repl(Engine(spark, catalog), ["SELECT nothing", "", "SELECT COUNT(*) AS n FROM t;", "exit", "SELECT * FROM t"], out)
    assert out.getvalue().startswith("ParseError") and out.getvalue().count("rows returned") == 1
