import datetime as dt
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from basalt.functions import types
from basalt.functions.predicates import ALWAYS_FALSE, ALWAYS_TRUE, OPS, UNKNOWN, Between, Comparison, Ref, all_of, any_of, by_selectivity, compare, compare_columns, merge_ranges
from basalt.operators.relational import conjunction, group_by, merge_join, scan, sort, tagged_union, theta_join


def test_random_predicates_against_a_model(spark):
    rng = random.Random(7)
    data = [(rng.choice([None, *range(9)]), rng.choice([None, *range(9)]), rng.choice([None, "a", "B", "cé", ""])) for _ in range(400)]
    df = spark.createDataFrame(data, "a int, b int, s string")
    model = dict(OPS)

    def true(p, row):
        x = {"a": row[0], "b": row[1], "s": row[2]}
        left, right = (x[v.name] if isinstance(v, Ref) else v for v in (p.left, p.right))
        return left is not None and right is not None and model[p.op](left, right)

    for _ in range(12):
        ps = [rng.choice([compare("a", rng.choice(list(OPS)), rng.randrange(9)), compare("s", rng.choice(list(OPS)), "b"), compare_columns("a", rng.choice(list(OPS)), "b")]) for _ in range(3)]
        assert df.where(all_of(ps)).count() == sum(all(true(p, r) for p in ps) for r in data)
        assert df.where(any_of(ps)).count() == sum(any(true(p, r) for p in ps) for r in data)
        for p in ps:
            assert df.where(p.inverted().column()).count() == sum(r_ok for r in data if (r_ok := true(p.inverted(), r)))
            assert df.where(p.mirrored().column()).count() == df.where(p.column()).count()


def test_ranges():
    merged = merge_ranges([compare("a", ">", 1), compare("a", "<=", 9), Comparison(3, "<", Ref("a")), compare("b", "=", 1)])
    assert merged == [Between("a", 3, 9, False, True), compare("b", "=", 1)]
    assert Between("a", 5, 4).truth() == ALWAYS_FALSE and Between("a", 5, 5, False).truth() == ALWAYS_FALSE and Between("a", 1, 2).truth() == UNKNOWN
    assert Comparison(1, "<", 2).truth() == ALWAYS_TRUE and Comparison(None, "=", None).truth() == ALWAYS_FALSE
    assert by_selectivity([compare("a", "<", 1), compare("a", "=", 1)], {"a": 100})[0].op == "="
    with pytest.raises(ValueError, match="unknown operator"):
        compare("a", "!=", 1)


def test_conjunctions(spark):
    eq, less, never, always = compare("a", "=", 1), compare("a", "<", 5), Comparison(2, "<", 1), Comparison(1, "<", 2)
    assert conjunction([less, always, F.col("a") > 0, eq], {"a": 100})[:2] == [eq, less] and len(conjunction([less, always, F.col("a") > 0, eq])) == 3
    df = spark.range(10).toDF("a")
    assert scan(df, None, [less, never]).count() == 0 and scan(df, None, [less, always]).count() == 5 and scan(df).count() == 10
    text = scan(df, None, [less, eq], {"a": 100})._jdf.queryExecution().analyzed().toString()
    assert text.index("= cast(1") < text.index("< cast(5") if "cast(1" in text else text.index("= 1") < text.index("< 5")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_text_codecs(spark):
    assert one(spark, types.from_text(F.lit("2020-2-9"), "DATE")) == dt.date(2020, 2, 9)
    assert one(spark, types.to_text(types.from_text(F.lit("2020-2-9 7:05:01.250"), "TIMESTAMP"), "TIMESTAMP")) == "2020-2-9 7:05:01.250"
    t = types.from_text(F.lit("7:05:09 (UTC -3:30)"), "TIME")
    assert one(spark, types.to_text(t, "TIME")) == "7:05:09 (UTC -3:30:00)"
    assert [one(spark, types.time_part(t, p)) for p in ("hour", "minute", "second", "offset")] == [7, 5, 9, -12600000]
    same = types.time_instant(types.from_text(F.lit("10:00:00 (UTC +2)"), "TIME")) == types.time_instant(types.from_text(F.lit("9:00:00 (UTC +1)"), "TIME"))
    assert one(spark, same)
    assert one(spark, types.char(F.lit("ab"), 4)) == "ab  " and one(spark, types.varchar(F.lit("  ab "), 4)) == "ab"
    assert one(spark, types.char_equals(types.char(F.lit("ab"), 4), F.lit("ab")))
    assert [one(spark, types.date_part(F.lit(dt.date(2020, 2, 9)), p)) for p in ("year", "month", "day")] == [2020, 1, 9]
    assert one(spark, types.from_text(F.lit(None).cast("string"), "TIME")) is None
    for kind, text in (("TIME", "25:00:00"), ("TIME", "x"), ("DATE", "2020-13-01"), ("INT", "x"), ("CHAR", "a" * 1025)):
        with pytest.raises(PySparkException):
            one(spark, types.from_text(F.lit(text), kind))


def test_null_sentinels(spark):
    df = spark.createDataFrame([(-(1 << 31), float("nan"), 1), (5, 1.5, 2)], "i int, d double, k int")
    assert [tuple(r) for r in types.null_sentinels(df, {"i": "INT", "d": "DOUBLE"}).orderBy("k").collect()] == [(None, None, 1), (5, 1.5, 2)]
    assert types.field("a", "INT", unique=True).metadata == {"unique": True, "type": "INT"}


def test_nulls_duplicates_and_empty(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (2, "d")], "k int, v string")
    right = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z")], "j int, w string")
    assert merge_join(left, right, ["k"], ["j"], ["v", "w"]).count() == 4
    assert theta_join(left, right, compare_columns("k", "<>", "j")).count() == 2
    assert theta_join(left, right).count() == 12
    empty = left.where("false")
    assert group_by(empty, ["k"], {"n": ("count", "*")}).count() == 0
    assert [tuple(r) for r in group_by(empty, [], {"n": ("count", "*"), "s": ("sum", "k"), "m": ("min", "v")}).collect()] == [(0, None, None)]
    assert [r.k for r in sort(left, ["k", "v"]).collect()] == [None, 1, 1, 2]
    assert [r.k for r in sort(left, [("k", False), "v"]).collect()] == [2, 1, 1, None]
    assert scan(left, ["v", ("k", "a"), ("k", "b")], [compare("k", ">=", 1)]).columns == ["v", "a", "b"]
    assert tagged_union({"l": left, "r": right}).columns == ["k", "v", "source_table", "j", "w"]
