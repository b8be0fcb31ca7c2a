"""Relational operators on nulls, duplicates, large keys and empty tables, and the shape of their plans."""

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.expressions import arithmetic, both, compare, constant, either, is_true, truthy
from millrace.operators import aggregates, joins, ordering, scans, setops, stats, transforms, verify
from millrace.plans.engine import explain
from tests.conftest import rows

KV = "k int, v int, s string"


@pytest.fixture(scope="module")
def nulls(spark):
    return spark.createDataFrame([(1, 1, "a"), (1, None, "a"), (None, 2, None), (None, 2, None), (2, None, ""), (3, 5, "a|b#")], KV)


def test_comparisons_have_two_values_when_projected(nulls):
    found = nulls.select(is_true(compare(F.col("v"), "=", 2)).alias("x"), both(F.col("v") > 1, F.col("k") > 0).alias("b"), either(F.col("v") > 1, F.col("k") > 0).alias("e"))
    assert [tuple(r) for r in found.collect()] == [(False, False, True), (False, False, True), (True, False, True), (True, False, True), (False, False, True), (False, True, True)]
    with pytest.raises(ValueError):
        compare(F.col("v"), "<>", 1)


def test_large_keys_compare_exactly(spark):
    df = spark.createDataFrame([(2**53,), (2**53 + 1,)], "id long")
    assert rows(scans.lookup(df, "id", 2**53 + 1)) == [(2**53 + 1,)]
    assert df.select(constant(2**31).alias("x")).schema["x"].dataType == T.LongType()


def test_arithmetic(spark):
    df = spark.createDataFrame([(7, 2), (None, 2)], "a int, b int")
    found = df.select(*(arithmetic(F.col("a"), op, F.col("b")).alias(n) for n, op in (("p", "+"), ("m", "-"), ("t", "*"), ("d", "/"))))
    assert rows(found) == [(None,) * 4, (9, 5, 14, 3.5)]
    assert [f.dataType for f in found.schema] == [T.LongType()] * 3 + [T.DoubleType()]
    with pytest.raises(Exception, match="division by zero"):
        df.select(arithmetic(F.col("a"), "/", F.lit(0))).collect()
    with pytest.raises(Exception, match="(?i)overflow"):
        df.select(arithmetic(F.lit(2**62), "*", F.col("a"))).collect()


def test_truth_of_values(nulls):
    assert nulls.where(truthy(F.col("s"), T.StringType())).count() == 3
    assert transforms.keep(nulls, F.col("v")).count() == 4
    assert transforms.keep(nulls, F.col("v") * 0.0).count() == 0


def test_lookups(nulls):
    assert scans.lookup(nulls, "k", 1).count() == 2 and scans.lookup(nulls, "k", None).count() == 0
    assert scans.range_lookup(nulls, "v", 2, 5, True, False).count() == 2 and scans.range_lookup(nulls, "k").count() == 4
    assert scans.prefix_lookup(nulls, {"k": 3}, "v", low=5).count() == 1 and scans.prefix_lookup(nulls, {"k": 3}, "v", low=5, low_inclusive=False).count() == 0
    assert scans.rows_where_any(nulls, F.col("k") == 1, F.col("v") == 1).count() == 2
    assert scans.fetch(nulls, scans.key_list(nulls, "k", F.col("s") == "a"), "k").count() == 2


def test_null_keys_join_nothing(spark, nulls):
    other = spark.createDataFrame([(1, "x"), (None, "y"), (3, "z"), (3, "z")], "k2 long, t string")
    for strategy in (None, "hash", "merge", "broadcast"):
        assert rows(joins.equi_join(nulls, other, F.col("k") == F.col("k2"), strategy).select("k", "t")) == [(1, "x"), (1, "x"), (3, "z"), (3, "z")]
    assert joins.many_to_one_join(nulls, other, "k", "k2").count() == 4
    assert joins.lookup_join(other, nulls, "k2", "k").count() == 4


def test_join_strategies_reach_the_plan(spark):
    a, b = spark.range(1000).withColumnRenamed("id", "a"), spark.range(1000).withColumnRenamed("id", "b")
    for strategy, node in (("hash", "ShuffledHashJoin"), ("merge", "SortMergeJoin"), ("broadcast", "BroadcastHashJoin")):
        assert node in "\n".join(r.plan for r in explain(joins.equi_join(a, b, F.col("a") == F.col("b"), strategy)).collect())
    large = spark.range(10**9).withColumnRenamed("id", "b")
    assert "Broadcast" not in "\n".join(r.plan for r in explain(joins.equi_join(large.withColumnRenamed("b", "a"), large, F.col("a") == F.col("b"), "broadcast")).collect())


def test_pushdown_pruning_and_top_k(spark, tmp_path):
    scans.cluster_by(spark.range(1000).select(F.col("id").alias("a"), (F.col("id") * 2).alias("b"), F.lit("x").alias("c")), ["a"]).write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    plan = lambda df: "\n".join(r.plan for r in explain(df).collect())
    text = plan(scans.covering(t, ["a"], F.col("a") == 7))
    assert "EqualTo(a,7)" in text and "ReadSchema: struct<a:bigint>" in text
    assert "Or(EqualTo(a,1),EqualTo(b,4))" in plan(scans.rows_where_any(t, F.col("a") == 1, F.col("b") == 4))
    assert "TakeOrderedAndProject" in plan(ordering.top_n(t, [("b", False)], 3))


def test_aggregates(nulls, spark):
    spec = {"n": ("count", "*"), "nv": ("count", "v"), "t": ("sum", "v"), "low": ("min", "s"), "high": ("max", "s")}
    assert rows(aggregates.aggregate(nulls, ["k"], spec)) == [(None, 2, 2, 4, None, None), (1, 2, 1, 1, "a", "a"), (2, 1, 0, None, "", ""), (3, 1, 1, 5, "a|b#", "a|b#")]
    assert rows(aggregates.aggregate(nulls.limit(0), [], spec)) == [(0, 0, None, None, None)] and rows(aggregates.aggregate(nulls.limit(0), ["k"], spec)) == []
    for bad in ({"x": ("sum", "s")}, {"x": ("sum", "*")}):
        with pytest.raises((TypeError, ValueError)):
            aggregates.aggregate(nulls, [], bad)
    pipes = spark.createDataFrame([("a|", "b"), ("a", "|b"), ("a", "|b")], "x string, y string")
    assert aggregates.aggregate(pipes, ["x", "y"], {"n": ("count", "*")}).count() == 2
    close = spark.createDataFrame([(1.0000001,), (1.0000002,)], "d double")
    assert aggregates.distinct(close).count() == 2
    grp = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "a int, b int")
    assert aggregates.groups(grp, ["a", "b"], ["a"]).count() == 3 and aggregates.groups(grp, ["a", "b"], ["a"], True).count() == 2


def test_order_of_nulls_and_limits(nulls):
    assert [r.v for r in ordering.sort(nulls, [("v", True)]).collect()] == [None, None, 1, 2, 2, 5]
    assert [r.v for r in ordering.top_n(nulls, [("v", False)], 4).collect()] == [5, 2, 2, 1]
    assert ordering.limit(nulls, 0).count() == 0 and ordering.top_n(nulls, [("v", True)], 99).count() == 6


def test_set_operations_check_their_sides(spark, nulls):
    with pytest.raises(TypeError):
        setops.combine(nulls.select("k"), "UNION ALL", nulls.select("s"))
    with pytest.raises(TypeError):
        setops.combine(nulls.select("k"), "UNION", nulls.select(F.col("k").cast("long")))
    with pytest.raises(ValueError):
        setops.combine(nulls, "MINUS", nulls)
    a = spark.createDataFrame([(1,), (2,)], "x int")
    c = spark.createDataFrame([(1,), (3,)], "y int")
    assert rows(setops.compound(a, [("UNION ALL", c), ("INTERSECT", c)])) == [(1,), (3,)]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 3)), st.sampled_from([None, "a", "b"])), max_size=8), st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 3)), st.sampled_from([None, "a", "b"])), max_size=8))
def test_set_operations_as_duckdb(spark, left, right):
    import pyarrow as pa

    schema = pa.schema([("x", pa.int32()), ("y", pa.string())])
    db = duckdb.connect()
    for name, data in (("l", left), ("r", right)):
        db.register(name, pa.Table.from_pylist([{"x": x, "y": y} for x, y in data], schema=schema))
    a, b = spark.createDataFrame(left, "x int, y string"), spark.createDataFrame(right, "x int, y string")
    key = lambda r: [(v is not None, v) for v in r]
    for op in ("UNION ALL", "UNION", "INTERSECT", "INTERSECT ALL", "EXCEPT", "EXCEPT ALL"):
        want = db.execute(f"SELECT * FROM l {op} SELECT * FROM r").fetchall()
        assert sorted(map(tuple, setops.combine(a, op, b).collect()), key=key) == sorted(want, key=key)


def test_statistics(spark, nulls):
    found = {r["column"]: tuple(r)[1:] for r in stats.columns(nulls).collect()}
    assert found["k"] == (6, 3, 2 / 6, 1.0, 3.0) and found["s"] == (6, 3, 2 / 6, None, None)
    assert [tuple(r) for r in stats.most_common(nulls, "s", 2).orderBy(F.desc("frequency")).collect()] == [("a", 2 / 6), ("", 1 / 6)]
    assert [r.upper_bound for r in stats.histogram(spark.range(1, 101).toDF("x"), "x").orderBy("bucket").collect()] == [10.0 * i for i in range(1, 11)]
    joint, common = stats.pairs(nulls, ["k", "v"])
    assert joint.first().distinct_pairs == 2 and common.count() == 2
    assert stats.columns(nulls.limit(0)).count() == 0 and stats.analyze(nulls, ["k", "s"]).count() == 2


def test_checks(nulls, spark):
    assert verify.multiset_equal(nulls, nulls.orderBy(F.desc("k"))) and not verify.multiset_equal(nulls, nulls.distinct())
    assert rows(verify.duplicate_keys(nulls, ["k"])) == [(1, 2)]
    assert tuple(verify.violations(nulls, ["k"], {"s": 2}).first()) == (2, 1)


def test_clashing_names(nulls):
    joined = transforms.all_columns_of(nulls, nulls, nulls.alias("a").join(nulls.alias("b"), F.col("a.k") == F.col("b.k")))
    assert joined.columns == ["k", "v", "s", "k_2", "v_2", "s_2"]
