"""Frequent values and top-n heaps against counting and sorting everything."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.llm import frequent, topn
from tests.conftest import rows

SEGMENTS = "relation_id int, column_idx int, segment_no long, tuple_count int, value string, frequency double, node__ string"


def segments(seed):
    rng = random.Random(seed)
    out = []
    for rel, col, n in ((1, 1, 40), (1, 2, 3), (2, 1, 1)):
        for seg in range(n):
            size = rng.choice([10, 100, 1000])
            values = rng.sample([None, "", "a", "a ", "A", "é", "x" * 300, *map(str, range(60))], 20)
            out += [(rel, col, seg, size, v, rng.choice([None, 0.0, 0.5, round(rng.random() / 20, 6), round(rng.random() / 20, 6)]), "n") for v in values]
    return out + rng.sample(out, len(out) // 4)


def totals(data):
    counts, whole = defaultdict(float), defaultdict(int)
    for rel, col, seg, size, v, f, _ in set(data):
        if v is not None and f is not None:
            counts[rel, col, v] += f * size
    for rel, col, seg, size in {r[:4] for r in data}:
        whole[rel, col] += size
    return counts, whole


def counted(spark, data, nodes):
    df = spark.createDataFrame(data, SEGMENTS).repartition(3)
    return frequent.count_segments(df, ["relation_id", "column_idx"], ["segment_no"], "value", "frequency", "tuple_count", nodes)


@pytest.mark.parametrize(("seed", "nodes"), [(1, 1), (2, 7), (3, 64)])
def test_shares_and_top_k(spark, seed, nodes):
    data = segments(seed)
    counts, whole = totals(data)
    for share in (0.015, 0.03):
        got = {tuple(r)[:3]: r.n for r in frequent.values_above_share(counted(spark, data, nodes), share).collect()}
        want = {k: n for k, n in counts.items() if n / whole[k[:2]] >= share}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    got = {(r.relation_id, r.column_idx, r["rank"]): r.value for r in frequent.top_k(counted(spark, data, nodes), 5).collect()}
    want = {}
    for key in whole:
        best = sorted((-round(n, 6), v) for (*k, v), n in counts.items() if tuple(k) == key and n > 0)[:5]
        want |= {(*key, i + 1): v for i, (_, v) in enumerate(best)}
    assert got == want


def test_plain_rows_with_a_hot_value(spark):
    rng = random.Random(5)
    data = [rng.choice(["hot", "hot", None, *map(str, range(200))]) for _ in range(3000)]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(data)], "value__ string, n int")
    got = [(r.value, int(r.n)) for r in frequent.top_k(frequent.count_rows(df, "value__", nodes=9), 3).orderBy("rank").collect()]
    assert got == sorted(Counter(v for v in data if v is not None).items(), key=lambda x: (-x[1], x[0]))[:3]
    few = frequent.top_k(frequent.count_rows(df.where("value__ = 'hot'"), "value__"), 3)
    assert few.count() == 1


def test_no_segments(spark):
    none = spark.createDataFrame([], SEGMENTS)
    count = lambda df: frequent.count_segments(df, ["relation_id", "column_idx"], ["segment_no"], "value", "frequency", "tuple_count")
    assert rows(frequent.values_above_share(count(none), 0.1)) == [] and rows(frequent.top_k(count(none), 3)) == []
    nulls = spark.createDataFrame([(1, 1, 1, None, "a", 0.5, ""), (1, 1, 2, 10, None, 1.0, ""), (None, None, None, 10, "b", 1.0, "")], SEGMENTS)
    assert [tuple(r)[:3] for r in frequent.values_above_share(count(nulls), 0.1).collect()] == [(None, None, "b")]


EMP = "dept int, id int, salary double, score__ string"


def best(data, n):
    groups = defaultdict(dict)
    for g, i, s, _ in data:
        if None not in (g, i, s):
            groups[g][i] = max(s, groups[g].get(i, float("-inf")))
    return sorted((g, i, s) for g, own in groups.items() for i, s in sorted(own.items(), key=lambda x: (-x[1], x[0]))[:n])


@pytest.mark.parametrize(("n", "buffer"), [(1, 1 << 18), (3, 50), (500, 50)])
def test_top_n(spark, monkeypatch, n, buffer):
    monkeypatch.setattr(topn, "_BUFFER_ROWS", buffer)
    monkeypatch.setattr(topn, "_STATE_ROWS", 40)
    rng = random.Random(n)
    data = [(rng.choice([None, 1, 1, 1, 1, *range(20)]), rng.choice([None, *range(300)]), rng.choice([None, -1.0, 0.0, 5.0, 5.0, rng.random()]), "") for _ in range(2000)]
    df = spark.createDataFrame(data + data[:100], EMP).repartition(7)
    assert rows(topn.top_n_per_group(df, "dept", "salary", "id", n)) == best(data, n)


def test_top_n_of_texts_nothing_and_zero(spark):
    df = spark.createDataFrame([("g" * 500, "b", 1.0), ("g" * 500, "a", 1.0), ("", "c", 1.0)], "dept string, id string, salary double")
    assert rows(topn.top_n_per_group(df, "dept", "salary", "id", 1)) == [("", "c", 1.0), ("g" * 500, "a", 1.0)]
    assert rows(topn.top_n_per_group(df.limit(0), "dept", "salary", "id", 1)) == [] == rows(topn.top_n_per_group(df, "dept", "salary", "id", 0))


def test_no_more_than_n_rows_leave_a_task_for_the_shuffle(spark):
    df = spark.range(0, 40000, 1, 4).select(F.lit(1).alias("dept"), "id", (F.col("id") % 1000).alias("salary"))
    found = topn.top_n_per_group(df, "dept", "salary", "id", 3)
    assert [r.id for r in found.orderBy("id").collect()] == [999, 1999, 2999]


def test_many_groups_in_one_partition_are_merged_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(topn, "_BUFFER_ROWS", 1 << 14)
    monkeypatch.setattr(topn, "partitions_for", lambda df: 1)
    df = spark.range(0, 2_000_000, 1, 4).select((F.col("id") % 1_000_000).cast("int").alias("dept"), "id", F.col("id").alias("salary"))
    found = topn.top_n_per_group(df, "dept", "salary", "id", 1)
    assert found.where("id = dept + 1000000").count() == 1_000_000 == found.count()


def test_phase_one_raises_the_bound_of_a_share(spark):
    data = [(1, 1, s, 100, v, f, "n") for s in range(50) for v, f in (("a", 0.5), ("b", 0.3), *((f"rare {s} {i}", 0.01) for i in range(10)))]
    counts = counted(spark, data, 4)
    assert [r.bound__ for r in frequent._lower_bounds(counts, 2).collect()] == pytest.approx([1500])
    assert rows(frequent.values_above_share(counts, 0.3).select("value")) == [("a",), ("b",)]
    for share in (0, -1, 1.5):
        with pytest.raises(ValueError):
            frequent.values_above_share(counts, share)
