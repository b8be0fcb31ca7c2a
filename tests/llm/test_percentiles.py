"""Distributed percentiles and misfitting histogram bounds against numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import ordered
from millrace.llm import percentiles as P
from tests.conftest import rows

SCHEMA = "id int, dept int, salary int, day int, weight string"
FS = (0.0, 0.1, 0.5, 0.77, 1.0)


def people(seed, n=600):
    rng = random.Random(seed)
    out = [(i, rng.choice([None, 1, 1, 1, 1, 1, 2, 3, 4]), rng.choice([None, *range(-20, 40), 7, 7, 7, 7]), i % 7, "w") for i in range(n)]
    out += rng.sample(out, n // 6) + [out[5]] * 100
    rng.shuffle(out)
    return out


def by_group(data):
    out = {}
    for _, dept, salary in {(i, d, s) for i, d, s, _, _ in data}:
        if salary is not None:
            out.setdefault(dept, []).append(salary)
    return out


@pytest.mark.parametrize(("seed", "chunk"), [(1, 1 << 20), (2, 5), (3, 50)])
def test_percentiles_are_exact(spark, monkeypatch, seed, chunk):
    monkeypatch.setattr(ordered, "CHUNK_ROWS", chunk)
    data = people(seed)
    df = spark.createDataFrame(data, SCHEMA).repartition(6)
    found = P.percentiles(P.known_values(df, ["dept"], "salary", key="id"), ["dept"], "salary", FS)
    want = {(g, len(v), f): np.percentile(v, 100 * f) for g, v in by_group(data).items() for f in FS}
    got = {(r.dept, r.n, r.fraction): r.percentile for r in found.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_pieces_put_together_later_lose_nothing(spark):
    data = people(3)
    df = spark.createDataFrame(data, SCHEMA)
    rows_of = P.known_values(df, ["day", "dept"], "salary", key="id")
    pieces = P.piece(rows_of, ["day"], ["dept"], "salary")
    again = P.percentiles(pieces.where("day < 3").unionByName(pieces.where("day >= 3")).select("dept", "salary", "weight"), ["dept"], "salary", FS)
    whole = P.percentiles(P.known_values(df, ["dept"], "salary", key="id"), ["dept"], "salary", FS)
    assert rows(again) == rows(whole)


@pytest.mark.parametrize("error", [0.25, 0.05, 0.01])
def test_condensed_pieces_keep_the_stated_error(spark, error):
    rng = random.Random(7)
    data = [(i, rng.choice([1, 1, 1, 2]), int(rng.lognormvariate(8, 2)), rng.choice([0, 0, 0, 1, 2]), "") for i in range(3000)]
    df = spark.createDataFrame(data, SCHEMA)
    pieces = P.piece(P.known_values(df, ["day", "dept"], "salary", key="id"), ["day"], ["dept"], "salary", error).cache()
    assert max(r["count"] for r in pieces.groupBy("day", "dept").count().collect()) <= np.ceil(1 / (2 * error))
    assert {r.dept: r.n for r in pieces.groupBy("dept").agg(F.sum("weight").alias("n")).collect()} == {g: len(v) for g, v in by_group(data).items()}
    for r in P.percentiles(pieces.select("dept", "salary", "weight"), ["dept"], "salary", (0.1, 0.5, 0.9)).collect():
        values = np.sort(by_group(data)[r.dept])
        low, high = np.searchsorted(values, r.percentile, "left") / len(values), np.searchsorted(values, r.percentile, "right") / len(values)
        # two neighbouring representatives may be interpolated
        assert low - 2 * error - 1e-3 <= r.fraction <= high + 2 * error + 1e-3


@pytest.mark.parametrize("chunk", [1 << 20, 7])
def test_misfits(spark, monkeypatch, chunk):
    monkeypatch.setattr(ordered, "CHUNK_ROWS", chunk)
    data = people(4)
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    buckets = [(d, b, x, f, "x") for d in (None, 1, 2, 3, 9) for b, (x, f) in enumerate([(7.0, 0.5), (7.0, 0.5), (-100.0, 0.0), (-100.0, 0.2), (1000.0, 1.0), (1000.0, 0.9), (None, 0.5), (6.5, None)])]
    hist = spark.createDataFrame(buckets + buckets[:4], "dept int, bucket_no int, upper_bound double, cumulative_fraction double, salary string")
    got = rows(P.misfits(P.known_values(df, ["dept"], "salary", key="id"), ["dept"], "salary", hist, "bucket_no", "upper_bound", "cumulative_fraction", 0.05))
    want = set()
    for d, b, x, f, _ in buckets:
        v = by_group(data).get(d)
        if v and x is not None and f is not None:
            below, upto = sum(s < x for s in v) / len(v), sum(s <= x for s in v) / len(v)
            if f < below - 0.05 or f > upto + 0.05:
                want.add((d, b))
    assert set(got) == want and len(got) == len(want)


def test_nothing_and_one_value(spark):
    df = spark.createDataFrame([(1, 1, None, 1, ""), (2, 1, None, 1, "")], SCHEMA)
    assert rows(P.percentiles(P.known_values(df, ["dept"], "salary", key="id"), ["dept"], "salary", FS)) == []
    assert rows(P.percentiles(P.known_values(df.limit(0), ["dept"], "salary"), ["dept"], "salary", FS)) == []
    one = spark.createDataFrame([(1, None, 5, 1, "")], SCHEMA)
    assert rows(P.percentiles(P.known_values(one, ["dept"], "salary"), ["dept"], "salary", (0.5,))) == [(None, 1, 0.5, 5.0)]
    assert rows(P.percentiles(P.known_values(one.withColumn("dept", F.lit("é" * 1000)), ["dept"], "salary"), ["dept"], "salary", (1.0,)))[0][3] == 5.0
    with pytest.raises(ValueError):
        P.percentiles(P.known_values(one, ["dept"], "salary"), ["dept"], "salary", (1.5,))


def test_one_value_over_all_partitions(spark):
    df = spark.range(4000).select(F.col("id").cast("int").alias("id"), F.lit(1).alias("dept"), F.lit(7).alias("salary"))
    found = P.percentiles(P.known_values(df, ["dept"], "salary", key="id"), ["dept"], "salary", (0.0, 0.5, 1.0))
    assert [(r.n, r.percentile) for r in found.collect()] == [(4000, 7.0)] * 3


def test_a_value_most_rows_have_is_one_row_of_the_sort(spark, monkeypatch):
    sorted_rows = []
    sort = ordered.sort_once
    monkeypatch.setattr(ordered, "sort_once", lambda df, *a: sorted_rows.append(df) or sort(df, *a))
    df = spark.range(0, 200_000, 1, 8).select(F.lit(1).alias("dept"), F.when(F.col("id") % 10 > 0, 5).otherwise(F.col("id").cast("int")).alias("salary"))
    found = {r.fraction: r.percentile for r in P.percentiles(P.known_values(df, ["dept"], "salary"), ["dept"], "salary", (0.0, 0.5, 1.0)).collect()}
    assert found == {0.0: 0.0, 0.5: 5.0, 1.0: 199990.0}
    assert sorted_rows[0].count() == 20_001


def test_a_million_groups_in_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(ordered, "CHUNK_ROWS", 10_000)
    df = spark.range(0, 1_000_000, 1, 4).select(F.col("id").cast("int").alias("dept"), (F.col("id") % 7).cast("int").alias("salary"))
    found = P.percentiles(P.known_values(df, ["dept"], "salary"), ["dept"], "salary", (0.5,))
    assert found.where("percentile = dept % 7 AND n = 1").count() == 1_000_000
