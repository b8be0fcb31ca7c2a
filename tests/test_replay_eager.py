"""Change-feed replay and joins on pre-aggregated inputs against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import eager, replay
from millrace.operators.replay import DELETE, INSERT, UPDATE, replay_feed
from tests.conftest import rows

FEED = "k1 int, k2 string, seq long, op int, bits int, a int, b string, note string"


def brute(feed):
    """Apply changes one after the other."""
    state, last, seen = {}, {}, set()
    for k1, k2, seq, op, bits, a, b, _ in sorted((r for r in feed if r[2] is not None and r[3] in (1, 2, 3)), key=lambda r: r[2]):
        key = (k1, k2)
        if (key, seq) in seen:
            continue
        seen.add((key, seq))
        if op == DELETE:
            state.pop(key, None)
            continue
        row = [None, None] if op == INSERT else state.get(key, [None, None])
        row = [v if bits >> i & 1 else old for i, (v, old) in enumerate(zip((a, b), row))]
        state[key], last[key] = row, seq
    return sorted(((*k, last[k], *v) for k, v in state.items()), key=str)


def feed_of(rng, n, keys, hot=0.0):
    out = []
    for seq in range(n):
        key = (0, "hot") if rng.random() < hot else (rng.choice([None, *range(keys)]), rng.choice([None, "x"]))
        out.append((*key, seq, rng.choice([INSERT, UPDATE, UPDATE, DELETE]), rng.randrange(4), rng.choice([None, *range(9)]), rng.choice([None, "", "é" * 3]), "other"))
    out += rng.sample(out, n // 5)
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("seed", "hot"), [(1, 0.0), (2, 0.5), (3, 1.0)])
def test_replay_against_brute_force(spark, seed, hot):
    feed = feed_of(random.Random(seed), 400, 9, hot)
    df = spark.createDataFrame(feed, FEED).repartition(5)
    found = replay_feed(df, ["k1", "k2"], "seq", "op", "bits", ["a", "b"])
    assert found.columns == ["k1", "k2", "seq", "a", "b"]
    assert sorted(map(tuple, found.collect()), key=str) == brute(feed)


def test_replay_carries_a_key_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(replay, "_CHUNK_ROWS", 3)
    feed = feed_of(random.Random(5), 120, 2)
    import pyarrow as pa

    order = sorted((r for r in feed), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "", r[2]))
    cols = list(zip(*[(r[0], r[1], r[2], r[3], 0 if r[3] == DELETE else r[4], r[5], r[6]) for r in order]))
    schema = pa.schema([("k1", pa.int32()), ("k2", pa.string()), ("seq", pa.int64()), ("op", pa.int32()), ("bits", pa.int64()), ("a", pa.int32()), ("b", pa.string())])
    table = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)
    found = [tuple(r.values()) for b in replay._replay_partition(2, 2)(iter(table.to_batches(max_chunksize=2))) for r in b.to_pylist()]
    assert sorted(((r[0], r[1], r[2], r[5], r[6]) for r in found if r[3] != DELETE), key=str) == brute(feed)


def test_replay_of_nothing_and_of_unplaced_changes(spark):
    empty = spark.createDataFrame([], FEED)
    assert rows(replay_feed(empty, ["k1", "k2"], "seq", "op", "bits", ["a", "b"])) == []
    odd = spark.createDataFrame([(1, "x", None, INSERT, 3, 1, "a", ""), (1, "x", 5, None, 3, 1, "a", ""), (1, "x", 6, 9, 3, 1, "a", ""), (1, "x", 7, UPDATE, None, 1, "a", "")], FEED)
    assert rows(replay_feed(odd, ["k1", "k2"], "seq", "op", "bits", ["a", "b"])) == [(1, "x", 7, None, None)]


def test_partial_states_of_days_merge(spark):
    feed = feed_of(random.Random(8), 300, 5)
    df = spark.createDataFrame(feed, FEED).where("op in (1,2,3)").withColumn("bits", F.when(F.col("op") == DELETE, 0).otherwise(F.col("bits")))
    halves = [replay.partial_states(df.where(c), ["k1", "k2"], "seq", "op", "bits", ["a", "b"]) for c in ("seq < 150", "seq >= 150")]
    merged = replay.merge_states(halves[1].unionByName(halves[0]), ["k1", "k2"], "seq", ["a", "b"])
    assert sorted(map(tuple, merged.where(F.col("op") != DELETE).select("k1", "k2", "seq", "a", "b").collect()), key=str) == brute(feed)


LOG = "lsn long, type string, txn_id long, relation_id int, page_no int, slot_no int, before_image string, after_image string"


def test_log_records(spark):
    log = spark.createDataFrame([
        (1, " begin", 1, None, None, None, None, None), (2, "HEAP_INSERT ", 1, 1, 1, 1, None, "7|1|100|a\\|b"), (2, "HEAP_INSERT", 1, 1, 1, 1, None, "7|1|100|a\\|b"),
        (3, "heap_update", 1, 1, 1, 1, None, "7|NULL|NULL|NULL"), (9, "Commit", 1, None, None, None, None, None),
        (4, "HEAP_INSERT", 2, 1, 1, 2, None, "8|1|1|x"), (5, "HEAP_DELETE", 1, 1, 1, 3, "9|1|1|y", None), (6, "HEAP_UPDATE", 1, 2, 1, 3, None, "9|1|1|y"),
        (7, None, 1, 1, 1, 1, None, "0|0|0|0"), (8, "CLR", 1, 1, 1, 1, None, "0|0|0|0"), (10, "HEAP_INSERT", None, 1, 1, 9, None, "1|1|1|q"), (11, "HEAP_UPDATE", 1, 1, 1, 5, None, None),
    ], LOG)
    assert rows(replay.table_state(log)) == [(1, 1, 1, 3, 7, None, None, None), (1, 1, 5, 11, None, None, None, None), (2, 1, 3, 6, 9, 1, 1, "y")]
    assert rows(replay.undo_list(log)) == [(4, 2), (10, None)] or rows(replay.undo_list(log)) == [(10, None), (4, 2)]
    assert rows(replay.table_state(log.limit(0))) == []


def test_name_with_a_bar_and_longer_images(spark):
    log = spark.createDataFrame([(1, "HEAP_INSERT", 1, 1, 1, 1, None, "7|1|100|" + "n\\|" * 5000), (2, "COMMIT", 1, None, None, None, None, None)], LOG)
    assert replay.table_state(log).first()["name"] == "n|" * 5000


E_SCHEMA, D_SCHEMA = "dept int, salary int, joined_rows string", "id int, dname string, joined_rows string"


@pytest.mark.parametrize("how", ["inner", "left"])
def test_eager_against_the_join(spark, how):
    rng = random.Random(4)
    emp = spark.createDataFrame([(rng.choice([None, 1, 1, 1, 1, 2, 3, 9]), rng.choice([None, -5, 0, 7, 7]), "z") for _ in range(300)], E_SCHEMA)
    dept = spark.createDataFrame([(1, "a", ""), (1, "a", ""), (2, None, ""), (2, "b", ""), (3, "a", ""), (None, "n", ""), (4, "d", "")], D_SCHEMA)
    aggs = {"n": ("count", "salary"), "t": ("sum", "salary"), "low": ("min", "salary"), "high": ("max", "salary")}
    found = eager.eager_join_aggregate(emp, dept, ("dept", "id"), aggs, {"names": ("count", "dname")}, right_group=["dname"], how=how)
    direct = emp.drop("joined_rows").join(dept.drop("joined_rows"), F.col("dept") == F.col("id"), how).groupBy("dept", "dname").agg(
        F.count(F.lit(1)), F.count("salary"), F.sum("salary"), F.min("salary"), F.max("salary"), F.count("dname"))
    assert rows(found) == rows(direct)
    rolled = eager.rollup(found, ["dname"], {"joined_rows": "count", "t": "sum", "low": "min"})
    assert {r.dname: r.joined_rows for r in rolled.collect()} == {r.dname: r.n for r in emp.drop("joined_rows").join(dept.drop("joined_rows"), F.col("dept") == F.col("id"), how).groupBy("dname").agg(F.count(F.lit(1)).alias("n")).collect()}


def test_heavy_keys(spark):
    emp = spark.createDataFrame([(None, 1, "")] * 50 + [(1, 1, "")] * 30 + [(2, 1, "")] * 17 + [(3, 1, "")] * 3, E_SCHEMA)
    dept = spark.createDataFrame([(1, "a", "")], D_SCHEMA)
    states = eager.eager_join_aggregate(emp, dept, ("dept", "id"), how="left", key_name="dept")
    assert rows(eager.heavy_keys(states, "dept", 0.03)) == [(1, 30), (2, 17), (3, 3)]
    assert rows(eager.heavy_keys(states, "dept", 0.031)) == [(1, 30), (2, 17)]
    none = eager.eager_join_aggregate(emp.limit(0), dept, ("dept", "id"), how="left", key_name="dept")
    assert rows(eager.heavy_keys(none, "dept", 0.03)) == []
    with pytest.raises(ValueError):
        eager.eager_join_aggregate(emp, dept, ("dept", "id"), how="full")
