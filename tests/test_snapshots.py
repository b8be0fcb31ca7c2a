"""Snapshots: versions, conflicts, breaking off, and a workload whose outcome is known in closed form."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import verify
from millrace.sources import snapshots
from millrace.sources.snapshots import ConflictError, TableStore
from millrace.sources.tables import ColumnDef, ConstraintError

COLUMNS = [ColumnDef("id", "INT", False), ColumnDef("dept_id", "INT", False), ColumnDef("salary", "BIGINT", False)]


class Stop(Exception):
    pass


def test_mixed_workload(spark, root):
    n = 60
    store = TableStore(spark, root)
    store.create("employees", COLUMNS)
    store.create_index("employees", "by_id", ["id"], True)
    make = lambda rows: spark.createDataFrame(rows, "id int, dept_id int, salary long")
    store.append("employees", make([(i, i % 11, 50000 + 10 * i) for i in range(1, n + 1)]))
    for i in range(3, n + 1, 3):
        store.update("employees", {"dept_id": (i + 3) % 13, "salary": 70000 + 25 * i}, F.col("id") == i)
    store.delete("employees", F.col("id") % 5 == 0)
    store.append("employees", make([(i, (7 * i) % 17, 90000 + i) for i in range(n + 1, n + n // 4 + 1)]))
    expected = [(i, (i + 3) % 13, 70000 + 25 * i) if i % 3 == 0 else (i, i % 11, 50000 + 10 * i) for i in range(1, n + 1) if i % 5] + [(i, (7 * i) % 17, 90000 + i) for i in range(n + 1, n + n // 4 + 1)]
    assert verify.multiset_equal(store.read("employees"), make(expected))
    assert [op for _, op in store.history("employees")][-2:] == ["delete", "insert"]
    assert {r.rule: r.violations for r in store.check("employees").collect() if r.violations} == {}


def test_a_break_leaves_the_old_table(spark, root):
    def stop_at(step):
        def hook(s):
            if s == step:
                raise Stop
        return hook

    store = TableStore(spark, root)
    store.create("t", COLUMNS)
    store.insert("t", [1, 1, 1])
    with pytest.raises(Stop):
        TableStore(spark, root, stop_at("written")).insert("t", [2, 2, 2])
    assert [tuple(r) for r in store.read("t").collect()] == [(1, 1, 1)]
    with pytest.raises(Stop):
        TableStore(spark, root, stop_at("committed")).insert("t", [3, 3, 3])
    assert store.read("t").count() == 2
    assert store.vacuum("t") == 1 and store.read("t").count() == 2


def test_of_two_writers_one_starts_again(spark, root):
    store = TableStore(spark, root)
    store.create("t", COLUMNS)
    store.create_index("t", "u", ["id"], True)
    other = TableStore(spark, root)
    met = []

    def meanwhile(step):
        if step == "checked" and not met:
            met.append(step)
            other.insert("t", [9, 9, 9])

    assert TableStore(spark, root, meanwhile).insert("t", [1, 1, 1]) == 1
    assert sorted(r.id for r in store.read("t").collect()) == [1, 9]
    met.clear()
    # what the other writer left counts for the rules
    other = TableStore(spark, root)
    with pytest.raises(ConstraintError):
        TableStore(spark, root, lambda step: step == "checked" and not met and (met.append(1), other.insert("t", [5, 5, 5]))).insert("t", [5, 1, 1])
    met.clear()
    assert TableStore(spark, root, lambda step: step == "checked" and not met and (met.append(1), other.insert("t", [6, 1, 1]))).update("t", {"salary": 7}, F.col("dept_id") == 1) == 2
    assert sorted((r.id, r.salary) for r in store.read("t").collect()) == [(1, 7), (5, 5), (6, 7), (9, 9)]


def test_a_writer_that_never_gets_its_turn_gives_up(spark, root, monkeypatch):
    monkeypatch.setattr(snapshots, "WAIT", 0)
    store = TableStore(spark, root)
    store.create("t", COLUMNS)
    other = TableStore(spark, root)
    with pytest.raises(ConflictError):
        TableStore(spark, root, lambda step: other.insert("t", [9, 9, 9]) if step == "checked" else None).insert("t", [1, 1, 1])
    assert {r.id for r in store.read("t").collect()} == {9}


def test_transactions_over_tables(spark, root):
    store = TableStore(spark, root)
    for t in ("a", "b"):
        store.create(t, COLUMNS)
        store.insert(t, [1, 1, 1])
    ids = lambda s, t: sorted(r.id for r in s.read(t).collect())
    with store.transaction() as both:
        both.insert("a", [2, 2, 2])
        both.delete("b")
        assert ids(both, "a") == [1, 2] and ids(both, "b") == [] and ids(store, "a") == [1] == ids(store, "b")
    assert ids(store, "a") == [1, 2] and ids(store, "b") == []
    with pytest.raises(Stop), store.transaction() as both:
        both.insert("a", [3, 3, 3])
        raise Stop
    assert ids(store, "a") == [1, 2]
    # a table that was only read must not have changed either
    late = store.transaction()
    late.insert("a", [4, 4, late.read("b").count()])
    store.insert("b", [7, 7, 7])
    with pytest.raises(ConflictError):
        late.commit()
    assert ids(store, "a") == [1, 2] and ids(store, "b") == [7]
    store.insert("a", [5, 5, 5])
    assert ids(store, "a") == [1, 2, 5] and [op for _, op in store.history("a")] == ["create", "insert", "insert", "insert"]


@pytest.mark.parametrize(("step", "counts"), [("written", False), ("prepared", False), ("decided", True)])
def test_a_transaction_that_breaks_off(spark, root, monkeypatch, step, counts):
    monkeypatch.setattr(snapshots, "WAIT", 0)

    def hook(s):
        if s == step:
            raise Stop

    store = TableStore(spark, root)
    for t in ("a", "b"):
        store.create(t, COLUMNS)
    broken = TableStore(spark, root).transaction()
    with pytest.raises(Stop):
        broken.on_step = hook
        broken.insert("a", [1, 1, 1])
        broken.insert("b", [1, 1, 1])
        broken.commit()
    assert [store.read(t).count() for t in "ab"] == [int(counts)] * 2
    # whoever comes next decides that it failed
    assert store.insert("a", [2, 2, 2]) == 1 and store.insert("b", [2, 2, 2]) == 1
    assert [store.read(t).count() for t in "ab"] == [1 + counts] * 2


def test_parts_of_like_size_are_merged(spark, root, monkeypatch):
    monkeypatch.setattr(snapshots, "MERGE", 4)
    store = TableStore(spark, root)
    store.create("t", COLUMNS)
    store.create_index("t", "u", ["id"], True)
    for i in range(22):
        store.insert("t", [(7 * i) % 22, i, i])
        assert len(store.snapshot("t").parts) <= 3 * 3
    assert sorted(r.id for r in store.read("t").collect()) == list(range(22))
    with pytest.raises(ConstraintError):
        store.insert("t", [5, 0, 0])
    before = len(store.snapshot("t").parts)
    assert store.compact("t") == before and len(store.snapshot("t").parts) == 1 and store.compact("t") == 1
    assert all(r.violations == 0 for r in store.check("t").collect())


def test_conditions_and_keys_reach_the_reader(spark, root, monkeypatch):
    plans = []
    store = TableStore(spark, root)
    store.create("t", COLUMNS)
    store.create_index("t", "u", ["id"], True)
    store.append("t", spark.range(1000).selectExpr("int(id)", "int(id % 7)", "id"))
    read = TableStore.read
    monkeypatch.setattr(TableStore, "read", lambda self, *a: plans.append(read(self, *a)) or plans[-1])
    found = {}
    where = type(plans and plans[0] or spark.range(1)).where

    def watch(df, condition):
        out = where(df, condition)
        found[out._jdf.queryExecution().executedPlan().toString()] = True
        return out

    monkeypatch.setattr(type(spark.range(1)), "where", watch)
    store.insert("t", [5000, 1, 1])
    assert any("EqualTo(id,5000)" in p for p in found)
    found.clear()
    store.update("t", {"salary": 1}, F.col("id") == 17)
    assert any("EqualTo(id,17)" in p for p in found)
    found.clear()
    store.delete("t", F.col("dept_id") > 5)
    assert any("GreaterThan(dept_id,5)" in p for p in found)


def test_checks_find_what_is_wrong(spark, root):
    store = TableStore(spark, root)
    store.create("t", COLUMNS)
    store.create_index("t", "u", ["id"], True)
    store.append("t", spark.range(10).selectExpr("int(id)", "0", "id"))
    (part,) = store.snapshot("t").parts
    spark.createDataFrame([(3, 0, 0), (1, None, 0), (1, 0, 0)], "id int, dept_id int, salary long").coalesce(1).write.mode("append").parquet(f"{root}/t/{part}")
    assert {r.rule: r.violations for r in store.check("t").collect() if r.violations} == {"rows by part": 3, "order of the first index": 1, "dept_id is null": 1, "u is unique": 2}


def test_readers_keep_their_snapshot_and_torn_commits_do_not_count(spark, root, tmp_path):
    store = TableStore(spark, root)
    store.create("t", COLUMNS)
    store.insert("t", [1, 1, 1])
    before = store.read("t")
    store.update("t", {"salary": 5})
    assert before.first().salary == 1 and store.read("t").first().salary == 5
    (tmp_path / "tables/t/commits/000000000004.json").write_text('{"table": ')
    assert TableStore(spark, root).read("t").first().salary == 5


def test_update_is_all_or_nothing(spark, root):
    store = TableStore(spark, root)
    store.create("t", COLUMNS)
    store.create_index("t", "u", ["id"], True)
    for i in (1, 2, 3):
        store.insert("t", [i, 0, 0])
    with pytest.raises(ConstraintError):
        store.update("t", {"id": 3}, F.col("id") < 3)
    assert sorted(r.id for r in store.read("t").collect()) == [1, 2, 3]


@pytest.mark.parametrize(("step", "statement"), [
    (step, statement) for statement in ("insert", "update", "delete", "index", "compact") for step in ("written", "checked", "merged", "committed")
    if (step, statement) not in {("checked", "delete"), ("checked", "compact"), ("merged", "delete"), ("merged", "index"), ("merged", "compact"), ("merged", "update")}
])
def test_breaking_off_at_any_step_leaves_the_old_table_or_the_new(spark, root, monkeypatch, step, statement):
    monkeypatch.setattr(snapshots, "MERGE", 4)
    run = {
        "insert": lambda s: s.insert("t", [9, 9, 9]), "update": lambda s: s.update("t", {"id": 50}, F.col("id") == 2), "delete": lambda s: s.delete("t", F.col("id") == 2),
        "index": lambda s: s.create_index("t", "v", ["salary"], True), "compact": lambda s: s.compact("t"),
    }[statement]
    rows_of = lambda s: sorted(tuple(r) for r in s.read("t").collect())

    def hook(s):
        if s == step:
            raise Stop

    store, other = TableStore(spark, root), TableStore(spark, f"{root}-whole")
    for s in (store, other):
        s.create("t", COLUMNS)
        s.create_index("t", "u", ["id"], True)
        s.append("t", spark.createDataFrame([(1, 1, 1), (2, 2, 2)], "a int, b int, c long"))
        s.insert("t", [3, 3, 3])
        s.insert("t", [4, 4, 4])
    old = rows_of(store)
    run(other)
    with pytest.raises(Stop):
        run(TableStore(spark, root, hook))
    assert rows_of(store) == (rows_of(other) if step == "committed" else old)
    if step != "committed":
        run(store)
    assert rows_of(store) == rows_of(other) and all(r.violations == 0 for r in store.check("t").collect())
