"""Tables as immutable snapshots on shared storage.

A table is a folder with data parts (folders of Parquet files, written once) and commits (small JSON
files, numbered without gaps). A commit lists the parts that make up the table from then on. A writer
first writes its parts, then publishes the next commit by a rename that fails if the number is taken:
of two writers, one starts again from what the other left, and readers keep the snapshot they opened.
There is nothing to recover: parts that no commit names were never part of the table, and a torn commit
is no commit.

INSERT adds a part. UPDATE and DELETE rewrite only the parts in which a row matches. Parts of like size are
merged once there are ``MERGE`` of them, so a table of n rows has about ``MERGE * log(n)`` parts however
many statements made it. The keys of the first index are the order of the rows in every part, so that
lookups by them skip row groups and pages; keys of other indexes get Bloom filters.

A transaction is a set of commits, one for each table it wrote or read, that count only once its outcome
is published. Whoever meets a commit whose transaction does not end may publish that it failed; only one
outcome can be published.
"""

from __future__ import annotations

import json
import random
import time
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators import scans, verify
from millrace.session import PARTITION_BYTES, estimated_bytes
from millrace.sources.tables import ColumnDef, ConstraintError, TableDef


#: parts of like size that are merged, and times a statement starts again when another writer was first
MERGE, ATTEMPTS = 16, 8
#: seconds before a statement starts again, doubled each time
WAIT = 0.02


class ConflictError(RuntimeError):
    """Another writer committed first."""


class Storage:
    """The few file operations commits need, on whatever file system the root is on."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self.fs = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        path = self.path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> bool:
        """Write ``text`` under ``name`` all at once; False if the name is taken."""
        temporary = self.path(f".{uuid.uuid4().hex}")
        stream = self.fs.create(temporary, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        target = self.path(name)
        self.fs.mkdirs(target.getParent())
        try:
            if self.fs.getScheme() == "file":
                # a local rename replaces its target; a new link to an existing name fails
                files = self.jvm.java.nio.file.Files
                local = lambda p: self.jvm.java.nio.file.Path.of(p.toUri())
                qualified = self.fs.makeQualified(target), self.fs.makeQualified(temporary)
                try:
                    files.createLink(local(qualified[0]), local(qualified[1]))
                    return True
                except Exception as error:
                    if "FileAlreadyExists" in str(error):
                        return False
                    raise
            return bool(self.fs.rename(temporary, target))
        finally:
            self.fs.delete(temporary, False)

    def remove(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


@dataclass(frozen=True)
class Snapshot:
    version: int
    table: TableDef
    #: rows by part
    rows: dict[str, int] = field(default_factory=dict)

    @property
    def parts(self) -> tuple[str, ...]:
        return tuple(self.rows)


def _all(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions)


class TableStore:
    """Named tables below ``root``, which has to be reachable by all executors."""

    def __init__(self, spark: SparkSession, root: str, on_step: Callable[[str], None] | None = None):
        """``on_step`` is called with the names of the steps of a statement (``written``, ``checked``, ``merged``,
        ``prepared``, ``decided``, ``committed``, ``removed``); tests raise from it to break off there."""
        self.spark, self.root = spark, root.rstrip("/")
        self.storage = Storage(spark, root)
        self.on_step = on_step or (lambda step: None)

    def names(self) -> list[str]:
        return [n for n in self.storage.names("") if not n.startswith(".") and self.storage.names(f"{n}/commits")]

    def exists(self, name: str) -> bool:
        return self._newest(name) is not None

    def _commits(self, name: str) -> list[int]:
        return sorted(int(f[:-5]) for f in self.storage.names(f"{name}/commits") if f.endswith(".json"))

    def _entry(self, name: str, version: int) -> dict | None:
        """A commit as it was written; None for a torn one."""
        try:
            x = json.loads(self.storage.read(f"{name}/commits/{version:012d}.json"))
            return x if {"table", "parts", "operation"} <= x.keys() else None
        except (ValueError, AttributeError):
            return None

    def _outcome(self, transaction: str | None) -> str | None:
        """``commit`` or ``abort``; None while the transaction has not ended."""
        if transaction is None:
            return "commit"
        name = f".transactions/{transaction}.json"
        return json.loads(self.storage.read(name))["outcome"] if self.storage.fs.exists(self.storage.path(name)) else None

    def _newest(self, name: str) -> Snapshot | None:
        for version in reversed(self._commits(name)):
            x = self._entry(name, version)
            if x is not None and self._outcome(x.get("transaction")) == "commit":
                return Snapshot(version, TableDef.from_json(x["table"]), dict(x["parts"]))
        return None

    def snapshot(self, name: str) -> Snapshot:
        found = self._newest(name)
        if found is None:
            raise ValueError(f"no table {name}")
        return found

    def read(self, name: str, snapshot: Snapshot | None = None) -> DataFrame:
        snap = snapshot or self.snapshot(name)
        return self._parts(name, snap.table, snap.parts)

    def _parts(self, name: str, table: TableDef, parts) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], table.schema)
        return self.spark.read.schema(table.schema).parquet(*(f"{self.root}/{name}/{p}" for p in parts))

    def _write(self, name: str, df: DataFrame, table: TableDef) -> dict[str, int]:
        """A new part, laid out by the table's indexes; none for no rows."""
        part = f"part-{uuid.uuid4().hex}"
        order, filtered = table.layout
        if order and estimated_bytes(df) <= PARTITION_BYTES:
            df = df.coalesce(1).sortWithinPartitions(*order)
        elif order:
            df = scans.cluster_by(df, order)
        writer = df.write
        for c in filtered:
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
        writer.parquet(f"{self.root}/{name}/{part}")
        self.on_step("written")
        n = self._parts(name, table, (part,)).count()
        return {part: n} if n else {}

    def _commit(self, name: str, base: Snapshot, table: TableDef, rows: Mapping[str, int], operation: str, transaction: str | None = None) -> None:
        """Publish the commit that follows ``base``; ConflictError if another one may."""
        commits = self._commits(name)
        for version in commits:
            if version > base.version and (x := self._entry(name, version)) is not None and self._outcome(x.get("transaction")) != "abort":
                raise ConflictError(f"{name} was changed by another writer")
        content = {"table": table.to_json(), "parts": dict(rows), "operation": operation}
        if transaction:
            content["transaction"] = transaction
        if not self.storage.publish(f"{name}/commits/{max([base.version, *commits]) + 1:012d}.json", json.dumps(content)):
            raise ConflictError(f"{name} was changed by another writer")
        self.on_step("prepared" if transaction else "committed")

    def _again(self, name: str, statement: Callable[[], Any]) -> Any:
        """Run a statement, from the start where another writer was first; gives up after ``ATTEMPTS``.

        A transaction that has not ended by then is taken to have been left by its writer, and fails.
        """
        for attempt in range(ATTEMPTS):
            try:
                return statement()
            except ConflictError:
                if attempt == ATTEMPTS - 1:
                    raise
                time.sleep(WAIT * 2**attempt * (0.5 + random.random()))
                if attempt == ATTEMPTS - 2:
                    for version in self._commits(name)[-1:]:
                        left = (self._entry(name, version) or {}).get("transaction")
                        if left:
                            self.storage.publish(f".transactions/{left}.json", json.dumps({"outcome": "abort"}))

    def create(self, name: str, columns: list[ColumnDef]) -> None:
        if self.exists(name):
            raise ValueError(f"table {name} exists")
        if len({c.name for c in columns}) < len(columns):
            raise ValueError(f"table {name} names a column twice")
        self._commit(name, Snapshot(0, TableDef((), {})), TableDef(tuple(columns), {}), {}, "create")

    def create_index(self, name: str, index: str, keys: list[str], unique: bool) -> None:
        """Check null keys, and equal keys of a unique index, and lay out the rows that are there for lookups by it."""

        def statement() -> None:
            snap = self.snapshot(name)
            if index in snap.table.indexes:
                raise ValueError(f"index {index} exists")
            for k in keys:
                snap.table.column(k)
            table = TableDef(snap.table.columns, snap.table.indexes | {index: (tuple(keys), unique)})
            self._check(self.read(name, snap), TableDef(table.columns, {index: (tuple(keys), unique)}))
            rows = self._write(name, self.read(name, snap), table) if snap.rows and table.layout != snap.table.layout else snap.rows
            self._commit(name, snap, table, rows, f"create index {index}")

        self._again(name, statement)

    def _check(self, df: DataFrame, table: TableDef, old: DataFrame | None = None, keys_of: Mapping[str, Any] | None = None) -> None:
        """Raise unless ``df``, joining rows of ``old``, obeys the table's rules; ``keys_of`` holds its values if it is one row."""
        required = {c.name for c in table.columns if not c.nullable} | {k for keys, _ in table.indexes.values() for k in keys}
        bad = verify.violations(df, sorted(required), {c.name: c.length for c in table.columns if c.length is not None}).first()
        broken = [n for n, v in bad.asDict().items() if v]
        if broken:
            raise ConstraintError("; ".join(broken))
        for index, (keys, unique) in table.indexes.items():
            if not unique:
                continue
            clash = keys_of is None and not verify.duplicate_keys(df, keys).isEmpty()
            if not clash and old is not None:
                clash = not self._meeting(df, old, keys, keys_of).isEmpty()
            if clash:
                raise ConstraintError(f"{index}: a key occurs twice")
        self.on_step("checked")

    @staticmethod
    def _meeting(df: DataFrame, old: DataFrame, keys, keys_of: Mapping[str, Any] | None) -> DataFrame:
        """Rows of ``old`` with a key of ``df``. The values of one row, or the range of many, reach the Parquet reader."""
        if keys_of is not None:
            return old.where(_all(F.col(k) == F.lit(keys_of[k]) for k in keys)).limit(1)
        low, high = df.agg(F.min(keys[0]), F.max(keys[0])).first()
        new = df.select(*(F.col(k).alias(f"new__{k}") for k in keys))
        return old.where(F.col(keys[0]).between(F.lit(low), F.lit(high))).join(new, _all(F.col(k) == F.col(f"new__{k}") for k in keys), "left_semi")

    def append(self, name: str, rows: DataFrame, keys_of: Mapping[str, Any] | None = None) -> int:
        """Add rows (by column position); all of them or none. They are written once, however often the commit is tried."""
        snap = self.snapshot(name)
        fields = snap.table.schema.fields
        if len(rows.columns) != len(fields):
            raise ConstraintError(f"{name} has {len(fields)} columns")
        typed = rows.toDF(*(f.name for f in fields)).select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in fields))
        part = self._write(name, typed, snap.table)

        def statement() -> int:
            now = self.snapshot(name)
            self._check(self._parts(name, now.table, tuple(part)), now.table, self.read(name, now) if now.rows else None, keys_of)
            self._commit(name, now, now.table, self._merged(name, now.table, now.rows | part), "insert")
            return sum(part.values())

        return self._again(name, statement)

    def insert(self, name: str, values: list[Any]) -> int:
        """Add one row of literals, one for each column."""
        table = self.snapshot(name).table
        if len(values) != len(table.columns):
            raise ConstraintError(f"{name} has {len(table.columns)} columns")
        row = tuple(c.store(v) for c, v in zip(table.columns, values))
        return self.append(name, self.spark.createDataFrame([row], table.schema).coalesce(1), {c.name: v for c, v in zip(table.columns, row)})

    def _merged(self, name: str, table: TableDef, rows: Mapping[str, int]) -> dict[str, int]:
        """Parts with those of like size (powers of ``MERGE``) merged, where there are ``MERGE`` of them."""
        rows = dict(rows)
        while True:
            sizes: dict[int, list[str]] = {}
            for p, n in rows.items():
                tier = 0
                while n >= MERGE:
                    n, tier = n // MERGE, tier + 1
                sizes.setdefault(tier, []).append(p)
            full = next((own for own in sizes.values() if len(own) >= MERGE), None)
            if full is None:
                return rows
            rows = {p: n for p, n in rows.items() if p not in full} | self._write(name, self._parts(name, table, full), table)
            self.on_step("merged")

    def compact(self, name: str) -> int:
        """Merge all parts into one; how many there were. What was merged goes with ``vacuum``."""

        def statement() -> int:
            snap = self.snapshot(name)
            if len(snap.rows) > 1:
                self._commit(name, snap, snap.table, self._write(name, self.read(name, snap), snap.table), "compact")
            return len(snap.rows)

        return self._again(name, statement)

    def _touched(self, name: str, snap: Snapshot, condition: Column | None) -> dict[str, int]:
        """Rows that match, by part."""
        if condition is None or not snap.rows:
            return dict(snap.rows)
        part = F.regexp_extract(F.input_file_name(), r"/(part-[0-9a-f]{32})/", 1)
        return {r["part"]: r["count"] for r in self.read(name, snap).where(condition).groupBy(part.alias("part")).count().collect()}

    def update(self, name: str, changes: Mapping[str, Any], condition: Column | None = None) -> int:
        """Set columns to literals where the condition is true; every row or, on any violation, none."""

        def statement() -> int:
            snap = self.snapshot(name)
            literals = {c: snap.table.column(c).literal(v) for c, v in changes.items()}
            hits = self._touched(name, snap, condition)
            if not sum(hits.values()):
                return 0
            hit = condition if condition is not None else F.lit(True)
            old = self._parts(name, snap.table, tuple(hits))
            # all columns at once: conditions see the row as it was
            new = old.select(*(F.when(hit, literals[c]).otherwise(F.col(c)).alias(c) if c in literals else F.col(c) for c in old.columns))
            rest = {p: n for p, n in snap.rows.items() if p not in hits}
            part = self._write(name, new, snap.table)
            touched = {i: x for i, x in snap.table.indexes.items() if set(x[0]) & set(literals)}
            self._check(self._parts(name, snap.table, tuple(part)), TableDef(snap.table.columns, touched), self._parts(name, snap.table, tuple(rest)) if rest else None)
            self._commit(name, snap, snap.table, self._merged(name, snap.table, rest | part), "update")
            return sum(hits.values())

        return self._again(name, statement)

    def delete(self, name: str, condition: Column | None = None) -> int:
        """Remove rows where the condition is true; all rows without one."""

        def statement() -> int:
            snap = self.snapshot(name)
            hits = self._touched(name, snap, condition)
            n = sum(hits.values())
            if n:
                # parts of which every row matches just go
                some = [p for p, k in hits.items() if k < snap.rows[p]]
                kept = {p: k for p, k in snap.rows.items() if p not in hits}
                if some:
                    kept |= self._write(name, self._parts(name, snap.table, some).where(~F.coalesce(condition, F.lit(False))), snap.table)
                self._commit(name, snap, snap.table, self._merged(name, snap.table, kept), "delete")
            return n

        return self._again(name, statement)

    def transaction(self) -> Transaction:
        return Transaction(self)

    def history(self, name: str) -> list[tuple[int, str]]:
        """Versions that count and what made them."""
        entries = [(v, self._entry(name, v)) for v in self._commits(name)]
        return [(v, x["operation"]) for v, x in entries if x is not None and self._outcome(x.get("transaction")) == "commit"]

    def check(self, name: str) -> DataFrame:
        """Columns ``rule``, ``violations``: whether rows, rules, indexes and layout of a table are as its newest commit says."""
        snap = self.snapshot(name)
        df, (order, _) = self.read(name, snap), snap.table.layout
        at = [F.regexp_extract(F.input_file_name(), r"/(part-[0-9a-f]{32})/", 1).alias("part"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place")]
        found = []
        if snap.rows:
            said = self.spark.createDataFrame(list(snap.rows.items()), "said string, n long")
            counted = df.select(*at).groupBy("part").count()
            found.append(said.join(counted, F.col("said") == F.col("part"), "full").agg(F.lit("rows by part").alias("rule"), F.sum(F.abs(F.coalesce("n", F.lit(0)) - F.coalesce("count", F.lit(0)))).alias("violations")))
        if snap.rows and order:
            before = F.lag(F.struct(*order)).over(Window.partitionBy("file").orderBy("place"))
            found.append(df.select(*at, *order).withColumn("late", before > F.struct(*order)).agg(F.lit("order of the first index").alias("rule"), F.count_if("late").alias("violations")))
        required = sorted({c.name for c in snap.table.columns if not c.nullable} | {k for keys, _ in snap.table.indexes.values() for k in keys})
        rules = verify.violations(df, required, {c.name: c.length for c in snap.table.columns if c.length is not None})
        found.append(rules.unpivot([], rules.columns, "rule", "violations"))
        for index, (keys, unique) in snap.table.indexes.items():
            if unique:
                found.append(verify.duplicate_keys(df, keys).agg(F.lit(f"{index} is unique").alias("rule"), F.count(F.lit(1)).alias("violations")))
        return reduce(DataFrame.unionByName, [f.select("rule", F.coalesce("violations", F.lit(0)).cast("long").alias("violations")) for f in found])

    def vacuum(self, name: str, keep: int = 1) -> int:
        """Remove commits older than the newest ``keep`` and parts that none of these names; no writer may be at work."""
        snap = self.snapshot(name)
        kept = [v for v, _ in self.history(name) if v <= snap.version][-keep:]
        alive = set()
        for v in kept:
            alive |= set(self._entry(name, v)["parts"])
        gone = [p for p in self.storage.names(name) if p.startswith("part-") and p not in alive]
        for p in gone:
            self.storage.remove(f"{name}/{p}")
            self.on_step("removed")
        for v in self._commits(name):
            if v < kept[0]:
                self.storage.remove(f"{name}/commits/{v:012d}.json")
        return len(gone)


class Transaction(TableStore):
    """Statements on any tables that take effect together, or not at all.

    It sees what it wrote, and else the tables as they were when it first met them. ``commit`` fails with
    ConflictError if any of these has changed since; leaving the ``with`` block by an error rolls back.
    """

    def __init__(self, store: TableStore):
        super().__init__(store.spark, store.root, store.on_step)
        self.id = uuid.uuid4().hex
        self.base: dict[str, Snapshot] = {}
        self.now: dict[str, Snapshot] = {}
        self.done: dict[str, list[str]] = {}

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self.commit()
        else:
            self.rollback()

    def _newest(self, name: str) -> Snapshot | None:
        if name not in self.now:
            found = super()._newest(name)
            if found is None:
                return None
            self.base[name] = self.now[name] = found
        return self.now[name]

    def _commit(self, name: str, base: Snapshot, table: TableDef, rows: Mapping[str, int], operation: str, transaction: str | None = None) -> None:
        self.base.setdefault(name, base)
        self.now[name] = Snapshot(base.version, table, dict(rows))
        self.done.setdefault(name, []).append(operation)

    def commit(self) -> None:
        if not self.done:
            return
        try:
            # tables that were only read get a commit too, so that no other writer changes them meanwhile
            for name in sorted(self.now):
                super()._commit(name, self.base[name], self.now[name].table, self.now[name].rows, ", ".join(self.done.get(name, ["read"])), self.id)
        except ConflictError:
            self.rollback()
            raise
        decided = self.storage.publish(f".transactions/{self.id}.json", json.dumps({"outcome": "commit"}))
        self.done.clear()
        if not decided:
            raise ConflictError("the transaction was taken to have been left")
        self.on_step("decided")

    def rollback(self) -> None:
        if self.done:
            self.storage.publish(f".transactions/{self.id}.json", json.dumps({"outcome": "abort"}))
        self.done.clear()
