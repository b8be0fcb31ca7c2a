"""Rebuilding current state from a change feed.

A change is an insert (sets the row, forgetting whatever was there), an update (sets some of the
columns) or a delete. Changes of one key take effect in the order of their sequence numbers, however
often and in whatever order they arrive. A stretch of changes of one key is itself a change: a delete
if it ends with one, an insert if something in it reset the row, else an update of the columns it sets.
Replaying is therefore associative, and a key with any number of changes can be replayed in pieces.

The feed is range-partitioned by (key, sequence) and sorted within the partitions; each partition
replays its stretch of every key, and the few keys cut by a partition boundary are put together in a
second replay over one row per key and partition. A hot key is thereby spread over as many partitions
as its changes need.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.session import map_arrow, partitions_for

INSERT, UPDATE, DELETE = 1, 2, 3
#: rows of a partition replayed at once; a key that goes on is carried over
_CHUNK_ROWS = 1 << 20


@dataclass
class _Stretch:
    """What matters of rows sorted by key and sequence, by key: places of rows, -1 where there is none."""

    starts: np.ndarray
    seq: np.ndarray
    op: np.ndarray
    bits: np.ndarray
    #: last change, last insert or delete, and last change of each column after it
    live: np.ndarray
    reset: np.ndarray
    setters: list[np.ndarray]


def _stretch(table: pa.Table, n_keys: int, n_values: int) -> _Stretch:
    n = table.num_rows
    index = np.arange(n)
    new_key = np.zeros(n, dtype=bool)
    new_key[0] = True
    for i in range(n_keys):
        column = table.column(i).combine_chunks()
        differs = pc.fill_null(pc.not_equal(column.slice(1), column.slice(0, n - 1)), False).to_numpy(zero_copy_only=False)
        nulls = pc.is_null(column).to_numpy(zero_copy_only=False)
        new_key[1:] |= differs | (nulls[1:] != nulls[:-1])
    seq, op, bits = (table.column(n_keys + i).combine_chunks().to_numpy(zero_copy_only=False).copy() for i in range(3))
    #: a sequence number seen before has been applied already
    applied = np.zeros(n, dtype=bool)
    applied[1:] = ~new_key[1:] & (seq[1:] == seq[:-1])
    op[applied], bits[applied] = 0, 0
    starts = np.flatnonzero(new_key)
    ends = np.append(starts[1:], n) - 1
    last = lambda hit: np.maximum.accumulate(np.where(hit, index, -1))[ends]
    live = last(op != 0)
    reset = last((op == INSERT) | (op == DELETE))
    reset = np.where(reset >= starts, reset, -1)
    setters = []
    for i in range(n_values):
        at = last((bits >> i) & 1 == 1)
        setters.append(np.where((at >= starts) & (at >= reset), at, -1))
    return _Stretch(starts, seq, op, bits, live, reset, setters)


def _fold(table: pa.Table, n_keys: int, n_values: int) -> pa.Table:
    """Replay rows sorted by key and sequence; one row, itself a change, for each key."""
    s = _stretch(table, n_keys, n_values)
    ends_op = s.op[s.live]
    out_op = np.where(ends_op == DELETE, DELETE, np.where(s.reset >= 0, INSERT, UPDATE)).astype(np.int32)
    out_bits = np.zeros(len(s.starts), dtype=np.int64)
    values = []
    for i, at in enumerate(s.setters):
        known = (at >= 0) & (out_op != DELETE)
        out_bits |= np.where(known, 1 << i, 0)
        values.append(table.column(n_keys + 3 + i).take(pa.array(np.where(known, at, 0), mask=~known)))
    keys = [table.column(i).take(pa.array(s.starts)) for i in range(n_keys)]
    return pa.Table.from_arrays([*keys, pa.array(s.seq[s.live]), pa.array(out_op), pa.array(out_bits), *values], schema=table.schema)


def _prune(table: pa.Table, n_keys: int, n_values: int) -> pa.Table:
    """The changes that can still matter, with the columns they can still decide."""
    s = _stretch(table, n_keys, n_values)
    bits = np.zeros(table.num_rows, dtype=np.int64)
    kept = np.zeros(table.num_rows, dtype=bool)
    kept[s.live] = True
    kept[s.reset[s.reset >= 0]] = True
    for i, at in enumerate(s.setters):
        kept[at[at >= 0]] = True
        bits[at[at >= 0]] |= 1 << i
    place = n_keys + 2
    return table.set_column(place, table.schema.field(place), pa.array(bits)).filter(pa.array(kept))


def _replay_partition(n_keys: int, n_values: int, step: Callable[[pa.Table, int, int], pa.Table] = _fold):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= _CHUNK_ROWS:
                done = step(pa.Table.from_batches(held), n_keys, n_values)
                # the last key may go on in the next rows
                at = int(_stretch(done, n_keys, 0).starts[-1])
                yield from done.slice(0, at).to_batches()
                held = done.slice(at).combine_chunks().to_batches()
                rows = len(held)
        if held:
            yield from step(pa.Table.from_batches(held), n_keys, n_values).to_batches()

    return run


def _in_order(changes: DataFrame, keys: Sequence[str], seq: str, op: str, set_bits: str, values: Sequence[str]) -> DataFrame:
    order = [*keys, seq]
    picked = changes.select(*keys, F.col(seq).cast("long").alias(seq), F.col(op).cast("int").alias(op), F.col(set_bits).cast("long").alias(set_bits), *values)
    return picked.repartitionByRange(partitions_for(picked), *order).sortWithinPartitions(*order)


def partial_states(changes: DataFrame, keys: Sequence[str], seq: str, op: str, set_bits: str, values: Sequence[str]) -> DataFrame:
    """Changes folded to few rows per key, each for all changes between two sequence numbers."""
    parts = _in_order(changes, keys, seq, op, set_bits, values)
    return map_arrow(parts, _replay_partition(len(keys), len(values)), parts.schema)


def merge_states(states: DataFrame, keys: Sequence[str], seq: str, values: Sequence[str]) -> DataFrame:
    """Fold states of stretches that do not overlap in sequence (partitions, closed periods) to one row per key."""
    parts = states.repartition(*(F.col(k) for k in keys)).sortWithinPartitions(*keys, seq)
    return map_arrow(parts, _replay_partition(len(keys), len(values)), parts.schema)


def surviving_changes(changes: DataFrame, keys: Sequence[str], seq: str, op: str, set_bits: str, values: Sequence[str]) -> DataFrame:
    """Those changes that can still matter whatever else arrives, at most one per column and two more per key.

    Unlike folded states they keep their sequence numbers, so survivors of any parts of a feed, however
    these overlap, can be put together and replayed. Keys cut by a partition may keep some rows more.
    """
    parts = _in_order(changes, keys, seq, op, set_bits, values)
    return map_arrow(parts, _replay_partition(len(keys), len(values), _prune), parts.schema)


def replay_feed(changes: DataFrame, keys: Sequence[str], seq: str, op: str, set_bits: str, values: Sequence[str]) -> DataFrame:
    """Current rows: ``keys``, ``seq`` of the last change, ``values``.

    ``op`` is INSERT, UPDATE or DELETE (1, 2, 3); ``set_bits`` has bit *i* set where the change sets
    ``values[i]``, which may then be set to null. A sequence number that occurs again for a key is
    skipped. An update of an unknown key creates the row with the columns it sets (the feed may be
    younger than the row); columns never set are null. An update after a delete creates the row anew.

    Changes with a null sequence number or a null or unknown ``op`` have no place in the order and
    are ignored; null key columns are key values like any other. An empty feed gives no rows. Values
    may be of any length. Columns not named are ignored, whatever their names.
    """
    names, vals = [f"k__{i}" for i in range(len(keys))], [f"v__{i}" for i in range(len(values))]
    parts = partial_states(as_changes(changes, keys, seq, op, set_bits, values), names, "seq__", "op__", "bits__", vals)
    return live_rows(merge_states(parts, names, "seq__", vals), keys, seq, values)


def as_changes(changes: DataFrame, keys: Sequence[str], seq: str, op: str, set_bits: str, values: Sequence[str]) -> DataFrame:
    """Changes under the names the replay works with: k__0 ..., seq__, op__, bits__, v__0 ..."""
    return changes.where(F.col(seq).isNotNull() & F.col(op).isin(INSERT, UPDATE, DELETE)).select(
        *(F.col(k).alias(f"k__{i}") for i, k in enumerate(keys)), F.col(seq).cast("long").alias("seq__"), F.col(op).cast("int").alias("op__"),
        F.coalesce(F.when(F.col(op) == DELETE, F.lit(0)).otherwise(F.col(set_bits)), F.lit(0)).cast("long").alias("bits__"), *(F.col(v).alias(f"v__{i}") for i, v in enumerate(values)),
    )


def live_rows(states: DataFrame, keys: Sequence[str], seq: str, values: Sequence[str]) -> DataFrame:
    """Rows that exist after the states of ``merge_states``, under their own names."""
    return states.where(F.col("op__") != DELETE).select(
        *(F.col(f"k__{i}").alias(k) for i, k in enumerate(keys)), F.col("seq__").alias(seq), *(F.col(f"v__{i}").alias(v) for i, v in enumerate(values))
    )


#: column order of a tuple image
IMAGE_COLUMNS = ("id", "dept", "salary", "name")
TUPLE_KEY = ("relation_id", "page_no", "slot_no")


def committed_changes(log: DataFrame) -> DataFrame:
    """Heap changes of committed transactions, in the form ``replay_feed`` takes.

    Record types are compared without regard to letter case and surrounding blanks; records of any
    other or of no type, and transactions without a COMMIT record anywhere in the feed, have no
    effect. An image holds ``id|dept|salary|name`` with a backslash before a ``|`` of the name and
    ``NULL`` for NULL; a change without an image sets no columns.
    """
    kind = F.upper(F.trim("type"))
    commits = log.where(kind == "COMMIT").select(F.col("txn_id").alias("committed_txn")).where(F.col("committed_txn").isNotNull()).distinct()
    op = F.when(kind == "HEAP_INSERT", INSERT).when(kind == "HEAP_UPDATE", UPDATE).when(kind == "HEAP_DELETE", DELETE)
    parts = F.split("after_image", r"\|", 4)
    # the name is the fourth field and may hold escaped bars, which do not end it
    field = lambda i: F.nullif(F.get(parts, F.lit(i)), F.lit("NULL"))
    changes = log.select(*TUPLE_KEY, "lsn", "txn_id", op.alias("op"), "after_image").where(F.col("op").isNotNull())
    return changes.join(commits, F.col("txn_id") == F.col("committed_txn"), "left_semi").select(
        *TUPLE_KEY, "lsn", "op", F.when(F.col("after_image").isNull(), 0).otherwise(15).alias("set_bits"),
        field(0).try_cast(T.IntegerType()).alias("id"), field(1).try_cast(T.IntegerType()).alias("dept"),
        field(2).try_cast(T.IntegerType()).alias("salary"), F.replace(field(3), F.lit("\\|"), F.lit("|")).alias("name"),
    )


def table_state(log: DataFrame) -> DataFrame:
    """Content of every live tuple: tuple key, ``lsn`` of its last change, id, dept, salary, name."""
    return replay_feed(committed_changes(log), TUPLE_KEY, "lsn", "op", "set_bits", IMAGE_COLUMNS)


def undo_list(log: DataFrame) -> DataFrame:
    """Heap changes of transactions that neither committed nor aborted: distinct (lsn, txn_id)."""
    kind = F.upper(F.trim("type"))
    ended = log.where(kind.isin("COMMIT", "ABORT")).select(F.col("txn_id").alias("ended_txn")).where(F.col("ended_txn").isNotNull()).distinct()
    changes = log.where(kind.isin("HEAP_INSERT", "HEAP_UPDATE", "HEAP_DELETE")).select("lsn", "txn_id").distinct()
    return changes.join(ended, F.col("txn_id") == F.col("ended_txn"), "left_anti")
