"""The N best items of every group by bounded heaps merged across partitions.

Every task keeps, for each group it meets, only the N best (score, id) pairs; what leaves the task for
the shuffle is at most N rows per group, so that a group of any size costs its tasks a scan. After the
shuffle the rows come sorted by group, and heaps are merged one group after the other: a task holds one
heap and a buffer, however many groups it is given.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import map_arrow, partitions_for

#: rows buffered before heaps are cut down to N again
_BUFFER_ROWS = 1 << 18
#: heap rows a task holds; beyond it they are handed on and merged after the shuffle
_STATE_ROWS = 1 << 21


def _changes(columns: Sequence[pa.ChunkedArray]) -> np.ndarray:
    """Whether each row differs from the row before in any of ``columns`` (none of them null)."""
    n = len(columns[0])
    out = np.zeros(n, dtype=bool)
    out[0] = True
    for column in columns:
        column = column.combine_chunks()
        out[1:] |= pc.not_equal(column.slice(1), column.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    return out


def _keep_best(rows: pa.Table, n: int) -> pa.Table:
    """The ``n`` best rows of each group; columns g__, id__, score__ come first."""
    if not rows.num_rows:
        return rows
    once = rows.sort_by([("g__", "ascending"), ("id__", "ascending"), ("score__", "descending")])
    once = once.filter(pa.array(_changes([once["g__"], once["id__"]])))
    best = once.sort_by([("g__", "ascending"), ("score__", "descending"), ("id__", "ascending")])
    starts = np.flatnonzero(_changes([best["g__"]]))
    rank = np.arange(best.num_rows) - np.repeat(starts, np.diff(np.append(starts, best.num_rows)))
    return best.filter(pa.array(rank < n))


def _joined(state: pa.Table | None, held: list[pa.RecordBatch]) -> pa.Table:
    return pa.Table.from_batches([*(state.to_batches() if state is not None else []), *held])


def _heaps(n: int):
    """Heaps of all groups of a partition; handed on to be merged once there are too many to be held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: pa.Table | None = None
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            kept = state.num_rows if state is not None else 0
            if rows >= max(_BUFFER_ROWS, kept):
                state = _keep_best(_joined(state, held), n)
                held, rows = [], 0
                if state.num_rows > _STATE_ROWS:
                    yield from state.to_batches()
                    state = None
        if held or state is not None:
            yield from _keep_best(_joined(state, held), n).to_batches()

    return run


def _merged(n: int):
    """Heaps of rows sorted by group, group by group: only the last group's heap is kept for the rows to come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: pa.Table | None = None
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows >= _BUFFER_ROWS:
                best = _keep_best(_joined(state, held), n)
                last = int(np.flatnonzero(_changes([best["g__"]]))[-1])
                yield from best.slice(0, last).to_batches()
                state, held, rows = best.slice(last).combine_chunks(), [], 0
        if held or state is not None:
            yield from _keep_best(_joined(state, held), n).to_batches()

    return run


def top_n_per_group(df: DataFrame, group: str, score: str, item: str, n: int) -> DataFrame:
    """Columns ``group``, ``item``, ``score``: the ``n`` items with the highest score of each group.

    Equal scores rank by ascending item. An item that occurs several times in a group counts once,
    with its highest score. Rows whose group, score or item is null do not take part. A group with
    fewer than ``n`` items keeps them all; an empty input or ``n`` of 0 gives no rows. Group and item
    may be of any type that can be ordered; NaN scores rank below all others. Other columns are
    ignored, whatever their names.
    """
    picked = df.select(F.col(group).alias("g__"), F.col(item).alias("id__"), F.col(score).alias("score__")).where("g__ IS NOT NULL AND id__ IS NOT NULL AND score__ IS NOT NULL")
    if n < 1:
        picked = picked.limit(0)
    local = map_arrow(picked, _heaps(n), picked.schema)
    merged = map_arrow(local.repartition(partitions_for(picked), "g__").sortWithinPartitions("g__"), _merged(n), picked.schema)
    return merged.select(F.col("g__").alias(group), F.col("id__").alias(item), F.col("score__").alias(score))
