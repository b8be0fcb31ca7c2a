"""Positions in a distributed sort: what stands before each row of a sorted, weighted table.

The rows are range-partitioned and sorted by (group, ...) and written once, so that the partitions no
longer change. Only the first and the last group of a partition can go on in another one; their weights,
and those of groups that are too large to be held at a time, are all the driver sees: two rows per
partition, and one for every ``CHUNK_ROWS`` rows. From them follows how much of a partition's first group
stands before it and how much these groups hold altogether. Partitions are then read as a stream of
chunks, each of whole groups or of a piece of a large one, so that no partition is ever held.

Rows of weight 0 are marks: they take no place. Marks that sort before a group's other rows can be
handed on (``carry``) to the other partitions that hold the group.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.taskcontext import TaskContext

from millrace.session import cut_lineage, map_arrow, partitions_for

#: rows held at a time
CHUNK_ROWS = 1 << 20


@dataclass(frozen=True)
class Places:
    """Of the rows of a chunk: group starts, weight before each row in its group, weight of each row, total of each group."""

    starts: np.ndarray
    before: np.ndarray
    weights: np.ndarray
    totals: np.ndarray

    @property
    def group_of_row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.starts)), np.diff(np.append(self.starts, len(self.before))))

    def rows_at(self, group: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the places (in the groups with these numbers) lie in the chunk, and in which rows."""
        first = self.before[self.starts]
        ends = np.append(self.starts[1:], len(self.before)) - 1
        size = self.before[ends] + self.weights[ends] - first
        here = np.flatnonzero((place >= first[group]) & (place < first[group] + size[group]))
        # places ascend within a group and rows over groups: one search for all
        base = np.cumsum(size) - size
        end_of_row = self.before + self.weights - (first - base)[self.group_of_row]
        g, p = group[here], place[here]
        return here, np.searchsorted(end_of_row, base[g] + p - first[g], side="right")


@dataclass
class _Edges:
    #: weight of a partition's first group that stands before it, and the marks carried into it
    before: dict[int, int] = field(default_factory=dict)
    carried: dict[int, list] = field(default_factory=dict)
    #: totals of all groups that may not be whole in a chunk
    totals: dict[str, int] = field(default_factory=dict)


def starts_of_groups(table: pa.Table, group: Sequence[str]) -> np.ndarray:
    """Index of the first row of each run of equal ``group`` columns; nulls are equal to nulls."""
    n = table.num_rows
    new = np.zeros(n, dtype=bool)
    new[0] = True
    for name in group:
        column = table.column(name).combine_chunks()
        differs = pc.fill_null(pc.not_equal(column.slice(1), column.slice(0, n - 1)), False).to_numpy(zero_copy_only=False)
        nulls = pc.is_null(column).to_numpy(zero_copy_only=False)
        new[1:] |= differs | (nulls[1:] != nulls[:-1])
    return np.flatnonzero(new)


def sort_once(df: DataFrame, group: Sequence[str], then: Sequence[str]) -> DataFrame:
    """``df`` range-partitioned and sorted by group and ``then``, written to the shared folder."""
    order = [*group, *then]
    return cut_lineage(df.repartitionByRange(partitions_for(df), *order).sortWithinPartitions(*order))


def _key(table: pa.Table, group: Sequence[str], row: int) -> str:
    return repr([table[g][row].as_py() for g in group])


def _edges_of_partition(group: Sequence[str], weight: str, carry: Sequence[str]):
    schema = pa.schema([("pid", pa.int32()), ("place", pa.int32()), ("key", pa.string()), ("weight", pa.int64()), ("marks", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        #: key, weight, rows and marks of the group that is being read, and its number
        key, total, rows, marks, number = None, 0, 0, [], -1
        out: list[tuple] = []

        def close(last: bool) -> None:
            if number == 0 or last or rows >= CHUNK_ROWS:
                out.append((TaskContext.get().partitionId(), number, key, total, pickle.dumps(marks) if last and marks else None))

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            starts = starts_of_groups(table, group)
            weights = table[weight].to_numpy().astype(np.int64)
            sums, sizes = np.add.reduceat(weights, starts), np.diff(np.append(starts, len(weights)))
            # groups between the first and the last of a batch are small and whole
            for i in sorted({0, len(starts) - 1}):
                now = _key(table, group, int(starts[i]))
                if now != key:
                    if key is not None:
                        close(False)
                    number += 1 if i == 0 or len(starts) < 3 else len(starts) - 1
                    key, total, rows, marks = now, 0, 0, []
                total, rows = total + int(sums[i]), rows + int(sizes[i])
                if carry and (i == len(starts) - 1):
                    piece = table.slice(int(starts[i]), int(sizes[i]))
                    marks += piece.filter(pc.equal(piece[weight], 0)).select(carry).to_pylist()
        if key is not None:
            close(True)
            yield pa.RecordBatch.from_pydict({n: [r[i] for r in out] for i, n in enumerate(schema.names)}, schema=schema)

    return run


def _edges(ordered: DataFrame, group: Sequence[str], weight: str, carry: Sequence[str]) -> _Edges:
    picked = ordered.select(*dict.fromkeys([*group, weight, *carry]))
    rows = map_arrow(picked, _edges_of_partition(group, weight, carry), "pid int, place int, key string, weight bigint, marks binary").collect()
    out, marks = _Edges(), {}
    for r in rows:
        out.totals[r.key] = out.totals.get(r.key, 0) + r.weight
    seen: dict[str, int] = {}
    for r in sorted(rows, key=lambda r: (r.pid, r.place)):
        if r.place == 0:
            out.before[r.pid] = seen.get(r.key, 0)
            if marks.get(r.key):
                out.carried[r.pid] = list(marks[r.key])
        seen[r.key] = seen.get(r.key, 0) + r.weight
        if r.marks is not None:
            marks = {r.key: [*marks.get(r.key, []), *pickle.loads(r.marks)]}
    return out


def map_groups(ordered: DataFrame, group: Sequence[str], weight: str, make: Callable[[list], Callable[[pa.Table, Places], pa.Table]], schema: str, carry: Sequence[str] = ()) -> DataFrame:
    """``fn(chunk, places)`` for all chunks of ``ordered`` (of ``sort_once``), in order within a partition.

    ``make(marks)`` gives a new ``fn`` for each partition; ``marks`` are the ``carry`` columns of marks that
    stand in earlier partitions in the group this partition begins with. The driver collects the edges.
    """
    edges = ordered.sparkSession.sparkContext.broadcast(_edges(ordered, group, weight, carry))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        known = edges.value
        fn = make(known.carried.get(pid, []))
        #: what stands before the next row if it belongs to the group ``last``; None before the first chunk
        offset, last = known.before.get(pid, 0), None

        def step(table: pa.Table, starts: np.ndarray) -> pa.Table:
            nonlocal offset, last
            weights = table[weight].to_numpy().astype(np.int64)
            first, final = _key(table, group, 0), _key(table, group, int(starts[-1]))
            start = offset if last in (None, first) else 0
            running = np.cumsum(weights) - weights
            shift = running[starts].copy()
            shift[0] -= start
            before = running - np.repeat(shift, np.diff(np.append(starts, len(weights))))
            totals = np.add.reduceat(weights, starts)
            totals[0], totals[-1] = known.totals.get(first, totals[0]), known.totals.get(final, totals[-1])
            offset, last = int(before[-1] + weights[-1]), final
            return fn(table, Places(starts, before, weights, totals))

        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= CHUNK_ROWS:
                table = pa.Table.from_batches(held)
                starts = starts_of_groups(table, group)
                # the last group is kept until it is whole, unless it is all there is
                cut = int(starts[-1]) or rows
                rest = table.slice(cut).combine_chunks()
                yield from step(table.slice(0, cut), starts[starts < cut]).to_batches()
                held, rows = rest.to_batches(), rest.num_rows
        if rows:
            table = pa.Table.from_batches(held)
            yield from step(table, starts_of_groups(table, group)).to_batches()

    return map_arrow(ordered, run, schema)
