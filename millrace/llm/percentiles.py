"""Percentiles of groups by a full distributed sort with per-partition counts.

Equal values of a group are combined to one weighted row, the rows are sorted by (group, value) over all
partitions, each partition counts what it holds, and the counts give the places of every row in its
group. Target places are then located, and percentiles interpolated between the two neighbouring order
statistics; all of it is exact.

Input may be rows or weighted values, so results of separate parts can be put together later: ``piece``
condenses each part to at most ``1 / (2 * error)`` weighted values per group, whose ranks are off by at
most ``error`` of the part, and percentiles over the union of pieces are off by at most ``error`` of
the whole. An ``error`` of 0 keeps each distinct value with its number and loses nothing.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import ordered


def known_values(df: DataFrame, group: Sequence[str], value: str, key: str | None = None, weight: str | None = None) -> DataFrame:
    """Group columns, ``value``, ``weight``: the rows that take part, each ``key`` once.

    Rows without a value do not take part. Repeated rows (equal in group, value and key) are combined
    before the shuffle, so that neither many copies nor a large group reach one task. Weights below one
    do not count.
    """
    picked = df.where(F.col(value).isNotNull())
    if key is not None:
        return picked.select(*group, value, key).distinct().withColumn("weight", F.lit(1).cast("long"))
    w = F.lit(1) if weight is None else F.col(weight)
    return picked.select(*group, value, w.cast("long").alias("weight")).where("weight > 0")


def _combined(rows: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """One row for each distinct value of a group, combined before anything is sorted: a value that most rows have is one row per task."""
    return rows.groupBy(*group, value).agg(F.sum("weight").alias("weight"))


def percentiles(rows: DataFrame, group: Sequence[str], value: str, fractions: Sequence[float]) -> DataFrame:
    """Group columns, ``n``, ``fraction``, ``percentile`` (double) from ``known_values`` or pieces.

    The percentile at fraction f of n values is found at place f * (n - 1) of the sorted values,
    interpolated linearly between its neighbours. Null group values form a group of their own; groups
    without values and empty inputs give no rows; NaN counts as larger than any number. Equal values
    are as many values as rows. Names of other columns do not matter, they are dropped.
    """
    fs = [float(f) for f in fractions]
    if any(not 0 <= f <= 1 for f in fs):
        raise ValueError("fractions must lie between 0 and 1")
    run = ordered.sort_once(_combined(rows, group, value), group, [value])
    names = [*group]
    types = dict(rows.dtypes)

    def locate(table: pa.Table, at: ordered.Places) -> pa.Table:
        values = table[value].to_numpy().astype(np.float64)
        every = np.arange(len(at.starts))
        rows_, part, frac, total = [], [], [], []
        for f in fs:
            place = f * (at.totals - 1)
            low = np.floor(place).astype(np.int64)
            share = place - low
            for k, p in ((low, 1 - share), (np.minimum(low + 1, at.totals - 1), share)):
                some = np.flatnonzero(p > 0)
                here, row = at.rows_at(every[some], k[some])
                g = some[here]
                rows_.append(row), part.append(p[g]), frac.append(np.full(len(g), f)), total.append(at.totals[g])
        row = np.concatenate(rows_)
        out = table.select(names).take(pa.array(row))
        return (
            out.append_column("n", pa.array(np.concatenate(total))).append_column("fraction", pa.array(np.concatenate(frac)))
            .append_column("part", pa.array(np.concatenate(part))).append_column("value__", pa.array(values[row]))
        )

    schema = ", ".join([*(f"`{g}` {types[g]}" for g in names), "n bigint, fraction double, part double, value__ double"])
    found = ordered.map_groups(run.select(*names, value, "weight"), group, "weight", lambda _: locate, schema)
    # the two neighbours may come from two partitions
    return found.groupBy(*names, "n", "fraction").agg(F.sum(F.col("part") * F.col("value__")).alias("percentile"))


def piece(rows: DataFrame, part: Sequence[str], group: Sequence[str], value: str, error: float = 0.0) -> DataFrame:
    """Condensed parts of the data: part and group columns, ``value``, ``weight``.

    ``rows`` come from ``known_values`` with the part columns among its groups. With ``error`` 0 each
    distinct value is kept with its weight. Otherwise a part's group of n values is cut into
    m = ceil(1 / (2 * error)) stretches of equal weight, each represented by the value in its middle;
    groups of at most m values are kept as they are. Empty input gives no rows.
    """
    if error <= 0:
        return rows.groupBy(*part, *group, value).agg(F.sum("weight").alias("weight"))
    m = math.ceil(1 / (2 * error))
    names = [*part, *group]
    run = ordered.sort_once(_combined(rows, names, value), names, [value])
    types = dict(rows.dtypes)

    def condense(table: pa.Table, at: ordered.Places) -> pa.Table:
        total = at.totals[at.group_of_row]
        before, after = at.before, at.before + at.weights
        stretches = np.minimum(total, m)
        # middles of stretches s lie at (s + 1/2) * total / stretches; a row stands for those within it
        below = lambda x: -((total - 2 * x * stretches) // (2 * total))
        first, end = below(before), below(after)
        edge = lambda s: s * total // stretches
        weight = edge(end) - edge(first)
        out = table.select([*names, value]).append_column("weight", pa.array(weight))
        return out.filter(pa.array(weight > 0))

    schema = ", ".join([*(f"`{g}` {types[g]}" for g in names), f"`{value}` {types[value]}", "weight bigint"])
    return ordered.map_groups(run.select(*names, value, "weight"), names, "weight", lambda _: condense, schema)


def _below(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a < b`` with NaN as the largest number."""
    return (a < b) | (np.isnan(b) & ~np.isnan(a))


def misfits(rows: DataFrame, group: Sequence[str], value: str, buckets: DataFrame, number: str, bound: str, fraction: str, tolerance: float) -> DataFrame:
    """Buckets of a stored histogram whose bound does not fit the data: group columns and ``number``.

    A bucket misfits if its cumulative fraction lies more than ``tolerance`` below the fraction of
    values smaller than its bound, or above the fraction of values up to it. That is decided at two places
    of the sorted group: the bound is too high if it lies above the order statistic that ``tolerance``
    more than the bucket's fraction of the values end with, and too low if it lies below the one after those
    that ``tolerance`` less of them end with. These places are whole numbers, so the order statistics
    themselves are compared and nothing lies between two neighbours.

    Buckets take part in the sort as marks before the values of their group. Buckets with a null bound or
    fraction, and buckets of groups without values, never misfit. Repeated buckets come out once.
    """
    names = [*group]
    types = dict(rows.dtypes)
    kind = dict(buckets.dtypes)[number]
    body = _combined(rows, group, value).select(*names, F.col(value).cast("double").alias("v__"), F.lit(None).cast(kind).alias("number__"), F.lit(None).cast("double").alias("b__"), F.lit(None).cast("double").alias("f__"), "weight")
    marks = buckets.select(*(F.col(g).cast(types[g]).alias(g) for g in names), F.lit(None).cast("double").alias("v__"), F.col(number).alias("number__"), F.col(bound).cast("double").alias("b__"), F.col(fraction).cast("double").alias("f__"), F.lit(0).cast("long").alias("weight"))
    marks = marks.where("b__ IS NOT NULL AND f__ IS NOT NULL").distinct()
    # a null value sorts before all others
    run = ordered.sort_once(body.unionByName(marks), group, ["v__", "number__", "b__", "f__"])
    mark_columns = ["number__", "b__", "f__"]

    def make(carried: list):
        #: marks of the group that the last chunk ended with, or that the partition begins with
        state = {"key": None, "marks": carried}

        def locate(table: pa.Table, at: ordered.Places) -> pa.Table:
            own = table.select(mark_columns).append_column("group__", pa.array(at.group_of_row)).filter(pa.array(at.weights == 0))
            first = [table[g][0].as_py() for g in names]
            went_on = state["marks"] if state["key"] in (None, repr(first)) else []
            earlier = pa.Table.from_pylist([m | {"group__": 0} for m in went_on], schema=own.schema)
            asked = pa.concat_tables([earlier, own])
            new = np.arange(asked.num_rows) >= earlier.num_rows
            g, b, f = (asked[c].to_numpy() for c in ("group__", "b__", "f__"))
            final = len(at.starts) - 1
            state["key"] = repr([table[c][int(at.starts[-1])].as_py() for c in names])
            state["marks"] = asked.filter(pa.array(g == final)).select(mark_columns).to_pylist()
            n = at.totals[g]
            size = np.maximum(n, 1)
            #: least number of values below the bound, and most values up to it, at which it misfits; of the numbers around, the exact ones
            least, most = np.floor((f + tolerance) * size) + 2, np.floor((f - tolerance) * size) - 2
            for d in (1, 0, -1):
                k = np.floor((f + tolerance) * size) + d
                least = np.where(f < k / size - tolerance, k, least)
                k = np.floor((f - tolerance) * size) - d
                most = np.where(f > k / size + tolerance, k, most)
            least, most = least.astype(np.int64), most.astype(np.int64)
            wrong = new & (n > 0) & ((least <= 0) | (most >= n))
            values = table["v__"].to_numpy()
            for place, high in ((least - 1, True), (most, False)):
                some = np.flatnonzero((place >= 0) & (place < n))
                here, row = at.rows_at(g[some], place[some])
                x = some[here]
                wrong[x] |= _below(values[row], b[x]) if high else _below(b[x], values[row])
            hit = np.flatnonzero(wrong)
            out = table.select(names).take(pa.array(at.starts[g[hit]]))
            return out.append_column("number__", asked["number__"].take(pa.array(hit)))

        return locate

    schema = ", ".join([*(f"`{g}` {types[g]}" for g in names), f"number__ {kind}"])
    found = ordered.map_groups(run, group, "weight", make, schema, mark_columns)
    # the two places of a bucket may lie in two partitions
    return found.select(*names, F.col("number__").alias(number)).distinct()
