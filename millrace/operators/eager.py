"""Joins followed by aggregation, computed on pre-aggregated inputs.

A join on a key that holds most of the rows of one side makes one task produce most of the joined
rows. Where only aggregates of the join are wanted, the join need not be built: both inputs are
aggregated by the join key first (with map-side combining, so that a hot key leaves every map task
as a single row), the compact states are joined, and the algebra of the aggregates gives the value
over the joined rows::

    COUNT(*)     = rows_left * rows_right
    SUM(left.x)  = sum_left(x) * rows_right
    SUM(right.y) = sum_right(y) * rows_left
    MIN/MAX      = MIN/MAX of the side the column comes from
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_KINDS = ("count", "sum", "min", "max")
#: aggregate name -> (kind, input column); ``("count", "*")`` counts joined rows.
Aggregates = Mapping[str, tuple[str, str]]


def _state(df: DataFrame, side: str, key: str, group: Sequence[str], aggs: Aggregates) -> DataFrame:
    """One row per (key, group) with the compact aggregation state of ``side``."""
    picked = [F.col(key).alias(f"{side}__key"), *(F.col(g).alias(f"{side}__g{i}") for i, g in enumerate(group))]
    values = {}
    for name, (kind, column) in aggs.items():
        if kind not in _KINDS:
            raise ValueError(f"unknown aggregate {kind!r}; one of {_KINDS}")
        if column != "*":
            values[name] = (kind, f"{side}__v{len(values)}")
            picked.append(F.col(column).alias(values[name][1]))
    out = [F.count(F.lit(1)).alias(f"{side}__rows")]
    for name, (kind, column) in values.items():
        out.append(getattr(F, kind)(column).alias(f"{side}__a_{name}"))
    return df.select(*picked).groupBy(f"{side}__key", *(f"{side}__g{i}" for i in range(len(group)))).agg(*out)


def eager_join_aggregate(
    left: DataFrame,
    right: DataFrame,
    on: tuple[str, str],
    left_aggs: Aggregates | None = None,
    right_aggs: Aggregates | None = None,
    left_group: Sequence[str] = (),
    right_group: Sequence[str] = (),
    how: str = "inner",
    key_name: str = "key",
) -> DataFrame:
    """Aggregates of ``left JOIN right ON left.k = right.k`` without building the join.

    The result has one row per join key and per combination of ``left_group``/``right_group``
    columns: ``key_name``, the group columns, ``joined_rows`` and one column for each aggregate.
    ``rollup`` sums such rows up further. ``how`` is ``inner`` or ``left``.

    Null keys match nothing: they vanish from an inner join and form one row of a left join.
    An empty input gives no rows. Values that are null are skipped by COUNT, SUM, MIN and MAX, and
    SUM, MIN and MAX over nothing but nulls are null. Rows that occur several times count several
    times, as in the join. Other columns, whatever their names, are ignored.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be 'inner' or 'left'")
    left_aggs, right_aggs = dict(left_aggs or {}), dict(right_aggs or {})
    l_state = _state(left, "l", on[0], left_group, left_aggs)
    r_state = _state(right, "r", on[1], right_group, right_aggs)
    joined = l_state.join(r_state, F.col("l__key") == F.col("r__key"), how)
    l_rows = F.col("l__rows")
    #: an unmatched left row stands once in a left join
    r_rows = F.coalesce(F.col("r__rows"), F.lit(1)) if how == "left" else F.col("r__rows")

    def scaled(side: str, name: str, kind: str, column: str, times: Column) -> Column:
        if column == "*":
            return l_rows * r_rows if side == "l" or how == "inner" else l_rows * F.coalesce("r__rows", F.lit(0))
        state = F.col(f"{side}__a_{name}")
        if kind == "count":
            return F.coalesce(state, F.lit(0)) * times
        return state * times if kind == "sum" else state

    out = [F.col("l__key").alias(key_name)]
    out += [F.col(f"l__g{i}").alias(g) for i, g in enumerate(left_group)]
    out += [F.col(f"r__g{i}").alias(g) for i, g in enumerate(right_group)]
    out.append((l_rows * r_rows).alias("joined_rows"))
    out += [scaled("l", n, *spec, r_rows).alias(n) for n, spec in left_aggs.items()]
    out += [scaled("r", n, *spec, l_rows).alias(n) for n, spec in right_aggs.items()]
    return joined.select(*out)


def rollup(states: DataFrame, by: Sequence[str], aggs: Mapping[str, str]) -> DataFrame:
    """Combine rows of ``eager_join_aggregate`` by fewer columns.

    ``aggs`` names the kind of each column: ``count`` and ``sum`` add up, ``min`` and ``max`` keep
    the extreme. Null group values form a group of their own.
    """
    combine = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}
    return states.groupBy(*by).agg(*(combine[kind](name).alias(name) for name, kind in aggs.items()))


def heavy_keys(states: DataFrame, key: str, share: float) -> DataFrame:
    """Keys of ``eager_join_aggregate`` that hold at least ``share`` of all joined rows.

    Null keys count in the total but are never returned. No rows in, no rows out.
    """
    total = states.agg(F.coalesce(F.sum("joined_rows"), F.lit(0)).alias("n")).scalar()
    # a filter on the key itself would be pushed into the scan, and the total could not share it
    by_key = states.groupBy(key).agg(F.sum("joined_rows").alias("joined_rows"), F.max(F.col(key).isNotNull()).alias("known__"))
    return by_key.where(F.col("known__") & (F.col("joined_rows") >= F.lit(float(share)) * total)).select(key, "joined_rows")
