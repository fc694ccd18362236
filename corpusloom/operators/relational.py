"""Filter, join, column append and row ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.runtime import durable, fits_broadcast

JOIN_TYPES = ("inner", "left", "right", "outer")

_ROW = "__row"
_PLACE = "__place"
_LOCAL_BITS = 33  # low bits of monotonically_increasing_id hold the position inside its partition


def filter_view(df: DataFrame, predicate: str | Column, sort_columns: bool = False) -> DataFrame:
    """Rows for which a SQL expression or Column is true."""
    kept = df.where(F.expr(predicate) if isinstance(predicate, str) else predicate)
    return kept.select(*sorted(df.columns)) if sort_columns else kept


def filter_mapper(df: DataFrame, predicate: str | Column, id_col: str) -> DataFrame:
    """New position -> old row id of the rows that pass, as ``(new_id, old_id)``."""
    kept = filter_view(df, predicate).select(F.col(id_col).alias("old_id"))
    return with_row_id(kept, order_by="old_id", name="new_id").select("new_id", "old_id")


def with_row_id(df: DataFrame, order_by: str | Sequence[str] | None = None, name: str = "row_id") -> DataFrame:
    """Add a contiguous 0..n-1 ``bigint``.

    Rows are numbered inside each partition and shifted by the sizes of the partitions before it, so no
    task sees more than its own partition. The numbered rows are checkpointed, because counting and
    shifting must see the very same partitions even when an executor is lost in between. With
    ``order_by`` (unique values) the order is global; without it rows are numbered as they are read.
    """
    keys = [order_by] if isinstance(order_by, str) else list(order_by or [])
    arranged = df.orderBy(*keys) if keys else df
    numbered = durable(arranged.withColumn(_PLACE, F.monotonically_increasing_id()))
    part = F.shiftright(_PLACE, _LOCAL_BITS)
    # One row per partition: bounded by the partition count, so one window task and a broadcast are safe.
    sizes = numbered.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    local = F.col(_PLACE).bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    return (
        numbered.withColumn("__part", part)
        .join(F.broadcast(offsets), "__part")
        .withColumn(name, F.col("__offset") + local)
        .drop("__part", "__offset", _PLACE)
    )


def join_views(
    left: DataFrame,
    right: DataFrame,
    left_cols: Sequence[str],
    right_cols: Sequence[str] | None = None,
    how: str = "inner",
) -> DataFrame:
    """Equi join; key columns keep their left names and null keys match each other.

    Other columns present on both sides get the suffixes ``_x`` and ``_y``. A hot key must not end in
    one task: adaptive execution splits skewed partitions of an inner join on both sides, but not the
    null-supplying side of an outer join. Unless that side is small enough to broadcast, an outer join
    therefore runs as the inner join plus the rows without partner, found by an anti join against the
    other side's distinct keys.
    """
    keys, right_keys = list(left_cols), list(right_cols if right_cols is not None else left_cols)
    if len(keys) != len(right_keys):
        raise ValueError("each left key needs one right key")
    if how not in JOIN_TYPES:
        raise ValueError(f"join type must be one of {JOIN_TYPES}")
    renamed = dict(zip(right_keys, keys))
    right_rest = [c for c in right.columns if c not in renamed]
    left_rest = [c for c in left.columns if c not in keys]
    shared = set(left_rest) & set(right_rest)
    left_out = {c: f"{c}_x" if c in shared else c for c in left_rest}
    right_out = {c: f"{c}_y" if c in shared else c for c in right_rest}

    l_side = left.select(
        *[F.col(k).alias(f"__l_{k}") for k in keys], *[F.col(c).alias(f"__lv_{c}") for c in left_rest]
    )
    r_side = right.select(
        *[F.col(r).alias(f"__r_{k}") for r, k in renamed.items()], *[F.col(c).alias(f"__rv_{c}") for c in right_rest]
    )
    on = _null_safe(l_side, r_side, [(f"__l_{k}", f"__r_{k}") for k in keys])

    def shape(joined: DataFrame) -> DataFrame:
        """Final columns; a side that is absent reads as null."""
        present = set(joined.columns)
        out = []
        for k in keys:
            sides = [F.col(c) for c in (f"__l_{k}", f"__r_{k}") if c in present]
            out.append(F.coalesce(*sides).alias(k))
        for rest, prefix, source, side in ((left_out, "__lv_", left, l_side), (right_out, "__rv_", right, r_side)):
            for c, name in rest.items():
                value = F.col(prefix + c) if prefix + c in present else F.lit(None).cast(source.schema[c].dataType)
                out.append(value.alias(name))
        return joined.select(*out)

    if how == "inner":
        return shape(l_side.join(r_side, on, "inner"))
    if how == "left" and fits_broadcast(right):
        return shape(l_side.join(r_side, on, "left"))
    if how == "right" and fits_broadcast(left):
        return shape(l_side.join(r_side, on, "right"))

    result = shape(l_side.join(r_side, on, "inner"))
    if how in ("left", "outer"):
        result = result.unionByName(shape(_without_partner(l_side, r_side, "__l_", "__r_", keys)))
    if how in ("right", "outer"):
        result = result.unionByName(shape(_without_partner(r_side, l_side, "__r_", "__l_", keys)))
    return result


def _null_safe(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    condition = F.lit(True)
    for a, b in pairs:
        condition = condition & left[a].eqNullSafe(right[b])
    return condition


def _without_partner(df: DataFrame, other: DataFrame, own: str, foreign: str, keys: Sequence[str]) -> DataFrame:
    # Distinct keys are combined map-side, so a hot key adds one row per task here.
    other_keys = other.select(*[f"{foreign}{k}" for k in keys]).distinct()
    on = _null_safe(df, other_keys, [(f"{own}{k}", f"{foreign}{k}") for k in keys])
    return df.join(other_keys, on, "left_anti")


def append_column(
    source: DataFrame,
    target: DataFrame,
    col: str,
    new_name: str | None = None,
    on: str | None = None,
    order_source: str | Sequence[str] | None = None,
    order_target: str | Sequence[str] | None = None,
    overwrite: bool = False,
) -> DataFrame:
    """Copy a column of ``source`` into ``target``, by key ``on`` or, without one, by row position.

    Both tables must hold the same rows: a key or position found on one side only raises while the
    result is computed, as does a key found twice in either table.
    """
    name = new_name or col
    if name in target.columns and not overwrite:
        raise ValueError(f"column {name} exists; pass overwrite=True to replace it")
    base = target.drop(name) if name != on else target
    if on is None:
        values = with_row_id(source, order_source, _ROW).select(_ROW, F.col(col).alias("__value"))
        rows = with_row_id(base, order_target, _ROW)
        key = _ROW
    else:
        key = on
        values = source.groupBy(on).agg(F.first(col).alias("__value"), F.count(F.lit(1)).alias("__here"))
        there = base.groupBy(on).agg(F.count(F.lit(1)).alias("__there"))
        values = values.join(there, on, "left").withColumn("__copies", F.greatest("__here", "__there")).drop("__here", "__there")
        rows = base
    matched = rows.withColumn("__in_target", F.lit(True)).join(
        values.withColumn("__in_source", F.lit(True)), key, "full_outer"
    )
    complete = F.col("__in_target").isNotNull() & F.col("__in_source").isNotNull()
    if on is not None:
        complete = complete & (F.col("__copies") == 1)
    value = F.when(complete, F.col("__value")).otherwise(
        F.raise_error(F.lit("a row has no partner, or more than one, in the other table")).cast(source.schema[col].dataType)
    )
    columns = [c for c in base.columns if c != name]
    return matched.select(*columns, value.alias(name))
