"""Group counts, column sums and group-wise text concatenation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

CHUNK_ROWS = 1024


def _names(columns: str | Sequence[str]) -> list[str]:
    return [columns] if isinstance(columns, str) else list(columns)


def group_count(df: DataFrame, columns: str | Sequence[str]) -> DataFrame:
    """Size of each group; rows with a null in a group column are left out."""
    keys = _names(columns)
    return _with_keys(df, keys).groupBy(*keys).count()


def _with_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are set. Keys that cannot be null need no filter, which matters when they are
    costly expressions: a filter is pushed down to the scan and evaluates them a second time."""
    nullable = [k for k in keys if df.schema[k].nullable]
    return df.dropna(subset=nullable) if nullable else df


def column_sums(df: DataFrame, columns: str | Sequence[str]) -> DataFrame:
    """Sum of each column as rows ``(cols, count)``."""
    names = _names(columns)
    sums = df.agg(*[F.sum(c).alias(c) for c in names])
    return sums.unpivot([], names, "cols", "count")


def group_concat(
    df: DataFrame,
    by: str | Sequence[str],
    text_cols: str | Sequence[str],
    order_by: str,
    delim: str = ", ",
) -> DataFrame:
    """Texts of each group joined in ``order_by`` order; null and empty texts are skipped.

    ``order_by`` is a ``bigint`` row id. Texts are joined per run of 1,024 consecutive ids first, so
    sorting a hot group is shared by many tasks and the last step only strings finished chunks
    together. A group whose whole text cannot be one cell is served by ``group_concat_parts``.
    """
    keys, texts = _names(by), _names(text_cols)
    parts = group_concat_parts(df, keys, texts, order_by, delim)
    # A chunk with no text at all is null here and skipped by listagg.
    return parts.groupBy(*keys).agg(
        *[F.coalesce(F.expr(_joined(c, delim, "part")), F.lit("")).alias(c) for c in texts]
    )


def group_concat_parts(
    df: DataFrame,
    by: str | Sequence[str],
    text_cols: str | Sequence[str],
    order_by: str,
    delim: str = ", ",
    rows_per_part: int = CHUNK_ROWS,
) -> DataFrame:
    """The same texts in pieces ``(by…, part, texts…)``; pieces in ``part`` order make up the group."""
    keys, texts = _names(by), _names(text_cols)
    part = F.floor(F.col(order_by) / rows_per_part).cast("bigint")
    rows = _with_keys(df, keys).select(*keys, part.alias("part"), F.col(order_by).alias("__order"), *texts)
    return rows.groupBy(*keys, "part").agg(
        *[F.expr(_joined(c, delim, "__order", f"`{c}` != ''")).alias(c) for c in texts]
    )


def _joined(column: str, delim: str, order: str, condition: str | None = None) -> str:
    literal = delim.replace("\\", "\\\\").replace("'", "\\'")
    filtered = f" FILTER (WHERE {condition})" if condition else ""
    return f"listagg(`{column}`, '{literal}') WITHIN GROUP (ORDER BY `{order}`){filtered}"
