"""Vectors are ``array<double>``; text files hold them as JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T


def stringify(vector: Column) -> Column:
    return F.to_json(vector)


def unstringify(text: Column, element: str = "double") -> Column:
    return F.from_json(text, f"array<{element}>")


def combine_features(df: DataFrame, columns: Sequence[str]) -> Column:
    """Array and scalar columns, row-wise flattened to one ``array<double>``."""
    parts = []
    for name in columns:
        is_array = isinstance(df.schema[name].dataType, T.ArrayType)
        parts.append((F.col(name) if is_array else F.array(F.col(name))).cast("array<double>"))
    return F.concat(*parts)
