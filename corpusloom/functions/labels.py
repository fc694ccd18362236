"""Label cells: several labels in one text, separated by comma or semicolon."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def parse_labels(label: Column, multilabel: bool = False) -> Column:
    """``array<string>`` of lower-cased, trimmed labels; only the first one unless ``multilabel``."""
    parts = F.transform(F.split(F.lower(label.cast("string")), "[,;]"), lambda part: F.trim(part))
    return parts if multilabel else F.slice(parts, 1, 1)
