"""Document collections and their validation rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F, types as T

STRING, INT, DATE = T.StringType(), T.IntegerType(), T.TimestampType()
STRINGS = T.ArrayType(T.StringType())


@dataclass(frozen=True)
class Rules:
    """Required fields and the types of all typed fields; ids are strings."""

    required: Sequence[str]
    types: Mapping[str, T.DataType]


# Field names, types and required fields of the three collections.
COLLECTIONS = {
    "corpus": Rules(
        ("corpusName", "text"),
        {"corpusName": STRING, "text": STRING, "source": STRING, "date": DATE},
    ),
    "clusters": Rules(
        ("corpusName", "clusterNo", "clusteringName"),
        {
            "corpusName": STRING,
            "clusterNo": INT,
            "childClusterings": STRINGS,
            "childItems": STRINGS,
            "annotations": STRINGS,
        },
    ),
    "codes": Rules(
        ("codeSet", "codeName"),
        {"codeSet": STRING, "codeName": STRING, "children": STRINGS, "codeDesc": STRING},
    ),
}


def validation_errors(df: DataFrame, kind: str | Rules):
    """``array<string>`` Column naming what is wrong with each row; empty for a valid one."""
    rules = COLLECTIONS[kind] if isinstance(kind, str) else kind
    problems = []
    for name in rules.required:
        if name not in df.columns:
            problems.append(F.lit(f"{name} is missing"))
        else:
            problems.append(F.when(F.col(name).isNull(), f"{name} is missing"))
    for name, wanted in rules.types.items():
        if name in df.columns and not _fits(df.schema[name].dataType, wanted):
            problems.append(F.when(F.col(name).isNotNull(), f"{name} is not {wanted.simpleString()}"))
    return F.filter(F.array(*problems), lambda p: p.isNotNull())


def _fits(actual: T.DataType, wanted: T.DataType) -> bool:
    if isinstance(wanted, T.ArrayType):
        return isinstance(actual, T.ArrayType) and _fits(actual.elementType, wanted.elementType)
    if isinstance(wanted, T.IntegerType):
        return isinstance(actual, (T.ByteType, T.ShortType, T.IntegerType))
    if isinstance(wanted, T.TimestampType):
        return isinstance(actual, (T.TimestampType, T.TimestampNTZType, T.DateType))
    return isinstance(actual, type(wanted))


def validate_collection(df: DataFrame, kind: str | Rules) -> tuple[DataFrame, DataFrame]:
    """Split into valid rows and rejected rows; the latter carry ``_errors``."""
    checked = df.withColumn("_errors", validation_errors(df, kind))
    return checked.where(F.size("_errors") == 0).drop("_errors"), checked.where(F.size("_errors") > 0)


def require_valid(df: DataFrame, kind: str | Rules) -> DataFrame:
    """The rows themselves; the first bad one stops the job that reads them."""
    errors = validation_errors(df, kind)
    names = F.array_join(errors, "; ")
    checked = df.where(F.when(F.size(errors) == 0, True).otherwise(F.raise_error(names).cast("boolean")))
    return checked
