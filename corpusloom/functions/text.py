"""Tokens, whitespace, text concatenation and in-row prefix sums."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F

# Runs of word characters, spelled out because \w is ASCII-only in Java regex.
WORD_CLASS = r"[\p{L}\p{N}_]"

_CHUNK = 256


def tokens(text: Column, min_length: int = 2) -> Column:
    """Lower-cased runs of at least ``min_length`` word characters."""
    pattern = f"{WORD_CLASS}{{{min_length},}}"
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def normalize_whitespace(text: Column) -> Column:
    """Every run of white space becomes one blank."""
    return F.regexp_replace(text, r"(?U)\s+", " ")


def lowercase(text: Column) -> Column:
    return F.lower(text)


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def combine_text(columns: Sequence[str | Column], delim: str = "", skip_nulls: bool = False) -> Column:
    """Join several columns as text; a null prints as ``None`` unless ``skip_nulls``."""
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    parts = [c.cast("string") for c in cols]
    if not skip_nulls:
        parts = [F.coalesce(p, F.lit("None")) for p in parts]
    return F.concat_ws(delim, *parts)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def running_total(lengths: Column) -> Column:
    """Exclusive prefix sums of an ``array<int>``, as ``array<bigint>``.

    Appending to an array copies it, so sums are built per chunk of 256 elements and the chunks are
    shifted afterwards; the copying stays linear in the array length.
    """

    def fold(items: Column, value) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("total"), F.array().cast("array<bigint>").alias("before"))
        return F.aggregate(
            items,
            start,
            lambda acc, x: F.struct(
                (acc["total"] + value(x)).alias("total"),
                F.array_append(acc["before"], acc["total"]).alias("before"),
            ),
        )

    chunk_ids = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(lengths) / _CHUNK).cast("int") - 1, F.lit(0)))
    chunks = F.transform(chunk_ids, lambda c: fold(F.slice(lengths, c * _CHUNK + 1, _CHUNK), lambda x: x))
    return let(
        chunks,
        lambda parts: F.flatten(
            F.zip_with(
                parts,
                fold(parts, lambda p: p["total"])["before"],
                lambda p, base: F.transform(p["before"], lambda x: x + base),
            )
        ),
    )
