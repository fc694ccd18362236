"""Helpers of this folder: shared storage, row keys, blobs of hashed rows."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusloom.runtime import ensure_checkpoint_dir

LAST_ID = (1 << 63) - 1
SHARED_BITS = 1 << 18
ROW_GROUP_BYTES = 16 << 20  # what a writing task holds
BATCH_ROWS = 1024  # of texts that a Python worker holds


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the cluster's checkpoint folder and read again; survives lost executors."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs run inside hand at most ``BATCH_ROWS`` rows at once to Python: whole texts weigh far more than the rows Spark expects."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    if before is None or not 0 < int(before) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def small_table(spark: SparkSession, columns: dict[str, np.ndarray], schema: str) -> DataFrame:
    """A few rows of the driver's as a DataFrame; Python rows would start Python workers on the executors to be read."""
    return spark.createDataFrame(pa.table(columns), schema)


def bitmap(values: DataFrame, bits: int = 1 << 22) -> np.ndarray:
    """One bit for each long of the only column of ``values``, by its remainder; the size is fixed by ``bits``.

    A lookup may find values that are not there, but misses none, so it can go before an exact join.
    """
    (name,) = values.columns
    bit = F.expr(f"CAST(((`{name}` % {bits}) + {bits}) % {bits} AS LONG)")  # bits divides 2**64, so signs do not matter
    words = values.where(F.col(name).isNotNull()).select(bit.alias("bit")).distinct().groupBy(F.expr("CAST(bit DIV 64 AS INT)").alias("at")).agg(
        F.expr("bit_or(shiftleft(1L, CAST(bit % 64 AS INT)))").alias("mask")
    )
    out = np.zeros(bits // 64, np.uint64)
    for row in words.collect():  # at most bits / 64 rows
        out[row["at"]] = np.int64(row["mask"]).view(np.uint64)
    return out


def may_hold(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    bit = values.view(np.uint64) % np.uint64(64 * len(bitmap))
    return (bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


def parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def doc_key(id_col: str) -> Column:
    """The id as a long; null comes after all others."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID))


def text_hash(text_col: str) -> Column:
    """64 bits of the text; with the id they tell all rows apart but those that are equal."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def row_tag(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """:func:`text_hash` for rows whose id is not theirs alone, else 0, which costs nothing to carry around.

    Shared ids are told by a bitmap of fixed size, which may find some more, but misses none. Reads the ids only.
    """
    shared = bitmap(docs.groupBy(doc_key(id_col).alias("id")).count().where("count > 1").select("id"), SHARED_BITS)
    return F.when(is_in(shared, doc_key(id_col)), text_hash(text_col)).otherwise(F.lit(0).cast("long")) if shared.any() else F.lit(0).cast("long")


def is_in(bitmap: np.ndarray, value: Column) -> Column:
    """:func:`may_hold` as a Column."""
    words = F.split(F.lit(",".join(map(str, bitmap.view(np.int64)))), ",").cast("array<bigint>")
    bit = F.pmod(value, F.lit(64 * len(bitmap)))
    return F.bit_get(F.get(words, F.shiftright(bit, 6).cast("int")), F.pmod(bit, F.lit(64)).cast("int")) == 1


def flat(column: pa.ChunkedArray, dtype=np.int64) -> np.ndarray:
    """All values of a list column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.astype(dtype) if values.dtype.itemsize != np.dtype(dtype).itemsize else values.view(dtype)


def lists(values: np.ndarray, heads: np.ndarray) -> pa.ListArray:
    """``values`` cut at ``heads`` (first index of every list)."""
    offsets = np.append(heads, len(values)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def heads_of(*keys: np.ndarray) -> np.ndarray:
    """First index of every run of equal keys; the keys are sorted."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def run_of(heads: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` sorted rows the number of its run."""
    new = np.zeros(n, np.int64)
    new[heads] = 1
    return np.cumsum(new) - 1


def bucketed(bucket: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
    """One row per bucket, with the columns' values as lists."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    heads = heads_of(bucket)
    arrays = [pa.array(bucket[heads].astype(np.int32))] + [lists(v[order], heads) for v in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, ["bucket", *columns])
