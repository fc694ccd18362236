"""Nearest neighbours by randomly rotated one-bit codes.

Vectors are centred, scaled to length one and rotated; the code keeps one sign per dimension, and beside it the
length and the product of the rotated vector with its own code. From these a query estimates its inner product
with every vector of a block, together with an error bound; vectors whose smallest possible distance does not exceed
the k-th smallest of the largest possible ones are reranked on the original vectors. Queries and vectors are hashed
into blocks, every pair of a query block and a vector block is one task's work and gives k rows per query, and a
final window keeps the k nearest. All vectors are indexed; nothing is sampled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from corpusloom.llm import common

QUERY_BLOCK, VECTOR_BLOCK = 512, 8192
#: Standard deviations of the estimate that the bound allows for.
SURE = 4.0


def rotation(dims: int, seed: int = 3) -> np.ndarray:
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(seed)).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, length, and product with the own code of every vector."""
    moved = vectors - centre
    length = np.sqrt((moved**2).sum(1))
    turned = (moved / np.where(length > 0, length, 1)[:, None]) @ turn.T
    return np.packbits(turned > 0, axis=1), length, np.abs(turned).sum(1) / np.sqrt(vectors.shape[1])


def _matrix(column, dims: int) -> np.ndarray:
    return common.flat(column, np.float64).reshape(-1, dims)


def _bytes(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _index(centre: np.ndarray):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(len(centre))
        for batch in batches:
            codes, length, own = encode(_matrix(batch.column("vector"), len(centre)), centre, turn)
            new = [pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(length), pa.array(own)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "code", "length", "own"])

    return task


def distances(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, summed dimension by dimension."""
    total = np.zeros(len(vectors))
    for i in range(len(query)):
        total += (vectors[:, i] - query[i]) ** 2
    return np.sqrt(total)


def _search(k: int, centre: np.ndarray):
    dims = len(centre)

    def compare(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        rows = []
        if queries.num_rows and vectors.num_rows:
            turn = rotation(dims)
            ids, base = vectors.column("vec_id").to_numpy(), _matrix(vectors.column("vector"), dims)
            length, own = (vectors.column(c).to_numpy() for c in ("length", "own"))
            bits = np.unpackbits(_bytes(vectors.column("code"), (dims + 7) // 8), axis=1, count=dims)
            signs = (bits.astype(np.float32) * 2 - 1) / np.float32(np.sqrt(dims))
            own = np.maximum(own, 1e-9)
            error = SURE * np.sqrt(np.maximum(0, 1 - own**2)) / own / np.sqrt(max(1, dims - 1))
            for query_id, query in zip(queries.column("vec_id").to_numpy(), _matrix(queries.column("vector"), dims)):
                moved = query - centre
                far = np.sqrt((moved**2).sum())
                cosine = signs @ (turn @ (moved / (far or 1))).astype(np.float32) / own
                square, reach = length**2 + far**2, 2 * length * far
                low, high = square - reach * np.minimum(1, cosine + error), square - reach * np.maximum(-1, cosine - error)
                others = np.flatnonzero(ids != query_id)
                if not len(others):
                    continue
                slack = 1e-6 * (1 + square[others].max())
                limit = np.partition(high[others], min(k, len(others)) - 1)[min(k, len(others)) - 1] + slack
                chosen = others[low[others] <= limit]
                exact = distances(query, base[chosen])
                best = np.lexsort((ids[chosen], exact))[:k]
                rows += [(int(query_id), int(ids[chosen[b]]), float(exact[b])) for b in best]
        columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))]
        return pa.table(columns, ["query_id", "vec_id", "score"])

    return compare


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(vec_id, vector)`` of the vectors that can take part, as doubles."""
    vector = F.col(vector_col).cast("array<double>")
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("vector"))
        .where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & ~bad & F.exists("vector", lambda x: x != 0))
    )


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row of ``queries`` its ``k`` nearest of ``vectors``.

    Both tables have the same columns. Nearest is the smallest Euclidean distance, ties go to the smaller id; rows with the
    query's own id are not its candidates. With fewer candidates than ``k`` all are returned. Vectors that are null,
    zero, or hold null or non-finite numbers take no part, nor do rows without an id and vectors of another length than
    the most frequent one. Repeated rows are candidates each. Extra columns are not read. Empty tables give an empty result.
    """
    known = usable(vectors, id_col, vector_col)
    sizes = known.groupBy(F.size("vector").alias("dims")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "dims").limit(1).collect()
    dims = sizes[0]["dims"] if sizes else 1
    known = known.where(F.size("vector") == dims)
    asked = usable(queries, id_col, vector_col).where(F.size("vector") == dims)
    means = known.select(F.posexplode("vector")).groupBy("pos").agg(F.avg("col").alias("mean")).collect()  # one row per dimension
    centre = np.zeros(dims)
    for row in means:
        centre[row["pos"]] = row["mean"]
    indexed = common.stored(known.mapInArrow(_index(centre), "vec_id long, vector array<double>, code binary, length double, own double"))
    query_blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    vector_blocks = max(1, -(-indexed.count() // VECTOR_BLOCK))
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    left = asked.withColumn("q", block(query_blocks)).withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(vector_blocks - 1))))
    right = indexed.withColumn("v", block(vector_blocks)).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    found = left.groupBy("q", "v").cogroup(right.groupBy("q", "v")).applyInArrow(_search(k, centre), "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
