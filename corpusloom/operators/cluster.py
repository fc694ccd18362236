"""Density clustering: one level of the mutual-reachability hierarchy, exact at any size.

Rows with at least ``min_samples`` others within ``eps`` are core; cores within ``eps`` of each other
share a cluster; everything else is noise. Neighbours come from a pivot-partitioned metric join: each
vector belongs to the cell of its nearest pivot and looks into every cell whose border lies within
``eps``, so each pair meets in exactly one cell. Cells are cut into blocks of fixed size, which meet without being
shuffled (see :mod:`corpusloom.operators.blocks`). No pair list leaves a task: the first pass returns the few nearest
distances, the second a spanning forest of what the task has seen.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegralType

from corpusloom.operators.blocks import NEAREST, Forest, Nearest, meet, packed, placed
from corpusloom.operators.components import connected_components
from corpusloom.operators.relational import with_row_id
from corpusloom.runtime import durable

NOISE = -1
CELL_ROWS = 4096
BLOCK_ROWS = 2048
MAX_PIVOTS = 8192


def density_cluster(
    df: DataFrame,
    vec: str,
    eps: float,
    id_col: str,
    min_cluster_size: int = 15,
    min_samples: int = 6,
    include_p: bool = False,
    out: str = "hdbscan",
) -> DataFrame:
    """Add ``hdbscan`` (0.. by smallest ``id_col``, -1 for noise) and optionally ``hdbscan_p``.

    ``hdbscan_p`` is the smallest core distance in the cluster over the row's own, 0 for noise. Ids that are no
    integers are numbered in their order first. Runs its jobs when called, as the components need rounds.
    """
    if not isinstance(df.schema[id_col].dataType, IntegralType):
        numbers = with_row_id(df.select(F.col(id_col).alias("__key")).where("__key IS NOT NULL").distinct(), "__key", "__number")
        numbered = df.join(numbers, F.col(id_col) == F.col("__key"), "left").drop("__key")
        return density_cluster(numbered, vec, eps, "__number", min_cluster_size, min_samples, include_p, out).drop("__number")
    vector = F.col(vec).cast("array<double>")
    # Equal vectors become one weighted point, so a mass of copies is neither compared nor stored.
    points = durable(
        df.where(F.col(vec).isNotNull())
        .select(F.col(id_col).cast("bigint").alias("id"), vector.alias("vec"))
        .groupBy("vec")
        .agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
    )
    pivots = _pivots(points)
    cores = durable(_core_points(points, pivots, eps, min_samples))
    links = _block_join(cores, pivots, eps, Forest, "a bigint, b bigint", once=True)
    components = connected_components(links.select("a", "b"))

    members = cores.join(components, cores["id"] == components["node"], "left").select(
        "id", "vec", "copies", "core_distance", F.coalesce("component", "id").alias("component")
    )
    clusters = (
        members.groupBy("component")
        .agg(F.sum("copies").alias("size"), F.min("id").alias("first_id"), F.min("core_distance").alias("densest"))
        .where(F.col("size") >= min_cluster_size)
    )
    numbered = with_row_id(clusters, order_by="first_id", name="label").select("component", "label", "densest")
    labelled = members.join(numbered, "component").select(
        F.col("vec").alias("__vec"),
        F.col("label").cast("int").alias(out),
        F.coalesce(F.try_divide("densest", "core_distance"), F.lit(1.0)).alias("__p"),
    )
    result = df.join(labelled, vector.eqNullSafe(F.col("__vec")), "left").withColumn(
        out, F.coalesce(out, F.lit(NOISE))
    )
    if include_p:
        result = result.withColumn(f"{out}_p", F.coalesce("__p", F.lit(0.0)))
    return result.drop("__vec", "__p")


def _core_points(points: DataFrame, pivots: np.ndarray, eps: float, min_samples: int) -> DataFrame:
    """Core points with their core distance: how far the ``min_samples``-th other row is."""
    near = _block_join(points, pivots, eps, lambda: Nearest(min_samples), NEAREST)
    # One list for each stretch of blocks that a row was compared with.
    merged = near.groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, min_samples).alias("near"))

    twins = F.struct(F.lit(0.0).alias("d"), F.lit(None).cast("bigint").alias("id"), (F.col("copies") - 1).alias("n"))
    entries = F.concat(F.array(twins), F.coalesce("near", F.array().cast("array<struct<d:double,id:bigint,n:bigint>>")))
    start = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("double").alias("at"))

    def walk(acc: Column, e: Column) -> Column:
        seen = acc["seen"] + e["n"]
        return F.struct(seen.alias("seen"), F.coalesce(acc["at"], F.when(seen >= min_samples, e["d"])).alias("at"))

    # Each entry stands for one row at least, so the nearest ``min_samples`` tell whether there are enough.
    return (
        points.join(merged, "id", "left")
        .withColumn("core_distance", F.aggregate(entries, start, walk)["at"])
        .where("core_distance IS NOT NULL")
        .select("id", "vec", "copies", "core_distance")
    )


def _pivots(points: DataFrame) -> np.ndarray:
    """A few vectors picked by hash; at most MAX_PIVOTS of them reach the driver and the tasks."""
    wanted = max(1, min(MAX_PIVOTS, points.count() // CELL_ROWS))
    rows = points.orderBy(F.xxhash64("id"), "id").limit(wanted).select("vec").collect()
    return np.array([r.vec for r in rows], dtype=np.float64).reshape(len(rows), -1 if rows else 0)


def _block_join(points: DataFrame, pivots: np.ndarray, eps: float, task, schema: str, once: bool = False) -> DataFrame:
    """Run ``task`` on the pairs of blocks whose rows may lie within ``eps`` of each other."""
    rows = points.select(
        "id", "vec", "copies", F.lit(0.0).alias("core"), F.lit(0).cast("bigint").alias("comp"), F.lit(float(eps)).alias("reach")
    )
    return meet(packed(placed(rows, pivots), BLOCK_ROWS), pivots.shape[1], task, schema, once)


def cluster_sizes(df: DataFrame, out: str = "hdbscan") -> DataFrame:
    """Rows per cluster, noise included."""
    return df.groupBy(out).count()
