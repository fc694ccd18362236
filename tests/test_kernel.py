"""Random features against the kernel itself, and on data that no line separates."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom import operators as op


def test_products_approach_the_kernel(spark):
    """The error of one product has a deviation of at most 1 / sqrt(dims); six of them bound all pairs."""
    x = np.random.default_rng(2).normal(size=(60, 8))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(99, None)], "id int, v array<double>").repartition(3)
    gamma, dims = op.kernel_width(df, "v"), 4096
    assert gamma == pytest.approx(1 / (8 * x.var()))
    rows = {r.id: r.z for r in op.rbf_features(df, "v", "z", dims=dims).collect()}
    assert rows[99] is None
    z = np.array([rows[i] for i in range(60)])
    kernel = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(-1))
    assert np.abs(z @ z.T - kernel).max() < 6 / np.sqrt(dims)


def test_rings(spark):
    draw = np.random.default_rng(3)
    angle, ring = draw.uniform(0, 2 * np.pi, 600), np.arange(600) % 2
    points = np.stack([np.cos(angle), np.sin(angle)], 1) * (1 + 2 * ring)[:, None] + draw.normal(0, 0.1, (600, 2))
    rows = [(i, [float(v) for v in p], f"r{ring[i]}" if i < 300 else None) for i, p in enumerate(points)]
    df = spark.createDataFrame(rows, "id int, v array<double>, label string")

    def right(frame, features):
        found = op.train_predict(frame, features, "label").where("id >= 300").select("id", "train").collect()
        return np.mean([r.train == f"r{ring[r.id]}" for r in found])

    assert right(df, ["v"]) < 0.7 and right(op.rbf_features(df, "v", dims=128), ["rbf"]) > 0.97


def test_awkward_vectors(spark):
    schema = "id int, v array<double>"
    assert op.rbf_features(spark.createDataFrame([], schema), "v").count() == 0
    same = op.rbf_features(spark.createDataFrame([(1, [2.0, 2.0]), (2, None)], schema).withColumn("rbf", F.lit(1)), "v", dims=4).collect()
    assert len(same[0].rbf) == 4 and same[1].rbf is None
    with pytest.raises(Exception, match="same length"):
        op.rbf_features(spark.createDataFrame([(1, [2.0]), (2, [1.0, 2.0])], schema).coalesce(1), "v", gamma=1.0).collect()
    with pytest.raises(ValueError):
        op.rbf_features(spark.createDataFrame([], schema), "v", dims=0)
