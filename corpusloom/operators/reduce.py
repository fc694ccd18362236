"""Vectors to fewer dimensions by principal components."""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

COMPONENTS = 10


def reduce_dims(df: DataFrame, vec: str, k: int = COMPONENTS, out: str = "umap") -> DataFrame:
    """Add the first ``k`` principal components of ``vec`` as ``array<double>``.

    Only a dimensions-by-dimensions covariance reaches the driver. Linear, so neighbourhood settings and
    seeds have no meaning here. The sign of each component is fixed: its largest loading is positive.
    """
    vectors = df.withColumn("__vec", array_to_vector(F.col(vec).cast("array<double>")))
    model = PCA(k=k, inputCol="__vec", outputCol="__pc").fit(vectors.where(F.col(vec).isNotNull()).select("__vec"))
    loadings = model.pc.toArray()
    signs = [1.0 if loadings[abs(loadings[:, i]).argmax(), i] > 0 else -1.0 for i in range(k)]
    projected = model.transform(vectors.where(F.col(vec).isNotNull()))
    signed = F.zip_with(vector_to_array("__pc"), F.array(*[F.lit(s) for s in signs]), lambda x, s: x * s)
    result = projected.withColumn(out, signed).drop("__vec", "__pc")
    if not df.schema[vec].nullable:
        return result
    empty = df.where(F.col(vec).isNull()).withColumn(out, F.lit(None).cast("array<double>"))
    return result.unionByName(empty)
