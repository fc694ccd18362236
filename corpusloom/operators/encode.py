"""Text to vector: a hashing encoder inside the JVM and a hook for user models."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.functions.text import tokens
from corpusloom.operators.matchmany import pieces

HASH_DIMENSIONS = 256
PIECE_BYTES, PIECE_ROWS = 1 << 21, 1024


def encode_text(
    df: DataFrame,
    col: str,
    encoder: Callable[[Column], Column] | None = None,
    clip: int | None = None,
    order_by: str | None = None,
    out: str = "sbert",
    dimensions: int = HASH_DIMENSIONS,
) -> DataFrame:
    """Add a vector column ``array<double>``.

    Without ``encoder`` the lower-cased words are hashed to ``dimensions`` counts of length one.
    ``clip`` keeps the first rows by ``order_by``.
    """
    if clip is not None:
        df = clip_rows(df, clip, order_by)
    if encoder is not None:
        return df.withColumn(out, encoder(F.col(col)).cast("array<double>"))
    words = df.withColumn("__words", F.coalesce(tokens(F.col(col)), F.array().cast("array<string>")))
    counted = HashingTF(inputCol="__words", outputCol="__tf", numFeatures=dimensions).transform(words)
    scaled = Normalizer(inputCol="__tf", outputCol="__unit").transform(counted)
    return scaled.withColumn(out, vector_to_array("__unit")).drop("__words", "__tf", "__unit")


def clip_rows(df: DataFrame, n: int, order_by: str | Sequence[str] | None = None) -> DataFrame:
    """First ``n`` rows; name an order for a result that does not depend on the file layout."""
    keys = [order_by] if isinstance(order_by, str) else list(order_by or [])
    return (df.orderBy(*keys) if keys else df).limit(n)


def model_encoder(load: Callable[[], Callable[[list[str]], Sequence]]) -> Callable[[Column], Column]:
    """Wrap a user model; ``load`` runs once per task and returns an encoder of a list of texts, which gets some MB of them at most."""

    @F.arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = load()
        kind = pa.list_(pa.float64())
        for batch in batches:
            made = [pa.array([], kind)]
            for piece in pieces(batch, PIECE_BYTES, PIECE_ROWS):  # texts and vectors as Python objects only for a piece
                vectors = encode(["" if t is None else t for t in piece.to_pylist()])
                made.append(pa.array([[float(x) for x in v] for v in vectors], kind))
            yield pa.concat_arrays(made)

    return lambda text: run(text)
