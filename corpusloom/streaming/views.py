"""File-source streams in and out of view folders.

The narrow operators (sentences, keyword in context, match counting, sentiment, clean-up, encoding,
filter) take a streaming DataFrame as it is; they run no job and keep no state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.streaming import StreamingQuery


def read_stream(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def append_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what has arrived to a Parquet folder, then stop; restarts continue from ``checkpoint``."""
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(availableNow=True).start()
