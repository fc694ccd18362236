"""Corpus files: TSV import, keyword lists, and the clean-up step's column helpers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusloom.functions.patterns import validate
from corpusloom.functions.text import text_or_empty

_BOM = "﻿"


def read_corpus_tsv(spark: SparkSession, path: str, rename: Mapping[str, str] | None = None) -> DataFrame:
    """TSV with header as text columns; the first (index) column is dropped, ``rename`` maps names."""
    df = spark.read.option("header", True).option("sep", "\t").csv(path)
    df = df.toDF(*[c.removeprefix(_BOM) for c in df.columns])
    return df.drop(df.columns[0]).withColumnsRenamed(dict(rename or {}))


def import_corpus_tsv(spark: SparkSession, path: str, target: str, rename: Mapping[str, str] | None = None) -> None:
    """Append a TSV file to the Parquet collection at ``target``."""
    read_corpus_tsv(spark, path, rename).write.mode("append").parquet(target)


def load_keywords(spark: SparkSession, path: str) -> list[str]:
    """One regex per line, stripped. The list becomes part of a plan."""
    files = spark.read.format("binaryFile").load(path)
    texts = [bytes(r.content).decode("utf-8") for r in files.orderBy("path").select("content").collect()]
    keywords = [line.strip() for text in texts for line in text.removeprefix(_BOM).splitlines()]
    validate(keywords)
    return keywords


def read_table_csv(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A UTF-8 CSV with header and no index column."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return reader.csv(path, schema=schema) if schema is not None else reader.csv(path, inferSchema=True)


def text_column(name: str) -> Column:
    """A column as text with nulls read as empty."""
    return text_or_empty(F.col(name))


def add_column_csv(df: DataFrame, name: str, value: Column, path: str) -> DataFrame:
    """Add a column and write the table, without index, to a new ``path``."""
    result = df.withColumn(name, value)
    result.write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)
    return result
