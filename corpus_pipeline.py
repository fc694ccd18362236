"""Documents through five stages; each takes (spark, docs, sf_dir) and works on what the one before kept.

All stages but the last return the columns that they were given, in their order, whatever their names beside ``doc_id``,
``text`` and ``source``, and an empty table for an empty one. Null and empty texts and repeated or null ids are no error;
each stage says what becomes of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusloom.llm import common
from corpusloom.llm.decontam import without_leaks
from corpusloom.llm.mixing import count_words, mix_sources
from corpusloom.llm.neardup import near_duplicates
from corpusloom.llm.quality import fit
from corpusloom.llm.substring import remove_repeats


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _aside(docs: DataFrame, results: str) -> tuple[DataFrame, list[Column]]:
    """``docs`` with columns named like an operator's results under other names, and the columns that restore them."""
    moved = {c: f"aside_{i}_{c}" for i, c in enumerate(docs.columns) if c in results.split()}
    return docs.withColumnsRenamed(moved), [F.col(f"`{moved.get(c, c)}`").alias(c) for c in docs.columns]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are neither of low quality nor toxic; null and empty texts are of low quality.

    Rows that share an id are judged by their text each.
    """
    own, columns = _aside(docs, "quality toxicity keep")
    return fit(own, _table(spark, sf_dir, "labels")).score(own).where("keep").select(*columns)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8): the one with the smallest id.

    Null and empty texts are like nothing else and stay, as do rows without an id. Rows that share an id are one
    document and stay or go together.
    """
    own, columns = _aside(docs, "n_shingles component_id kept")
    return near_duplicates(own).where("kept").select(*columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the windows of 50 words that an earlier document has; texts that are left empty go.

    A text without such repeats stays as it is; of the others the kept words are joined by one space, and ``n_chars``,
    if there, is renewed. Null and empty texts stay. A null id counts as the largest; rows that share an id do not repeat
    each other.
    """
    own, columns = _aside(docs, "n_words n_removed spans kept_text")
    cut = remove_repeats(own, window=50).where("n_removed = 0 OR n_removed < n_words").withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return cut.select(*columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items; null and empty texts hold none. Rows that share an id are judged by their text each."""
    return without_leaks(docs, _table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes words from, with their size, source_size, target and taken words.

    Columns of these names are replaced. Null and empty texts have no words to take and go; a null source is one of its
    own; rows that share an id are taken from each on their own.
    """
    results = ["size", "source_size", "target", "taken"]
    plain = [c for c in docs.columns if c not in results]
    whole = F.struct(*[F.col(f"`{c}`") for c in plain]).alias("whole")
    held = common.stored(docs.select(whole, "doc_id", "source", count_words(F.col("text")).alias("size"), F.monotonically_increasing_id().alias("row")))
    # The schedule works on narrow rows; texts are joined once, by the number that the stored row has.
    rows, _ = mix_sources(held.select("row", "doc_id", "source", "size"))
    taken = rows.where("taken > 0").select("row", *results)
    return held.select("row", "whole").join(taken, "row").select(*[F.col("whole").getField(c).alias(c) for c in plain], *results)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", minhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
]
#: SQL cannot express the classifier; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written as Parquet and read again."""
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir))
    return docs
