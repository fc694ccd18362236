"""Registered round trips through the sources and sinks: what is written from the tables and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom import operators as op
from corpusloom.functions.patterns import match_count
from corpusloom.runtime import ensure_checkpoint_dir
from corpusloom.sources import collections as C
from corpusloom.sources.tabular import add_column_csv, import_corpus_tsv, load_keywords, read_table_csv
from corpusloom.sources.views import ViewStore, read_csv_view, write_csv_view


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"


def view_versions(spark, sf_dir):
    """A view saved, read, changed and saved under its own name: the newest version."""
    store = ViewStore(spark, _folder(spark))
    store.save(_table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"), "docs")
    store.save(store.scan("docs").where("lang <> 'de'").withColumn("n_chars", F.length("text")), "docs")
    return store.load("docs").select("doc_id", "lang", "source", "n_chars")


def csv_view(spark, sf_dir):
    """Vectors and texts through a CSV view and back."""
    path = _folder(spark)
    rows = _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("orders"), F.max("o_orderpriority").alias("top"))
    write_csv_view(rows.select("o_custkey", F.col("o_custkey").alias("customer"), "orders", "top"), path, index="o_custkey")
    read = read_csv_view(spark, path, schema="row long, customer long, orders string, top string", multi_line=False)
    return read.select("customer", "top", F.from_json("orders", "array<long>").alias("orders")).select("customer", "top", F.size("orders").alias("n"), F.get("orders", 0).alias("first"))


def import_tsv(spark, sf_dir):
    """Two TSV files appended to one collection, their columns renamed."""
    target = _folder(spark)
    parts = _table(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").alias("key"), "p_name", "p_brand")
    for half in (0, 1):
        path = _folder(spark)
        parts.where(F.col("p_partkey") % 2 == half).write.option("header", True).option("sep", "\t").csv(path)
        import_corpus_tsv(spark, path, target, {"p_name": "text", "p_brand": "corpusName"})
    return spark.read.parquet(target).select(F.col("key").cast("long").alias("key"), "text", "corpusName")


def keyword_file(spark, sf_dir):
    """Keywords read from a file, and how often each occurs in the documents."""
    path = _folder(spark)
    names = _table(spark, sf_dir, "benchmark").select(F.regexp_extract(F.lower("text"), "([a-z]{5,})", 1).alias("word")).where("word <> ''").distinct()
    names.orderBy("word").coalesce(1).write.text(path)  # one word for each item at most
    dictionary = [{"word": k, "regex": k} for k in load_keywords(spark, f"{path}/*.txt")]
    counted = op.match_counts(_table(spark, sf_dir, "documents").select("text"), "text", dictionary, ["word"], "regex")
    return counted.select(F.explode("matches").alias("keyword", "n")).groupBy("keyword").agg(F.sum("n").alias("n"))


def collection_split(spark, sf_dir):
    """Documents as a corpus collection, valid and rejected rows told apart."""
    rows = _table(spark, sf_dir, "documents").select(
        "doc_id", F.when(F.col("n_chars") % 7 != 0, F.col("source")).alias("corpusName"), F.when(F.col("n_chars") % 5 != 0, F.col("text")).alias("text"), "lang"
    )
    valid, rejected = C.validate_collection(rows, "corpus")
    told = valid.select("doc_id", F.lit(True).alias("valid"), F.lit("").alias("errors"))
    return told.unionByName(rejected.select("doc_id", F.lit(False).alias("valid"), F.array_join("_errors", "; ").alias("errors")))


def column_csv(spark, sf_dir):
    """A table with one more column, written as CSV and read with inferred types."""
    path = _folder(spark)
    nations = _table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    add_column_csv(nations, "ends", match_count(F.col("s_name"), "[0-9]"), path)
    return read_table_csv(spark, path).select(F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_name", F.col("ends").cast("long").alias("ends"))


def saved_learner(spark, sf_dir):
    """Whether a learner predicts the same after it was saved and loaded; vectors with an even id are its examples."""
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 2 == 0, F.concat(F.lit("c"), F.col("label"))).alias("label"))
    learner = op.fit_learner(rows, ["embedding"], "label")
    path = _folder(spark)
    op.save_learner(learner, path)
    before, after = (op.train_predict(rows, ["embedding"], "label", learner=m).select("vec_id", F.col("train").alias(n)) for m, n in ((learner, "one"), (op.load_learner(path), "two")))
    return before.join(after, "vec_id").select("vec_id", (F.col("one") == F.col("two")).alias("same"))


QUERIES = {f.__name__: f for f in (view_versions, csv_view, import_tsv, keyword_file, collection_split, column_csv, saved_learner)}

ORACLE_SQL = {
    "view_versions": "SELECT doc_id, lang, source, CAST(length(text) AS INTEGER) AS n_chars FROM documents WHERE lang <> 'de'",
    "csv_view": """SELECT o_custkey AS customer, max(o_orderpriority) AS top, CAST(count(*) AS INTEGER) AS n, min(o_orderkey) AS "first"
        FROM orders GROUP BY o_custkey""",
    "import_tsv": "SELECT p_partkey AS key, p_name AS text, p_brand AS \"corpusName\" FROM part",
    "keyword_file": """WITH words AS (SELECT DISTINCT regexp_extract(lower(text), '([a-z]{5,})', 1) AS word FROM benchmark)
        SELECT word AS keyword, CAST(sum((length(lower(text)) - length(replace(lower(text), word, ''))) // length(word)) AS BIGINT) AS n
        FROM documents JOIN words ON word <> '' AND contains(lower(text), word) GROUP BY word""",
    "collection_split": """SELECT doc_id, n_chars % 7 <> 0 AND n_chars % 5 <> 0 AS valid, concat_ws('; ', CASE WHEN n_chars % 7 = 0 THEN 'corpusName is missing' END,
        CASE WHEN n_chars % 5 = 0 THEN 'text is missing' END) AS errors FROM documents""",
    "column_csv": "SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, s_name, CAST(len(regexp_extract_all(s_name, '[0-9]')) AS BIGINT) AS ends FROM supplier",
    "saved_learner": "SELECT vec_id, true AS same FROM embeddings",
}
