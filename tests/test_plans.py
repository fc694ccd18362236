"""What the physical plans must and must not hold."""

import os

import pytest
from pyspark.sql import functions as F

from corpusloom import operators as op
from corpusloom.plans.queries import DICTIONARY, QUERIES, table

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scans(text):
    return [line for line in text.splitlines() if "FileScan" in line]


NARROW = {
    "kwic": lambda d: op.kwic(d, "text", ["the", r"a\s"], "doc_id", keep_data=["lang"]),
    "kwic_no_overlap": lambda d: op.kwic(d, "text", ["the"], "doc_id", no_overlap=True, keep_data=False),
    "split_sentences": lambda d: op.split_sentences(d, "text"),
    "spans": lambda d: op.with_sentence_spans(d, "text"),
    "match_counter": lambda d: op.match_counter(d, "text", DICTIONARY, ["category", "language"], "regex", "exact"),
    "sentiment": lambda d: op.sentiment(d, "text"),
    "translate": lambda d: op.map_text_where(d, "text", op.glossary({"a": "b"}), "lang = 'de'"),
    "cleanup": lambda d: op.standard_cleanup(d.withColumn("date", F.lit("1.2.2020"))),
    "encode": lambda d: op.encode_text(d, "text"),
}


@pytest.mark.parametrize("name", NARROW)
def test_text_operators_do_not_shuffle(spark, name):
    text = plan(NARROW[name](table(spark, SF_DIR, "documents")))
    assert "Exchange" not in text and "Join" not in text


def test_columns_are_pruned_and_filters_pushed(spark):
    kwic = plan(op.kwic(table(spark, SF_DIR, "documents"), "text", ["the"], "doc_id", keep_data=False))
    assert all("n_chars" not in line and "source" not in line for line in scans(kwic))
    kept = op.filter_view(table(spark, SF_DIR, "orders"), "o_orderstatus = 'F' AND o_totalprice > 100000")
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    scan = kept.select("o_orderkey")._jdf.queryExecution().explainString(mode)
    assert "EqualTo(o_orderstatus,F)" in scan and "GreaterThan(o_totalprice,100000.0)" in scan
    assert "o_orderdate" not in scan


def test_ctfidf_limits_before_the_window_and_reuses_the_counts(spark):
    df = op.ctfidf(table(spark, SF_DIR, "documents"), "lang", "text", 5, "english", include_tf=True)
    text = plan(df)
    assert "WindowGroupLimit" in text
    df.collect()
    final = plan(df).split("\n+- == Initial Plan ==")[0]
    assert "ReusedExchange" in final
    # The text is read and cut into words once; the other scan only counts rows.
    assert len([line for line in scans(final) if "text:string" in line]) == 1


EAGER = {"density_cluster", "cluster_sizes", "train_predict", "train_multilabel", "query_set", "classwise_query_set", "reduce_dims"} | {
    "density_hierarchy", "abbreviation_scores", "starter_scores", "learned_sentences", "saved_learner", "kernel_products", "train_kernel", "language_posterior"
}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_no_nested_loops(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text
