import pytest
from pyspark.sql import functions as F

from corpusloom import operators as op
from corpusloom.runtime import ensure_checkpoint_dir, spread
from corpusloom.sources import collections as C
from corpusloom.sources import tabular, views
from corpusloom.streaming import append_stream, read_stream


def test_csv_view(spark, tmp_path):
    path = tmp_path / "v.csv"
    path.write_text(',text,n,Unnamed: 3\n0,"a ""q"", b\nline 2",1,x\n1,,2,y\n')
    df = views.read_csv_view(spark, str(path))
    assert df.columns == ["text", "n"]
    assert [tuple(r) for r in df.collect()] == [('a "q", b\nline 2', 1), (None, 2)]
    assert views.read_csv_view(spark, str(path), clip=1).count() == 1
    out = df.withColumn("v", F.array(F.lit(1.5), F.lit(2.0)))
    views.write_csv_view(out, str(tmp_path / "out"), index="n")
    back = views.read_csv_view(spark, str(tmp_path / "out"), index_col=False)
    assert back.columns == ["n", "text", "v"]
    assert {r.v for r in back.collect()} == {"[1.5,2.0]"}


def test_file_row_id(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(0, 100, 1, 4).write.parquet(path)
    df = spark.read.parquet(path)
    got = views.file_row_id(df).orderBy("row_id").collect()
    assert [r.row_id for r in got] == list(range(100)) and [r.id for r in got] == list(range(100))
    assert [r.id for r in views.clip_file_rows(df, 5).orderBy("id").collect()] == [0, 1, 2, 3, 4]


def test_spread(spark, tmp_path):
    path = str(tmp_path / "big")
    spark.range(0, 400000, 1, 1).select(F.sha2(F.col("id").cast("string"), 256).alias("s")).write.parquet(path)
    df = spark.read.parquet(path)
    wide = df.repartition(64)
    assert spread(df).rdd.getNumPartitions() >= 8
    assert spread(wide) is wide
    assert spread(spark.range(10)).rdd.getNumPartitions() == spark.range(10).rdd.getNumPartitions()


def test_corpus_tsv(spark, tmp_path):
    path = tmp_path / "m.tsv"
    path.write_text("﻿dead\telement\tcoach\nx1\tstrange\tc1\nx2\tsocial\tc2\n", encoding="utf-8")
    target = str(tmp_path / "corpus")
    tabular.import_corpus_tsv(spark, str(path), target)
    tabular.import_corpus_tsv(spark, str(path), target)
    rows = spark.read.parquet(target)
    assert rows.columns == ["element", "coach"] and rows.count() == 4
    assert tabular.read_corpus_tsv(spark, str(path), {"coach": "trainer"}).columns == ["element", "trainer"]


def test_keywords(spark, tmp_path):
    path = tmp_path / "k.txt"
    path.write_text("obama \n fun\nluck\n", encoding="utf-8")
    assert tabular.load_keywords(spark, str(path)) == ["obama", "fun", "luck"]
    path.write_text("ok\n(\n")
    with pytest.raises(ValueError):
        tabular.load_keywords(spark, str(path))


def test_table_csv(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,b\n1,x\n2,\n")
    df = tabular.read_table_csv(spark, str(path))
    assert [r.b for r in df.select(tabular.text_column("b").alias("b")).collect()] == ["x", ""]
    tabular.add_column_csv(df, "c", F.col("a") * 2, str(tmp_path / "o"))
    assert tabular.read_table_csv(spark, str(tmp_path / "o")).columns == ["a", "b", "c"]


def test_validate_collection(spark):
    df = spark.createDataFrame(
        [("c", "t", "s"), (None, "t", None), ("c", None, None)], "corpusName string, text string, source string"
    )
    good, bad = C.validate_collection(df, "corpus")
    assert good.count() == 1 and {tuple(r._errors) for r in bad.collect()} == {
        ("corpusName is missing",), ("text is missing",)}
    assert C.require_valid(good, "corpus").count() == 1
    with pytest.raises(Exception, match="is missing"):
        C.require_valid(df, "corpus").collect()
    clusters = spark.createDataFrame([("c", 1.5, "n", ["x"])], "corpusName string, clusterNo double, clusteringName string, childItems array<string>")
    assert C.validate_collection(clusters, "clusters")[1].first()._errors == ["clusterNo is not int"]
    codes = spark.createDataFrame([("s",)], "codeSet string")
    assert C.validate_collection(codes, "codes")[1].first()._errors == ["codeName is missing"]


def test_checkpoint_dir_is_kept(spark):
    assert ensure_checkpoint_dir(spark) == ensure_checkpoint_dir(spark)


def test_narrow_operators_stream(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.createDataFrame([(1, "de", "Das ist gut. Und das?"), (2, "en", "The fun of it. No luck.")], "id long, lang string, text string")
    rows.write.parquet(source)
    stream = read_stream(spark, source, rows.schema)
    stream = op.filter_view(stream, "id > 0")
    stream = op.detect_language(op.sentiment(stream, "text"), "text")
    stream = op.match_counter(stream, "text", [{"l": "n", "r": "das|fun"}], ["l"], "r")
    stream = op.kwic(stream, "text", ["gut", "fun", "das"], "id", keep_data=["lang", "language_id", "n"])
    query = append_stream(stream, out, str(tmp_path / "ck"))
    assert query.awaitTermination(120)
    got = spark.read.parquet(out).collect()
    assert sorted((r.parent_id, r.keyword, r.n) for r in got) == [(1, "das", 2), (1, "das", 2), (1, "gut", 2), (2, "fun", 1)]
