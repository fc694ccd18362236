import pytest
from pyspark.sql import functions as F

from corpusloom import operators as op
from corpusloom.plans.commands import Workspace


DELIVERIES = [(day, town, load) for day, town in enumerate(["Ulm", "Gent", None, "Ulm", "Lyon", "Gent", "Ulm", "Brno"]) for load in (day * day, -day)]
DEPOTS = [("Gent", "dry", 4), ("Ulm", "wet", 9), ("Turin", "dry", 2), (None, "none", 0), ("Ulm", "dry", 1)]


@pytest.fixture()
def sides(spark):
    return spark.createDataFrame(DELIVERIES, "day int, town string, load int"), spark.createDataFrame(DEPOTS, "town string, kind string, docks int")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_join_by_the_rule(sides):
    """Every pair of rows with equal towns, null with null; the outer join adds each side's rest once."""
    a, b = sides
    pairs = [(d, t, n, k, q) for d, t, n in DELIVERIES for u, k, q in DEPOTS if t == u]
    alone = [(d, t, n, None, None) for d, t, n in DELIVERIES if t not in {u for u, _, _ in DEPOTS}]
    empty = [(None, u, None, k, q) for u, k, q in DEPOTS if u not in {t for _, t, _ in DELIVERIES}]
    assert alone and empty
    columns = ["day", "town", "load", "kind", "docks"]
    assert rows(op.join_views(a, b, ["town"]).select(columns)) == sorted(pairs, key=str)
    assert rows(op.join_views(a, b, ["town"], how="outer").select(columns)) == sorted(pairs + alone + empty, key=str)


@pytest.mark.parametrize("threshold", ["10485760", "-1"])
@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
def test_join_like_pandas(spark, how, threshold):
    """Null keys match, clashing names get suffixes, swapped key names survive; both join plans."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        a = spark.createDataFrame([("k", "1", 1), (None, "2", 2), ("q", "2", 3)], "p string, q string, v int")
        b = spark.createDataFrame([("1", "k", 10), ("2", None, 20), ("9", "z", 30)], "p string, q string, v int")
        got = op.join_views(a, b, ["p", "q"], ["q", "p"], how)
        pa, pb = a.toPandas(), b.toPandas().rename(columns={"q": "p", "p": "q"})
        want = pa.merge(pb, on=["p", "q"], how=how)
        want = want.astype(object).where(want.notna(), None)
        assert got.columns == ["p", "q", "v_x", "v_y"]
        assert rows(got) == sorted((tuple(r) for r in want[got.columns].itertuples(index=False)), key=str)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_join_argument_checks(sides):
    a, b = sides
    with pytest.raises(ValueError):
        op.join_views(a, b, ["town"], ["town", "kind"])
    with pytest.raises(ValueError):
        op.join_views(a, b, ["town"], how="cross")


def test_filter(sides):
    a, _ = sides
    kept = op.filter_view(a, "load < 0", sort_columns=True)
    assert kept.columns == ["day", "load", "town"] and rows(kept) == sorted(((d, n, t) for d, t, n in DELIVERIES if n < 0), key=str)
    numbered = op.with_row_id(a, ["day", "load"])
    order = sorted(DELIVERIES, key=lambda r: (r[0], r[2]))
    passing = [i for i, (_, t, _) in enumerate(order) if t == "Ulm"]
    assert rows(op.filter_mapper(numbered, F.col("town") == "Ulm", "row_id")) == sorted(enumerate(passing), key=str)


def test_row_id_is_contiguous(spark):
    df = spark.range(1000).withColumn("k", F.xxhash64("id")).repartition(13)
    ids = op.with_row_id(df, "k").orderBy("k").select("row_id").collect()
    assert [r.row_id for r in ids] == list(range(1000))
    plain = op.with_row_id(df).select("row_id").collect()
    assert sorted(r.row_id for r in plain) == list(range(1000))


def test_append_column(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(1, 5), (2, 6)], "k int, w int")
    assert rows(op.append_column(a, b, "v", on="k")) == [(1, 5, "x"), (2, 6, "y")]
    assert rows(op.append_column(a, b, "v", "n", order_source="k", order_target="k")) == [(1, 5, "x"), (2, 6, "y")]
    with pytest.raises(ValueError):
        op.append_column(a, b.withColumnRenamed("w", "v"), "v", on="k")
    longer = b.unionByName(spark.createDataFrame([(3, 7)], "k int, w int"))
    with pytest.raises(Exception, match="no partner"):
        op.append_column(a, longer, "v", on="k").collect()
    with pytest.raises(Exception, match="no partner"):
        op.append_column(a, longer, "v", "n", order_source="k", order_target="k").collect()


def test_counts(spark):
    df = spark.createDataFrame([(x,) for x in (1, 1, 1, 4, 4, 3, 3, 3, 3, None)], "A int")
    assert rows(op.group_count(df, "A")) == [(1, 3), (3, 4), (4, 2)]
    two = spark.createDataFrame([(1, 1), (0, 1), (1, 1), (0, 0), (0, 0)], "A int, B int")
    assert rows(op.column_sums(two, ["A", "B"])) == [("A", 2), ("B", 3)]


def test_group_concat(spark):
    """Texts of a group in the order of the id, without nulls and rows that belong to no group."""
    given = [(i, "xyz"[i % 3] if i % 7 else None, None if i % 5 == 0 else f"w{i * 37 % 11}") for i in range(40)] + [(50, "v", None), (51, "u", "")]
    df = spark.createDataFrame(given, "i long, label string, text string").repartition(4)
    groups = {g for _, g, _ in given if g}
    expected = [(g, "/".join(t for _, h, t in given if h == g and t)) for g in sorted(groups)]
    got = [(g, t or "") for g, t in rows(op.group_concat(df, "label", "text", "i", "/"))]
    assert got == expected


def test_group_concat_hot_group(spark):
    """Chunks keep the order across their edges and skip empty stretches."""
    df = spark.range(5000).select(
        "id", F.lit("g").alias("g"), F.when(F.col("id").between(1000, 2500), "").otherwise(F.col("id").cast("string")).alias("t")
    )
    expected = ",".join(str(i) for i in range(5000) if not 1000 <= i <= 2500)
    assert op.group_concat(df.repartition(7), "g", "t", "id", ",").first().t == expected
    parts = op.group_concat_parts(df, "g", "t", "id", ",").where("t is not null").orderBy("part").collect()
    assert ",".join(p.t for p in parts) == expected


def test_workspace(spark, tmp_path):
    ws = Workspace(spark, str(tmp_path / "views"))
    texts = ["Obama is fun. Good luck!", "Nothing here.", "Luck. Fun. Luck again."]
    ws.store.save(spark.createDataFrame([(t, f"t{i % 2}") for i, t in enumerate(texts)], "text string, topic string").coalesce(1), "a")
    (tmp_path / "kw.txt").write_text("obama\nfun\nluck\n")
    hits = ws.kwic("a", "hits", str(tmp_path / "kw.txt"), "text")
    assert hits.count() == 6
    assert {"sent_ranges", "context", "keyword", "parent_id", "text", "topic"} == set(hits.columns)
    assert ws.segment("a", "text", 2).count() == 4  # read and saved under one name
    assert ws.store.versions("a") == [1, 2]
    ws.group_by_count("a", "counts", "topic")
    assert rows(ws.load("counts")) == [("t0", 3), ("t1", 1)]
    ws.group_by_condense("a", "joined", "topic", "text", " ")
    assert ws.load("joined").where("topic = 't0'").first().text == "Obama is fun. Good luck! Luck. Fun. Luck again."
    ws.join("a", "counts", "both", "topic", "topic")
    assert ws.load("both").columns == ["topic", "text", "count"]
    ws.append_column("a", "both", "text", "copy")
    assert ws.load("both").where("copy is null").count() == 0
    assert ws.ctfidf("a", "words", "topic", "text", 3, "english").count() > 0
    assert ws.similarity("a", "sim", "topic", "text", "english").count() == 4
    assert ws.filter_by("a", "f", "topic = 't1'").count() == 1
    assert ws.sentiment("text", "a", "s").select("sentiment_score").count() == 4
    assert len(ws.sbert("text", "a", clip=2, new_view="e").first().sbert) == 256
    assert ws.load("e").count() == 2
    ws.store.drop_old_versions("a")
    assert ws.store.versions("a") == [2]
