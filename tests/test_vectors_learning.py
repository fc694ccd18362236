import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom import operators as op
from corpusloom.operators import cluster


def python_clusters(vectors, eps, min_size, k):
    """Brute force over all pairs."""
    n = len(vectors)
    d = np.sqrt(((vectors[:, None, :] - vectors[None, :, :]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    core = np.array([(row <= eps).sum() >= k for row in d])
    core_distance = np.array([np.sort(row)[k - 1] for row in d])
    label, seen, components = np.full(n, -1), set(), []
    for start in range(n):
        if not core[start] or start in seen:
            continue
        stack, component = [start], []
        seen.add(start)
        while stack:
            i = stack.pop()
            component.append(i)
            for j in np.flatnonzero((d[i] <= eps) & core):
                if j not in seen:
                    seen.add(j)
                    stack.append(j)
        components.append(component)
    p = np.zeros(n)
    number = 0
    for component in components:
        if len(component) < min_size:
            continue
        label[component] = number
        densest = core_distance[component].min()
        p[component] = [densest / core_distance[i] if core_distance[i] else 1.0 for i in component]
        number += 1
    return label, p


def blobs(seed=3):
    rng = np.random.default_rng(seed)
    centers = rng.normal(0, 6, (5, 4))
    parts = [c + rng.normal(0, s, (n, 4)) for c, s, n in zip(centers, (0.3, 0.6, 0.4, 0.9, 0.2), (60, 80, 40, 90, 9))]
    copies = np.repeat(parts[0][:1], 50, axis=0)  # a group of equal rows
    noise = rng.uniform(-12, 12, (40, 4))
    return np.vstack([*parts, copies, noise])


@pytest.mark.parametrize("cell,block", [(4096, 2048), (40, 2048), (40, 16)])
def test_density_cluster_like_brute_force(spark, monkeypatch, cell, block):
    monkeypatch.setattr(cluster, "CELL_ROWS", cell)
    monkeypatch.setattr(cluster, "BLOCK_ROWS", block)
    vectors = blobs()
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(9999, None)], "id long, v array<double>")
    got = {r.id: r for r in op.density_cluster(df, "v", 0.8, "id", 15, 6, include_p=True).collect()}
    label, p = python_clusters(vectors, 0.8, 15, 6)
    assert len(set(label)) > 3
    assert [got[i].hdbscan for i in range(len(vectors))] == label.tolist()
    assert [got[i].hdbscan_p for i in range(len(vectors))] == pytest.approx(p.tolist())
    assert got[9999].hdbscan == -1
    sizes = {r.hdbscan: r["count"] for r in op.cluster_sizes(df.withColumn("hdbscan", F.lit(-1))).collect()}
    assert sizes == {-1: len(vectors) + 1}


def test_density_cluster_without_clusters(spark):
    schema = "id long, v array<double>"
    lone = spark.createDataFrame([(1, [0.0, 0.0]), (2, [9.0, 9.0])], schema)
    assert [r.hdbscan for r in op.density_cluster(lone, "v", 0.5, "id").collect()] == [-1, -1]
    assert op.density_cluster(lone.where("id > 5"), "v", 0.5, "id").count() == 0
    copies = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(20)], schema)
    got = op.density_cluster(copies, "v", 0.5, "id", include_p=True).collect()
    assert {(r.hdbscan, r.hdbscan_p) for r in got} == {(0, 1.0)}


def test_connected_components(spark):
    rng = np.random.default_rng(1)
    edges = [(i, i + 1) for i in range(100, 160)]  # a long path
    edges += [(500, i) for i in range(501, 600)]  # a hub
    edges += [(int(a), int(b)) for a, b in rng.integers(1000, 1100, (80, 2))]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    got = op.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len(want) and {r.node: r.component for r in got} == want
    assert op.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_encode(spark):
    df = spark.createDataFrame([(1, "I like python"), (2, "Diese Welt ist schön."), (3, None)], "id int, t string")
    got = op.encode_text(df, "t").orderBy("id").collect()
    assert all(len(r.sbert) == 256 for r in got)
    assert [round(sum(x * x for x in r.sbert), 6) for r in got] == [1.0, 1.0, 0.0]
    clipped = op.encode_text(df, "t", clip=1, order_by="id")
    assert [r.id for r in clipped.collect()] == [1]

    def load():
        return lambda texts: [np.array([len(t), 1.0]) for t in texts]

    modelled = op.encode_text(df, "t", op.model_encoder(load)).orderBy("id").collect()
    assert [r.sbert for r in modelled] == [[13.0, 1.0], [21.0, 1.0], [0.0, 1.0]]


def test_reduce_dims(spark):
    rng = np.random.default_rng(0)
    data = rng.normal(size=(80, 2)) @ rng.normal(size=(2, 6))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)] + [(99, None)], "id int, v array<double>")
    got = {r.id: r.umap for r in op.reduce_dims(df, "v", 2).collect()}
    assert got.pop(99) is None and len(got) == 80
    low = np.array([got[i] for i in range(80)])
    distance = lambda m: np.linalg.norm(m[:, None] - m[None], axis=-1)
    assert np.allclose(distance(low), distance(data))  # rank 2 data keeps all distances


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(120):
        kind = i % 3
        x = [float(v) for v in rng.normal(4.0 * np.eye(3)[kind], 0.5)]
        label = None if i % 5 == 0 else ("Red", "blue ; x", "Green,y")[kind]
        rows.append((i, x, float(kind), label))
    return spark.createDataFrame(rows, "id long, v array<double>, s double, label string").cache()


def test_train_single(labelled, tmp_path):
    got = op.train_predict(labelled, ["v", "s"], "label", save=str(tmp_path / "m")).collect()
    assert all(r.train == ("red", "blue", "green")[r.id % 3] for r in got)
    learner = op.load_learner(str(tmp_path / "m"))
    assert learner.classes == ["blue", "green", "red"]
    again = op.train_predict(labelled, ["v", "s"], "label", learner=learner).collect()
    assert sorted(again) == sorted(got)


def test_train_multilabel(labelled):
    got = op.train_predict(labelled, ["v"], "label", multilabel=True, binarize=True)
    assert got.columns[-5:] == ["blue", "green", "red", "x", "y"]
    for r in got.collect():
        want = ({"red"}, {"blue", "x"}, {"green", "y"})[r.id % 3]
        assert {c for c in ("blue", "green", "red", "x", "y") if r[c] == 1} == want
    with pytest.raises(ValueError):
        op.train_predict(labelled, ["v"], "label", multilabel=True)


def test_query_sets(labelled):
    learner = op.fit_learner(labelled, ["v"], "label")
    scored = op.class_probabilities(labelled, learner, ["v"]).cache()
    picked = op.query_set(scored, "label", "probabilities", "id", 4, ("uncertainty", "margin")).collect()
    assert len(picked) == 8 and len({r.id for r in picked}) == 8
    open_rows = scored.where("label is null").toPandas()
    best = open_rows.assign(u=1 - open_rows.probabilities.map(max)).sort_values(["u", "id"], ascending=[False, True])
    assert {r.id for r in picked if r.strategy == "uncertainty"} == set(best.id[:4])
    assert all(abs(sum(p) - 1) < 1e-9 for p in open_rows.probabilities)
    per_class = op.classwise_query_set(scored, "label", "probabilities", learner.classes, "id", 3).toPandas()
    assert per_class.groupby("class").size().to_dict() == {"blue": 3, "green": 3, "red": 3}


def test_nearest_per_column(spark):
    df = spark.createDataFrame([(0, 20, 7, 31), (1, 44, 12, 27), (2, 9, 90, 60)], "id long, a int, b int, c int")
    got = {r["class"]: r.id for r in op.nearest_per_column(df, ["a", "b", "c"], 28, 1, "id").collect()}
    assert got == {"a": 0, "b": 1, "c": 1}


def test_binarize(spark):
    df = spark.createDataFrame([(1, "A; b,C"), (2, "b"), (3, None)], "id int, l string")
    got = op.binarize_labels(df, "l", True).orderBy("id").collect()
    assert [(r.a, r.b, r.c) for r in got] == [(1, 1, 1), (0, 1, 0), (None, None, None)]
    assert op.class_names(df, "l") == ["a", "b"]
