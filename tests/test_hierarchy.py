"""The density hierarchy against a plain one over all pairs."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import cluster, hierarchy
from corpusloom.operators.hierarchy import density_hierarchy
from tests.test_vectors_learning import blobs

TABLES = "/root/testdata/sf0.01"


def plain(vectors, least, k):
    """Labels and probabilities by single linkage over all edges, condensed from the top."""
    n = len(vectors)
    d = np.sqrt(((vectors[:, None, :] - vectors[None, :, :]) ** 2).sum(-1))
    core = np.sort(d + np.where(np.eye(n, dtype=bool), np.inf, 0), axis=1)[:, k - 1]
    w = np.maximum(np.maximum(core[:, None], core[None, :]), d)
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    node, children, height, size = list(range(n)), {}, {}, {i: 1 for i in range(n)}
    a, b = np.triu_indices(n, 1)
    # copies first, then as the operator orders its edges between different vectors
    for e in np.lexsort((b, a, d[a, b] > 0, w[a, b])):
        x, y = find(a[e]), find(b[e])
        if x != y:
            new = n + len(children)
            children[new], height[new] = (node[x], node[y]), w[a[e], b[e]]
            size[new] = size[node[x]] + size[node[y]]
            parent[y] = x
            node[x] = new
    density = lambda v: 1 / height[v] if height[v] > 0 else np.inf

    def rows_of(v):
        stack, out = [v], []
        while stack:
            v = stack.pop()
            if v < n:
                out.append(v)
            else:
                stack.extend(children[v])
        return out

    root = n + len(children) - 1
    left, inner, birth, level = {}, {root: []}, {root: 0.0}, {root: []}
    todo = [(root, root)]
    while todo:
        v, c = todo.pop()
        if v < n:
            left[v] = (c, 1 / core[v] if core[v] > 0 else np.inf)
            level[c].append((left[v][1], 1))
            continue
        big = [x for x in children[v] if size[x] >= least]
        for x in children[v]:
            if size[x] < least:
                for r in rows_of(x):
                    left[r] = (c, density(v))
                    level[c].append((density(v), 1))
            elif len(big) == 1:
                todo.append((x, c))
            else:
                inner[c].append(x)
                inner[x], birth[x], level[x] = [], density(v), []
                level[c].append((density(v), size[x]))
                todo.append((x, x))
    stability = {c: sum(m * (at - birth[c]) for at, m in level[c]) for c in inner}
    value, chosen = {}, set()
    for c in sorted(inner, key=lambda c: (-birth[c], c)):  # children are born later
        below = sum(value[x] for x in inner[c])
        value[c] = max(stability[c], below)
        if stability[c] >= below and c != root:
            chosen.add(c)
    home = {}
    for c in sorted(inner, key=lambda c: (birth[c], -c)):
        for x in inner[c]:
            home[x] = home.get(c) or (x if x in chosen else None)
    goal = [home.get(left[i][0]) for i in range(n)]
    number = {}
    for g in goal:
        if g is not None:
            number.setdefault(g, len(number))
    p = []
    for i in range(n):
        most = max(at for at, _ in level[goal[i]]) if goal[i] is not None else 0
        at = left[i][1]
        p.append(0.0 if goal[i] is None else 1.0 if np.isinf(at) or not most else min(at, most) / most)
    return [number.get(g, -1) for g in goal], p


def check(spark, vectors, least=15, k=6):
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(99999, None)], "id long, v array<double>")
    got = {r.id: r for r in density_hierarchy(df, "v", "id", least, k, include_p=True).collect()}
    label, p = plain(np.asarray(vectors, float), least, k)
    assert [got[i].hdbscan for i in range(len(vectors))] == label
    assert [got[i].hdbscan_p for i in range(len(vectors))] == pytest.approx(p)
    assert got[99999].hdbscan == -1 and len(got) == len(vectors) + 1
    return label


@pytest.mark.parametrize("cell,block,band", [(4096, 2048, 1 << 17), (30, 16, 25)])
def test_blobs_like_brute_force(spark, monkeypatch, cell, block, band):
    """One task for all, and rounds over many cells, blocks and bands."""
    monkeypatch.setattr(cluster, "CELL_ROWS", cell)
    monkeypatch.setattr(cluster, "BLOCK_ROWS", block)
    monkeypatch.setattr(hierarchy, "BAND", band)
    assert len(set(check(spark, blobs()))) > 4


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_of_different_density(spark, seed):
    draw = np.random.default_rng(seed)
    nested = [draw.normal(0, 3, (120, 2)), draw.normal((1, 1), 0.1, (60, 2)), draw.normal((-2, 0), 0.2, (60, 2)), draw.normal((30, 0), 2, (100, 2))]
    check(spark, np.vstack(nested), 12, 4)


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="test tables not present")
def test_tables_like_brute_force(spark):
    from corpusloom.plans.queries import QUERIES

    rows = spark.read.parquet(f"{TABLES}/embeddings.parquet").orderBy("vec_id").collect()
    label, p = plain(np.array([r.embedding for r in rows], float), 15, 6)
    got = {r.vec_id: r for r in QUERIES["density_hierarchy"](spark, TABLES).collect()}
    assert [got[r.vec_id].hdbscan for r in rows] == label
    assert [got[r.vec_id].hdbscan_p for r in rows] == pytest.approx(p, abs=1e-6)


def test_awkward_rows(spark):
    schema = "id long, v array<double>"
    assert density_hierarchy(spark.createDataFrame([], schema), "v", "id").count() == 0
    few = spark.createDataFrame([(1, [0.0]), (2, [1.0]), (3, None)], schema)
    assert [r.hdbscan for r in density_hierarchy(few, "v", "id").collect()] == [-1] * 3
    copies = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(30)], schema)
    assert {r.hdbscan for r in density_hierarchy(copies, "v", "id").collect()} == {-1}  # never all rows as one
    two = copies.union(spark.createDataFrame([(i, [5.0, 1.0]) for i in range(100, 130)], schema)).withColumn("id", F.col("id").cast("string"))
    got = density_hierarchy(two, "v", "id", include_p=True).collect()
    assert {(r.hdbscan, r.hdbscan_p, float(r.v[0])) for r in got} == {(0, 1.0, 5.0), (1, 1.0, 1.0)} or len({r.hdbscan for r in got}) == 2


def nested(depth=14, n=20):
    """Groups in pairs, each pair closer together than the last and beside it: as many levels of clusters."""
    draw = np.random.default_rng(8)
    return np.vstack([draw.normal((3.0**-i, 3.0**-i), 0.02 * 3.0**-i, (n, 2)) for i in range(depth)])


@pytest.mark.parametrize("one_task", [0, 1 << 21])
def test_rounds_and_one_task_agree(spark, monkeypatch, one_task):
    """what fits one task gives the same there as by rounds over the cluster."""
    monkeypatch.setattr(cluster, "CELL_ROWS", 60)
    monkeypatch.setattr(cluster, "BLOCK_ROWS", 32)
    monkeypatch.setattr(hierarchy, "BAND", 40)
    monkeypatch.setattr(hierarchy, "ONE_TASK", one_task)
    check(spark, nested(8), 10, 4)


def test_tables_do_not_grow_with_the_levels(spark, monkeypatch):
    """a deep tree of clusters is not walked by one job a level."""
    tables = []
    monkeypatch.setattr(hierarchy, "written", lambda df, written=hierarchy.written: tables.append(df) or written(df))
    assert max(check(spark, nested(), 10, 4)) >= 12
    assert len(tables) <= 20


@pytest.mark.parametrize("shift,scale", [(0.0, 1.0), (1e4, 1.0), (0.0, 1e-9), (0.0, 1e17)])
def test_no_near_pair_is_missed(shift, scale):
    """F1: pairs are chosen in single precision; pairs within reach are all among them, few others, no row with itself."""
    from corpusloom.operators.blocks import Block

    draw = np.random.default_rng(9)
    vec = (draw.normal(size=(150, 12)) + shift) * scale
    sides = []
    for ids in (np.arange(100), np.arange(50, 150)):
        block = Block.__new__(Block)
        block.id, block.vec, block.length, block.small, block.ids = ids, vec[ids], (vec[ids] ** 2).sum(1), None, None
        sides.append(block)
    a, b = sides
    d = np.sqrt(((a.vec[:, None] - b.vec[None]) ** 2).sum(-1))
    d[a.id[:, None] == b.id[None]] = np.inf
    reach = np.sort(d, axis=1)[np.arange(100), draw.integers(0, 40, 100)]
    rows = np.arange(0, 100, 3)
    for k in (0, 2):
        i, j = a.near(rows, b, reach, k)
        got, wanted = set(zip(rows[i].tolist(), j.tolist())), set(zip(*map(np.ndarray.tolist, np.nonzero(d <= reach[:, None]))))
        wanted = {(x, y) for x, y in wanted if x in set(rows.tolist()) and (not k or d[x, y] <= np.sort(d[x])[k - 1])}
        assert wanted <= got and all(a.id[x] != b.id[y] for x, y in got)
        assert shift or scale < 1 or k or got == wanted
