"""Density clustering without a radius: the whole mutual-reachability hierarchy, condensed and cut by stability.

1. Core distances. Each vector belongs to the cell of its nearest pivot. A bound from its own block and from the pivots
   limits how far its ``min_samples``-th neighbour, and ``MORE`` behind it, can be; it looks into the cells within that bound.
2. Minimum spanning tree by Boruvka rounds. Each component takes its lightest edge to another one. Neighbours and
   pivots give it a first edge, and only rows that could have a lighter one beyond their neighbours look for it, in cells
   that hold other components. Both sides know what is found and edges are in a strict order (weight, ends), so rounds
   never close a circle.
3. Dendrogram. Edges are cut by rank into bands of ``BAND`` edges. Halving the bands level by level, the lower half's
   components become nodes of the upper half, so that finally each band is merged by one task on its own, whatever the
   size of its components.
4. Condensed tree, stability and selection by joins: pointer doubling within a cluster, rounds over the tree of clusters.

Everything that is read more than once is written to the checkpoint folder. Nothing but pivots and one row per cell reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegralType

from corpusloom.operators import cluster
from corpusloom.operators.blocks import NEAREST, Block, Nearest, matrix as _matrix, meet, packed, placed, squared_distances as _squared
from corpusloom.operators.cluster import NOISE
from corpusloom.operators.components import connected_components
from corpusloom.operators.relational import with_row_id
from corpusloom.runtime import written

BAND = 1 << 17
MORE = 10  # neighbours known of a row beyond those of its core distance
ONE_TASK = 1 << 21  # rows of a few numbers that one task may hold; what is larger goes by rounds over the cluster
_EDGE = "comp bigint, w double, a bigint, b bigint, other bigint"


def density_hierarchy(
    df: DataFrame, vec: str, id_col: str, min_cluster_size: int = 15, min_samples: int = 6, include_p: bool = False, out: str = "hdbscan"
) -> DataFrame:
    """Add ``hdbscan`` (0.. by smallest ``id_col``, -1 for noise) and optionally ``hdbscan_p``.

    A row's core distance is the distance to the ``min_samples``-th other row, an edge weighs as much as the largest of
    the ends' core distances and their distance. Clusters are the most stable ones of the condensed tree, never all
    rows as one. ``hdbscan_p`` is the row's density over the highest of its cluster, 0 for noise. Null vectors are
    noise, equal vectors always share their label. Ids that are no integers are numbered in their order first.
    Fewer than ``min_samples`` + 1 rows are noise. Runs its jobs when called.
    """
    if min_cluster_size < 2 or min_samples < 1:
        raise ValueError("min_cluster_size must be 2 at least, min_samples 1")
    if not isinstance(df.schema[id_col].dataType, IntegralType):
        numbers = with_row_id(df.select(F.col(id_col).alias("__key")).where("__key IS NOT NULL").distinct(), "__key", "__number")
        numbered = df.join(numbers, F.col(id_col) == F.col("__key"), "left").drop("__key")
        return density_hierarchy(numbered, vec, "__number", min_cluster_size, min_samples, include_p, out).drop("__number")
    vector = F.col(vec).cast("array<double>")
    points = with_row_id(
        df.where(F.col(vec).isNotNull()).groupBy(vector.alias("vec")).agg(F.min(F.col(id_col).cast("bigint")).alias("first_id"), F.count(F.lit(1)).alias("copies")),
        name="id",
    )
    points = written(points.select("id", "vec", "copies", "first_id"))
    rows = points.agg(F.sum("copies")).first()[0] or 0
    if rows <= min_samples:
        labels = points.select("id", F.lit(None).cast("int").alias("label"), F.lit(0.0).alias("p"))
    else:
        cores, near, pivots = core_distances(points, min_samples)
        edges = spanning_tree(cores, near, pivots)
        merges = dendrogram(points.select("id", "copies"), edges)
        labels = stable_clusters(cores.join(points.select("id", "first_id"), "id"), merges, min_cluster_size)
    found = points.join(labels, "id").select(F.col("vec").alias("__vec"), F.col("label").alias(out), F.col("p").alias("__p"))
    result = df.join(found, vector.eqNullSafe(F.col("__vec")), "left").withColumn(out, F.coalesce(out, F.lit(NOISE)))
    if include_p:
        result = result.withColumn(f"{out}_p", F.coalesce("__p", F.lit(0.0)))
    return result.drop("__vec", "__p")


# --- meeting rows that may be near each other ---------------------------------------------------------


class Pivots:
    """At most ``cluster.MAX_PIVOTS`` rows, with what is known of them."""

    def __init__(self, points: DataFrame):
        wanted = max(1, min(cluster.MAX_PIVOTS, points.count() // cluster.CELL_ROWS))
        self.rows = points.orderBy(F.xxhash64("id"), "id").limit(wanted).select("id", "vec").collect()
        self.vec = np.array([r.vec for r in self.rows], np.float64).reshape(len(self.rows), -1)
        self.ids = np.array([r.id for r in self.rows], np.int64)

    def known(self, points: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Core distance and component of each pivot."""
        found = {r.id: (r.core, r.comp) for r in points.where(F.col("id").isin([int(i) for i in self.ids])).select("id", "core", "comp").collect()}
        return np.array([found[int(i)][0] for i in self.ids]), np.array([found[int(i)][1] for i in self.ids], np.int64)


def _bound(k: int):
    """Per row the distance within which ``k`` others lie, as far as its own block tells."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        vectors, copies = _matrix(table.column("vec")), table.column("copies").to_numpy()
        squared = _squared(vectors, vectors)
        first = np.argpartition(squared, k, axis=1)[:, : k + 1] if k + 1 < len(squared) else np.tile(np.arange(len(squared)), (len(squared), 1))
        order = np.take_along_axis(first, np.argsort(np.take_along_axis(squared, first, axis=1), axis=1), axis=1)
        others = copies[order].cumsum(axis=1) - 1
        enough = others >= k
        at = order[np.arange(len(order)), enough.argmax(axis=1)]
        length = (vectors * vectors).sum(1)
        far = np.sqrt(squared[np.arange(len(at)), at] + 1e-12 * (length + length[at] + 1.0)) * (1 + 1e-9)
        return pa.table({"id": table.column("id"), "reach": pa.array(np.where(enough[:, -1], far, np.inf))})

    return run


def core_distances(points: DataFrame, min_samples: int) -> tuple[DataFrame, DataFrame, Pivots]:
    """Rows with ``core`` (the distance of the ``min_samples``-th other row) and ``radius``, edges ``(a, b, d)`` to all rows nearer than that."""
    pivots = Pivots(points)
    k, listed = min_samples, min_samples + MORE
    fresh = points.select("id", "vec", "copies", F.lit(0.0).alias("core"), F.col("id").alias("comp"), F.lit(-1.0).alias("reach"))
    homes = written(placed(fresh, pivots.vec).select("id", "vec", "copies", "home"))
    sizes = F.broadcast(homes.groupBy("home").agg(F.ceil(F.count(F.lit(1)) / cluster.BLOCK_ROWS).alias("blocks")))
    blocked = homes.join(sizes, "home").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    bounds = written(blocked.groupBy("home", "block").applyInArrow(_bound(listed), "id bigint, reach double"))
    looking = fresh.drop("reach").join(bounds, "id")
    lists = meet(packed(placed(looking, pivots.vec), cluster.BLOCK_ROWS), pivots.vec.shape[1], lambda: Nearest(listed), NEAREST)
    # One list for each stretch of blocks that a row was compared with.
    merged = written(lists.groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, listed).alias("near")))
    start = F.struct((F.col("copies") - 1).alias("seen"), F.when(F.col("copies") > k, F.lit(0.0)).alias("at"))

    def walk(acc, e):
        seen = acc["seen"] + e["n"]
        return F.struct(seen.alias("seen"), F.coalesce(acc["at"], F.when(seen >= k, e["d"])).alias("at"))

    known = written(
        points.join(merged, "id", "left").withColumn("near", F.coalesce("near", F.array().cast("array<struct<d:double,id:bigint,n:bigint>>")))
        .withColumn("core", F.aggregate("near", start, walk)["at"])
        .withColumn("radius", F.coalesce(F.get("near", F.lit(listed - 1))["d"], "core"))
    )
    edges = known.select(F.col("id").alias("a"), F.explode("near").alias("e")).select("a", F.col("e.id").alias("b"), F.col("e.d").alias("d"))
    return known.select("id", "vec", "copies", "core", "radius"), edges, pivots


# --- spanning tree ------------------------------------------------------------------------------------


def _lightest(comp, w, a, b, other) -> pa.Table:
    """The lightest edge of each component, by weight and ends."""
    low, high = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((high, low, w, comp))
    comp = comp[order]
    first = np.flatnonzero(np.append(True, comp[1:] != comp[:-1])) if len(comp) else order[:0]
    order = order[first]
    columns = (comp[first], w[order], low[order], high[order], other[order])
    return pa.table({n: pa.array(c) for n, c in zip(("comp", "w", "a", "b", "other"), columns)})


class _Outgoing:
    """Per component of looking rows their lightest edge to another component, within reach."""

    def __init__(self):
        self.found: list[pa.Table] = []

    def meet(self, a: Block, b: Block, rows: np.ndarray) -> None:
        if a.comp[rows[0]] == b.comp[0] and (a.comp[rows] == b.comp[0]).all() and (b.comp == b.comp[0]).all():
            return
        i, j = a.near(rows, b, a.reach)
        if len(i) <= 64 * len(rows):
            open_ = a.comp[rows[i]] != b.comp[j]
            return self._keep(a, b, rows[i[open_]], j[open_])
        foreign = a.comp[rows][:, None] != b.comp[None, :]
        squared = a.squared(rows, b)
        doubt = 1e-12 * (a.length[rows][:, None] + b.length[None, :] + 1.0)
        base = np.maximum(a.core[rows][:, None], b.core[None, :])
        least = np.where(foreign, np.maximum(base, np.sqrt(np.maximum(squared - doubt, 0.0))), np.inf)
        most = np.where(foreign, np.maximum(base, np.sqrt(squared + doubt)), np.inf).min(axis=1, initial=np.inf)
        limit = np.minimum(most, a.reach[rows] * (1 + 1e-9))
        i, j = np.nonzero((least <= limit[:, None]) & foreign)
        self._keep(a, b, rows[i], j)

    def _keep(self, a: Block, b: Block, i: np.ndarray, j: np.ndarray) -> None:
        if len(i):
            w = np.maximum(np.maximum(a.core[i], b.core[j]), a.exact(i, b, j))
            self.found.append(_lightest(a.comp[i], w, a.id[i], b.id[j], b.comp[j]))

    def leave(self, a: Block) -> None:
        if len(self.found) > 1:
            self.found = [self.end()]

    def end(self) -> pa.Table | None:
        if not self.found:
            return None
        return _lightest(*(pa.concat_tables(self.found).column(c).to_numpy() for c in ("comp", "w", "a", "b", "other")))


def _to_pivots(pivots: Pivots, core: np.ndarray, comp: np.ndarray):
    """Per batch each component's lightest edge to a pivot of another one, told to both."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for full in batches:
            for start in range(0, full.num_rows, 256):
                batch = full.slice(start, 256)
                vectors, own = _matrix(batch.column("vec")), batch.column("comp").to_numpy()
                d = np.sqrt(((vectors[:, None, :] - pivots.vec[None, :, :]) ** 2).sum(-1)) if len(pivots.ids) <= 64 else np.sqrt(_squared(vectors, pivots.vec))
                w = np.maximum(np.maximum(batch.column("core").to_numpy()[:, None], core[None, :]), d)
                w = np.where(own[:, None] != comp[None, :], w, np.inf)
                j = w.argmin(axis=1)
                i = np.flatnonzero(np.isfinite(w[np.arange(len(j)), j]))
                j, ids = j[i], batch.column("id").to_numpy()[i]
                exact = np.sqrt(((vectors[i] - pivots.vec[j]) ** 2).sum(axis=1))
                weight = np.maximum(np.maximum(batch.column("core").to_numpy()[i], core[j]), exact)
                ends = (np.append(own[i], comp[j]), np.append(weight, weight), np.append(ids, pivots.ids[j]), np.append(pivots.ids[j], ids), np.append(comp[j], own[i]))
                yield from _lightest(*ends).to_batches()

    return task


def _prim(table: pa.Table) -> pa.Table:
    """The whole tree of one block of rows."""
    ids, vectors, core = table.column("id").to_numpy(), _matrix(table.column("vec")), table.column("core").to_numpy()
    order = np.argsort(ids)
    ids, vectors, core = ids[order], vectors[order], core[order]
    weight, parent, inside = np.full(len(ids), np.inf), np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
    edges, at = [], 0
    for _ in range(len(ids) - 1):
        inside[at] = True
        w = np.maximum(np.maximum(core[at], core), np.sqrt(((vectors - vectors[at]) ** 2).sum(axis=1)))
        key = lambda p: (np.minimum(ids[p], ids), np.maximum(ids[p], ids))
        (low, high), (low_now, high_now) = key(at), key(parent)
        better = (w < weight) | (w == weight) & ((low < low_now) | (low == low_now) & (high < high_now))
        better &= ~inside
        weight[better], parent[better] = w[better], at
        open_ = np.flatnonzero(~inside)
        low, high = np.minimum(ids[parent[open_]], ids[open_]), np.maximum(ids[parent[open_]], ids[open_])
        at = int(open_[np.lexsort((high, low, weight[open_]))[0]])
        edges.append((min(ids[at], ids[parent[at]]), max(ids[at], ids[parent[at]]), weight[at]))
    return pa.table({n: pa.array([e[i] for e in edges], kind) for i, (n, kind) in enumerate((("a", pa.int64()), ("b", pa.int64()), ("w", pa.float64())))})


def spanning_tree(cores: DataFrame, near: DataFrame, pivots: Pivots) -> DataFrame:
    """``(a, b, w)``, one edge fewer than rows."""
    if cores.count() <= cluster.BLOCK_ROWS:
        return written(cores.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(_prim, "a bigint, b bigint, w double"))
    points = written(cores.select("id", "vec", "copies", "core", F.col("id").alias("comp"), F.lit(-1.0).alias("reach"), "radius"))
    core = points.select("id", "core")
    # Mutual reachability of the neighbours that the core distances were taken from.
    light = written(
        near.join(core.select(F.col("id").alias("a"), F.col("core").alias("core_a")), "a").join(core.select(F.col("id").alias("b"), F.col("core").alias("core_b")), "b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.greatest("d", "core_a", "core_b").alias("w")).distinct()
    )
    tree = None
    first = F.min(F.struct("w", "a", "b", "other")).alias("e")
    while points.select("comp").distinct().limit(2).count() > 1:
        of = points.select("id", "comp")
        light = written(
            light.join(of.select(F.col("id").alias("a"), F.col("comp").alias("comp")), "a").join(of.select(F.col("id").alias("b"), F.col("comp").alias("other")), "b").where("comp <> other")
        )
        back = light.select(F.col("other").alias("comp"), "w", "a", "b", F.col("comp").alias("other"))
        known = light.select("comp", "w", "a", "b", "other").unionByName(back)
        to_pivots = points.mapInArrow(_to_pivots(pivots, *pivots.known(points)), _EDGE)
        bound = written(known.unionByName(written(to_pivots)).groupBy("comp").agg(first).select("comp", "e.*"))
        light = light.select("a", "b", "w")
        looking = points.drop("reach").join(bound.select("comp", F.col("w").alias("reach")), "comp").withColumn(
            "reach", F.when((F.col("core") < F.col("reach")) & (F.col("radius") <= F.col("reach")), F.col("reach")).otherwise(F.lit(-1.0))
        )
        cells = {r["home"]: (r["lo"], r["hi"]) for r in _cells(points, pivots).collect()}  # one row per pivot at most
        low, high = (np.array([cells.get(i, (0, 0))[side] for i in range(len(pivots.vec))]) for side in (0, 1))
        lighter = written(meet(packed(placed(looking, pivots.vec, low, high), cluster.BLOCK_ROWS), pivots.vec.shape[1], _Outgoing, _EDGE))
        back = lighter.select(F.col("other").alias("comp"), "w", "a", "b", F.col("comp").alias("other"))
        chosen = written(bound.unionByName(lighter).unionByName(back).groupBy("comp").agg(first).select("comp", "e.*"))
        new = chosen.select("a", "b", "w").distinct()
        tree = written(new if tree is None else tree.unionByName(new))
        merged = _components(chosen.select(F.lit(0).alias("part"), F.col("comp").alias("a"), F.col("other").alias("b")), chosen.count()).withColumnsRenamed({"comp": "component", "id": "node"})
        points = written(points.join(merged, points["comp"] == merged["node"]).select("id", "vec", "copies", "core", F.col("component").alias("comp"), "reach", "radius"))
    return tree


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest number connected with each of ``n``."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root


def _components(edges: DataFrame, most: int) -> DataFrame:
    """``(part, id, comp)``: the smallest node connected with each node of ``edges (part, a, b)`` inside its part of ``most`` edges at most."""
    if most > ONE_TASK:
        end = lambda c: F.struct("part", F.col(c).alias("id"))
        return connected_components(edges.select(end("a").alias("a"), end("b").alias("b"))).select("node.*", F.col("component.id").alias("comp"))

    def task(key: tuple, table: pa.Table) -> pa.Table:
        a, b = table.column("a").to_numpy(), table.column("b").to_numpy()
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        comp = nodes[_roots(at[: len(a)], at[len(a) :], len(nodes))]
        return pa.table({"part": pa.array(np.full(len(nodes), key[0].as_py(), np.int64)), "id": nodes, "comp": comp})

    return edges.groupBy("part").applyInArrow(task, "part bigint, id bigint, comp bigint")


def _cells(points: DataFrame, pivots: Pivots) -> DataFrame:
    return placed(points, pivots.vec).groupBy("home").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))


# --- dendrogram ---------------------------------------------------------------------------------------

_MERGE = "rank bigint, w double, left bigint, left_size bigint, right bigint, right_size bigint"


def _merge_band(edges: pa.Table, nodes: pa.Table) -> pa.Table:
    """Merges of one band's edges in order; a side is named by its last merge, or by its row as -1 - id."""
    find = {n: (n, s, t) for n, s, t in zip(*(nodes.column(c).to_pylist() for c in ("node", "size", "top")))}

    def root(n: int) -> int:
        path = []
        while find[n][0] != n:
            path.append(n)
            n = find[n][0]
        for p in path:
            find[p] = (n, 0, 0)
        return n

    out = []
    for rank, w, a, b in sorted(zip(*(edges.column(c).to_pylist() for c in ("rank", "w", "a", "b")))):
        a, b = sorted((root(a), root(b)))
        (_, size_a, top_a), (_, size_b, top_b) = find[a], find[b]
        out.append((rank, w, top_a, size_a, top_b, size_b))
        find[a], find[b] = (a, size_a + size_b, rank), (a, 0, 0)
    names = [f.split()[0] for f in _MERGE.split(", ")]
    return pa.table({n: pa.array([o[i] for o in out], pa.float64() if n == "w" else pa.int64()) for i, n in enumerate(names)})


def dendrogram(sizes: DataFrame, tree: DataFrame) -> DataFrame:
    """Every merge of single linkage: rank of its edge, weight, and both sides (rank of the side's last merge, or -1 - id) with their rows."""
    edges = written(with_row_id(tree, ["w", "a", "b"], "rank").select("rank", "w", "a", "b"))
    nodes = sizes.select(F.lit(0).cast("bigint").alias("part"), F.col("id").alias("node"), F.col("copies").alias("size"), (-1 - F.col("id")).alias("top"))
    width = BAND
    while width < edges.count():
        width *= 2
    edges = edges.withColumn("part", F.floor(F.col("rank") / width))
    while width > BAND:
        # The lower half of every part becomes a part of its own; the upper half sees its components as nodes.
        width //= 2
        half = F.floor(F.col("rank") / width)
        low, high = edges.where(half % 2 == 0), edges.where(half % 2 == 1)
        comps = written(_components(low.select("part", "a", "b"), width).withColumnRenamed("id", "node"))
        tops = low.join(comps, (low["part"] == comps["part"]) & (low["a"] == comps["node"])).groupBy(low["part"], "comp").agg(F.max("rank").alias("last"))
        grown = nodes.join(comps, ["part", "node"], "left").withColumn("comp", F.coalesce("comp", "node"))
        above = grown.groupBy("part", "comp").agg(F.sum("size").alias("size"), F.max("top").alias("top")).join(tops, ["part", "comp"], "left")
        above = above.select((F.col("part") * 2 + 1).alias("part"), F.col("comp").alias("node"), "size", F.coalesce("last", "top").alias("top"))
        for c in ("a", "b"):
            other = comps.select("part", F.col("node").alias(c), F.col("comp").alias("to"))
            high = high.join(other, ["part", c], "left").withColumn(c, F.coalesce("to", c)).drop("to")
        edges = written(low.withColumn("part", F.col("part") * 2).unionByName(high.withColumn("part", F.col("part") * 2 + 1)))
        ends = edges.select("part", F.explode(F.array("a", "b")).alias("node")).distinct()
        below = nodes.withColumn("part", F.col("part") * 2)
        nodes = written(below.unionByName(above).join(ends, ["part", "node"], "left_semi"))
    bands = edges.groupBy("part").cogroup(nodes.groupBy("part"))
    return written(bands.applyInArrow(_merge_band, _MERGE))


# --- condensed tree -----------------------------------------------------------------------------------


def _doubled(table: pa.Table) -> pa.Table:
    node, goal, open_ = (table.column(c).to_numpy() for c in ("node", "goal", "open"))
    order = np.argsort(node)
    node, goal, open_ = node[order], goal[order], open_[order]
    while open_.any():
        i = np.flatnonzero(open_)
        at = np.minimum(np.searchsorted(node, goal[i]), len(node) - 1)
        known = node[at] == goal[i]
        goal[i], open_[i] = np.where(known, goal[at], goal[i]), known & open_[at]
    return pa.table({"node": node, "goal": goal})


def _followed(steps: DataFrame) -> DataFrame:
    """``(node, goal)``: where ``steps (node, goal, open)`` lead while goals are nodes that are open themselves; by doubling."""
    state = written(steps)
    if state.count() <= ONE_TASK:
        return state.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(_doubled, "node bigint, goal bigint")
    while not state.where("open").isEmpty():
        more = state.select(F.col("node").alias("goal"), F.col("goal").alias("then"), F.col("open").alias("still"))
        jumped = state.where("open").join(more, "goal", "left").select(
            "node", F.coalesce("then", "goal").alias("goal"), F.coalesce("still", F.lit(False)).alias("open")
        )
        state = written(state.where("NOT open").unionByName(jumped))
    return state.select("node", "goal")


def stable_clusters(rows: DataFrame, merges: DataFrame, least: int) -> DataFrame:
    """``(id, label, p)`` of the rows in clusters; labels count from 0 by the smallest ``first_id``."""
    density = F.when(F.col("w") > 0, 1 / F.col("w")).otherwise(F.lit(float("inf")))
    total = F.col("left_size") + F.col("right_size")
    both = merges.withColumn("size", total).withColumn("at", density).select("rank", "at", F.explode(F.array(
        F.struct(F.col("left").alias("node"), F.col("left_size").alias("size"), F.col("right_size").alias("beside")),
        F.struct(F.col("right").alias("node"), F.col("right_size").alias("size"), F.col("left_size").alias("beside")),
    )).alias("s"))
    sides = written(both.select(F.col("s.node").alias("node"), F.col("s.size").alias("size"), F.col("s.beside").alias("beside"), F.col("rank").alias("above"), "at"))
    # Small sides climb to the first merge that has enough rows; fewer than `least` steps.
    small = sides.where(F.col("size") < least)
    climbed = _followed(small.select("node", F.col("above").alias("goal"), F.lit(True).alias("open")))
    # Clusters begin at the top and where both sides of a merge have enough rows; else a merge continues the one above.
    large = sides.where(F.col("size") >= least)
    continued = _followed(large.select("node", F.when(F.col("beside") < least, F.col("above")).otherwise(F.col("node")).alias("goal"), (F.col("beside") < least).alias("open")))
    continued = written(continued)
    cluster_of = lambda name: continued.select(F.col("node").alias(name), F.col("goal").alias("cluster"))
    top = merges.agg(F.max("rank").alias("rank")).first()["rank"]
    points = rows.withColumn("node", -1 - F.col("id")).withColumn("alone", F.when(F.col("core") > 0, 1 / F.col("core")).otherwise(F.lit(float("inf"))))
    if top is None:
        return points.select("id", F.lit(None).cast("int").alias("label"), F.lit(0.0).alias("p")).limit(0)
    at = merges.select(F.col("rank").alias("goal"), density.alias("at"))
    left = points.join(climbed, "node", "left").join(at, "goal", "left")
    left = left.select("id", "first_id", "copies", F.coalesce("goal", "node").alias("place"), F.coalesce("at", "alone").alias("density"))
    left = written(left.join(cluster_of("place"), "place", "left").withColumn("cluster", F.coalesce("cluster", F.lit(top))).drop("place"))
    # Tree of clusters, without the one of all rows.
    begun = large.where(F.col("beside") >= least).select(F.col("node").alias("cluster"), "size", F.col("at").alias("birth"), F.col("above").alias("place"))
    begun = begun.join(cluster_of("place").withColumnRenamed("cluster", "parent"), "place", "left").withColumn("parent", F.coalesce("parent", F.lit(top))).drop("place")
    begun = written(begun)
    # A merge of the topmost chain is followed to the top, which has no side of its own.
    leaving = left.select("cluster", F.col("copies").alias("n"), F.col("density").alias("at")).unionByName(begun.select(F.col("parent").alias("cluster"), F.col("size").alias("n"), F.col("birth").alias("at")))
    own = begun.join(leaving, "cluster").groupBy("cluster", "parent", "birth").agg(
        F.sum(F.col("n") * (F.col("at") - F.col("birth"))).alias("stability"), F.max("at").alias("densest")
    )
    clusters = written(own)
    chosen = _selected(clusters)
    member = left.join(chosen.withColumnRenamed("node", "cluster"), "cluster").join(clusters.select(F.col("cluster").alias("goal"), "densest"), "goal")
    member = written(member.withColumn("p", F.when((F.col("density") == float("inf")) | (F.col("densest") == 0), 1.0).otherwise(F.least("density", "densest") / F.col("densest"))))
    numbered = with_row_id(member.groupBy("goal").agg(F.min("first_id").alias("first_id")), "first_id", "label").select("goal", "label")
    return member.join(numbered, "goal").select("id", F.col("label").cast("int").alias("label"), "p")


def _chosen(table: pa.Table) -> pa.Table:
    """What :func:`_selected` finds, in one task. Clusters are named by ranks, those inside others by smaller ones."""
    order = np.argsort(table.column("cluster").to_numpy())
    names, parents, stable = (table.column(c).to_numpy()[order].tolist() for c in ("cluster", "parent", "stability"))
    place = {c: i for i, c in enumerate(names)}
    above = [place.get(p, -1) for p in parents]
    inside, chosen = [0.0] * len(names), [False] * len(names)
    for i, (up, s) in enumerate(zip(above, stable)):
        kept = s != s or s >= inside[i]  # as in SQL, NaN is the largest
        chosen[i] = kept
        if up >= 0:
            inside[up] += s if kept else inside[i]
    goal: list[int | None] = [None] * len(names)
    for i in range(len(names) - 1, -1, -1):
        over = goal[above[i]] if above[i] >= 0 else None
        goal[i] = names[i] if over is None and chosen[i] else over
    kept = [i for i, g in enumerate(goal) if g is not None]
    return pa.table({"node": pa.array([names[i] for i in kept], pa.int64()), "goal": pa.array([goal[i] for i in kept], pa.int64())})


def _selected(clusters: DataFrame) -> DataFrame:
    """``(node, goal)``: for every cluster inside a selected one, or selected itself, the topmost such."""
    if clusters.count() <= ONE_TASK // 4:  # rows become Python objects
        return written(clusters.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(_chosen, "node bigint, goal bigint"))
    state = written(clusters.select("cluster", "parent", "stability", F.lit(None).cast("double").alias("value"), F.lit(False).alias("chosen")))
    while True:  # from the leaves up: a cluster is kept if it is no less stable than what lies in it
        below = state.groupBy(F.col("parent").alias("cluster")).agg(F.sum("value").alias("inside"), F.count_if(F.col("value").isNull()).alias("open"))
        ready = state.join(below, "cluster", "left").withColumn("ready", F.col("value").isNull() & (F.coalesce("open", F.lit(0)) == 0))
        inside = F.coalesce("inside", F.lit(0.0))
        renewed = written(ready.select(
            "cluster", "parent", "stability", F.when(F.col("ready"), F.greatest("stability", inside)).otherwise(F.col("value")).alias("value"),
            F.when(F.col("ready"), F.col("stability") >= inside).otherwise(F.col("chosen")).alias("chosen"),
        ))
        state = renewed
        if state.where("value IS NULL").isEmpty():
            break
    pending = state.select("cluster", "parent", "chosen")
    done = pending.select("cluster", F.lit(None).cast("bigint").alias("goal")).limit(0)  # there may be no cluster but all rows
    known = pending.select("parent").distinct().join(pending.select(F.col("cluster").alias("parent")), "parent", "left_anti").select(F.col("parent").alias("cluster"), F.lit(None).cast("bigint").alias("goal"))
    while not known.isEmpty():  # from the top down: what lies in a chosen cluster belongs to it
        above = known.select(F.col("cluster").alias("parent"), F.col("goal").alias("over"))
        known = written(pending.join(above, "parent").select("cluster", F.coalesce("over", F.when(F.col("chosen"), F.col("cluster"))).alias("goal")))
        done = written(done.unionByName(known))
    return done.where("goal IS NOT NULL").select(F.col("cluster").alias("node"), "goal")
