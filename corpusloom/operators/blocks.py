"""Pairs of blocks of vectors that may hold neighbours, met without copying a row for each pair.

Rows of a cell are packed, some ``BLOCK_ROWS`` at a time, into one row of arrays and written once. Blocks then meet in a
Cartesian product of the written table with itself: a task reads two stretches of it and passes over pairs of which no
row looks into the other's cell. Nothing is shuffled for a pair, so what is written and shuffled grows with the rows only.
What a task finds it keeps until its left block, or the task, ends.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusloom.runtime import written

FILE_BLOCKS = 16
_ROWS_PER_STEP = 256
NO_ID = -(1 << 63)
STATE = {"id": np.int64, "copies": np.int64, "core": np.float64, "comp": np.int64, "reach": np.float64}
POINT = "id bigint, vec array<double>, copies bigint, core double, comp bigint, reach double"
_PACKED = "number bigint, cell int, " + ", ".join(f"{c} binary" for c in STATE) + ", vec binary, halo binary, bits array<bigint>"


def matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(column) and len(flat) % len(column):
        raise ValueError("vectors must all have the same length")
    return flat.reshape(len(column), -1).astype(np.float64, copy=False)


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T), 0.0)


def placed(points: DataFrame, centers: np.ndarray, low: np.ndarray | None = None, high: np.ndarray | None = None) -> DataFrame:
    """``points`` with ``home``, the cell of the nearest center, and ``halo``, a bit for each cell within ``reach``, its own included.

    Cells that hold nothing but the row's own component, from ``low`` to ``high``, are left out; so is every cell if ``reach`` is negative.
    """
    norms = (centers * centers).sum(1)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for full in batches:
            for start in range(0, full.num_rows, _ROWS_PER_STEP):  # the distance matrix is rows times centers
                batch = full.slice(start, _ROWS_PER_STEP)
                vectors = matrix(batch.column("vec"))
                squared = squared_distances(vectors, centers)
                home = squared.argmin(axis=1)
                own = squared[np.arange(len(home)), home]
                gaps = np.sqrt(squared_distances(centers[home], centers))
                # Distance to the plane halfway between two centers bounds the distance to the other cell.
                # What rounding may have cost is given back, so that no cell is missed.
                doubt = 1e-12 * ((vectors * vectors).sum(1)[:, None] + norms[None, :])
                with np.errstate(divide="ignore", invalid="ignore"):
                    border = (squared - own[:, None] - doubt) / (2.0 * gaps)
                limit = batch.column("reach").to_numpy()[:, None]
                within = ~(border > limit * (1 + 1e-9) + 1e-9)
                within[np.arange(len(home)), home] = True
                if low is not None:
                    comp = batch.column("comp").to_numpy()[:, None]
                    within &= (low[None, :] != comp) | (high[None, :] != comp)
                within &= limit >= 0
                halo = pa.array([row.tobytes() for row in np.packbits(within, axis=1, bitorder="little")], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home, pa.int32()), halo], [*batch.schema.names, "home", "halo"])

    return points.select(*[c.split()[0] for c in POINT.split(", ")]).mapInArrow(task, f"{POINT}, home int, halo binary")


def _pack(key: tuple, table: pa.Table) -> pa.Table:
    vectors = matrix(table.column("vec"))
    small = vectors.astype(np.float32)
    if not (small == vectors).all():
        small = vectors  # not made of 32-bit numbers
    halo = np.frombuffer(b"".join(table.column("halo").to_pylist()), np.uint8).reshape(len(vectors), -1)
    any_ = np.bitwise_or.reduce(halo, axis=0)
    words = np.append(any_, np.zeros(-len(any_) % 8, np.uint8)).view("<i8")
    values = {"number": (key[0].as_py() << 32) | key[1].as_py(), "cell": key[0].as_py()}
    for name, kind in STATE.items():
        values[name] = np.ascontiguousarray(table.column(name).combine_chunks().fill_null(NO_ID if name == "id" else 0).to_numpy(zero_copy_only=False).astype(kind, copy=False)).tobytes()
    values |= {"vec": small.tobytes(), "halo": halo.tobytes(), "bits": words.tolist()}
    kinds = [pa.int64(), pa.int32(), *[pa.binary()] * (len(STATE) + 2), pa.list_(pa.int64())]
    return pa.table({n: pa.array([v], k) for (n, v), k in zip(values.items(), kinds)})


def packed(rows: DataFrame, block_rows: int) -> DataFrame:
    """Blocks of rows that :func:`placed` has given a home."""
    sizes = [(r["home"], -(-r["count"] // block_rows)) for r in rows.groupBy("home").count().collect()]  # one row per cell
    known = F.broadcast(rows.sparkSession.createDataFrame(sizes, "home int, blocks int"))
    dealt = rows.join(known, "home").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    blocks = dealt.groupBy("home", "block").applyInArrow(_pack, _PACKED)
    count, cores = sum(n for _, n in sizes), rows.sparkSession.sparkContext.defaultParallelism
    # Pairs of files are tasks: some four for each core, where there are blocks for it.
    return written(blocks.coalesce(max(1, count // FILE_BLOCKS, min(count, math.ceil(2 * math.sqrt(cores))))))


class Block:
    """A packed block's columns as arrays; ``halo`` only of the left one."""

    def __init__(self, batch: pa.RecordBatch, row: int, side: str):
        get = lambda name: batch.column(f"{side}_{name}")[row]
        self.number, self.cell = get("number").as_py(), get("cell").as_py()
        for name, kind in STATE.items():
            setattr(self, name, np.frombuffer(get(name).as_buffer(), kind).copy())
        n, data = len(self.id), get("vec").as_buffer()
        width = batch.column("dims")[row].as_py()
        self.vec = np.frombuffer(data, np.float32 if len(data) == 4 * n * width else np.float64).reshape(n, width).astype(np.float64)
        self.length = (self.vec * self.vec).sum(1)
        self.halo = np.frombuffer(get("halo").as_buffer(), np.uint8).reshape(n, -1).copy() if side == "a" else None
        self.small: tuple[np.ndarray, np.ndarray] | None = None
        self.ids: np.ndarray | None = None

    def sorted_ids(self) -> np.ndarray:
        if self.ids is None:
            self.ids = np.sort(self.id)
        return self.ids

    def _sides(self) -> tuple[np.ndarray, np.ndarray]:
        """The vectors with a one, and with minus half their squared length, behind them: their products are what :meth:`near` compares."""
        if self.small is None:
            kind = np.float32 if self.length.max(initial=0.0) < 1e30 else np.float64
            half = (-0.5 * self.length).astype(kind)[:, None]
            vec = self.vec.astype(kind)
            self.small = np.hstack([vec, np.ones_like(half)]), np.hstack([vec, half])
        return self.small

    def near(self, rows: np.ndarray, other: Block, reach: np.ndarray, k: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Pairs ``(place in rows, row of other)`` that hold all within ``reach``, and few others; never a row with itself.

        A pair is near if a·b - |b|²/2 is at least (|a|² - reach²)/2. The product is of single precision, what that may cost is given
        back. Where more than some ``k`` rows are within reach, only what may be among the ``k`` nearest is kept, if ``k`` is given.
        """
        score = self._sides()[0][rows] @ other._sides()[1].T
        unit = max(np.finfo(side.dtype).eps for side in (self._sides()[0], other._sides()[1]))
        most = np.sqrt(other.length.max(initial=0.0))
        doubt = (self.vec.shape[1] + 4) * unit * (np.sqrt(self.length[rows]) + most) * most + 1e-12 * (self.length[rows] + 1.0) + 1e-20
        ids = other.sorted_ids()
        same = np.flatnonzero(ids[np.minimum(np.searchsorted(ids, self.id[rows]), len(ids) - 1)] == self.id[rows])
        if len(same):
            score[same] = np.where(self.id[rows[same]][:, None] == other.id[None, :], -np.inf, score[same])
        with np.errstate(over="ignore", invalid="ignore"):
            least = (self.length[rows] - reach[rows] ** 2 * (1 + 1e-9)) / 2 - doubt
            least = np.maximum(np.nextafter(least.astype(score.dtype), -np.inf, dtype=score.dtype), np.finfo(score.dtype).min)
        within = score >= least[:, None]
        if k and k < score.shape[1] and np.count_nonzero(within) > 4 * k * len(rows):
            within &= score >= (np.partition(score, -k, axis=1)[:, -k] - 3 * doubt).astype(score.dtype)[:, None]
        return np.divmod(np.flatnonzero(within), max(1, score.shape[1]))

    def squared(self, rows: np.ndarray, other: Block) -> np.ndarray:
        return np.maximum(self.length[rows][:, None] + other.length[None, :] - 2.0 * (self.vec[rows] @ other.vec.T), 0.0)

    def exact(self, i: np.ndarray, other: Block, j: np.ndarray) -> np.ndarray:
        """Distances of row i and the other's row j, pair by pair."""
        parts = [slice(s, s + 65536) for s in range(0, len(i), 65536)]
        return np.concatenate([np.sqrt(((self.vec[i[p]] - other.vec[j[p]]) ** 2).sum(axis=1)) for p in parts]) if parts else np.zeros(0)

    def looking(self, cell: int) -> np.ndarray:
        """Rows that look into ``cell``."""
        return np.flatnonzero(self.halo[:, cell >> 3] >> (cell & 7) & 1)


def meet(blocks: DataFrame, dims: int, task: Callable, schema: str, once: bool = False) -> DataFrame:
    """Run ``task()`` in every task: its ``meet(a, b, rows)`` gets the rows of block ``a`` that look into the cell of ``b``.

    ``leave(a)``, called behind the last of a run of pairs with the same ``a``, and ``end()`` return tables or None.
    ``once`` leaves out pairs of which the mirrored one is there.
    """
    left = blocks.select(*[F.col(c).alias(f"a_{c}") for c in blocks.columns])
    right = blocks.select(*[F.col(c).alias(f"b_{c}") for c in blocks.columns if c not in ("halo", "bits", "reach")])
    looks = F.bit_get(F.get("a_bits", F.shiftright("b_cell", 6)), F.col("b_cell") % 64) == 1
    pairs = left.join(right.hint("shuffle_replicate_nl"), looks & (F.col("a_number") <= F.col("b_number")) if once else looks)
    pairs = pairs.drop("a_bits").withColumns({"b_reach": F.col("b_core"), "dims": F.lit(dims)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, a = task(), None
        for batch in batches:
            for row in range(batch.num_rows):
                if a is None or a.number != batch.column("a_number")[row].as_py():
                    if a is not None and (out := state.leave(a)) is not None:
                        yield from out.to_batches()
                    a = Block(batch, row, "a")
                b = Block(batch, row, "b")
                rows = a.looking(b.cell)
                for start in range(0, len(rows), _ROWS_PER_STEP):
                    state.meet(a, b, rows[start : start + _ROWS_PER_STEP])
        for out in (state.leave(a) if a is not None else None, state.end()):
            if out is not None:
                yield from out.to_batches()

    return pairs.mapInArrow(run, schema)


class Nearest:
    """Per looking row its ``k`` nearest other rows within reach, as ``(id, near)``; of equally near ones the smaller ids."""

    def __init__(self, k: int):
        self.k, self.of, self.found, self.new = k, None, [], 0

    def meet(self, a: Block, b: Block, rows: np.ndarray) -> None:
        if self.of != a.number:
            self.of, self.limit, self.found, self.new = a.number, a.reach.copy(), [], 0
        i, j = a.near(rows, b, self.limit, self.k)
        if not len(i):
            return
        d = a.exact(rows[i], b, j)
        kept = d <= a.reach[rows[i]]
        self.found.append((rows[i[kept]], d[kept], b.id[j[kept]], b.copies[j[kept]]))
        self.new += np.count_nonzero(kept)
        if 2 * self.new >= self.k * len(a.id):  # sorting costs more than comparing
            self._cut()

    def _cut(self) -> None:
        row, d, other, copies = (np.concatenate(c) for c in zip(*self.found))
        order = np.lexsort((other, d, row))
        row = row[order]
        heads = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
        rank = np.arange(len(row)) - np.repeat(heads, np.diff(np.append(heads, len(row))))
        kept, full = rank < self.k, rank == self.k - 1
        self.limit[row[full]] = np.minimum(self.limit[row[full]], d[order][full])
        order = order[kept]
        self.found, self.new = [(row[kept], d[order], other[order], copies[order])], 0

    def leave(self, a: Block) -> pa.Table | None:
        if self.of != a.number or not self.found:
            return None
        self._cut()
        if not len(self.found[0][0]):
            return None
        (row, d, other, copies), self.of = self.found[0], None
        heads = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        entries = pa.StructArray.from_arrays([pa.array(d), pa.array(other), pa.array(copies)], ["d", "id", "n"])
        near = pa.ListArray.from_arrays(pa.array(np.append(heads, len(row)), pa.int32()), entries)
        return pa.table({"id": pa.array(a.id[row[heads]]), "near": near})

    def end(self) -> None:
        return None


NEAREST = "id bigint, near array<struct<d:double,id:bigint,n:bigint>>"


class Forest:
    """Edges ``(a, b)`` that connect what pairs within reach connect, fewer than the rows that the task sees."""

    def __init__(self):
        self.places: dict[int, slice] = {}
        self.parent = np.zeros(0, np.int64)
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []

    def _roots(self, block: Block) -> np.ndarray:
        if block.number not in self.places:
            start = len(self.parent)
            self.places[block.number] = slice(start, start + len(block.id))
            self.parent = np.append(self.parent, np.arange(start, start + len(block.id)))
        place = self.places[block.number]
        root = self.parent[place]
        while not np.array_equal(above := self.parent[root], root):
            root = above
        self.parent[place] = root
        return root

    def _find(self, n: int) -> int:
        while self.parent[n] != n:
            n = self.parent[n]
        return int(n)

    def meet(self, a: Block, b: Block, rows: np.ndarray) -> None:
        mine, other = self._roots(a)[rows], self._roots(b)
        if len(other) and (mine == mine[0]).all() and (other == mine[0]).all():
            return  # connected already
        squared = a.squared(rows, b)
        limit = a.reach[rows] ** 2
        # The expanded square loses digits; pairs close to the limit are measured again directly.
        doubt = np.abs(squared - limit[:, None]) <= 1e-9 * (1.0 + limit + a.length[rows])[:, None]
        i, j = np.nonzero(doubt)
        squared[i, j] = np.where(a.exact(rows[i], b, j) <= a.reach[rows[i]], -np.inf, np.inf)
        close = squared <= limit[:, None]
        while True:
            open_ = close & (mine[:, None] != other[None, :])
            i = np.flatnonzero(open_.any(axis=1))
            if not len(i):
                return
            j = open_[i].argmax(axis=1)
            joined = []
            for at, (x, y) in enumerate(zip(mine[i].tolist(), other[j].tolist())):
                x, y = self._find(x), self._find(y)
                if x != y:
                    self.parent[max(x, y)] = min(x, y)
                    joined.append(at)
            self.edges.append((a.id[rows[i[joined]]], b.id[j[joined]]))
            mine, other = self._roots(a)[rows], self._roots(b)

    def leave(self, a: Block) -> None:
        return None

    def end(self) -> pa.Table | None:
        if not self.edges:
            return None
        return pa.table({n: np.concatenate(c) for n, c in zip("ab", zip(*self.edges))})
