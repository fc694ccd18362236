"""Near-duplicate documents: MinHash signatures, multi-index Hamming join, exact confirmation.

A signature has ``SLOTS`` symbols of ``BITS`` bits, the low bits of one minimum per hash function. Two documents of Jaccard
similarity J differ in each with a probability of 1 - J at most; the join finds every pair that differs in at most
``DISTANCE`` of them (at J = 0.8 a pair exceeds that with probability below 1e-6). The signature is split into chunks of
``CHUNK`` symbols. By pigeonhole a pair within the distance has a chunk with at most ``ERRORS`` errors, so every way to
leave that many symbols out gives a key, made of the chunk's other symbols. Such a pair has at least ``SHARED`` keys in
common, and still has one after each side has dropped its ``SHARED`` - 1 most frequent keys.

Documents with equal sets are one node from the start. In every bucket of a key the members are first compared
with one leader, which settles groups of copies in linear work; members of buckets that still hold several
components are then compared with each other, by bands of similar size and in blocks, inside tasks. A candidate goes
on if its signatures are within the distance and a sketch of ``BINS`` bins, each with the smallest shingle hash that falls into it, allows the similarity within
``SURE`` standard deviations, and is then confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from corpusloom.llm import common
from corpusloom.llm.words import SMALL_BYTES, Hasher, Words, mix, slices
from corpusloom.operators.components import connected_components

SLOTS, BITS, CHUNK, ERRORS, DISTANCE = 64, 16, 4, 1, 30
BLOCK = 512
BINS, SURE = 1024, 5.3
HELD_BITS = 1 << 20


def shared_keys() -> int:
    """Keys that two signatures within DISTANCE have in common at least, errors placed as badly as can be."""
    chunks = SLOTS // CHUNK

    def left(errors: int) -> int:
        return len(list(combinations(range(CHUNK - errors), CHUNK - ERRORS))) if errors <= CHUNK - 1 else 0

    best = [0] * (DISTANCE + 1)  # most keys lost with so many errors
    for _ in range(chunks):
        best = [max(best[d - e] + left(0) - left(e) for e in range(min(CHUNK, d) + 1)) for d in range(DISTANCE + 1)]
    return chunks * left(0) - best[DISTANCE]


SHARED = shared_keys()


def distinct_shingles(words: Words, hasher: Hasher, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of all rows one after another, and each row's number of them.

    A row with fewer than ``k`` words has its whole sequence as the only shingle, one without words has none.
    """
    hashes = hasher.words(words.text, words.start, words.end)
    prefix = hasher.prefix(hashes)
    out, sizes = [], np.zeros(words.rows, np.int64)
    at = np.arange(max(0, len(hashes) - k + 1))
    grams = hasher.sequences(prefix, at, at + k)
    for i in range(words.rows):
        a, b = words.bounds[i], words.bounds[i + 1]
        if b - a >= k:
            found = np.unique(grams[a : b - k + 1])
        elif b > a:
            found = hasher.sequences(prefix, np.array([a]), np.array([b]))
        else:
            continue
        out.append(found)
        sizes[i] = len(found)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), sizes


def minima(shingles: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One row of SLOTS symbols per non-empty set: the low bits of its minimum hashes."""
    heads = (np.cumsum(sizes) - sizes)[sizes > 0]
    factor = mix(np.arange(1, SLOTS + 1, dtype=np.uint64) * np.uint64(77)) | np.uint64(1)
    out = np.empty((len(heads), SLOTS), np.uint64)
    for i in range(SLOTS):
        h = shingles * factor[i]
        h ^= h >> np.uint64(29)
        h *= factor[i]
        out[:, i] = np.minimum.reduceat(h, heads) if len(heads) else 0
    return mix(out) & np.uint64((1 << BITS) - 1)


def bins(shingles: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One row of BINS bytes per set: of each bin's smallest shingle a byte that is not 0; 0 for an empty bin."""
    out = np.zeros((len(sizes), BINS), np.uint8)
    row = np.repeat(np.arange(len(sizes)), sizes)
    bin_ = (shingles // np.uint64((1 << 64) // BINS)).astype(np.int64)  # shingles are sorted, so bins are, too
    heads = common.heads_of(row, bin_)
    out[row[heads], bin_[heads]] = mix(shingles[heads]) % np.uint64(255) + np.uint64(1)
    return out


def keys_of(symbols: np.ndarray) -> np.ndarray:
    """All keys of each signature."""
    out = []
    for chunk in range(SLOTS // CHUNK):
        for number, kept in enumerate(combinations(range(CHUNK), CHUNK - ERRORS)):
            h = np.full(len(symbols), chunk * 1000 + number, np.uint64)
            for slot in kept:
                h = mix(h * np.uint64(31) + symbols[:, chunk * CHUNK + slot])
            out.append(h)
    return np.stack(out, 1)


def within_distance(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Whether signatures differ in at most DISTANCE symbols."""
    return np.count_nonzero(one != others, axis=1) <= DISTANCE


_SKETCH = "doc long, size long, set_a long, set_b long, keys array<long>, signature binary, sketch binary"


def _sketch(k: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(lower=True)
        for batch in batches:
            for piece in slices(batch, "text", SMALL_BYTES):
                words = Words(piece.column("text"))
                shingles, sizes = distinct_shingles(words, hasher, k)
                sums = np.append(np.uint64(0), np.cumsum(shingles, dtype=np.uint64))
                other = np.append(np.uint64(0), np.cumsum(mix(shingles), dtype=np.uint64))
                ends = np.cumsum(sizes)
                symbols = minima(shingles, sizes)
                keys = keys_of(symbols)
                full = np.zeros((words.rows, keys.shape[1]), np.uint64)
                full[sizes > 0] = keys
                signature = np.zeros((words.rows, SLOTS), np.uint16)
                signature[sizes > 0] = symbols
                signs = bins(shingles, sizes)
                yield pa.RecordBatch.from_pydict({
                    "doc": piece.column("doc"),
                    "size": pa.array(sizes),
                    "set_a": pa.array((sums[ends] - sums[ends - sizes]).view(np.int64)),
                    "set_b": pa.array((other[ends] - other[ends - sizes]).view(np.int64)),
                    "keys": common.lists(full.reshape(-1), np.arange(words.rows) * keys.shape[1]),
                    "signature": _binary(signature),
                    "sketch": _binary(signs),
                })

    return task


def _binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * (rows.shape[1] * rows.itemsize)
    return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])


def _matrix(column, width: int = BINS, kind=np.uint8) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _allows(one: np.ndarray, others: np.ndarray, size: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Whether sketches leave the similarity possible; the more of the sets they hold, the less they err."""
    either = np.count_nonzero(one | others, axis=1)
    both = np.count_nonzero((one == others) & (one > 0), axis=1)
    share = percent / 100
    union = np.maximum((size + sizes) / (1 + share), either)
    spread = SURE * np.sqrt(share * (1 - share) * either * (1 - either / np.maximum(union, 1)) + 0.1)
    return both + spread >= share * either


def _near(percent: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = within_distance(*(_matrix(batch.column(f"sign_{s}"), SLOTS, np.uint16) for s in "ab"))
            batch = batch.filter(pa.array(near))
            a, b = (_matrix(batch.column(f"sketch_{s}")) for s in "ab")
            n, m = (batch.column(f"size_{s}").to_numpy() for s in "ab")
            yield batch.select(["a", "b"]).filter(pa.array(_allows(a, b, n, m, percent)))

    return task


def _confirm(k: int, percent: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(lower=True)
        for batch in batches:
            for half in slices(batch, "text_a", SMALL_BYTES):
                for piece in slices(half, "text_b", SMALL_BYTES):
                    sides = []
                    for side in ("text_a", "text_b"):
                        found, sizes = distinct_shingles(Words(piece.column(side)), hasher, k)
                        sides.append((found, np.append(0, np.cumsum(sizes))))
                    (xs, x), (ys, y) = sides
                    linked = []
                    for i in range(piece.num_rows):
                        n, m = x[i + 1] - x[i], y[i + 1] - y[i]
                        both = len(np.intersect1d(xs[x[i] : x[i + 1]], ys[y[i] : y[i + 1]], assume_unique=True))
                        linked.append(bool(both and 100 * both >= percent * (n + m - both)))
                    yield piece.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return task


def _within(percent: int):
    """Pairs of one block pair that lie in different components and whose sizes, signatures and sketches allow a link.

    A pair that meets in several cells is given out in the first band and key that both have.
    """

    def compare(table: pa.Table) -> pa.Table:
        column = lambda c: table.column(c).to_numpy()
        key, band, low, high, block = (column(c) for c in ("key", "band", "low", "high", "block"))
        order = np.lexsort((block, high, low, band, key))
        key, band, low, high, block = (c[order] for c in (key, band, low, high, block))
        doc, size, component, base = (column(c)[order] for c in ("doc", "size", "component", "base"))
        chosen = pa.array(order)
        taken = lambda c: table.column(c).combine_chunks().take(chosen)
        signatures, signs = _matrix(taken("signature"), SLOTS, np.uint16), _matrix(taken("sketch"))
        kept = table.column("kept").combine_chunks().take(chosen)
        bounds = np.append(0, np.cumsum(kept.value_lengths().to_numpy()))
        own = common.flat(kept)
        heads = np.append(common.heads_of(key, band, low, high), len(key))
        pairs = []
        for a, b in zip(heads[:-1], heads[1:]):
            same = low[a] == high[a]
            first = b if same else a + int(np.searchsorted(block[a:b], low[a], "right"))
            for i in range(a, first):
                others = np.arange(i + 1 if same else first, b)
                small, large = np.minimum(size[i], size[others]), np.maximum(size[i], size[others])
                open_ = (component[i] != component[others]) & (doc[i] != doc[others]) & (100 * small >= percent * large)
                others = others[open_ & (np.maximum(base[i], base[others]) == band[a])]
                others = others[within_distance(signatures[i], signatures[others])] if len(others) else others
                others = others[_allows(signs[i], signs[others], size[i], size[others], percent)] if len(others) else others
                for j in others:
                    meet = np.intersect1d(own[bounds[i] : bounds[i + 1]], own[bounds[j] : bounds[j + 1]])
                    if len(meet) and meet[0] == key[a]:
                        pairs.append((doc[i], doc[j]) if doc[i] < doc[j] else (doc[j], doc[i]))
        return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})

    return compare


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80
) -> DataFrame:
    """Each row of ``docs`` with ``n_shingles``, ``component_id`` and ``kept``.

    Linked are documents whose sets of distinct ``shingle``-word shingles (A-Z lower-cased) have a Jaccard
    similarity of at least ``percent`` %. ``component_id`` is the smallest id reachable by links; ``kept`` is true
    for that document.

    A text without words (null and empty ones) has no shingles and is linked with nothing. A row without an id
    is linked with nothing, has no shingles, a null ``component_id`` and is kept. Rows that share an id are one node. A column
    of ``docs`` that is named like a result is replaced. An empty table gives an empty one.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    known = texts.where("doc IS NOT NULL")
    sketches = common.stored(known.mapInArrow(_sketch(shingle), _SKETCH))
    classes = sketches.where("size > 0").groupBy("set_a", "set_b", "size").agg(F.min("doc").alias("rep"))
    nodes = sketches.join(classes.select(F.col("rep").alias("doc")).distinct(), "doc", "left_semi")
    narrow = nodes.select("doc", "size", "signature", "sketch").dropDuplicates(["doc"])

    keys = nodes.where("size > 0").select("doc", "size", F.explode("keys").alias("key"))
    buckets = keys.groupBy("key").agg(
        F.count("*").alias("docs"), F.min(F.struct("doc", "size")).alias("leader")
    ).where("docs > 1")
    by_frequency = W.partitionBy("doc").orderBy(F.desc("docs"), "key")
    members = common.stored(
        keys.join(buckets, "key").withColumn("place", F.row_number().over(by_frequency)).where(F.col("place") >= SHARED)
        .select("key", "doc", "size", "docs", F.col("leader.doc").alias("leader"), F.col("leader.size").alias("leader_size"))
    )

    def confirmed(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct()
        held = common.bitmap(ends, HELD_BITS)  # of a fixed size
        # The bitmap keeps most texts out of the shuffle, the join is exact.
        needed = known.where(common.is_in(held, F.col("doc"))).join(ends, "doc", "left_semi").dropDuplicates(["doc"])
        a, b = (needed.select(F.col("doc").alias(s), F.col("text").alias(f"text_{s}")) for s in "ab")
        return common.stored(pairs.join(a, "a").join(b, "b").mapInArrow(_confirm(shingle, percent), "a long, b long"))

    close = F.least("size", "leader_size") * 100 >= F.greatest("size", "leader_size") * percent
    led = members.where((F.col("doc") != F.col("leader")) & close).select(F.col("doc").alias("a"), F.col("leader").alias("b")).distinct()
    signs = {s: narrow.select(F.col("doc").alias(s), F.col("signature").alias(f"sign_{s}"), F.col("sketch").alias(f"sketch_{s}"), F.col("size").alias(f"size_{s}")) for s in "ab"}
    near = common.stored(led.join(signs["a"], "a").join(signs["b"], "b").mapInArrow(_near(percent), "a long, b long"))
    links = confirmed(near)
    found = connected_components(links)

    placed = members.where("docs > 2").join(found.withColumnRenamed("node", "doc"), "doc", "left").select(
        "key", "doc", "size", F.coalesce("component", "doc").alias("component")
    )
    # Linked sets differ in size by percent at most, so they are in one band of sizes or in neighbouring ones.
    band = F.floor(F.log(F.col("size").cast("double")) / float(np.log(100 / percent) * 1.001)).cast("int") if percent < 100 else F.hash("size")
    placed = placed.withColumn("base", band).withColumn("band", F.explode(F.array("base", F.col("base") + 1)))
    kept_keys = members.where("docs > 2").groupBy("doc").agg(F.collect_set("key").alias("kept"))
    open_cells = placed.groupBy("key", "band").agg(
        F.count("*").alias("members"), F.min("component").alias("least"), F.max("component").alias("most")
    ).where("least < most").select("key", "band", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"))
    cells = (
        placed.join(open_cells, ["key", "band"]).join(narrow.select("doc", "signature", "sketch").join(kept_keys, "doc"), "doc")
        .withColumn("block", F.pmod(F.hash("doc"), F.col("blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", "band", "base", "doc", "size", "component", "signature", "sketch", "kept", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    )
    spread = cells.withColumn("bucket", F.pmod(F.hash("key", "band", "low", "high"), F.lit(4 * common.parts(docs))))
    rest = common.stored(spread.groupBy("bucket").applyInArrow(_within(percent), "a long, b long").distinct())
    links = links.unionByName(confirmed(rest))
    components = connected_components(links).withColumnRenamed("node", "rep")

    of_class = classes.join(components, "rep", "left").select(
        "set_a", "set_b", "size", F.coalesce("component", "rep").alias("component")
    )
    by_doc = (
        sketches.select("doc", "size", "set_a", "set_b").join(of_class, ["set_a", "set_b", "size"], "left")
        .groupBy("doc").agg(F.max("size").alias("size"), F.min(F.coalesce("component", "doc")).alias("component"))
    )
    names = ["n_shingles", "component_id", "kept"]
    plain = docs.drop(*[c for c in docs.columns if c in names])
    joined = plain.withColumn("__doc", F.col(id_col).cast("long")).join(by_doc.withColumnsRenamed({"doc": "__doc", "size": "__size", "component": "__component"}), "__doc", "left")
    own = [F.col(f"`{c}`") for c in plain.columns]
    return joined.select(
        *own, F.coalesce("__size", F.lit(0)).alias("n_shingles"), F.col("__component").alias("component_id"),
        F.coalesce(F.col("__component") == F.col("__doc"), F.lit(True)).alias("kept"),
    )
