"""Prefix trie of conversations by the Euler-tour technique.

A node is a distinct sequence of first turns. Sequences are known by 128 bits: the exclusive or of hashes of (place,
role, text), which is a running total and so needs no task to see a whole conversation. Grouping by it gives the nodes
with their members' number and smallest id; (smallest id, depth) names a node from then on.

The Euler tour enters and leaves each node once: from entering a node it goes to its first child or leaves it, from
leaving it goes to the next sibling or leaves the parent. These arcs are a linked list. It is ranked in two steps:
every task follows the arcs among its own nodes (pointer doubling in numpy), which leaves one arc for each stretch
that enters the task; these are ranked by pointer jumping over the cluster, each round a join of unique keys. With the arcs'
positions known, prefix sums over the tour give each subtree's totals: what was added between entering and leaving.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.llm import common
from corpusloom.llm.mixing import count_words

FAN = 1024
CHUNK_IDS = 4096
TASK_NODES = 1 << 18
KEY = ["depth", "x", "y"]  # of a node: its depth and the 128 bits of its sequence


def numbered(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``at``, the place from 0 among rows of equal ``keys`` (longs) in the given order; stored.

    Rows are sorted over the cluster, so a key's rows may fill many tasks. Tasks number what they have, and what
    earlier tasks have of their first key is added.
    """
    columns = rows.columns

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count = None, 0
        part = TaskContext.get().partitionId()
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            values = [batch.column(k).to_numpy() for k in keys]
            heads = common.heads_of(*values)
            local = np.arange(n) - heads[common.run_of(heads, n)]
            if last == tuple(v[0] for v in values):
                local[: heads[1] if len(heads) > 1 else n] += count
            last, count = tuple(v[-1] for v in values), int(local[-1]) + 1
            arrays = [*batch.columns, pa.array(local), pa.array(np.full(n, part, np.int64))]
            yield pa.RecordBatch.from_arrays(arrays, [*columns, "at", "task"])

    by = [F.col(k) for k in keys] + [F.col(o) for o in order]
    spread = rows.repartitionByRange(common.parts(rows), *by).sortWithinPartitions(*by)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    local = common.stored(spread.mapInArrow(task, f"{fields}, at long, task long"))
    earlier = Window.partitionBy(*keys).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    of_task = local.groupBy(*keys, "task").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(earlier))
    # Only the first key of a task can stand in earlier ones: one row per task at most.
    before = F.broadcast(of_task.where("before > 0").select(*keys, "task", "before"))
    whole = local.join(before, [*keys, "task"], "left")
    return whole.select(*columns, (F.col("at") + F.coalesce("before", F.lit(0))).alias("at"))


def running(rows: DataFrame, keys: list[str], values: list[str], last: int, xor: bool = False) -> DataFrame:
    """``rows`` with each of ``values`` replaced by its total over equal ``keys`` up to the row's ``at`` (0 to ``last``).

    Totals run within blocks of ``FAN`` places, over the blocks' totals likewise, and so on. ``rows`` are read twice
    if there is more than one block.
    """
    total = F.bit_xor if xor else F.sum
    block = F.expr(f"at DIV {FAN}")
    window = Window.partitionBy(*keys, "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.withColumn("block", block).withColumns({v: total(v).over(window) for v in values})
    if last < FAN:
        return inside.drop("block")
    blocks = rows.groupBy(*keys, block.alias("at")).agg(*[total(v).alias(v) for v in values])
    before = running(blocks, keys, values, last // FAN, xor)
    shifted = before.select(*keys, (F.col("at") + 1).alias("block"), *[F.col(v).alias(f"_{v}") for v in values])
    held = {v: F.coalesce(f"_{v}", F.lit(0)) for v in values}
    whole = inside.join(shifted, [*keys, "block"], "left")
    return whole.withColumns({v: F.col(v).bitwiseXOR(held[v]) if xor else F.col(v) + held[v] for v in values}).select(*rows.columns)


def numbered_turns(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """``(conv, at, a, b, words)``: a row for each turn of a conversation that has an id, with its place and two hashes."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    role, text = empty(role_col), empty(text_col)
    narrow = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"),
        F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(1), text, role).alias("b"), count_words(text).cast("long").alias("words"),
    )
    return numbered(narrow, ["conv"], ["turn", "a", "b"]).drop("turn")


def first_turns_shared(rows: DataFrame, sharing: int = 20, most: int = 4) -> DataFrame:
    """Conversations as :func:`numbered_turns` gives them, rebuilt on the first turns of one in ``sharing``.

    Conversation c gets the first h turns of c - c % ``sharing``, as many as it has, and then its own but its first h, where
    h is crc32 of the decimal c modulo ``most``.
    """
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % most).alias("h")
    convs = rows.groupBy("conv").agg(F.count("*").alias("n")).withColumn("h", h).withColumn("source", F.col("conv") - F.col("conv") % sharing)
    convs = common.stored(convs)
    sizes = convs.select(F.col("conv").alias("source"), F.col("n").alias("given"))
    taken = convs.join(sizes, "source", "left").withColumn("given", F.least("h", F.coalesce("given", F.lit(0))))
    heads = rows.where(F.col("at") < most - 1).withColumnRenamed("conv", "source")  # at most `most` rows of a conversation
    shared = heads.join(taken.where("h > 0").select("conv", "source", "h"), "source").where("at < h").select("conv", "at", "a", "b", "words")
    short = taken.where("given < h").select("conv", (F.col("h") - F.col("given")).alias("lacks"))
    own = rows.where(F.col("at") >= h).join(short, "conv", "left").withColumn("at", F.col("at") - F.coalesce("lacks", F.lit(0)))
    return shared.unionByName(own.select("conv", "at", "a", "b", "words"))


def _id_lists():
    """Sorted members to stretches of a node's ids, joined by commas."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = [batch.column(k).to_numpy() for k in KEY]
            ids = batch.column("conv").to_numpy()
            if not len(ids):
                continue
            heads = common.heads_of(*key)
            cuts = np.concatenate([np.arange(a, b, CHUNK_IDS) for a, b in zip(heads, np.append(heads[1:], len(ids)))])
            texts = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(cuts, np.append(cuts[1:], len(ids)))]
            arrays = [pa.array(k[cuts]) for k in key] + [pa.array(ids[cuts]), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, [*KEY, "first", "ids"])

    return task


def _list_digests():
    """Sorted stretches of ids to one SHA-256 per node."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, out = None, None, []

        def flush():
            columns = list(zip(*out))
            arrays = [pa.array(c, pa.int64()) for c in columns[:3]] + [pa.array(columns[3], pa.string())]
            return pa.RecordBatch.from_arrays(arrays, [*KEY, "ends_sha256"])

        for batch in batches:
            for *key, ids in zip(*(batch.column(c).to_pylist() for c in [*KEY, "ids"])):
                if key != now:
                    if now is not None:
                        out.append((*now, sha.hexdigest()))
                    now, sha = key, hashlib.sha256(ids.encode())
                else:
                    sha.update(f",{ids}".encode())
            if len(out) > CHUNK_IDS:
                yield flush()
                out = []
        if now is not None:
            out.append((*now, sha.hexdigest()))
            yield flush()

    return task


def _end_digests(ends: DataFrame) -> DataFrame:
    """``(depth, x, y, ends_sha256)`` of ``ends (depth, x, y, conv)``; a node's ids are joined in stretches before they meet."""
    parts = common.parts(ends)
    key = "depth long, x long, y long"
    spread = ends.select(*KEY, "conv").repartitionByRange(parts, *KEY, "conv").sortWithinPartitions(*KEY, "conv")
    lists = spread.mapInArrow(_id_lists(), f"{key}, first long, ids string")
    met = lists.repartition(parts, *KEY).sortWithinPartitions(*KEY, "first")
    return met.drop("first").mapInArrow(_list_digests(), f"{key}, ends_sha256 string")


def _own_stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of a task, sorted by (conv, depth), to their arcs, each with the head of its stretch and the way from there."""
    batches = list(batches)  # about TASK_NODES nodes, some numbers each
    if not sum(b.num_rows for b in batches):
        return
    table = pa.Table.from_batches(batches)
    node = {c: table.column(c).combine_chunks() for c in table.column_names}
    get = lambda c: node[c].fill_null(0).to_numpy()
    there = lambda c: node[c].is_valid().to_numpy(zero_copy_only=False)
    conv, depth, n = get("conv"), get("depth"), table.num_rows
    child, sibling = there("first_child"), there("sibling")
    # Arc 2i enters node i, 2i + 1 leaves it; where it goes: a node and whether it is left there.
    to_conv, to_step = np.empty(2 * n, np.int64), np.empty(2 * n, np.int64)
    to_conv[::2] = np.where(child, get("first_child"), conv)
    to_step[::2] = np.where(child, 2 * (depth + 1), 2 * depth + 1)
    to_conv[1::2] = np.where(sibling, get("sibling"), get("parent"))
    to_step[1::2] = np.where(sibling, 2 * depth, 2 * (depth - 1) + 1)
    last = np.zeros(2 * n, bool)
    last[1::2] = depth == 0
    # The depths of one smallest member follow each other.
    heads = common.heads_of(conv)
    counts = np.diff(np.append(heads, n))
    at = np.minimum(np.searchsorted(conv[heads], to_conv), len(heads) - 1)
    step = (to_step >> 1) - depth[heads[at]]
    local = (conv[heads[at]] == to_conv) & (step >= 0) & (step < counts[at]) & ~last
    following = np.where(local, 2 * (heads[at] + step) + (to_step & 1), -1)
    end, way = np.where(local, following, np.arange(2 * n)), local.astype(np.int64)
    while (following[end] >= 0).any():
        way = way + way[end]
        end = end[end]
    longest = np.zeros(2 * n, np.int64)
    np.maximum.at(longest, end, way)
    begins = np.ones(2 * n, bool)
    begins[following[local]] = False
    head_of = np.zeros(2 * n, np.int64)
    head_of[end[begins]] = np.flatnonzero(begins)
    head = head_of[end]
    arc_conv, arc_step = np.repeat(conv, 2), np.repeat(2 * depth, 2) + np.tile([0, 1], n)
    leaf, saved = np.zeros(2 * n, np.int64), np.zeros(2 * n, np.int64)
    leaf[::2], saved[::2] = ~child, get("saving")
    out_of = np.where(begins, end, 0)
    columns = {
        "conv": arc_conv, "step": arc_step, "head_conv": arc_conv[head], "head_step": arc_step[head], "way": longest[end] - way,
        "length": longest[end] + 1, "leaf": leaf, "saved": saved,
    }
    arrays = {c: pa.array(v) for c, v in columns.items()}
    gone = ~begins | last[out_of]
    arrays["next_conv"], arrays["next_step"] = pa.array(to_conv[out_of], mask=gone), pa.array(to_step[out_of], mask=gone)
    yield from pa.table(arrays).to_batches(max_chunksize=1 << 16)


_ARCS = "conv long, step long, head_conv long, head_step long, way long, length long, leaf long, saved long, next_conv long, next_step long"


def ranked(heads: DataFrame) -> DataFrame:
    """``(head_conv, head_step, ahead)``: from each stretch's head on, arcs up to the end of the tour, by pointer jumping.

    Every round doubles the way that a pointer spans. Pointers to one stretch are unique, so no key is hot.
    """
    state = common.stored(heads.select("head_conv", "head_step", F.col("length").alias("ahead"), "next_conv", "next_step"))
    while not state.where("next_conv IS NOT NULL").isEmpty():
        going = state.where("next_conv IS NOT NULL")
        goal = state.select(
            F.col("head_conv").alias("next_conv"), F.col("head_step").alias("next_step"), F.col("ahead").alias("more"),
            F.col("next_conv").alias("then_conv"), F.col("next_step").alias("then_step"),
        )
        jumped = going.join(goal, ["next_conv", "next_step"]).select(
            "head_conv", "head_step", (F.col("ahead") + F.col("more")).alias("ahead"), F.col("then_conv").alias("next_conv"), F.col("then_step").alias("next_step")
        )
        state = common.stored(state.where("next_conv IS NULL").unionByName(jumped))
    return state.select("head_conv", "head_step", "ahead")


def subtree_totals(tree: DataFrame) -> DataFrame:
    """``(conv, depth, n_leaves, saved_tokens)`` of ``tree (conv, depth, parent, first_child, sibling, saving)``."""
    names = ["conv", "depth", "parent", "first_child", "sibling", "saving"]
    parts = max(common.parts(tree), tree.count() // TASK_NODES)
    spread = tree.select(*names).repartitionByRange(parts, "conv", "depth").sortWithinPartitions("conv", "depth")
    arcs = common.stored(spread.mapInArrow(_own_stretches, _ARCS))
    ranks = ranked(arcs.where("way = 0"))
    total = arcs.count()
    places = arcs.join(ranks, ["head_conv", "head_step"]).select(
        "conv", "step", "leaf", "saved", (F.lit(total) - F.col("ahead") + F.col("way")).alias("at")
    )
    own = common.stored(places.withColumns({"leaf_sum": F.col("leaf"), "saved_sum": F.col("saved")}))
    sums = running(own, [], ["leaf_sum", "saved_sum"], max(0, total - 1))
    sign = F.when(F.col("step") % 2 == 1, 1).otherwise(-1)
    return sums.groupBy("conv", F.expr("step DIV 2").alias("depth")).agg(
        (F.sum(F.col("leaf_sum") * sign) + F.sum("leaf")).alias("n_leaves"), (F.sum(F.col("saved_sum") * sign) + F.sum("saved")).alias("saved_tokens")
    )


def prefix_trie(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """The trie's nodes: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``rows (conv, at, a, b, words)`` are turns as :func:`numbered_turns` gives them, ``convs (conv)`` all members, also those
    without turns. A node's ``conv_id`` is its smallest member, ``n_convs`` counts members, ``n_leaves`` childless
    nodes of its subtree (itself included), ``saved_tokens`` sums (n_convs - 1) * words of the last turn over its
    subtree, ``ends_sha256`` is of the ids that end here, ascending, joined by commas. Without members there is no node.
    """
    placed = common.stored(rows.withColumns({"zx": F.xxhash64("at", "a", "b"), "zy": F.xxhash64("b", "at", "a")}).withColumns({"x": F.col("zx"), "y": F.col("zy")}))
    last = placed.agg(F.max("at")).first()[0] or 0
    paths = common.stored(running(placed, ["conv"], ["x", "y"], last, xor=True).select(
        "conv", (F.col("at") + 1).alias("depth"), "x", "y", F.col("x").bitwiseXOR(F.col("zx")).alias("px"), F.col("y").bitwiseXOR(F.col("zy")).alias("py"), "words"
    ))
    everyone = convs.agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs"))
    smallest, members = everyone.first()
    nodes = common.stored(paths.groupBy(*KEY).agg(
        F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.min("px").alias("px"), F.min("py").alias("py"), F.min("words").alias("words")
    ))
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv").alias("parent"))
    first = nodes.where("depth = 1").withColumn("parent", F.lit(smallest).cast("long"))
    deeper = nodes.where("depth > 1").join(above, ["depth", "px", "py"])
    inner = first.unionByName(deeper).select("conv", *KEY, "parent", "n_convs", (F.expr("(n_convs - 1) * words")).alias("saving"))
    children = common.stored(numbered(inner, ["depth", "parent"], ["conv"]))
    root = convs.sparkSession.createDataFrame([(smallest, 0, 0, 0, None, members, 0)] if members else [], "conv long, depth long, x long, y long, parent long, n_convs long, saving long")
    following = children.select("depth", "parent", (F.col("at") - 1).alias("at"), F.col("conv").alias("sibling"))
    kids = children.groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("conv")).agg(F.count("*").alias("n_children"), F.min("conv").alias("first_child"))
    with_sibling = children.join(following, ["depth", "parent", "at"], "left").drop("at")
    ends = paths.groupBy("conv").agg(F.max(F.struct(*KEY)).alias("end")).select("conv", "end.*")
    turnless = convs.join(paths.select("conv").distinct(), "conv", "left_anti").select("conv", *[F.lit(0).cast("long").alias(k) for k in KEY])
    digests = _end_digests(ends.unionByName(turnless))
    tree = common.stored(
        with_sibling.unionByName(root, allowMissingColumns=True).join(kids, ["conv", "depth"], "left").join(digests, KEY, "left")
    )
    totals = subtree_totals(tree)
    return tree.join(totals, ["conv", "depth"]).select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def conversation_trie(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", share_first: bool = False
) -> DataFrame:
    """:func:`prefix_trie` of all conversations, with ``share_first`` rebuilt by :func:`first_turns_shared`.

    Turns are in order of ``turn`` (null first), ties by their hashes. Null roles and texts are empty. Rows without a
    conversation id belong to none and are left out. Repeated rows are repeated turns. Other columns are not read. An
    empty table gives an empty one.
    """
    rows = common.stored(numbered_turns(turns, conv_col, turn_col, role_col, text_col))
    convs = rows.select("conv").distinct()
    return prefix_trie(first_turns_shared(rows) if share_first else rows, convs)
