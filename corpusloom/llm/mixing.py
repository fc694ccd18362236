"""Mixing sources to target weights by a low-discrepancy schedule over shuffled blocks of equally many words.

Every source's documents are laid end to end in a shuffled order and cut into blocks of ``block_words``. Slot i of
the mix takes the golden-ratio point frac(i * 0.618...), finds the source whose stretch of the cumulative shares
holds it, and takes that source's next block; after its last block a source starts over. A source stops at its
quota (its target in whole words), and the few slots that the points leave short are appended at the end.
Only DataFrame functions are used. Offsets and ranks are counted per chunk first, so no source is in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from corpusloom.llm import common

WORD = r"[^\x20\x09-\x0D]+"
GOLDEN = "0.61803398874989484820"
CHUNK_DOCS = 4096
CHUNK_SLOTS = 65536
MAX_REPEATS = 3


def count_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sized: DataFrame, source_col: str, size_col: str, weights: DataFrame | None, repeats: int) -> DataFrame:
    """One row per source: number, source, source_size, docs, weight, target (words as a double).

    Targets share the sum of all sizes by weight, none above ``repeats`` times its source's size; what is cut off
    is shared among the others by weight. With sources ordered by limit per weight, those at their limit come
    first, so one running sum finds the share of the rest. The windows hold one row per source.
    """
    sources = sized.groupBy(F.col(source_col).alias("source")).agg(
        F.sum(size_col).alias("source_size"), F.count("*").alias("docs")
    )
    sources = sources.withColumn("number", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    if weights is None:
        sources = sources.withColumn("weight", (F.col("number") % 3 + 1).cast("double"))
    else:
        given = weights.select(F.col("source").alias("__source"), F.col("weight").cast("double").alias("weight"))
        sources = sources.join(given, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")
        sources = sources.withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    limit = F.col("source_size") * float(repeats)
    by_limit = W.orderBy("ratio", "number")
    ordered = sources.withColumn("ratio", F.when(F.col("weight") > 0, limit / F.col("weight")).otherwise(F.lit(float("inf"))))
    level = (F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum(limit).over(by_limit.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))) / F.nullif(
        F.sum("weight").over(by_limit.rowsBetween(0, W.unboundedFollowing)), F.lit(0.0)
    )
    leveled = ordered.withColumn("level", level).withColumn("below", (F.col("weight") > 0) & (F.col("ratio") > F.col("level")))
    rest = F.min_by("level", F.when(F.col("below"), F.struct("ratio", "number"))).over(W.partitionBy())
    target = F.when(F.col("weight") <= 0, F.lit(0.0)).otherwise(F.least(limit, F.coalesce(F.col("weight") * rest, limit)))
    return leveled.withColumn("target", target).select("number", "source", "source_size", "docs", "weight", "target")


def with_slots(sources: DataFrame, repeats: int, block_words: int) -> DataFrame:
    """Adds quota, blocks, rest (words of the last epoch) and slots of every source, and its stretch of shares."""
    size = F.col("source_size")
    quota = F.least(F.floor(F.col("target") + 1e-6).cast("long"), size * repeats)
    out = sources.withColumn("quota", quota).withColumn("blocks", F.ceil(size / F.lit(block_words)).cast("long"))
    out = out.withColumn("epochs", F.coalesce(F.expr("quota div nullif(source_size, 0)"), F.lit(0)).cast("long"))
    out = out.withColumn("rest", F.col("quota") - F.col("epochs") * size)
    out = out.withColumn("slots", F.col("epochs") * F.col("blocks") + F.ceil(F.col("rest") / F.lit(block_words)).cast("long"))
    upto = F.sum("slots").over(W.orderBy("number").rowsBetween(W.unboundedPreceding, 0))
    return out.withColumn("upto", upto).withColumn("all_slots", F.sum("slots").over(W.partitionBy()))


def schedule(sources: DataFrame, block_words: int) -> DataFrame:
    """``(slot, number, block, epoch, take)``: which block each slot of the mix takes, and how many of its words.

    ``sources`` is a stored table; one row of it, its totals, is read here to know the number of slots.
    """
    spark = sources.sparkSession
    total, count = sources.agg(F.coalesce(F.max("all_slots"), F.lit(0)), F.count("*")).first()
    grid = 4 * count + 1
    points = spark.range(total).withColumn(
        "at", F.expr(f"(CAST(id AS DECIMAL(15, 0)) * CAST('{GOLDEN}' AS DECIMAL(20, 20))) % 1")
    ).select(F.col("id").alias("slot"), (F.col("at").cast("double") * total).alias("at"))
    points = points.withColumn("cell", F.floor(F.col("at") * (grid / max(total, 1))).cast("long"))
    low = F.col("upto") - F.col("slots")
    stretches = sources.where("slots > 0").select(
        "number", low.cast("double").alias("low"), F.col("upto").cast("double").alias("high"),
        F.explode(F.sequence(F.floor(low * (grid / max(total, 1))).cast("long"), F.floor(F.col("upto") * (grid / max(total, 1))).cast("long"))).alias("cell"),
    )
    hits = points.join(stretches, "cell").where("at >= low AND at < high").select("slot", "number", F.expr(f"slot div {CHUNK_SLOTS}").alias("chunk"))
    counts = hits.groupBy("number", "chunk").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("number").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = hits.join(counts.select("number", "chunk", before.alias("before")), ["number", "chunk"]).select(
        "slot", "number", (F.col("before") + F.row_number().over(W.partitionBy("number", "chunk").orderBy("slot")) - 1).alias("rank")
    )
    drawn = counts.groupBy(F.col("number").alias("__number")).agg(F.sum("n").alias("n"))
    late = (
        sources.join(drawn, F.col("number") == F.col("__number"), "left").withColumn("n", F.coalesce("n", F.lit(0)))
        .where("n < slots").withColumn("rank", F.explode(F.sequence(F.col("n"), F.col("slots") - 1)))
        .select((F.lit(total) + (F.col("rank") - F.col("n")) * F.lit(count) + F.col("number")).alias("slot"), "number", "rank")
    )
    facts = sources.select("number", "slots", "blocks", "rest", "source_size")
    block = F.expr("rank % blocks")
    last = F.col("rest") - (F.ceil(F.col("rest") / F.lit(block_words)) - 1) * block_words
    take = F.when((F.col("rank") == F.col("slots") - 1) & (F.col("rest") > 0), last).otherwise(
        F.least(F.lit(block_words), F.col("source_size") - F.col("block") * block_words)
    )
    return (
        ranked.unionByName(late).join(facts, "number").where("rank < slots")
        .withColumn("block", block).select("slot", "number", "block", F.expr("rank div blocks").alias("epoch"), take.cast("long").alias("take"))
    )


def laid_out(sized: DataFrame, sources: DataFrame, id_col: str, source_col: str, size_col: str, seed: str) -> DataFrame:
    """Every row with its source's facts and ``start``, its first word's place in the shuffled source."""
    facts = sources.select(
        F.col("source").alias("__source"), F.col("number").alias("__number"), F.col("source_size").alias("__source_size"),
        F.col("target").alias("__target"), F.greatest(F.lit(1), F.ceil(F.col("docs") / CHUNK_DOCS)).alias("__chunks"),
    )
    key = F.md5(F.concat(F.lit(seed), F.lit(":"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    rows = sized.join(facts, F.col(source_col).eqNullSafe(F.col("__source"))).withColumn("__key", key)
    share = F.conv(F.substring("__key", 1, 8), 16, 10).cast("double") / float(1 << 32)
    rows = rows.withColumn("__chunk", F.floor(share * F.col("__chunks")))
    sums = rows.groupBy("__number", "__chunk").agg(F.sum(size_col).alias("__words"))
    before = F.sum("__words").over(W.partitionBy("__number").orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1))
    offsets = sums.select("__number", "__chunk", F.coalesce(before, F.lit(0)).alias("__before"))
    order = W.partitionBy("__number", "__chunk").orderBy("__key", id_col, size_col).rowsBetween(W.unboundedPreceding, 0)
    start = F.col("__before") + F.sum(size_col).over(order) - F.col(size_col)
    return rows.join(offsets, ["__number", "__chunk"]).withColumn("__start", start)


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size_col: str = "size",
    weights: DataFrame | None = None, repeats: int = MAX_REPEATS, block_words: int = 1024, seed: str = "mix",
) -> tuple[DataFrame, DataFrame]:
    """``(rows, slots)``: each row of ``docs`` with ``source_size``, ``target`` and ``taken``, and the mix itself.

    ``docs`` holds each row's number of words in ``size_col``. ``weights`` is ``(source, weight)``; without it
    sources by code point, null last, weigh 1, 2, 3, repeating. ``taken`` counts the words that the mix takes from
    the row, repeats counted; a source's sum is its target in whole words. ``slots`` is the schedule.

    Rows without words are taken 0 times; a null size counts as 0. Null is a source of its own. Rows that share
    an id are laid out one after another, in an order that their size decides. Columns of ``docs`` named like a
    result are replaced. An empty table gives an empty one.
    """
    plain = docs.drop("source_size", "target", "taken").withColumn(size_col, F.coalesce(F.col(size_col).cast("long"), F.lit(0)))
    narrow = plain.select(id_col, source_col, size_col)
    sources = common.stored(with_slots(source_targets(narrow, source_col, size_col, weights, repeats), repeats, block_words))
    slots = schedule(sources, block_words)
    b = block_words
    pieces = (
        laid_out(narrow, sources, id_col, source_col, size_col, seed).where(F.col(size_col) > 0)
        .select(F.col("__number").alias("number"), F.col("__start").alias("start"), (F.col("__start") + F.col(size_col)).alias("end"))
        .withColumn("block", F.explode(F.expr(f"sequence(start div {b}, (end - 1) div {b})")))
        .select("number", "start", "block", F.greatest(F.col("start") - F.col("block") * b, F.lit(0)).alias("from"),
                F.least(F.col("end") - F.col("block") * b, F.lit(b)).alias("to"))
    )
    words = F.greatest(F.lit(0), F.least("to", "take") - F.col("from"))
    taken = pieces.join(slots, ["number", "block"]).groupBy(F.col("number").alias("__number"), F.col("start").alias("__start")).agg(F.sum(words).alias("__taken"))
    rows = laid_out(plain, sources, id_col, source_col, size_col, seed).join(taken, ["__number", "__start"], "left")
    got = F.when(F.col(size_col) > 0, F.coalesce("__taken", F.lit(0))).otherwise(F.lit(0))
    return rows.select(
        *[F.col(f"`{c}`") for c in plain.columns], F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"), got.cast("long").alias("taken"),
    ), slots
