"""Class-based TF-IDF: top words per group and similarity between groups."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.functions.stopwords import is_word_of, stop_words
from corpusloom.functions.text import combine_text, tokens
from corpusloom.runtime import durable

TILE_GROUPS = 512
TILE_ROWS = 1_000_000
_WORDS_PER_STEP = 4096


def ctfidf(
    df: DataFrame,
    group: str | Sequence[str],
    cols: str | Sequence[str],
    ranks: int = 20,
    lang: str | None = "german",
    include_tf: bool = False,
) -> DataFrame:
    """``group_label, word, rank, tfidf`` of the ``ranks`` heaviest words of each group.

    Rank 1 is the highest score, ties go by word. ``include_tf`` adds ``word_tf``, the word of the same
    rank by plain frequency. Several group columns make a JSON object label.
    """
    counts = term_counts(df, group, cols, lang)
    weights = _weighted(counts, df)
    # Ranking needs no normalisation (one divisor per group), so only ranked rows meet the norms. The
    # window keeps at most ``ranks`` rows per group and task before it shuffles.
    top = _ranked(weights, ranks, F.desc("weight"), F.asc("word"))
    norms = weights.groupBy("group_label").agg(F.sum(F.abs("weight")).alias("norm"))
    scored = top.join(norms, "group_label").select(
        "group_label",
        "word",
        "rank",
        F.coalesce(F.try_divide("weight", "norm"), F.lit(0.0)).alias("tfidf"),
    )
    if not include_tf:
        return scored
    by_tf = _ranked(counts, ranks, F.desc("tf"), F.asc("word"))
    by_tf = by_tf.select("group_label", "rank", F.col("word").alias("word_tf"))
    return scored.join(by_tf, ["group_label", "rank"]).select("group_label", "word", "word_tf", "rank", "tfidf")


def _ranked(weights: DataFrame, ranks: int, *order: Column) -> DataFrame:
    window = Window.partitionBy("group_label").orderBy(*order)
    return weights.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= ranks)


def term_counts(
    df: DataFrame, group: str | Sequence[str], cols: str | Sequence[str], lang: str | None
) -> DataFrame:
    """``group_label, word, tf``; rows without a group or text add nothing.

    Everything downstream starts at this aggregation, whose shuffle Spark runs once and reuses. Counts
    are combined map-side, so a hot group or word sends one row per task and key.
    """
    docs = _labelled(df, group, cols).where(F.col("group_label").isNotNull())
    words = docs.select("group_label", F.explode(tokens(F.col("text"))).alias("word"))
    # Joins on the word would add this filter on their side only and keep the branches from sharing.
    words = words.where(F.col("word").isNotNull())
    stops = stop_words(lang)
    if stops:
        words = words.where(~is_word_of("word", stops))
    return words.groupBy("group_label", "word").agg(F.count(F.lit(1)).alias("tf"))


def term_weights(
    df: DataFrame, group: str | Sequence[str], cols: str | Sequence[str], lang: str | None
) -> DataFrame:
    """``group_label, word, weight`` with ``weight = tf * ln(rows / total count of the word)``.

    ``rows`` counts every input row, also those without a group.
    """
    return _weighted(term_counts(df, group, cols, lang), df)


def _weighted(counts: DataFrame, df: DataFrame) -> DataFrame:
    rows = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    totals = counts.groupBy("word").agg(F.sum("tf").alias("total"))
    return counts.join(totals, "word").select(
        "group_label", "word", (F.col("tf") * F.ln(rows / F.col("total"))).alias("weight")
    )


def _labelled(df: DataFrame, group: str | Sequence[str], cols: str | Sequence[str]) -> DataFrame:
    groups = [group] if isinstance(group, str) else list(group)
    texts = [cols] if isinstance(cols, str) else list(cols)
    label = F.col(groups[0])
    if len(groups) > 1:
        complete = F.lit(True)
        for g in groups:
            complete = complete & F.col(g).isNotNull()
        label = F.when(complete, F.to_json(F.struct(*groups)))
    text = F.col(texts[0]) if len(texts) == 1 else combine_text(texts, ". ")
    return df.select(label.alias("group_label"), text.alias("text"))


def group_similarity(
    df: DataFrame,
    group: str | Sequence[str],
    cols: str | Sequence[str],
    lang: str | None = "german",
    tile_groups: int = TILE_GROUPS,
) -> DataFrame:
    """Cosine of the groups' weights as ``(group_a, group_b, similarity)``, the full square.

    A tiled matrix product instead of a self-join on the word, which would put out every pair of groups
    for each shared word: groups are hashed into blocks of about ``tile_groups``, words into slices, and
    each (block, block, slice) task multiplies two small matrices of about ``TILE_ROWS`` entries at most.
    A frequent word or a hot group is cut along both directions; partial products are added up by
    (group, group).
    """
    # Written once: its size decides the slices, and it is read twice.
    weights = durable(term_weights(df, group, cols, lang))
    labels = _labelled(df, group, cols).where(F.col("group_label").isNotNull()).select("group_label").distinct()
    blocks = max(1, -(-labels.count() // tile_groups))
    tiles = blocks * (blocks + 1) // 2
    cores = df.sparkSession.sparkContext.defaultParallelism
    slices = max(1, -(-2 * weights.count() // (blocks * TILE_ROWS)), cores // tiles)

    norms = weights.groupBy("group_label").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    unit = weights.join(norms, "group_label").select(
        "group_label",
        "word",
        F.coalesce(F.try_divide("weight", "norm"), F.lit(0.0)).alias("value"),
        F.pmod(F.xxhash64("word"), F.lit(slices)).cast("int").alias("piece"),
    )
    # Wordless rows carry every group into slice 0 of its tiles, which puts out the zeros as well.
    members = labels.select(
        "group_label", F.lit(None).cast("string").alias("word"), F.lit(0.0).alias("value"), F.lit(0).alias("piece")
    )
    block = F.pmod(F.xxhash64("group_label"), F.lit(blocks)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    tiled = (
        unit.unionByName(members)
        .select("*", block.alias("block"))
        .select("*", other.alias("other"))
        .select(
            F.least("block", "other").alias("tile_a"),
            F.greatest("block", "other").alias("tile_b"),
            "piece",
            "block",
            "group_label",
            "word",
            "value",
        )
    )
    label_type = labels.schema["group_label"].dataType.simpleString()
    products = tiled.groupBy("tile_a", "tile_b", "piece").applyInPandas(
        _multiply_tile, f"group_a {label_type}, group_b {label_type}, product double"
    )
    return products.groupBy("group_a", "group_b").agg(F.sum("product").alias("similarity"))


def _multiply_tile(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    tile_a, tile_b, piece = (int(k) for k in key)
    codes, labels = pd.factorize(rows["group_label"])
    side_of = np.zeros(len(labels), dtype=np.int64)
    side_of[codes] = rows["block"].to_numpy()
    in_a, in_b = np.flatnonzero(side_of == tile_a), np.flatnonzero(side_of == tile_b)
    position = np.zeros(len(labels), dtype=np.int64)
    position[in_a] = np.arange(len(in_a))
    position[in_b] = np.arange(len(in_b))

    used = rows["word"].notna().to_numpy()
    word, _ = pd.factorize(rows["word"][used])
    order = np.argsort(word, kind="stable")
    word, who = word[order], codes[used][order]
    value = rows["value"].to_numpy()[used][order]
    product = np.zeros((len(in_a), len(in_b)))
    n_words = int(word[-1]) + 1 if len(word) else 0
    for first in range(0, n_words, _WORDS_PER_STEP):
        low, high = np.searchsorted(word, [first, first + _WORDS_PER_STEP])
        w, g, v = word[low:high] - first, who[low:high], value[low:high]

        def dense(block: int, size: int) -> np.ndarray:
            matrix = np.zeros((size, _WORDS_PER_STEP))
            mine = side_of[g] == block
            matrix[position[g[mine]], w[mine]] = v[mine]
            return matrix

        left = dense(tile_a, len(in_a))
        right = left if tile_a == tile_b else dense(tile_b, len(in_b))
        product += left @ right.T

    a, b = np.indices(product.shape).reshape(2, -1) if piece == 0 else np.nonzero(product)
    names = np.asarray(labels)
    out = pd.DataFrame({"group_a": names[in_a[a]], "group_b": names[in_b[b]], "product": product[a, b]})
    if tile_a == tile_b:
        return out
    mirrored = out.rename(columns={"group_a": "group_b", "group_b": "group_a"})
    return pd.concat([out, mirrored[out.columns]], ignore_index=True)
