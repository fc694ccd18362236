"""Substring dedup by a sparse suffix array over words.

Only suffixes at content-selected minimisers are kept: each window of ``min_words`` words selects the smallest
``k``-word shingle that starts early enough for ``DEPTH`` words of the suffix to lie inside the window. Equal
windows select the same place, so every repeat of ``min_words`` words or more shows as two suffixes that agree in
their first ``DEPTH`` words.

The suffixes are sorted over the whole cluster by their words (in blocks of eight, each compared by its hash), then
by the stretch of text they stand for, then by document. As the document is part of the order, a passage of any
number of copies spreads over many tasks. Each task compares neighbours: where neighbours agree in the stretch, all
but the smallest document's are repeats; where they only agree in the suffix, the match is extended to the left
and right, window by window. The suffixes at the edges of a task, whose other neighbour is elsewhere, are always
extended. Windows that overlap or touch merge into maximal repeats.

A task knows the smallest document of its own rows only. The first document of a run there, or of a window, is always
asked where another task or another run may hold a smaller one, so what it found is then looked up for the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from corpusloom.llm import common
from corpusloom.llm.substring import (
    ASK, OPEN, REPEATED, SPARE_BUCKETS, asked_windows, head_of, keyed_texts, pack, with_kind, _FIRST, _WINDOWS,
)
from corpusloom.llm.words import Anchors, Hasher, Words, slices

DEPTH, BLOCK_WORDS = 24, 8
ORDER = ["word0", "word8", "word16", "body", "doc"]
_SUFFIX = "word0 long, word8 long, word16 long, body long, doc long, tag long, place long"
_MARKED = "doc long, tag long, place long, origin long, origin_tag long, head long"


def _suffixes(min_words: int, k: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, other = Hasher(), Hasher(seed=9)
        for batch in batches:
            for piece in slices(batch, "text"):
                words = Words(piece.column("text"))
                hashes = hasher.words(words.text, words.start, words.end)
                found = Anchors(hasher, hashes, words.row_of_word(), min_words - DEPTH + k, k, reach=min_words)
                body = other.sequences(other.prefix(hashes), found.first, found.last + min_words)
                at = found.place
                blocks = [hasher.sequences(found.prefix, at + i, at + i + BLOCK_WORDS) for i in range(0, DEPTH, BLOCK_WORDS)]
                doc, tag = (piece.column(c).to_numpy()[found.row] for c in ("doc", "tag"))
                place = pack(OPEN, found.first - words.bounds[found.row], found.last - found.first + 1)
                columns = [*(c.view(np.int64) for c in (*blocks, body)), doc, tag, place]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [*ORDER, "tag", "place"])

    return task


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    w0, w1, w2, body, doc, tag, place = (table.column(c).to_numpy() for c in (*ORDER, "tag", "place"))
    n = len(doc)
    groups, runs = common.heads_of(w0, w1, w2), common.heads_of(w0, w1, w2, body)
    of_group, of_run = common.run_of(groups, n), common.run_of(runs, n)
    origin, origin_tag, head = doc[runs][of_run], tag[runs][of_run], (place[runs][of_run] >> _WINDOWS) & ((1 << _FIRST) - 1)
    later = doc > origin
    bodies = np.bincount(of_group[runs], minlength=len(groups))
    several = np.maximum.reduceat(doc, groups) > np.minimum.reduceat(doc, groups)
    edge = (of_group == 0) | (of_group == len(groups) - 1)
    ask = (((bodies > 1) & several)[of_group] | edge) & ~later
    keep = later | ask
    out = np.where(later, with_kind(place, REPEATED), with_kind(place, ASK))
    columns = {"doc": doc, "tag": tag, "place": out, "origin": origin, "origin_tag": origin_tag, "head": head}
    yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in columns.values()], list(columns))


def _smallest(rows: DataFrame, lower: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` with the origin that their origin's own row of the same ``key`` has in ``lower``, if it is smaller."""
    least = lower.groupBy(F.col("doc").alias("origin"), *key).agg(F.min("origin").alias("lower"))
    return rows.join(least, ["origin", *key], "left").withColumn("origin", F.least("origin", "lower")).drop("lower")


def maximal_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, k: int = 5) -> DataFrame:
    """``(doc_id, start_word, end_word, n_words, first_doc_id)``: repeats of at least ``min_words`` words.

    Each row is a maximal stretch of words of a document that is covered by windows of ``min_words`` words which a
    document with a smaller id has too; ``end_word`` lies behind the last. ``first_doc_id`` is the smallest document
    that has a part of it, of at least ``min_words`` words. Documents without repeats have no row, nor have null, empty and shorter texts. A null
    id counts as the largest. Rows that share an id count as one document and do not repeat each other; their
    repeats are listed once per different text. Extra columns are not read. An empty table gives an empty one.
    """
    if not k < min_words - DEPTH + k <= min_words < 1 << _WINDOWS:
        raise ValueError(f"min_words must lie between {DEPTH + 1} and 4095, k below {DEPTH}")
    count = common.parts(docs)
    texts = keyed_texts(docs, id_col, text_col)
    suffixes = texts.mapInArrow(_suffixes(min_words, k), _SUFFIX)
    in_order = suffixes.repartitionByRange(count, *ORDER).sortWithinPartitions(*ORDER)
    marks = common.stored(in_order.mapInArrow(_neighbours, _MARKED))
    kind = F.shiftright("place", _WINDOWS + _FIRST)
    asked = marks.where(kind == ASK).select("doc", "tag", "place")
    later = asked_windows(texts, asked, min_words, SPARE_BUCKETS * count)
    # neither join has a hot key: each origin stands for rows of the one task in which it was the smallest
    settled = _smallest(later.where("local"), later.where("NOT local"), ["window"]).unionByName(later.where("NOT local"))
    settled = settled.select("doc", "tag", F.col("place").bitwiseAND(~((1 << _WINDOWS) - 1)).bitwiseOR(1).alias("place"), "origin", head_of(F.col("place")).alias("head"))
    repeated = marks.where(kind == REPEATED)
    known = settled.withColumnRenamed("tag", "origin_tag")
    found = _smallest(repeated, known, ["origin_tag", "head"]).select("doc", "tag", "place", "origin").unionByName(settled.drop("head"))

    bits = lambda shift, width: F.shiftright("place", shift).bitwiseAND((1 << width) - 1)
    spans = found.select(
        "doc", "tag", bits(_WINDOWS, _FIRST).alias("start"),
        (bits(_WINDOWS, _FIRST) + bits(0, _WINDOWS) + (min_words - 1)).alias("end"), "origin",
    )
    row = W.partitionBy("doc", "tag").orderBy("start", "end", "origin")
    before = F.max("end").over(row.rowsBetween(W.unboundedPreceding, -1))
    parts = spans.withColumn("new", F.when(F.col("start") <= before, 0).otherwise(1))
    parts = parts.withColumn("number", F.sum("new").over(row.rowsBetween(W.unboundedPreceding, 0)))
    merged = parts.groupBy("doc", "tag", "number").agg(
        F.min("start").alias("start_word"), F.max("end").alias("end_word"), F.min("origin").alias("first_doc_id")
    )
    return merged.select(
        F.nullif(F.col("doc"), F.lit(common.LAST_ID)).alias("doc_id"), "start_word", "end_word",
        (F.col("end_word") - F.col("start_word")).alias("n_words"), "first_doc_id",
    )
