"""Substring dedup by seed and extend on winnowed anchors.

Every window of ``window`` words has one anchor, its smallest ``k``-word shingle (the seed). A run is the stretch
of words around one anchor, reaching out both ways as far as windows choose that anchor. Runs meet by anchor:

1. Equal runs: all but the smallest document's are repeats as a whole.
2. Runs that share the anchor but differ (the ends of a repeat): their windows, which extend the seed to the
   left and right by less than a window, meet by window.

Repeated windows that touch or overlap merge into maximal repeats. Nothing is paired: a run or window is compared
with the smallest document that has it. Each task first settles what it can among its own rows, so the copies of
a passage reach another task once for every few ten megabytes of text, however many there are; an anchor with
many different runs in one task skips step 1 and asks for step 2 at once.

Runs are compared by 128 bits, windows by 64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.llm import common
from corpusloom.llm.words import SMALL_BYTES, Anchors, Hasher, Words, blank_table, slices

FLUSH_ROWS = 1 << 19
MANY_RUNS = 64
SPARE_BUCKETS = 4
# What a place says about its windows.
OPEN, REPEATED, ASK, MARKER = range(4)
_WINDOWS, _FIRST = 12, 34
_BLOB = "bucket int, anchor array<long>, body array<long>, doc array<long>, tag array<long>, place array<long>"
_MARKS = "doc long, tag long, place long"
_FOUND = "doc long, tag long, place long, origin long, window long, local boolean"


def pack(kind, first, windows) -> np.ndarray:
    """48 bits: kind, first window, number of windows."""
    head = (np.asarray(kind, np.int64) << _FIRST) | np.asarray(first, np.int64)
    return (head << _WINDOWS) | np.asarray(windows, np.int64)


def with_kind(place: np.ndarray, kind: int) -> np.ndarray:
    return place & ((1 << (_WINDOWS + _FIRST)) - 1) | (kind << (_WINDOWS + _FIRST))


def head_of(place: Column) -> Column:
    """First window of the run that an asked window belongs to."""
    bits = lambda shift, width: F.shiftright(place, shift).bitwiseAND((1 << width) - 1)
    return bits(_WINDOWS, _FIRST) - bits(0, _WINDOWS) + 1


def kind_of(place: np.ndarray) -> np.ndarray:
    return place >> (_WINDOWS + _FIRST)


def first_of(place: np.ndarray) -> np.ndarray:
    return (place >> _WINDOWS) & ((1 << _FIRST) - 1)


def windows_of(place: np.ndarray) -> np.ndarray:
    return place & ((1 << _WINDOWS) - 1)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (h.view(np.uint64) % np.uint64(buckets)).astype(np.int64)


def settle(anchor, body, doc, tag, place, hot_runs: int | None) -> tuple[np.ndarray, ...]:
    """Compare rows with the smallest document of their body; returns the rows with their kinds renewed.

    Rows of larger documents are REPEATED. With ``hot_runs`` None this is the last word: first rows ask for their
    windows if the anchor has several bodies in several documents, and only REPEATED and ASK rows return. Else
    first rows stay OPEN, but those of anchors with more than ``hot_runs`` bodies ask, leaving one MARKER.
    """
    order = np.lexsort((doc, body, anchor))
    anchor, body, doc, tag, place = anchor[order], body[order], doc[order], tag[order], place[order]
    n = len(anchor)
    runs = common.heads_of(anchor, body)
    of_run = common.run_of(runs, n)
    groups = common.heads_of(anchor)
    of_group = common.run_of(groups, n)
    bodies = np.bincount(of_group[runs], minlength=len(groups))
    later = doc > doc[runs][of_run] if n else np.zeros(0, bool)
    marker = kind_of(place) == MARKER
    if hot_runs is None:
        most, least = np.maximum.reduceat(doc, groups) if n else doc, np.minimum.reduceat(doc, groups) if n else doc
        marked = np.bincount(of_group[marker], minlength=len(groups)) > 0
        ask = ((bodies > 1) & ((most > least) | marked))[of_group] if n else later
        out = np.where(later, with_kind(place, REPEATED), with_kind(place, ASK))
        keep = (later | ask) & ~marker
        return anchor[keep], body[keep], doc[keep], tag[keep], out[keep]
    hot = (bodies > hot_runs)[of_group] if n else later
    place = np.where(later, with_kind(place, REPEATED), np.where(hot, with_kind(place, ASK), place))
    if hot.any():
        at = groups[bodies > hot_runs]
        zero = np.zeros(len(at), np.int64)
        anchor, body = np.append(anchor, anchor[at]), np.append(body, zero.view(body.dtype))
        doc, tag, place = np.append(doc, doc[at]), np.append(tag, zero), np.append(place, with_kind(zero, MARKER))
    return anchor, body, doc, tag, place


def _runs(window: int, k: int, buckets: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, other = Hasher(), Hasher(seed=9)
        held, rows = [], 0

        def flush():
            columns = [np.concatenate(c) for c in zip(*held)]
            held.clear()
            anchor, body, doc, tag, place = settle(*columns, MANY_RUNS)
            settled = np.isin(kind_of(place), (REPEATED, ASK))
            bucket = np.where(settled, _bucket(doc, buckets), _bucket(anchor, buckets))
            anchor[settled] = body[settled] = 0  # compresses away
            return common.bucketed(bucket, anchor=anchor, body=body, doc=doc, tag=tag, place=place)

        for batch in batches:
            for piece in slices(batch, "text", SMALL_BYTES):
                words = Words(piece.column("text"))
                row = words.row_of_word()
                hashes = hasher.words(words.text, words.start, words.end)
                found = Anchors(hasher, hashes, row, window, k)
                if not len(found.first):
                    continue
                body = other.sequences(other.prefix(hashes), found.first, found.last + window)
                doc, tag = (piece.column(c).to_numpy()[found.row] for c in ("doc", "tag"))
                place = pack(OPEN, found.first - words.bounds[found.row], found.last - found.first + 1)
                held.append((found.anchor.view(np.int64), body.view(np.int64), doc, tag, place))
                rows += len(doc)
                if rows >= FLUSH_ROWS:
                    yield flush()
                    rows = 0
        if held:
            yield flush()

    return task


def _compare(table: pa.Table) -> pa.Table:
    columns = [common.flat(table.column(c)) for c in ("anchor", "body", "doc", "tag", "place")]
    done = np.isin(kind_of(columns[-1]), (REPEATED, ASK))
    found = settle(*(c[~done] for c in columns), None)
    return pa.table({n: np.append(c[done], f) for n, c, f in zip(("doc", "tag", "place"), columns[2:], found[2:])})


def extensions(window: int, buckets: int):
    """Windows of the asked places, for comparing; those that the task can settle carry the smaller document.

    In place of a number of windows each has its own number in its run, from 1.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(seed=17)
        held, rows = [], 0

        def flush():
            anchor, doc, tag, place = (np.concatenate(c) for c in zip(*held))
            held.clear()
            order = np.lexsort((doc, anchor))
            anchor, doc, tag, place = anchor[order], doc[order], tag[order], place[order]
            heads = common.heads_of(anchor)
            origin = doc[heads][common.run_of(heads, len(doc))]
            later = doc > origin
            place = np.where(later, with_kind(place, REPEATED), place)
            bucket = np.where(later, _bucket(doc, buckets), _bucket(anchor, buckets))
            return common.bucketed(bucket, anchor=anchor, body=np.where(later, origin, 0), doc=doc, tag=tag, place=place)

        for batch in batches:
            for piece in slices(batch, "text", SMALL_BYTES):
                words = Words(piece.column("text"))
                prefix = hasher.prefix(hasher.words(words.text, words.start, words.end))
                places = piece.column("places")
                asked, of = common.flat(places), np.repeat(np.arange(words.rows), places.value_lengths().to_numpy())
                count = windows_of(asked)
                total = int(count.sum())
                step = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
                first, of = np.repeat(first_of(asked), count) + step, np.repeat(of, count)
                at = words.bounds[of] + first
                doc, tag = (piece.column(c).to_numpy()[of] for c in ("doc", "tag"))
                held.append((hasher.sequences(prefix, at, at + window).view(np.int64), doc, tag, pack(OPEN, first, step + 1)))
                rows += total
                if rows >= FLUSH_ROWS:
                    yield flush()
                    rows = 0
        if held:
            yield flush()

    return task


def compare_extensions(table: pa.Table) -> pa.Table:
    """Windows that a smaller document has too, with the smallest one, or if ``local`` the smallest one in some task."""
    anchor, body, doc, tag, place = (common.flat(table.column(c)) for c in ("anchor", "body", "doc", "tag", "place"))
    done = kind_of(place) == REPEATED
    found = [(doc[done], tag[done], place[done], body[done], anchor[done])]
    anchor, doc, tag, place = anchor[~done], doc[~done], tag[~done], place[~done]
    order = np.lexsort((doc, anchor))
    anchor, doc, tag, place = anchor[order], doc[order], tag[order], place[order]
    heads = common.heads_of(anchor)
    origin = doc[heads][common.run_of(heads, len(doc))]
    later = doc > origin
    found.append((doc[later], tag[later], with_kind(place[later], REPEATED), origin[later], anchor[later]))
    columns = dict(zip(("doc", "tag", "place", "origin", "window"), (np.concatenate(c) for c in zip(*found))))
    return pa.table(columns | {"local": np.arange(len(columns["doc"])) < done.sum()})


def asked_windows(texts: DataFrame, asked: DataFrame, window: int, buckets: int) -> DataFrame:
    """The windows of ``asked (doc, tag, place)`` that a smaller document has too, as :func:`compare_extensions` gives them."""
    chosen = texts.join(_by_document(asked), ["doc", "tag"])
    blobs = chosen.mapInArrow(extensions(window, buckets), _BLOB)
    return blobs.groupBy("bucket").applyInArrow(compare_extensions, _FOUND)


def _by_document(marks: DataFrame) -> DataFrame:
    return marks.groupBy("doc", "tag").agg(F.collect_list("place").alias("places"))


def repeated_windows(texts: DataFrame, window: int = 13, k: int = 5) -> DataFrame:
    """``(doc, tag, places)``: per row of ``texts (doc, tag, text)`` the runs of windows that also start in a smaller document."""
    if not 1 <= k <= window < 1 << _WINDOWS:
        raise ValueError("k must not exceed the window, nor the window 4095 words")
    buckets = SPARE_BUCKETS * common.parts(texts)
    blobs = texts.mapInArrow(_runs(window, k, buckets), _BLOB)
    marks = common.stored(blobs.groupBy("bucket").applyInArrow(_compare, _MARKS))
    kind = F.shiftright("place", _WINDOWS + _FIRST)
    later = asked_windows(texts, marks.where(kind == ASK), window, buckets)
    single = F.col("place").bitwiseAND(~((1 << _WINDOWS) - 1)).bitwiseOR(1)
    return _by_document(marks.where(kind == REPEATED).unionByName(later.select("doc", "tag", single.alias("place"))))


def keyed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc, tag, text)``: the id as a number, what tells rows of one id apart, and the text."""
    return docs.select(common.doc_key(id_col).alias("doc"), common.row_tag(docs, id_col, text_col).alias("tag"), F.col(text_col).alias("text"))


def covered_words(words: Words, places: pa.Array, window: int) -> np.ndarray:
    """For each word whether one of its row's places covers it."""
    lengths = np.nan_to_num(places.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    place, of = common.flat(places), np.repeat(np.arange(words.rows), lengths)
    at = words.bounds[of] + first_of(place)
    change = np.zeros(len(words.start) + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + windows_of(place) + window - 1, -1)
    return np.cumsum(change[:-1]) > 0


def kept_texts(words: Words, kept: np.ndarray) -> pa.Array:
    """Per row its kept words joined by one space."""
    take = np.zeros(len(words.text) + 1, bool)
    take[np.append(words.start[kept], 0)[:-1]] = True
    inside = np.zeros(len(words.text) + 1, np.int64)
    np.add.at(inside, words.start[kept], 1)
    np.add.at(inside, words.end[kept], -1)
    take = np.cumsum(inside[:-1]) > 0
    text = np.where(blank_table()[words.text], np.uint8(32), words.text)
    tail = words.offsets[1:][words.row_of_word()]
    ends = words.end[kept & (words.end < tail)]
    take[ends] = True
    at = np.append(0, np.cumsum(take))[words.offsets]
    data, out = text[take].tobytes(), []
    for i in range(words.rows):
        out.append(data[at[i] : at[i + 1]].rstrip(b" ").decode("utf-8"))
    return pa.array(out, pa.string())


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, k: int = 5) -> DataFrame:
    """Each row of ``docs`` with ``n_words``, ``n_removed``, ``spans`` and ``kept_text``.

    Removed is each word in a window of ``window`` words that also starts in a document with a smaller id; windows
    are judged on the input. ``spans`` are the maximal repeats as word positions (start, end behind the last).
    ``kept_text`` joins the rest by one space.

    Null and empty texts have no words and an empty ``kept_text``. A null id counts as the largest. Rows that
    share an id count as one document, so they do not repeat each other. A column of ``docs`` that is named like
    a result is replaced. An empty table gives an empty one.
    """
    schema = "n_words long, n_removed long, spans array<struct<start: long, end: long>>, kept_text string"

    @F.arrow_udf(schema)
    def cut(text: pa.Array, places: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([text, places], ["text", "places"])
        out = []
        for piece in slices(batch, "text", SMALL_BYTES):
            words = Words(piece.column("text"))
            covered = covered_words(words, piece.column("places"), window)
            sums = np.append(0, np.cumsum(covered))
            edge = np.diff(np.concatenate(([False], covered, [False])).astype(np.int8))
            start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            cuts = words.bounds[(words.bounds > 0) & (words.bounds < len(covered))]
            inner = np.unique(cuts[covered[cuts] & covered[cuts - 1]]) if len(cuts) else cuts
            start, end = np.sort(np.append(start, inner)), np.sort(np.append(end, inner))
            owner = np.searchsorted(words.bounds, start, "right") - 1
            spans = pa.StructArray.from_arrays(
                [pa.array(start - words.bounds[owner]), pa.array(end - words.bounds[owner])], ["start", "end"]
            )
            offsets = np.searchsorted(owner, np.arange(words.rows + 1)).astype(np.int32)
            columns = [
                pa.array(words.counts),
                pa.array(np.diff(sums[words.bounds])),
                pa.ListArray.from_arrays(pa.array(offsets), spans),
                kept_texts(words, ~covered),
            ]
            out.append(pa.StructArray.from_arrays(columns, ["n_words", "n_removed", "spans", "kept_text"]))
        return pa.concat_arrays(out) if out else pa.array([], pa.struct([]))

    cut = cut.asNondeterministic()  # else a filter on the results cuts every text once more, in a worker of its own
    key = {"doc": common.doc_key(id_col), "tag": common.row_tag(docs, id_col, text_col)}
    names = ["n_words", "n_removed", "spans", "kept_text"]
    plain = docs.drop(*[c for c in docs.columns if c in names])
    found = repeated_windows(docs.select(*[c.alias(n) for n, c in key.items()], F.col(text_col).alias("text")), window, k)
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in plain.columns]).alias("row"), *[c.alias(n) for n, c in key.items()])
    cut_rows = held.join(found, ["doc", "tag"], "left").withColumn("cut", cut(F.col("row").getField(text_col), F.col("places")))
    return cut_rows.select(*[F.col("row").getField(c).alias(c) for c in plain.columns], *[F.col("cut").getField(n).alias(n) for n in names])
