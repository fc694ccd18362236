"""Benchmark decontamination by template canonicalisation.

Words are lower-cased and stripped of ASCII punctuation; numbers, units behind a number and names become typed
placeholders, so a question keeps its template when its parameters change. Every ``WINDOW`` tokens of an item give a
template window. Beside it stands the literal window of the same words without case and punctuation, as whether a word
is a name depends on case and surroundings, which a verbatim copy may not share. Documents' windows first pass a bitmap of fixed size (``BITS``, built from the benchmark), which
lets nearly all clean text go inside the scan; the rest joins the benchmark's windows by hash.

The placeholders of matching windows must then agree on one renaming: an item's value stands for one value in the
document, and back. A document may hold several variants of an item, so this is asked per occurrence: windows with the
same distance between their places in document and item lay the item over one stretch of the document. They vote for
their renaming, and windows at near distances that agree with it are added, as a name may have more or fewer words
in the document. Parts of one item that lie far apart are also judged together. The best of all these counts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from corpusloom.llm import common
from corpusloom.llm.licenses import bare_words
from corpusloom.llm.words import SMALL_BYTES, Hasher, slices

WINDOW, ENOUGH = 8, 13
SHORTEST = 4  # templates of fewer tokens are too short to tell; literal windows have no such bound
SHIFT = 6  # tokens by which the parts of one occurrence may be shifted
BITS = 1 << 22
LEAK_BITS = 1 << 20
RARE = 8
NUMBER, UNIT, NAME = (np.uint64(i) for i in (1, 2, 3))
#: Units of measure that follow a number.
UNITS = (
    "mm cm dm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t gram grams kilogram kilograms oz ounce "
    "ounces lb lbs pound pounds ml cl l liter liters litre litres gal gallon gallons s sec second seconds min minute minutes "
    "h hr hour hours day days week weeks month months year years k c f degree degrees percent usd eur gbp dollar dollars "
    "euro euros cent cents kmh mph hz khz mhz ghz w kw mw j kj v a kb mb gb tb meter meters metre metres kilometer kilometers"
).split()
_WINDOWS = "doc long, tag long, h long, size int, literal boolean, place long, word long, end_word long, tokens long, slots array<long>"


def _positions(piece: pa.RecordBatch):
    """Per bare token: row, word number, template id and value hash; and whether it is a placeholder."""
    words, full, hashes = bare_words(piece.column("text"))
    if (words.text >= 0x80).any():  # case of letters beyond ASCII; words stay the same in number
        _, _, hashes = bare_words(pc.utf8_lower(piece.column("text")))
    row = words.row_of_word()[full]
    text = words.text
    mark = np.zeros(256, bool)
    mark[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
    # first two bytes that are not punctuation
    keep = np.flatnonzero(~mark[text])
    at = np.searchsorted(keep, words.start[full])
    first = text[keep[at]] if len(at) else np.zeros(0, np.uint8)
    after = np.minimum(at + 1, max(0, len(keep) - 1))
    second = np.where(keep[after] < words.end[full], text[keep[after]], 32) if len(at) else first
    upper = (first >= 65) & (first <= 90)
    low = ((second >= 97) & (second <= 122)) | (second >= 0x80)
    closing = np.isin(text[words.end[full] - 1], [ord(c) for c in ".!?:"]) if len(at) else np.zeros(0, bool)
    opens = np.ones(len(row), bool)
    opens[1:] = closing[:-1] | (row[1:] != row[:-1])
    number = (first >= 48) & (first <= 57)
    units = np.sort(Hasher(lower=True).words(*_joined(UNITS)))
    found = np.searchsorted(units, hashes)
    unit = units[np.minimum(found, len(units) - 1)] == hashes
    unit[1:] &= number[:-1] & (row[1:] == row[:-1])
    unit[:1] = False
    name = upper & low & ~opens & ~number
    ids = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, hashes)))
    word = np.flatnonzero(full) - words.bounds[row]
    return row, word, ids, hashes, number | unit | name


def _joined(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    text = np.frombuffer(" ".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    return text, ends - [len(w) for w in words], ends


def _template_windows(lengths: list[int] | None, bitmap: np.ndarray | None):
    """Windows of the given lengths; of items (no lengths given) windows of WINDOW tokens or the whole shorter item.

    Each window comes as a literal one and, where it holds placeholders, as a template.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, verbatim = Hasher(seed=31), Hasher(seed=37)
        for batch in batches:
            for piece in slices(batch, "text", SMALL_BYTES):
                row, word, ids, values, slot = _positions(piece)
                held = np.append(0, np.cumsum(slot))
                kinds = [(True, verbatim, verbatim.prefix(values)), (False, hasher, hasher.prefix(ids))]
                tokens = np.bincount(row, minlength=piece.num_rows)
                heads = np.cumsum(tokens) - tokens
                for size in lengths or range(1, WINDOW + 1):
                    n = len(row) - size + 1
                    if n <= 0:
                        continue
                    at = np.flatnonzero(row[:n] == row[size - 1 :])
                    if lengths is None and size < WINDOW:
                        at = at[tokens[row[at]] == size]
                    for literal, own, prefix in kinds:
                        some = at
                        if not literal:
                            if size < SHORTEST:
                                continue
                            count = held[at + size] - held[at]
                            some = at[(count > 0) & (2 * count <= size)]  # half the window is literal at least
                        h = own.sequences(prefix, some, some + size)
                        if bitmap is not None:
                            passed = common.may_hold(bitmap, h)
                            some, h = some[passed], h[passed]
                        if not len(some):
                            continue
                        if literal and bitmap is not None and size < WINDOW:  # whole items: one copy per text tells all
                            _, once = np.unique(np.stack([row[some].view(np.uint64), h]), axis=1, return_index=True)
                            some, h = some[np.sort(once)], h[np.sort(once)]
                        r = row[some]
                        count = held[some + size] - held[some]
                        places = np.flatnonzero(slot)
                        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                        inside = values[places[np.repeat(held[some], count) + step]] if len(places) else values[:0]
                        yield pa.RecordBatch.from_pydict({
                            "doc": piece.column("doc").take(pa.array(r)), "tag": piece.column("tag").take(pa.array(r)),
                            "h": pa.array(h.view(np.int64)), "size": pa.array(np.full(len(some), size, np.int32)),
                            "literal": pa.array(np.full(len(some), literal)), "place": pa.array(some - heads[r]),
                            "word": pa.array(word[some]), "end_word": pa.array(word[some + size - 1] + 1),
                            "tokens": pa.array(tokens[r]), "slots": common.lists(inside, np.cumsum(count) - count),
                        })

    return task


def _renaming(rows: list[dict], there: dict, back: dict) -> list[dict]:
    """The rows whose pairs of values agree with one renaming: the given one, extended by what most pairs support."""
    votes = Counter(p for row in rows for p in row["pairs"])
    for a, b in sorted(votes, key=lambda p: (-votes[p], p[0] != p[1], p)):
        if a not in there and b not in back:
            there[a], back[b] = b, a
    return [r for r in rows if all(there.get(a) == b for a, b in r["pairs"])]


def _occurrences(rows: list[dict]) -> Iterator[list[dict]]:
    """Per distance of places the windows that agree on its renaming, nearest distances first."""
    shift = lambda r: r["place"] - r["item_place"]
    lines = {d: list(g) for d, g in groupby(sorted(rows, key=shift), key=shift)}
    for d in lines:
        there, back, kept = {}, {}, []
        for near in sorted(range(d - SHIFT, d + SHIFT + 1), key=lambda x: abs(x - d)):
            if near in lines:
                kept += _renaming(lines[near], there, back)
        yield kept


def _summary(rows: list[dict]) -> tuple[int, int, int, int]:
    """Covered tokens of the item, renamed values, first and last word."""
    covered = {i for r in rows for i in range(r["item_place"], r["item_place"] + r["size"])}
    changed = {p for r in rows for p in r["pairs"] if p[0] != p[1]}
    return len(covered), len(changed), min((r["word"] for r in rows), default=0), max((r["end_word"] for r in rows), default=0)


def _consistent(table: pa.Table) -> pa.Table:
    """One row for a document and item: the most that an occurrence covers, verbatim or under one renaming of values."""
    rows = table.to_pylist()
    for row in rows:
        row["pairs"] = list(zip(row["item_slots"], row["item_slots"] if row["literal"] else row["slots"]))
    found = [_summary(_renaming(rows, {}, {})), _summary([r for r in rows if r["literal"]]), *map(_summary, _occurrences(rows))]
    covered, changed, start, end = min(found, key=lambda f: (-f[0], f[1:]))
    first = rows[0]
    return pa.table({
        "doc": pa.array([first["doc"]], pa.int64()), "tag": pa.array([first["tag"]], pa.int64()),
        "item_id": pa.array([first["item_id"]], pa.int64()), "item_tag": pa.array([first["item_tag"]], pa.int64()),
        "matched_tokens": pa.array([covered], pa.int64()), "item_tokens": pa.array([first["item_tokens"]], pa.int64()),
        "start_word": pa.array([start], pa.int64()), "end_word": pa.array([end], pa.int64()), "changed_values": pa.array([changed], pa.int64()),
    })


_FOUND = (
    "doc long, tag long, item_id long, item_tag long, matched_tokens long, item_tokens long, start_word long, end_word long, changed_values long"
)
_KEY, _ITEM = ["h", "size", "literal"], ["item_id", "item_tag"]


def _index(benchmark: DataFrame, item_col: str, item_text: str, enough: int) -> DataFrame:
    """Windows of all items. ``common`` ones stand in more than ``RARE`` items.

    A document that shares nothing else with an item than common windows can hold a leak of it only if they cover
    enough of the item (``wide`` items). Wide items whose common windows are the same in the same places are a class,
    for which the smallest item stands (``open``); ``n_items`` is its size.
    """
    items = benchmark.select(common.doc_key(item_col).alias("doc"), common.text_hash(item_text).alias("tag"), F.col(item_text).alias("text"))
    index = common.stored(
        items.dropDuplicates(["doc", "tag"]).mapInArrow(_template_windows(None, None), _WINDOWS).select(
            *_KEY, F.col("doc").alias("item_id"), F.col("tag").alias("item_tag"), F.col("place").alias("item_place"), F.col("tokens").alias("item_tokens"), F.col("slots").alias("item_slots")
        )
    )
    often = index.select(*_KEY, *_ITEM).distinct().groupBy(*_KEY).count().where(F.col("count") > RARE).drop("count")
    shared = index.join(often, _KEY)
    in_order = Window.partitionBy(*_ITEM).orderBy("item_place", "size").rowsBetween(Window.unboundedPreceding, -1)  # one item's windows
    end = F.col("item_place") + F.col("size")
    fresh = F.greatest(F.lit(0), end - F.greatest("item_place", F.coalesce(F.max(end).over(in_order), F.lit(0))))
    places = F.array_sort(F.collect_list(F.struct("item_place", *_KEY)))
    wide = shared.withColumn("fresh", fresh).groupBy(*_ITEM).agg(F.sum("fresh").alias("covered"), F.max("item_tokens").alias("tokens"), places.alias("places"))
    wide = wide.where(F.col("covered") >= F.least(F.lit(enough), F.col("tokens")))
    start = F.col("places")[0]["item_place"]
    alike = F.transform("places", lambda w: F.struct((w["item_place"] - start).alias("at"), w["h"].alias("h"), w["literal"].alias("literal")))
    classes = wide.select(*_ITEM, F.md5(F.to_json(alike)).alias("alike"))
    first = classes.groupBy("alike").agg(F.min(F.struct(*_ITEM)).alias("item"), F.count("*").alias("n_items")).select("item.*", "n_items")
    marked = index.join(often.withColumn("common", F.lit(True)), _KEY, "left").join(first, _ITEM, "left")
    return common.stored(marked.withColumns({"common": F.coalesce("common", F.lit(False)), "open": F.col("n_items").isNotNull(), "n_items": F.coalesce("n_items", F.lit(1))}))


def _leaks(texts: DataFrame, benchmark: DataFrame, item_col: str, item_text: str, enough: int) -> DataFrame:
    """Leaks in ``texts (doc, tag, text)``."""
    index = _index(benchmark, item_col, item_text, enough)
    lengths = sorted(r["size"] for r in index.select("size").distinct().collect())  # up to WINDOW rows
    bitmap = common.bitmap(index.select("h"), BITS)  # of a fixed size, whatever the benchmark's
    windows = common.stored(texts.mapInArrow(_template_windows(lengths or [WINDOW], bitmap), _WINDOWS).drop("tokens"))
    own = [*_KEY, *_ITEM, "item_place", "item_tokens", "item_slots"]
    met = windows.join(index.where("open OR NOT common").select(*own), _KEY)
    # Common windows count for the pairs that have met otherwise.
    pairs = met.select("doc", "tag", *_ITEM).distinct()
    rest = index.where("common AND NOT open").select(*own)
    more = pairs.join(rest, _ITEM).join(windows, ["doc", "tag", *_KEY])
    matches = met.unionByName(more)
    found = matches.groupBy("doc", "tag", *_ITEM).applyInArrow(_consistent, _FOUND)
    sizes = index.where("open").select(*_ITEM, "n_items").distinct()
    kept = found.where(F.col("matched_tokens") >= F.least(F.lit(enough), F.col("item_tokens"))).join(sizes, _ITEM, "left")
    return kept.withColumns({"n_items": F.coalesce("n_items", F.lit(1)), "item_id": F.nullif(F.col("item_id"), F.lit(common.LAST_ID))}).drop("item_tag")


def benchmark_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text: str = "text", enough: int = ENOUGH,
) -> DataFrame:
    """``(doc_id, item_id, matched_tokens, item_tokens, start_word, end_word, changed_values, n_items)`` per document and item.

    A pair is listed when matching windows that are verbatim, whatever their case, punctuation and line breaks, or agree
    on one renaming cover ``enough`` tokens of the item, or all of a shorter one. The other columns tell of the best
    occurrence. ``changed_values`` counts renamed placeholders; 0 is a verbatim leak. Items of fewer than four
    tokens, and windows that hold more placeholders than words, match verbatim only. More than ``RARE`` items that have
    a passage of that length in common are told by the smallest of them, ``n_items`` in number, where a document has that
    passage alone. Null and empty texts never match. Items without an id are looked for as well, their ``item_id`` is
    null; a null document id stays null. Rows that share an id are judged by their text each, once per different text.
    Extra columns are not read. Without items or documents the result is empty.
    """
    texts = docs.select(common.doc_key(id_col).alias("doc"), common.text_hash(text_col).alias("tag"), F.col(text_col).alias("text"))
    found = _leaks(texts, benchmark, item_col, item_text, enough)
    columns = ["item_id", "matched_tokens", "item_tokens", "start_word", "end_word", "changed_values", "n_items"]
    return found.select(F.nullif(F.col("doc"), F.lit(common.LAST_ID)).alias("doc_id"), *columns)


def without_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", enough: int = ENOUGH
) -> DataFrame:
    """The rows of ``docs`` that hold no item of the benchmark, with the same columns, whatever their names.

    Rows that a bitmap of fixed size knows to be clean stay where they are; only the others meet the list of leaks.
    """
    key = {"doc": common.doc_key(id_col), "tag": common.text_hash(text_col)}
    texts = docs.select(*[c.alias(n) for n, c in key.items()], F.col(text_col).alias("text"))
    bad = common.stored(_leaks(texts, benchmark, item_col, item_text, enough).select("doc", "tag").distinct())
    bitmap = common.bitmap(bad.select(F.xxhash64("doc", "tag").alias("h")), LEAK_BITS)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(n) for n, c in key.items()])
    rows = rows.withColumn("maybe", common.is_in(bitmap, F.xxhash64("doc", "tag")))
    kept = rows.where("NOT maybe").drop("maybe").unionByName(rows.where("maybe").drop("maybe").join(bad, ["doc", "tag"], "left_anti"))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
