"""Rows that share an id, among them thousands without one; passages that many items and documents share."""

import collections
import random
import time

import pytest
from pyspark.sql import functions as F

from corpusloom.llm.decontam import benchmark_leaks, without_leaks
from corpusloom.llm.lm import score_texts
from corpusloom.llm.substring import remove_repeats
from corpusloom.llm.suffix import maximal_repeats
from tests.llm import brute
from tests.llm.test_llm import vocabulary

SCHEMA = "doc_id long, text string, doc string, tag int, __doc int, row string, maybe int"


def rows_sharing_ids(n=1200):
    """Documents 1 to 19, rows that share id 20, and rows without an id; some repeat passages of the others."""
    draw, words = random.Random(13), vocabulary(4000, 5)
    text = lambda k: [draw.choice(words) for _ in range(k)]
    own = {i: text(90) for i in range(1, 20)}
    rows = [(i, " ".join(w)) for i, w in own.items()]
    for i in range(n):
        w = text(draw.randint(1, 60))
        if i % 3 == 0:
            source, at = own[draw.randint(1, 19)], draw.randint(0, 30)
            w[draw.randint(0, len(w)) : 0] = source[at : at + draw.choice([12, 13, 55])]
        rows.append((20 if i % 5 == 0 else None, " ".join(w)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 3, 4, "y", 5) for r in rows], SCHEMA).repartition(6)


def expected_cuts(rows, n):
    """Per row (id, text): words that lie in windows which start in a document with a smaller id, null last."""
    key = lambda i: float("inf") if i is None else i
    first = {}
    for i, t in rows:
        w = brute.words(t)
        for j in range(len(w) - n + 1):
            gram = tuple(w[j : j + n])
            first[gram] = min(first.get(gram, key(i)), key(i))
    out = collections.Counter()
    for i, t in rows:
        w = brute.words(t)
        covered = [False] * len(w)
        for j in range(len(w) - n + 1):
            if first[tuple(w[j : j + n])] < key(i):
                covered[j : j + n] = [True] * n
        out[i, len(w), sum(covered), " ".join(x for x, c in zip(w, covered) if not c)] += 1
    return out


def test_substring(spark):
    rows = rows_sharing_ids()
    out = remove_repeats(frame(spark, rows))
    assert out.columns == [*(c.split()[0] for c in SCHEMA.split(", ")), "n_words", "n_removed", "spans", "kept_text"]
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in out.collect()) == expected_cuts(rows, 13)


def test_rows_with_equal_short_hashes(spark):
    """Many rows without an id, of which one repeats a document, in either order."""
    draw, words = random.Random(3), vocabulary(5000, 8)
    base = " ".join(draw.choice(words) for _ in range(60))
    rows = [(1, base), *((None, " ".join(draw.choice(words) for _ in range(20))) for _ in range(2000)), (None, " ".join(draw.choice(words) for _ in range(300)) + " " + base)]
    for order in (rows, rows[::-1]):
        got = collections.Counter(r.n_removed for r in remove_repeats(frame(spark, order)).collect())
        assert got == {0: 2001, 60: 1}


def test_suffix_array(spark):
    rows = rows_sharing_ids()
    got = collections.Counter()
    for r in maximal_repeats(frame(spark, rows), min_words=50).collect():
        got[r.doc_id] += r.n_words
    expected = collections.Counter()
    for i, _, removed, _ in expected_cuts(sorted(set(rows), key=str), 50).elements():
        expected[i] += removed
    assert got == expected


def test_language_model(spark):
    rows = rows_sharing_ids(400)
    got = collections.Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in score_texts(frame(spark, rows)).collect())
    again = collections.Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in score_texts(frame(spark, rows).repartition(3)).collect())
    assert got == again and sum(got.values()) == len(rows)


def test_leaks_in_rows_sharing_ids(spark):
    draw, words = random.Random(4), vocabulary(3000, 6)
    text = lambda k: " ".join(draw.choice(words) for _ in range(k))
    items = [(i if i % 4 else None, text(20)) for i in range(40)]
    rows = [(None if i % 2 else 7, text(15) + (" " + draw.choice(items)[1] if i % 10 == 0 else "") + " " + text(5)) for i in range(2000)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    holds = lambda t: [i for i, x in items if x in t]
    found = collections.Counter((r.doc_id, r.item_id) for r in benchmark_leaks(frame(spark, rows), benchmark).collect())
    assert found == collections.Counter((d, i) for d, t in rows for i in holds(t))
    clean = without_leaks(frame(spark, rows), benchmark)
    assert clean.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert collections.Counter(r.text for r in clean.collect()) == collections.Counter(t for _, t in rows if not holds(t))


@pytest.mark.parametrize("length", [12, 20])
def test_line_shared_by_many_items_and_documents(spark, length):
    """A line too short to be a leak costs nothing; a longer one is told once for each document."""
    draw, words = random.Random(5), vocabulary(3000, 7)
    text = lambda k, start="": " ".join(start + draw.choice(words) for _ in range(k))
    line = text(length)
    items = [(i, f"{line} {text(12, "q")}") for i in range(600)]  # else some go on like a document by chance
    leaked = {i: draw.randrange(600) for i in range(0, 1500, 50)}
    docs = [(i, f"{text(10)} {items[leaked[i]][1] if i in leaked else line} {text(10)}") for i in range(1500)]
    begin = time.time()
    found = {(r.doc_id, r.item_id): r for r in benchmark_leaks(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert time.time() - begin < 60
    pairs = set(leaked.items())
    if length >= 13:
        pairs |= {(d, 0) for d, _ in docs}
        assert all(r.n_items == (600 if i == 0 else 1) for (_, i), r in found.items())
    same_start = {(d, i) for d, x in leaked.items() for i, t in items if t.split()[length] == items[x][1].split()[length]}
    assert pairs <= set(found) <= pairs | same_start
    assert all(found[p].matched_tokens == length + 12 for p in leaked.items())
