"""Counting with many patterns against Python's re and against the operator for few patterns."""

import random
import re
import time

import pyarrow as pa
import pytest

from corpusloom import operators as op
from corpusloom.functions.automaton import Automaton, compiled, literals
from corpusloom.operators.matchmany import _Counter


def test_literals():
    assert literals("Abc") == (["abc"], True) and literals(r"\bthe\b") == (["the"], False)
    assert literals("(?:foo|bar)x") == (["foo", "bar"], False) and literals("ab?cde") == (["cde"], False)
    assert [literals(p) for p in ("a?", r"\w+", "foo|", "[ab]+", "é")] == [None] * 5


def test_words_that_lie_in_each_other():
    words = ["he", "she", "his", "hers", "e", "rs"]
    text = b"ushers\xffhehis"
    import numpy as np

    places, numbers = Automaton(words).find(np.frombuffer(text, np.uint8))
    found = sorted((p, words[n]) for p, n in zip(places.tolist(), numbers.tolist()))
    assert found == sorted((i + len(w), w) for w in words for i in range(len(text)) if text.startswith(w.encode(), i))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_counts_like_python(seed):
    draw = random.Random(seed)
    patterns = [("".join(draw.choice("abc") for _ in range(draw.randint(1, 4))), draw.random() < 0.3) for _ in range(60)]
    patterns += [(p, False) for p in ("a+b", "(?:ab|ca)c*", "[ab]", "c(?=a)", "s", "k+", "i", "aa|b", "é", "a{2,}", "(?<=a)b")] + [(r"\bab", True), ("AB", True)]
    texts = ["".join(draw.choice("aabcABC sſKİı é\n") for _ in range(draw.randint(0, 3000))) for _ in range(50)] + [None, "", "aaaa"]
    expected = [{i: n for i, p in enumerate(patterns) if (n := sum(1 for _ in compiled(*p).finditer(t or "")))} for t in texts]
    assert _Counter(patterns)(pa.array(texts)) == expected


def test_same_numbers_as_few_patterns(spark):
    rows = [(1, "Aaa bbb CcC d aaab"), (2, ""), (3, None), (4, "x aaaa. the a.b")]
    df = spark.createDataFrame(rows, "id long, text string")
    dictionary = [
        {"g": "as", "w": "many", "regex": "a{2,}", "case": False}, {"g": "as", "w": "two", "regex": "aa", "case": True},
        {"g": "rest", "w": "any", "regex": "[b-d]+", "case": False}, {"g": "rest", "w": "the", "regex": r"\bthe\b", "case": False},
    ]
    wide = op.match_counter(df, "text", dictionary, ["g", "w"], "regex", "case").collect()
    got = {r.id: r.matches for r in op.match_counts(df, "text", dictionary, ["g", "w"], "regex", "case").collect()}
    nodes = ("as", "many", "two", "rest", "any", "the")
    assert got == {r.id: {n: r[n] for n in nodes if r[n]} for r in wide}
    with pytest.raises(ValueError):
        op.match_counts(df, "text", dictionary, ["g", "w"], "regex", out="id")
    assert op.match_counts(df.limit(0), "text", dictionary, ["g", "w"], "regex").count() == 0


def test_time_hardly_grows_with_patterns():
    draw = random.Random(4)
    word = lambda: "".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randint(5, 8)))
    vocabulary = list({word() for _ in range(20_000)})
    texts = pa.array([" ".join(draw.choice(vocabulary) for _ in range(300)) for _ in range(300)])
    seconds = {}
    for n in (50, 5000):
        counter = _Counter([(w, False) for w in vocabulary[:n]])
        begin = time.process_time()
        found = counter(texts)
        seconds[n] = time.process_time() - begin
        assert found[0] == {i: len(re.findall(w, texts[0].as_py())) for i, w in enumerate(vocabulary[:n]) if w in texts[0].as_py()}
    assert seconds[5000] < 10 * seconds[50] + 1  # a hundred times the patterns, and matches
