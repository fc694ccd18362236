"""Sentence boundaries learned from texts: which words, and which cuts they take back."""

import random

from pyspark.sql import functions as F

from corpusloom import operators as op
from corpusloom.functions.sentences import sentence_spans
from corpusloom.operators.boundaries import BoundaryModel, learned_spans


def texts(n=120):
    draw = random.Random(3)
    plain = ["house", "river", "market", "window", "letter", "garden", "winter", "silver"]
    names = ["Abel", "Berta", "Cäsar", "Dora"]
    sentence = lambda: " ".join(draw.choice(plain) for _ in range(draw.randint(4, 9)))
    out = []
    for _ in range(n):
        parts = []
        for _ in range(draw.randint(3, 8)):
            s = sentence()
            kind = draw.randint(0, 3)
            if kind == 0:
                s += f" ca. {draw.randint(2, 90)} {draw.choice(plain)}"
            if kind == 1:
                s += f" by dr. {draw.choice(names)} and {draw.choice(plain)}"
            parts.append(draw.choice(["However ", "The ", ""]) + s + draw.choice([".", ".", "!", "?"]))
        out.append(" ".join(parts))
    return out


def spans_of(spark, rows, model):
    df = spark.createDataFrame(list(enumerate(rows)), "id int, text string")
    found = df.select("id", sentence_spans(F.col("text")).alias("rules"), learned_spans(F.col("text"), model).alias("own")).collect()
    return {r.id: ([tuple(s) for s in r.rules or []], [tuple(s) for s in r.own or []]) for r in found}


def test_learned_words(spark):
    df = spark.createDataFrame([(t,) for t in texts()] + [(None,), ("",)], "text string")
    model = op.learn_boundaries(df, "text")
    assert {"ca", "dr"} <= set(model.abbreviations) and not {"house", "river", "market"} & set(model.abbreviations)
    assert "however" in model.starters and "the" in model.starters and "house" not in model.starters


def test_spans_differ_where_an_abbreviation_says_so(spark):
    rows = [*texts(), None, "", " \n", "ca. 5 houses", "x ca.", "1. ca. b. c", "a dr. Abel. However ca. 3", "went to dr. However it rained"]
    df = spark.createDataFrame([(t,) for t in texts()], "text string")
    model = op.learn_boundaries(df, "text")
    taken_back = 0
    for i, (rules, own) in spans_of(spark, rows, model).items():
        text, expected = rows[i] or "", []
        for start, end in rules:
            before = text[expected[-1][0] : expected[-1][1]].split()[-1].lower() if expected else ""
            behind = text[start:end].split()[0]
            word = before.rstrip(".!?")
            back = before.endswith(".") and (
                word in model.abbreviations and not (behind[0].isupper() and behind.lower().rstrip(".!?") in model.starters) or f"{word} {behind.lower()}" in model.collocations
            )
            if back:
                expected[-1] = (expected[-1][0], end)
                taken_back += 1
            else:
                expected.append((start, end))
        assert own == expected, rows[i]
    assert taken_back > 20


def test_an_empty_model_leaves_the_rules(spark):
    empty = op.learn_boundaries(spark.createDataFrame([], "text string"), "text")
    assert empty == BoundaryModel([], [], [])
    assert all(rules == own for rules, own in spans_of(spark, texts(20), empty).values())


def test_collocations(spark):
    model = BoundaryModel([], [], ["5 may", "##number## mai"])
    found = spans_of(spark, ["On 5. Mai it rained. Then not.", "On 5. Juni it rained."], model)
    assert [len(own) for _, own in found.values()] == [2, 2] and len(found[0][0]) == 3
