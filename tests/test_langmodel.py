"""Languages by character n-grams against counting one by one, and on texts too short for stop words."""

import collections
import math

import pytest

from corpusloom import operators as op

TEXTS = [
    ("de", "Die Straße führt durch das kleine Städtchen und über die alte Brücke zum Markt, wo Händler ihre Früchte verkaufen."),
    ("de", "Nachmittags scheint häufig die Sonne, doch morgens liegt dichter Nebel zwischen den Häusern und auf den Wiesen."),
    ("en", "The street leads through the little town and across the old bridge to the market, where traders are selling their fruit."),
    ("en", "In the afternoon the sun is often shining, but in the morning thick fog lies between the houses and over the meadows."),
    ("fr", "La rue traverse la petite ville et le vieux pont jusqu'au marché, où les marchands vendent leurs fruits aux passants."),
    (None, "Nobody said what this is."), ("fr", None),
]


@pytest.mark.parametrize("n", [1, 3])
def test_scores_one_by_one(spark, n):
    df = spark.createDataFrame(TEXTS, "lang string, text string").repartition(3)
    model = op.learn_languages(df, "text", "lang", n=n, alpha=0.5)
    grams = lambda t: [t.lower()[i : i + n] for i in range(len(t) - n + 1)]
    counts, texts = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in TEXTS:
        if lang and text:
            counts[lang].update(grams(text))
            texts[lang] += 1
    known = {g for c in counts.values() for g in c}
    found = {r.text: r for r in op.classify_language(df, "text", model).collect()}
    for _, text in TEXTS:
        if text is None:
            assert found[None].language is None and found[None].language_p is None
            continue
        score = {
            lang: math.log(texts[lang] / 5) + sum(math.log((c[g] + 0.5) / (c.total() + 0.5 * (len(known) + 1))) for g in grams(text)) for lang, c in counts.items()
        }
        best = min(score, key=lambda lang: (-score[lang], lang))
        row = found[text]
        assert row.language == best and row.language_score == pytest.approx(score[best])
        assert row.language_p == pytest.approx(1 / sum(math.exp(max(-700, s - score[best])) for s in score.values()))


def test_short_texts_without_stop_words(spark):
    model = op.learn_languages(spark.createDataFrame(TEXTS, "lang string, text string"), "text", "lang")
    short = [("Früchte", "de"), ("Häuser", "de"), ("sunshine thing", "en"), ("bridges", "en"), ("marchés", "fr"), ("passant", "fr")]
    rows = op.classify_language(spark.createDataFrame(short, "text string, expected string"), "text", model).collect()
    assert all(r.language == r.expected for r in rows)


def test_awkward_rows(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    model = op.learn_languages(empty, "text", "lang")
    assert model.languages == []
    some = spark.createDataFrame([("x", ""), ("x", None), ("x", "ab")], "language string, text string")
    assert {r.language for r in op.classify_language(some, "text", model).collect()} == {None}
    model = op.learn_languages(spark.createDataFrame(TEXTS, "lang string, text string"), "text", "lang")
    rows = {r.text: r.language for r in op.classify_language(some, "text", model).collect()}
    assert rows[None] is None and rows[""] == "de" and op.classify_language(empty, "text", model).count() == 0
    with pytest.raises(ValueError):
        op.learn_languages(empty, "text", "lang", n=4)
