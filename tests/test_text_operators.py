import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corpusloom import operators as op
from corpusloom.functions.stopwords import stop_words
from corpusloom.operators.matchcount import node_leaves
from tests.test_functions import TEXTS, python_sentences

KWIC_TEXTS = [t for t in TEXTS if t] + [
    "The end. The start of the end! Then theirs?  The.   ",
    "a. the b the. c? the! d the e the. f the. g. h the",
]


def python_kwic(texts, patterns, no_overlap=False):
    out = []
    for doc, text in enumerate(texts):
        spans, taken = python_sentences(text), set()
        for pattern in patterns:
            for m in re.finditer(pattern, text, re.IGNORECASE):
                if not spans:
                    continue
                i = max(n for n, (start, _) in enumerate(spans) if start <= m.start())
                if no_overlap:
                    if taken & {i - 1, i, i + 1}:
                        continue
                    taken |= {i - 1, i, i + 1}
                parts = [text[a:b] for a, b in spans]
                before = parts[i - 1] if i > 0 else ""
                after = parts[i + 1] if i + 1 < len(parts) else ""
                out.append((doc, pattern, f"{before} {parts[i]} {after}"))
    return sorted(out)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(KWIC_TEXTS)) + [(99, None)], "id long, text string").cache()


@pytest.mark.parametrize("no_overlap", [False, True])
@pytest.mark.parametrize(
    "patterns",
    [
        ["the", "e"],  # searched per sentence
        [r"\.\s+[a-z]", r"the\s"],  # reaches over sentence ends
        [r"[.!?)]", r"\s+"],  # starts at marks, closers and blanks
        [r"\.", "the"],
    ],
)
def test_kwic_like_python(docs, patterns, no_overlap):
    got = op.kwic(docs, "text", patterns, "id", no_overlap=no_overlap, keep_data=False)
    assert got.columns == ["context", "keyword", "parent_id"]
    assert sorted((r.parent_id, r.keyword, r.context) for r in got.collect()) == python_kwic(
        KWIC_TEXTS, patterns, no_overlap
    )


def test_kwic_options(spark, docs):
    master = op.kwic(docs, "text", ["the", "a"], "id", master_expr=r"\b<KEYWORD>\b", keep_data=False).collect()
    assert {r.keyword for r in master} == {"the", "a"}
    full = op.kwic(docs, "text", ["the"], "id")
    assert full.columns == ["text", "sent_ranges", "context", "keyword", "parent_id"]
    two = spark.createDataFrame([(0, "Fun here", "no luck")], "id long, a string, b string")
    row = op.kwic(two, ["a", "b"], ["luck"], "id").first()
    assert row.combined_text == "Fun here. no luck" and row.context == "Fun here. no luck "
    with pytest.raises(ValueError, match="not a regular expression"):
        op.kwic(docs, "text", ["("], "id")


def test_split_sentences(spark):
    df = spark.createDataFrame([(1, "Aa bb. Cc dd! Ee ff? Gg."), (2, ""), (3, None)], "id long, t string")
    got = op.split_sentences(df, "t", 3).collect()
    assert [tuple(r) for r in got] == [(1, "Aa bb. Cc dd! Ee ff?"), (1, "Gg.")]
    assert op.split_sentences(df, "t", 3, "part").columns == ["id", "t", "part"]


def python_weights(rows, stops):
    counts = defaultdict(Counter)
    for group, text in rows:
        if group is not None and text is not None:
            counts[group].update(w for w in re.findall(r"\b\w\w+\b", text.lower()) if w not in stops)
    totals = Counter()
    for c in counts.values():
        totals.update(c)
    return {g: {w: n * math.log(len(rows) / totals[w]) for w, n in c.items()} for g, c in counts.items()}


GROUPED = [
    ("a", "apple pear apple the plum plum plum plum plum plum"),
    ("a", "pear kiwi"),
    ("b", "apple fig fig"),
    ("c", "kiwi grape, grape; Grape"),
    (None, "apple ghost"),
    ("d", "the of and"),
    ("b", None),
]


def test_ctfidf_like_python(spark):
    df = spark.createDataFrame(GROUPED, "g string, t string")
    weights = python_weights(GROUPED, set(stop_words("english")))
    got = {(r.group_label, r["rank"]): r for r in op.ctfidf(df, "g", "t", 3, "english", include_tf=True).collect()}
    assert {g for g, _ in got} == {"a", "b", "c"}  # all words of d are stop words
    for group, words in weights.items():
        norm = sum(abs(w) for w in words.values())
        for rank, (word, weight) in enumerate(sorted(words.items(), key=lambda x: (-x[1], x[0]))[:3], 1):
            assert got[group, rank].word == word
            assert got[group, rank].tfidf == pytest.approx(weight / norm if norm else 0.0)
    assert got["a", 1].word_tf == "plum"
    assert any(w < 0 for w in python_weights(GROUPED[:4], set())["a"].values())  # the sign is kept


def test_ctfidf_vocabulary(spark):
    df = spark.createDataFrame([(1, "This is a first test"), (2, "another test it was"), (3, "third one here this")], "g int, t string")
    words = op.ctfidf(df, "g", "t", 100, None).select("word").distinct().count()
    assert words == 10


@pytest.mark.parametrize("tile", [1, 2, 512])
def test_similarity_like_python(spark, tile):
    df = spark.createDataFrame(GROUPED, "g string, t string")
    weights = python_weights(GROUPED, set(stop_words("english")))
    groups = ["a", "b", "c", "d"]
    got = {(r.group_a, r.group_b): r.similarity for r in op.group_similarity(df, "g", "t", "english", tile).collect()}
    assert set(got) == {(x, y) for x in groups for y in groups}
    for (x, y), value in got.items():
        a, b = weights.get(x, {}), weights.get(y, {})
        norm = math.sqrt(sum(v * v for v in a.values())) * math.sqrt(sum(v * v for v in b.values()))
        want = sum(v * b.get(w, 0) for w, v in a.items()) / norm if norm else 0.0
        assert value == pytest.approx(want, abs=1e-12)


TOOLS = [
    ("cutting", "saws", "saw(?:s|n)?", False), ("cutting", "saws", "blade", True), ("cutting", "knives", "kni(?:fe|ves)", False),
    ("joining", "glue", "glue[ds]?", False), ("joining", "nails", "Nail", True), ("joining", "nails", "screws?", False),
]
WORKSHOP = "Saw the blade, saws and Blade: a knife, two knives; glued and Glue. Nail, nail, screws SCREW sawn"


@pytest.mark.parametrize("levels", [["kind", "tool"], ["tool", "kind"]])
def test_match_counter_like_a_loop(spark, levels):
    dictionary = spark.createDataFrame(TOOLS, "kind string, tool string, regex string, cs boolean")
    df = spark.createDataFrame([(WORKSHOP,)], "t string")
    row = op.match_counter(df, "t", dictionary, levels, "regex", "cs").first().asDict()
    row.pop("t")
    want = dict.fromkeys([n for kind, tool, _, _ in TOOLS for n in (kind, tool)], 0)
    for kind, tool, regex, exact in TOOLS:
        found = len(re.findall(regex, WORKSHOP, 0 if exact else re.IGNORECASE))
        want[kind] += found
        want[tool] += found
    assert row == want


def test_match_counter_rules(spark):
    df = spark.createDataFrame([("aAb",)], "t string")
    with pytest.raises(ValueError, match="undefined"):
        op.match_counter(df, "t", [{"l": None, "r": "a"}], ["l"], "r")
    with pytest.raises(ValueError, match="higher level"):
        node_leaves([("tree", "oak"), ("oak", "leaf"), ("wood", "oak")])
    assert node_leaves([("fruit", "fruit", "plum"), ("fruit", "stone", "cherry")]) == {
        "fruit": [("fruit", "fruit", "plum"), ("fruit", "stone", "cherry")],
        "stone": [("fruit", "stone", "cherry")], "cherry": [("fruit", "stone", "cherry")]}
    row = op.match_counter(df, "t", [{"l": "n", "r": "a"}, {"l": "n", "r": "b"}], ["l"], "r").first()
    assert row.n == 3
    quotes = spark.createDataFrame([("say \"x\" or 'y' \\\\ z",)], "t string")
    rules = [{"l": "one", "r": "'"}, {"l": "both", "r": "'|\""}, {"l": "slash", "r": r"\\"}, {"l": "word", "r": r"\bz\b"}]
    row = op.match_counter(quotes, "t", rules, ["l"], "r").first()
    assert (row.one, row.both, row.slash, row.word) == (2, 4, 2, 1)
    many = [{"l": f"n{i}", "r": f"(?:a|x{i})"} for i in range(250)]
    assert op.match_counter(df, "t", many, ["l"], "r").first().n249 == 2


def test_sentiment(spark):
    df = spark.createDataFrame([(1, "Good day. Bad bad good luck! Nothing."), (2, ""), (3, None)], "id int, t string")
    got = {r.id: r.sentiment_score for r in op.sentiment(df, "t").collect()}
    assert got == {1: pytest.approx(1.0), 2: 0.0, 3: 0.0}
    assert [r.id for r in op.sentiment(df, "t", drop_empty=True).collect()] == [1]


def test_sentiment_model(spark):
    def load():
        def predict(sentences):
            if any("boom" in s for s in sentences):
                raise ValueError
            return [("negative" if "no" in s else "NEUTRAL" if "so" in s else "LABEL_2", 0.5) for s in sentences]

        return predict

    df = spark.createDataFrame(
        [(1, "Yes. It is no fun. So so"), (2, "no. boom now. Yes"), (3, None)], "id int, t string"
    ).coalesce(1)
    got = {r.id: r.sentiment_score for r in op.sentiment(df, "t", op.model_scorer(load)).collect()}
    assert got == {1: 0.0, 2: 0.0, 3: 0.0}


def test_map_text_where(spark):
    df = spark.createDataFrame([(1, "de", "die Katze und das"), (2, "en", "die hard"), (3, None, "die")], "id int, l string, t string")
    words = op.glossary({"die": "the", "und": "and", "the": "wrong"})
    got = [tuple(r) for r in op.map_text_where(df, "t", words, "l = 'de'").orderBy("id").collect()]
    assert got == [(1, "de", "the Katze and das"), (2, "en", "die hard"), (3, None, "die")]

    def load():
        def convert(text):
            if "hard" in text:
                raise ValueError
            return text.upper()

        return convert

    model = op.map_text_where(df, "t", op.text_model(load), new_col="u").orderBy("id").collect()
    assert [r.u for r in model] == ["DIE KATZE UND DAS", "die hard", "DIE"]


def test_cleanup(spark):
    rows = [
        (1, "23. Juni 2012", "Das ist nicht die Welt und der ftp Server"),
        (2, "nan", "This is not the world and http server"),
        (3, None, "xyzzy"),
        (4, "Sat Jun 23 2012 about noonish", None),
        (5, "a string of 26 characters!", "Le monde est à nous et les autres"),
    ]
    df = spark.createDataFrame(rows, "id int, date string, text string")
    got = {r.id: r for r in op.standard_cleanup(df).collect()}
    assert [got[i].language_id for i in (1, 2, 3, 4, 5)] == ["de", "en", "de", "de", "fr"]
    assert [got[i].date_standardized for i in (1, 2, 3, 5)] == [
        "2012-06-23 00:00:00", "nan", "n.a.", "a string of 26 characters!"]
    assert got[1].text_preprocessed == "welt server" and got[2].text_preprocessed == "world server"
    assert got[4].text_preprocessed == "" and got[4].text == ""
    status = op.standardize_dates(df, "date", status="s").orderBy("id").collect()
    assert [r.s for r in status] == ["parsed", "nan", "missing", "unparsed", "kept"]


def test_preprocess_with_annotator(spark):
    annotate = lambda text: F.transform(
        F.split(text, " "),
        lambda t: F.struct(t.alias("token"), F.concat(t, F.lit("X")).alias("lemma"),
                           F.when(t.rlike("^[A-Z]"), "NOUN").otherwise("VERB").alias("pos")),
    )
    df = spark.createDataFrame([("The Cat runs \nHome Www", "en"), ("Der Hund", "xx")], "t string, l string")
    got = op.preprocess_text(df, "t", "l", annotate=annotate).collect()
    assert [r.text_preprocessed for r in got] == ["catx", "hundx"]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id long, g string, t string, date string")
    assert op.ctfidf(none, "g", "t").count() == 0
    assert op.group_similarity(none, "g", "t").count() == 0
    assert op.kwic(none, "t", ["a"], "id").count() == 0
    assert op.with_row_id(none, "id").count() == 0
    assert op.group_concat(none, "g", "t", "id").count() == 0
    assert op.standard_cleanup(none, "t").count() == 0
