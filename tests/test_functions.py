"""Column functions against plain Python."""

import json
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import patterns as P
from corpusloom.functions import sentences as S
from corpusloom.functions.dates import parse_date
from corpusloom.functions.labels import parse_labels
from corpusloom.functions.text import combine_text, normalize_whitespace, running_total, tokens
from corpusloom.functions.vectors import combine_features, stringify, unstringify

TEXTS = [
    "Hello there. How are you?  Fine!",
    '  Leading blanks. A. Smith said: "Go!" Then he left.   ',
    "Wait... what? On the 12. march it rained. On the 12. March it snowed.",
    "One.\nTwo.\r\n\r\nThree",
    "no end",
    "J. R. R. Tolkien wrote. a b. c",
    "(Really?) Yes.) No.",
    "",
    "   ",
    None,
]


def python_sentences(text):
    """The same rules, decided one candidate at a time."""
    cuts = []
    for m in re.finditer(r"""[.!?]["')\]}]*(?=[ \t\r\n])""", text):
        end = m.end()
        word = re.split(r"[ \t\r\n]", text[:end])[-1]
        after = text[end:].lstrip(" \t\r\n")[:1]
        if text[:end].endswith(".."):
            continue
        if re.fullmatch(r"[^\W\d_]\.", word) and after.isalpha():
            continue
        if re.fullmatch(r"[0-9,]+\.", word) and after.islower():
            continue
        cuts.append(end)
    spans, begin = [], 0
    for cut in [*cuts, len(text.rstrip(" \t\r\n"))]:
        if cut > begin and text[begin:cut].strip(" \t\r\n"):
            spans.append((begin, cut))
        begin = cut + len(text[cut:]) - len(text[cut:].lstrip(" \t\r\n"))
    return spans


def test_sentences_and_spans(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    rows = df.select("t", S.sentences(F.col("t")).alias("s"), S.sentence_spans(F.col("t")).alias("sp")).collect()
    for row in rows:
        if row.t is None:
            assert row.s is None and row.sp is None
            continue
        spans = [(x.start, x.end) for x in row.sp]
        assert spans == python_sentences(row.t), row.t
        assert row.s == [row.t[a:b] for a, b in spans]


def test_stray_marks_keep_offsets(spark):
    text = f"A{S.MARK}b c. D{S.HIT} e."
    row = spark.createDataFrame([(text,)], "t string").select(S.sentence_spans(F.col("t")).alias("sp")).first()
    assert [(x.start, x.end) for x in row.sp] == python_sentences(text)


def test_running_total_over_many_chunks(spark):
    row = spark.range(1).select(
        running_total(F.transform(F.sequence(F.lit(1), F.lit(1500)), lambda x: x.cast("int"))).alias("r"),
        running_total(F.array().cast("array<int>")).alias("e"),
    ).first()
    expected, total = [], 0
    for x in range(1, 1501):
        expected.append(total)
        total += x
    assert row.r == expected and row.e == []


def test_tokens_match_python(spark):
    text = "Größe_2 ist 10,5 m; l'été — x Ärger"
    got = spark.createDataFrame([(text,)], "t string").select(tokens(F.col("t")).alias("x")).first().x
    assert got == re.findall(r"\b\w\w+\b", text.lower())


def test_normalize_whitespace(spark):
    df = spark.createDataFrame([("a \n\t b c",)], "t string")
    assert df.select(normalize_whitespace(F.col("t")).alias("x")).first().x == "a b c"


def test_combine_text(spark):
    df = spark.createDataFrame([("red", "kite", "9 m", None)], "A string, B string, C string, D int")
    row = df.select(
        combine_text(["A", "B", "C"]).alias("x"),
        combine_text(["A", "B", "C"], ". ").alias("y"),
        combine_text(["A", "D"], " ").alias("n"),
        combine_text(["A", "D"], " ", skip_nulls=True).alias("s"),
    ).first()
    assert tuple(row) == ("redkite9 m", "red. kite. 9 m", "red None", "red")


def test_patterns(spark):
    with pytest.raises(ValueError, match="not a regular expression"):
        P.validate(["ok", "("])
    df = spark.createDataFrame([("für FÜR füße abc",)], "t string")
    count = lambda p, case=False: df.select(P.match_count(F.col("t"), p, case).alias("n")).first().n
    assert count("für") == 2 and count("für", True) == 1
    assert count(r"\bf\w+") == 3
    assert count(r"(?P<a>f)ü(?P=a)?") == 3
    assert P.stays_within_words("les?") and P.stays_within_words(r"\bfun\w+")
    assert not P.stays_within_words("a.b") and not P.stays_within_words("x*") and not P.stays_within_words(r"a\s")


@pytest.mark.parametrize(
    "text,expected",
    [
        ("23.06.2012", "2012-06-23 00:00:00"),
        ("1.2.2012 14:30", "2012-02-01 14:30:00"),
        ("23. Juni 2012", "2012-06-23 00:00:00"),
        ("Samstag, 23. Juni 2012, 14:30 Uhr", "2012-06-23 14:30:00"),
        ("3. März 2020 um 08:15 Uhr", "2020-03-03 08:15:00"),
        ("2012-06-23", "2012-06-23 00:00:00"),
        ("2012-06-23T10:11:12", "2012-06-23 10:11:12"),
        ("June 23, 2012", "2012-06-23 00:00:00"),
        ("23 June 2012", "2012-06-23 00:00:00"),
        ("03/04/2012", "2012-04-03 00:00:00"),
        ("06/23/2012", "2012-06-23 00:00:00"),
        ("31.02.2012", None),
        ("some day", None),
        (None, None),
    ],
)
def test_parse_date(spark, text, expected):
    df = spark.createDataFrame([(text,)], "d string")
    assert df.select(parse_date(F.col("d")).cast("string").alias("x")).first().x == expected


def test_labels(spark):
    df = spark.createDataFrame([("A; b,C",), (None,)], "l string")
    rows = df.select(parse_labels(F.col("l"), True).alias("m"), parse_labels(F.col("l")).alias("s")).collect()
    assert rows[0].m == ["a", "b", "c"] and rows[0].s == ["a"]
    assert rows[1].m is None


def test_vectors(spark):
    given = [([0.25 * i, -1.0 / (i + 1), 3e10 * i], i - 2) for i in range(5)]
    schema = T.StructType([T.StructField("x", T.ArrayType(T.DoubleType())), T.StructField("y", T.IntegerType())])
    df = spark.createDataFrame(given, schema).coalesce(1)
    joined = df.select(combine_features(df, ["x", "y"]).alias("a"), combine_features(df, ["y", "x", "x"]).alias("b")).collect()
    assert [r.a for r in joined] == [[*x, y] for x, y in given]
    assert [r.b for r in joined] == [[y, *x, *x] for x, y in given]
    back = df.select(unstringify(stringify(F.col("x"))).alias("x")).collect()
    assert [r.x for r in back] == [x for x, _ in given]
    texts = ["[]", "[7]", "[ -1.5e3 ,2 , 0.125]"]
    parsed = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(unstringify(F.col("t")).alias("v"))
    assert [r.v for r in parsed.collect()] == [json.loads(t) for t in texts]
