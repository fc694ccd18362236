"""Python's regular expressions keep their meaning in the JVM."""

import re

import pytest

from corpusloom.functions.patterns import match_count, validate
from corpusloom.functions.sentences import sentences
from corpusloom.operators.cluster import density_cluster
from corpusloom.operators.matchcount import match_counter
from corpusloom.operators.relational import append_column

TEXT = "a&&b x{ x{} {3} aaa aaaa [x] [[ ] ^ ] - & b_1 ab12 Abc ABC é É ß\nline two.\tend\x0b \x00 (x) a|b x, y; $5 ~ # \\ z"
PATTERNS = [
    "a", "[a&&b]", "[&&]", "x{", "x{}", "a{3}", "a{2,}", "a{,2}b", "a{,}b", "[[]", "[]]", "[^]]", "[a[b]", "[[ab]x]", "[^[]x",
    r"[\[\]]", r"[\]&]", "[a-c]+", "[-a]", r"[\w-]+", "[&-z]", "(?P<one>a)(?P=one)", "(?P<a_b>x).?(?P=a_b)", r"(a)\1", "(?:ab)+", "(?i)abc",
    "(?-i:abc)", "(?i:ABC)", "(?s)line.*end", "(?m)^line", r"z\Z", r"\Aa", "$", "z$", r"\bab", r"\d+", r"\w+", r"\s", r"\v", r"\0", r"\x41",
    r"é", r"\U00000041", "(?#note)ab", "a(?=a)", "(?<=a)a", "(?<!a)a", "a*?b", "a++", "(?>a+)b", "x{ ", "b_", r"\$5", "[$#~]", "é", "[é-ü]", "#", " # ",
]


def test_same_counts(spark):
    df = spark.createDataFrame([(TEXT,)], "t string")
    validate(PATTERNS)
    row = df.select([match_count(df.t, p).alias(str(i)) for i, p in enumerate(PATTERNS)]).first()
    expected = [sum(1 for _ in re.finditer(p, TEXT, re.IGNORECASE)) for p in PATTERNS]
    assert {p: n for p, n in zip(PATTERNS, row)} == dict(zip(PATTERNS, expected))


@pytest.mark.parametrize("pattern", ["(", "(a)?(?(1)b|c)", "(?x)a b", "(?a)é"])
def test_refused_by_name(spark, pattern):
    with pytest.raises(ValueError, match=re.escape(pattern)):
        validate([pattern])


def test_long_ordinal(spark):
    text = "See 1234567890123456789012345678901234567890. next one. Then 12. Dez. 3. on"
    df = spark.createDataFrame([(text,)], "t string")
    row = df.select(sentences(df.t)).first()
    assert row[0] == ["See 1234567890123456789012345678901234567890. next one.", "Then 12.", "Dez.", "3. on"]


def test_large_dictionary(spark):
    words = [{"node": f"n{i % 3}", "regex": f"w{i}x"} for i in range(12_000)]
    df = spark.createDataFrame([("w1x w2x w4x w11999x",)], "t string")
    from corpusloom.operators import matchcount

    assert len(matchcount._dictionary_rows(words, ["node"], "regex", None)) == 12_000
    row = match_counter(df, "t", words[:60], ["node"], "regex").first()
    assert (row.n0, row.n1, row.n2) == (0, 2, 1)


@pytest.mark.parametrize("kind", ["int", "string", "bigint"])
def test_cluster_id_types(spark, kind):
    rows = [(i, [float(i % 2) * 50 + (i // 2) * 0.01, 0.0]) for i in range(60)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>").selectExpr(f"CAST(id AS {kind}) AS id", "v")
    found = density_cluster(df, "v", 0.5, "id")
    assert found.columns == ["id", "v", "hdbscan"]
    assert sorted(r["count"] for r in found.groupBy("hdbscan").count().collect()) == [30, 30]


def test_append_column_notices_target_duplicates(spark):
    source = spark.createDataFrame([(1, "a"), (2, "b")], "k int, c string")
    target = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    with pytest.raises(Exception, match="no partner"):
        append_column(source, target, "c", on="k").collect()
