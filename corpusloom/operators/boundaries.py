"""Sentence boundaries learned from the corpus without labels (Kiss & Strunk, 2006).

Tokens are runs between blanks, lower-cased, without quotes and brackets around them. An abbreviation is a type that
nearly always stands before a period, by a log-likelihood ratio that short types and types with inner periods raise and
occurrences without a period lower. A sentence starter stands behind sentence ends more often than chance, and the second
word of a collocation behind a certain word and period. All of it comes from counts of distinct tokens and of distinct
pairs around a sentence end, combined before they are shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.functions import sentences as S
from corpusloom.functions.text import let, running_total
from corpusloom.runtime import written

ABBREVIATION, STARTER, COLLOCATION = 0.3, 30.0, 7.88
OPENING, CLOSING = r"""^["'(\[{]+""", r"""["')\]},;:]+$"""
NUMBER = "##number##"


def _bare(token: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(token), OPENING, ""), CLOSING, "")


def _type(bare: Column) -> Column:
    """The type of a token that has lost what surrounds it: without end marks, all numbers alike."""
    kept = F.regexp_replace(bare, "[.!?]+$", "")
    return F.when(kept.rlike("^[0-9][0-9.,]*$"), NUMBER).otherwise(kept)


def _counted(df: DataFrame, text: Column) -> DataFrame:
    """``(type, mark, n)``: distinct tokens by type and end mark (a period, another mark, or none)."""
    tokens = df.select(F.explode(F.split(text, f"{S.BLANKS}+")).alias("token")).where("token <> ''").groupBy("token").agg(F.count("*").alias("n"))
    bare = tokens.select(_bare(F.col("token")).alias("bare"), "n")
    mark = F.when(F.col("bare").rlike("[!?]$"), "!").when(F.col("bare").rlike(r"(?<!\.)\.$"), ".").otherwise("")
    return bare.groupBy(_type(F.col("bare")).alias("type"), mark.alias("mark")).agg(F.sum("n").alias("n")).where("type <> ''")


def abbreviation_scores(df: DataFrame, text_col: str) -> DataFrame:
    """``(type, with_period, without_period, score)`` of all types that stand before a period and hold a letter."""
    return _scores(written(_counted(df, F.col(text_col))))


def _sum(df: DataFrame, *values: Column) -> tuple:
    """Totals over all rows as numbers."""
    return tuple(v or 0 for v in df.agg(*[F.sum(v) for v in values]).first())


def _scores(counts: DataFrame) -> DataFrame:
    period = F.when(F.col("mark") == ".", F.col("n")).otherwise(0)
    tokens, periods = _sum(counts, F.col("n"), period)
    types = counts.groupBy("type").agg(F.sum(period).alias("with_period"), F.sum(F.col("n") - period).alias("without_period"))
    types = types.where(F.col("type").rlike(r"\p{L}") & (F.col("with_period") > 0))
    chance = F.lit(periods / tokens if tokens else 1.0)
    with_, without = F.col("with_period"), F.col("without_period")
    # All tokens before a period would make the chance 1; the logarithm of the rest is then never needed.
    ratio = 2 * (with_ * (F.log(F.lit(0.99)) - F.log(chance)) + without * (F.log(F.lit(0.01)) - F.log(F.greatest(1 - chance, F.lit(1e-300)))))
    inner = F.length("type") - F.length(F.replace("type", F.lit("."), F.lit("")))
    letters = F.length("type") - inner
    score = ratio * F.exp(-letters) * (inner + 1) * F.exp(-without * F.log(letters.cast("double")))
    return types.select("type", "with_period", "without_period", score.alias("score"))


def _together(a: Column, b: Column, both: Column, total: Column) -> Column:
    """Log-likelihood ratio of two events that occur a, b and both times together among ``total``; negative if they avoid each other."""

    def likely(k: Column, n: Column, p: Column) -> Column:
        part = lambda count, chance: F.when(count > 0, count * F.log(chance)).otherwise(0.0)
        return part(k, p) + part(n - k, 1 - p)

    rest, other = total - a, b - both
    apart = likely(both, a, b / total) + likely(other, rest, b / total)
    joint = likely(both, a, both / a) + F.when(rest > 0, likely(other, rest, F.try_divide(other, rest))).otherwise(0.0)
    ratio = 2 * (joint - apart)
    return F.when(both * total > a * b, ratio).otherwise(-ratio)


@dataclass
class BoundaryModel:
    """What a corpus says about its sentence ends; words and pairs above their thresholds."""

    abbreviations: list[str]
    starters: list[str]
    collocations: list[str]  # "word next"


def followers(df: DataFrame, text_col: str) -> DataFrame:
    """``(type, mark, next, n)``: what stands behind a token with an end mark."""
    tokens = F.filter(F.split(F.col(text_col), f"{S.BLANKS}+"), lambda t: t != "")
    pair = lambda ts: F.zip_with(F.slice(ts, F.lit(1), F.greatest(F.size(ts) - 1, F.lit(0))), F.slice(ts, F.lit(2), F.size(ts)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    ends = F.filter(let(tokens, pair), lambda p: p["a"].rlike(r"""[.!?]["')\]},;:]*$"""))
    pairs = df.select(F.explode(ends).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n"))
    bare = pairs.select(_bare(F.col("a")).alias("a"), _type(_bare(F.col("b"))).alias("next"), "n")
    mark = F.when(F.col("a").rlike("[!?]$"), "!").when(F.col("a").rlike(r"(?<!\.)\.$"), ".").otherwise("")
    return bare.groupBy(_type(F.col("a")).alias("type"), mark.alias("mark"), "next").agg(F.sum("n").alias("n")).where("mark <> '' AND next <> ''")


def starter_scores(df: DataFrame, text_col: str, abbreviation: float = ABBREVIATION) -> DataFrame:
    """``(type, n, behind, score)``: how often types occur, how often behind a sentence end that is no abbreviation's, and the ratio."""
    counts = written(_counted(df, F.col(text_col)))
    return _starters(counts, written(followers(df, text_col)), _scores(counts).where(F.col("score") >= abbreviation).select("type"))


def _starters(counts: DataFrame, pairs: DataFrame, abbreviations: DataFrame) -> DataFrame:
    ends = written(pairs.join(abbreviations.withColumn("short", F.lit(True)), "type", "left").where("short IS NULL OR mark <> '.'"))
    behind = ends.groupBy(F.col("next").alias("type")).agg(F.sum("n").alias("behind"))
    (tokens,), (breaks,) = _sum(counts, F.col("n")), _sum(ends, F.col("n"))
    types = counts.groupBy("type").agg(F.sum("n").alias("n")).join(behind, "type")
    score = _together(F.lit(float(breaks)), F.col("n"), F.least("behind", "n"), F.lit(float(tokens)))
    return types.where(F.col("type").rlike(r"\p{L}")).select("type", "n", "behind", score.alias("score"))


def learn_boundaries(
    df: DataFrame, text_col: str, abbreviation: float = ABBREVIATION, starter: float = STARTER, collocation: float = COLLOCATION
) -> BoundaryModel:
    """Train on all texts. The words above the thresholds become part of later plans, as stop lists do.

    Null and empty texts hold no tokens; an empty table gives an empty model, with which the plain rules stand.
    """
    counts, pairs = written(_counted(df, F.col(text_col))), written(followers(df, text_col))
    short = written(_scores(counts).where(F.col("score") >= abbreviation).select("type"))
    starts = _starters(counts, pairs, short).where(F.col("score") >= starter).select("type")
    n = counts.groupBy("type").agg(F.sum("n").alias("n"))
    (tokens,) = _sum(counts, F.col("n"))
    periods = pairs.where("mark = '.'").groupBy("type", "next").agg(F.sum("n").alias("both"))
    joined = periods.join(n.withColumnRenamed("n", "a"), "type").join(n.select(F.col("type").alias("next"), F.col("n").alias("b")), "next")
    # Only words that rules or the list above do not take for a sentence's last one: initials, numbers and abbreviations.
    weak = (F.length("type") == 1) | (F.col("type") == NUMBER)
    joined = joined.join(short.withColumn("short", F.lit(True)), "type", "left").where(weak | F.col("short"))
    least = F.least("both", "a", "b")
    strong = joined.where(_together(F.col("a"), F.col("b"), least, F.lit(float(tokens))) >= collocation)
    words = lambda frame, column: sorted(r[0] for r in frame.select(column).collect())
    return BoundaryModel(words(short, "type"), words(starts, "type"), words(strong, F.concat_ws(" ", "type", "next")))


def learned_spans(text: Column, model: BoundaryModel) -> Column:
    """``array<struct<start:int,end:int>>`` as :func:`sentence_spans`, without the cuts that the model takes back.

    A cut behind a period goes if the word before is an abbreviation, unless the word behind is capitalised and a
    sentence starter, or if both words are a collocation.
    """

    def spans(pieces: Column) -> Column:
        return let(running_total(F.transform(pieces, F.length)), lambda offsets: _kept_spans(pieces, offsets, model))

    return let(S._pieces(S.without_marks(text)), spans)


def _kept_spans(pieces: Column, offsets: Column, model: BoundaryModel) -> Column:
    last = F.size(pieces) - 1
    one_of = lambda value, words: value.isin(*words) if words else F.lit(False)

    def taken_back(word: Column, behind: Column) -> Column:
        """Whether the cut behind a period goes, by the type of the word before and the word behind."""
        pair = let(F.concat_ws(" ", word, _type(_bare(behind))), lambda both: one_of(both, model.collocations))
        starts = F.regexp_replace(behind, OPENING, "").rlike(r"^\p{Lu}") & one_of(_type(_bare(behind)), model.starters)
        return pair | (one_of(word, model.abbreviations) & ~starts)

    def stays(i: Column) -> Column:
        """Whether the cut behind piece ``i`` stays."""
        before = F.regexp_extract(F.get(pieces, i), r"((?<![^ \t\r\n])[^ \t\r\n]+)$", 1)
        behind = F.regexp_extract(F.get(pieces, i + 2), r"^([^ \t\r\n]+)", 1)
        word = lambda bare: let(_type(bare), lambda w: taken_back(w, behind))
        return let(_bare(before), lambda bare: ~F.when(bare.rlike(r"(?<!\.)\.$"), word(bare)).otherwise(F.lit(False)))

    # Each cut is judged once; pieces between kept cuts become one span.
    kept = F.filter(F.transform(pieces, lambda _, i: F.when((i % 2 == 0) & (i < last), F.when(stays(i), i))), F.isnotnull)
    return let(kept, lambda cuts: _spans_between(pieces, offsets, cuts))


def _spans_between(pieces: Column, offsets: Column, cuts: Column) -> Column:
    """Spans from piece 0 to the last, cut behind the pieces ``cuts``."""
    last = F.size(pieces) - 1
    begins = F.concat(F.array(F.lit(0)), F.transform(cuts, lambda i: i + 2))
    ends = F.concat(cuts, F.array(last))

    def span(a: Column, b: Column) -> Column:
        length = F.when(b == last, F.length(S._trim_last(F.get(pieces, b)))).otherwise(F.length(F.get(pieces, b)))
        return F.struct(F.get(offsets, a).cast("int").alias("start"), (F.get(offsets, b) + length).cast("int").alias("end"))

    return F.filter(F.zip_with(begins, ends, span), lambda s: s["end"] > s["start"])
