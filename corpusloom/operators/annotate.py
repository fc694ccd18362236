"""Sentence scoring, conditional text mapping, and the hooks for user models."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.functions.sentences import sentences
from corpusloom.functions.text import WORD_CLASS, let, tokens

# Label names that sentiment models give.
NEGATIVE_LABELS = ("LABEL_0", "NEGATIVE")
NEUTRAL_LABELS = ("LABEL_1", "NEUTRAL")
SCORES = "array<struct<label:string,score:double>>"

# Small default word lists for the built-in scorer; pass your own for real work.
POSITIVE_WORDS = (
    "beautiful", "best", "better", "excellent", "fun", "good", "great", "happy", "love", "luck", "nice", "perfect",
    "freude", "gut", "glück", "schön", "super", "toll", "beau", "bien", "bon", "bonne", "heureux",
    "bueno", "feliz", "mejor",
)
NEGATIVE_WORDS = (
    "awful", "bad", "hate", "horrible", "poor", "sad", "terrible", "ugly", "worse", "worst", "worthless", "wrong",
    "furchtbar", "hässlich", "schlecht", "schlimm", "traurig", "laid", "mal", "mauvais", "pire", "triste",
    "feo", "malo", "peor",
)

Scorer = Callable[[Column], Column]


def sentiment(
    df: DataFrame, col: str, scorer: Scorer | None = None, out: str = "sentiment_score", drop_empty: bool = False
) -> DataFrame:
    """Mean sentence score per text: negative labels count minus, neutral ones not at all.

    A text with no scored sentence gets 0.0. ``scorer`` maps ``array<string>`` to ``array<struct<label,
    score>>``, one per sentence. ``drop_empty`` leaves out texts without a sentence.
    """
    score = scorer or lexicon_scorer()

    def signed(s: Column) -> Column:
        label = F.upper(s["label"])
        return (
            F.when(label.isin(*NEGATIVE_LABELS), -s["score"]).when(label.isin(*NEUTRAL_LABELS), None).otherwise(s["score"])
        )

    def mean(values: Column) -> Column:
        total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)
        return F.coalesce(F.try_divide(total, F.size(values).cast("double")), F.lit(0.0))

    scored = df.withColumn("__sentences", sentences(F.col(col)))
    if drop_empty:
        scored = scored.where(F.size("__sentences") > 0)
    scored = scored.withColumn("__scores", score(F.col("__sentences")))
    kept = F.filter(F.transform("__scores", signed), lambda v: v.isNotNull())
    # The second use of the sentences keeps them a column of their own: a Python scorer takes a plain
    # column, and sentences folded into its argument would not reach it.
    value = F.when(F.size("__sentences") > 0, let(kept, mean)).otherwise(F.lit(0.0))
    return scored.withColumn(out, value).drop("__sentences", "__scores")


def lexicon_scorer(
    positive: Sequence[str] = POSITIVE_WORDS, negative: Sequence[str] = NEGATIVE_WORDS
) -> Scorer:
    """Score by counted words, ``|p - n| / (p + n)``; runs inside the JVM."""

    def score(sentence_tokens: Column) -> Column:
        def hits(words: Sequence[str]) -> Column:
            return F.size(F.filter(sentence_tokens, lambda t: t.isin(*words)))

        return let(
            F.struct(hits(positive).alias("p"), hits(negative).alias("n")),
            lambda h: F.struct(
                F.when(h["p"] > h["n"], "POSITIVE").when(h["p"] < h["n"], "NEGATIVE").otherwise("NEUTRAL").alias("label"),
                F.coalesce(F.try_divide(F.abs(h["p"] - h["n"]), (h["p"] + h["n"]).cast("double")), F.lit(0.0)).alias(
                    "score"
                ),
            ),
        )

    return lambda sents: F.transform(sents, lambda s: let(tokens(s), score))


def model_scorer(load: Callable[[], Callable[[list[str]], list[tuple[str, float]]]]) -> Scorer:
    """Wrap a user model; ``load`` runs once per Python worker and returns a batch predictor.

    Sentences the model fails on score ``("LABEL_0", 0.0)``.
    """

    @F.pandas_udf(SCORES)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        predict = load()

        def one(text: str) -> tuple[str, float]:
            try:
                return predict([text])[0]
            except Exception:
                return "LABEL_0", 0.0

        for batch in batches:
            flat = [s for sents in batch if sents is not None for s in sents]
            try:
                scores = list(predict(flat)) if flat else []
            except Exception:
                scores = [one(s) for s in flat]
            given = iter(scores)
            yield pd.Series(
                [
                    [dict(zip(("label", "score"), next(given))) for _ in (sents if sents is not None else ())]
                    for sents in batch
                ]
            )

    return lambda sents: run(sents)


def map_text_where(
    df: DataFrame,
    col: str,
    fn: Callable[[Column], Column],
    where: str | Column | None = None,
    new_col: str | None = None,
) -> DataFrame:
    """Apply a text function where a condition holds, copy the text elsewhere.

    ``fn`` gets null for the rows that are only copied, so a model never sees them; a null result keeps
    the original text.
    """
    text = F.col(col)
    chosen = F.lit(True) if where is None else (F.expr(where) if isinstance(where, str) else where)
    mapped = F.when(chosen, F.coalesce(fn(F.when(chosen, text)), text)).otherwise(text)
    return df.withColumn(new_col or col, mapped)


def text_model(load: Callable[[], Callable[[str], str]]) -> Callable[[Column], Column]:
    """Wrap a user text-to-text model for ``map_text_where``; a failure leaves the text as it was."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        convert = load()

        def one(text: str | None) -> str | None:
            if text is None:
                return None
            try:
                return convert(text)
            except Exception:
                return None

        for batch in batches:
            yield batch.map(one, na_action="ignore").astype(object)

    return lambda text: run(text)


def glossary(words: Mapping[str, str]) -> Callable[[Column], Column]:
    """Word-for-word substitution in one pass over the text, for ``map_text_where``."""
    table = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
    pieces = f"{WORD_CLASS}+|[^\\p{{L}}\\p{{N}}_]+"

    def convert(text: Column) -> Column:
        return F.array_join(
            F.transform(
                F.regexp_extract_all(text, F.lit(pieces), F.lit(0)),
                lambda w: F.when(w.isin(*words), F.try_element_at(table, w)).otherwise(w),
            ),
            "",
        )

    return convert
