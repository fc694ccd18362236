"""Sentence spans and splitting long texts into runs of sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpusloom.functions import sentences as S
from corpusloom.functions.text import let


def with_sentence_spans(df: DataFrame, col: str, out: str = "sent_ranges") -> DataFrame:
    """Add the character ranges of the sentences of ``col``."""
    return df.withColumn(out, S.sentence_spans(F.col(col)))


def split_sentences(df: DataFrame, col: str, n: int = 8, new_col: str | None = None) -> DataFrame:
    """One row per run of ``n`` sentences, joined by a blank; rows without a sentence vanish.

    The chunk replaces ``col`` unless ``new_col`` is given. Narrow: each row is split on its own.
    """
    out = new_col or col

    def chunks(sents):
        last = F.ceil(F.size(sents) / n).cast("int") - 1
        runs = F.transform(
            F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
            lambda i: F.array_join(F.slice(sents, i * n + 1, n), " "),
        )
        return F.when(F.size(sents) > 0, runs)

    kept = [c for c in df.columns if c != out]
    return df.select(*kept, F.explode(let(S.sentences(F.col(col)), chunks)).alias(out))
