"""Keyword in context: one row per regex match with its neighbouring sentences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.functions import patterns as P, sentences as S
from corpusloom.functions.text import combine_text, let

KEYWORD_SLOT = "<KEYWORD>"


def kwic(
    df: DataFrame,
    cols: str | Sequence[str],
    keywords: Sequence[str],
    id_col: str,
    no_overlap: bool = False,
    keep_data: bool | Sequence[str] = True,
    master_expr: str | None = None,
) -> DataFrame:
    """Matches of each keyword, any case, with the sentence before, around and after the match start.

    Output: ``context, keyword, parent_id`` and, with ``keep_data``, the source columns and
    ``sent_ranges``; a list of names keeps just those. Everything happens inside the row: no shuffle,
    no join.
    """
    names = [cols] if isinstance(cols, str) else list(cols)
    if not keywords:
        raise ValueError("at least one keyword is needed")
    P.validate(keywords)
    patterns = [master_expr.replace(KEYWORD_SLOT, k) if master_expr else k for k in keywords]
    P.validate(patterns)

    base = df
    if len(names) > 1:
        base = df.withColumn("combined_text", combine_text(names, ". "))
        names = ["combined_text"]
    text = F.col(names[0])

    def hits(sents: Column) -> Column:
        """``array<struct<k,i>>``: keyword number and sentence number of each match."""
        found = _sentence_numbers(text, sents, patterns)
        if no_overlap:
            return _without_overlap(found)
        return F.flatten(
            F.transform(found, lambda nums, k: F.transform(nums, lambda i: F.struct(k.alias("k"), i.alias("i"))))
        )

    labels = F.array(*[F.lit(k) for k in keywords])

    def contexts(sents: Column) -> Column:
        def context(hit: Column) -> Column:
            i = hit["i"]
            before = F.when(i > 0, F.get(sents, i - 1)).otherwise("")
            after = F.coalesce(F.get(sents, i + 1), F.lit(""))
            return F.struct(
                F.concat_ws(" ", before, F.get(sents, i), after).alias("context"),
                F.get(labels, hit["k"]).alias("keyword"),
            )

        return F.transform(hits(sents), context)

    # Source columns are repeated for every match, so a caller of huge texts names only what is needed.
    if keep_data is True or keep_data is False:
        source = [c for c in base.columns if c != id_col] if keep_data else []
    else:
        source = list(keep_data)
    if keep_data is True:
        base = base.withColumn("sent_ranges", S.sentence_spans(text))
        source.append("sent_ranges")
    rows = base.select(
        F.col(id_col).alias("parent_id"), *source, F.explode(let(S.sentences(text), contexts)).alias("__hit")
    )
    return rows.select(*source, "__hit.context", "__hit.keyword", "parent_id")


def _sentence_numbers(text: Column, sents: Column, patterns: Sequence[str]) -> Column:
    """``array<array<int>>``: per pattern the sentence number of each match, in text order."""
    if all(P.stays_within_words(p) for p in patterns):
        # No match can reach over a boundary, so sentences can be searched one by one.
        def per_sentence(p: str) -> Column:
            return F.flatten(F.transform(sents, lambda s, i: F.array_repeat(i, P.match_count(s, p))))

        return F.array(*[per_sentence(p) for p in patterns])

    last = F.size(sents) - 1
    found = let(S.sentence_starts(text), lambda starts: F.array(*[S.sentence_of_matches(text, P.java_regex(p), starts, last) for p in patterns]))
    return F.when(F.size(sents) > 0, found)


def _without_overlap(found: Column) -> Column:
    """Greedy choice in (keyword, position) order: kept sentence numbers of one text differ by 3 or more.

    A sentence turned down once stays turned down, so only distinct numbers are looked at; what earlier
    keywords block is removed by a hash-based ``array_except``, and within one keyword numbers ascend,
    so comparing with the last kept one is enough.
    """
    empty_hits = F.array().cast("array<struct<k:int,i:int>>")
    empty = F.array().cast("array<int>")

    def spaced(numbers: Column) -> Column:
        return F.aggregate(
            numbers,
            empty,
            lambda kept, i: F.when(
                (F.size(kept) == 0) | (i - F.coalesce(F.get(kept, F.size(kept) - 1), F.lit(0)) >= 3),
                F.array_append(kept, i),
            ).otherwise(kept),
        )

    def add_keyword(kept: Column, nums: Column, k: Column) -> Column:
        blocked = F.flatten(F.transform(kept, lambda h: F.sequence(h["i"] - 2, h["i"] + 2)))
        free = F.array_except(nums, blocked)
        chosen = F.transform(spaced(free), lambda i: F.struct(k.cast("int").alias("k"), i.cast("int").alias("i")))
        return F.concat(kept, chosen)

    numbered = F.transform(found, lambda nums, k: F.struct(nums.alias("nums"), k.alias("k")))
    return F.aggregate(numbered, empty_hits, lambda kept, f: add_keyword(kept, f["nums"], f["k"]))
