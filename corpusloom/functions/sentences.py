"""Rule-based sentence boundaries as Column expressions.

The rules are those an untrained Punkt splitter (Kiss & Strunk, 2006) ends up with: a sentence ends at
``.``, ``!`` or ``?`` (plus closing quotes and brackets) before white space, except after an ellipsis,
after a single-letter initial followed by a letter, and after a number followed by a lower-case letter.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from corpusloom.functions.text import let, running_total

# A Unicode noncharacter: reserved for internal use, so it is free to act as the cut mark.
MARK = "\ufdd0"
HIT = "\ufdd1"

BLANKS = r"[ \t\r\n]"


#: End punctuation (group 1) and the blanks after it (group 2) wherever a sentence ends.
_BOUNDARY = (
    r"""([.!?]["')\]}]*)(?<!\.\.)"""
    rf"""(?!(?<=(?<![^ \t\r\n])\p{{L}}\.){BLANKS}+\p{{L}})"""
    rf"""({BLANKS}+)"""
)
#: A cut after a number before a lower-case letter, taken back once the cuts are marked.
#: The number is read forwards from the start of its token, so it may have any length.
_ORDINAL = rf"((?<![^ \t\r\n{MARK}])[0-9,]+\.){MARK}({BLANKS}+){MARK}(?=\p{{Ll}})"


def without_marks(text: Column) -> Column:
    """Free the cut marks: a stray one becomes U+FFFD, which keeps every offset."""
    for mark in (MARK, HIT):
        text = F.replace(text, F.lit(mark), F.lit("\ufffd"))
    return text


def _pieces(text: Column) -> Column:
    """Alternating sentences and the blanks between them; joined they give the text back."""
    marked = F.regexp_replace(text, _BOUNDARY, f"$1{MARK}$2{MARK}")
    return F.split(F.regexp_replace(marked, _ORDINAL, "$1$2"), MARK)


def _trim_last(piece: Column) -> Column:
    return F.regexp_replace(piece, rf"{BLANKS}+\z", "")


def sentences(text: Column) -> Column:
    """``array<string>`` of sentences; blank text gives an empty array, null gives null."""

    def texts(pieces: Column) -> Column:
        kept = F.transform(
            pieces,
            lambda s, i: F.when(i % 2 == 1, "").when(i == F.size(pieces) - 1, _trim_last(s)).otherwise(s),
        )
        return F.filter(kept, lambda s: s != "")

    return let(_pieces(without_marks(text)), texts)


def sentence_spans(text: Column) -> Column:
    """``array<struct<start:int,end:int>>`` of character offsets, end exclusive."""

    def spans(pieces: Column, offsets: Column) -> Column:
        def span(s: Column, i: Column) -> Column:
            length = F.when(i % 2 == 1, 0).when(i == F.size(pieces) - 1, F.length(_trim_last(s))).otherwise(F.length(s))
            start = F.get(offsets, i)
            return F.struct(start.cast("int").alias("start"), (start + length).cast("int").alias("end"))

        return F.filter(F.transform(pieces, span), lambda s: s["end"] > s["start"])

    return let(
        _pieces(without_marks(text)),
        lambda pieces: let(running_total(F.transform(pieces, F.length)), lambda offsets: spans(pieces, offsets)),
    )


def sentence_starts(text: Column) -> Column:
    """``array<int>``: where each sentence begins, blank ones included."""
    starts = let(_pieces(without_marks(text)), lambda pieces: running_total(F.transform(pieces, F.length)))
    return F.filter(starts, lambda _, i: i % 2 == 0)


def sentence_of_matches(text: Column, java_regex: str, starts: Column, last: Column) -> Column:
    """Sentence number of each match, ``array<int>`` in text order, by where the match starts.

    Matches are found in the whole text and marked, so the lengths between the marks give their places. Sorted in with
    the sentences' ``starts``, the j-th match has so many starts before it as its place in the order exceeds j. ``last`` is the
    number of the last sentence: a match in trailing blanks belongs to it, one in blanks between sentences to the
    sentence before.
    """
    between = F.split(F.regexp_replace(without_marks(text), java_regex, f"{HIT}$0"), HIT)

    def numbers(offsets: Column) -> Column:
        places = F.slice(offsets, F.lit(2), F.size(offsets))
        at = lambda kind: lambda x: F.struct(x.alias("at"), F.lit(kind).alias("kind"))
        both = F.array_sort(F.concat(F.transform(starts, at(0)), F.transform(places, at(1))))
        ranks = F.filter(F.transform(both, lambda x, i: F.when(x["kind"] == 1, i)), F.isnotnull)
        return F.transform(ranks, lambda rank, j: F.greatest(F.lit(0), F.least(rank - j - 1, last)))

    return let(running_total(F.transform(between, F.length)), numbers)
