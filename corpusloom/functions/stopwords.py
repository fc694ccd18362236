"""Stop-word lists that ship with Spark ML, addressed by language name or ISO 639-1 code."""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, functions as F

ISO_NAMES = {
    "da": "danish", "de": "german", "en": "english", "es": "spanish", "fi": "finnish", "fr": "french",
    "hu": "hungarian", "it": "italian", "nl": "dutch", "no": "norwegian", "pt": "portuguese",
    "ru": "russian", "sv": "swedish", "tr": "turkish",
}


@lru_cache(maxsize=None)
def stop_words(language: str | None) -> tuple[str, ...]:
    """Lower-cased stop words; ``None`` means no list. Needs a running session."""
    if language is None:
        return ()
    name = ISO_NAMES.get(language, language)
    return tuple(sorted({w.lower() for w in StopWordsRemover.loadDefaultStopWords(name)}))


def _in(words: Iterable[str]) -> str:
    quoted = ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in words)
    return f"IN ({quoted})"


# The lists go in as SQL text: one parse instead of one call per word, and the optimizer turns it into a
# hash set either way. ``column`` names a column of the table.


def is_word_of(column: str, words: Iterable[str]) -> Column:
    return F.expr(f"`{column}` {_in(words)}")


def count_words(column: str, words: Iterable[str]) -> Column:
    """How many elements of an ``array<string>`` column are in the list."""
    return F.expr(f"size(filter(`{column}`, w -> w {_in(words)}))")


def without_words(column: str, words: Iterable[str], item: str = "w") -> Column:
    """The array without the elements whose text (``item``, an expression of ``w``) is in the list."""
    return F.expr(f"filter(`{column}`, w -> NOT {item} {_in(words)})")
