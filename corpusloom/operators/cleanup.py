"""Clean-up of a raw corpus: dates, language, stop words, and the three in a row."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.functions.dates import parse_date
from corpusloom.functions.stopwords import count_words, stop_words, without_words
from corpusloom.functions.text import text_or_empty, tokens
from corpusloom.operators.aggregate import group_count

DEFAULT_LANGUAGE = "de"
LANGUAGES = ("de", "en", "fr", "it", "es")
# Languages with a stop-word list in the preprocessing step, words always dropped there, and the parts of
# speech that an annotated text keeps.
PREPROCESS_LANGUAGES = ("en", "de", "fr", "it")
FILTER_LIST = ("ftp", "http", "mailto", "www", "schweiz", "-")
KEEP_POS = ("NOUN", "PROPN")

Annotator = Callable[[Column], Column]


def standardize_dates(df: DataFrame, col: str = "date", out: str = "date_standardized", status: str | None = None) -> DataFrame:
    """Dates as ``yyyy-MM-dd HH:mm:ss`` text; what cannot be read stays as it is.

    Empty becomes ``n.a.``, ``nan`` stays. ``status`` names an extra column saying which case applied
    (``parsed``, ``kept``, ``missing``, ``nan``, ``unparsed``), so unread rows can be counted.
    """
    raw, parsed = F.col("__raw"), F.col("__parsed")
    case = (
        F.when(raw == "nan", "nan")
        .when(parsed.isNotNull(), "parsed")
        .when(F.length(raw).between(26, 27), "kept")
        .when(raw == "", "missing")
        .otherwise("unparsed")
    )
    # Staged, so that parsing, the costly part, happens once per row.
    staged = df.withColumn("__raw", text_or_empty(F.col(col))).withColumn("__parsed", parse_date(raw))
    staged = staged.withColumn("__case", case)
    value = (
        F.when(F.col("__case") == "parsed", parsed.cast("string"))
        .when(F.col("__case") == "missing", "n.a.")
        .otherwise(raw)
    )
    staged = staged.withColumn(out, value)
    if status:
        staged = staged.withColumn(status, F.col("__case"))
    return staged.drop("__raw", "__parsed", "__case")


def detect_language(
    df: DataFrame,
    col: str,
    default: str = DEFAULT_LANGUAGE,
    out: str = "language_id",
    languages: Sequence[str] = LANGUAGES,
) -> DataFrame:
    """ISO 639-1 code of the language whose stop words fill most of the text.

    Ties go to the earlier language, a text without any stop word gets ``default``.
    """
    lists = {code: stop_words(code) for code in languages}
    staged = df.withColumn("__tokens", tokens(F.col(col)))
    staged = staged.withColumn("__hits", F.array(*[count_words("__tokens", words) for words in lists.values()]))
    top = F.array_max("__hits")
    codes = F.array(*[F.lit(c) for c in lists])
    found = F.when(top > 0, F.element_at(codes, F.array_position("__hits", top).cast("int")))
    return staged.withColumn(out, F.coalesce(found, F.lit(default))).drop("__tokens", "__hits")


def language_stats(df: DataFrame, language_col: str = "language_id") -> DataFrame:
    return group_count(df, language_col)


def preprocess_text(
    df: DataFrame,
    col: str,
    lang_col: str,
    filter_list: Sequence[str] = FILTER_LIST,
    annotate: Annotator | None = None,
    keep_pos: Sequence[str] = KEEP_POS,
    out: str = "text_preprocessed",
) -> DataFrame:
    """Lower-case words without stop words of the row's language (unknown: German) and filtered words.

    ``annotate`` may map a text to ``array<struct<token,lemma,pos>>``; then only ``keep_pos`` lemmas stay.
    """
    always = set(filter_list)
    banned = {code: sorted(always | set(stop_words(code))) for code in PREPROCESS_LANGUAGES}

    def kept(item: str) -> Column:
        lists = {code: without_words("__items", words, item) for code, words in banned.items()}
        default = lists.pop(DEFAULT_LANGUAGE)
        chain = F
        for code, items in lists.items():
            chain = chain.when(F.col(lang_col) == code, items)
        return chain.otherwise(default)

    if annotate is None:
        staged = df.withColumn("__items", tokens(F.col(col), 1))
        words = kept("w")
    else:
        staged = df.withColumn("__items", annotate(F.col(col)))
        good = F.filter(
            kept("lower(w.token)"), lambda x: x["pos"].isin(*keep_pos) & ~x["token"].startswith("\n")
        )
        words = F.transform(good, lambda x: F.lower(x["lemma"]))
    return staged.withColumn(out, F.coalesce(F.array_join(words, " "), F.lit(""))).drop("__items")


def standard_cleanup(df: DataFrame, text_col: str = "text", date_col: str = "date") -> DataFrame:
    """Add ``date_standardized``, ``language_id`` and ``text_preprocessed``; no shuffle."""
    dated = standardize_dates(df, date_col)
    filled = dated.withColumn(text_col, text_or_empty(F.col(text_col)))
    return preprocess_text(detect_language(filled, text_col), text_col, "language_id")
