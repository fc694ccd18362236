"""Languages told apart by character n-grams: naive Bayes on counts learned from labelled texts.

Tasks count the n-grams of their texts as numbers made of code points, so what is shuffled is one row per language and
distinct n-gram of a task. The table of all distinct n-grams travels with the scoring tasks; it grows with the
alphabet's combinations, not with the texts. Scoring is one narrow pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MOST = 3  # code points that fit into a number
PIECE_CHARS = 1 << 20
_BITS = 21


def _grams(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """n-grams of all texts as numbers, and the text of each."""
    lengths = np.array([len(t or "") for t in texts], np.int64)
    points = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    row = np.repeat(np.arange(len(texts)), lengths)
    size = len(points) - n + 1
    if size <= 0:
        return points[:0], row[:0]
    key = np.zeros(size, np.int64)
    for i in range(n):
        key = (key << _BITS) | points[i : i + size]
    whole = row[:size] == row[n - 1 :]
    return key[whole], row[:size][whole]


def _pieces(column: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """Stretches of texts of about ``PIECE_CHARS``, with their first row."""
    texts = column.to_pylist()
    held, begin = 0, 0
    for i, text in enumerate(texts):
        held += len(text or "")
        if held >= PIECE_CHARS:
            yield begin, texts[begin : i + 1]
            held, begin = 0, i + 1
    if begin < len(texts):
        yield begin, texts[begin:]


@dataclass
class LanguageModel:
    """Languages in order, the n-grams known, and the logarithms of their shares; the last row is for unknown ones."""

    languages: list[str]
    n: int
    keys: np.ndarray
    shares: np.ndarray
    priors: np.ndarray

    def scores(self, column: pa.Array) -> np.ndarray:
        out = np.tile(self.priors, (len(column), 1))
        for begin, texts in _pieces(column):
            key, row = _grams(texts, self.n)
            at = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
            at = np.where(self.keys[at] == key, at, len(self.keys)) if len(self.keys) else np.zeros(len(key), np.int64)
            for j in range(len(self.languages)):
                out[begin : begin + len(texts), j] += np.bincount(row, weights=self.shares[at, j], minlength=len(texts))
        return out


def learn_languages(df: DataFrame, text_col: str, lang_col: str, n: int = MOST, alpha: float = 0.5) -> LanguageModel:
    """Count on the rows that have a language and a text; case is ignored.

    A language's share of an n-gram is (count + alpha) / (all + alpha * (distinct in any language + 1)), its prior the share of
    its texts. Without such rows the model knows no language.
    """
    if not 1 <= n <= MOST or alpha <= 0:
        raise ValueError(f"n must lie between 1 and {MOST}, alpha above 0")
    rows = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.lower(text_col).alias("text"))
    found = rows.groupBy("lang").count().orderBy("lang").collect()  # one row per language
    languages = [r["lang"] for r in found]
    number = {lang: i for i, lang in enumerate(languages)}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.array([number[v] for v in batch.column("lang").to_pylist()], np.int64)
            for begin, texts in _pieces(batch.column("text")):
                key, row = _grams(texts, n)
                lang = own[begin + row]
                order = np.lexsort((key, lang))
                key, lang = key[order], lang[order]
                heads = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (lang[1:] != lang[:-1]))) if len(key) else order
                counts = np.diff(np.append(heads, len(key)))
                yield pa.RecordBatch.from_pydict({"lang": pa.array(lang[heads]), "gram": pa.array(key[heads]), "n": pa.array(counts.astype(np.int64))})

    counted = rows.mapInArrow(task, "lang long, gram long, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n")).toArrow()
    gram, lang, times = (counted.column(c).to_numpy() for c in ("gram", "lang", "n"))
    keys, at = np.unique(gram, return_inverse=True)
    table = np.zeros((len(keys) + 1, len(languages)))
    table[at, lang] = times
    total = table.sum(axis=0)
    shares = np.log((table + alpha) / (total + alpha * (len(keys) + 1)))
    texts = np.array([r["count"] for r in found], float)
    return LanguageModel(languages, n, keys, shares, np.log(texts / texts.sum()) if len(texts) else texts)


def classify_language(df: DataFrame, text_col: str, model: LanguageModel, out: str = "language") -> DataFrame:
    """Add ``language`` (the likeliest, of equals the first by name), ``language_score`` (its log of prior and text) and ``language_p``.

    Null texts and models without languages give nulls; an empty text goes by the priors. Columns of these names are
    replaced.
    """
    if not model.languages:
        kinds = {out: "string", f"{out}_score": "double", f"{out}_p": "double"}
        return df.withColumns({n: F.lit(None).cast(k) for n, k in kinds.items()})

    @F.arrow_udf("language string, score double, p double")
    def classify(text: pa.Array) -> pa.Array:
        scores = model.scores(text)
        best = scores.argmax(axis=1)
        top = scores[np.arange(len(best)), best]
        p = 1 / np.exp(np.clip(scores - top[:, None], -700, 0)).sum(axis=1)
        names = pa.array(model.languages).take(pa.array(best))
        return pa.StructArray.from_arrays([names, pa.array(top), pa.array(p)], ["language", "score", "p"], mask=text.is_null())

    told = df.withColumn("__told", classify(F.lower(text_col)))
    return told.withColumns({out: F.col("__told.language"), f"{out}_score": F.col("__told.score"), f"{out}_p": F.col("__told.p")}).drop("__told")
