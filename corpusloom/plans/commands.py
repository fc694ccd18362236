"""Whole commands: read a view, run one operator, save a view.

``Workspace`` mirrors how the operators are used from a shell: views are named, a command writes a new
view or, without ``new_view``, a new version of the one it read.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession

from corpusloom import operators as op
from corpusloom.functions.text import combine_text
from corpusloom.sources.tabular import load_keywords
from corpusloom.sources.views import ViewStore, file_row_id, read_csv_view

ROW_ID = "__view_row"


def names(columns: str | Sequence[str]) -> list[str]:
    """``"a, b"`` or ``["a", "b"]``."""
    return [c.strip() for c in columns.split(",")] if isinstance(columns, str) else list(columns)


class Workspace:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.store = ViewStore(spark, root)

    def load(self, view: str, clip: int | None = None) -> DataFrame:
        return self.store.load(view, clip)

    def _numbered(self, view: str) -> DataFrame:
        """The view with the position of each row, straight from the file reader."""
        return file_row_id(self.store.scan(view), ROW_ID)

    def _save(self, df: DataFrame, view: str) -> DataFrame:
        self.store.save(df, view)
        return self.store.load(view)

    def import_csv(self, path: str, view: str, schema=None, index_col: bool = True) -> DataFrame:
        return self._save(read_csv_view(self.spark, path, schema, index_col), view)

    def join(
        self, left: str, right: str, new_view: str, left_cols: str, right_cols: str, how: str = "inner"
    ) -> DataFrame:
        joined = op.join_views(self.load(left), self.load(right), names(left_cols), names(right_cols), how)
        return self._save(joined, new_view)

    # extract VIEW NEW_VIEW

    def kwic(
        self,
        view: str,
        new_view: str,
        keywords: str | Sequence[str],
        cols: str,
        no_overlap: bool = False,
        keep_data: bool = True,
        master_expr: str | None = None,
    ) -> DataFrame:
        """``keywords``: path of a keyword file, or the list itself."""
        patterns = load_keywords(self.spark, keywords) if isinstance(keywords, str) else list(keywords)
        df = self._numbered(view)
        return self._save(op.kwic(df, names(cols), patterns, ROW_ID, no_overlap, keep_data, master_expr), new_view)

    def ctfidf(
        self,
        view: str,
        new_view: str,
        group_by: str | Sequence[str],
        cols: str,
        ranks: int = 20,
        lang: str | None = "german",
        include_tf: bool = False,
    ) -> DataFrame:
        return self._save(op.ctfidf(self.load(view), group_by, names(cols), ranks, lang, include_tf), new_view)

    def similarity(
        self, view: str, new_view: str, group_by: str | Sequence[str], cols: str, lang: str | None = "german"
    ) -> DataFrame:
        return self._save(op.group_similarity(self.load(view), group_by, names(cols), lang), new_view)

    def filter_by(self, view: str, new_view: str, predicate: str | Column) -> DataFrame:
        return self._save(op.filter_view(self.load(view), predicate, sort_columns=True), new_view)

    def group_by_count(
        self, view: str, new_view: str, cols: str, horizontal: bool = False, show: bool = False
    ) -> DataFrame:
        count = op.column_sums if horizontal else op.group_count
        result = self._save(count(self.load(view), names(cols)), new_view)
        if show:
            keys = ["cols"] if horizontal else names(cols)
            result.orderBy(*keys).show(max(1, result.count()), truncate=False)
        return result

    def group_by_condense(
        self, view: str, new_view: str, group_cols: str, condense_cols: str, delim: str = ", "
    ) -> DataFrame:
        df = self._numbered(view)
        return self._save(op.group_concat(df, names(group_cols), names(condense_cols), ROW_ID, delim), new_view)

    # utils FEATURE VIEW

    def sentiment(self, feature: str, view: str, new_view: str | None = None, scorer=None) -> DataFrame:
        """Texts without a sentence are left out of the saved view."""
        scored = op.sentiment(self.load(view), feature, scorer, drop_empty=True)
        return self._save(scored, new_view or view)

    def translate(
        self,
        feature: str,
        view: str,
        fn: Callable[[Column], Column],
        where: str | Column | None = None,
        new_col: str | None = None,
        new_view: str | None = None,
    ) -> DataFrame:
        return self._save(op.map_text_where(self.load(view), feature, fn, where, new_col), new_view or view)

    def match_counter(
        self,
        feature: str,
        view: str,
        nested_cols: str,
        regex_col: str,
        dictionary_view: str,
        case_col: str | None = None,
        new_view: str | None = None,
    ) -> DataFrame:
        dictionary = self.store.scan(dictionary_view)
        counted = op.match_counter(self.load(view), feature, dictionary, names(nested_cols), regex_col, case_col)
        return self._save(counted, new_view or view)

    def hdbscan(
        self,
        feature: str,
        view: str,
        eps: float,
        min_cluster_size: int = 15,
        min_samples: int = 6,
        include_p: bool = False,
        new_view: str | None = None,
    ) -> DataFrame:
        df = self._numbered(view)
        clustered = op.density_cluster(df, feature, eps, ROW_ID, min_cluster_size, min_samples, include_p)
        return self._save(clustered.drop(ROW_ID), new_view or view)

    def umap(self, feature: str, view: str, components: int = 10, new_view: str | None = None) -> DataFrame:
        return self._save(op.reduce_dims(self.load(view), feature, components), new_view or view)

    # encoder, train, append, segment

    def sbert(
        self, text_col: str, view: str, encoder=None, clip: int | None = None, new_view: str | None = None
    ) -> DataFrame:
        return self._save(op.encode_text(self.load(view, clip), text_col, encoder), new_view or view)

    def train(
        self,
        features: str,
        label: str,
        view: str,
        multilabel: bool = False,
        binarize: bool = False,
        learner_path: str | None = None,
        new_view: str | None = None,
    ) -> DataFrame:
        """A learner saved earlier at ``learner_path`` is used again; otherwise the new one is saved there."""
        learner = op.load_learner(learner_path) if learner_path and self.store.exists(learner_path) else None
        save = learner_path if learner is None else None
        df = self.load(view)
        return self._save(op.train_predict(df, names(features), label, multilabel, binarize, learner, save), new_view or view)

    def append_column(
        self, view1: str, view2: str, col: str, new_name: str | None = None, overwrite: bool = False
    ) -> DataFrame:
        """Copy a column of ``view1`` to ``view2`` by row position."""
        source, target = self._numbered(view1), self._numbered(view2)
        return self._save(
            op.append_column(source, target, col, new_name, on=ROW_ID, overwrite=overwrite).drop(ROW_ID), view2
        )

    def segment(
        self, view: str, col: str, n_sentences: int = 8, new_col: str | None = None, new_view: str | None = None
    ) -> DataFrame:
        return self._save(op.split_sentences(self.load(view), col, n_sentences, new_col), new_view or view)

    def clean(self, view: str, text_col: str = "text", date_col: str = "date", new_view: str | None = None) -> DataFrame:
        return self._save(op.standard_cleanup(self.load(view), text_col, date_col), new_view or view)

    def combine(self, view: str, cols: str, out: str, delim: str = "", new_view: str | None = None) -> DataFrame:
        return self._save(self.load(view).withColumn(out, combine_text(names(cols), delim)), new_view or view)
