"""Operators: DataFrame in, DataFrame out."""

from corpusloom.operators.aggregate import column_sums, group_concat, group_concat_parts, group_count
from corpusloom.operators.annotate import (
    glossary,
    lexicon_scorer,
    map_text_where,
    model_scorer,
    sentiment,
    text_model,
)
from corpusloom.operators.boundaries import BoundaryModel, abbreviation_scores, learn_boundaries, learned_spans, starter_scores
from corpusloom.operators.cleanup import (
    detect_language,
    language_stats,
    preprocess_text,
    standard_cleanup,
    standardize_dates,
)
from corpusloom.operators.cluster import cluster_sizes, density_cluster
from corpusloom.operators.components import connected_components
from corpusloom.operators.ctfidf import ctfidf, group_similarity, term_weights
from corpusloom.operators.encode import clip_rows, encode_text, model_encoder
from corpusloom.operators.hierarchy import density_hierarchy
from corpusloom.operators.kernel import kernel_width, rbf_features
from corpusloom.operators.kwic import kwic
from corpusloom.operators.langmodel import LanguageModel, classify_language, learn_languages
from corpusloom.operators.learn import (
    Learner,
    binarize_labels,
    class_names,
    class_probabilities,
    classwise_query_set,
    fit_learner,
    label_classes,
    load_learner,
    nearest_per_column,
    query_set,
    save_learner,
    train_predict,
)
from corpusloom.operators.matchcount import match_counter
from corpusloom.operators.matchmany import match_counts
from corpusloom.operators.reduce import reduce_dims
from corpusloom.operators.relational import append_column, filter_mapper, filter_view, join_views, with_row_id
from corpusloom.operators.segment import split_sentences, with_sentence_spans

__all__ = [
    "BoundaryModel",
    "LanguageModel",
    "Learner",
    "abbreviation_scores",
    "append_column",
    "binarize_labels",
    "class_names",
    "class_probabilities",
    "classify_language",
    "classwise_query_set",
    "clip_rows",
    "cluster_sizes",
    "column_sums",
    "connected_components",
    "ctfidf",
    "density_cluster",
    "density_hierarchy",
    "detect_language",
    "encode_text",
    "filter_mapper",
    "filter_view",
    "fit_learner",
    "glossary",
    "group_concat",
    "group_concat_parts",
    "group_count",
    "group_similarity",
    "join_views",
    "kernel_width",
    "kwic",
    "label_classes",
    "learn_boundaries",
    "learn_languages",
    "learned_spans",
    "language_stats",
    "lexicon_scorer",
    "load_learner",
    "map_text_where",
    "match_counter",
    "match_counts",
    "model_encoder",
    "model_scorer",
    "nearest_per_column",
    "preprocess_text",
    "query_set",
    "rbf_features",
    "reduce_dims",
    "save_learner",
    "sentiment",
    "split_sentences",
    "standard_cleanup",
    "starter_scores",
    "standardize_dates",
    "term_weights",
    "text_model",
    "train_predict",
    "with_row_id",
    "with_sentence_spans",
]
