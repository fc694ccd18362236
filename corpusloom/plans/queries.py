"""One registered query per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom import operators as op
from corpusloom.functions.labels import parse_labels
from corpusloom.functions.sentences import sentence_spans
from corpusloom.functions.text import combine_text, lowercase, normalize_whitespace
from corpusloom.functions.vectors import combine_features, stringify, unstringify
from corpusloom.plans import source_queries
from corpusloom.runtime import spread
from corpusloom.sources.collections import validation_errors

Query = Callable[[SparkSession, str], DataFrame]

KEYWORDS = ("the", "und", "les?")
PHRASES = (r"[a-z]+e\.\s+[a-z]+", r"the\s+of")
MASTER = r"<KEYWORD>[ \t\r\n]+[a-z]+"
DICTIONARY = (
    {"category": "articles", "language": "articles_en", "regex": "the", "exact": False},
    {"category": "articles", "language": "articles_en", "regex": "an?[ \\t\\r\\n]", "exact": True},
    {"category": "articles", "language": "articles_de", "regex": "d(?:er|ie|as)", "exact": False},
    {"category": "conjunctions", "language": "conjunctions_en", "regex": "and", "exact": False},
    {"category": "conjunctions", "language": "conjunctions_de", "regex": "und", "exact": True},
    {"category": "conjunctions", "language": "conjunctions_fr", "regex": "et", "exact": True},
)
GLOSSARY = {"und": "and", "nicht": "not", "die": "the", "der": "the", "ist": "is"}
EPS = 1.18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a label cell such as ``Good; Toxic``; null where no one labelled the document."""
    labels = table(spark, sf_dir, "labels").select(
        "doc_id",
        F.concat_ws(
            "; ",
            F.when(F.col("quality") == 1, "Good").otherwise("Poor"),
            F.when(F.col("toxic") == 1, "Toxic"),
        ).alias("label"),
    )
    return documents(spark, sf_dir).join(labels, "doc_id", "left")


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# --- class-based TF-IDF ------------------------------------------------------------------------------


def ctfidf_lang(spark, sf_dir):
    return _rounded(op.ctfidf(documents(spark, sf_dir), "lang", "text", 20, "english"), "tfidf")


def ctfidf_source_tf(spark, sf_dir):
    return _rounded(op.ctfidf(documents(spark, sf_dir), "source", "text", 10, "german", include_tf=True), "tfidf")


def ctfidf_two_groups(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return _rounded(op.ctfidf(docs, ["lang", "source"], ["source", "text"], 5, "french"), "tfidf")


def group_similarity(spark, sf_dir):
    return _rounded(op.group_similarity(documents(spark, sf_dir), "source", "text", "english"), "similarity")


def group_similarity_lang(spark, sf_dir):
    return _rounded(op.group_similarity(documents(spark, sf_dir), "lang", "text", None), "similarity")


# --- relational --------------------------------------------------------------------------------------


def filter_orders(spark, sf_dir):
    return op.filter_view(table(spark, sf_dir, "orders"), "o_orderstatus = 'F' AND o_totalprice > 100000", True)


def filter_mapper(spark, sf_dir):
    return op.filter_mapper(table(spark, sf_dir, "orders"), "o_orderstatus = 'F'", "o_orderkey")


def _join(spark, sf_dir, how):
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return op.join_views(customers, orders, ["c_custkey"], ["o_custkey"], how)


def join_inner(spark, sf_dir):
    return _join(spark, sf_dir, "inner")


def join_left(spark, sf_dir):
    return _join(spark, sf_dir, "left")


def join_right(spark, sf_dir):
    return _join(spark, sf_dir, "right")


def join_outer(spark, sf_dir):
    return _join(spark, sf_dir, "outer")


def join_null_keys(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").select(
        F.nullif("n_nationkey", F.lit(3)).alias("n_nationkey"), F.col("n_name").alias("name")
    )
    suppliers = table(spark, sf_dir, "supplier").select(
        F.nullif("s_nationkey", F.lit(5)).alias("s_nationkey"), F.col("s_name").alias("name")
    )
    return op.join_views(nations, suppliers, ["n_nationkey"], ["s_nationkey"], "outer")


def combine_text_part(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    brand = F.nullif("p_brand", F.lit("Brand#13"))
    return parts.select("p_partkey", combine_text(["p_name", brand, "p_type", "p_size"], ". ").alias("combined"))


def with_row_id(spark, sf_dir):
    return op.with_row_id(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")


def append_column(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    upper = docs.select("doc_id", F.upper("lang").alias("code"))
    return op.append_column(upper, docs, "code", "lang_code", on="doc_id")


def append_column_position(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    sources = table(spark, sf_dir, "documents").select("doc_id", "source")
    return op.append_column(sources, docs, "source", "origin", order_source="doc_id", order_target="doc_id")


def clip_rows(spark, sf_dir):
    return op.clip_rows(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), 50, "doc_id")


# --- aggregation -------------------------------------------------------------------------------------


def group_count(spark, sf_dir):
    return op.group_count(table(spark, sf_dir, "documents"), ["lang", "source"])


def group_count_events(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.nullif("event_type", F.lit("error")).alias("event_type"))
    return op.group_count(events, "event_type")


def column_sums(spark, sf_dir):
    return op.column_sums(table(spark, sf_dir, "labels"), ["quality", "toxic"])


def group_concat(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return op.group_concat(turns, "conv_id", ["role", "text"], "turn", ", ")


def group_concat_parts(spark, sf_dir):
    return op.group_concat_parts(table(spark, sf_dir, "documents"), "source", "lang", "doc_id", ", ", 100)


# --- sentences and matches ---------------------------------------------------------------------------


def sentence_spans_docs(spark, sf_dir):
    spans = documents(spark, sf_dir).select("doc_id", F.posexplode(sentence_spans(F.col("text"))).alias("i", "span"))
    return spans.select(
        "doc_id",
        F.col("i").cast("bigint").alias("sentence"),
        F.col("span.start").cast("bigint").alias("start_at"),
        F.col("span.end").cast("bigint").alias("end_at"),
    )


def abbreviation_scores(spark, sf_dir):
    scores = op.abbreviation_scores(documents(spark, sf_dir), "text")
    return scores.withColumn("score", F.round("score", 4))


def starter_scores(spark, sf_dir):
    scores = op.starter_scores(documents(spark, sf_dir).select("text"), "text")
    return scores.withColumn("score", F.round("score", 4))


def learned_sentences(spark, sf_dir):
    """Sentences by boundaries learned from all documents."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = op.learn_boundaries(docs, "text")
    return docs.select("doc_id", F.posexplode(op.learned_spans(F.col("text"), model)).alias("n", "span")).select("doc_id", "n", "span.*")


def segment_sentences(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "lang", "text")
    return op.split_sentences(docs, "text", 8, "segment").select("doc_id", "lang", "segment")


def normalize_text(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", normalize_whitespace(lowercase(F.col("text"))).alias("text"))


def _kwic(spark, sf_dir, keywords, **options):
    return op.kwic(documents(spark, sf_dir), "text", list(keywords), "doc_id", keep_data=["lang", "source"], **options)


def kwic(spark, sf_dir):
    return _kwic(spark, sf_dir, KEYWORDS)


def kwic_master(spark, sf_dir):
    return _kwic(spark, sf_dir, KEYWORDS, master_expr=MASTER)


def kwic_phrases(spark, sf_dir):
    return _kwic(spark, sf_dir, PHRASES)


def kwic_no_overlap(spark, sf_dir):
    return _kwic(spark, sf_dir, KEYWORDS, no_overlap=True)


def language_posterior(spark, sf_dir):
    """Documents' languages by character trigrams of all documents."""
    docs = documents(spark, sf_dir).select("doc_id", "lang", "text")
    told = op.classify_language(docs, "text", op.learn_languages(docs, "text", "lang"))
    return told.select("doc_id", "language", F.round("language_score", 3).alias("score"))


def match_counts(spark, sf_dir):
    """Every word of the benchmark, and all words of an initial, in every document."""
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))).alias("word")
    words = table(spark, sf_dir, "benchmark").select(word).distinct().orderBy("word")
    dictionary = words.select(F.concat(F.lit("initial "), F.left("word", F.lit(1))).alias("initial"), "word", F.col("word").alias("regex"))
    docs = documents(spark, sf_dir).select("doc_id", "text")
    counted = op.match_counts(docs, "text", dictionary, ["initial", "word"], "regex")
    return counted.select("doc_id", F.explode("matches").alias("node", "n"))


def match_counter(spark, sf_dir):
    docs = documents(spark, sf_dir)
    counted = op.match_counter(docs, "text", DICTIONARY, ["category", "language"], "regex", "exact")
    return counted.drop("text", "n_chars")


# --- clean-up ----------------------------------------------------------------------------------------


def detect_language(spark, sf_dir):
    return op.detect_language(documents(spark, sf_dir), "text").select("doc_id", "lang", "language_id")


def language_stats(spark, sf_dir):
    return op.language_stats(op.detect_language(documents(spark, sf_dir), "text"))


def _date_strings(spark, sf_dir):
    """Order dates written out in several ways, and some that are no dates."""
    when = F.col("o_orderdate")
    german = F.array(*[F.lit(m) for m in (
        "Januar", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November",
        "Dezember")])
    english = F.array(*[F.lit(m) for m in (
        "January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November",
        "December")])
    month = F.month(when)
    written = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.date_format(when, "dd.MM.yyyy"))
        .when(F.col("o_orderpriority") == "2-HIGH",
              F.concat(F.dayofmonth(when), F.lit(". "), F.element_at(german, month), F.lit(" "), F.year(when)))
        .when(F.col("o_orderpriority") == "3-MEDIUM",
              F.concat(F.element_at(english, month), F.lit(" "), F.dayofmonth(when), F.lit(", "), F.year(when)))
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.date_format(when, "yyyy-MM-dd HH:mm:ss"))
        .when(F.col("o_orderstatus") == "O", F.lit(None).cast("string"))
        .when(F.col("o_orderstatus") == "F", F.lit("nan"))
        .otherwise(F.concat(F.lit("order "), F.col("o_orderkey"), F.lit(" undated")))
    )
    return spread(table(spark, sf_dir, "orders")).select("o_orderkey", written.alias("date"))


def standardize_dates(spark, sf_dir):
    return op.standardize_dates(_date_strings(spark, sf_dir), "date", status="date_status").drop("date")


def preprocess_text(spark, sf_dir):
    return op.preprocess_text(documents(spark, sf_dir), "text", "lang").select("doc_id", "text_preprocessed")


def standard_cleanup(spark, sf_dir):
    dates = _date_strings(spark, sf_dir).withColumnRenamed("o_orderkey", "doc_id")
    docs = documents(spark, sf_dir).select("doc_id", "text").join(dates, "doc_id", "left")
    return op.standard_cleanup(docs).select("doc_id", "date_standardized", "language_id", "text_preprocessed")


# --- annotation and vectors --------------------------------------------------------------------------


def sentiment_lexicon(spark, sf_dir):
    scored = op.sentiment(documents(spark, sf_dir), "text", op.lexicon_scorer(("good", "the", "und"), ("worthless", "of", "nicht")))
    return _rounded(scored.select("doc_id", "sentiment_score"), "sentiment_score")


def map_text_where(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "lang", "text")
    return op.map_text_where(docs, "text", op.glossary(GLOSSARY), F.col("lang") == "de", "translated").drop("text")


def sentiment_model(spark, sf_dir):
    """A user model that tells sentences apart by their length and fails on batches with a question."""

    def load():
        def predict(sentences):
            if any("?" in s for s in sentences):
                raise ValueError("no questions")
            return [(("NEGATIVE", "NEUTRAL", "POSITIVE")[len(s) % 3], (len(s) % 7 + 1) / 10) for s in sentences]

        return predict

    scored = op.sentiment(documents(spark, sf_dir), "text", op.model_scorer(load))
    return _rounded(scored.select("doc_id", "sentiment_score"), "sentiment_score")


def map_text_model(spark, sf_dir):
    """A user model for French texts that fails on tables."""

    def load():
        def convert(text):
            if "|" in text:
                raise ValueError("a table")
            return f"{len(text)}:{text[:7]}"

        return convert

    docs = documents(spark, sf_dir).select("doc_id", "lang", "text")
    return op.map_text_where(docs, "text", op.text_model(load), F.col("lang") == "fr", "translated").drop("text")


def encode_model(spark, sf_dir):
    """A user model that encodes a text by its length and a letter's count."""

    def load():
        return lambda texts: [(len(t), t.count("e"), 0.5) for t in texts]

    encoded = op.encode_text(documents(spark, sf_dir), "text", op.model_encoder(load)).select("doc_id", "sbert")
    return encoded.select("doc_id", F.posexplode("sbert").alias("dimension", "value")).withColumn("dimension", F.col("dimension").cast("bigint"))


def encode_hash_norm(spark, sf_dir):
    """Every hashed vector has length one, but for texts without a token."""
    square = F.aggregate("sbert", F.lit(0.0), lambda a, x: a + x * x)
    return encode_hash(spark, sf_dir).select("doc_id", F.round(square, 6).alias("norm"))


def encode_hash(spark, sf_dir):
    return op.encode_text(documents(spark, sf_dir), "text").select("doc_id", "sbert")


def vector_json_roundtrip(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    read = vectors.select("vec_id", unstringify(stringify(F.col("v"))).alias("v"))
    return read.select("vec_id", F.posexplode("v").alias("dimension", "value")).select(
        "vec_id", F.col("dimension").cast("bigint").alias("dimension"), F.round("value", 6).alias("value")
    )


def combine_features_emb(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    combined = vectors.select("vec_id", combine_features(vectors, ["embedding", "label"]).alias("f"))
    return combined.select("vec_id", F.posexplode("f").alias("dimension", "value")).select(
        "vec_id", F.col("dimension").cast("bigint").alias("dimension"), F.round("value", 6).alias("value")
    )


def validate_collection(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.nullif("lang", F.lit("es")).alias("corpusName"),
        "text",
        F.nullif("source", F.lit("src3")).alias("source"),
        F.col("n_chars").alias("date"),
    )
    return docs.select("doc_id", F.array_join(validation_errors(docs, "corpus"), "; ").alias("errors"))


def reduce_dims(spark, sf_dir):
    return op.reduce_dims(table(spark, sf_dir, "embeddings"), "embedding", 10).select("vec_id", "umap")


def density_cluster(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    clustered = op.density_cluster(vectors, "embedding", EPS, "vec_id", include_p=True)
    return _rounded(clustered.select("vec_id", "hdbscan", "hdbscan_p"), "hdbscan_p")


def density_hierarchy(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    clustered = op.density_hierarchy(vectors, "embedding", "vec_id", include_p=True)
    return _rounded(clustered.select("vec_id", "hdbscan", "hdbscan_p"), "hdbscan_p")


def cluster_sizes(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return op.cluster_sizes(op.density_cluster(vectors, "embedding", EPS, "vec_id"))


# --- labels and training -----------------------------------------------------------------------------


def parse_labels_docs(spark, sf_dir):
    docs = labelled_documents(spark, sf_dir)
    return docs.select("doc_id", F.array_join(parse_labels(F.col("label"), True), "|").alias("labels"))


def label_classes(spark, sf_dir):
    return op.label_classes(labelled_documents(spark, sf_dir), "label", True)


def binarize_labels(spark, sf_dir):
    docs = labelled_documents(spark, sf_dir).select("doc_id", "label")
    return op.binarize_labels(docs, "label", True).drop("label")


def train_predict(spark, sf_dir):
    encoded = op.encode_text(labelled_documents(spark, sf_dir), "text").select("doc_id", "sbert", "label")
    return op.train_predict(encoded, ["sbert"], "label").select("doc_id", "train")


def train_multilabel(spark, sf_dir):
    encoded = op.encode_text(labelled_documents(spark, sf_dir), "text").select("doc_id", "sbert", "label")
    return op.train_predict(encoded, ["sbert"], "label", multilabel=True, binarize=True).drop("sbert", "label")


def kernel_products(spark, sf_dir):
    """Whether products of random features are near the kernel, for each vector and the one with the next id."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    gamma = op.kernel_width(vectors, "v")
    # Only the vectors are shuffled: features, many times as wide, are made behind the join.
    other = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    made = op.rbf_features(vectors.join(other, "vec_id"), "v", "z", dims=2048, gamma=gamma)
    made = op.rbf_features(made, "w", "y", dims=2048, gamma=gamma)
    total = lambda a, b, f: F.aggregate(F.zip_with(a, b, f), F.lit(0.0), lambda s, x: s + x)
    kernel = F.exp(-gamma * total("v", "w", lambda x, y: (x - y) * (x - y)))
    return made.select("vec_id", (F.abs(total("z", "y", lambda x, y: x * y) - kernel) < 0.12).alias("near"))


def train_kernel(spark, sf_dir):
    """Labels of vectors with an odd id, learned on random features of the others."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 2 == 0, F.concat(F.lit("c"), F.col("label"))).alias("label"))
    return op.train_predict(op.rbf_features(rows, "embedding", dims=256), ["rbf"], "label").select("vec_id", "train")


def _scored(spark, sf_dir):
    encoded = op.encode_text(labelled_documents(spark, sf_dir), "text").select("doc_id", "sbert", "label")
    learner = op.fit_learner(encoded, ["sbert"], "label")
    return op.class_probabilities(encoded, learner, ["sbert"]), learner


def query_set(spark, sf_dir):
    scored, _ = _scored(spark, sf_dir)
    return op.query_set(scored, "label", "probabilities", "doc_id", 5, ("uncertainty", "margin"))


def classwise_query_set(spark, sf_dir):
    scored, learner = _scored(spark, sf_dir)
    return op.classwise_query_set(scored, "label", "probabilities", learner.classes, "doc_id", 5)


def _length_scores(spark, sf_dir):
    """A score any engine can recompute: how long a document is against two scales."""
    n = F.col("n_chars").cast("double")
    share = F.array(n / (n + 900.0), F.lit(1.0) - n / (n + 900.0))
    return labelled_documents(spark, sf_dir).select("doc_id", "label", share.alias("probabilities"))


def query_set_length(spark, sf_dir):
    picked = op.query_set(_length_scores(spark, sf_dir), "label", "probabilities", "doc_id", 7, ("uncertainty", "margin"))
    return _rounded(picked.withColumn("strategy_no", F.col("strategy_no").cast("bigint")), "score")


def classwise_length(spark, sf_dir):
    scored = _length_scores(spark, sf_dir)
    picked = op.classwise_query_set(scored, "label", "probabilities", ["long", "short"], "doc_id", 7, False)
    return _rounded(picked.withColumn("rank", F.col("rank").cast("bigint")), "value")


def nearest_per_column(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    picked = op.nearest_per_column(parts, ["p_size", "p_retailprice"], 25.0, 10, "p_partkey")
    return picked.withColumn("rank", F.col("rank").cast("bigint"))


QUERIES: dict[str, Query] = {
    "ctfidf_lang": ctfidf_lang,
    "ctfidf_source_tf": ctfidf_source_tf,
    "ctfidf_two_groups": ctfidf_two_groups,
    "group_similarity": group_similarity,
    "group_similarity_lang": group_similarity_lang,
    "filter_orders": filter_orders,
    "filter_mapper": filter_mapper,
    "join_inner": join_inner,
    "join_left": join_left,
    "join_right": join_right,
    "join_outer": join_outer,
    "join_null_keys": join_null_keys,
    "combine_text": combine_text_part,
    "with_row_id": with_row_id,
    "append_column": append_column,
    "append_column_position": append_column_position,
    "clip_rows": clip_rows,
    "group_count": group_count,
    "group_count_events": group_count_events,
    "column_sums": column_sums,
    "group_concat": group_concat,
    "group_concat_parts": group_concat_parts,
    "sentence_spans": sentence_spans_docs,
    "segment_sentences": segment_sentences,
    "normalize_text": normalize_text,
    "kwic": kwic,
    "kwic_master": kwic_master,
    "kwic_phrases": kwic_phrases,
    "kwic_no_overlap": kwic_no_overlap,
    "match_counter": match_counter,
    "abbreviation_scores": abbreviation_scores,
    "starter_scores": starter_scores,
    "learned_sentences": learned_sentences,
    "language_posterior": language_posterior,
    "match_counts": match_counts,
    "detect_language": detect_language,
    "language_stats": language_stats,
    "standardize_dates": standardize_dates,
    "preprocess_text": preprocess_text,
    "standard_cleanup": standard_cleanup,
    "sentiment_lexicon": sentiment_lexicon,
    "map_text_where": map_text_where,
    "encode_hash": encode_hash,
    "encode_hash_norm": encode_hash_norm,
    "encode_model": encode_model,
    "sentiment_model": sentiment_model,
    "map_text_model": map_text_model,
    "vector_json_roundtrip": vector_json_roundtrip,
    "combine_features": combine_features_emb,
    "validate_collection": validate_collection,
    "reduce_dims": reduce_dims,
    "density_cluster": density_cluster,
    "density_hierarchy": density_hierarchy,
    "cluster_sizes": cluster_sizes,
    "parse_labels": parse_labels_docs,
    "label_classes": label_classes,
    "binarize_labels": binarize_labels,
    "train_predict": train_predict,
    "train_multilabel": train_multilabel,
    "kernel_products": kernel_products,
    "train_kernel": train_kernel,
    "query_set": query_set,
    "classwise_query_set": classwise_query_set,
    "query_set_length": query_set_length,
    "classwise_length": classwise_length,
    "nearest_per_column": nearest_per_column,
} | source_queries.QUERIES
