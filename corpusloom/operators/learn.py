"""Label training on a partly labelled table and query sets for active learning."""

from __future__ import annotations

import json
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window, functions as F

from corpusloom.functions.labels import parse_labels
from corpusloom.functions.vectors import combine_features
from corpusloom.runtime import durable

PARALLEL_FITS = 8
VALUES_PER_TASK = 1_000_000
_FEATURES = "__features"
_LABELS = "__labels"
_PROBA = "__proba"


def label_classes(df: DataFrame, label: str, multilabel: bool = False) -> DataFrame:
    """Distinct labels, one per row, as ``class``."""
    return df.select(F.explode(parse_labels(F.col(label), multilabel)).alias("class")).distinct()


def class_names(df: DataFrame, label: str, multilabel: bool = False) -> list[str]:
    """Sorted labels on the driver; they become columns or places of the probability array."""
    return sorted(r["class"] for r in label_classes(df, label, multilabel).collect())


def binarize_labels(
    df: DataFrame, label: str, multilabel: bool = False, classes: Sequence[str] | None = None
) -> DataFrame:
    """Add a 0/1 column per class; null for rows without a label."""
    names = list(classes) if classes is not None else class_names(df, label, multilabel)
    staged = df.withColumn(_LABELS, parse_labels(F.col(label), multilabel))
    flags = [F.array_contains(_LABELS, c).cast("int").alias(c) for c in names]
    return staged.select("*", *flags).drop(_LABELS)


@dataclass
class Learner:
    """Fitted models and their classes: one multinomial model, or one binary model per class."""

    classes: list[str]
    multilabel: bool
    models: list = field(default_factory=list)

    def with_probabilities(self, df: DataFrame, features: Sequence[str]) -> DataFrame:
        """Add ``__proba``, one probability per class in class order."""
        scored = df.withColumn(_FEATURES, array_to_vector(combine_features(df, features)))
        parts = []
        for i, model in enumerate(self.models):
            model = model.copy()
            raw, proba, prediction = f"__raw_{i}", f"__proba_{i}", f"__prediction_{i}"
            model.setFeaturesCol(_FEATURES).setRawPredictionCol(raw).setProbabilityCol(proba).setPredictionCol(prediction)
            scored = model.transform(scored).drop(raw, prediction)
            parts.append(vector_to_array(proba))
        if self.multilabel:
            combined = F.array(*[p[1] for p in parts])
        else:
            combined = F.slice(parts[0], 1, len(self.classes))
        return scored.withColumn(_PROBA, combined).drop(_FEATURES, *[f"__proba_{i}" for i in range(len(parts))])

    def save(self, path: str) -> None:
        spark = _session()
        PipelineModel(self.models).write().overwrite().save(f"{path}/models")
        meta = json.dumps({"classes": self.classes, "multilabel": self.multilabel})
        spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/classes")

    @classmethod
    def load(cls, path: str) -> Learner:
        meta = json.loads(_session().read.text(f"{path}/classes").first()["value"])
        return cls(meta["classes"], meta["multilabel"], list(PipelineModel.load(f"{path}/models").stages))


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession()


def save_learner(learner: Learner, path: str) -> None:
    learner.save(path)


def load_learner(path: str) -> Learner:
    return Learner.load(path)


def fit_learner(
    df: DataFrame, features: Sequence[str], label: str, multilabel: bool = False, max_iter: int = 25, reg: float = 0.01
) -> Learner:
    """Fit on the rows that have a label.

    Single label: one multinomial model, so the passes over the data do not grow with the classes.
    Several labels: one binary model per class on the same stored features, a few at a time.
    """
    known = df.where(F.col(label).isNotNull())
    classes = class_names(known, label, multilabel)
    if not classes:
        raise ValueError(f"no labelled row in {label}")
    # Written once: every optimiser pass reads it, and a lost executor does not recompute the source.
    train = durable(
        known.select(
            array_to_vector(combine_features(known, features)).alias("features"),
            parse_labels(F.col(label), multilabel).alias(_LABELS),
        )
    )

    # Each optimiser pass is one job over all partitions: a small table is read in few tasks.
    size = train.select(F.count(F.lit(1)), F.max(F.size(vector_to_array("features")))).first()
    train = train.coalesce(max(1, size[0] * size[1] // VALUES_PER_TASK))

    def logistic(target, family: str):
        rows = train.select("features", target.cast("double").alias("label"))
        return LogisticRegression(family=family, maxIter=max_iter, regParam=reg, tol=1e-4).fit(rows)

    if multilabel:
        # A fit is a chain of short jobs, so several run at a time to keep the cluster busy.
        with ThreadPoolExecutor(PARALLEL_FITS) as pool:
            fit = inheritable_thread_target(df.sparkSession)(
                lambda c: logistic(F.array_contains(_LABELS, c), "binomial")
            )
            models = list(pool.map(fit, classes))
    else:
        # Class number by a map built once; a chain of comparisons would grow with the classes.
        order = F.create_map(*[F.lit(x) for i, c in enumerate(classes) for x in (c, float(i))])
        models = [logistic(F.element_at(order, F.col(_LABELS)[0]), "multinomial")]
    return Learner(classes, multilabel, models)


def train_predict(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    multilabel: bool = False,
    binarize: bool = False,
    learner: Learner | None = None,
    save: str | None = None,
) -> DataFrame:
    """Predict the rows without a label; labelled rows keep their own.

    A class counts from probability 0.5 on; a row no class reaches gets its most probable one (the first
    of equals). ``binarize`` gives a 0/1 column per class, else column ``train`` holds the alphabetically
    first class of the row.
    """
    if multilabel != binarize:
        raise ValueError("non-binarized multilabel is not supported: multilabel and binarize must be equal")
    model = learner or fit_learner(df, features, label, multilabel)
    if save:
        model.save(save)
    scored = model.with_probabilities(df, features).withColumn(_LABELS, parse_labels(F.col(label), multilabel))
    names = F.array(*[F.lit(c) for c in model.classes])

    top = F.array_position(_PROBA, F.array_max(_PROBA)).cast("int")
    over = F.filter(names, lambda c, i: F.get(F.col(_PROBA), i) >= 0.5)
    predicted = F.when(F.exists(_PROBA, lambda p: p >= 0.5), over).otherwise(F.array(F.element_at(names, top)))
    chosen = F.when(F.col(label).isNotNull(), F.col(_LABELS)).otherwise(predicted)
    staged = scored.withColumn("__chosen", chosen)
    if binarize:
        out = [F.array_contains("__chosen", c).cast("int").alias(c) for c in model.classes]
    else:
        out = [F.array_min("__chosen").alias("train")]
    return staged.select(*df.columns, *out)


def class_probabilities(df: DataFrame, learner: Learner, features: Sequence[str], out: str = "probabilities") -> DataFrame:
    return learner.with_probabilities(df, features).withColumnRenamed(_PROBA, out)


STRATEGIES = ("uncertainty", "margin", "min_confidence")


def query_set(
    df: DataFrame,
    label: str,
    probabilities: str,
    id_col: str,
    n: int = 5,
    strategies: Sequence[str] = ("uncertainty",),
) -> DataFrame:
    """``strategy, id, score``: per strategy the ``n`` unlabelled rows most worth labelling.

    A later strategy skips rows an earlier one picked.
    """
    proba = F.col(probabilities)
    ordered = F.sort_array(proba, asc=False)
    scores = {
        "uncertainty": 1 - F.array_max(proba),
        "margin": F.get(ordered, F.lit(1)) - F.get(ordered, F.lit(0)),
        "min_confidence": -F.array_min(proba),
    }
    numbered = F.array(
        *[
            F.struct(F.lit(i).alias("strategy_no"), F.lit(s).alias("strategy"), scores[s].alias("score"))
            for i, s in enumerate(strategies)
        ]
    )
    scored = df.where(F.col(label).isNull()).select(id_col, F.inline(numbered))
    # Earlier strategies take at most n rows each, so the first n * (number + 1) of a strategy are enough:
    # one pass over the table, then only these few rows are looked at.
    window = Window.partitionBy("strategy_no").orderBy(F.desc("score"), F.asc(id_col))
    ranked = scored.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= n * len(strategies))
    candidates = durable(ranked.where(F.col("rank") <= n * (F.col("strategy_no") + 1)))
    picks: DataFrame | None = None
    for number in range(len(strategies)):
        pool = candidates.where(F.col("strategy_no") == number)
        left = pool if picks is None else pool.join(picks.select(id_col), id_col, "left_anti")
        chosen = left.orderBy("rank").limit(n).select("strategy_no", "strategy", id_col, "score")
        picks = chosen if picks is None else picks.unionByName(chosen)
    return picks


def nearest_per_column(
    df: DataFrame, columns: Sequence[str], nearest_to: float, n: int, id_col: str
) -> DataFrame:
    """``class, rank, id, value``: per column the ``n`` rows whose value lies nearest to a number.

    The window drops all but ``n`` rows per column and task before it shuffles.
    """
    long = df.select(id_col, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(id_col, list(columns), "class", "value")
    window = Window.partitionBy("class").orderBy(F.abs(F.col("value") - nearest_to), id_col)
    return long.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= n)


def classwise_query_set(
    df: DataFrame,
    label: str,
    probabilities: str,
    classes: Sequence[str],
    id_col: str,
    n: int = 5,
    most_uncertain: bool = True,
) -> DataFrame:
    """Per class the ``n`` unlabelled rows nearest to 0.5 (uncertain) or to 1 (certain)."""
    pool = df.where(F.col(label).isNull()).select(id_col, *[F.get(probabilities, F.lit(i)).alias(c) for i, c in enumerate(classes)])
    return nearest_per_column(pool, classes, 0.5 if most_uncertain else 1.0, n, id_col)
