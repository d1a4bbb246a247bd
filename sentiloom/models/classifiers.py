"""Baseline and boosted classifiers, ensembles and scoring on pyspark.ml.

A fitted classifier adds ``p_negative``, ``p_neutral``, ``p_positive`` and ``label_id``.
"""

from __future__ import annotations

import json
import warnings
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from functools import partial

from pyspark import inheritable_thread_target
from pyspark.errors import IllegalArgumentException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentiloom.models import boosting
from sentiloom.models.boosting import Fitted, Model, Settings
from sentiloom.models.resamples import Resampled
from sentiloom.models.stages import TextVectors
from sentiloom.operators.joins import group_join
from sentiloom.operators.sampling import class_weights, seeded_unit, stratified_kfold
from sentiloom.schemas import LABEL_NAMES
from sentiloom.session import measured

PROBS = [f"p_{x}" for x in LABEL_NAMES]
K = len(LABEL_NAMES)
NOT_FEATURES = ["post_id", "auto_label", "auto_label_id", "is_augmented", "y_true", "fold", "weight"]


def argmax_id(values: list[Column]) -> Column:
    best = F.greatest(*values)
    out = F.lit(len(values) - 1)
    for i in range(len(values) - 2, -1, -1):
        out = F.when(values[i] == best, i).otherwise(out)
    return out


def with_class_weight(df: DataFrame, label: str) -> DataFrame:
    """Add ``weight``: balanced class weight."""
    weights = class_weights(df, label).select(label, F.col("balanced_weight").alias("weight"))
    return group_join(df, weights, [label])


def probability_columns(df: DataFrame, vector: str = "_probability") -> DataFrame:
    """Three probability columns from a probability vector; a class unseen in training gets 0."""
    arr = vector_to_array(vector)
    out = df.withColumns({p: F.coalesce(F.get(arr, F.lit(i)), F.lit(0.0)) for i, p in enumerate(PROBS)})
    return out.withColumn("label_id", argmax_id([F.col(p) for p in PROBS]))


@dataclass
class Baseline:
    """Multinomial logistic regression on TF-IDF text vectors, balanced weights."""

    text_col: str = "preprocessed_text"
    label: str = "auto_label_id"
    max_features: int = 5000
    c: float = 1.0
    max_iter: int = 1000
    model: PipelineModel | None = None
    metadata: dict = field(default_factory=dict)

    def fit(self, df: DataFrame) -> "Baseline":
        weighted = with_class_weight(df.select(self.text_col, self.label), self.label)
        rows = df.count()
        vectors = TextVectors(inputCol=self.text_col, outputCol="_features", maxFeatures=self.max_features)
        regression = LogisticRegression(
            featuresCol="_features", labelCol=self.label, weightCol="weight", family="multinomial", maxIter=self.max_iter,
            regParam=1.0 / (self.c * max(rows, 1)), standardization=False, probabilityCol="_probability",
            rawPredictionCol="_raw", predictionCol="_prediction")
        fitted = vectors.fit(weighted)
        ready = measured(fitted.transform(weighted).select("_features", self.label, "weight"), "vectors")  # made once, read twice by the fit
        self.model = PipelineModel(stages=[fitted, regression.fit(ready)])
        self.metadata = {"model_name": "baseline_logistic_regression", "model_version": "1.0.0", "training_samples": rows,
                         "max_features": self.max_features}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        out = probability_columns(self.model.transform(df))
        return out.drop("_features", "_probability", "_raw", "_prediction")

    def regression(self) -> LogisticRegressionModel:
        return self.model.stages[-1]

    def terms(self) -> list[str]:
        return self.model.stages[0].stages[0].terms()

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        row = json.dumps(self.metadata | {"text_col": self.text_col, "label": self.label})
        _session().createDataFrame([(row,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")

    @classmethod
    def load(cls, path: str) -> "Baseline":
        row = json.loads(_session().read.text(f"{path}/metadata").first()["value"])
        out = cls(text_col=row.pop("text_col"), label=row.pop("label"), max_features=row["max_features"])
        out.model, out.metadata = PipelineModel.load(f"{path}/model"), row
        return out


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession()


def numeric_features(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in NOT_FEATURES]


def impute_mean(train: DataFrame, columns: list[str]):
    """Imputer fitted on the training rows only: null -> training mean."""
    return Imputer(strategy="mean", inputCols=columns, outputCols=columns).fit(as_double(train, columns))


def as_double(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


@dataclass
class Boosted:
    """Multiclass gradient boosting on numeric columns (:mod:`sentiloom.models.boosting`), balanced weights, early stop.

    Rows with ``validation_col`` end the training; without that column a tenth of the rows, drawn by digest of the key, does.
    """

    features: list[str] | None = None
    label: str = "auto_label_id"
    settings: Settings = field(default_factory=Settings)
    validation_col: str | None = None
    key: str = "post_id"
    fitted: Fitted | None = None
    history: dict = field(default_factory=dict)

    def _train(self, df: DataFrame, models: list[Model], group) -> list[Fitted]:
        self.features = self.features or numeric_features(df)
        mark = F.col(self.validation_col) if self.validation_col else seeded_unit(self.settings.seed + 7, self.key) < 0.1
        slim = df.select(self.key, self.label, group.alias("_group"), F.coalesce(mark, F.lit(False)).alias("_mark"), *self.features)
        return boosting.fit(with_class_weight(slim, self.label), self.features, models, K, self.label, "weight", "_group", "_mark", self.key)

    def fit(self, df: DataFrame) -> "Boosted":
        self.fitted = self._train(df, [Model(self.settings, marked=True)], F.lit(0))[0]
        self.history = {"best_iteration": self.fitted.model.best + 1, "losses": [row[0] for row in self.fitted.model.history]}
        return self

    def fit_all(self, df: DataFrame) -> "Boosted":
        """All rounds on all rows: nothing is held out."""
        self.fitted = self._train(df, [Model(replace(self.settings, patience=self.settings.rounds))], F.lit(0))[0]
        return self

    def fit_cv(self, df: DataFrame, folds: int = 5) -> "Boosted":
        """A model per fold, all trained together, each stopped by its own fold; the one with the best held-out accuracy is kept."""
        folded = stratified_kfold(df, self.label, folds, self.key, self.settings.seed)
        trained = self._train(folded, [Model(self.settings, f) for f in range(folds)], F.col("fold"))
        scores = [one.model.history[one.model.best][1] if one.model.history else 0.0 for one in trained]
        best = max(range(folds), key=lambda i: scores[i])
        self.fitted, self.history = trained[best], {"cv_scores": scores, "best_fold": best, "rounds": [len(one.model.history) for one in trained]}
        return self

    def fit_folds(self, folded: DataFrame, folds: int) -> "list[Boosted]":
        """A model per fold that never saw it: a tenth of the other folds ends its training."""
        trained = self._train(folded, [Model(self.settings, f, marked=True) for f in range(folds)], F.col("fold"))
        return [replace(self, fitted=one) for one in trained]

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.fitted.probabilities(df, "_p").withColumns({p: F.get("_p", F.lit(i)) for i, p in enumerate(PROBS)}).drop("_p")
        return out.withColumn("label_id", argmax_id([F.col(p) for p in PROBS]))

    def importance(self) -> list[tuple[str, float]]:
        return self.fitted.importance()


def feature_importance(spark, model: Boosted) -> DataFrame:
    """Importance table, largest first."""
    return spark.createDataFrame(model.importance(), "feature string, importance double").orderBy(
        F.desc("importance"), "feature")


def top_features(importance: DataFrame, n: int = 10) -> DataFrame:
    return importance.orderBy(F.desc("importance"), "feature").limit(n)


def top_terms_per_class(spark, model: Baseline, n: int = 20) -> DataFrame:
    """Terms with the largest absolute coefficient per class (the coefficient table is bounded by the vocabulary)."""
    from pyspark.sql import Window

    matrix = model.regression().coefficientMatrix.toArray()
    rows = [(LABEL_NAMES[c], t, float(matrix[c, i])) for c in range(matrix.shape[0]) for i, t in enumerate(model.terms())]
    table = spark.createDataFrame(rows, "label string, term string, coefficient double")
    w = Window.partitionBy("label").orderBy(F.desc(F.abs("coefficient")), "term")
    return table.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


# --- ensembles ----------------------------------------------------------------------------


def base_probabilities(models: dict, df: DataFrame) -> DataFrame:
    """Score with every base model in one pass; columns are prefixed with the model name."""
    out = df
    for name, model in models.items():
        scored = model.transform(out)
        out = scored.withColumnsRenamed({p: f"{name}_{p}" for p in PROBS}).drop("label_id")
    return out


#: The boosted second level, which has few columns: smaller trees, every round kept.
META = Settings(rounds=500, max_depth=5)


@dataclass
class Stacked:
    """Meta-model, logistic or boosted, over the concatenated probabilities of base models."""

    models: dict
    label: str = "auto_label_id"
    meta_type: str = "logistic"
    c: float = 1.0
    max_iter: int = 1000
    key: str = "post_id"
    meta: PipelineModel | Boosted | None = None
    held: DataFrame | None = None

    def inputs(self) -> list[str]:
        return [f"{m}_{p}" for m in self.models for p in PROBS]

    def fit_meta(self, scored: DataFrame) -> "Stacked":
        if self.meta_type == "boosted":
            self.meta = Boosted(self.inputs(), self.label, META, key=self.key).fit_all(scored)
            return self
        assembler = VectorAssembler(inputCols=self.inputs(), outputCol="_meta")
        rows = scored.select(self.label, *self.inputs())
        regression = LogisticRegression(featuresCol="_meta", labelCol=self.label, family="multinomial", maxIter=self.max_iter, standardization=False,
                                        regParam=1.0 / (self.c * max(rows.count(), 1)), probabilityCol="_probability", rawPredictionCol="_raw",
                                        predictionCol="_prediction")
        self.meta = Pipeline(stages=[assembler, regression]).fit(rows)
        return self

    def fit(self, df: DataFrame) -> "Stacked":
        scored = base_probabilities(self.models, df)
        rows = scored.select(*[c for c in scored.columns if c in {self.key, self.label, *self.inputs()}])
        return self.fit_meta(measured(rows, "meta"))  # scored once, read several times by the fit

    def transform(self, df: DataFrame) -> DataFrame:
        scored = self.meta.transform(base_probabilities(self.models, df))
        if self.meta_type == "boosted":
            return scored
        return probability_columns(scored).drop("_meta", "_probability", "_raw", "_prediction")


def uniform(df: DataFrame) -> DataFrame:
    """Stand-in scores when a base model cannot be fitted."""
    return df.withColumns({p: F.lit(1.0 / K) for p in PROBS}).withColumn("label_id", F.lit(0))


class Uniform:
    transform = staticmethod(uniform)


def fit_or_uniform(make, df: DataFrame):
    try:
        return make().fit(df)
    except (IllegalArgumentException, ValueError) as problem:  # the data cannot be fitted (no term, one class); anything else stops the job
        warnings.warn(f"base model failed, uniform scores used: {type(problem).__name__}: {problem}", stacklevel=2)
        return Uniform()


def side_by_side(spark, calls: list) -> list:
    """Results of calls that run their Spark jobs at the same time, so that short jobs of one fill the gaps of others."""
    with ThreadPoolExecutor(max(len(calls), 1)) as pool:
        return [done.result() for done in [pool.submit(inheritable_thread_target(spark)(call)) for call in calls]]


def out_of_fold(df: DataFrame, makers: dict, label: str, folds: int, key: str, seed: int) -> DataFrame:
    """Rows (key, label, fold, probabilities of every base model), each scored by models that never saw its fold."""
    folded = measured(stratified_kfold(df, label, folds, key, seed), "folded")
    by_fold = {}
    for name, make in makers.items():
        model = make()
        if isinstance(model, Boosted):  # all folds in the same passes
            try:
                by_fold[name] = model.fit_folds(folded, folds)
                continue
            except ValueError as problem:
                warnings.warn(f"base model failed, uniform scores used: {problem}", stacklevel=2)
                by_fold[name] = [Uniform()] * folds
                continue
        others = [folded.filter(F.col("fold") != f).drop("fold") for f in range(folds)]
        by_fold[name] = side_by_side(df.sparkSession, [partial(fit_or_uniform, make, rows) for rows in others])
    held = None
    for f in range(folds):
        part = base_probabilities({name: models[f] for name, models in by_fold.items()}, folded.filter(F.col("fold") == f))
        part = part.select(key, label, "fold", *[f"{m}_{p}" for m in makers for p in PROBS])
        held = part if held is None else held.unionByName(part)
    return measured(held, "held-scores")


def oof_stacking(df: DataFrame, makers: dict, label: str = "auto_label_id", folds: int = 5, key: str = "post_id", seed: int = 42,
                 meta_type: str = "boosted") -> Stacked:
    """Meta-model trained on scores from base models that never saw the scored fold; the base models are then fitted on all rows."""
    held = out_of_fold(df, makers, label, folds, key, seed)
    return Stacked({name: fit_or_uniform(make, df) for name, make in makers.items()}, label, meta_type, key=key, held=held).fit_meta(held)


def bootstrap_scores(train: DataFrame, score: DataFrame, features: list[str], label: str = "auto_label_id", rounds: int = 10, key: str = "post_id") -> DataFrame:
    """Long rows (post, model, p_*) of logistic models fitted on ``rounds`` seeded Poisson resamples, all in the same passes."""
    scored = Resampled(features, K, rounds, label=label, key=key).fit(train).scores(score)
    out = scored.select(key, F.concat(F.lit("round"), F.col("round").cast("string")).alias("model"), *[F.get("p", F.lit(i)).alias(p) for i, p in enumerate(PROBS)])
    return out.select(key, "model", argmax_id([F.col(p) for p in PROBS]).alias("label_id"), *PROBS)


def batch_score(model, df: DataFrame, text_col: str = "full_text", features: list[str] | None = None) -> DataFrame:
    """Probabilities, served label and confidence for a table of texts; with ``features`` also a map of those columns' values."""
    from sentiloom.functions.sentiment import explain_reason, threshold_classifier

    out = explain_reason(threshold_classifier(model.transform(df), text_col))
    if features is None:
        return out
    pairs = [x for c in features for x in (F.lit(c), F.col(c).cast("double"))]
    return out.withColumn("features", F.create_map(*pairs))
