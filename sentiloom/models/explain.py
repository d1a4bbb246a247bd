"""Contributions of linear models and permutation importance."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentiloom.models.classifiers import as_double
from sentiloom.operators.ranking import with_position
from sentiloom.operators.sampling import seeded


def fit_linear(df: DataFrame, features: list[str], label: str = "auto_label_id", max_iter: int = 50):
    """Imputed numeric features into a multinomial logistic regression."""
    stages = [Imputer(strategy="mean", inputCols=features, outputCols=features),
              VectorAssembler(inputCols=features, outputCol="_features"),
              LogisticRegression(featuresCol="_features", labelCol=label, family="multinomial", maxIter=max_iter, regParam=0.01)]
    return Pipeline(stages=stages).fit(as_double(df, features))


def linear_contributions(df: DataFrame, model, features: list[str], class_id: int, key: str = "post_id") -> DataFrame:
    """(key, feature, contribution) with contribution = coefficient * (x - mean x).

    A row's contributions add up to its margin minus the margin of the mean row.
    """
    imputed = model.stages[0].transform(as_double(df, features))
    coefficients = model.stages[-1].coefficientMatrix.toArray()[class_id]
    means = imputed.agg(*[F.avg(c).alias(c) for c in features])
    rows = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).alias("value"),
                 (float(coefficients[i]) * (F.col(c) - means.select(c).scalar())).alias("contribution"))
        for i, c in enumerate(features)])
    return imputed.select(key, F.inline(rows))


def global_contributions(contributions: DataFrame) -> DataFrame:
    return contributions.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("importance")).orderBy(
        F.desc("importance"), "feature")


def top_contributions(contributions: DataFrame, n: int = 5, key: str = "post_id") -> DataFrame:
    """Each row's ``n`` features of largest absolute contribution (a row has as many entries as the model has features)."""
    entry = F.struct((-F.abs("contribution")).alias("order"), "feature", "contribution")
    best = contributions.groupBy(key).agg(F.slice(F.array_sort(F.collect_list(entry)), 1, n).alias("e"))
    return best.select(key, F.posexplode("e").alias("rank", "e")).select(
        key, (F.col("rank") + 1).alias("rank"), "e.feature", "e.contribution")


def permutation_importance(df: DataFrame, score, features: list[str], label: str = "auto_label_id", key: str = "post_id",
                           seed: int = 42) -> DataFrame:
    """Drop in accuracy when one feature's values are dealt out to other rows.

    ``score`` maps a table to one with ``label_id``.  Rows get the values of the row at the
    same position in a shuffled order: a join on unique positions.
    """
    placed = with_position(df, [key], "_pos")
    donors = with_position(df.withColumn("_h", seeded(seed, key)), ["_h", key], "_pos").select(
        "_pos", *[F.col(c).alias(f"_new_{c}") for c in features])
    both = placed.join(donors, "_pos").persist()
    hit = F.avg((F.col("label_id") == F.col(label)).cast("double"))
    base = score(both.drop("_pos", *[f"_new_{c}" for c in features])).agg(hit.alias("accuracy")).first()["accuracy"]
    parts = None
    for c in features:
        changed = both.withColumn(c, F.col(f"_new_{c}")).drop("_pos", *[f"_new_{x}" for x in features])
        part = score(changed).agg(F.lit(c).alias("feature"), (F.lit(base) - hit).alias("importance"))
        parts = part if parts is None else parts.unionByName(part)
    return parts
