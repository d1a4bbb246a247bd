"""Combining the predictions of several models, given as long rows (post_id, model, label_id, p_*)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentiloom.functions.sentiment import argmax_label
from sentiloom.schemas import LABEL_NAMES

PROBS = [f"p_{x}" for x in LABEL_NAMES]


def _weight(weights: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for name, value in weights.items():
        out = F.when(F.col("model") == name, value).otherwise(out)
    return out


def soft_vote(rows: DataFrame, weights: dict[str, float], key: str = "post_id") -> DataFrame:
    """Weighted mean of the class probabilities and its largest class; weights must sum to 1."""
    if not math.isclose(sum(weights.values()), 1.0, abs_tol=1e-8):
        raise ValueError("weights must sum to 1")
    mixed = rows.groupBy(key).agg(*[F.sum(_weight(weights) * F.col(p)).alias(p) for p in PROBS])
    return mixed.withColumn("prediction", argmax_label(*[F.col(p) for p in PROBS]))


def hard_vote(rows: DataFrame, key: str = "post_id") -> DataFrame:
    """Most frequent label, ties to the smallest id."""
    counted = rows.groupBy(key).agg(*[F.count_if(F.col("label_id") == i).alias(f"n{i}") for i in range(len(LABEL_NAMES))])
    names = [F.col(f"n{i}") for i in range(len(LABEL_NAMES))]
    best = F.greatest(*names)
    return counted.select(key, F.when(names[0] == best, 0).when(names[1] == best, 1).otherwise(2).alias("label_id"),
                          best.alias("votes"))


def model_contributions(rows: DataFrame, models: list[str], key: str = "post_id") -> DataFrame:
    """Each model's probabilities side by side."""
    return rows.groupBy(key).agg(*[
        F.max(F.when(F.col("model") == m, F.col(p))).alias(f"{m}_{p}") for m in models for p in PROBS])


def ensemble_uncertainty(rows: DataFrame, key: str = "post_id") -> DataFrame:
    """Mean over repeated predictions, its largest class, and the largest class deviation."""
    stats = rows.groupBy(key).agg(
        *[F.avg(p).alias(p) for p in PROBS], *[F.stddev_pop(p).alias(f"s_{p}") for p in PROBS])
    return stats.select(key, *PROBS, argmax_label(*[F.col(p) for p in PROBS]).alias("prediction"),
                        F.greatest(*[F.col(f"s_{p}") for p in PROBS]).alias("uncertainty"))
