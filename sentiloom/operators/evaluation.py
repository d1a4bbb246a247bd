"""Classification metrics from one contingency table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentiloom.operators.ranking import running_totals
from sentiloom.schemas import LABEL_NAMES

MIN_ACCURACY, MIN_F1 = 0.80, 0.75  # fixed values
COMPARED = ["accuracy", "f1_weighted", "precision_weighted", "recall_weighted"]


def _safe(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def confusion_matrix(df: DataFrame, keys: list[str] = (), k: int = 3) -> DataFrame:
    """Counts by (true, predicted) for all k*k cells, absent ones as 0.

    The cells are counted map-side; the grid is made from the counts, not by a join.
    """
    cells = [(i, j) for i in range(k) for j in range(k)]
    wide = df.groupBy(*keys).agg(*[
        F.count_if((F.col("y_true") == i) & (F.col("y_pred") == j)).alias(f"c{i}_{j}") for i, j in cells])
    return wide.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(i).alias("y_true"), F.lit(j).alias("y_pred"), F.col(f"c{i}_{j}").alias("count"))
        for i, j in cells])))


def per_class_metrics(matrix: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support of each class; 0 where undefined.

    Every cell adds to its row's class and to its column's class, so one grouping does both.
    """
    n, zero = F.col("count"), F.lit(0).cast("bigint")
    hit = F.when(F.col("y_true") == F.col("y_pred"), n).otherwise(zero)
    sides = F.array(
        F.struct(F.col("y_true").alias("label_id"), n.alias("s"), hit.alias("h"), zero.alias("p")),
        F.struct(F.col("y_pred").alias("label_id"), zero.alias("s"), zero.alias("h"), n.alias("p")))
    out = matrix.select(*keys, F.inline(sides)).groupBy(*keys, "label_id").agg(
        F.sum("s").alias("support"), F.sum("h").alias("hits"), F.sum("p").alias("predicted"))
    out = out.withColumns({"precision": _safe(F.col("hits"), F.col("predicted")),
                           "recall": _safe(F.col("hits"), F.col("support"))})
    return out.withColumn("f1", _safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def _average_columns() -> list[Column]:
    n, occurs = F.sum("support"), (F.col("support") > 0) | (F.col("predicted") > 0)
    measures = ("precision", "recall", "f1")
    return [
        _safe(F.sum("hits"), n).alias("accuracy"),
        *[F.avg(F.when(occurs, F.col(m))).alias(f"{m}_macro") for m in measures],
        *[F.try_divide(F.sum(F.col(m) * F.col("support")), n.cast("double")).alias(f"{m}_weighted") for m in measures],
        n.alias("support"),
    ]


def _agreement_columns() -> list[Column]:
    t, p = F.col("support").cast("double"), F.col("predicted").cast("double")
    c, s, tp, tt, pp = (F.sum(x) for x in (F.col("hits").cast("double"), t, t * p, t * t, p * p))
    chance = F.try_divide(tp, s * s)
    return [
        F.try_divide(F.try_divide(c, s) - chance, 1 - chance).alias("cohen_kappa"),
        F.try_divide(c * s - tp, F.sqrt((s * s - pp) * (s * s - tt))).alias("matthews_corrcoef"),
    ]


def classification_metrics(matrix: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Accuracy and macro/weighted precision, recall, F1 (macro over labels that occur)."""
    return per_class_metrics(matrix, keys).groupBy(*keys).agg(*_average_columns())


def kappa_mcc(matrix: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Cohen kappa and the multiclass Matthews coefficient; undefined (0/0) gives null."""
    return per_class_metrics(matrix, keys).groupBy(*keys).agg(*_agreement_columns())


def roc_auc_ovr(df: DataFrame, keys: list[str] = ()) -> DataFrame:
    """One-vs-rest AUC per class and its mean weighted by prevalence.

    Rows are counted per (class, score) first; ties count one half.
    """
    keys = list(keys)
    long = df.select(*keys, "y_true", F.explode(F.array(*[
        F.struct(F.lit(i).alias("label_id"), F.col(f"p_{x}").alias("p")) for i, x in enumerate(LABEL_NAMES)
    ])).alias("e")).select(*keys, "e.label_id", "e.p", (F.col("y_true") == F.col("e.label_id")).alias("hit"))
    counted = long.groupBy(*keys, "label_id", "p").agg(
        F.count_if("hit").alias("pos"), F.count_if(~F.col("hit")).alias("neg"))
    runs = running_totals(counted, [*keys, "label_id"], ["p"], ["pos", "neg"])
    wins = F.col("pos") * (F.col("cum_neg") - F.col("neg") + 0.5 * F.col("neg"))
    return runs.groupBy(*keys, "label_id").agg(
        F.try_divide(F.sum(wins), (F.max("all_pos") * F.max("all_neg")).cast("double")).alias("auc"),
        F.max("all_pos").alias("positives"))


def roc_auc(df: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Weighted one-vs-rest AUC; with only two true labels, the AUC of class 1."""
    per_class = roc_auc_ovr(df, keys)
    present = F.count_if(F.col("positives") > 0)
    weighted = F.try_divide(F.sum(F.col("auc") * F.col("positives")), F.sum(F.when(F.col("auc").isNotNull(), F.col("positives"))))
    binary = F.max(F.when(F.col("label_id") == 1, F.col("auc")))
    return per_class.groupBy(*keys).agg(F.when(present == 2, binary).otherwise(weighted).alias("roc_auc"))


def all_metrics(df: DataFrame, keys: list[str]) -> DataFrame:
    """Every scalar metric in one row per key."""
    classes = per_class_metrics(confusion_matrix(df, keys), keys)
    return classes.groupBy(*keys).agg(*_average_columns(), *_agreement_columns()).join(roc_auc(df, keys), keys, "left")


def flatten_metrics(scalars: DataFrame, classes: DataFrame, keys: list[str]) -> DataFrame:
    """(key..., metric_name, metric_value) rows; class metrics become per_class.<class>.<metric>."""
    names = [c for c in scalars.columns if c not in keys]
    flat = scalars.select(*keys, F.explode(F.create_map(*[
        x for c in names for x in (F.lit(c), F.col(c).cast("double"))])).alias("metric_name", "metric_value"))
    label = F.element_at(F.array(*[F.lit(x) for x in LABEL_NAMES]), F.col("label_id") + 1)
    nested = classes.select(*keys, F.explode(F.create_map(*[
        x for m in ("precision", "recall", "f1")
        for x in (F.concat(F.lit("per_class."), label, F.lit("." + m)), F.col(m))])).alias("metric_name", "metric_value"))
    return flat.unionByName(nested)


def model_gate(scalars: DataFrame, min_accuracy: float = MIN_ACCURACY, min_f1: float = MIN_F1) -> DataFrame:
    return scalars.withColumn("passed", (F.col("accuracy") >= min_accuracy) & (F.col("f1_weighted") >= min_f1))


def confidence_bands(df: DataFrame, keys: list[str] = ()) -> DataFrame:
    best = F.greatest(*[F.col(f"p_{x}") for x in LABEL_NAMES])
    return df.groupBy(*keys).agg(
        F.avg(best).alias("avg_confidence"), F.count_if(best > 0.8).alias("high"),
        F.count_if((best > 0.6) & (best <= 0.8)).alias("medium"), F.count_if(best <= 0.6).alias("low"))


def compare_models(metric_rows: DataFrame, metrics: list[str] = COMPARED) -> DataFrame:
    """One row per model, missing metrics 0.0, best weighted F1 first."""
    wide = metric_rows.groupBy("model").pivot("metric_name", metrics).agg(F.first("metric_value", True)).fillna(0.0, metrics)
    best = wide.select(F.max("f1_weighted")).scalar()
    return wide.withColumn("is_best", F.col("f1_weighted") == best).orderBy(F.desc("f1_weighted"), "model")


def cv_summary(scores: DataFrame, keys: list[str] = ("model",)) -> DataFrame:
    """Mean, population deviation, extremes and best fold of fold scores."""
    return scores.groupBy(*keys).agg(
        F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.min("score").alias("min"),
        F.max("score").alias("max"), F.max_by("fold", F.struct("score", -F.col("fold"))).alias("best_fold"))
