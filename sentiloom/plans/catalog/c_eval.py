"""Evaluation of scored posts."""

from pyspark.sql import functions as F

from sentiloom.operators import evaluation as E
from sentiloom.operators import joins as J
from sentiloom.operators.sampling import stratified_kfold
from sentiloom.plans.catalog.c_labels import _SPLIT  # noqa: F401
from sentiloom.plans.catalog.c_text import r6
from sentiloom.plans.registry import query

KEY = ["model"]
_CELLS = """(SELECT m.model, a.i AS y_true, b.i AS y_pred, (SELECT count(*) FROM scored s WHERE s.model = m.model AND s.y_true = a.i AND s.y_pred = b.i) AS count
 FROM (SELECT DISTINCT model FROM scored) m, (VALUES (0), (1), (2)) a(i), (VALUES (0), (1), (2)) b(i)) cells"""
_CLASS = f"""(SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1
 FROM (SELECT t.model, t.l AS label_id, support, predicted, hits, coalesce(hits::DOUBLE / nullif(predicted, 0), 0) AS precision,
  coalesce(hits::DOUBLE / nullif(support, 0), 0) AS recall
  FROM (SELECT model, y_true AS l, sum(count)::BIGINT AS support, sum(CASE WHEN y_true = y_pred THEN count ELSE 0 END)::BIGINT AS hits FROM {_CELLS} GROUP BY model, y_true) t
  JOIN (SELECT model, y_pred AS l, sum(count)::BIGINT AS predicted FROM {_CELLS} GROUP BY model, y_pred) p ON p.model = t.model AND p.l = t.l) q) cls"""
_SCALAR = f"""(SELECT model, sum(hits)::DOUBLE / sum(support) AS accuracy, avg(precision) AS precision_macro, avg(recall) AS recall_macro,
 avg(f1) AS f1_macro, sum(precision * support) / sum(support) AS precision_weighted, sum(recall * support) / sum(support) AS recall_weighted,
 sum(f1 * support) / sum(support) AS f1_weighted, sum(support)::BIGINT AS support FROM {_CLASS} WHERE support > 0 OR predicted > 0 GROUP BY model) sc"""
_NAMES = ["accuracy", "precision_macro", "recall_macro", "f1_macro", "precision_weighted", "recall_weighted", "f1_weighted"]


@query("align_labels", "SELECT t.post_id, t.y_true, l.auto_label_id AS y_pred FROM truth t JOIN labeled l USING (post_id)", "truth labeled")
def _align_labels(v):
    return J.align_labels(v.truth, v.labeled.select("post_id", F.col("auto_label_id").alias("y_pred")))


@query("confusion_matrix", f"SELECT * FROM {_CELLS}", "scored")
def _confusion_matrix(v):
    return E.confusion_matrix(v.scored, KEY)


@query("per_class_metrics", f"SELECT model, label_id, support, predicted, hits, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM {_CLASS}", "scored")
def _per_class_metrics(v):
    return E.per_class_metrics(E.confusion_matrix(v.scored, KEY), KEY).select(
        "model", "label_id", "support", "predicted", "hits", *r6("precision", "recall", "f1"))


@query("classification_metrics", f"SELECT model, support, {', '.join(f'round({n}, 6) AS {n}' for n in _NAMES)} FROM {_SCALAR}", "scored")
def _classification_metrics(v):
    return E.classification_metrics(E.confusion_matrix(v.scored, KEY), KEY).select("model", "support", *r6(*_NAMES))


_KM = f"""(SELECT model, (c / s - tp / (s * s)) / nullif(1 - tp / (s * s), 0) AS cohen_kappa,
 (c * s - tp) / nullif(sqrt((s * s - pp) * (s * s - tt)), 0) AS matthews_corrcoef
FROM (SELECT model, sum(hits)::DOUBLE AS c, sum(support)::DOUBLE AS s, sum(support * predicted)::DOUBLE AS tp,
 sum(support * support)::DOUBLE AS tt, sum(predicted * predicted)::DOUBLE AS pp FROM {_CLASS} GROUP BY model) z) km"""


@query("kappa_mcc", f"SELECT model, round(cohen_kappa, 6) AS cohen_kappa, round(matthews_corrcoef, 6) AS matthews_corrcoef FROM {_KM}", "scored")
def _kappa_mcc(v):
    return E.kappa_mcc(E.confusion_matrix(v.scored, KEY), KEY).select("model", *r6("cohen_kappa", "matthews_corrcoef"))


# mean rank of ties, straight over the rows
_AUC = """(SELECT model, label_id, (sum(CASE WHEN hit THEN r END) - n1 * (n1 + 1) / 2.0) / (n1 * n0) AS auc, n1 AS positives
 FROM (SELECT *, rank() OVER (PARTITION BY model, label_id ORDER BY p) + (count(*) OVER (PARTITION BY model, label_id, p) - 1) / 2.0 AS r,
  sum(hit::INT) OVER (PARTITION BY model, label_id)::DOUBLE AS n1, sum((NOT hit)::INT) OVER (PARTITION BY model, label_id)::DOUBLE AS n0
  FROM (SELECT model, 0 AS label_id, p_negative AS p, y_true = 0 AS hit FROM scored UNION ALL SELECT model, 1, p_neutral, y_true = 1 FROM scored
   UNION ALL SELECT model, 2, p_positive, y_true = 2 FROM scored) u) w GROUP BY model, label_id, n1, n0) auc"""


@query("roc_auc_ovr", f"""SELECT model, label_id, round(auc, 6) AS auc, positives::BIGINT AS positives FROM {_AUC}
UNION ALL SELECT model, -1, round(sum(auc * positives) / sum(positives), 6), NULL FROM {_AUC} GROUP BY model""", "scored")
def _roc_auc_ovr(v):
    per_class = E.roc_auc_ovr(v.scored, KEY).select("model", "label_id", *r6("auc"), "positives")
    total = E.roc_auc(v.scored, KEY).select("model", F.lit(-1).alias("label_id"), F.round("roc_auc", 6).alias("auc"),
                                            F.lit(None).cast("bigint").alias("positives"))
    return per_class.unionByName(total)


_FLAT = f"""(SELECT model, unnest(['{"', '".join(_NAMES)}']) AS metric_name, unnest([{', '.join(_NAMES)}]) AS metric_value FROM {_SCALAR}
 UNION ALL SELECT model, 'per_class.' || (['negative', 'neutral', 'positive'])[label_id + 1] || '.' || unnest(['precision', 'recall', 'f1']),
 unnest([precision, recall, f1]) FROM {_CLASS}) flat"""


@query("flatten_metrics", f"SELECT model, metric_name, round(metric_value, 6) AS metric_value FROM {_FLAT}", "scored")
def _flatten_metrics(v):
    matrix = E.confusion_matrix(v.scored, KEY)
    scalars = E.classification_metrics(matrix, KEY).drop("support")
    return E.flatten_metrics(scalars, E.per_class_metrics(matrix, KEY), KEY).select("model", "metric_name", *r6("metric_value"))


@query("metrics_udaf", f"""SELECT model, {', '.join(f'round({n}, 6) AS {n}' for n in _NAMES)}, round(cohen_kappa, 6) AS cohen_kappa,
 round(matthews_corrcoef, 6) AS matthews_corrcoef, round(roc_auc, 6) AS roc_auc FROM {_SCALAR} JOIN {_KM} USING (model)
 JOIN (SELECT model, sum(auc * positives) / sum(positives) AS roc_auc FROM {_AUC} GROUP BY model) a USING (model)""", "scored")
def _metrics_udaf(v):
    return E.all_metrics(v.scored, KEY).select("model", *r6(*_NAMES, "cohen_kappa", "matthews_corrcoef", "roc_auc"))


@query("model_gate", f"""SELECT model, round(accuracy, 6) AS accuracy, round(f1_weighted, 6) AS f1_weighted,
 accuracy >= 0.8 AND f1_weighted >= 0.75 AS passed FROM {_SCALAR}""", "scored")
def _model_gate(v):
    gate = E.model_gate(E.classification_metrics(E.confusion_matrix(v.scored, KEY), KEY))
    return gate.select("model", *r6("accuracy", "f1_weighted"), "passed")


@query("confidence_bands", """SELECT model, round(avg(b), 6) AS avg_confidence, count_if(b > 0.8)::BIGINT AS high,
 count_if(b > 0.6 AND b <= 0.8)::BIGINT AS medium, count_if(b <= 0.6)::BIGINT AS low
FROM (SELECT model, greatest(p_negative, p_neutral, p_positive) AS b FROM scored) x GROUP BY model""", "scored")
def _confidence_bands(v):
    return E.confidence_bands(v.scored, KEY).select("model", *r6("avg_confidence"), "high", "medium", "low")


@query("compare_models", f"""SELECT model, round(accuracy, 6) AS accuracy, round(f1_weighted, 6) AS f1_weighted,
 round(precision_weighted, 6) AS precision_weighted, round(recall_weighted, 6) AS recall_weighted,
 f1_weighted = max(f1_weighted) OVER () AS is_best FROM {_SCALAR} ORDER BY f1_weighted DESC, model""", "scored")
def _compare_models(v):
    matrix = E.confusion_matrix(v.scored, KEY)
    rows = E.flatten_metrics(E.classification_metrics(matrix, KEY).drop("support"), E.per_class_metrics(matrix, KEY), KEY)
    return E.compare_models(rows).select("model", *r6(*E.COMPARED), "is_best")


_FOLDS = """(SELECT model, fold, avg((y_true = y_pred)::INT) AS score FROM (SELECT s.*, (row_number() OVER (PARTITION BY s.model, s.y_true
 ORDER BY md5('42|' || s.post_id || '|' || s.model), s.post_id) - 1) % 5 AS fold FROM scored s) x GROUP BY model, fold) f"""


@query("cv_summary", f"""SELECT model, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, round(min(score), 6) AS min,
 round(max(score), 6) AS max FROM {_FOLDS} GROUP BY model""", "scored")
def _cv_summary(v):
    keyed = v.scored.withColumns({"stratum": F.concat_ws("|", "model", F.col("y_true").cast("string")),
                                  "row_id": F.concat_ws("|", "post_id", "model")})
    folded = stratified_kfold(keyed, "stratum", key="row_id")
    scores = folded.groupBy("model", "fold").agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("int")).alias("score"))
    return E.cv_summary(scores).select("model", *r6("mean", "std", "min", "max"))
