"""Label statistics and checks."""

from pyspark.sql import functions as F

from sentiloom.operators import labeling as LB
from sentiloom.operators import sampling as SP
from sentiloom.plans.catalog.c_text import r6
from sentiloom.plans.registry import query


@query("labeling_stats", """
SELECT count(*) AS total_samples, count_if(auto_label = 'negative')::BIGINT AS negative_count,
 count_if(auto_label = 'neutral')::BIGINT AS neutral_count, count_if(auto_label = 'positive')::BIGINT AS positive_count,
 round(avg(label_confidence), 6) AS avg_confidence, round(avg(label_agreement), 6) AS avg_agreement,
 count_if(label_confidence > 0.7)::BIGINT AS high_confidence_samples,
 count_if(label_agreement >= 0.67)::BIGINT AS high_agreement_samples, count_if(label_agreement = 1)::BIGINT AS all_agree,
 count_if(label_agreement >= 0.67)::BIGINT AS two_agree, count_if(label_agreement < 0.67)::BIGINT AS no_agreement FROM labeled""",
       "labeled")
def _labeling_stats(v):
    out = LB.labeling_stats(v.labeled)
    return out.withColumns({c: F.round(c, 6) for c in ("avg_confidence", "avg_agreement")})


@query("filter_stats", """
SELECT is_high, auto_label, count(*) AS count, round(avg(label_confidence), 6) AS avg_confidence,
 round(avg(label_agreement), 6) AS avg_agreement, round(count(*) * 100.0 / (SELECT count(*) FROM labeled), 6) AS percentage
FROM (SELECT *, label_confidence >= 0.6 AND label_agreement >= 0.67 AS is_high FROM labeled) x
GROUP BY ROLLUP (is_high, auto_label)""", "labeled")
def _filter_stats(v):
    return LB.filter_stats(v.labeled).select(
        "is_high", "auto_label", "count", *r6("avg_confidence", "avg_agreement", "percentage"))


_Q = "quantile_cont({c}, {p})"


@query("suggest_thresholds", """
SELECT 'conservative' AS strategy, round(quantile_cont(label_confidence, 0.75), 6) AS min_confidence, 1.0::DOUBLE AS min_agreement,
 '~25%' AS expected_retention, round(quantile_cont(label_agreement, 0.75), 6) AS agreement_quantile FROM labeled
UNION ALL SELECT 'moderate', round(quantile_cont(label_confidence, 0.5), 6), 0.67, '~50%',
 round(quantile_cont(label_agreement, 0.5), 6) FROM labeled
UNION ALL SELECT 'aggressive', round(quantile_cont(label_confidence, 0.25), 6), 0.67, '~75%',
 round(quantile_cont(label_agreement, 0.25), 6) FROM labeled""", "labeled")
def _suggest_thresholds(v):
    return LB.suggest_thresholds(v.labeled).select(
        "strategy", *r6("min_confidence"), "min_agreement", "expected_retention", *r6("agreement_quantile"))


_SHARES = """SELECT *, (abs(negative_share - 0.33) + abs(neutral_share - 0.34) + abs(positive_share - 0.33)) / 3 AS avg_divergence
FROM (SELECT count_if(auto_label = 'negative')::DOUBLE / count(*) AS negative_share,
 count_if(auto_label = 'neutral')::DOUBLE / count(*) AS neutral_share,
 count_if(auto_label = 'positive')::DOUBLE / count(*) AS positive_share FROM labeled) s"""


@query("label_distribution_check", f"""
SELECT round(negative_share, 6) AS negative_share, round(neutral_share, 6) AS neutral_share,
 round(positive_share, 6) AS positive_share, round(avg_divergence, 6) AS avg_divergence, avg_divergence < 0.2 AS is_valid,
 CASE WHEN avg_divergence < 0.2 THEN 'Distribution is acceptable' ELSE 'Distribution is skewed' END AS message
FROM ({_SHARES}) x""", "labeled")
def _label_distribution_check(v):
    return LB.label_distribution_check(v.labeled).select(
        *r6("negative_share", "neutral_share", "positive_share", "avg_divergence"), "is_valid", "message")


_PAIRS = """
SELECT 'textblob_prediction_vs_vader_prediction' AS pair, textblob_prediction AS a, vader_prediction AS b FROM labeled
UNION ALL SELECT 'textblob_prediction_vs_finbert_prediction', textblob_prediction, finbert_prediction FROM labeled
UNION ALL SELECT 'vader_prediction_vs_finbert_prediction', vader_prediction, finbert_prediction FROM labeled"""
_KAPPA = f"""
SELECT o.pair, (po - pe) / (1 - pe) AS kappa
FROM (SELECT pair, count_if(a = b)::DOUBLE / count(*) AS po FROM ({_PAIRS}) p GROUP BY pair) o
JOIN (SELECT x.pair, sum(x.share * y.share) AS pe
 FROM (SELECT pair, a AS l, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY pair) AS share FROM ({_PAIRS}) p GROUP BY pair, a) x
 JOIN (SELECT pair, b AS l, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY pair) AS share FROM ({_PAIRS}) p GROUP BY pair, b) y
 ON x.pair = y.pair AND x.l = y.l GROUP BY x.pair) e ON e.pair = o.pair"""


@query("pairwise_kappa", f"SELECT pair, round(kappa, 6) AS kappa FROM ({_KAPPA}) k", "labeled")
def _pairwise_kappa(v):
    return LB.pairwise_kappa(v.labeled).select("pair", *r6("kappa"))


_LEVEL = """CASE WHEN k > 0.8 THEN 'Almost perfect agreement' WHEN k > 0.6 THEN 'Substantial agreement'
 WHEN k > 0.4 THEN 'Moderate agreement' WHEN k > 0.2 THEN 'Fair agreement' ELSE 'Slight agreement' END"""


@query("kappa_summary", f"SELECT round(k, 6) AS average_kappa, {_LEVEL} AS interpretation FROM (SELECT avg(kappa) AS k FROM ({_KAPPA}) x) y",
       "labeled")
def _kappa_summary(v):
    return LB.kappa_summary(LB.pairwise_kappa(v.labeled)).select(*r6("average_kappa"), "interpretation")


_CONF = """SELECT avg(label_confidence) AS mean, stddev_samp(label_confidence) AS std, min(label_confidence) AS min,
 max(label_confidence) AS max, quantile_cont(label_confidence, 0.25) AS q25, median(label_confidence) AS median,
 quantile_cont(label_confidence, 0.75) AS q75 FROM labeled"""


@query("confidence_distribution", f"""
SELECT round(mean, 6) AS mean, round(std, 6) AS std, min, max, round(q25, 6) AS q25, round(median, 6) AS median,
 round(q75, 6) AS q75, mean > 0.5 AND std < 0.3 AND median > 0.5 AS is_healthy FROM ({_CONF}) c""", "labeled")
def _confidence_distribution(v):
    return LB.confidence_distribution(v.labeled).select(
        *r6("mean", "std"), "min", "max", *r6("q25", "median", "q75"), "is_healthy")


@query("label_qa_report", f"""
SELECT (SELECT count(*) FROM labeled) AS sample_size, (SELECT count(DISTINCT auto_label) FROM labeled) AS unique_labels,
 d.avg_divergence < 0.2 AS distribution_valid, round(k.k, 6) AS average_kappa,
 c.mean > 0.5 AND c.std < 0.3 AND c.median > 0.5 AS confidence_healthy,
 CASE WHEN d.avg_divergence < 0.2 AND k.k > 0.4 AND c.mean > 0.5 AND c.std < 0.3 AND c.median > 0.5 THEN 'PASSED'
  ELSE 'NEEDS_REVIEW' END AS overall_status
FROM ({_SHARES}) d, (SELECT avg(kappa) AS k FROM ({_KAPPA}) x) k, ({_CONF}) c""", "labeled")
def _label_qa_report(v):
    return LB.label_qa_report(v.labeled).withColumn("average_kappa", F.round("average_kappa", 6))


@query("class_weights", """
SELECT auto_label_id, count, round(n / (k * count), 6) AS balanced_weight,
 round(1.0::DOUBLE / (count + 1e-6) / inv * k, 6) AS inverse_weight
FROM (SELECT *, sum(count) OVER ()::DOUBLE AS n, count(*) OVER () AS k, sum(1.0::DOUBLE / (count + 1e-6)) OVER () AS inv
 FROM (SELECT auto_label_id, count(*) AS count FROM labeled GROUP BY auto_label_id) c) d""", "labeled")
def _class_weights(v):
    return SP.class_weights(v.labeled, "auto_label_id").select(
        "auto_label_id", "count", *r6("balanced_weight", "inverse_weight"))


_SPLIT = """(SELECT *, CASE WHEN r <= floor(n * 0.15 + 0.5) THEN 'test' WHEN r <= floor(n * 0.15 + 0.5) * 2 THEN 'val' ELSE 'train' END AS split,
 (r - 1) % 5 AS fold FROM (SELECT post_id, auto_label_id, row_number() OVER (PARTITION BY auto_label_id ORDER BY md5('42|' || post_id), post_id) AS r,
 count(*) OVER (PARTITION BY auto_label_id) AS n FROM labeled) x) y"""


@query("stratified_split", f"SELECT post_id, auto_label_id, split FROM {_SPLIT}", "labeled")
def _stratified_split(v):
    return SP.stratified_split(v.labeled.select("post_id", "auto_label_id"), "auto_label_id")


@query("stratified_kfold", f"SELECT post_id, auto_label_id, fold::INT AS fold FROM {_SPLIT}", "labeled")
def _stratified_kfold(v):
    return SP.stratified_kfold(v.labeled.select("post_id", "auto_label_id"), "auto_label_id")


@query("split_label_distribution", f"SELECT split, auto_label_id, count(*) AS count FROM {_SPLIT} GROUP BY split, auto_label_id", "labeled")
def _split_label_distribution(v):
    return SP.split_label_distribution(
        SP.stratified_split(v.labeled.select("post_id", "auto_label_id"), "auto_label_id"), "auto_label_id")


@query("union_train_val", f"SELECT post_id, split FROM {_SPLIT} WHERE split <> 'test'", "labeled")
def _union_train_val(v):
    split = SP.stratified_split(v.labeled.select("post_id", "auto_label_id"), "auto_label_id").select("post_id", "split")
    return SP.union_train_val(split.filter("split = 'train'"), split.filter("split = 'val'"))
