"""Prediction-log roll-ups, windows and drift."""

from pyspark.sql import functions as F

from sentiloom.operators import drift as D
from sentiloom.operators import monitoring as M
from sentiloom.plans.catalog.c_text import r6
from sentiloom.plans.registry import query

_METRICS = """count(*) AS total_predictions, round(avg(response_time_ms), 6) AS average_response_time_ms,
 count_if(success AND sentiment_label = 'negative')::BIGINT AS negative, count_if(success AND sentiment_label = 'neutral')::BIGINT AS neutral,
 count_if(success AND sentiment_label = 'positive')::BIGINT AS positive, count_if(NOT success)::BIGINT AS error_count,
 round(count_if(NOT success)::DOUBLE / greatest(count(*), 1), 6) AS error_rate"""


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


@query("prediction_metrics", f"SELECT model_name, {_METRICS} FROM predictions GROUP BY model_name", "predictions")
def _prediction_metrics(v):
    return rounded(M.prediction_metrics(v.predictions, ["model_name"]), "average_response_time_ms", "error_rate")


@query("daily_metrics", f"SELECT date_trunc('day', predicted_at)::TIMESTAMP AS day, {_METRICS} FROM predictions GROUP BY 1", "predictions")
def _daily_metrics(v):
    out = rounded(M.daily_metrics(v.predictions), "average_response_time_ms", "error_rate")
    return out.withColumn("day", F.col("day").cast("timestamp_ntz"))


@query("hourly_metrics", """
SELECT h.hour, coalesce(predictions, 0) AS predictions, round(avg_ms, 6) AS avg_response_time_ms, coalesce(error_count, 0) AS error_count,
 coalesce(negative, 0) AS negative, coalesce(neutral, 0) AS neutral, coalesce(positive, 0) AS positive
FROM (SELECT unnest(range(TIMESTAMP '2023-12-31 20:00:00', TIMESTAMP '2024-02-01 20:00:00', INTERVAL 1 HOUR)) AS hour) h
LEFT JOIN (SELECT date_trunc('hour', predicted_at) AS hour, count(*) AS predictions, avg(response_time_ms) AS avg_ms,
 count_if(NOT success)::BIGINT AS error_count, count_if(success AND sentiment_label = 'negative')::BIGINT AS negative,
 count_if(success AND sentiment_label = 'neutral')::BIGINT AS neutral, count_if(success AND sentiment_label = 'positive')::BIGINT AS positive
 FROM predictions GROUP BY 1) p ON p.hour = h.hour""", "predictions")
def _hourly_metrics(v):
    out = M.hourly_metrics(v.predictions, "2023-12-31 20:00:00", 24 * 32)
    return rounded(out, "avg_response_time_ms").withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query("latency_percentiles", """
SELECT model_name, min(CASE WHEN r = least(floor(n * 0.5), n - 1) THEN x END) AS p50,
 min(CASE WHEN r = least(floor(n * 0.95::DOUBLE), n - 1) THEN x END) AS p95, min(CASE WHEN r = least(floor(n * 0.99::DOUBLE), n - 1) THEN x END) AS p99,
 min(x) AS min, max(x) AS max
FROM (SELECT model_name, response_time_ms AS x, row_number() OVER (PARTITION BY model_name ORDER BY response_time_ms) - 1 AS r,
 count(*) OVER (PARTITION BY model_name) AS n FROM predictions) y GROUP BY model_name""", "predictions")
def _latency_percentiles(v):
    return M.latency_percentiles(v.predictions)


@query("feed_metrics", """
SELECT count(*) AS total, count_if(sentiment_label = 'negative')::BIGINT AS negative, count_if(sentiment_label = 'neutral')::BIGINT AS neutral,
 count_if(sentiment_label = 'positive')::BIGINT AS positive, round(count_if(sentiment_label = 'negative')::DOUBLE / count(*), 6) AS negative_share,
 round(count_if(sentiment_label = 'neutral')::DOUBLE / count(*), 6) AS neutral_share,
 round(count_if(sentiment_label = 'positive')::DOUBLE / count(*), 6) AS positive_share, round(avg(confidence_score), 6) AS avg_confidence
FROM predictions""", "predictions")
def _feed_metrics(v):
    return rounded(M.feed_metrics(v.predictions), "negative_share", "neutral_share", "positive_share", "avg_confidence")


@query("batch_summary", """
SELECT api_key AS batch_id, count(*) AS total_predictions, round(avg(confidence_score), 6) AS average_confidence,
 count_if(sentiment_label = 'negative')::BIGINT AS negative, count_if(sentiment_label = 'positive')::BIGINT AS positive,
 round(sum(response_time_ms), 4) AS total_time_ms FROM predictions GROUP BY api_key""", "predictions")
def _batch_summary(v):
    out = M.batch_summary(v.predictions.withColumnRenamed("api_key", "batch_id"))
    return out.select("batch_id", "total_predictions", *r6("average_confidence"), F.col("label_distribution")["negative"].alias("negative"),
                      F.col("label_distribution")["positive"].alias("positive"), F.round("total_time_ms", 4).alias("total_time_ms"))


@query("dashboard_rollups", """
SELECT count(*) AS predictions_24h, round(avg(confidence_score), 6) AS avg_confidence,
 round(count_if(NOT success)::DOUBLE / count(*), 6) AS error_share,
 count(DISTINCT CASE WHEN predicted_at > TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 5 MINUTE THEN api_key END) AS active_keys_5m
FROM predictions WHERE predicted_at > TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 24 HOUR AND predicted_at <= TIMESTAMP '2024-01-20 12:00:00'""",
       "predictions")
def _dashboard_rollups(v):
    return rounded(M.dashboard_rollups(v.predictions, "2024-01-20 12:00:00"), "avg_confidence", "error_share")


@query("rolling_latency", """
SELECT prediction_id, model_name, round(avg(response_time_ms) OVER (PARTITION BY model_name ORDER BY predicted_at, prediction_id
 ROWS BETWEEN 999 PRECEDING AND CURRENT ROW) + 1e-8, 6) AS rolling_response FROM predictions""", "predictions")
def _rolling_latency(v):
    slim = v.predictions.select("prediction_id", "model_name", "predicted_at", "response_time_ms")
    # the added 1e-8, on both sides, keeps means that lie exactly between two roundings from hanging on their last bit
    return M.rolling_latency(slim).select("prediction_id", "model_name", F.round(F.col("rolling_response_ms") + 1e-8, 6).alias("rolling_response"))


@query("accuracy_last_100", """
SELECT prediction_id, model_name, round(avg((y_true = y_pred)::INT) OVER (PARTITION BY model_name ORDER BY predicted_at, prediction_id
 ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 6) AS rolling_accuracy
FROM (SELECT p.*, t.y_true, CASE sentiment_label WHEN 'negative' THEN 0 WHEN 'neutral' THEN 1 ELSE 2 END AS y_pred
 FROM predictions p JOIN truth t USING (post_id)) x""", "predictions truth")
def _accuracy_last_100(v):
    from sentiloom.functions.sentiment import label_id

    joined = v.predictions.select("prediction_id", "post_id", "model_name", "predicted_at", label_id(F.col("sentiment_label")).alias("y_pred")) \
        .join(v.truth, "post_id")
    return M.rolling_accuracy(joined).select("prediction_id", "model_name", *r6("rolling_accuracy"))


@query("rate_limit_audit", """
SELECT request_id, client, n AS calls_in_window, n > 100 AS over_limit FROM (SELECT *, count(*) OVER (PARTITION BY client ORDER BY ts
 RANGE BETWEEN INTERVAL 60 SECOND PRECEDING AND CURRENT ROW) AS n FROM requests) x""", "requests")
def _rate_limit_audit(v):
    calls = v.requests.withColumn("ts", F.col("ts").cast("timestamp"))
    return M.rate_limit_audit(calls).select("request_id", "client", "calls_in_window", "over_limit")


@query("rate_limit_decisions", None)
def _rate_limit_decisions(v):
    return M.rate_limit_decisions(v.requests.withColumn("ts", F.col("ts").cast("timestamp"))).select("request_id", "client", "accepted")


@query("alert_hold", """
SELECT model_name, min(slot) AS since, max(slot) AS until, count(*) AS slots FROM (
 SELECT *, slot - INTERVAL 1 HOUR * row_number() OVER (PARTITION BY model_name ORDER BY slot) AS island
 FROM error_series WHERE error_rate > 0.15) x GROUP BY model_name, island HAVING count(*) >= 3""", "error_series")
def _alert_hold(v):
    out = M.alert_hold(v.error_series, F.col("error_rate") > 0.15, hold_seconds=3 * 3600, step_seconds=3600)
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("since", "until")})


# --- drift ---------------------------------------------------------------------------

@query("reference_stats", """
SELECT feature, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, min(x) AS min, max(x) AS max, count(*) AS n
FROM samples WHERE side = 'ref' GROUP BY feature""", "samples")
def _reference_stats(v):
    return rounded(D.reference_stats(v.samples), "mean", "std")


_PSI = """(SELECT feature, abs(sum((np - rp) * ln(np / rp))) AS psi FROM (
 SELECT c.feature, CASE WHEN r > 0 THEN r::DOUBLE / rt ELSE 0.0001 END AS rp, CASE WHEN n > 0 THEN n::DOUBLE / nt ELSE 0.0001 END AS np
 FROM (SELECT s.feature, greatest(least((x - lo) / ((hi - lo) / 10) - ((x - lo) / ((hi - lo) / 10)) % 1, 9), 0) AS bin,
   count_if(side = 'ref') AS r, count_if(side = 'new') AS n FROM samples s JOIN ranges g ON g.feature = s.feature
   WHERE x BETWEEN lo AND hi GROUP BY s.feature, bin) c
 JOIN (SELECT feature, count_if(side = 'ref') AS rt, count_if(side = 'new') AS nt FROM samples GROUP BY feature) t ON t.feature = c.feature) z
 GROUP BY feature) psi"""
_RANGES = "ranges AS (SELECT feature, min(x) AS lo, max(x) AS hi FROM samples WHERE side = 'ref' GROUP BY feature)"
_KS = """(SELECT feature, max(abs(fr - fn)) AS ks, max(nr)::BIGINT AS n_ref, max(nn)::BIGINT AS n_new FROM (
 SELECT feature, x, sum(r) OVER w / (sum(r) OVER (PARTITION BY feature))::DOUBLE AS fr, sum(n) OVER w / (sum(n) OVER (PARTITION BY feature))::DOUBLE AS fn,
  sum(r) OVER (PARTITION BY feature) AS nr, sum(n) OVER (PARTITION BY feature) AS nn
 FROM (SELECT feature, x, count_if(side = 'ref') AS r, count_if(side = 'new') AS n FROM samples GROUP BY feature, x) c
 WINDOW w AS (PARTITION BY feature ORDER BY x)) d GROUP BY feature) ks"""
_LAM = "(sqrt(n_ref::DOUBLE * n_new / (n_ref + n_new)) + 0.12 + 0.11 / sqrt(n_ref::DOUBLE * n_new / (n_ref + n_new))) * ks"
_P = f"""(SELECT *, CASE WHEN lam < 0.2 THEN 1 ELSE greatest(0, least(1, list_sum(list_transform(range(1, 21),
 lambda k: CASE WHEN k % 2 = 1 THEN 2 ELSE -2 END * exp(-2.0::DOUBLE * k * k * lam * lam))))) END AS p_value FROM (SELECT *, {_LAM} AS lam FROM {_KS}) l) p"""


@query("psi", f"WITH {_RANGES} SELECT feature, round(psi, 6) AS psi FROM {_PSI}", "samples")
def _psi(v):
    return D.psi(v.samples).select("feature", *r6("psi"))


@query("ks_two_sample", f"SELECT feature, round(ks, 6) AS ks, n_ref, n_new, round(p_value, 6) AS p_value FROM {_P}", "samples")
def _ks_two_sample(v):
    return D.ks_two_sample(v.samples).select("feature", *r6("ks"), "n_ref", "n_new", *r6("p_value"))


_ALERTS = f"""
SELECT feature AS feature_name, 'psi' AS kind, round(psi, 6) AS drift_score, 0.1::DOUBLE AS threshold,
 CASE WHEN psi > 0.25 THEN 'critical' ELSE 'warning' END AS severity FROM {_PSI} WHERE psi > 0.1
UNION ALL SELECT feature, 'ks', round(ks, 6), 0.05, CASE WHEN p_value < 0.01 THEN 'critical' ELSE 'warning' END FROM {_P}
WHERE p_value < 0.05 AND n_new >= 10"""


@query("drift_alerts", f"WITH {_RANGES} {_ALERTS}", "samples")
def _drift_alerts(v):
    kind = F.when(F.col("message").startswith("PSI"), "psi").otherwise("ks").alias("kind")
    return D.drift_alerts(v.samples, "2024-02-01 00:00:00").select("feature_name", kind, *r6("drift_score"), "threshold", "severity")


@query("drift_report_24h", f"""WITH {_RANGES}, a AS ({_ALERTS})
SELECT count(*) AS total_alerts_24h, count_if(severity = 'critical')::BIGINT AS critical_alerts,
 count_if(severity = 'warning')::BIGINT AS warning_alerts FROM a""", "samples")
def _drift_report_24h(v):
    fresh = D.drift_alerts(v.samples, "2024-02-01 00:00:00")
    old = fresh.withColumn("timestamp", F.lit("2024-01-25 00:00:00").cast("timestamp_ntz"))
    return D.drift_report_24h(fresh.union(old), "2024-02-01 12:00:00")
