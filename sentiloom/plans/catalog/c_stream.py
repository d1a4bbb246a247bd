"""Streaming jobs run over the given tables until their input is used up."""

from pyspark.sql import functions as F

from sentiloom.functions.sentiment import threshold_classifier
from sentiloom.operators.monitoring import rate_limit_decisions
from sentiloom.plans.catalog.c_monitor import _ALERTS, _RANGES
from sentiloom.plans.catalog.c_sentiment import _CONFIDENCE, _DECIDED, served
from sentiloom.plans.catalog.c_text import r6
from sentiloom.plans.registry import query
from sentiloom.session import scratch_path
from sentiloom.sources import fixtures
from sentiloom.sources.posts import read_landing
from sentiloom.streaming import jobs as J


WHOLE = "3650 days"  # a bound beyond the table's times, where every row counts


def streamed(v, df, name, files=1):
    """Write a derived table to the shared folder and open it as a stream of ``files`` micro-batches, each of as many files as its size asks for."""
    path = scratch_path(v.spark, name)
    if files == 1:
        df.write.parquet(path)
        return v.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1000).parquet(path)
    splits = max(v.spark.read.parquet(f"{v.folder}/{t}.parquet").rdd.getNumPartitions() for t in ("documents", "events"))
    each = -(-splits // files)
    df.repartition(files * each).write.parquet(path)
    return v.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", each).parquet(path)


def streamed_in_order(v, df, name, by, cuts):
    """The same, one file per stretch of ``by``, oldest first."""
    path = scratch_path(v.spark, name)
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = df if low is None else df.filter(F.col(by) >= F.lit(low).cast("timestamp"))
        (part if high is None else part.filter(F.col(by) < F.lit(high).cast("timestamp"))).coalesce(1).write.mode("append").parquet(path)
    return v.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def event_stream(v):
    """The event table itself as a stream."""
    schema = v.spark.read.parquet(f"{v.folder}/events.parquet").schema
    # a stream wants a folder or a pattern; the table may be a single file
    return v.spark.readStream.schema(schema).parquet(f"{v.folder}/event[s].parquet")


def prediction_stream(v):
    sql = fixtures._spell(fixtures._SQL["predictions"][1], "spark").replace("FROM events", "FROM {events}")
    return v.spark.sql(sql, events=event_stream(v)).withColumn("predicted_at", F.col("predicted_at").cast("timestamp"))


def places(v, name):
    return scratch_path(v.spark, name), scratch_path(v.spark, f"{name}-checkpoint")


@query("stream_ingest_quality", """
SELECT id AS post_id, subreddit, score, make_timestamp((created_utc * 1000000)::BIGINT) AS created_utc FROM raw_posts""", "raw_posts")
def _stream_ingest_quality(v):
    landing = scratch_path(v.spark, "landing")
    v.raw_posts.write.json(landing)
    target, checkpoint = places(v, "ingest")
    J.stream_ingest_quality(read_landing(v.spark, landing, streaming=True), target, checkpoint, "2024-01-02 00:00:00")
    return v.spark.read.parquet(f"{target}/posts").select("post_id", "subreddit", "score", "created_utc")


@query("stream_dedup", "SELECT DISTINCT post_id FROM posts", "posts")
def _stream_dedup(v):
    rows = v.collections.select("post_id", "run").join(v.posts.select("post_id", "created_utc"), "post_id")
    rows = rows.withColumn("created_utc", F.col("created_utc").cast("timestamp"))
    target, checkpoint = places(v, "dedup")
    J.stream_dedup_whole(streamed(v, rows, "dedup-source", 5), target, checkpoint, 8)
    return v.spark.read.parquet(f"{target}/posts").select("post_id")


@query("stream_live_feed", f"""
WITH feed AS (SELECT post_id, prediction, {_CONFIDENCE} AS confidence FROM {_DECIDED} JOIN (SELECT post_id AS p, subreddit FROM posts) o ON p = post_id
 WHERE subreddit IN ('src0', 'src1', 'src2') AND {_CONFIDENCE} >= 0.4)
SELECT count(*) AS total, count_if(prediction = 'negative')::BIGINT AS negative, count_if(prediction = 'neutral')::BIGINT AS neutral,
 count_if(prediction = 'positive')::BIGINT AS positive, round(count_if(prediction = 'negative')::DOUBLE / count(*), 6) AS negative_share,
 round(count_if(prediction = 'neutral')::DOUBLE / count(*), 6) AS neutral_share, round(count_if(prediction = 'positive')::DOUBLE / count(*), 6) AS positive_share,
 round(avg(confidence), 6) AS avg_confidence FROM feed""", "posts model_probs")
def _stream_live_feed(v):
    posts = served(v).select("post_id", "subreddit", "full_text", "p_negative", "p_neutral", "p_positive")
    target, checkpoint = places(v, "feed")
    J.stream_live_feed(streamed(v, posts, "feed-source", 3), lambda df: threshold_classifier(df, "full_text"),
                       ["src0", "src1", "src2"], 0.4, target, checkpoint)
    rows = v.spark.read.parquet(target)
    last = rows.filter(F.col("batch") == rows.select(F.max("batch")).scalar()).drop("batch", "run")
    return last.withColumns({c: F.round(c, 6) for c in ("negative_share", "neutral_share", "positive_share", "avg_confidence")})


@query("stream_hourly_metrics", """
SELECT date_trunc('hour', predicted_at) AS slot, model_name, count(*) AS predictions, round(avg(response_time_ms), 6) AS avg_response_time_ms,
 count_if(NOT success)::BIGINT AS error_count, count_if(success AND sentiment_label = 'negative')::BIGINT AS negative,
 count_if(success AND sentiment_label = 'neutral')::BIGINT AS neutral, count_if(success AND sentiment_label = 'positive')::BIGINT AS positive
FROM predictions GROUP BY 1, 2""", "predictions")
def _stream_hourly_metrics(v):
    return _tumbling(v, "1 hour")


def _tumbling(v, width):
    target, checkpoint = places(v, "tumbling")
    log = v.predictions.withColumn("predicted_at", F.col("predicted_at").cast("timestamp")).drop("probabilities")
    J.stream_hourly_metrics(streamed(v, log, "tumbling-source", 3), target, checkpoint, width, WHOLE)
    out = J.final_state(v.spark, target, ["slot", "model_name"])
    return out.withColumns({"slot": F.col("slot").cast("timestamp_ntz"), "avg_response_time_ms": F.round("avg_response_time_ms", 6)})


@query("stream_daily_metrics", """
SELECT date_trunc('day', predicted_at)::TIMESTAMP AS slot, model_name, count(*) AS predictions, round(avg(response_time_ms), 6) AS avg_response_time_ms,
 count_if(NOT success)::BIGINT AS error_count, count_if(success AND sentiment_label = 'negative')::BIGINT AS negative,
 count_if(success AND sentiment_label = 'neutral')::BIGINT AS neutral, count_if(success AND sentiment_label = 'positive')::BIGINT AS positive
FROM predictions GROUP BY 1, 2""", "predictions")
def _stream_daily_metrics(v):
    return _tumbling(v, "1 day")


@query("stream_sliding_rates", """
SELECT slot, count(*) AS calls, count_if(NOT success)::BIGINT AS errors, round(count_if(NOT success)::DOUBLE / count(*), 6) AS error_rate,
 round(list_sort(list(response_time_ms) FILTER (WHERE response_time_ms IS NOT NULL))[greatest(1, ceil(0.95 * count(response_time_ms)))::BIGINT], 6) AS p95_ms
FROM (SELECT success, response_time_ms, make_timestamp((floor(epoch_us(predicted_at) / 30000000) * 30000000 - i * 30000000)::BIGINT) AS slot
 FROM predictions, range(10) r(i)) x GROUP BY slot""", "predictions")
def _stream_sliding_rates(v):
    target, checkpoint = places(v, "sliding")
    log = v.predictions.withColumn("predicted_at", F.col("predicted_at").cast("timestamp")).select("predicted_at", "success", "response_time_ms")
    J.stream_sliding_rates(streamed(v, log, "sliding-source", 5), target, checkpoint, WHOLE)
    out = J.sliding_rates(J.final_state(v.spark, target, ["pane"]))
    return out.select(F.col("slot").cast("timestamp_ntz").alias("slot"), "calls", "errors", *r6("error_rate", "p95_ms"))


@query("stream_rate_limit")
def _stream_rate_limit(v):
    calls = v.requests.withColumn("ts", F.col("ts").cast("timestamp"))
    target, checkpoint = places(v, "limiter")
    J.stream_rate_limit(streamed(v, calls, "limiter-source"), target, checkpoint)
    decided = v.spark.read.parquet(target).select("request_id", F.col("accepted").alias("stream_accepted"))
    return rate_limit_decisions(calls).select("request_id", "accepted").join(decided, "request_id", "full")


@query("stream_alert_hold", """
SELECT model_name, min(slot) AS since FROM (
 SELECT *, slot - INTERVAL 1 HOUR * row_number() OVER (PARTITION BY model_name ORDER BY slot) AS island
 FROM error_series WHERE error_rate > 0.15) x GROUP BY model_name, island HAVING count(*) >= 3""", "error_series")
def _stream_alert_hold(v):
    series = v.error_series.withColumn("slot", F.col("slot").cast("timestamp"))
    target, checkpoint = places(v, "hold")
    source = scratch_path(v.spark, "hold-source")
    shuffled = series.select("model_name", "slot", "error_rate").withColumn("_b", F.pmod(F.xxhash64("model_name", "slot"), F.lit(5)))
    for number in range(5):  # slots in any order over five batches, then one later row that lets the watermark pass them all
        shuffled.filter(F.col("_b") == number).drop("_b").coalesce(1).write.mode("append").parquet(source)
    ended = series.agg(F.lit("end").alias("model_name"), (F.max("slot") + F.expr("INTERVAL 400 DAYS")).alias("slot"), F.lit(0.0).alias("error_rate"))
    ended.write.mode("append").parquet(source)
    stream = v.spark.readStream.schema(ended.schema).option("maxFilesPerTrigger", 1).parquet(source)
    J.stream_alert_hold(stream, F.col("error_rate") > 0.15, 3 * 3600, 3600, target, checkpoint, "365 days")
    out = v.spark.read.parquet(target)
    return out.select("model_name", F.timestamp_micros("since_us").cast("timestamp_ntz").alias("since"))


@query("stream_drift", f"WITH {_RANGES} SELECT feature_name, drift_score, threshold, severity FROM ({_ALERTS}) a", "samples")
def _stream_drift(v):
    new = v.samples.filter("side = 'new'").select("feature", "x")
    reference = v.samples.filter("side = 'ref'").select("feature", "x")
    target, checkpoint = places(v, "drift")
    J.stream_drift(streamed(v, new, "drift-source"), reference, "2024-02-01 00:00:00", target, checkpoint)
    return v.spark.read.parquet(target).select("feature_name", *r6("drift_score"), "threshold", "severity")
