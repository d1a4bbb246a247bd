"""Roll-ups, windows and alerts over the prediction log."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentiloom.operators.ranking import exact_quantiles, rolling_mean
from sentiloom.schemas import LABEL_NAMES

CALLS, PERIOD_SECONDS = 100, 60  # fixed values
LAST_RESPONSES, LAST_LABELED = 1000, 100
ALERTS = {"accuracy": ("below", 0.75, 10), "drift": ("above", 0.2, 15), "error_rate": ("above", 0.05, 5)}


def _label_counts(where: Column | None = None) -> list[Column]:
    ok = F.lit(True) if where is None else where
    return [F.count_if(ok & (F.col("sentiment_label") == x)).alias(x) for x in LABEL_NAMES]


def prediction_metrics(log: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Total, mean response time, labels of successes, error share."""
    errors = F.count_if(~F.col("success"))
    return log.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_predictions"), F.avg("response_time_ms").alias("average_response_time_ms"),
        *_label_counts(F.col("success")), errors.alias("error_count"),
        (errors / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("error_rate"))


def daily_metrics(log: DataFrame) -> DataFrame:
    return prediction_metrics(log.withColumn("day", F.date_trunc("day", "predicted_at")), ["day"])


def hourly_metrics(log: DataFrame, start: str, hours: int = 24) -> DataFrame:
    """One row per hour from ``start``, hours without calls included."""
    first = F.lit(start).cast("timestamp_ntz")
    last = first + F.expr(f"INTERVAL '{hours}' HOUR")
    spine = log.sparkSession.range(1).select(F.explode(F.sequence(
        first, last - F.expr("INTERVAL '1' HOUR"), F.expr("INTERVAL '1' HOUR"))).alias("hour"))
    counted = (
        log.filter((F.col("predicted_at") >= first) & (F.col("predicted_at") < last))
        .groupBy(F.date_trunc("hour", "predicted_at").alias("hour"))
        .agg(F.count(F.lit(1)).alias("predictions"), F.avg("response_time_ms").alias("avg_response_time_ms"),
             F.count_if(~F.col("success")).alias("error_count"), *_label_counts(F.col("success")))
    )
    return spine.join(counted, "hour", "left").fillna(0, ["predictions", "error_count", *LABEL_NAMES])


def latency_percentiles(log: DataFrame, keys: list[str] = ("model_name",)) -> DataFrame:
    """p50/p95/p99 by index floor(n*p) of the sorted times (no interpolation), min and max."""
    keys = list(keys)
    q = exact_quantiles(log.select(*keys, "response_time_ms"), keys, "response_time_ms", [0.5, 0.95, 0.99], interpolate=False)
    wide = q.groupBy(*keys).agg(*[
        F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(n)
        for n, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))])
    ends = log.groupBy(*keys).agg(F.min("response_time_ms").alias("min"), F.max("response_time_ms").alias("max"))
    return wide.join(ends, keys)


def feed_metrics(feed: DataFrame) -> DataFrame:
    total = F.count(F.lit(1))
    return feed.agg(
        total.alias("total"), *_label_counts(),
        *[(F.count_if(F.col("sentiment_label") == x) / total).alias(f"{x}_share") for x in LABEL_NAMES],
        F.avg("confidence_score").alias("avg_confidence"))


def batch_summary(log: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Per batch: count, mean confidence, label -> count map, total time."""
    counts = F.map_from_arrays(F.array(*[F.lit(x) for x in LABEL_NAMES]), F.array(*_label_counts()))
    return log.groupBy(batch).agg(
        F.count(F.lit(1)).alias("total_predictions"), F.avg("confidence_score").alias("average_confidence"),
        F.map_filter(counts, lambda k, n: n > 0).alias("label_distribution"),
        F.sum("response_time_ms").alias("total_time_ms"))


def dashboard_rollups(log: DataFrame, as_of: str) -> DataFrame:
    """Last 24 h volume, mean confidence and error share; API keys active in the last 5 minutes."""
    now = F.lit(as_of).cast("timestamp_ntz")
    day = log.filter((F.col("predicted_at") > now - F.expr("INTERVAL '24' HOUR")) & (F.col("predicted_at") <= now))
    recent = F.col("predicted_at") > now - F.expr("INTERVAL '5' MINUTE")
    return day.agg(
        F.count(F.lit(1)).alias("predictions_24h"), F.avg("confidence_score").alias("avg_confidence"),
        F.coalesce(F.try_divide(F.count_if(~F.col("success")).cast("double"), F.count(F.lit(1)).cast("double")), F.lit(0.0))
        .alias("error_share"),
        F.countDistinct(F.when(recent, F.col("api_key"))).alias("active_keys_5m"))


def rolling_latency(log: DataFrame, rows: int = LAST_RESPONSES, keys: list[str] = ("model_name",)) -> DataFrame:
    """Mean over the last ``rows`` response times of each model, at every call."""
    return rolling_mean(log, list(keys), ["predicted_at", "prediction_id"], rows, {"rolling_response_ms": "response_time_ms"})


def rolling_accuracy(labeled_log: DataFrame, rows: int = LAST_LABELED, keys: list[str] = ("model_name",)) -> DataFrame:
    """Accuracy over the last ``rows`` predictions whose truth is known."""
    hits = labeled_log.withColumn("_hit", (F.col("y_true") == F.col("y_pred")).cast("int"))
    return rolling_mean(hits, list(keys), ["predicted_at", "prediction_id"], rows, {"rolling_accuracy": "_hit"}).drop("_hit")


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def rate_limit_audit(calls: DataFrame, limit: int = CALLS, period: int = PERIOD_SECONDS) -> DataFrame:
    """Calls of the client in the trailing ``period`` seconds, and whether they exceed the limit.

    Calls are counted per exact time first.  A client's time line is cut into slots of one
    period; each count is also shown to the next slot, which is as far as a window reaches.
    """
    span = period * 1_000_000
    counted = calls.groupBy("client", "ts").agg(F.count(F.lit(1)).alias("_n")).withColumn("_us", _micros(F.col("ts")))
    own = F.floor(F.col("_us") / span)
    spread = counted.withColumn("_own", own).withColumn("_slot", F.explode(F.array(F.col("_own"), F.col("_own") + 1)))
    w = Window.partitionBy("client", "_slot").orderBy("_us").rangeBetween(-span, 0)
    seen = spread.withColumn("calls_in_window", F.sum("_n").over(w)).filter(F.col("_slot") == F.col("_own"))
    return calls.join(seen.select("client", "ts", "calls_in_window"), ["client", "ts"]).withColumn(
        "over_limit", F.col("calls_in_window") > limit)


def admit(times: list[int], now: int, limit: int, span: int) -> tuple[bool, list[int]]:
    """One limiter step on microseconds: forget times older than the span, then accept or reject."""
    kept = [t for t in times if t >= now - span]
    if len(kept) >= limit:
        return False, kept
    return True, kept + [now]


def rate_limit_decisions(calls: DataFrame, limit: int = CALLS, period: int = PERIOD_SECONDS) -> DataFrame:
    """Accept or reject each call; only accepted calls count (batch twin of the stream limiter).

    The rule is sequential per client, but an idle stretch longer than the period clears the
    memory, so a client's busy stretches are independent tasks.  Within a task rows stream
    through in time order and only the accepted times of the last period are held.
    """
    span = period * 1_000_000
    timed = calls.withColumn("_us", _micros(F.col("ts"))).withColumn("_slot", F.floor(F.col("_us") / span))
    slots = timed.select("client", "_slot").distinct()
    order = Window.partitionBy("client").orderBy("_slot")
    fresh = F.when(F.col("_slot") - F.lag("_slot").over(order) < 2, 0).otherwise(1)
    stretches = slots.withColumn("_new", fresh).withColumn("_stretch", F.sum("_new").over(order)).drop("_new")
    ordered = (
        timed.join(stretches, ["client", "_slot"]).repartition("client", "_stretch")
        .sortWithinPartitions("client", "_stretch", "_us", "request_id")
        .select("request_id", "client", "ts", "_us", "_stretch")
    )

    def step(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, held = None, []
        for frame in frames:
            verdicts = []
            for client, stretch, now in zip(frame["client"], frame["_stretch"], frame["_us"]):
                if (client, stretch) != current:
                    current, held = (client, stretch), []
                accepted, held = admit(held, now, limit, span)
                verdicts.append(accepted)
            yield frame[["request_id", "client", "ts"]].assign(accepted=verdicts)

    kinds = dict(calls.dtypes)
    return ordered.mapInPandas(step, f"request_id bigint, client string, ts {kinds['ts']}, accepted boolean")


def alert_hold(series: DataFrame, condition: Column, hold_seconds: int, step_seconds: int, keys: list[str] = ("model_name",),
               slot: str = "slot") -> DataFrame:
    """Stretches of evenly spaced slots in which ``condition`` held for at least ``hold_seconds``.

    ``series`` is one row per key and slot, already aggregated from the log.
    """
    keys = list(keys)
    order = Window.partitionBy(*keys).orderBy(slot)
    at = _micros(F.col(slot))
    marked = series.withColumns({"_on": F.coalesce(condition, F.lit(False)), "_at": at})
    before = F.lag("_on").over(order) & (F.col("_at") - F.lag("_at").over(order) == step_seconds * 1_000_000)
    starts = marked.withColumn("_start", (F.col("_on") & ~F.coalesce(before, F.lit(False))).cast("int"))
    islands = starts.withColumn("_island", F.sum("_start").over(order.rowsBetween(Window.unboundedPreceding, 0))).filter("_on")
    return islands.groupBy(*keys, "_island").agg(
        F.min(slot).alias("since"), F.max(slot).alias("until"), F.count(F.lit(1)).alias("slots"),
    ).filter(F.col("slots") * step_seconds >= hold_seconds).drop("_island")
