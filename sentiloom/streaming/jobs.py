"""Structured Streaming jobs.

Every job takes a streaming DataFrame, a target folder and a checkpoint folder and
runs until the input seen at its start is used up (``availableNow``), so a scheduler
can start it again at any interval.  Batch outputs are written under the query's id and their batch number: a repeated batch
replaces itself, a new checkpoint replaces nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sentiloom.operators import drift, frames, monitoring
from sentiloom.operators.monitoring import CALLS, PERIOD_SECONDS, admit
from sentiloom.operators.quality import run_checks
from sentiloom.session import STATE_STORE, cut, make_folder
from sentiloom.sources.posts import normalize_raw_posts
from sentiloom.sources.sinks import write_quality_metrics

LATENESS = "1 hour"  # default bound; every job takes its own


@contextmanager
def rocksdb_state(spark: SparkSession):
    """The processors below need the RocksDB state store while their query starts."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, STATE_STORE)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def run_batches(stream: DataFrame, handle: Callable[[DataFrame, int, str], None], checkpoint: str, mode: str = "append") -> int:
    """Run until the input is used up; returns how many rows came too late for the watermark.

    ``handle`` gets the batch, its number and the query's id, which a new checkpoint changes and a restart keeps.
    """
    spark, names = stream.sparkSession, {}

    def numbered(batch: DataFrame, number: int) -> None:
        handle(batch, number, names.setdefault("run", batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")))

    with rocksdb_state(spark):
        started = (stream.writeStream.foreachBatch(numbered).outputMode(mode).option("checkpointLocation", checkpoint)
                   .trigger(availableNow=True).start())
        started.awaitTermination()
    return sum(state.numRowsDroppedByWatermark for p in started.recentProgress for state in p.stateOperators)


def to_folder(stream: DataFrame, target: str, checkpoint: str, mode: str = "append") -> int:
    def write(batch: DataFrame, number: int, run: str) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/run={run}/batch={number}")

    return run_batches(stream, write, checkpoint, mode)


def final_state(spark: SparkSession, target: str, keys: list[str]) -> DataFrame:
    """Newest row per key of an update-mode output of one run."""
    rows = spark.read.parquet(target).drop("run")
    rest = [c for c in rows.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r"))
    return newest.select(*keys, "r.*").drop("batch")


class CriticalQuality(RuntimeError):
    """A batch failed a critical check; nothing of it was written."""


def stream_ingest_quality(raw: DataFrame, target: str, checkpoint: str, as_of: str) -> None:
    """Normalise landed records, check each batch, write posts and the metric log; stop on a critical check."""

    def handle(batch: DataFrame, number: int, run: str) -> None:
        posts = normalize_raw_posts(batch, as_of).persist()
        checks = run_checks(posts, as_of).persist()
        append = checks.withColumn("batch", F.lit(number))
        append.write.mode("overwrite").parquet(f"{target}/checks/run={run}/batch={number}")
        if not checks.filter(~F.col("passed") & (F.col("severity") == "critical")).isEmpty():
            raise CriticalQuality(f"batch {number}: critical quality check failed")
        posts.write.mode("overwrite").parquet(f"{target}/posts/run={run}/batch={number}")
        write_quality_metrics(checks, f"{run}-{number}", as_of, f"{target}/quality_metrics")
        checks.unpersist()
        posts.unpersist()

    run_batches(raw, handle, checkpoint)


def stream_dedup(posts: DataFrame, target: str, checkpoint: str, lateness: str = LATENESS) -> int:
    """First occurrence of each post id within the lateness bound (``created_utc`` is a timestamp)."""
    once = posts.withWatermark("created_utc", lateness).dropDuplicatesWithinWatermark(["post_id"])
    return to_folder(once, target, checkpoint)


KEY_BUCKETS = 64


def _key_name(target: str) -> str:
    return "seen_" + hashlib.sha256(target.encode()).hexdigest()[:24]


def _key_table(spark: SparkSession, target: str, kind: str, buckets: int) -> str:
    """The ids written so far as a table bucketed by id; a new session finds the folders of an earlier one."""
    name = _key_name(target)
    place = f"{target}/keys"
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (post_id {kind}, run STRING, batch BIGINT) USING parquet PARTITIONED BY (run, batch) "
              f"CLUSTERED BY (post_id) SORTED BY (post_id) INTO {buckets} BUCKETS LOCATION '{place}'")
    make_folder(spark, place)
    spark.sql(f"MSCK REPAIR TABLE {name}")
    return name


def unseen(batch: DataFrame, seen: DataFrame, buckets: int) -> DataFrame:
    """Rows of ``batch``, the earliest of each id, whose id is not in ``seen``.  The batch goes to the buckets of ``seen``, which stays where it is."""
    batch = batch.repartition(buckets, "post_id")
    first = Window.partitionBy("post_id").orderBy("created_utc", F.xxhash64(*[F.col(c) for c in batch.columns]))
    fresh = batch.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    return fresh.join(seen.select(F.col("post_id").alias("_seen")), F.col("post_id") == F.col("_seen"), "left_anti")


def stream_dedup_whole(posts: DataFrame, target: str, checkpoint: str, buckets: int = KEY_BUCKETS) -> None:
    """First occurrence of each post id in the whole collection, however old a repeat is.

    The ids are kept in a bucketed table below ``target``, a partition per batch.  A batch is compared with the ids of all batches but itself
    and later ones, so a repeated batch gives the same rows; its rows are written before its ids.  Rows without an id are dropped.
    """
    kind = dict(posts.dtypes)["post_id"]

    def handle(batch: DataFrame, number: int, run: str) -> None:
        spark = batch.sparkSession
        name = _key_table(spark, target, kind, buckets)
        seen = spark.table(name).filter(~((F.col("run") == run) & (F.col("batch") >= number)))
        unseen(batch.filter("post_id is not null"), seen, buckets).write.mode("overwrite").parquet(f"{target}/posts/run={run}/batch={number}")
        made = spark.read.schema(batch.schema).parquet(f"{target}/posts/run={run}/batch={number}")
        spark.sql(f"ALTER TABLE {name} DROP IF EXISTS PARTITION (run = '{run}', batch = {number})")
        slim = made.select("post_id", F.lit(run).alias("run"), F.lit(number).cast("long").alias("batch")).repartition(buckets, "post_id")
        slim.write.mode("append").insertInto(name)

    run_batches(posts, handle, checkpoint)
    posts.sparkSession.sql(f"DROP TABLE IF EXISTS {_key_name(target)}")  # the folders stay


def stream_live_feed(posts: DataFrame, score: Callable[[DataFrame], DataFrame], subreddits: list[str], min_confidence: float,
                     target: str, checkpoint: str) -> None:
    """Score asked posts as they arrive and keep running feed metrics."""
    scored = score(posts.filter(F.col("subreddit").isin(subreddits)))
    kept = frames.stream_request_filter(scored, subreddits, min_confidence)
    feed = monitoring.feed_metrics(kept.select(
        F.col("prediction").alias("sentiment_label"), F.col("confidence").alias("confidence_score")))
    to_folder(feed, target, checkpoint, "complete")


def stream_hourly_metrics(log: DataFrame, target: str, checkpoint: str, width: str = "1 hour", lateness: str = LATENESS) -> int:
    """Tumbling metrics per model; updates carry the state so far.  Returns the calls that came after the bound."""
    counted = (
        log.withWatermark("predicted_at", lateness).groupBy(F.window("predicted_at", width).alias("w"), "model_name")
        .agg(F.count(F.lit(1)).alias("predictions"), F.avg("response_time_ms").alias("avg_response_time_ms"),
             F.count_if(~F.col("success")).alias("error_count"),
             *[F.count_if(F.col("success") & (F.col("sentiment_label") == x)).alias(x) for x in ("negative", "neutral", "positive")])
    )
    return to_folder(counted.select(F.col("w.start").alias("slot"), *[c for c in counted.columns if c != "w"]), target, checkpoint, "update")


PANE = "30 seconds"
PANES = 10  # of a sliding window of five minutes
SKETCH = 4096  # values up to which a quantile sketch is exact; beyond, its rank error is under 0.1 %


def stream_panes(log: DataFrame, target: str, checkpoint: str, lateness: str = LATENESS) -> int:
    """Calls, errors and a mergeable quantile sketch of the response times per pane of 30 seconds.

    A call is aggregated once, map-side first; windows are put together from panes (:func:`sliding_rates`), not from copies of calls.
    Returns the calls that came after the bound.
    """
    panes = (
        log.withWatermark("predicted_at", lateness).groupBy(F.window("predicted_at", PANE).alias("w"))
        .agg(F.count(F.lit(1)).alias("calls"), F.count_if(~F.col("success")).alias("errors"), F.count("response_time_ms").alias("timed"),
             F.kll_sketch_agg_double("response_time_ms", SKETCH).alias("sketch"))
    )
    return to_folder(panes.select(F.col("w.start").alias("pane"), "calls", "errors", "timed", "sketch"), target, checkpoint, "update")


def sliding_rates(panes: DataFrame) -> DataFrame:
    """Error share and p95 latency over the last 5 minutes, every 30 seconds, from the newest state of each pane."""
    step = F.expr(f"INTERVAL {PANE}")
    shown = panes.withColumn("slot", F.explode(F.transform(F.sequence(F.lit(0), F.lit(PANES - 1)), lambda i: F.col("pane") - step * i)))
    merged = shown.groupBy("slot").agg(
        F.sum("calls").alias("calls"), F.sum("errors").alias("errors"), F.sum("timed").alias("timed"),
        F.kll_merge_agg_double(F.when(F.col("timed") > 0, F.col("sketch")), SKETCH).alias("sketch"))
    p95 = F.when(F.col("timed") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(0.95)))
    return merged.select("slot", "calls", "errors", (F.col("errors") / F.col("calls")).alias("error_rate"), p95.alias("p95_ms"))


def stream_sliding_rates(log: DataFrame, target: str, checkpoint: str, lateness: str = LATENESS) -> int:
    """Keep the panes of ``log`` below ``target``; read them with :func:`final_state` (key ``pane``) and :func:`sliding_rates`."""
    return stream_panes(log, target, checkpoint, lateness)


class RateLimiter(StatefulProcessor):
    """Accept or reject calls per client; the state is the accepted times of the last period (at most ``calls``)."""

    def __init__(self, calls: int = CALLS, period: int = PERIOD_SECONDS):
        self.calls, self.span = calls, period * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getListState("times", "us bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [int(t[0]) for t in self.times.get()] if self.times.exists() else []
        # one client's calls of one micro-batch, put in time order
        frame = pd.concat(list(rows)).sort_values(["us", "request_id"])
        verdicts = []
        for now in frame["us"]:
            accepted, held = admit(held, int(now), self.calls, self.span)
            verdicts.append(accepted)
        self.times.put([(t,) for t in held]) if held else self.times.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((int(frame["us"].iloc[-1]) + self.span) // 1000 + 1)
        yield pd.DataFrame({"request_id": frame["request_id"], "client": key[0], "accepted": verdicts})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.times.clear()  # every remembered time is older than the period
        yield pd.DataFrame({"request_id": pd.Series(dtype="int64"), "client": pd.Series(dtype="str"), "accepted": pd.Series(dtype="bool")})

    def close(self) -> None:
        pass


def stream_rate_limit(calls: DataFrame, target: str, checkpoint: str, lateness: str = LATENESS) -> int:
    timed = calls.withWatermark("ts", lateness).select("request_id", "client", "ts", F.unix_micros("ts").alias("us"))
    decided = timed.groupBy("client").transformWithStateInPandas(
        statefulProcessor=RateLimiter(), outputStructType="request_id bigint, client string, accepted boolean",
        outputMode="Append", timeMode="EventTime")
    return to_folder(decided, target, checkpoint)


class AlertHold(StatefulProcessor):
    """Fire once when a condition has held for ``hold`` milliseconds of evenly spaced slots.

    Slots wait in map state until the watermark has passed them; their timers then go off in order of time, so slots may
    come late, shuffled and in any batch.  Only slots the watermark has not passed are held.
    """

    def __init__(self, hold_seconds: int, step_seconds: int):
        self.hold, self.step = hold_seconds * 1000, step_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "ms bigint", "is_on boolean")
        self.state = handle.getValueState("since", "since bigint, last bigint, fired boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for ms, on in zip(frame["ms"], frame["is_on"]):
                self.waiting.updateValue((int(ms),), (bool(on),))
                self.handle.registerTimer(int(ms))
        yield pd.DataFrame({"model_name": pd.Series(dtype="str"), "since_us": pd.Series(dtype="int64"), "fired_us": pd.Series(dtype="int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        since, last, fired = self.state.get() if self.state.exists() else (None, None, False)
        on, = self.waiting.getValue((now,))
        self.waiting.removeKey((now,))
        out = []
        if not on:
            since, fired = None, False
        elif since is None or now - last != self.step:
            since, fired = now, False
        if since is not None and not fired and now - since + self.step >= self.hold:
            fired = True
            out.append((key[0], since * 1000, now * 1000))
        self.state.update((since, now, fired))
        yield pd.DataFrame(out, columns=["model_name", "since_us", "fired_us"]).astype({"model_name": "str", "since_us": "int64", "fired_us": "int64"})

    def close(self) -> None:
        pass


def stream_alert_hold(series: DataFrame, condition, hold_seconds: int, step_seconds: int, target: str, checkpoint: str,
                      lateness: str = LATENESS) -> int:
    """``series`` has model_name, slot (timestamp, one row per model and slot) and the columns ``condition`` reads.

    An alert is decided once the watermark, ``lateness`` behind the newest slot of any model, has passed it.
    """
    marked = series.withWatermark("slot", lateness).select(
        "model_name", "slot", F.unix_millis("slot").alias("ms"), F.coalesce(condition, F.lit(False)).alias("is_on"))
    fired = marked.groupBy("model_name").transformWithStateInPandas(
        statefulProcessor=AlertHold(hold_seconds, step_seconds),
        outputStructType="model_name string, since_us bigint, fired_us bigint", outputMode="Append", timeMode="EventTime")
    return to_folder(fired, target, checkpoint)


def stream_drift(new_samples: DataFrame, reference: DataFrame, as_of: str, target: str, checkpoint: str) -> None:
    """Drift alerts of each batch against a reference table (feature, x), which is counted once."""
    known = cut(drift.value_counts(reference.select("feature", F.lit("ref").alias("side"), "x")))

    def handle(batch: DataFrame, number: int, run: str) -> None:
        added = drift.value_counts(batch.select("feature", F.lit("new").alias("side"), "x"))
        drift.alerts_of_counts(cut(drift.merge_counts(known, added)), as_of).write.mode("overwrite").parquet(f"{target}/run={run}/batch={number}")

    run_batches(new_samples, handle, checkpoint)
