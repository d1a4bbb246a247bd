"""Models, sinks and streaming jobs."""

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from sentiloom.models import classifiers as C
from sentiloom.models import explain, scorer
from sentiloom.models.stages import TextVectors, vector_parts
from sentiloom.operators import terms, voting
from sentiloom.plans import catalog  # noqa: F401
from sentiloom.plans.catalog import c_models as M
from sentiloom.plans.registry import CATALOG
from sentiloom.session import scratch_path
from sentiloom.sources import posts as P
from sentiloom.sources import sinks as K
from sentiloom.streaming import jobs as J


def test_vector_form_equals_long_form(views):
    texts = views.cleaned.select("post_id", "cleaned_text").persist()
    vocabulary = terms.fit_vocabulary(texts, "cleaned_text", 300)
    long = terms.tfidf(texts, "cleaned_text", vocabulary, sublinear=True)
    model = TextVectors(inputCol="cleaned_text", outputCol="v", maxFeatures=300).fit(texts)
    parts = vector_parts(F.col("v"))
    wide = model.transform(texts).select("post_id", F.explode(F.arrays_zip(parts["indices"].alias("i"), parts["values"].alias("w"))).alias("e"))
    both = long.join(wide.select("post_id", F.col("e.i").alias("term_index"), F.col("e.w").alias("w")), ["post_id", "term_index"], "full")
    row = both.agg(F.count("*").alias("n"), F.max(F.abs(F.col("weight") - F.col("w"))).alias("gap"), F.count_if(F.col("w").isNull() | F.col("weight").isNull()).alias("lone")).first()
    assert row["n"] > 1000 and row["lone"] == 0 and row["gap"] < 1e-9
    texts.unpersist()


def test_baseline_beats_majority_and_survives_saving(spark, views):
    train, test = M.part(views, "train"), M.part(views, "val", "test")
    model = M.baseline(views).fit(train)
    scored = model.transform(test).select("post_id", "auto_label_id", "label_id", *C.PROBS).persist()
    total = sum((F.col(p) for p in C.PROBS), F.lit(0.0))
    assert scored.agg(F.max(F.abs(total - 1))).first()[0] < 1e-9
    hits = scored.agg(F.avg((F.col("label_id") == F.col("auto_label_id")).cast("double"))).first()[0]
    largest = max(r["count"] for r in test.groupBy("auto_label_id").count().collect()) / test.count()
    assert hits >= largest - 0.05
    path = scratch_path(spark, "saved")
    model.save(path)
    again = C.Baseline.load(path)
    assert again.metadata["training_samples"] == train.count()
    assert again.transform(test).select("post_id", *C.PROBS).exceptAll(scored.select("post_id", *C.PROBS)).count() == 0


def test_boosted_learns_keywords(views):
    train, test = M.part(views, "train"), M.part(views, "val", "test")
    model = M.boosted(views).fit(train)
    hits = model.transform(test).agg(F.avg((F.col("label_id") == F.col("auto_label_id")).cast("double"))).first()[0]
    largest = max(r["count"] for r in test.groupBy("auto_label_id").count().collect()) / test.count()
    assert hits > largest
    importance = dict(model.importance())
    assert max(importance, key=importance.get) in ("bullish_keyword_count", "bearish_keyword_count")


def test_contributions_add_up_to_the_margin(views):
    test = M.part(views, "test")
    model = explain.fit_linear(M.part(views, "train"), M.NUMERIC)
    rows = explain.linear_contributions(test, model, M.NUMERIC, 2).groupBy("post_id").agg(F.sum("contribution").alias("s"))
    scored = model.transform(C.as_double(test, M.NUMERIC)).select("post_id", "_features", "rawPrediction").collect()
    coefficients = model.stages[-1].coefficientMatrix.toArray()[2]
    margins = {r["post_id"]: float(np.dot(coefficients, r["_features"].toArray())) for r in scored}
    mean = np.mean(list(margins.values()))
    for r in rows.collect():
        assert r["s"] == pytest.approx(margins[r["post_id"]] - mean, abs=1e-6)


def test_votes(spark):
    rows = [("p", "a", 2, 0.1, 0.2, 0.7), ("p", "b", 0, 0.6, 0.2, 0.2), ("p", "c", 0, 0.5, 0.4, 0.1), ("q", "a", 2, 0.0, 0.0, 1.0), ("q", "b", 1, 0.0, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "post_id string, model string, label_id int, p_negative double, p_neutral double, p_positive double")
    with pytest.raises(ValueError):
        voting.soft_vote(df, {"a": 0.5, "b": 0.6})
    assert {r["post_id"]: r["label_id"] for r in voting.hard_vote(df).collect()} == {"p": 0, "q": 1}
    same = df.filter("post_id = 'p' and model = 'a'")
    assert voting.ensemble_uncertainty(same.union(same)).first()["uncertainty"] == 0


def test_scorer_falls_back_to_neutral(spark):
    def broken():
        raise ImportError("no such model")

    score = scorer.scorer_udf(scorer.uniform_when_missing(broken))
    df = spark.createDataFrame([("a",), (None,)], "t string")
    assert [r["p"] for r in df.select(score("t").alias("p")).collect()] == [[0.0, 1.0, 0.0]] * 2


def test_failed_base_model_gives_uniform_scores(spark):
    class Broken:
        def fit(self, df):
            raise ValueError("one class")

    with pytest.warns(UserWarning):
        model = C.fit_or_uniform(Broken, spark.range(1))
    assert model.transform(spark.range(1)).first()["p_neutral"] == pytest.approx(1 / 3)


def test_a_lost_executor_is_not_a_data_error(spark):
    class Lost:
        def fit(self, df):
            raise RuntimeError("executor lost")

    with pytest.raises(RuntimeError):
        C.fit_or_uniform(Lost, None)


def test_invariants_of_rows_only_queries(spark):
    limiter = CATALOG["stream_rate_limit"](spark, SMALL)
    assert limiter.filter(~F.col("accepted").eqNullSafe(F.col("stream_accepted"))).count() == 0
    row = CATALOG["stream_ingest_quality"](spark, SMALL)
    assert row.count() == 200
    topics = CATALOG["topics"](spark, SMALL)
    total = sum((F.col(f"topic_{i}") for i in range(10)), F.lit(0.0))
    assert topics.agg(F.max(F.abs(total - 1))).first()[0] < 1e-6
    alerts = {(r["feature_name"], r["severity"]) for r in CATALOG["stream_drift"](spark, SMALL).collect()}
    batch = {(r["feature_name"], r["severity"]) for r in CATALOG["drift_alerts"](spark, SMALL).collect()}
    assert alerts == batch
    assert CATALOG["production_features"](spark, SMALL).columns == ["post_id", *__import__("sentiloom.lexicons", fromlist=["x"]).PRODUCTION_43]


def test_limiter_over_several_batches(spark):
    """Calls arrive in three runs; the state carries over and the verdicts equal one batch run."""
    from sentiloom.operators.monitoring import rate_limit_decisions

    calls = spark.range(600).select(F.col("id").alias("request_id"), F.lit("c").alias("client"), F.timestamp_micros(1704067200000000 + F.col("id") * 400_000).alias("ts"))
    source, target, checkpoint = (scratch_path(spark, n) for n in ("calls", "out", "cp"))
    for lo in (0, 200, 400):
        calls.filter(f"request_id >= {lo} and request_id < {lo + 200}").write.mode("append").parquet(source)
        J.stream_rate_limit(spark.readStream.schema(calls.schema).parquet(source), target, checkpoint)
    streamed = {r["request_id"]: r["accepted"] for r in spark.read.parquet(target).collect()}
    assert streamed == {r["request_id"]: r["accepted"] for r in rate_limit_decisions(calls).collect()}
    assert not all(streamed.values())


def test_late_rows_are_counted_and_the_bound_is_a_parameter(spark):
    times = [1704067200, 1704067200 + 86_400, 1704067200 + 90_000, 1704067200 + 60]
    for lateness, late in (("1 hour", 1), ("3 days", 0)):
        source, target, checkpoint = (scratch_path(spark, n) for n in ("late", "late-out", "late-cp"))
        dropped = []
        for i, t in enumerate(times):
            one = spark.createDataFrame([(f"p{i}", t)], "post_id string, t long").select("post_id", F.timestamp_seconds("t").alias("created_utc"))
            one.write.mode("append").parquet(source)
            dropped.append(J.stream_dedup(spark.readStream.schema(one.schema).parquet(source), target, checkpoint, lateness))
        assert sum(dropped) == late and spark.read.parquet(target).count() == 4 - late
    assert [r.run.count("-") for r in spark.read.parquet(target).select("run").distinct().collect()] == [4]  # the query id


def test_critical_batch_stops_the_ingest(spark):
    bad = spark.createDataFrame([("1", None, None)] * 20, "id string, title string, selftext string")
    landing, target, checkpoint = (scratch_path(spark, n) for n in ("bad", "bad-out", "bad-cp"))
    bad.write.json(landing)
    with pytest.raises(Exception, match="critical"):
        J.stream_ingest_quality(P.read_landing(spark, landing, streaming=True), target, checkpoint, "2024-01-02 00:00:00")
    assert spark.read.parquet(f"{target}/checks").count() == 5


def test_empty_table_writes_nothing(spark, views):
    assert K.write_posts(views.posts.limit(0), scratch_path(spark, "none")) == ""


def test_typed_table_rejects_missing_required_column(spark):
    from sentiloom.schemas import TABLES

    assert P.to_declared(spark.createDataFrame([("1",)], "post_id string"), "posts").columns == TABLES["posts"].names


def test_a_repeat_never_passes(spark):
    """Batches months apart, a restart with the same checkpoint, a new checkpoint, and a batch that runs twice."""
    source, target, checkpoint = (scratch_path(spark, n) for n in ("whole", "whole-out", "whole-cp"))

    def land(rows):
        one = spark.createDataFrame(rows, "post_id string, t long, x int").select("post_id", F.timestamp_seconds("t").alias("created_utc"), "x").coalesce(1)
        one.write.mode("append").parquet(source)
        return one.schema

    def run(place):
        J.stream_dedup_whole(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), target, place, 4)
        return sorted((r.post_id, r.x) for r in spark.read.parquet(f"{target}/posts").collect())

    schema = land([("a", 1_700_000_000, 1), ("b", 1_700_000_000, 2), ("a", 1_600_000_000, 3), (None, 1, 9)])
    assert run(checkpoint) == [("a", 3), ("b", 2)]
    land([("a", 1_750_000_000, 4), ("c", 1_750_000_000, 5)])
    land([("c", 1_400_000_000, 6), ("d", 1, 7)])
    want = [("a", 3), ("b", 2), ("c", 5), ("d", 7)]
    assert run(checkpoint) == want and run(checkpoint) == want
    assert run(scratch_path(spark, "whole-cp-2")) == want  # all files again, under another run


def test_the_seen_ids_are_not_shuffled(spark):
    target = scratch_path(spark, "seen")
    name = J._key_table(spark, target, "string", 4)
    spark.range(100).selectExpr("cast(id as string) post_id", "'r' run", "id % 3 batch").repartition(4, "post_id").write.mode("append").insertInto(name)
    batch = spark.createDataFrame([("7", 1), ("x", 1), ("x", 2)], "post_id string, created_utc int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = J.unseen(batch, spark.table(name).filter("batch < 9"), 4)
        plan = left._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert [(r.post_id, r.created_utc) for r in left.collect()] == [("x", 1)]
    store = plan[plan.index("Sort [_seen") :]  # the right side of the join
    assert "SortMergeJoin" in plan and "Bucketed: true" in store and "Exchange" not in store, plan
    spark.sql(f"DROP TABLE {name}")


def test_panes_stay_within_the_rank_error(spark):
    """A pane and a window with far more values than the sketch keeps."""
    log = spark.range(60_000).select(
        F.timestamp_seconds(1_704_067_200 + F.col("id") % 60).alias("predicted_at"), (F.col("id") % 10 != 0).alias("success"),
        F.when(F.col("id") % 7 != 0, ((F.col("id") * 7919) % 60_013).cast("double")).alias("response_time_ms"))
    source, target, checkpoint = (scratch_path(spark, n) for n in ("panes", "panes-out", "panes-cp"))
    log.repartition(3).write.parquet(source)
    J.stream_sliding_rates(spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(source), target, checkpoint)
    rates = {r.slot.timestamp() - 1_704_067_200: r for r in J.sliding_rates(J.final_state(spark, target, ["pane"])).collect()}
    assert len(rates) == 11 and rates[0].calls == 60_000 and rates[0].error_rate == pytest.approx(0.1)
    whole = np.sort([r.response_time_ms for r in log.filter("response_time_ms is not null").collect()])
    assert abs(np.searchsorted(whole, rates[0].p95_ms) / len(whole) - 0.95) < 0.002


def test_alert_slots_in_any_order_and_batch(spark):
    rng = np.random.default_rng(5)
    states = {m: rng.random(200) < 0.7 for m in ("m1", "m2")}
    rows = [(m, 3600 * k, bool(on)) for m, series in states.items() for k, on in enumerate(series) if k % 37]  # some slots are missing
    order = rng.permutation(len(rows))
    source, target, checkpoint = (scratch_path(spark, n) for n in ("holds", "holds-out", "holds-cp"))
    frame = lambda part: spark.createDataFrame(part, "model_name string, t long, bad boolean").select("model_name", F.timestamp_seconds("t").alias("slot"), "bad")
    for part in np.array_split(order, 5):
        one = frame([rows[i] for i in part]).coalesce(1)
        one.write.mode("append").parquet(source)
    frame([("end", 3600 * 2000, False)]).write.mode("append").parquet(source)
    stream = spark.readStream.schema(one.schema).option("maxFilesPerTrigger", 1).parquet(source)
    J.stream_alert_hold(stream, F.col("bad"), 3 * 3600, 3600, target, checkpoint, "300 hours")
    got = sorted((r.model_name, r.since_us // 3_600_000_000, r.fired_us // 3_600_000_000) for r in spark.read.parquet(target).collect())
    want = []
    for m, series in states.items():
        run = 0
        for k in range(201):
            run = run + 1 if k < 200 and k % 37 and series[k] else 0
            if run == 3:
                want.append((m, k - 2, k))
    assert got == sorted(want) and len(want) > 10
