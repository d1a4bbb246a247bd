"""Brute-force and invariant checks of the operators, with hot groups."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentiloom.operators import augment as A
from sentiloom.operators import drift as D
from sentiloom.operators import evaluation as EV
from sentiloom.operators import frames, joins, labeling, monitoring, quality, ranking, sampling, statistics


def test_group_positions_with_a_hot_group(spark):
    rnd = random.Random(1)
    rows = [(0 if rnd.random() < 0.5 else rnd.randint(1, 5), rnd.randint(0, 20), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g int, x int, id int").repartition(7)
    got = {r["id"]: (r["pos"], r["group_size"]) for r in ranking.with_group_position(df, ["g"], ["x", "id"]).collect()}
    for g in range(6):
        ordered = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2]))
        assert [got[r[2]] for r in ordered] == [(i, len(ordered)) for i in range(len(ordered))]


@pytest.mark.parametrize("n", [1, 2, 100, 101])
def test_quantiles(spark, n):
    rnd = random.Random(n)
    xs = [float(rnd.randint(0, 30)) for _ in range(n)]
    df = spark.createDataFrame([("a", x) for x in xs] + [("b", 1.0)], "g string, x double")
    probs = [0.25, 0.5, 0.9, 0.95]
    linear = {r["prob"]: r["quantile"] for r in ranking.exact_quantiles(df, ["g"], "x", probs).filter("g = 'a'").collect()}
    index = {r["prob"]: r["quantile"] for r in ranking.exact_quantiles(df, ["g"], "x", probs, False).filter("g = 'a'").collect()}
    for p in probs:
        assert linear[p] == pytest.approx(np.quantile(xs, p))
        assert index[p] == sorted(xs)[min(int(n * p), n - 1)]


def test_rolling_mean_over_block_borders(spark):
    rnd = random.Random(3)
    rows = [(i % 2 if i % 3 else 0, i, rnd.randint(0, 9)) for i in range(200)]
    df = spark.createDataFrame(rows, "g int, id int, x int")
    out = ranking.rolling_mean(df, ["g"], ["id"], 5, {"m": "x"}, block=7).collect()
    assert len(out) == len(rows)
    for r in out:
        before = [x for g, i, x in rows if g == r["g"] and i <= r["id"]][-5:]
        assert r["m"] == pytest.approx(sum(before) / len(before))


def limiter_by_hand(calls, limit, span):
    held, verdicts = {}, {}
    for rid, client, us in sorted(calls, key=lambda c: (c[1], c[2], c[0])):
        times = [t for t in held.get(client, []) if t >= us - span]
        verdicts[rid] = len(times) < limit
        held[client] = times + [us] if verdicts[rid] else times
    return verdicts


def test_rate_limiter(spark):
    exact = [(i, "c", i * 10_000) for i in range(101)] + [(101, "c", 60_001_000)]
    rnd = random.Random(5)
    clock, noisy = 0, []
    for i in range(1500):
        clock += rnd.choice([1_000, 200_000, 900_000, 130_000_000 if i % 400 == 0 else 5_000])
        noisy.append((1000 + i, rnd.choice("ab"), clock))
    calls = exact + noisy
    df = spark.createDataFrame(calls, "request_id bigint, client string, us bigint").withColumn("ts", F.timestamp_micros("us"))
    got = {r["request_id"]: r["accepted"] for r in monitoring.rate_limit_decisions(df).collect()}
    want = limiter_by_hand(calls, 100, 60_000_000)
    assert got == want and not want[100] and want[101]
    seen = {r["request_id"]: r["calls_in_window"] for r in monitoring.rate_limit_audit(df).collect()}
    for rid, client, us in calls:
        assert seen[rid] == sum(1 for _, c, t in calls if c == client and us - 60_000_000 <= t <= us)


@pytest.mark.parametrize("limit", ["-1", "10m"])
def test_joins_with_and_without_broadcast_a_null_group_and_a_map_column(spark, limit):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        words = spark.createDataFrame([(i, random.Random(i).choice(["the", "the", "moon", "x"])) for i in range(500)], "id int, word string")
        table = spark.createDataFrame([("the", 1.0), ("moon", 2.0)], "word string, v double")
        got = joins.dictionary_join(words, table, "word", "left").select("id", "word", "v").collect()
        assert len(got) == 500 and all(r.v == {"the": 1.0, "moon": 2.0}.get(r.word) for r in got)
        left = spark.createDataFrame([(None if i % 7 == 0 else i % 3, i, {"a": i}) for i in range(60)], "g int, id int, m map<string,int>")
        groups = left.groupBy("g").agg(F.count("*").alias("n"))
        out = joins.group_join(left, groups, ["g"])
        assert out.columns == ["g", "id", "m", "n"] and out.count() == 60
        assert {(r.g, r.n) for r in out.collect()} == {(r.g, r.n) for r in groups.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_rolling_mean_keeps_nan_and_large_values_to_their_frames(spark):
    xs = [0.1, 0.1, float("nan"), 0.1, 0.1, 1e17, 0.1, 0.1, 0.1, 0.1]
    df = spark.createDataFrame([(0, i, x) for i, x in enumerate(xs)], "g int, id int, x double")
    got = [r.m for r in ranking.rolling_mean(df, ["g"], ["id"], 2, {"m": "x"}, block=4).orderBy("id").collect()]
    assert [i for i, m in enumerate(got) if m != m] == [2, 3] and got[4] == pytest.approx(0.1) and got[8] == got[9] == pytest.approx(0.1)


def test_rolling_mean_equals_a_plain_one(spark):
    rnd = random.Random(8)
    xs = [rnd.choice([None, float("nan"), 1e17, 0.5, 0.25, 3.0]) if rnd.random() < 0.1 else rnd.random() for _ in range(400)]
    df = spark.createDataFrame([(i % 3 == 0, i, x) for i, x in enumerate(xs)], "g boolean, id int, x double")
    for rows, block in ((1, 1), (7, 14), (50, 60), (1000, 1)):
        got = {r.id: r.m for r in ranking.rolling_mean(df, ["g"], ["id"], rows, {"m": "x"}, block=block).collect()}
        assert len(got) == 400
        for g in (True, False):
            mine = [i for i in range(400) if (i % 3 == 0) == g]
            for n, i in enumerate(mine):
                frame = [xs[j] for j in mine[max(0, n - rows + 1) : n + 1] if xs[j] is not None]
                want = sum(frame) / len(frame) if frame else None
                assert got[i] == want if want is None else got[i] == pytest.approx(want, nan_ok=True), (rows, i)


def test_latest_rank_up_to(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), ("a", 3), ("a", 2), ("b", None)], "post_id string, predicted_at int")
    assert sorted(r.latest_rank for r in joins.latest_rank(df, 3).collect()) == [1, 1, 3]
    assert "WindowGroupLimit" in joins.latest_rank(df)._jdf.queryExecution().executedPlan().toString()


def test_latest_run_is_whole(spark, tmp_path):
    import os
    import time

    from sentiloom.sources.posts import latest_run, read_latest_file

    df = spark.range(100).repartition(8, "id")
    df.write.parquet(f"{tmp_path}/new")
    df.limit(3).write.parquet(f"{tmp_path}/old")
    past = time.time() - 5000
    for name in os.listdir(tmp_path / "old"):
        os.utime(tmp_path / "old" / name, (past, past))
    assert latest_run(spark, f"{tmp_path}/*").endswith("/new") and read_latest_file(spark, f"{tmp_path}/*").count() == 100


def test_splits_and_folds(spark):
    rows = [(f"{c}{i}", c) for c, n in (("a", 10), ("b", 100), ("c", 2)) for i in range(n)]
    df = spark.createDataFrame(rows, "post_id string, y string")
    counts = {(r["y"], r["split"]): r["n"] for r in sampling.stratified_split(df, "y").groupBy("y", "split").agg(F.count("*").alias("n")).collect()}
    assert counts[("b", "test")] == 15 and counts[("b", "val")] == 15 and counts[("b", "train")] == 70
    assert counts[("a", "test")] == 2 and sum(counts.values()) == 112
    # a class of one row turns stratification off: shares hold over the whole table only
    lone = df.union(spark.createDataFrame([("z", "z")], df.schema))
    total = {r["split"]: r["n"] for r in sampling.stratified_split(lone, "y").groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert total == {"test": 17, "val": 17, "train": 79}
    folds = sampling.stratified_kfold(df, "y", 5).groupBy("y", "fold").agg(F.count("*").alias("n")).collect()
    assert {r["n"] for r in folds if r["y"] == "b"} == {20} and {r["n"] for r in folds if r["y"] == "a"} == {2}
    assert sampling.tail_fraction(df, ["post_id"], 0.2).count() == 22


def test_quotas_and_copies(spark):
    words = "buy the dip and sell the rally soon today"
    rows = [(f"n{i}", 1, words) for i in range(100)] + [(f"p{i}", 2, words) for i in range(5)] + [(f"q{i}", 0, "short") for i in range(25)]
    df = spark.createDataFrame(rows, "post_id string, auto_label_id int, t string")
    quotas = {r["auto_label_id"]: r["quota"] for r in A.class_quotas(df, "auto_label_id", 0.3, 2).collect()}
    assert quotas == {1: 0, 2: 10, 0: 5}
    out = A.augment_minority_conservative(df, "t")
    made = out.filter("is_augmented")
    assert made.filter("auto_label_id = 2").count() == 10
    assert made.filter("auto_label_id = 0").count() == 0  # five copies, all unchanged and dropped
    assert out.filter("not is_augmented").count() == 130
    assert made.groupBy("post_id").count().agg(F.max("count")).first()[0] <= 2
    ratio = A.augment_minority_ratio(df, "t")
    assert {r["auto_label_id"]: r["count"] for r in ratio.groupBy("auto_label_id").count().collect()} == {0: 50, 1: 100, 2: 50}
    again = A.augment_minority_ratio(df, "t")
    assert ratio.exceptAll(again).count() == 0


def test_text_edits(spark):
    df = spark.createDataFrame([("1", "buy the dip before the big rally today"), ("2", "too short"), ("3", "alpha beta gamma delta epsilon zeta")],
                               "post_id string, t string")
    t, key = F.col("t"), ["post_id"]
    rows = {r["post_id"]: r for r in df.select("post_id", "t", A.synonym_replacement(t, key).alias("syn"), A.random_insertion(t, key).alias("ins"),
                                               A.random_swap(t, key).alias("swap"), A.random_deletion(t, key, p=0.1).alias("del")).collect()}
    for r in rows.values():
        assert sorted(r["swap"].split()) == sorted(r["t"].split())
        assert len(r["ins"].split()) in (len(r["t"].split()), len(r["t"].split()) + 1)
        assert len(r["del"].split()) >= 0.8 * len(r["t"].split())
    changed = [a != b for a, b in zip(rows["1"]["t"].split(), rows["1"]["syn"].split())]
    assert sum(changed) == 1
    assert rows["2"]["syn"] == rows["2"]["swap"] == "too short" and rows["3"]["syn"] == rows["3"]["t"]


def test_mixup_has_one_partner_per_row(spark):
    df = spark.createDataFrame([(f"{i}", i % 2, "a b c d") for i in range(20)], "post_id string, y int, t string")
    out = A.text_mixup(df, "t", "y").collect()
    assert len(out) == 20 and len({r["partner_id"] for r in out}) == 20
    assert all(len(r["mixed_text"].split()) == 4 and int(r["partner_id"]) % 2 == r["y"] for r in out)


def samples(spark, ref, new):
    return spark.createDataFrame([("f", "ref", float(x)) for x in ref] + [("f", "new", float(x)) for x in new], "feature string, side string, x double")


def psi_by_hand(ref, new):
    edges = np.histogram_bin_edges(ref, bins=10)
    r, n = np.histogram(ref, edges)[0] / len(ref), np.histogram(new, edges)[0] / len(new)
    r, n = np.where(r == 0, 0.0001, r), np.where(n == 0, 0.0001, n)
    return abs(np.sum((n - r) * np.log(n / r)))


def test_drift(spark):
    rnd = np.random.default_rng(0)
    ref, shifted = rnd.normal(0, 1, 500), rnd.normal(0.7, 1, 400)
    same = samples(spark, ref, ref)
    assert D.psi(same).first()["psi"] == pytest.approx(0) and D.ks_two_sample(same).first()["ks"] == 0
    row = D.psi(samples(spark, ref, shifted)).first()
    assert row["psi"] == pytest.approx(psi_by_hand(ref, shifted))  # values outside the reference range included
    ks = D.ks_two_sample(samples(spark, ref, shifted)).first()
    grid = np.concatenate([ref, shifted])
    by_hand = max(abs((ref <= x).mean() - (shifted <= x).mean()) for x in grid)
    assert ks["ks"] == pytest.approx(by_hand) and ks["p_value"] < 0.01
    assert D.psi(samples(spark, [3.0] * 20, [3.0] * 20)).first()["psi"] == pytest.approx(0)  # constant column
    few = D.drift_alerts(samples(spark, ref, [99.0] * 9), "2024-01-01")
    assert few.count() == 0  # nine new values are too few
    assert D.drift_alerts(samples(spark, ref, shifted), "2024-01-01").filter("severity = 'critical'").count() == 2
    table = spark.createDataFrame([(1, 2.0, "x")], "a int, b double, c string")
    assert {r["feature"] for r in D.to_samples(table, table.drop("b")).filter("side = 'new'").collect()} == {"a"}


def scored(spark, pairs):
    rows = [("m", t, p, 0.2, 0.3, 0.5) for t, p in pairs]
    return spark.createDataFrame(rows, "model string, y_true int, y_pred int, p_negative double, p_neutral double, p_positive double")


def test_kappa_and_mcc_edges(spark):
    def run(pairs):
        r = EV.kappa_mcc(EV.confusion_matrix(scored(spark, pairs), ["model"]), ["model"]).first()
        return r["cohen_kappa"], r["matthews_corrcoef"]

    assert run([(0, 0), (1, 1), (2, 2)]) == pytest.approx((1.0, 1.0))
    assert run([(0, 1), (1, 0)]) == pytest.approx((-1.0, -1.0))
    assert run([(1, 1), (1, 1)]) == (None, None)  # one class only: 0/0


def test_metrics_skip_absent_classes(spark):
    m = EV.classification_metrics(EV.confusion_matrix(scored(spark, [(0, 0), (0, 0), (1, 0)]), ["model"]), ["model"]).first()
    assert m["accuracy"] == pytest.approx(2 / 3)
    assert m["precision_macro"] == pytest.approx((2 / 3 + 0) / 2)  # class 2 does not occur
    cells = EV.confusion_matrix(scored(spark, [(0, 0)])).collect()
    assert len(cells) == 9 and sum(c["count"] for c in cells) == 1


def test_kappa_of_equal_annotators(spark):
    rows = [("a", "a", "b"), ("b", "b", "a"), ("a", "a", "a")]
    df = spark.createDataFrame(rows, "textblob_prediction string, vader_prediction string, finbert_prediction string")
    got = {r["pair"]: r["kappa"] for r in labeling.pairwise_kappa(df).collect()}
    assert got["textblob_prediction_vs_vader_prediction"] == pytest.approx(1.0)


def posts(spark, rows):
    return spark.createDataFrame(rows, "post_id string, title string, content string, created_utc timestamp_ntz, subreddit string, author string, "
                                       "score bigint, num_comments bigint")


def test_quality_checks(spark):
    import datetime as dt

    now = dt.datetime(2024, 1, 2)
    rows = [(str(i), "a title here", "some content", now, "s", "a", 1, 1) for i in range(17)]
    rows += [("0", "a title here", "some content", now, "s", "a", 1, 1)] * 2 + [(None, "a title here", "some content", now, "s", "a", 1, 1)]
    checks = {r["metric_name"]: r for r in quality.run_checks(posts(spark, rows), "2024-01-02 00:00:00").collect()}
    assert checks["duplicate_rate"]["metric_value"] == pytest.approx(2 / 20) and checks["duplicate_rate"]["severity"] == "critical"
    assert checks["data_completeness"]["metric_value"] == pytest.approx((19 / 20 + 4) / 5) and checks["data_completeness"]["passed"]
    assert checks["data_freshness"]["passed"] and checks["schema_validation"]["passed"]
    missing = quality.run_checks(posts(spark, rows).drop("title"), "2024-01-02").collect()
    # the missing column is a critical row, and the other checks still run
    by_name = {r["metric_name"]: r for r in missing}
    assert len(missing) == 5 and by_name["column_completeness"]["severity"] == "critical" and not by_name["column_completeness"]["passed"]
    assert by_name["duplicate_rate"]["metric_value"] == pytest.approx(2 / 20) and not by_name["schema_validation"]["passed"]
    no_ids = {r["metric_name"]: r for r in quality.run_checks(posts(spark, rows).drop("post_id"), "2024-01-02").collect()}
    assert no_ids["duplicate_rate"]["metric_value"] == pytest.approx(19 / 20)  # whole rows are compared
    empty = quality.quality_summary(quality.run_checks(posts(spark, []), "2024-01-02")).first()
    assert empty["total_checks"] == 5 and not empty["overall_passed"]


def test_bands_cover_every_row(spark):
    df = spark.createDataFrame([(0.6, 1.0), (0.59, 1.0), (0.9, 2 / 3), (None, 1.0), (0.9, None)], "label_confidence double, label_agreement double")
    high, low = frames.confidence_filter(df)
    assert (high.count(), low.count()) == (1, 4)
    high, low = frames.confidence_filter(df, min_agreement=0.66)
    assert (high.count(), low.count()) == (2, 3)
    with pytest.raises(ValueError):
        frames.train_row_filter(df)
    with pytest.raises(ValueError):
        frames.require_columns(df, ["nope"])


def test_dedup_is_idempotent(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 1, None)], "post_id string, run int, t string")
    once = statistics.dedup_keep_first(df)
    assert sorted((r["post_id"], r["t"] or "") for r in once.collect()) == [("a", "y"), ("b", "")]
    assert once.exceptAll(statistics.union_collections([once, df])).count() == 0
    with pytest.raises(ValueError):
        statistics.top_posts(df, 1, "controversial")


def test_alert_hold(spark):
    on = [1, 1, 0, 1, 1, 1, 0]
    df = spark.createDataFrame([("m", i * 60, float(x)) for i, x in enumerate(on)] + [("m", 600, 1.0), ("m", 660, 1.0)], "model_name string, s int, x double")
    series = df.withColumn("slot", F.timestamp_seconds("s"))
    out = monitoring.alert_hold(series, F.col("x") > 0, 180, 60).collect()
    assert [(r["since"].minute, r["slots"]) for r in out] == [(3, 3)]  # a gap in the slots ends a stretch


def test_hashed_dictionary_equals_a_join(spark, monkeypatch):
    from sentiloom.operators import dictionary, terms

    rnd = random.Random(12)
    rows = [(str(i), " ".join(rnd.choice(["aa", "bb", "cc dd", "éé", "zz9"]) for _ in range(rnd.choice([0, 1, 5, 60])))) for i in range(40)] + [("n", None)]
    df = spark.createDataFrame(rows, "post_id string, t string")
    vocabulary = terms.fit_vocabulary(df, "t", 50)
    words = terms.vocab_count(df, "t")
    lemmas = spark.createDataFrame([("aa", "a"), ("éé", "e"), ("none", "x"), (None, "y")], "word string, lemma string")
    split = df.filter("t is not null").selectExpr("post_id", "split(t, ' ') as w")

    def all_three():
        return [sorted(map(str, x.collect())) for x in (terms.tfidf(df, "t", vocabulary, True), terms.token_ids(df, "t", words, 9), joins.lemma_join(split, "w", lemmas))]

    looked_up = all_three()
    for x in (terms.token_ids(df, "t", words), joins.lemma_join(split, "w", lemmas)):
        main = x._jdf.queryExecution().executedPlan().toString().split("Subquery")[0]
        assert "Exchange" not in main and "Join" not in main
    monkeypatch.setattr(dictionary.hashed_dictionary, "__defaults__", ("word", 0))
    assert all_three() == looked_up and len(looked_up[0]) > 50


def test_empty_dictionary(spark):
    none = spark.createDataFrame([], "word string, lemma string")
    got = joins.lemma_join(spark.createDataFrame([("p", ["a", "b"])], "post_id string, w array<string>"), "w", none).collect()
    assert [r.lemmatized_text for r in got] == ["a b"]


def test_many_copies_of_one_row_are_made_by_several_tasks(spark):
    many = spark.range(400_000).select(F.col("id").cast("string").alias("post_id"), F.lit(1).alias("y"))
    df = spark.createDataFrame([("one", 0)], "post_id string, y int").unionByName(many)
    made = A.replicas(df, "y", 0.5, None, "post_id", 42).select("post_id", "copy_no")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the slim rows are too few bytes to be kept apart
    try:
        blocks = made.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"))
        spread = blocks.collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(r.n for r in spread) == 199_999 and len(spread) >= 4 and max(r.n for r in spread) < 120_000
    assert made.agg(F.min("copy_no"), F.max("copy_no"), F.count_distinct("copy_no")).first()[:] == (1, 199_999, 199_999)
