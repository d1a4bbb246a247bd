"""Quality checks, constraints, referential checks and counts."""

from pyspark.sql import functions as F

from sentiloom.operators import joins as J
from sentiloom.operators import quality as Q
from sentiloom.operators import statistics as ST
from sentiloom.functions import sentiment as S
from sentiloom.plans import oracle as O
from sentiloom.plans.catalog.c_features import POLAR
from sentiloom.plans.catalog.c_text import r6
from sentiloom.plans.registry import query

AS_OF = "2024-01-02 00:00:00"

# posts with repeated and missing ids
_MESSY = """(SELECT CASE WHEN score > 150 THEN NULL ELSE post_id END AS post_id, title, content, created_utc, subreddit, author,
 score, num_comments FROM posts
 UNION ALL SELECT post_id, title, content, created_utc, subreddit, author, score, num_comments FROM posts WHERE score > 60) m"""


def messy(v):
    cols = ["post_id", "title", "content", "created_utc", "subreddit", "author", "score", "num_comments"]
    base = v.posts.select(*cols)
    first = base.withColumn("post_id", F.when(F.col("score") <= 150, F.col("post_id")))
    return first.union(base.filter(F.col("score") > 60))


_TOTALS = f"""SELECT count(*) AS n,
 (count(post_id)::DOUBLE / count(*) + count(title)::DOUBLE / count(*) + count(content)::DOUBLE / count(*)
  + count(created_utc)::DOUBLE / count(*) + count(subreddit)::DOUBLE / count(*)) / 5 AS complete,
 (count(*) - count(DISTINCT post_id) - max(CAST(post_id IS NULL AS INT))) AS copies,
 sum(CAST(length({O.FULL_TEXT}) < 10 AS INT)) AS short, sum(CAST(length({O.FULL_TEXT}) > 10000 AS INT)) AS long,
 avg(date_diff('microsecond', created_utc, TIMESTAMP '{AS_OF}') / 3.6e9) AS mean_age,
 sum(CAST(date_diff('microsecond', created_utc, TIMESTAMP '{AS_OF}') / 3.6e9 <= 48 AS INT))::DOUBLE / count(*) AS fresh
FROM {_MESSY}"""


def _check(name, value, threshold, passed, warn):
    return (f"SELECT '{name}' AS metric_name, {passed} AS passed, round({value}, 6) AS metric_value, {threshold}::DOUBLE AS threshold, "
            f"CASE WHEN {passed} THEN 'info' WHEN {warn} THEN 'warning' ELSE 'critical' END AS severity FROM totals")


_CHECKS = {
    "data_completeness": _check("data_completeness", "complete", 0.95, "complete >= 0.95", "complete > 0.9"),
    "duplicate_rate": _check("duplicate_rate", "copies::DOUBLE / n", 0.05, "copies::DOUBLE / n <= 0.05", "copies::DOUBLE / n < 0.1"),
    "text_quality": _check("text_quality", "(n - short - long)::DOUBLE / n", 0.9, "(n - short - long)::DOUBLE / n >= 0.9",
                           "(n - short - long)::DOUBLE / n > 0.8"),
    "data_freshness": _check("data_freshness", "mean_age", 48, "fresh >= 0.5", "true"),
    "schema_validation": _check("schema_validation", "1.0::DOUBLE", 1, "true", "true"),
}


def _one_check(query_name, metric):
    @query(query_name, f"WITH totals AS ({_TOTALS}) {_CHECKS[metric]}", "posts")
    def _run(v):
        return Q.run_checks(messy(v), AS_OF).filter(F.col("metric_name") == metric).select(
            "metric_name", "passed", *r6("metric_value"), "threshold", "severity")


for _name, _metric in {"check_completeness": "data_completeness", "check_duplicates": "duplicate_rate",
                       "check_text_quality": "text_quality", "check_freshness": "data_freshness",
                       "check_schema": "schema_validation"}.items():
    _one_check(_name, _metric)

_ALL = f"WITH totals AS ({_TOTALS}), checks AS ({' UNION ALL '.join(_CHECKS.values())}) "


@query("quality_summary", _ALL + """
SELECT count(*) AS total_checks, sum(passed::INT)::BIGINT AS passed_checks, sum((NOT passed)::INT)::BIGINT AS failed_checks,
 sum((NOT passed AND severity = 'critical')::INT)::BIGINT AS critical_issues,
 sum((NOT passed AND severity = 'warning')::INT)::BIGINT AS warnings,
 sum((NOT passed AND severity = 'critical')::INT) = 0 AS overall_passed FROM checks""", "posts")
def _quality_summary(v):
    return Q.quality_summary(Q.run_checks(messy(v), AS_OF))


@query("checks_without_ids", """
WITH rows AS (SELECT title, content, subreddit, score FROM posts UNION ALL SELECT title, content, subreddit, score FROM posts WHERE score > 50)
SELECT 'column_completeness' AS metric_name, false AS passed, 0.0::DOUBLE AS metric_value, 'critical' AS severity
UNION ALL SELECT 'duplicate_rate', r <= 0.05, round(r, 6), CASE WHEN r <= 0.05 THEN 'info' WHEN r < 0.10 THEN 'warning' ELSE 'critical' END
 FROM (SELECT 1 - (SELECT count(*) FROM (SELECT DISTINCT * FROM rows) d)::DOUBLE / count(*) AS r FROM rows) x
UNION ALL SELECT 'data_freshness', false, NULL, 'critical'""", "posts")
def _checks_without_ids(v):
    slim = v.posts.select("title", "content", "subreddit", "score")
    checks = Q.run_checks(slim.unionByName(slim.filter("score > 50")), AS_OF)
    return checks.filter(F.col("metric_name").isin("column_completeness", "duplicate_rate", "data_freshness")).select(
        "metric_name", "passed", *r6("metric_value"), "severity")


@query("severity_grade", _ALL + """
SELECT metric_name, severity, CASE WHEN passed THEN 'passed' WHEN severity = 'warning' THEN 'warning' ELSE 'failed' END AS status
FROM checks""", "posts")
def _severity_grade(v):
    checks = Q.run_checks(messy(v), AS_OF)
    log = Q.quality_metrics(checks, "b1", AS_OF).select("metric_name", "status")
    return checks.select("metric_name", "severity").join(log, "metric_name")


@query("check_constraints", """
SELECT 'allowed_sentiment_label' AS rule, sum(CAST(label NOT IN ('positive', 'negative', 'neutral') AS INT))::BIGINT AS violations FROM x
UNION ALL SELECT 'allowed_source', sum(CAST(source NOT IN ('reddit', 'twitter', 'news', 'kaggle') AS INT))::BIGINT FROM x
UNION ALL SELECT 'allowed_dataset_type', sum(CAST(dataset_type NOT IN ('train', 'validation', 'test') AS INT))::BIGINT FROM x
UNION ALL SELECT 'allowed_status', sum(CAST(status NOT IN ('passed', 'failed', 'warning') AS INT))::BIGINT FROM x
UNION ALL SELECT 'not_null_post_id', count(*) - count(post_id) FROM x
UNION ALL SELECT 'not_null_content', count(*) - count(content) FROM x
UNION ALL SELECT 'not_null_created_utc', count(*) - count(created_utc) FROM x""".replace("FROM x", """FROM (
 SELECT *, CASE WHEN score < 0 THEN 'mixed' ELSE 'positive' END AS label,
 CASE WHEN is_self THEN 'reddit' ELSE subreddit END AS source,
 CASE WHEN score > 10 THEN 'train' WHEN score > 0 THEN 'holdout' END AS dataset_type,
 CASE WHEN num_comments > 50 THEN 'passed' ELSE 'unknown' END AS status FROM posts) x"""), "posts")
def _check_constraints(v):
    df = v.posts.withColumns({
        "sentiment_label": F.when(F.col("score") < 0, "mixed").otherwise("positive"),
        "source": F.when(F.col("is_self"), "reddit").otherwise(F.col("subreddit")),
        "dataset_type": F.when(F.col("score") > 10, "train").when(F.col("score") > 0, "holdout"),
        "status": F.when(F.col("num_comments") > 50, "passed").otherwise("unknown")})
    return Q.check_constraints(df, Q.ALLOWED, Q.NOT_NULL["posts"])


@query("collection_report", """
SELECT count(*) AS total_records, 11 AS total_features, count(DISTINCT subreddit) AS subreddits_covered,
 min(created_utc) AS first_created, max(created_utc) AS last_created FROM posts""", "posts")
def _collection_report(v):
    return ST.collection_report(v.posts.drop("is_self").withColumns({"is_self": F.lit(1), "extra": F.lit(0)}))


@query("value_counts", """
SELECT upvote_ratio AS value, count(*) AS count, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share
FROM posts WHERE upvote_ratio IS NOT NULL GROUP BY upvote_ratio""", "posts")
def _value_counts(v):
    return ST.value_counts(v.posts, "upvote_ratio").select(F.col("upvote_ratio").alias("value"), "count", *r6("share"))


@query("sorted_counts", """
SELECT subreddit, count(*) AS count FROM posts GROUP BY subreddit ORDER BY count DESC, subreddit""", "posts")
def _sorted_counts(v):
    return ST.sorted_counts(v.posts, "subreddit").select("subreddit", "count")


_STATS = f"""
SELECT subreddit, avg(score) AS subreddit_avg_score, stddev_samp(score) AS subreddit_std_score,
 median(score) AS subreddit_median_score, avg(num_comments) AS subreddit_avg_comments,
 stddev_samp(num_comments) AS subreddit_std_comments, median(num_comments) AS subreddit_median_comments,
 avg(sentiment_polarity) AS subreddit_avg_sentiment, stddev_samp(sentiment_polarity) AS subreddit_std_sentiment
FROM posts JOIN ({POLAR}) pol USING (post_id) GROUP BY subreddit"""
_STAT_COLS = ["subreddit_avg_score", "subreddit_std_score", "subreddit_median_score", "subreddit_avg_comments",
              "subreddit_std_comments", "subreddit_median_comments", "subreddit_avg_sentiment", "subreddit_std_sentiment"]


def polar_posts(v):
    """Posts narrowed to what the forum statistics need."""
    return S.polarity_score(v.cleaned).select("post_id", "subreddit", "score", "num_comments", "sentiment_polarity")


@query("subreddit_stats", f"SELECT subreddit, {', '.join(O.r6(c, c) for c in _STAT_COLS)} FROM ({_STATS}) s", "posts")
def _subreddit_stats(v):
    return ST.subreddit_stats(polar_posts(v)).select("subreddit", *r6(*_STAT_COLS))


@query("join_subreddit_stats", f"""
SELECT post_id, subreddit, {', '.join(O.r6(c, c) for c in _STAT_COLS[:3])} FROM posts LEFT JOIN ({_STATS}) s USING (subreddit)""",
       "posts")
def _join_subreddit_stats(v):
    posts = polar_posts(v)
    return J.join_stats(posts.select("post_id", "subreddit"), ST.subreddit_stats(posts), "subreddit").select(
        "post_id", "subreddit", *r6(*_STAT_COLS[:3]))


@query("relative_to_group", f"""
SELECT p.post_id, round(score::DOUBLE / nullif(subreddit_avg_score + 1, 0), 6) AS score_vs_subreddit_avg,
 round(pol.sentiment_polarity - subreddit_avg_sentiment, 6) + 0 AS sentiment_vs_subreddit_avg
FROM posts p JOIN ({POLAR}) pol USING (post_id) LEFT JOIN ({_STATS}) s USING (subreddit)""", "posts")
def _relative_to_group(v):
    posts = polar_posts(v)
    means = posts.groupBy("subreddit").agg(F.avg("score").alias("subreddit_avg_score"),
                                           F.avg("sentiment_polarity").alias("subreddit_avg_sentiment"))
    return ST.relative_to_group(posts, means).select(
        "post_id", *[(F.round(c, 6) + 0).alias(c) for c in ("score_vs_subreddit_avg", "sentiment_vs_subreddit_avg")])


@query("attach_by_key", f"""
SELECT p.post_id, p.subreddit, h.sentiment_polarity FROM posts p
LEFT JOIN (SELECT post_id, round(sentiment_polarity, 6) AS sentiment_polarity FROM ({POLAR}) x WHERE hits > 1) h USING (post_id)""",
       "posts")
def _attach_by_key(v):
    from sentiloom.plans.catalog.c_sentiment import _lexicon_join

    features = _lexicon_join(v).filter("hits > 1").select("post_id", "sentiment_polarity")
    return J.attach_by_key(v.posts.select("post_id", "subreddit"), features)


_LATEST = """SELECT p.prediction_id, p.post_id, o.title, o.subreddit, o.created_utc, p.model_name, p.sentiment_label,
 p.confidence_score, p.predicted_at FROM predictions p JOIN posts o ON p.post_id = o.post_id
WHERE p.predicted_at = (SELECT max(p2.predicted_at) FROM predictions p2 WHERE p2.post_id = p.post_id)"""


@query("latest_predictions", _LATEST, "predictions posts")
def _latest_predictions(v):
    return J.latest_predictions(v.predictions, v.posts).select(
        "prediction_id", "post_id", "title", "subreddit", "created_utc", "model_name", "sentiment_label",
        "confidence_score", "predicted_at")


@query("latest_rank", """
SELECT prediction_id, post_id, 1 AS latest_rank FROM (SELECT *, rank() OVER (PARTITION BY post_id ORDER BY predicted_at DESC) AS r
 FROM predictions) x WHERE r = 1""", "predictions")
def _latest_rank(v):
    return J.latest_rank(v.predictions).select("prediction_id", "post_id", "latest_rank")


@query("orphan_rows", """
SELECT prediction_id, post_id FROM predictions p WHERE NOT EXISTS (SELECT 1 FROM posts o WHERE o.post_id = p.post_id)""",
       "predictions posts")
def _orphan_rows(v):
    return J.orphan_rows(v.predictions, v.posts).select("prediction_id", "post_id")


@query("cascade_retain", """
SELECT prediction_id, post_id FROM predictions WHERE post_id IN (SELECT post_id FROM posts WHERE score >= 0)""", "predictions posts")
def _cascade_retain(v):
    return J.cascade_retain(v.predictions, v.posts.filter("score >= 0")).select("prediction_id", "post_id")


@query("dedup_keep_first", """
SELECT post_id, title, subreddit, score, category, run FROM (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY run) AS r
 FROM collections) x WHERE r = 1""", "collections")
def _dedup_keep_first(v):
    return ST.dedup_keep_first(v.collections)


@query("union_collections", """
SELECT post_id, subreddit, score, category, run, note FROM (
 SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY run) AS r FROM (
  SELECT post_id, subreddit, score, category, run, NULL::VARCHAR AS note FROM collections WHERE run < 3
  UNION ALL SELECT post_id, subreddit, score, category, run, 'late' FROM collections WHERE run = 3) u) x WHERE r = 1""", "collections")
def _union_collections(v):
    runs = v.collections.select("post_id", "subreddit", "score", "category", "run")
    parts = [runs.filter("run = 1"), runs.filter("run = 2"), runs.filter("run = 3").withColumn("note", F.lit("late"))]
    return ST.union_collections(parts)


@query("top_posts", """
SELECT subreddit, post_id, score, r AS rank, 'top' AS sort_by FROM (SELECT *, row_number() OVER (PARTITION BY subreddit
 ORDER BY score DESC, post_id) AS r FROM posts WHERE created_utc >= TIMESTAMP '2024-01-02 00:00:00') x WHERE r <= 5
UNION ALL SELECT subreddit, post_id, score, r, 'new' FROM (SELECT *, row_number() OVER (PARTITION BY subreddit
 ORDER BY created_utc DESC, post_id) AS r FROM posts) x WHERE r <= 5""", "posts")
def _top_posts(v):
    slim = v.posts.select("subreddit", "post_id", "score", "created_utc")
    since = F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")
    top = ST.top_posts(slim, 5, "top", since).withColumn("sort_by", F.lit("top"))
    return top.union(ST.top_posts(slim, 5, "new").withColumn("sort_by", F.lit("new"))).drop("created_utc")


@query("samples_per_label", """
SELECT auto_label, post_id, label_confidence, r AS sample_no FROM (SELECT *, row_number() OVER (PARTITION BY auto_label ORDER BY post_id) AS r
 FROM labeled) x WHERE r <= 3""", "labeled")
def _samples_per_label(v):
    return ST.samples_per_label(v.labeled.select("auto_label", "post_id", "label_confidence"))


@query("tail_fraction", """
SELECT post_id, created_utc FROM (SELECT *, row_number() OVER (ORDER BY created_utc, post_id) AS r, count(*) OVER () AS n FROM posts) x
WHERE r > n - floor(n * 0.2)""", "posts")
def _tail_fraction(v):
    from sentiloom.operators.sampling import tail_fraction

    return tail_fraction(v.posts.select("post_id", "created_utc"), ["created_utc", "post_id"], 0.2)
