"""Readers and writers, each as a round trip through the shared folder."""

from pyspark.sql import functions as F

from sentiloom.operators import evaluation as E
from sentiloom.operators.quality import run_checks
from sentiloom.plans.catalog.c_eval import _SCALAR
from sentiloom.plans.catalog.c_quality import _ALL, AS_OF, messy
from sentiloom.plans.catalog.c_text import r6
from sentiloom.plans.registry import query
from sentiloom.schemas import POSTS, TABLES
from sentiloom.sources import posts as P
from sentiloom.sources import sinks as K
from sentiloom.session import scratch_path

_POST_COLS = "post_id, title, content, author, created_utc, score, upvote_ratio, num_comments, subreddit, is_self"


def declared_posts(v):
    return P.to_declared(v.posts, "posts")


@query("read_posts_csv", f"SELECT {_POST_COLS} FROM posts", "posts")
def _read_posts_csv(v):
    path = K.write_posts(declared_posts(v), scratch_path(v.spark, "csv"), "csv")
    return P.read_posts_csv(v.spark, path).select(*_POST_COLS.split(", "))


@query("write_posts", f"SELECT {_POST_COLS}, CAST(created_utc AS DATE)::VARCHAR AS dt FROM posts", "posts")
def _write_posts(v):
    path = K.write_posts(declared_posts(v), scratch_path(v.spark, "posts"))
    back = v.spark.read.parquet(path)
    return back.select(*_POST_COLS.split(", "), F.col("dt").cast("string").alias("dt"))


@query("read_latest_file", f"SELECT {_POST_COLS}, 'second' AS run FROM posts", "posts")
def _read_latest_file(v):
    path = scratch_path(v.spark, "runs")
    rows = v.posts.select(*_POST_COLS.split(", ")).repartition(8, "post_id")  # several part files a run
    rows.withColumn("run", F.lit("first")).write.parquet(f"{path}/a")
    again = v.spark.read.schema(rows.schema).parquet(f"{path}/a")  # what the first run wrote: the posts are joined and dealt out once
    again.withColumn("run", F.lit("second")).write.parquet(f"{path}/b")
    return P.read_latest_file(v.spark, f"{path}/*")


@query("normalize_raw_posts", """
SELECT id AS post_id, title, selftext AS content, coalesce(author, '[deleted]') AS author,
 make_timestamp((created_utc * 1000000)::BIGINT) AS created_utc, score, upvote_ratio, num_comments, subreddit, url,
 'https://reddit.com' || permalink AS permalink, is_self FROM raw_posts""", "raw_posts")
def _normalize_raw_posts(v):
    path = scratch_path(v.spark, "landing")
    v.raw_posts.write.json(path)
    return P.normalize_raw_posts(P.read_landing(v.spark, path)).drop("collected_at", "link_flair_text")


@query("write_quality_report", _ALL + """
SELECT count(*) AS total_checks, sum((NOT passed AND severity = 'critical')::INT)::BIGINT AS critical_issues, count(*) AS details FROM checks""", "posts")
def _write_quality_report(v):
    path = scratch_path(v.spark, "report")
    K.write_quality_report(run_checks(messy(v), AS_OF), path)
    return v.spark.read.json(path).select("summary.total_checks", "summary.critical_issues", F.size("detailed_results").alias("details"))


@query("typed_tables", """
SELECT post_id, model_name, NULL::VARCHAR AS model_version, sentiment_label, confidence_score, predicted_at, response_time_ms, success, api_key
FROM predictions""", "predictions")
def _typed_tables(v):
    path = scratch_path(v.spark, "predictions")
    K.write_declared(v.predictions, "predictions", path)
    return v.spark.read.schema(TABLES["predictions"]).parquet(path).drop("probabilities")


def _typed(v, df, table):
    path = scratch_path(v.spark, table)
    K.write_declared(df, table, path)
    return v.spark.read.schema(TABLES[table]).parquet(path)


@query("typed_probabilities", """
SELECT prediction_id % 1000 AS slot, count(*) AS n, round(sum(confidence_score), 6) AS total FROM predictions GROUP BY 1""", "predictions")
def _typed_probabilities(v):
    # the map column comes back whole: its one entry holds the confidence
    rows = v.predictions.withColumn("probabilities", F.create_map("sentiment_label", "confidence_score")).withColumn("model_version", F.col("prediction_id").cast("string"))
    back = _typed(v, rows, "predictions")
    return back.groupBy((F.col("model_version").cast("bigint") % 1000).alias("slot")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.element_at("probabilities", F.col("sentiment_label"))), 6).alias("total"))


@query("typed_posts", f"SELECT {_POST_COLS} FROM posts", "posts")
def _typed_posts(v):
    return _typed(v, v.posts, "posts").select(*_POST_COLS.split(", "))


@query("typed_text_features", """
SELECT post_id, lower(content) AS cleaned_text, length(content)::INT AS text_length, len(regexp_extract_all(content, '[^ ]+'))::INT AS word_count,
 score / 4.0::DOUBLE AS sentiment_polarity, NULL::DOUBLE AS sentiment_subjectivity, subreddit AS language, created_utc AS processed_at FROM posts""", "posts")
def _typed_text_features(v):
    return _typed(v, v.posts.select(
        "post_id", F.lower("content").alias("cleaned_text"), F.length("content").alias("text_length"), F.regexp_count("content", F.lit("[^ ]+")).alias("word_count"),
        (F.col("score") / 4).alias("sentiment_polarity"), F.col("subreddit").alias("language"), F.col("created_utc").alias("processed_at")), "text_features")


@query("typed_performance_metrics", """
SELECT model_name, 'v1' AS model_version, 'avg_confidence' AS metric_name, round(avg(confidence_score), 6) AS metric_value, 'test' AS dataset_type,
 max(predicted_at) AS recorded_at FROM predictions GROUP BY 1""", "predictions")
def _typed_performance_metrics(v):
    rows = v.predictions.groupBy("model_name").agg(F.round(F.avg("confidence_score"), 6).alias("metric_value"), F.max("predicted_at").alias("recorded_at"))
    return _typed(v, rows.withColumns({"model_version": F.lit("v1"), "metric_name": F.lit("avg_confidence"), "dataset_type": F.lit("test")}), "performance_metrics")


@query("typed_quality_metrics", _ALL + f"""
SELECT 'b7' AS batch_id, metric_name, round(metric_value, 6) AS metric_value, threshold AS threshold_value,
 CASE WHEN passed THEN 'passed' WHEN severity = 'warning' THEN 'warning' ELSE 'failed' END AS status, TIMESTAMP '{AS_OF}' AS recorded_at FROM checks""", "posts")
def _typed_quality_metrics(v):
    path = scratch_path(v.spark, "quality-metrics")
    K.write_quality_metrics(run_checks(messy(v), AS_OF), "b7", AS_OF, path)
    return v.spark.read.schema(TABLES["quality_metrics"]).parquet(path).drop("batch").withColumn("metric_value", F.round("metric_value", 6))


@query("high_low_outputs", """
SELECT post_id, CASE WHEN label_confidence >= 0.6 AND label_agreement >= 0.67 THEN 'high' ELSE 'low' END AS band FROM labeled""", "labeled")
def _high_low_outputs(v):
    path = scratch_path(v.spark, "bands")
    K.write_bands(v.labeled, path)
    return v.spark.read.parquet(path).select("post_id", "band")


@query("write_comparison", f"""SELECT model, round(accuracy, 6) AS accuracy, round(f1_weighted, 6) AS f1_weighted,
 round(precision_weighted, 6) AS precision_weighted, round(recall_weighted, 6) AS recall_weighted,
 f1_weighted = max(f1_weighted) OVER () AS is_best FROM {_SCALAR}""", "scored")
def _write_comparison(v):
    path = scratch_path(v.spark, "comparison")
    matrix = E.confusion_matrix(v.scored, ["model"])
    rows = E.flatten_metrics(E.classification_metrics(matrix, ["model"]).drop("support"), E.per_class_metrics(matrix, ["model"]), ["model"])
    K.write_comparison(E.compare_models(rows), path)
    back = v.spark.read.schema("model string, " + ", ".join(f"{m} double" for m in E.COMPARED) + ", is_best boolean")
    return back.option("header", True).csv(path).select("model", *r6(*E.COMPARED), "is_best")
