"""Declared table types (nullability follows the reference tables)."""

from pyspark.sql import types as T


def _struct(text: str, required: str = "") -> T.StructType:
    must = set(required.split())
    fields = []
    for item in text.split(","):
        name, kind = item.strip().split(" ", 1)
        fields.append(T.StructField(name, T._parse_datatype_string(kind) if "<" in kind else _SIMPLE[kind],
                                    name not in must))
    return T.StructType(fields)


_SIMPLE = {
    "string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(),
    "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "timestamp_ntz": T.TimestampNTZType(),
    "probs": T.MapType(T.StringType(), T.DoubleType()),
}

POSTS = _struct(
    "post_id string, title string, content string, author string, created_utc timestamp_ntz, score bigint, "
    "upvote_ratio double, num_comments bigint, subreddit string, url string, permalink string, "
    "is_self boolean, link_flair_text string, collected_at timestamp_ntz",
)
LABELED = T.StructType(POSTS.fields + _struct(
    "full_text string, preprocessed_text string, auto_label string, auto_label_id int, label_confidence double, "
    "label_agreement double, textblob_prediction string, vader_prediction string, finbert_prediction string, "
    "score_negative double, score_neutral double, score_positive double",
).fields)
PREDICTIONS = _struct(
    "post_id string, model_name string, model_version string, sentiment_label string, confidence_score double, "
    "probabilities probs, predicted_at timestamp_ntz, response_time_ms double, success boolean, api_key string",
)
TEXT_FEATURES = _struct(
    "post_id string, cleaned_text string, text_length int, word_count int, sentiment_polarity double, "
    "sentiment_subjectivity double, language string, processed_at timestamp_ntz",
)
PERFORMANCE_METRICS = _struct(
    "model_name string, model_version string, metric_name string, metric_value double, dataset_type string, "
    "recorded_at timestamp_ntz",
)
QUALITY_METRICS = _struct(
    "batch_id string, metric_name string, metric_value double, threshold_value double, status string, "
    "recorded_at timestamp_ntz",
)
TABLES = {
    "posts": POSTS, "text_features": TEXT_FEATURES, "predictions": PREDICTIONS,
    "performance_metrics": PERFORMANCE_METRICS, "quality_metrics": QUALITY_METRICS,
}

# one row of a raw landing file, as the forum API returns it
RAW_POST = _struct(
    "id string, title string, selftext string, author string, created_utc double, score bigint, upvote_ratio double, "
    "num_comments bigint, subreddit string, url string, permalink string, is_self boolean, link_flair_text string",
)
LABEL_NAMES = ["negative", "neutral", "positive"]
