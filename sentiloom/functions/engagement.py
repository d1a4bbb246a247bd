"""Engagement, time and bin features as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def log1p_or_null(value: Column) -> Column:
    """ln(1+x); null where it is not finite (x <= -1)."""
    return F.when(value > -1, F.log1p(value.cast("double")))


def as_number(value: Column) -> Column:
    return F.coalesce(value.try_cast("double"), F.lit(0.0))


def viral(comments: Column, score: Column) -> Column:
    return F.coalesce(comments > score * 0.5, F.lit(False)).cast("int")


def engagement_base(df: DataFrame) -> DataFrame:
    s, c = as_number(F.col("score")), as_number(F.col("num_comments"))
    return df.withColumns({
        "score": s,
        "num_comments": c,
        "engagement_ratio": F.try_divide(c, s + 1),
        "controversy_score": c - s,
        "log_score": log1p_or_null(s),
        "log_comments": log1p_or_null(c),
        "engagement_level": F.when(s <= 0, "negative").when(s <= 10, "low").when(s <= 100, "medium").otherwise("high"),
        "viral_potential": viral(c, s),
    })


def engagement_post(df: DataFrame, production: bool = False) -> DataFrame:
    s, c, u = F.col("score"), F.col("num_comments"), F.col("upvote_ratio")
    columns = {
        "score_log": log1p_or_null(F.coalesce(s, F.lit(0))),
        "num_comments_log": log1p_or_null(F.coalesce(c, F.lit(0))),
        "upvote_ratio_norm": F.coalesce(u, F.lit(0.5)),
        "engagement_ratio": F.try_divide(c.cast("double"), (s + 1).cast("double")),
        "controversy_score": F.abs(u - 0.5) * 2,
    }
    if not production:
        columns["viral_potential"] = viral(c, s)
        columns["is_self_post"] = F.col("is_self").cast("int") if "is_self" in df.columns else F.lit(0)
    return df.withColumns(columns)


def _clock(ts: Column) -> dict[str, Column]:
    return {"hour": F.hour(ts), "day_of_week": F.weekday(ts)}


def temporal_base(df: DataFrame, ts_col: str = "created_utc") -> DataFrame:
    ts = F.col(ts_col)
    h = F.hour(ts)
    return df.withColumns({
        **_clock(ts),
        "day_of_month": F.dayofmonth(ts),
        "month": F.month(ts),
        "is_weekend": (F.weekday(ts) >= 5).cast("int"),
        "time_of_day": F.when(h <= 6, "night").when(h <= 12, "morning").when(h <= 18, "afternoon")
        .when(h <= 24, "evening"),
        "is_business_hours": h.between(9, 17).cast("int"),
    })


def temporal_cyclic(df: DataFrame, ts_col: str = "created_utc", production: bool = False) -> DataFrame:
    ts = F.col(ts_col)
    h, d = F.hour(ts), F.weekday(ts)
    columns = {
        **_clock(ts),
        "is_weekend": (d >= 5).cast("int"),
        "hour_sin": F.sin(2 * math.pi * h / 24),
        "hour_cos": F.cos(2 * math.pi * h / 24),
    }
    if not production:
        columns |= {
            "day_of_month": F.dayofmonth(ts),
            "month": F.month(ts),
            "is_business_hours": h.between(9, 17).cast("int"),
            "is_night": ((h >= 22) | (h <= 6)).cast("int"),
            "day_sin": F.sin(2 * math.pi * d / 7),
            "day_cos": F.cos(2 * math.pi * d / 7),
        }
    return df.withColumns(columns)


def parse_created(value: Column) -> Column:
    """Epoch seconds (UTC) first, then a timestamp string, else null; no session zone is involved."""
    seconds = value.try_cast("double")
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    plausible = F.when(F.abs(seconds) < 1e11, seconds)
    return F.coalesce(epoch + F.make_dt_interval(secs=plausible), F.try_to_timestamp(value).cast("timestamp_ntz"))


def text_complexity(df: DataFrame) -> DataFrame:
    w = F.col("word_count")
    sentence = w / (F.col("sentence_count") + 1)
    return df.withColumns({
        "lexical_diversity": F.col("unique_word_count") / (w + 1),
        "avg_sentence_length": sentence,
        "text_density": F.col("char_count") / (w + 1),
        "readability_score": 206.835 - 1.015 * sentence - 84.6 * F.col("avg_word_length"),
        "complexity_level": F.when(w <= 0, None).when(w <= 50, "very_short").when(w <= 150, "short")
        .when(w <= 300, "medium").otherwise("long"),
    })


def sentiment_derived(df: DataFrame) -> DataFrame:
    p, s = F.col("sentiment_polarity"), F.col("sentiment_subjectivity")
    strength = F.abs(p)
    return df.withColumns({
        "sentiment_strength": strength,
        "sentiment_category": F.when((p > -1) & (p <= -0.1), "negative").when((p > -0.1) & (p <= 0.1), "neutral")
        .when((p > 0.1) & (p <= 1), "positive"),
        "objectivity": 1 - s,
        "strong_opinion": ((strength > 0.5) & (s > 0.5)).cast("int"),
        "neutral_subjective": ((strength < 0.1) & (s > 0.5)).cast("int"),
    })
