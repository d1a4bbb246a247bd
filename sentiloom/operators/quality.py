"""Quality checks, one row per check, from one pass over the posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentiloom.functions.text import full_text
from sentiloom.operators.frames import EXPECTED_SCHEMA

REQUIRED = ["post_id", "title", "content", "created_utc", "subreddit"]  # fixed values
COMPLETENESS, MAX_DUPLICATES, VALID_TEXT, FRESH_SHARE, MAX_AGE_HOURS = 0.95, 0.05, 0.90, 0.50, 48.0
MIN_TEXT, MAX_TEXT = 10, 10000
CHECK = "struct<metric_name string, passed boolean, metric_value double, threshold double, severity string, message string>"


def severity_grade(passed: Column, warn: Column) -> Column:
    """info when passed, else warning or critical."""
    return F.when(passed, "info").when(warn, "warning").otherwise("critical")


def age_hours(as_of, created: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", created.cast("timestamp"), F.lit(as_of).cast("timestamp")) / F.lit(3.6e9)


def quality_totals(df: DataFrame, as_of: str) -> DataFrame:
    """Every number the checks need, from one scan and one shuffle on the post id.

    Missing columns count as null; without a post id, rows that are equal in all columns are duplicates.
    """
    if "post_id" not in df.columns:
        df = df.withColumn("post_id", F.sha2(F.to_json(F.struct(*df.columns)) if df.columns else F.lit(""), 256))
    df = df.withColumns({c: F.lit(None).cast("timestamp" if c == "created_utc" else "string") for c in REQUIRED if c not in df.columns})
    length = F.length(full_text(F.col("title"), F.col("content")))
    age = age_hours(as_of, F.col("created_utc"))
    slim = df.select(*[c for c in REQUIRED if c not in ("title", "content")],
                     F.col("title").isNotNull().alias("has_title"), F.col("content").isNotNull().alias("has_content"),
                     length.alias("text_length"), age.alias("age_hours"))
    present = {c: F.count(F.col(c)) for c in REQUIRED if c not in ("title", "content")}
    present |= {"title": F.count_if("has_title"), "content": F.count_if("has_content")}
    return slim.agg(
        F.count(F.lit(1)).alias("n"),
        *[e.alias(f"n_{c}") for c, e in present.items()],
        F.countDistinct("post_id").alias("ids"),
        F.coalesce(F.max(F.col("post_id").isNull().cast("int")), F.lit(0)).alias("null_ids"),
        F.count_if(F.col("text_length") < MIN_TEXT).alias("too_short"),
        F.count_if(F.col("text_length") > MAX_TEXT).alias("too_long"),
        F.count_if(F.col("age_hours") <= MAX_AGE_HOURS).alias("fresh"),
        F.avg("age_hours").alias("mean_age"))


def _share(part: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), F.col("n").cast("double")), F.lit(0.0))


def _row(name: str, value: Column, threshold: float, passed: Column, warn: Column, message: Column) -> Column:
    return F.struct(
        F.lit(name).alias("metric_name"), F.coalesce(passed, F.lit(False)).alias("passed"), value.alias("metric_value"),
        F.lit(float(threshold)).alias("threshold"),
        severity_grade(F.coalesce(passed, F.lit(False)), F.coalesce(warn, F.lit(False))).alias("severity"),
        message.alias("message"))


def _percent(value: Column) -> Column:
    return F.concat(F.format_string("%.2f", F.round(value * 100, 2)), F.lit("%"))


def check_rows(totals: DataFrame, df: DataFrame) -> DataFrame:
    """Checks as rows: completeness, duplicates, text quality, freshness, schema."""
    complete = sum((_share(F.col(f"n_{c}")) for c in REQUIRED), F.lit(0.0)) / len(REQUIRED)
    copies = F.col("n") - F.col("ids") - F.col("null_ids")
    repeated = _share(copies)
    valid = _share(F.col("n") - F.col("too_short") - F.col("too_long"))
    fresh = _share(F.col("fresh"))
    problems = schema_problems(df)
    missing = [c for c in REQUIRED if c not in df.columns]
    no_times = F.lit("created_utc" not in df.columns)
    schema_ok = F.lit(not problems)
    rows = F.array(
        _row("column_completeness", F.lit(0.0), 1.0, F.lit(False), F.lit(False), F.lit(f"Missing required columns: {missing}")) if missing else
        _row("data_completeness", complete, COMPLETENESS, complete >= COMPLETENESS, complete > 0.90,
             F.concat(F.lit("Data completeness: "), _percent(complete))),
        _row("duplicate_rate", repeated, MAX_DUPLICATES, repeated <= MAX_DUPLICATES, repeated < 0.10,
             F.concat(F.lit("Duplicate rate: "), _percent(repeated), F.lit(" ("), copies.cast("string"), F.lit("/"),
                      F.col("n").cast("string"), F.lit(" records)"))),
        _row("text_quality", valid, VALID_TEXT, valid >= VALID_TEXT, valid > 0.80,
             F.concat(F.lit("Text quality: "), _percent(valid), F.lit(" valid. Too short: "),
                      F.col("too_short").cast("string"), F.lit(", Too long: "), F.col("too_long").cast("string"))),
        _row("data_freshness", F.col("mean_age"), MAX_AGE_HOURS, fresh >= FRESH_SHARE, ~no_times,
             F.concat(F.lit("Data freshness: "), _percent(fresh), F.lit(" within 48h"))),
        _row("schema_validation", schema_ok.cast("double"), 1.0, schema_ok, F.lit(True),
             F.lit("Schema validation: " + ("Passed" if not problems else "Issues found: " + ", ".join(problems)))),
    )
    return totals.select(F.inline(rows))


def schema_problems(df: DataFrame) -> list[str]:
    """Expected columns that are absent or cannot be converted (arrays, maps, structs)."""
    kinds = dict(df.dtypes)
    out = []
    for name, wanted in EXPECTED_SCHEMA.items():
        if name not in kinds:
            out.append(f"Missing column: {name}")
        elif kinds[name].startswith(("array", "map", "struct", "binary")):
            out.append(f"Column {name} has type {kinds[name]}, expected {wanted}")
    return out


def run_checks(df: DataFrame, as_of: str) -> DataFrame:
    """All five checks, whatever columns there are; a missing required column makes completeness a critical row."""
    return check_rows(quality_totals(df, as_of), df)


def quality_summary(checks: DataFrame) -> DataFrame:
    failed = ~F.col("passed")
    return checks.agg(
        F.count(F.lit(1)).alias("total_checks"), F.count_if("passed").alias("passed_checks"),
        F.count_if(failed).alias("failed_checks"),
        F.count_if(failed & (F.col("severity") == "critical")).alias("critical_issues"),
        F.count_if(failed & (F.col("severity") == "warning")).alias("warnings"),
    ).withColumn("overall_passed", F.col("critical_issues") == 0)


def quality_metrics(checks: DataFrame, batch_id: str, recorded_at) -> DataFrame:
    """Checks in the shape of the quality metric log."""
    return checks.select(
        F.lit(batch_id).alias("batch_id"), "metric_name", "metric_value", F.col("threshold").alias("threshold_value"),
        F.when(F.col("passed"), "passed").when(F.col("severity") == "warning", "warning").otherwise("failed").alias("status"),
        F.lit(recorded_at).cast("timestamp_ntz").alias("recorded_at"))


# --- fixed values: declared table rules --------------------------------------------
ALLOWED = {
    "source": ["reddit", "twitter", "news", "kaggle"],
    "sentiment_label": ["positive", "negative", "neutral"],
    "dataset_type": ["train", "validation", "test"],
    "status": ["passed", "failed", "warning"],
}
NOT_NULL = {
    "posts": ["post_id", "content", "created_utc"],
    "predictions": ["model_name", "sentiment_label", "confidence_score"],
}


def check_constraints(df: DataFrame, allowed: dict[str, list[str]], not_null: list[str]) -> DataFrame:
    """Broken rows per rule (an allowed-value rule lets null pass, as a CHECK does)."""
    rules = {f"allowed_{c}": ~F.col(c).isin(v) for c, v in allowed.items()}
    rules |= {f"not_null_{c}": F.col(c).isNull() for c in not_null}
    wide = df.agg(*[F.count_if(rule).alias(name) for name, rule in rules.items()])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("rule"), F.col(name).alias("violations")) for name in rules])))
