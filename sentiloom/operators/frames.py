"""Column selection and row filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentiloom import lexicons as L


def _numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def drop_leakage_exact(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in L.LEAKAGE_EXACT if c in df.columns])


def drop_leakage_pattern(df: DataFrame) -> DataFrame:
    named = set(L.LEAKAGE_EXACT) | set(L.LEAKAGE_VALENCE)
    return df.drop(*[c for c in df.columns if c in named or any(m in c.lower() for m in L.LEAKAGE_MARKS)])


def select_legitimate(df: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Allow-listed numeric columns, in the order of the list."""
    numeric = set(_numeric(df))
    return df.select(*keys, *[c for c in L.LEGITIMATE if c in numeric])


def select_clean_numeric(df: DataFrame, keys: list[str] = ()) -> DataFrame:
    return df.select(*keys, *[c for c in _numeric(df) if c not in L.NOT_CLEAN_FEATURES])


def select_production_43(df: DataFrame, keys: list[str] = ()) -> DataFrame:
    return df.select(*keys, *[c for c in L.PRODUCTION_43 if c in df.columns])


def is_high_confidence(min_confidence: float = 0.6, min_agreement: float = 0.67, both: bool = True) -> Column:
    """Band test; the default 0.67 lies above 2/3, so only full agreement reaches it."""
    sure = F.col("label_confidence") >= min_confidence
    agreed = F.col("label_agreement") >= min_agreement
    return F.coalesce(sure & agreed if both else sure | agreed, F.lit(False))


def confidence_filter(df: DataFrame, **limits) -> tuple[DataFrame, DataFrame]:
    """High and low band; every row is in exactly one of them."""
    tagged = df.withColumn("is_high", is_high_confidence(**limits))
    return tagged.filter("is_high").drop("is_high"), tagged.filter(~F.col("is_high")).drop("is_high")


def complement_split(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which ``condition`` is not true (false or null)."""
    return df.filter(~F.coalesce(condition, F.lit(False)))


def min_length_filter(df: DataFrame, text_col: str = "full_text", longer_than: int = 50) -> DataFrame:
    return df.filter(F.length(text_col) > longer_than)


def label_slice(df: DataFrame, label, label_col: str = "auto_label") -> DataFrame:
    return df.filter(F.col(label_col) == label)


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def train_row_filter(df: DataFrame, min_rows: int = 50, **limits) -> DataFrame:
    """High-confidence rows; stops when there are too few to train on (one bounded count)."""
    high, _ = confidence_filter(df, **limits)
    if high.limit(min_rows).count() < min_rows:
        raise ValueError(f"fewer than {min_rows} high-confidence rows")
    return high


EXPECTED_SCHEMA = {  # fixed values
    "post_id": "string", "title": "string", "content": "string", "author": "string",
    "score": "bigint", "num_comments": "bigint", "subreddit": "string",
}


def coerce_schema(df: DataFrame) -> DataFrame:
    """Expected columns in their type; unreadable numbers become 0."""
    changes = {}
    for name, kind in EXPECTED_SCHEMA.items():
        if name in df.columns:
            c = F.col(name)
            changes[name] = (F.coalesce(c.try_cast("double"), F.lit(0.0)).cast("bigint") if kind == "bigint"
                             else c.cast("string"))
    return df.withColumns(changes)


def stream_request_filter(df: DataFrame, subreddits: list[str], min_confidence: float = 0.7,
                          max_posts: int | None = None) -> DataFrame:
    """Posts of the asked forums with enough confidence; newest ``max_posts`` of a batch."""
    if len(subreddits) > 10:
        raise ValueError("at most 10 subreddits")
    if not 0 <= min_confidence <= 1:
        raise ValueError("min_confidence must be within 0..1")
    out = df.filter(F.col("subreddit").isin(subreddits) & (F.col("confidence") >= min_confidence))
    if max_posts is None:
        return out
    if not 1 <= max_posts <= 100:
        raise ValueError("max_posts must be within 1..100")
    return out.orderBy(F.desc("created_utc"), "post_id").limit(max_posts)


def validate_requests(df: DataFrame) -> DataFrame:
    """Trim the texts of each request and say why it is not valid.

    ``texts`` is the request's list; a single request is a list of one.
    """
    trimmed = F.transform("texts", lambda t: F.trim(t))
    reason = (
        F.when(F.coalesce(F.size("texts"), F.lit(0)) <= 0, "no texts")
        .when(F.size("texts") > 100, "too many texts")
        .when(F.exists("texts", lambda t: F.coalesce(F.trim(t), F.lit("")) == ""), "blank text")
        .when(F.exists("texts", lambda t: F.length(t) > 10000), "text too long")
    )
    return df.withColumn("reason", reason).withColumns({"texts": trimmed, "is_valid": F.col("reason").isNull()})
