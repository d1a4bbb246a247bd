"""Group statistics, counts and column summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentiloom import lexicons as L
from sentiloom.operators.joins import join_stats
from sentiloom.operators.ranking import exact_quantiles


def subreddit_stats(df: DataFrame) -> DataFrame:
    """Mean, sample deviation and median per forum.

    Means come from ordinary partial aggregation; the exact medians come from
    counted values, so that a forum with a third of all posts is in no single task.
    Posts without a forum get no statistics.
    """
    df = df.filter(F.col("subreddit").isNotNull())
    base = df.groupBy("subreddit").agg(
        F.avg("score").alias("subreddit_avg_score"), F.stddev_samp("score").alias("subreddit_std_score"),
        F.avg("num_comments").alias("subreddit_avg_comments"),
        F.stddev_samp("num_comments").alias("subreddit_std_comments"),
        F.avg("sentiment_polarity").alias("subreddit_avg_sentiment"),
        F.stddev_samp("sentiment_polarity").alias("subreddit_std_sentiment"))
    long = df.select("subreddit", F.explode(F.array(
        F.struct(F.lit("score").alias("measure"), F.col("score").cast("double").alias("x")),
        F.struct(F.lit("num_comments").alias("measure"), F.col("num_comments").cast("double").alias("x")),
    )).alias("e")).select("subreddit", "e.measure", "e.x")
    medians = exact_quantiles(long, ["subreddit", "measure"], "x", [0.5]).groupBy("subreddit").agg(
        F.max(F.when(F.col("measure") == "score", F.col("quantile"))).alias("subreddit_median_score"),
        F.max(F.when(F.col("measure") == "num_comments", F.col("quantile"))).alias("subreddit_median_comments"))
    return base.join(medians, "subreddit", "left")


def relative_to_group(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Join group statistics back and compare each post with its group."""
    out = join_stats(df, stats, "subreddit")
    return out.withColumns({
        "score_vs_subreddit_avg": F.try_divide(F.col("score").cast("double"), F.col("subreddit_avg_score") + 1),
        "sentiment_vs_subreddit_avg": F.col("sentiment_polarity") - F.col("subreddit_avg_sentiment"),
    })


def value_counts(df: DataFrame, column: str, *group: str) -> DataFrame:
    """Count and share per value, nulls left out (shares within ``group`` if given)."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(*group, column).agg(F.count(F.lit(1)).alias("count"))
    if group:
        totals = counts.groupBy(*group).agg(F.sum("count").alias("_total"))
        return counts.join(totals, list(group)).withColumn("share", F.col("count") / F.col("_total")).drop("_total")
    total = df.select(F.count(column).alias("n")).scalar()
    return counts.withColumn("share", F.col("count") / total)


def sorted_counts(df: DataFrame, column: str, by_count: bool = True) -> DataFrame:
    counts = value_counts(df, column)
    return counts.orderBy(*([F.desc("count"), column] if by_count else [column]))


def collection_report(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total_records"), F.lit(len(df.columns)).alias("total_features"),
        F.countDistinct("subreddit").alias("subreddits_covered"),
        F.min("created_utc").alias("first_created"), F.max("created_utc").alias("last_created"))


def feature_summary(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Type, share of nulls and distinct values of the feature columns, sorted by name.

    One job over all columns; ``approximate`` trades exact distinct counts for one
    narrow pass without the per-value shuffle.
    """
    names = [c for c in df.columns if any(c.startswith(p) for p in L.SUMMARY_PREFIXES)]
    kinds = dict(df.dtypes)
    distinct = F.approx_count_distinct if approximate else F.countDistinct
    wide = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(F.col(c)).alias(f"n_{c}") for c in names],
                  *[distinct(F.col(c)).alias(f"d_{c}") for c in names])
    rows = F.array(*[F.struct(
        F.lit(c).alias("feature"), F.lit(kinds[c]).alias("dtype"),
        ((F.col("_n") - F.col(f"n_{c}")) * 100.0 / F.col("_n")).alias("missing_pct"),
        F.col(f"d_{c}").alias("unique_values")) for c in names])
    return wide.select(F.inline(rows)).orderBy("feature")


def top_posts(df: DataFrame, n: int, sort_by: str = "top", since=None) -> DataFrame:
    """Top or newest ``n`` posts per forum; ties by post id.

    The rank filter lets Spark cut each forum to ``n`` rows before the shuffle.
    """
    if sort_by not in ("top", "new"):
        raise ValueError(f"unknown sort: {sort_by}")
    from pyspark.sql import Window

    kept = df if since is None else df.filter(F.col("created_utc") >= since)
    order = F.desc("score") if sort_by == "top" else F.desc("created_utc")
    w = Window.partitionBy("subreddit").orderBy(order, "post_id")
    return kept.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def samples_per_label(df: DataFrame, n: int = 3, label_col: str = "auto_label", order_by: str = "post_id") -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy(label_col).orderBy(order_by)
    return df.withColumn("sample_no", F.row_number().over(w)).filter(F.col("sample_no") <= n)


def dedup_keep_first(df: DataFrame, key: str = "post_id", order_by: list[str] = ("run",)) -> DataFrame:
    """First row per key in arrival order; only the first rows of each task travel (group limit before the shuffle)."""
    from pyspark.sql import Window

    rest = [c for c in df.columns if c != key]
    first = F.row_number().over(Window.partitionBy(key).orderBy(*order_by))
    return df.withColumn("_nth", first).filter("_nth = 1").select(key, *rest)


def union_collections(frames: list[DataFrame], key: str = "post_id", order_by: list[str] = ("run",)) -> DataFrame:
    out = frames[0]
    for other in frames[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return dedup_keep_first(out, key, order_by)
