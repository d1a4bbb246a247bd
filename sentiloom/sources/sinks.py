"""Writers: posts, quality reports, bands, comparisons, declared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentiloom.operators.frames import is_high_confidence
from sentiloom.operators.quality import quality_metrics, quality_summary
from sentiloom.sources.posts import to_declared


def write_posts(df: DataFrame, path: str, fmt: str = "parquet", stamp: str | None = None) -> str:
    """Write below ``path`` and return the place; an empty table writes nothing and returns ''."""
    if df.isEmpty():
        return ""
    target = f"{path}/posts_{stamp}" if stamp else path
    if fmt == "csv":
        # every text is quoted: an empty title is not a missing one
        df.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").option(
            "timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(target)
        return target
    # rebalance gathers each day's rows into few files and still splits a day that is too large for one task
    days = df.withColumn("dt", F.to_date("created_utc")).hint("rebalance", "dt")
    days.write.mode("overwrite").partitionBy("dt").parquet(target)
    return target


def write_quality_report(checks: DataFrame, path: str) -> None:
    """Summary and detail in one JSON document (five checks, so one small row)."""
    detail = checks.agg(F.sort_array(F.collect_list(F.struct(
        "metric_name", "passed", "metric_value", "threshold", "message", "severity"))).alias("detailed_results"))
    summary = quality_summary(checks).withColumn("timestamp", F.current_timestamp())
    report = summary.select(F.struct("*").alias("summary")).withColumn(
        "detailed_results", detail.select("detailed_results").scalar())
    report.coalesce(1).write.mode("overwrite").json(path)


def write_quality_metrics(checks: DataFrame, batch_id: str, recorded_at, path: str) -> None:
    """Add a batch to the metric log; the same batch written again replaces itself."""
    rows = to_declared(quality_metrics(checks, batch_id, recorded_at), "quality_metrics")
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def write_bands(labeled: DataFrame, path: str, **limits) -> None:
    """High- and low-confidence rows in one pass: folders ``band=high`` and ``band=low``."""
    band = F.when(is_high_confidence(**limits), "high").otherwise("low")
    labeled.withColumn("band", band).hint("rebalance", "band").write.mode("overwrite").partitionBy("band").parquet(path)


def write_comparison(table: DataFrame, path: str) -> None:
    """Model comparison (one row per model), best first, as one CSV file."""
    table.orderBy(F.desc("f1_weighted"), "model").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_declared(df: DataFrame, table: str, path: str) -> None:
    to_declared(df, table).write.mode("overwrite").parquet(path)
