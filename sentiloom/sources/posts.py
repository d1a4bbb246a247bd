"""Readers of post tables and the declared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentiloom.schemas import POSTS, RAW_POST, TABLES

SITE = "https://reddit.com"  # fixed value: prefix of permalinks
DELETED = "[deleted]"


def read_posts_csv(spark: SparkSession, path: str, schema: T.StructType = POSTS) -> DataFrame:
    """Header CSV; bodies may contain line breaks and doubled quotes."""
    return (
        spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"')
        .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss[.SSSSSS]").csv(path)
    )


def latest_run(spark: SparkSession, pattern: str) -> str | None:
    """The newest run matching a glob: the folder of the newest part file, or the file itself if it lies bare.

    A run that Spark wrote is a folder of part files.  Only the file listing is read, no content.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(pattern).select("path", "modificationTime")
    name = F.element_at(F.split("path", "/"), -1)
    run = F.when(name.startswith("part-"), F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.col("path"))
    data = files.filter(~name.startswith("_") & ~name.startswith("."))
    newest = data.groupBy(run.alias("run")).agg(F.max("modificationTime").alias("t")).agg(F.max(F.struct("t", "run")).alias("m")).first()["m"]
    return newest["run"] if newest else None


def read_latest_file(spark: SparkSession, pattern: str, fmt: str = "parquet", schema: T.StructType | None = None) -> DataFrame:
    """All rows of the newest run matching a glob (see :func:`latest_run`)."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("multiLine", True).option("escape", '"')
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(latest_run(spark, pattern) or pattern)


def read_landing(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Raw API records as JSON lines."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(RAW_POST).json(path)


def normalize_raw_posts(raw: DataFrame, collected_at=None) -> DataFrame:
    """API records to the post table: missing authors, epoch times (UTC in any session zone), full permalinks."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    stamp = F.current_timestamp() if collected_at is None else F.lit(collected_at)
    return raw.select(
        F.col("id").alias("post_id"), "title", F.col("selftext").alias("content"),
        F.coalesce("author", F.lit(DELETED)).alias("author"),
        (epoch + F.make_dt_interval(secs=F.col("created_utc"))).alias("created_utc"), "score", "upvote_ratio",
        "num_comments", "subreddit", "url", F.concat(F.lit(SITE), F.col("permalink")).alias("permalink"), "is_self",
        "link_flair_text", stamp.cast("timestamp_ntz").alias("collected_at"))


def to_declared(df: DataFrame, table: str) -> DataFrame:
    """Cast and order to a declared table; a missing nullable column becomes null."""
    return df.to(TABLES[table])
