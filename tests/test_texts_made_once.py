"""Texts that an operator reads in several passes are made once: evaluations of the text column are counted."""

import pytest
from pyspark.sql import functions as F

from sentiloom.models.classifiers import Baseline
from sentiloom.models.topics import topics
from sentiloom.operators import augment as A
from sentiloom.plans.catalog import c_stream

ROWS = 60


@pytest.fixture
def counted(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(i):
        made.add(1)
        words = ["moon gain profit bullish rally", "crash loss scam bearish dump", "news about the weekly market today"][i % 3]
        return " ".join([words] * (2 + i % 4)) + f" number {i}  of the many longer posts"

    rows = spark.range(0, ROWS, 1, 2).select(F.col("id").cast("string").alias("post_id"), (F.col("id") % 7).cast("int").alias("seven"),
                                             F.when(F.col("id") % 5 < 2, 0).otherwise(1).cast("int").alias("y"), text("id").alias("t"))
    return rows, made


def test_topics(counted):
    rows, made = counted
    assert topics(rows, "t", k=3).collect() and made.value == ROWS


def test_text_mixup(counted):
    rows, made = counted
    assert len(A.text_mixup(rows, "t", "y").collect()) == ROWS and made.value == ROWS


def test_smart_balance(counted):
    rows, made = counted
    posts = rows.select("post_id", F.lit("a title").alias("title"), F.col("t").alias("content"))
    out = A.smart_balance(posts).groupBy("is_augmented").count().collect()
    assert {r["is_augmented"]: r["count"] for r in out}[False] == ROWS
    assert made.value <= 2 * ROWS  # the length filter and the row itself, in one pass


def test_baseline_reads_texts_twice(counted):
    """Once for the vocabulary, once for the vectors; the fit reads the vectors."""
    rows, made = counted
    Baseline(text_col="t", label="y", max_features=20, max_iter=5).fit(rows)
    assert made.value == 2 * ROWS


def test_a_large_feed_has_several_files_a_batch(spark, views):
    posts = views.posts.select("post_id", "subreddit")
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(n) for n in names]
    try:
        for n in names:
            spark.conf.set(n, "16384")
        stream = c_stream.streamed(views, posts, "feed", 3)
    finally:
        for n, value in zip(names, old):
            spark.conf.set(n, value)
    target, checkpoint = c_stream.places(views, "feed-test")
    query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)
    query.awaitTermination()
    sizes = [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
    assert len(sizes) == 3 and sum(sizes) == posts.count()
    assert spark.read.parquet(target).select(F.spark_partition_id()).count() == posts.count()
    files = spark.sparkContext._jvm.java.io.File(target).listFiles()
    assert sum(f.getName().endswith(".parquet") for f in files) > 3
