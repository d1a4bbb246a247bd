"""Topic features by latent Dirichlet allocation."""

from __future__ import annotations

from pyspark.ml.clustering import LDA
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentiloom.functions import patterns as P
from sentiloom.session import measured

TOPICS, TERMS, ITERATIONS = 10, 1000, 10  # fixed values


def topics(df: DataFrame, text_col: str, k: int = TOPICS, seed: int = 42, key: str = "post_id") -> DataFrame:
    """Share of each topic per text, the dominant topic and its share.

    The online optimiser samples mini-batches, so a fit does not hold all texts at once.
    """
    texts = measured(df.select(key, text_col), "topic-texts")  # every pass reads these files, not what they were made from
    words = texts.select(key, F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(P.TERM), F.lit(0)).alias("_terms"))
    counter = CountVectorizer(inputCol="_terms", outputCol="_counts", vocabSize=TERMS, minDF=2, maxDF=0.95).fit(words)
    counts = measured(counter.transform(words).select(key, "_counts"), "topic-counts")
    model = LDA(k=k, seed=seed, maxIter=ITERATIONS, optimizer="online", featuresCol="_counts", topicDistributionCol="_topics").fit(counts)
    raw = model.transform(counts).withColumn("_raw", vector_to_array("_topics"))
    # a text without a known term gets zeros from the model; all topics are then equally likely
    shares = raw.withColumn("topics", F.when(F.array_max("_raw") > 0, F.col("_raw")).otherwise(F.array_repeat(F.lit(1.0 / k), k)))
    best = F.array_max("topics")
    return shares.select(key, *[F.col("topics")[i].alias(f"topic_{i}") for i in range(k)],
                         (F.array_position("topics", best) - 1).cast("int").alias("dominant_topic"), best.alias("dominant_topic_prob"))
