"""Statistics and checks of automatic labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentiloom.operators.frames import is_high_confidence
from sentiloom.operators.ranking import exact_quantiles
from sentiloom.schemas import LABEL_NAMES

EXPECTED_SHARES = {"negative": 0.33, "neutral": 0.34, "positive": 0.33}  # fixed values
MAX_DIVERGENCE, MIN_KAPPA, FULL_AGREEMENT = 0.2, 0.4, 0.67
ANNOTATORS = ["textblob_prediction", "vader_prediction", "finbert_prediction"]


def labeling_stats(df: DataFrame) -> DataFrame:
    c, a = F.col("label_confidence"), F.col("label_agreement")
    return df.agg(
        F.count(F.lit(1)).alias("total_samples"),
        *[F.count_if(F.col("auto_label") == x).alias(f"{x}_count") for x in LABEL_NAMES],
        F.avg(c).alias("avg_confidence"), F.avg(a).alias("avg_agreement"),
        F.count_if(c > 0.7).alias("high_confidence_samples"),
        F.count_if(a >= FULL_AGREEMENT).alias("high_agreement_samples"),
        F.count_if(a == 1.0).alias("all_agree"), F.count_if(a >= FULL_AGREEMENT).alias("two_agree"),
        F.count_if(a < FULL_AGREEMENT).alias("no_agreement"))


def filter_stats(df: DataFrame, **limits) -> DataFrame:
    """Rows per band and label with subtotals (null label = whole band, null band = everything)."""
    total = df.select(F.count(F.lit(1)).cast("double")).scalar()
    return (
        df.withColumn("is_high", is_high_confidence(**limits))
        .rollup("is_high", "auto_label")
        .agg(F.count(F.lit(1)).alias("count"), F.avg("label_confidence").alias("avg_confidence"),
             F.avg("label_agreement").alias("avg_agreement"))
        .withColumn("percentage", F.col("count") / total * 100)
    )


def _band_quantiles(df: DataFrame, columns: list[str], probs: list[float]) -> DataFrame:
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("x")) for c in columns])).alias("e"))
    return exact_quantiles(long.select("e.measure", "e.x"), ["measure"], "x", probs)


def suggest_thresholds(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Three strategies from the confidence quartiles, plus the agreement quantiles.

    ``approximate`` reads the quantiles from a sketch in one pass.
    """
    columns, probs = ["label_confidence", "label_agreement"], [0.25, 0.5, 0.75, 0.9]
    if approximate:
        wide = df.agg(*[F.percentile_approx(c, probs, 10000).alias(c) for c in columns])
        quantiles = wide.select(F.inline(F.array(*[
            F.struct(F.lit(c).alias("measure"), F.lit(p).alias("prob"), F.col(c)[i].alias("quantile"))
            for c in columns for i, p in enumerate(probs)])))
    else:
        quantiles = _band_quantiles(df, columns, probs)

    def at(measure: str, prob: float) -> Column:
        return F.max(F.when((F.col("measure") == measure) & (F.col("prob") == prob), F.col("quantile")))

    wide = quantiles.agg(
        *[at("label_confidence", p).alias(f"c{int(p * 100)}") for p in probs],
        *[at("label_agreement", p).alias(f"a{int(p * 100)}") for p in probs])
    rows = [("conservative", "c75", 1.0, "~25%"), ("moderate", "c50", 0.67, "~50%"), ("aggressive", "c25", 0.67, "~75%")]
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("strategy"), F.col(q).alias("min_confidence"), F.lit(a).alias("min_agreement"),
                 F.lit(kept).alias("expected_retention"), F.col(q.replace("c", "a")).alias("agreement_quantile"))
        for name, q, a, kept in rows])))


def label_distribution_check(df: DataFrame, expected: dict[str, float] | None = None) -> DataFrame:
    expected = expected or EXPECTED_SHARES
    n = F.count("auto_label").cast("double")
    shares = df.agg(*[F.coalesce(F.try_divide(F.count_if(F.col("auto_label") == x).cast("double"), n), F.lit(0.0))
                      .alias(f"{x}_share") for x in LABEL_NAMES])
    gap = sum((F.abs(F.col(f"{x}_share") - expected.get(x, 0.33)) for x in LABEL_NAMES), F.lit(0.0)) / len(LABEL_NAMES)
    return shares.withColumn("avg_divergence", gap).withColumns({
        "is_valid": F.col("avg_divergence") < MAX_DIVERGENCE,
        "message": F.when(F.col("avg_divergence") < MAX_DIVERGENCE, "Distribution is acceptable")
        .otherwise("Distribution is skewed")})


def kappa_from_counts(counts: DataFrame, keys: list[str], a: str, b: str, n: str = "n") -> DataFrame:
    """Cohen kappa per key from a contingency table (one row per label pair)."""
    zero = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col(a).alias("l"), F.col(n).alias("ra"), zero.alias("rb"), F.when(F.col(a) == F.col(b), F.col(n)).otherwise(zero).alias("same")),
        F.struct(F.col(b).alias("l"), zero.alias("ra"), F.col(n).alias("rb"), zero.alias("same")))
    labels = counts.select(*keys, F.inline(sides)).groupBy(*keys, "l").agg(*[F.sum(c).cast("double").alias(c) for c in ("ra", "rb", "same")])
    total = F.sum("ra")
    po, pe = F.sum("same") / total, F.sum(F.col("ra") * F.col("rb")) / (total * total)
    return labels.groupBy(*keys).agg(F.try_divide(po - pe, 1 - pe).alias("kappa"))


def pairwise_kappa(df: DataFrame, annotators: list[str] = ANNOTATORS) -> DataFrame:
    """Kappa of every annotator pair; the rows are counted once, map-side, per label pair."""
    pairs = [(a, b) for i, a in enumerate(annotators) for b in annotators[i + 1:]]
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(f"{a}_vs_{b}").alias("pair"), F.col(a).alias("a"), F.col(b).alias("b")) for a, b in pairs
    ])).alias("e")).select("e.*")
    counts = long.groupBy("pair", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    return kappa_from_counts(counts, ["pair"], "a", "b")


def kappa_summary(pairs: DataFrame) -> DataFrame:
    k = F.col("average_kappa")
    return pairs.agg(F.avg("kappa").alias("average_kappa")).withColumn(
        "interpretation",
        F.when(k > 0.8, "Almost perfect agreement").when(k > 0.6, "Substantial agreement")
        .when(k > 0.4, "Moderate agreement").when(k > 0.2, "Fair agreement").otherwise("Slight agreement"))


def confidence_distribution(df: DataFrame) -> DataFrame:
    basic = df.agg(F.avg("label_confidence").alias("mean"), F.stddev_samp("label_confidence").alias("std"),
                   F.min("label_confidence").alias("min"), F.max("label_confidence").alias("max"))
    q = _band_quantiles(df, ["label_confidence"], [0.25, 0.5, 0.75])
    parts = [F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(name) for name, p in (("q25", 0.25), ("median", 0.5), ("q75", 0.75))]
    basic = basic.withColumn("_q", q.agg(F.struct(*parts).alias("q")).scalar()).select("*", "_q.*").drop("_q")
    healthy = (F.col("mean") > 0.5) & (F.col("std") < 0.3) & (F.col("median") > 0.5)
    return basic.withColumn("is_healthy", F.coalesce(healthy, F.lit(False)))


def label_qa_report(df: DataFrame) -> DataFrame:
    """One row: distribution, agreement, confidence and the overall status."""
    distribution = label_distribution_check(df)
    agreement = kappa_summary(pairwise_kappa(df))
    confidence = confidence_distribution(df)
    report = df.agg(F.count(F.lit(1)).alias("sample_size"), F.countDistinct("auto_label").alias("unique_labels"))
    report = report.withColumns({
        "distribution_valid": distribution.select("is_valid").scalar(),
        "average_kappa": agreement.select("average_kappa").scalar(),
        "confidence_healthy": confidence.select("is_healthy").scalar()})
    passed = F.col("distribution_valid") & (F.col("average_kappa") > MIN_KAPPA) & F.col("confidence_healthy")
    return report.withColumn("overall_status", F.when(passed, "PASSED").otherwise("NEEDS_REVIEW"))
