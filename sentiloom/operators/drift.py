"""Reference statistics, PSI, KS and drift alerts, all features in one job.

Samples are long rows (feature, side, x) with side ``ref`` or ``new``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentiloom.operators.ranking import running_totals
from sentiloom.session import cut

# fixed values
KS_P, KS_CRITICAL, PSI_LIMIT, PSI_CRITICAL, BINS, EMPTY_SHARE, MIN_NEW = 0.05, 0.01, 0.1, 0.25, 10, 0.0001, 10
KS_TERMS = 20


def to_samples(reference: DataFrame, new: DataFrame) -> DataFrame:
    """Numeric columns of two tables as (feature, side, x); features absent from ``new`` are left out."""
    numeric = [f.name for f in reference.schema if isinstance(f.dataType, T.NumericType)]

    def long(df: DataFrame, side: str) -> DataFrame:
        names = [c for c in numeric if c in df.columns]
        return df.select(F.lit(side).alias("side"), F.explode(F.array(*[
            F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in names])).alias("e")
        ).select("e.feature", "side", "e.x")

    return long(reference, "ref").union(long(new, "new"))


def _valid(samples: DataFrame) -> DataFrame:
    return samples.filter(F.col("x").isNotNull() & ~F.isnan("x"))


def reference_stats(samples: DataFrame) -> DataFrame:
    ref = _valid(samples).filter(F.col("side") == "ref")
    return ref.groupBy("feature").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"),
                                      F.max("x").alias("max"), F.count(F.lit(1)).alias("n"))


def _edges(lo: Column, hi: Column, bins: int) -> Column:
    """Edges 1..bins-1 of equal-width bins."""
    width = (hi - lo) / bins
    return F.array(*[lo + width * i for i in range(1, bins)])


def value_counts(samples: DataFrame) -> DataFrame:
    """How often each side has each value: rows (feature, x, r, n), all that PSI and KS need."""
    return _valid(samples).groupBy("feature", "x").agg(
        F.count_if(F.col("side") == "ref").alias("r"), F.count_if(F.col("side") == "new").alias("n"))


def merge_counts(*counts: DataFrame) -> DataFrame:
    """Counts of several batches added up."""
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    return out.groupBy("feature", "x").agg(F.sum("r").alias("r"), F.sum("n").alias("n"))


def psi(samples: DataFrame, bins: int = BINS) -> DataFrame:
    """Population stability index per feature (see :func:`psi_of_counts`)."""
    return psi_of_counts(value_counts(samples), bins)


def psi_of_counts(values: DataFrame, bins: int = BINS) -> DataFrame:
    """Population stability index per feature.

    Bins are equal-width over the reference range, the last one closed; new values outside
    the range fall in no bin but stay in the denominator; an empty share counts as 0.0001.
    A bin empty on both sides adds nothing, so no bin grid is needed.
    """
    ranges = values.filter(F.col("r") > 0).groupBy("feature").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    flat = F.col("lo") == F.col("hi")
    ranges = ranges.select("feature", F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
                           F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    ranges = ranges.withColumn("edges", _edges(F.col("lo"), F.col("hi"), bins))
    index = sum(((F.col("x") >= F.col("edges")[i]).cast("int") for i in range(bins - 1)), F.lit(0))
    inside = F.col("x").between(F.col("lo"), F.col("hi"))
    # one row per feature, and features are column names
    binned = values.join(F.broadcast(ranges), "feature").select("feature", F.when(inside, index).alias("bin"), "r", "n")
    counts = binned.groupBy("feature", "bin").agg(F.sum("r").alias("r"), F.sum("n").alias("n"))
    # at most bins + 1 rows per feature
    per_feature = Window.partitionBy("feature")
    counts = counts.withColumns({"rt": F.sum("r").over(per_feature), "nt": F.sum("n").over(per_feature)})

    def share(part: str, whole: str) -> Column:
        s = F.try_divide(F.col(part).cast("double"), F.col(whole).cast("double"))
        return F.when(s > 0, s).otherwise(EMPTY_SHARE)

    shares = counts.filter(F.col("bin").isNotNull()).withColumns({"rp": share("r", "rt"), "np": share("n", "nt")})
    return shares.groupBy("feature").agg(
        F.abs(F.sum((F.col("np") - F.col("rp")) * F.log(F.col("np") / F.col("rp")))).alias("psi"),
        F.max("nt").alias("n_new"))


def ks_p_value(statistic: Column, n_ref: Column, n_new: Column) -> Column:
    """Asymptotic two-sided p-value by the Kolmogorov series."""
    en = F.sqrt(n_ref.cast("double") * n_new / (n_ref + n_new))
    lam = (en + 0.12 + 0.11 / en) * statistic
    series = F.lit(0.0)
    for k in range(1, KS_TERMS + 1):
        series = series + (2.0 if k % 2 else -2.0) * F.exp(-2.0 * k * k * lam * lam)
    # below this the alternating series no longer converges and the value is 1
    return F.when(lam < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)))


def ks_two_sample(samples: DataFrame) -> DataFrame:
    """Largest distance of the two empirical distributions per feature, with its p-value."""
    return ks_of_counts(value_counts(samples))


def ks_of_counts(values: DataFrame) -> DataFrame:
    runs = running_totals(values, ["feature"], ["x"], ["r", "n"])
    gap = F.abs(F.try_divide(F.col("cum_r").cast("double"), F.col("all_r").cast("double"))
                - F.try_divide(F.col("cum_n").cast("double"), F.col("all_n").cast("double")))
    out = runs.groupBy("feature").agg(F.max(gap).alias("ks"), F.max("all_r").alias("n_ref"), F.max("all_n").alias("n_new"))
    return out.withColumn("p_value", ks_p_value(F.col("ks"), F.col("n_ref"), F.col("n_new")))


def drift_alerts(samples: DataFrame, as_of: str) -> DataFrame:
    """KS and PSI alerts; features with fewer than ten new values are skipped.  The samples are read once."""
    return alerts_of_counts(cut(value_counts(samples)), as_of)


def alerts_of_counts(values: DataFrame, as_of: str) -> DataFrame:
    at = F.lit(as_of).cast("timestamp_ntz").alias("timestamp")
    p, s = F.col("p_value"), F.col("psi")
    ks = ks_of_counts(values).filter((F.col("n_new") >= MIN_NEW) & (p < KS_P)).select(
        at, F.col("feature").alias("feature_name"), F.col("ks").alias("drift_score"), F.lit(KS_P).alias("threshold"),
        F.when(p < KS_CRITICAL, "critical").otherwise("warning").alias("severity"),
        F.format_string("KS test detected drift in %s (p-value: %.4f)", "feature", "p_value").alias("message"))
    shifts = psi_of_counts(values).filter((F.col("n_new") >= MIN_NEW) & (s > PSI_LIMIT)).select(
        at, F.col("feature").alias("feature_name"), F.col("psi").alias("drift_score"), F.lit(PSI_LIMIT).alias("threshold"),
        F.when(s > PSI_CRITICAL, "critical").otherwise("warning").alias("severity"),
        F.format_string("PSI detected drift in %s (score: %.4f)", "feature", "psi").alias("message"))
    return ks.unionByName(shifts)


def drift_report_24h(alerts: DataFrame, as_of: str) -> DataFrame:
    recent = alerts.filter(F.col("timestamp") > F.lit(as_of).cast("timestamp_ntz") - F.expr("INTERVAL '24' HOUR"))
    return recent.agg(F.count(F.lit(1)).alias("total_alerts_24h"),
                      F.count_if(F.col("severity") == "critical").alias("critical_alerts"),
                      F.count_if(F.col("severity") == "warning").alias("warning_alerts"))
