"""Splits, folds and tails with exact counts and reproducible order.

Order inside a class comes from a digest of (seed, id), never from a random
generator, so any retry of a lost task gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentiloom.operators.joins import group_join
from sentiloom.operators.ranking import with_group_position, with_position


def seeded(seed: int, *parts) -> Column:
    """Digest of the seed and the given columns; orders rows as if shuffled."""
    cols = [p if isinstance(p, Column) else F.col(p) for p in parts]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def seeded_unit(seed: int, *parts) -> Column:
    """Number in [0, 1) from the digest's first eight hex digits."""
    return F.conv(F.substring(seeded(seed, *parts), 1, 8), 16, 10).cast("double") / float(1 << 32)


def tail_fraction(df: DataFrame, order_by: list[str], fraction: float = 0.2) -> DataFrame:
    """Last ``floor(n * fraction)`` rows in the given order."""
    placed = with_position(df, order_by, "_pos")
    n = placed.select(F.count(F.lit(1))).scalar()
    return placed.filter(F.col("_pos") >= n - F.floor(n * fraction)).drop("_pos")


def stratified_split(df: DataFrame, label: str, key: str = "post_id", test_size: float = 0.15, val_size: float = 0.15,
                     seed: int = 42) -> DataFrame:
    """Add ``split`` (train, val, test) with exact shares per label; ``key`` is unique.

    If any label has fewer than two rows, the whole table is one stratum.
    """
    smallest = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).select(F.min("n")).scalar()
    # the slim order gives the digest at each border; every row then finds its split alone, and no wide row is shuffled
    stratum = F.when(smallest < 2, F.lit("all")).otherwise(F.coalesce(F.col(label).cast("string"), F.lit("?")))
    rows = df.withColumns({"_stratum": stratum, "_order": F.struct(seeded(seed, key).alias("digest"), F.col(key).alias("key"))})
    slim = rows.select(key, "_stratum", "_order")
    placed = with_group_position(slim, ["_stratum"], ["_order", key], "_pos", "_n")
    n, pos = F.col("_n"), F.col("_pos")
    test = F.floor(n * test_size + 0.5)
    val = F.floor(n * val_size + 0.5)
    last = {"_test": pos == test - 1, "_val": (pos == test + val - 1) & (val > 0)}
    borders = placed.groupBy("_stratum").agg(*[F.max(F.when(at, F.col("_order"))).alias(c) for c, at in last.items()])
    split = F.when(F.col("_order") <= F.col("_test"), "test").when(F.col("_order") <= F.col("_val"), "val").otherwise("train")
    return group_join(rows, borders, ["_stratum"]).withColumn("split", split).drop("_stratum", "_order", "_test", "_val")


def stratified_kfold(df: DataFrame, label: str, k: int = 5, key: str = "post_id", seed: int = 42) -> DataFrame:
    """Add ``fold`` (0..k-1); fold sizes within a label differ by at most one; ``key`` is unique."""
    slim = df.select(key, F.col(label).alias("_label"), seeded(seed, key).alias("_order"))
    placed = with_group_position(slim, ["_label"], ["_order", key], "_pos", "_n")
    return df.join(placed.select(key, F.pmod("_pos", F.lit(k)).cast("int").alias("fold")), key)


def split_label_distribution(df: DataFrame, label: str, split: str = "split") -> DataFrame:
    return df.groupBy(split, label).agg(F.count(F.lit(1)).alias("count"))


def union_train_val(train: DataFrame, val: DataFrame) -> DataFrame:
    return train.unionByName(val)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Per class: balanced weight n/(k*count) and inverse frequency scaled to mean 1."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("count"))
    n, k = F.sum("count").alias("n"), F.count(F.lit(1)).alias("k")
    totals = counts.agg(F.struct(n, k, F.sum(1.0 / (F.col("count") + 1e-6)).alias("inv")).alias("t")).scalar()
    return counts.withColumn("_t", totals).withColumns({
        "balanced_weight": F.col("_t.n") / (F.col("_t.k") * F.col("count")),
        "inverse_weight": 1.0 / (F.col("count") + 1e-6) / F.col("_t.inv") * F.col("_t.k"),
    }).drop("_t")
