"""Positions, running totals and exact quantiles without a single-task window.

A window with one huge partition puts a whole group (or the whole table) into
one task.  Here the data is sorted by range across the cluster, frozen in the
shared folder, and every range partition only needs the totals of the ranges
before it.  A hot group simply spans several ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentiloom.operators.joins import group_join
from sentiloom.session import cut

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _sorted_parts(df: DataFrame, order_by: list) -> DataFrame:
    """``df`` in global order with ``_part`` (range number) and ``_row`` (row in range), frozen."""
    out = df.orderBy(*[_col(c) for c in order_by]).withColumn("_mid", F.monotonically_increasing_id())
    return cut(out.withColumns({
        "_part": F.shiftright("_mid", _ROW_BITS),
        "_row": F.col("_mid").bitwiseAND((1 << _ROW_BITS) - 1),
    }).drop("_mid"))


def _offsets(per_part: DataFrame, names: list[str]) -> DataFrame:
    """Exclusive running totals over the range numbers: one row per shuffle partition."""
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(per_part.select(
        "_part", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_{n}_before") for n in names]))


def with_position(df: DataFrame, order_by: list, name: str = "pos") -> DataFrame:
    """Add the 0-based position in the global order (``order_by`` must be unique).

    Runs the sort at once (see module text).
    """
    parts = _sorted_parts(df, order_by)
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    return (
        parts.join(_offsets(sizes, ["n"]), "_part")
        .withColumn(name, F.col("_n_before") + F.col("_row"))
        .drop("_part", "_row", "_n_before")
    )


def with_group_position(df: DataFrame, group: list[str], order_by: list, name: str = "pos",
                        size: str = "group_size") -> DataFrame:
    """Add the 0-based position within the group and the group's size.

    The range sort reads its input twice (once to sample the ranges), so callers with wide
    or costly rows pass only keys here and join the positions back.
    """
    placed = with_position(df, [*group, *order_by], "_global")
    starts = placed.groupBy(*group).agg(F.min("_global").alias("_start"), F.count(F.lit(1)).alias(size))
    return group_join(placed, starts, group).withColumn(name, F.col("_global") - F.col("_start")).drop("_global", "_start")


def running_totals(df: DataFrame, group: list[str], order_by: list[str], sums: list[str]) -> DataFrame:
    """Add ``cum_<s>`` (inclusive, per group) and ``all_<s>`` (group total) for integer columns.

    ``group + order_by`` must be unique, as it is after pre-aggregation.
    """
    parts = _sorted_parts(df, [*group, *order_by])
    within = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    per_part = parts.groupBy("_part").agg(*[F.sum(s).alias(s) for s in sums])
    out = parts.withColumns({f"_{s}_run": F.sum(s).over(within) for s in sums}).join(_offsets(per_part, sums), "_part")
    out = out.withColumns({f"_{s}_all": F.col(f"_{s}_run") + F.col(f"_{s}_before") for s in sums})
    stats = out.groupBy(*group).agg(
        *[F.min(F.col(f"_{s}_all") - F.col(s)).alias(f"_{s}_start") for s in sums],
        *[F.sum(s).alias(f"all_{s}") for s in sums])
    out = group_join(out, stats, group)
    out = out.withColumns({f"cum_{s}": F.col(f"_{s}_all") - F.col(f"_{s}_start") for s in sums})
    return out.drop("_part", "_row", *[f"_{s}_{x}" for s in sums for x in ("run", "before", "all", "start")])


def exact_quantiles(df: DataFrame, group: list[str], value: str, probs: list[float],
                    interpolate: bool = True) -> DataFrame:
    """Exact quantiles per group: rows (group..., prob, quantile).

    ``interpolate`` gives the linear rule; otherwise the value at index
    floor(n * prob) of the sorted values.  Values are counted first, so the sort
    only sees distinct ones.
    """
    hist = (
        df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
        .groupBy(*group, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("cnt"))
    )
    runs = running_totals(hist, group, ["_v"], ["cnt"])
    n, p = F.col("all_cnt"), F.col("prob")
    at = p * (n - 1) if interpolate else F.least(F.floor(n * p), n - 1)
    out = runs.withColumn("prob", F.explode(F.array(*[F.lit(float(x)) for x in probs]))).withColumns({
        "_lo": F.floor(at), "_hi": F.ceil(at), "_frac": at - F.floor(at)})
    first = F.col("cum_cnt") - F.col("cnt")

    def holds(spot: str) -> Column:
        return (F.col(spot) >= first) & (F.col(spot) < F.col("cum_cnt"))

    picked = out.filter(holds("_lo") | holds("_hi")).groupBy(*group, "prob").agg(
        F.max(F.when(holds("_lo"), F.col("_v"))).alias("_a"),
        F.max(F.when(holds("_hi"), F.col("_v"))).alias("_b"),
        F.max("_frac").alias("_frac"))
    if interpolate:
        q = F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_frac")
    else:
        q = F.col("_a")
    return picked.select(*group, "prob", q.alias("quantile"))


def rolling_mean(df: DataFrame, group: list[str], order_by: list, rows: int, means: dict[str, str], block: int = 100_000
                 ) -> DataFrame:
    """Mean of columns over the last ``rows`` rows of each group, ending at the current row.

    ``means`` maps an output name to a column.  Positions are cut into runs of ``rows``.  The frame of a row is the beginning of its own run
    up to it and the end of the run before from the row that lies ``rows - 1`` back: one running sum from each side, no subtraction, the same
    work for a row however long the frame is, and a NaN or a very large value touches the frames it lies in and no other.  A group is cut into
    blocks of whole runs, and a block also gets the last run before it, so no group is one task.
    """
    rows = max(rows, 1)
    block = -(-max(block, rows) // rows) * rows
    placed = with_group_position(df, group, order_by, "_pos", "_size").drop("_size")
    own = F.floor(F.col("_pos") / block)
    targets = F.when(F.col("_pos") % block >= block - rows, F.array(own, own + 1)).otherwise(F.array(own))
    spread = placed.withColumns({"_own": own, "_run": F.floor(F.col("_pos") / rows)}).withColumn("_block", F.explode(targets))
    run = Window.partitionBy(*group, "_block", "_run")
    back = run.orderBy(F.desc("_pos")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = run.orderBy("_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*group, "_block").orderBy("_run", "_pos")
    values = {n: F.col(c).cast("double") for n, c in means.items()}
    ends = spread.withColumns({f"_end_{n}": F.struct(F.sum(v).over(back).alias("sum"), F.count(v).over(back).alias("n")) for n, v in values.items()})
    parts = {}
    for n, v in values.items():
        earlier = F.lag(f"_end_{n}", rows - 1).over(before)
        whole = (F.col("_pos") + 1) % rows == 0  # the frame is the run itself
        parts[f"_sum_{n}"] = F.coalesce(F.sum(v).over(ahead), F.lit(0.0)) + F.when(whole, 0.0).otherwise(F.coalesce(earlier["sum"], F.lit(0.0)))
        parts[f"_n_{n}"] = F.count(v).over(ahead) + F.when(whole, 0).otherwise(F.coalesce(earlier["n"], F.lit(0)))
    out = ends.withColumns(parts).filter(F.col("_block") == F.col("_own"))
    out = out.withColumns({n: F.when(F.col(f"_n_{n}") > 0, F.col(f"_sum_{n}") / F.col(f"_n_{n}")) for n in means})
    return out.drop("_pos", "_own", "_run", "_block", *[f"_{x}_{n}" for n in means for x in ("end", "sum", "n")])
