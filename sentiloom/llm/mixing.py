"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

1. Targets: every source asks for its weight's share of all words to take; a target stops at ``cap`` times its source, and what that frees
   is shared again by weight (water-filling over running sums, no iteration).
2. Apportionment: a block is ``BLOCK`` words.  Source ``s`` has the quotients target / (2k - 1), k = 1, 2, ...; the blocks go to the highest
   quotients, one after another.  ``SHARD`` blocks in a row are a shard of the mixture, so each shard has integer quotas, and as
   the rule never takes a block back when the house grows, the shards add up to the apportionment of the whole mixture.
3. Selection: the documents of a source stand in seeded order and form a ring of words cut into blocks.  A quota takes whole rounds,
   then a run of blocks from a seeded start.  A document at the edge of a run is taken in part.

Ranks and running sums come from range sorts of narrow rows, so a source with a third of all documents spans many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentiloom.llm.common import WORD, release, row_key, stored, table
from sentiloom.llm.registry import llm_query
from sentiloom.operators.ranking import running_totals, with_position

WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2
BLOCK, SHARD, SEED = 256, 4096, 20
_RUN = 10_000  # seats listed by one row, so that one large source is not listed in one task


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """``sources`` (source, source_size) -> with sid (rank by code point, null last), weight and target."""
    ranked = with_position(sources.withColumn("_none", F.col("source").isNull()), ["_none", "source"], "sid").drop("_none")
    cycle = F.array(*[F.lit(w) for w in weights])
    ranked = stored(ranked.withColumns({
        "weight": F.get(cycle, (F.col("sid") % len(weights)).cast("int")).cast("long"), "full": F.col("source_size") * cap}), "sources")
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    filling = running_totals(
        ranked.select("sid", "weight", "full", (F.col("full") / F.col("weight")).alias("ratio"), F.lit(0).alias("_all")),
        ["_all"], ["ratio", "sid"], ["full", "weight"])
    # the level if all sources that fill up earlier are full; the first source above its level sets the common one
    level = (F.lit(share * total) - (F.col("cum_full") - F.col("full"))) / (F.col("all_weight") - F.col("cum_weight") + F.col("weight"))
    common = filling.withColumn("level", level).filter("ratio > level").agg(F.min_by("level", F.struct("ratio", "sid"))).first()[0]
    target = F.col("full").cast("double") if common is None else F.least(F.col("full").cast("double"), F.col("weight") * F.lit(float(common)))
    return ranked.select("source", "source_size", "sid", "full", target.alias("target"))


def _within(price: float) -> Column:
    """Seats of a source whose quotient target / (2k - 1) is ``price`` or more."""
    return F.when(F.col("target") >= price, F.floor((F.col("target") / price + 1) / 2)).otherwise(F.lit(0)).cast("long")


def _price(aims: DataFrame, house: int, block: int) -> float:
    """A price at which the sources take ``house`` seats or a few more: one job per factor of 16 below twice the block, where half are taken at most."""
    price = 2.0 * block
    while True:
        prices = [price / 2 ** (j / 8) for j in range(33)]
        taken = aims.agg(*[F.sum(_within(p)).alias(f"n{j}") for j, p in enumerate(prices)]).first()
        for p, n in zip(prices, taken):
            if n >= house:
                return p * (1 - 1e-9)  # quotients that differ from the price by rounding only are listed too
        price = prices[-1]


def shard_quotas(aims: DataFrame, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """``aims`` (sid, target, ...) -> (shard, sid, quota): blocks of each source in each shard of the mixture.

    Listed are the seats at or above a price that fills the house, whatever the sizes of the sources.
    """
    aims = aims.filter("target > 0").select("sid", "target")
    house = int(round((aims.agg(F.sum("target")).first()[0] or 0.0) / block))
    most = _within(_price(aims, house, block)) if house else F.lit(0).cast("long")
    runs = aims.withColumn("most", most).filter("most > 0").select("sid", "target", "most", F.explode(F.sequence(F.lit(0).cast("long"), F.col("most"), F.lit(_RUN).cast("long"))).alias("from"))
    runs = runs.filter(F.col("from") < F.col("most"))
    seats = runs.repartition("sid", "from").select("sid", "target", F.explode(F.sequence(F.col("from") + 1, F.least(F.col("from") + _RUN, F.col("most")))).alias("k"))
    ranked = with_position(seats.select("sid", "k", (-F.col("target") / (2 * F.col("k") - 1)).alias("order")), ["order", "sid", "k"], "seat")
    return ranked.filter(F.col("seat") < house).groupBy(F.floor(F.col("seat") / shard).alias("shard"), "sid").agg(F.count(F.lit(1)).alias("quota"))


def mixture(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, taken.

    ``taken`` counts repeats and is ``cap`` times the size at most.  Null, empty and blank texts have size 0 and are taken 0 times.  Equal
    rows, and rows without an id, stand next to each other in the seeded order; which of them comes first is all the same.  An empty table
    gives no rows; other columns are ignored.
    """
    return _mixture(docs, [], weights, share, cap, block, seed)


def _mixture(docs: DataFrame, carried: list[str], weights=WEIGHTS, share: float = SHARE, cap: int = CAP, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """The mixture with columns that come after the id in the seeded order and are carried along."""
    sized = stored(docs.select(
        F.col("doc_id").cast("long"), F.col("source").cast("string"), n_words(F.col("text").cast("string")).alias("size"),
        F.xxhash64(F.lit(seed), "doc_id").alias("_order"), *carried), "sizes")
    aims = stored(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap), "targets")
    release(docs.sparkSession)  # every step is a range sort or two; what it leaves behind does not wait for the end of all
    quotas = stored(shard_quotas(aims, block).groupBy("sid").agg(F.sum("quota").alias("blocks")), "quotas")
    release(docs.sparkSession)
    plan = aims.join(quotas, "sid", "left").withColumn("words", F.least(F.coalesce(F.col("blocks"), F.lit(0)) * block, F.col("full")))
    rounds = F.floor(F.try_divide(F.col("words"), F.col("source_size")))
    plan = plan.withColumns({
        "rounds": F.coalesce(rounds, F.lit(0)),
        "begin": F.pmod(F.xxhash64(F.lit(seed), "sid"), F.greatest(F.ceil(F.col("source_size") / block), F.lit(1))) * block,
    }).withColumn("rest", F.col("words") - F.col("rounds") * F.col("source_size")).withColumnRenamed("source", "_source")
    known = sized.join(plan.select("sid", "_source"), sized["source"].eqNullSafe(F.col("_source"))).drop("_source")
    placed = running_totals(known, ["sid"], ["_order", "doc_id", "size", *carried], ["size"]).withColumn("_from", F.col("cum_size") - F.col("size"))
    release(docs.sparkSession)
    out = placed.join(plan.select("sid", "source_size", "target", "rounds", "begin", "rest"), "sid")

    def overlap(shift: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.col("cum_size"), F.col("begin") + F.col("rest") - shift) - F.greatest(F.col("_from"), F.col("begin") - shift))

    taken = F.col("rounds") * F.col("size") + overlap(F.lit(0)) + overlap(F.col("source_size"))
    return out.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), *carried)


def mix_sources(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last one: documents the mixture takes, with ``size`` and ``taken`` (words, repeats counted).

    Rows are told apart by id, text and source; rows equal in all three share the largest ``taken`` of them.  Columns of the two names
    are replaced.
    """
    release(spark)
    keyed = docs.drop("size", "taken").withColumns({"_llm_key": row_key(docs), "_llm_source": F.col("source").cast("string")})
    takes = _mixture(keyed.select("doc_id", "source", "text", "_llm_key"), ["_llm_key"]).groupBy("_llm_key", F.col("source").alias("_llm_from")).agg(
        F.max("size").alias("size"), F.max("taken").alias("taken")).filter("taken > 0").withColumnRenamed("_llm_key", "_llm_taken_key")
    return keyed.join(takes, (F.col("_llm_key") == F.col("_llm_taken_key")) & F.col("_llm_source").eqNullSafe(F.col("_llm_from"))).drop(
        "_llm_key", "_llm_taken_key", "_llm_source", "_llm_from")


@llm_query("op8_mixing")
def op8_mixing(spark, folder):
    return mixture(table(spark, folder, "documents"))
