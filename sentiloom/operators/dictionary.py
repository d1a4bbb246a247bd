"""Looking up the words of a row in a dictionary, without a shuffle.

The dictionary becomes one value, an array of buckets: the hash of a word picks its bucket, the few words in it are compared.  The value is a
scalar subquery, so it is made once and every row's expression refers to it; words are not exploded and rows stay where they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentiloom.functions.text import bind
from sentiloom.session import measured

MOST_WORDS = 100_000  # of a dictionary that is one value; larger ones are joined


class HashedDictionary:
    """``table`` (word, values...; words distinct) as a value that expressions can look words up in."""

    def __init__(self, table: DataFrame, word: str, size: int):
        self.word, self.buckets = word, 1 << max(4, (size - 1).bit_length())
        entry = F.struct(*table.columns)
        filled = table.filter(F.col(word).isNotNull()).groupBy(self._bucket(F.col(word)).alias("_b")).agg(F.collect_list(entry).alias("_e"))
        every = table.sparkSession.range(self.buckets).select(F.col("id").cast("int").alias("_b"))
        none = F.array().cast(filled.schema["_e"].dataType)
        self.table = every.join(filled, "_b", "left").agg(F.transform(
            F.array_sort(F.collect_list(F.struct("_b", F.coalesce("_e", none).alias("_e")))), lambda b: b["_e"]).alias("_dictionary"))

    def _bucket(self, word: Column) -> Column:
        return F.pmod(F.xxhash64(word), F.lit(self.buckets)).cast("int")

    def attach(self, df: DataFrame) -> DataFrame:
        """``df`` with the column ``_dictionary``, to be used in the next projection and dropped there: the planner then folds it into the expression."""
        return df.withColumn("_dictionary", self.table.scalar())

    def entries(self, words: Column) -> Column:
        """For each word its row of the dictionary, null if it has none."""
        def one(w: Column) -> Column:
            return F.get(F.filter(F.get(F.col("_dictionary"), self._bucket(w)), lambda e: e[self.word] == w), F.lit(0))

        return F.transform(words, one)


def hashed_dictionary(table: DataFrame, word: str = "word", most: int = MOST_WORDS) -> tuple[DataFrame, HashedDictionary | None]:
    """The table, written once, and its hashed form; None in place of that if it has more than ``most`` words."""
    table = measured(table, "dictionary")
    size = table.count()
    return table, HashedDictionary(table, word, size) if size <= most else None


def runs_of_equal(items: Column, key: str) -> Column:
    """Sorted array of structs -> structs (item, n) with the number of neighbours of equal ``key``, one per run."""
    def counted(sorted_items: Column) -> Column:
        last = F.size(sorted_items) - 1
        ends = F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
                        lambda i: (i <= last) & ~F.get(sorted_items, i + 1)[key].eqNullSafe(F.get(sorted_items, i)[key]))
        return bind(ends, lambda e: F.transform(e, lambda at, k: F.struct(
            F.get(sorted_items, at).alias("item"), (at - F.coalesce(F.get(e, k - 1), F.lit(-1))).alias("n"))))

    return bind(items, counted)
