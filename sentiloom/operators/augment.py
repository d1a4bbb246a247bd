"""Class balancing with edited copies of minority-class texts.

All choices come from a digest of seed, row and copy number, so a retried task makes
the same copies.  Quotas are exact: a row's copies follow from its position in its
class, whatever the size of the class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentiloom import lexicons as L
from sentiloom.functions.sentiment import heuristic_label, label_name
from sentiloom.functions.text import bind, full_text, tokens
from sentiloom.operators.frames import min_length_filter
from sentiloom.operators.joins import group_join
from sentiloom.operators.ranking import with_group_position
from sentiloom.operators.sampling import seeded, seeded_unit
from sentiloom.session import measured

CONSERVATIVE_SHARE, MAX_COPIES, RATIO = 0.3, 2, 0.5  # fixed values
MIN_WORDS, MIN_WORDS_ADVANCED, KEEP_SHARE = 5, 3, 0.8
METHODS = ("synonym", "insertion", "swap", "deletion")


def _draw(seed: int, *parts: Column | str) -> Column:
    return seeded_unit(seed, *parts)


def _pick(unit: Column, n: Column) -> Column:
    """0-based index below ``n``."""
    return F.least(F.floor(unit * n), n - 1).cast("int")


def _synonym_of(word: Column, unit: Column) -> Column:
    table = F.create_map(*[x for w, s in L.SYNONYMS.items() for x in (F.lit(w), F.array(*[F.lit(y) for y in s]))])
    choices = F.element_at(table, F.lower(word))
    return F.get(choices, _pick(unit, F.size(choices)))


def words_of(text: Column) -> Column:
    """Words of a text; the edits take them ready-made as ``words`` where several edits share them."""
    return tokens(F.coalesce(text, F.lit("")))


def synonym_replacement(text: Column, key: list, n: int = 1, seed: int = 42, min_words: int = MIN_WORDS, words: Column | None = None) -> Column:
    """Replace ``n`` words that have synonyms; short texts stay as they are."""

    def edit(w: Column) -> Column:
        spots = F.filter(F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0))),
                         lambda i: F.lower(F.get(w, i)).isin(list(L.SYNONYMS)))
        ranked = F.transform(spots, lambda i: F.struct(seeded(seed, *key, i).alias("h"), i.alias("i")))
        drawn = F.transform(F.slice(F.sort_array(ranked), 1, n), lambda e: e["i"])
        replaced = bind(drawn, lambda chosen: F.transform(w, lambda x, i: F.when(
            F.array_contains(chosen, i), _synonym_of(x, _draw(seed + 1, *key, i))).otherwise(x)))
        return F.when(F.size(w) < min_words, text).otherwise(F.array_join(replaced, " "))

    return bind(words_of(text) if words is None else words, edit)


def random_insertion(text: Column, key: list, seed: int = 42, min_words: int = MIN_WORDS_ADVANCED, words: Column | None = None) -> Column:
    """Insert a synonym of one drawn word at a drawn place, if it has one."""

    def edit(w: Column) -> Column:
        size = F.size(w)
        source = F.get(w, _pick(_draw(seed, *key, F.lit("word")), size))
        new = bind(source, lambda s: F.when(
            F.lower(s).isin(list(L.SYNONYMS)), _synonym_of(s, _draw(seed, *key, F.lit("synonym")))))
        at = _pick(_draw(seed, *key, F.lit("place")), size + 1)

        def place(d: Column) -> Column:
            longer = F.concat(F.slice(w, 1, d["at"]), F.array(d["new"]), F.slice(w, d["at"] + 1, F.greatest(size, F.lit(1))))
            return F.when((size < min_words) | d["new"].isNull(), text).otherwise(F.array_join(longer, " "))

        return bind(F.struct(new.alias("new"), at.alias("at")), place)

    return bind(words_of(text) if words is None else words, edit)


def random_swap(text: Column, key: list, n: int = 2, seed: int = 42, min_words: int = MIN_WORDS_ADVANCED, words: Column | None = None) -> Column:
    """Swap ``n`` drawn pairs of different places, one after the other."""

    def edit(w: Column) -> Column:
        size = F.size(w)
        moved = w
        for k in range(n):
            a = _pick(_draw(seed, *key, F.lit(f"a{k}")), size)
            shift = 1 + _pick(_draw(seed, *key, F.lit(f"b{k}")), size - 1)
            moved = _swapped(moved, a, F.pmod(a + shift, size))
        return F.when(size < min_words, text).otherwise(F.array_join(moved, " "))

    return bind(words_of(text) if words is None else words, edit)


def _swapped(words: Column, a: Column, b: Column) -> Column:
    return bind(F.struct(words.alias("w"), a.alias("a"), b.alias("b")), lambda s: F.transform(
        s["w"], lambda x, i: F.when(i == s["a"], F.get(s["w"], s["b"])).when(i == s["b"], F.get(s["w"], s["a"])).otherwise(x)))


def random_deletion(text: Column, key: list, p: float = 0.05, seed: int = 42, min_words: int = MIN_WORDS,
                    keep_share: float = KEEP_SHARE, words: Column | None = None) -> Column:
    """Drop words with probability ``p``; unchanged when less than ``keep_share`` would stay, never empty."""

    def edit(w: Column) -> Column:
        numbered = F.transform(w, lambda x, i: F.struct(x.alias("w"), _draw(seed, *key, i).alias("u")))
        one = F.get(w, _pick(_draw(seed, *key, F.lit("one")), F.size(w)))

        def join(kept: Column) -> Column:
            short = (F.size(w) < min_words) | (F.size(kept) < F.size(w) * keep_share)
            return F.when(short, text).when(F.size(kept) == 0, one).otherwise(F.array_join(kept, " "))

        return bind(F.transform(F.filter(numbered, lambda e: e["u"] > p), lambda e: e["w"]), join)

    return bind(words_of(text) if words is None else words, edit)


def edit_text(method: Column, text: Column, key: list, seed: int, conservative: bool) -> Column:
    """Apply the named edit."""
    if conservative:
        edits = {"synonym": synonym_replacement(text, key, 1, seed), "deletion": random_deletion(text, key, 0.05, seed)}
    else:
        edits = {
            "synonym": synonym_replacement(text, key, 2, seed, MIN_WORDS_ADVANCED),
            "insertion": random_insertion(text, key, seed),
            "swap": random_swap(text, key, 2, seed),
            "deletion": random_deletion(text, key, 0.1, seed, MIN_WORDS_ADVANCED, 0.0),
        }
    out = text
    for name, edited in edits.items():
        out = F.when(method == name, edited).otherwise(out)
    return out


def class_quotas(df: DataFrame, label: str, share: float, max_copies: int | None) -> DataFrame:
    """Copies wanted per class: up to ``share`` of the largest class, at most ``max_copies`` per row."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("count"))
    largest = counts.select(F.max("count")).scalar()
    want = F.greatest(F.lit(0), F.floor(largest * share) - F.col("count"))
    if max_copies is not None:
        want = F.least(want, F.col("count") * max_copies)
    return counts.withColumn("quota", want.cast("bigint"))


COPY_BLOCK = 1000  # copies of a row that one row of the second step makes


def replicas(df: DataFrame, label: str, share: float, max_copies: int | None, key: str, seed: int) -> DataFrame:
    """One row per copy to make, with ``copy_no``; quotas are met exactly by cycling through the class.

    Copies are made in two steps: slim rows (key, block of copies) are dealt out first, so the many copies of one row are made by
    several tasks; the wide row then meets its blocks.
    """
    quotas = class_quotas(df, label, share, max_copies).select(label, "quota").filter("quota > 0")
    slim = group_join(df.select(key, label), quotas, [label])
    placed = with_group_position(slim.withColumn("_h", seeded(seed, key)), [label], ["_h", key], "_pos", "_n")
    copies = F.floor((F.col("quota") - F.col("_pos") + F.col("_n") - 1) / F.col("_n"))  # whole numbers
    chosen = placed.select(key, copies.cast("long").alias("_copies")).filter("_copies > 0")
    last = F.floor((F.col("_copies") - 1) / COPY_BLOCK)
    blocks = chosen.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), last))).repartition(key, "_block")
    first, end = F.col("_block") * COPY_BLOCK + 1, F.least(F.col("_copies"), (F.col("_block") + 1) * COPY_BLOCK)
    numbered = blocks.select(key, F.explode(F.sequence(first, end)).alias("copy_no"))
    return df.join(numbered, key)


def union_augmented(df: DataFrame, copies: DataFrame) -> DataFrame:
    """Originals and copies with their provenance."""
    marked = df.withColumns({"is_augmented": F.lit(False), "augmentation_method": F.lit("original")})
    return marked.unionByName(copies.withColumn("is_augmented", F.lit(True)), allowMissingColumns=True)


def _augment(df, text_col, label, share, max_copies, methods, key, seed, conservative) -> DataFrame:
    made = replicas(df, label, share, max_copies, key, seed)
    parts = [key, "copy_no"]
    names = F.array(*[F.lit(m) for m in methods])
    made = made.withColumn("augmentation_method", F.get(names, _pick(_draw(seed + 7, *parts), F.lit(len(methods)))))
    made = made.withColumns({"_old": F.col(text_col), text_col: edit_text(
        F.col("augmentation_method"), F.col(text_col), parts, seed, conservative)})
    if conservative:
        made = made.filter(~F.col(text_col).eqNullSafe(F.col("_old")))
    return union_augmented(df, made.drop("_old", "copy_no"))


def augment_minority_conservative(df: DataFrame, text_col: str = "preprocessed_text", label: str = "auto_label_id",
                                  methods: tuple = ("synonym",), key: str = "post_id", seed: int = 42) -> DataFrame:
    """Classes below 30 % of the largest get up to two copies per row; copies an edit left unchanged are dropped."""
    return _augment(df, text_col, label, CONSERVATIVE_SHARE, MAX_COPIES, methods, key, seed, True)


def augment_minority_ratio(df: DataFrame, text_col: str = "preprocessed_text", label: str = "auto_label_id",
                           ratio: float = RATIO, methods: tuple = ("synonym", "insertion", "swap"), key: str = "post_id",
                           seed: int = 42) -> DataFrame:
    """Every smaller class is filled up to ``ratio`` of the largest."""
    return _augment(df, text_col, label, ratio, None, methods, key, seed, False)


def text_mixup(df: DataFrame, text_col: str, label: str, alpha: float = 0.5, key: str = "post_id", seed: int = 42) -> DataFrame:
    """Mix each text with the next one of its class in shuffled order: one partner per row.

    Partners meet on (class, position), a unique key, so no pair grid arises.
    """
    df = measured(df.select(key, label, text_col), "mixed")  # each text is made once, though it is read as itself and as a partner
    placed = with_group_position(df.select(key, label).withColumn("_h", seeded(seed, key)), [label], ["_h", key],
                                 "_pos", "_n").drop("_h")
    partner = placed.select(F.col(label).alias("_label"), F.pmod(F.col("_pos") - 1, F.col("_n")).alias("_at"),
                            F.col(key).alias("partner_id"))
    couples = placed.join(partner, (placed[label] == partner["_label"]) & (placed["_pos"] == partner["_at"])).select(key, "partner_id")
    texts = df.select(F.col(key).alias("partner_id"), F.col(text_col).alias("_other"))
    pairs = df.select(key, label, text_col).join(couples, key).join(texts, "partner_id")

    def sampled(text: Column, share: float, who: str) -> Column:
        words = words_of(text)
        ranked = F.sort_array(F.transform(words, lambda w, i: F.struct(seeded(seed, key, F.lit(who), i).alias("h"), w.alias("w"))))
        return F.slice(ranked, 1, F.floor(F.size(words) * share).cast("int"))

    both = F.concat(sampled(F.col(text_col), alpha, "a"), sampled(F.col("_other"), 1 - alpha, "b"))
    mixed = F.transform(F.sort_array(F.transform(both, lambda e: F.struct(F.md5(e["h"]).alias("h"), e["w"].alias("w")))), lambda e: e["w"])
    return pairs.select(key, "partner_id", label, F.array_join(mixed, " ").alias("mixed_text"))


def smart_balance(posts: DataFrame, seed: int = 42) -> DataFrame:
    """Heuristic labels, length filter, conservative augmentation and label names."""
    t = full_text(F.col("title"), F.col("content"))
    labeled = posts.withColumn("full_text", t).withColumn("heuristic_label", heuristic_label(F.col("full_text")))
    written = measured(min_length_filter(labeled).drop("full_text"), "balanced")  # quotas, places and copies read these files
    kept = written.withColumn("full_text", t).select(*labeled.columns)
    balanced = augment_minority_conservative(kept, "full_text", "heuristic_label", seed=seed)
    return balanced.withColumnRenamed("heuristic_label", "auto_label_id").withColumn(
        "auto_label", label_name(F.col("auto_label_id")))
