"""Joins: statistics back to rows, newest per key, referential checks, dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentiloom.operators.dictionary import hashed_dictionary
from sentiloom.session import measured


def dictionary_join(left: DataFrame, table: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """Join word rows with a dictionary of any size.

    No hint and no switch: adaptive execution broadcasts a dictionary it has measured to be small and splits the partition
    of a very frequent word otherwise.
    """
    return left.join(table, on, how)


def group_join(left: DataFrame, groups: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join a per-group table (one narrow row per group) back to the group's rows; a null group is a group too.

    The groups are written first, so the planner knows their bytes: below its own threshold they are broadcast and the rows stay
    where they are, above it the join is left to adaptive execution, which splits a hot group.  Rows may have columns of any type.
    """
    names = {c: f"_k_{c}" for c in on}
    renamed = measured(groups.withColumnsRenamed(names), "groups")
    same = [left[c].eqNullSafe(renamed[k]) for c, k in names.items()]
    return left.join(renamed, same, how).drop(*names.values())


def join_stats(df: DataFrame, stats: DataFrame, key: str) -> DataFrame:
    """Left join of one-row-per-key statistics."""
    return group_join(df, stats, [key], "left")


def latest_rank(predictions: DataFrame, upto: int = 1) -> DataFrame:
    """Rows with a time whose rank by time within the post is at most ``upto``, newest first, ties kept.

    Spark limits each group before the shuffle already, so a post with very many predictions is cut where its rows lie.
    """
    newest = Window.partitionBy("post_id").orderBy(F.desc("predicted_at"))
    timed = predictions.filter(F.col("predicted_at").isNotNull())
    return timed.withColumn("latest_rank", F.rank().over(newest)).filter(F.col("latest_rank") <= upto)


def latest_predictions(predictions: DataFrame, posts: DataFrame) -> DataFrame:
    """Newest prediction of each post (ties kept) with the post's columns."""
    post_columns = posts.select("post_id", "title", "content", "subreddit", "created_utc")
    return latest_rank(predictions).drop("latest_rank").join(post_columns, "post_id")


def orphan_rows(children: DataFrame, parents: DataFrame, key: str = "post_id") -> DataFrame:
    return children.join(parents.select(key), key, "left_anti")


def cascade_retain(children: DataFrame, surviving: DataFrame, key: str = "post_id") -> DataFrame:
    return children.join(surviving.select(key), key, "left_semi")


def attach_by_key(df: DataFrame, features: DataFrame, key: str = "post_id") -> DataFrame:
    return df.join(features, key, "left")


def align_labels(truth: DataFrame, predicted: DataFrame, key: str = "post_id") -> DataFrame:
    return truth.join(predicted, key, "inner")


def lexicon_join(words: DataFrame, lexicon: DataFrame, key: str = "post_id") -> DataFrame:
    """Mean polarity and subjectivity per post from a lexicon *table* (word, polarity, subjectivity).

    ``words`` has one row per word.  Misses are dropped before the shuffle and a post's hits
    are summed map-side, so one small row per post travels.
    """
    hits = dictionary_join(words, lexicon, "word")
    return hits.groupBy(key).agg(
        F.avg("polarity").alias("sentiment_polarity"),
        F.avg("subjectivity").alias("sentiment_subjectivity"),
        F.count(F.lit(1)).alias("hits"))


def lemma_join(posts: DataFrame, words: str, lemmas: DataFrame, key: str = "post_id") -> DataFrame:
    """Rebuild each post's text from dictionary lemmas (word, lemma); unknown words stay.

    ``words`` is an array column.  Words are looked up inside the row; a dictionary too large for that is joined, and a post's words are
    gathered again.
    """
    table, hashed = hashed_dictionary(lemmas.select("word", "lemma"))
    if hashed is not None:
        found = F.zip_with(F.col("_w"), hashed.entries(F.col("_w")), lambda w, e: F.coalesce(e["lemma"], w))
        return hashed.attach(posts.select(key, F.col(words).alias("_w"))).select(key, F.array_join(found, " ").alias("lemmatized_text"))
    looked_up = dictionary_join(posts.select(key, F.posexplode(words).alias("pos", "word")), table, "word", "left")
    pairs = F.struct("pos", F.coalesce("lemma", "word").alias("w"))
    return looked_up.groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(pairs)), lambda e: e["w"]), " ").alias("lemmatized_text"))


def synonym_join(words: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Words with their synonym list (word, synonyms); words without one keep null."""
    return dictionary_join(words, synonyms, "word", "left")
