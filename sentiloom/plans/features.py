"""Whole feature sets, each a chain of operators over one text column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentiloom import lexicons as L
from sentiloom.functions import engagement as E
from sentiloom.functions import sentiment as S
from sentiloom.functions import text as X
from sentiloom.operators.statistics import relative_to_group, subreddit_stats


def process_posts(df: DataFrame) -> DataFrame:
    """Text columns of the table path: full, cleaned and preprocessed text, scores, counts, coins."""
    out = df.withColumn("full_text", X.full_text(F.col("title"), F.col("content")))
    out = out.withColumn("cleaned_text", X.clean_text(F.col("full_text")))
    out = out.withColumn("preprocessed_text", X.preprocess_text(F.col("cleaned_text")))
    return X.coin_mentions_map(X.text_statistics(S.polarity_score(out)))


def base_features(df: DataFrame) -> DataFrame:
    """Time, engagement, complexity, sentiment and forum features of processed posts."""
    out = E.sentiment_derived(E.text_complexity(E.engagement_base(E.temporal_base(df))))
    return relative_to_group(out, subreddit_stats(out))


def clean_features(df: DataFrame, text_col: str = "full_text") -> DataFrame:
    out = X.char_ratios(X.url_mention_hashtag(X.char_class_counts(df, text_col), text_col))
    out = X.sentence_features(X.avg_word_length(X.lexical_diversity(X.readability(out, text_col), text_col), text_col), text_col)
    out = X.keyword_ratios(X.keyword_counts(out, text_col), text_col)
    out = X.trading_terms(X.price_percent(X.coin_flags(out, text_col), text_col), text_col)
    out = E.engagement_post(X.emoji_features(out, text_col))
    if "created_utc" in df.columns:
        out = E.temporal_cyclic(out)
    return S.polarity_score(out, text_col)


def production_features(df: DataFrame, text_col: str = "preprocessed_text", temporal: bool = False) -> DataFrame:
    """The served feature set; the five time columns are off, as in the trained model."""
    out = X.char_ratios(X.char_class_counts(X.with_marks(df, text_col), text_col), commas=False)
    out = X.sentence_features(X.avg_word_length(X.lexical_diversity(X.readability(out, text_col), text_col), text_col), text_col)
    out = X.keyword_ratios(X.keyword_counts(out, text_col), text_col, urgency=False)
    out = X.price_percent(X.coin_flags(out.drop(X.MARKED), text_col, L.COINS_PRODUCTION), text_col)
    out = E.engagement_post(out, production=True)
    return E.temporal_cyclic(out, production=True) if temporal else out


def advanced_features(df: DataFrame, text_col: str = "full_text") -> DataFrame:
    out = X.keyword_counts(df, "preprocessed_text" if "preprocessed_text" in df.columns else text_col, advanced=True)
    out = out.withColumn("bullish_bearish_ratio", F.col("bullish_keyword_count") / (F.col("bearish_keyword_count") + 1))
    out = X.readability(S.valence_score(out, text_col), text_col, min_words=6).drop("syllable_count")
    out = X.emoji_features(X.price_percent(out, text_col, advanced=True), text_col, advanced=True)
    out = X.coin_flags(out, text_col, L.COINS_PRODUCTION)
    return out.withColumn("hashtag_count", X.count_marked(F.col(text_col), "#", "#" + X.P.WORD + "+"))
