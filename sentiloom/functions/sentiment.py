"""Lexicon scores, annotators, weighted vote and serving rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentiloom import lexicons as L
from sentiloom.functions import patterns as P
from sentiloom.functions.text import present
from sentiloom.schemas import LABEL_NAMES


def words_of(text: Column) -> Column:
    """Lower-case runs of word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(P.WORD + "+"), F.lit(0))


def _level(word: Column, groups: list, slot: int) -> Column:
    """Value of the group ``word`` is in (hashed ``isin`` per group), else null."""
    out = F.lit(None).cast("double")
    for group in reversed(groups):
        out = F.when(word.isin(group[-1]), F.lit(group[slot])).otherwise(out)
    return out


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def polarity_score(df: DataFrame, text_col: str = "cleaned_text") -> DataFrame:
    """Mean polarity and subjectivity of the lexicon words in each text, 0.0 without a hit.

    The lexicon is a fixed literal, so each text is scored where it lies: no
    explode, no join, no shuffle.
    """
    hits = F.filter(words_of(F.coalesce(F.col(text_col), F.lit(""))),
                    lambda w: w.isin([x for g in L.POLARITY_GROUPS for x in g[-1]]))
    scored = F.transform(hits, lambda w: F.struct(
        _level(w, L.POLARITY_GROUPS, 0).alias("p"), _level(w, L.POLARITY_GROUPS, 1).alias("s")))
    return (
        df.withColumn("_hits", scored)
        .withColumns({
            "sentiment_polarity": F.coalesce(F.try_divide(
                _sum(F.transform("_hits", lambda h: h["p"])), F.size("_hits").cast("double")), F.lit(0.0)),
            "sentiment_subjectivity": F.coalesce(F.try_divide(
                _sum(F.transform("_hits", lambda h: h["s"])), F.size("_hits").cast("double")), F.lit(0.0)),
        })
        .drop("_hits")
    )


def valence_score(df: DataFrame, text_col: str = "full_text") -> DataFrame:
    """Negative/neutral/positive shares and the compound s/sqrt(s*s+15).

    A booster right before a lexicon word strengthens it, a negator among the
    three words before it flips it.
    """
    words = F.col("_words")
    lexicon = [x for g in L.VALENCE_GROUPS for x in g[-1]]

    def word_at(i: Column, back: int) -> Column:
        return F.try_element_at(words, F.when(i >= back, i + 1 - back))

    def score(w: Column, i: Column) -> Column:
        base = _level(w, L.VALENCE_GROUPS, 0)
        boosted = F.when(F.coalesce(word_at(i, 1).isin(L.BOOSTERS), F.lit(False)),
                         base + F.signum(base) * L.BOOST_STEP).otherwise(base)
        negated = F.lit(False)
        for back in (1, 2, 3):
            negated = negated | F.coalesce(word_at(i, back).isin(L.NEGATORS), F.lit(False))
        value = F.when(negated, boosted * L.NEGATION_FACTOR).otherwise(boosted)
        return F.when(w.isin(lexicon), value).otherwise(F.lit(0.0))

    total = F.col("_total")
    per_word = F.col("_valence")
    plus = _sum(F.transform(F.filter(per_word, lambda v: v > 0), lambda v: v + 1))
    minus = _sum(F.transform(F.filter(per_word, lambda v: v < 0), lambda v: v - 1))
    flat = F.size(F.filter(per_word, lambda v: v == 0)).cast("double")
    mass = F.col("_plus") + F.abs(F.col("_minus")) + F.col("_flat")
    return (
        df.withColumn("_words", words_of(F.coalesce(F.col(text_col), F.lit(""))))
        .withColumn("_valence", F.transform(words, score))
        .withColumns({"_total": _sum(per_word), "_plus": plus, "_minus": minus, "_flat": flat})
        .withColumns({
            "vader_compound": total / F.sqrt(total * total + L.VALENCE_ALPHA),
            "vader_neg": F.coalesce(F.try_divide(F.abs(F.col("_minus")), mass), F.lit(0.0)),
            "vader_neu": F.coalesce(F.try_divide(F.col("_flat"), mass), F.lit(0.0)),
            "vader_pos": F.coalesce(F.try_divide(F.col("_plus"), mass), F.lit(0.0)),
        })
        .drop("_words", "_valence", "_total", "_plus", "_minus", "_flat")
    )


def argmax_label(negative: Column, neutral: Column, positive: Column) -> Column:
    """Name of the largest score; ties go to the earlier label."""
    best = F.greatest(negative, neutral, positive)
    return F.when(negative == best, "negative").when(neutral == best, "neutral").when(positive == best, "positive")


def label_id(name: Column) -> Column:
    out = F.lit(None).cast("int")
    for i, label in enumerate(LABEL_NAMES):
        out = F.when(name == label, i).otherwise(out)
    return out


def label_name(number: Column) -> Column:
    out = F.lit(None).cast("string")
    for i, label in enumerate(LABEL_NAMES):
        out = F.when(number == i, label).otherwise(out)
    return out


def annotator_labels(df: DataFrame) -> DataFrame:
    """Three annotators: polarity cut at 0.1, compound cut at 0.05, argmax of given probabilities.

    Needs ``sentiment_polarity``, the ``vader_*`` columns and ``third_negative``,
    ``third_neutral``, ``third_positive``.
    """
    p, c = F.col("sentiment_polarity"), F.col("vader_compound")
    first = F.when(p > 0.1, "positive").when(p < -0.1, "negative").otherwise("neutral")
    second = F.when(c >= 0.05, "positive").when(c <= -0.05, "negative").otherwise("neutral")
    mass = F.col("vader_neg") + F.col("vader_neu") + F.col("vader_pos")
    third = [F.col(f"third_{x}") for x in LABEL_NAMES]

    def share(name: str, empty: float) -> Column:
        return F.when(mass > 0, F.try_divide(F.col(name), mass)).otherwise(empty)

    out = df.withColumns({
        "textblob_prediction": first,
        "textblob_confidence": F.abs(p),
        "vader_prediction": second,
        "vader_confidence": F.abs(c),
        "second_negative": share("vader_neg", 0.0),
        "second_neutral": share("vader_neu", 1.0),
        "second_positive": share("vader_pos", 0.0),
        "finbert_prediction": argmax_label(*third),
        "finbert_confidence": F.greatest(*third),
    })
    return out.withColumns({
        f"first_{x}": (F.col("textblob_prediction") == x).cast("double") for x in LABEL_NAMES})


VOTE_WEIGHTS = (0.2, 0.3, 0.5)  # fixed values


def ensemble_label(df: DataFrame, weights=VOTE_WEIGHTS, text_col: str | None = None) -> DataFrame:
    """Weighted vote of the three annotators; empty text is neutral with confidence 0."""
    a, b, c = weights
    scores = {
        f"score_{x}": a * F.col(f"first_{x}") + b * F.col(f"second_{x}") + c * F.col(f"third_{x}")
        for x in LABEL_NAMES
    }
    out = df.withColumns(scores)
    names = ["textblob_prediction", "vader_prediction", "finbert_prediction"]
    if text_col:
        empty = F.coalesce(F.col(text_col), F.lit("")) == ""
        neutral = {"score_negative": 0.0, "score_neutral": 1.0, "score_positive": 0.0}
        out = out.withColumns(
            {k: F.when(empty, v).otherwise(F.col(k)) for k, v in neutral.items()}
            | {n: F.when(empty, "neutral").otherwise(F.col(n)) for n in names})
    cols = [F.col(f"score_{x}") for x in LABEL_NAMES]
    out = out.withColumn("auto_label", argmax_label(*cols))
    agree = sum(((F.col(n) == F.col("auto_label")).cast("int") for n in names), F.lit(0)) / F.lit(3.0)
    confidence = F.greatest(*cols)
    if text_col:
        agree = F.when(empty, 0.0).otherwise(agree)
        confidence = F.when(empty, 0.0).otherwise(confidence)
    return out.withColumns({
        "auto_label_id": label_id(F.col("auto_label")),
        "label_confidence": confidence,
        "label_agreement": agree,
    })


def keyword_balance(text: Column, positive: list[str], negative: list[str]) -> tuple[Column, Column]:
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return present(lowered, positive), present(lowered, negative)


def heuristic_label(text: Column) -> Column:
    good, bad = keyword_balance(text, L.HEURISTIC_POSITIVE, L.HEURISTIC_NEGATIVE)
    return F.when(good > bad, 2).when(bad > good, 0).otherwise(1)


BOOST_TO, CLEAR_ABOVE, SPLIT_RATIO = 0.6, 0.35, 1.5  # fixed values


def threshold_classifier(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Keyword boost, then the low-threshold decision; needs ``p_negative/p_neutral/p_positive``."""
    good, bad = keyword_balance(F.col(text_col), L.STRONG_POSITIVE, L.STRONG_NEGATIVE)
    out = df.withColumns({"_good": good, "_bad": bad}).withColumns({
        "_pos": F.when(F.col("_good") > F.col("_bad"), F.greatest(F.col("p_positive"), F.lit(BOOST_TO)))
        .otherwise(F.col("p_positive")),
        "_neg": F.when(F.col("_bad") > F.col("_good"), F.greatest(F.col("p_negative"), F.lit(BOOST_TO)))
        .otherwise(F.col("p_negative")),
    })
    pos, neg, neu = F.col("_pos"), F.col("_neg"), F.col("p_neutral")
    label = (
        F.when((pos > neg) & (pos > neu) & (pos > CLEAR_ABOVE), "positive")
        .when((neg > pos) & (neg > neu) & (neg > CLEAR_ABOVE), "negative")
        .when((pos + neg > neu * SPLIT_RATIO) & (pos > neg), "positive")
        .when(pos + neg > neu * SPLIT_RATIO, "negative")
        .otherwise("neutral")
    )
    out = out.withColumn("prediction", label)
    confidence = F.when(F.col("prediction") == "positive", pos).when(F.col("prediction") == "negative", neg) \
        .otherwise(neu)
    return out.withColumn("confidence", confidence).drop("_good", "_bad", "_pos", "_neg")


def explain_reason(df: DataFrame) -> DataFrame:
    """Confidence level and a sentence; needs ``confidence`` and the three probabilities."""
    neg, neu, pos = (F.col(f"p_{x}") for x in LABEL_NAMES)
    best = F.greatest(neg, neu, pos)

    def percent(value: Column) -> Column:
        return F.concat(F.format_string("%.1f", F.round(value * 100, 1)), F.lit("%)"))

    reason = (
        F.when(pos == best, F.concat(F.lit("Text shows positive sentiment (confidence: "), percent(pos)))
        .when(neg == best, F.concat(F.lit("Text shows negative sentiment (confidence: "), percent(neg)))
        .otherwise(F.concat(F.lit("Text is neutral or mixed (confidence: "), percent(neu)))
    )
    c = F.col("confidence")
    return df.withColumns({
        "reason": reason,
        "confidence_level": F.when(c > 0.7, "high").when(c > 0.5, "medium").otherwise("low"),
    })
