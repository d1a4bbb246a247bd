"""Hand-made cases for the rules that are easy to get wrong."""

import pytest
from pyspark.sql import functions as F

from sentiloom.functions import engagement as E
from sentiloom.functions import sentiment as S
from sentiloom.functions import text as X


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("raw, want", [
    ("Check https://example.com/a?b=1 NOW", "check now"),
    ("mail a.b@c.d please", "mail please"),
    ("hi @satoshi and u/vitalik in r/defi", "hi and in"),
    ("and/or/maybe", "and/o"),  # the forum pattern has no word boundary
    ("#Bitcoin  to\tthe\nmoon ", "bitcoin to the moon"),
    ("a@b.c d", "d"),
    ("@abc@def x", "x"),
    ("Größe über ÉTÉ", "größe über été"),
    (None, ""), ("", ""),
])
def test_clean_text(spark, raw, want):
    assert one(spark, raw, X.clean_text) == want


def test_strip_and_stopwords(spark):
    assert one(spark, "don't $BTC, 5%!", X.strip_special) == "dont $BTC 5"
    assert one(spark, "don't $BTC", lambda c: X.strip_special(c, False)) == "dont BTC"
    # apostrophes go first, so "dont" is no stop word any more; "not" and "very" are kept
    assert one(spark, "I don't think this is not a very good coin", X.preprocess_text) == "dont think not very good coin"
    assert one(spark, "the fees", X.preprocess_text) == "fee"


def test_serving_clean(spark):
    assert one(spark, "Go! https://x.y Up_10%  now", X.serving_clean) == "go up_10 now"


def test_keywords_are_substrings(spark):
    assert one(spark, "bullish", lambda c: X.present(c, ["bull", "bullish", "red"])) == 2
    assert one(spark, "shared", lambda c: X.present(c, ["red"])) == 1
    assert one(spark, "moon moon", lambda c: X.present(c, ["moon"])) == 1


def test_coin_words_need_boundaries(spark):
    df = spark.createDataFrame([("method ETH, not ethics",), ("(btc) bitcoin_x",), ("adamant",)], "full_text string")
    rows = X.coin_flags(df).select("mentions_eth", "mentions_btc", "mentions_ada", "total_crypto_mentions").collect()
    assert [tuple(r) for r in rows] == [(1, 0, 0, 1), (0, 1, 0, 1), (0, 0, 0, 0)]


def test_mentions_repeat_and_tickers(spark):
    df = spark.createDataFrame([("btc BTC bitcoin $SOL,$ADA $toolong",)], "t string")
    low = X.coin_mentions_map(df, "t").first()
    raw = X.coin_mentions_map(df, "t", raw_case=True).first()
    assert low["crypto_mentions"]["bitcoin"] == ["btc", "btc", "bitcoin"] and "tickers" not in low["crypto_mentions"]
    assert raw["crypto_mentions"]["tickers"] == ["SOL", "ADA"] and raw["has_crypto_mention"]


def test_statistics_of_empty_text(spark):
    row = X.text_statistics(spark.createDataFrame([("",)], "cleaned_text string")).first()
    assert tuple(row)[1:] == (0, 0, 0, 0.0, 0)
    row = X.text_statistics(spark.createDataFrame([("One two. Three",)], "cleaned_text string")).first()
    assert (row["word_count"], row["sentence_count"], row["unique_word_count"]) == (3, 1, 3)


def test_time_and_engagement_bins(spark):
    hours = spark.createDataFrame([(h, f"2024-01-06 {h:02d}:30:00") for h in (0, 6, 7, 12, 13, 18, 19, 23)], "h int, s string")
    df = E.temporal_base(hours.withColumn("created_utc", F.to_timestamp("s"))).orderBy("h").collect()
    assert [r["time_of_day"] for r in df] == ["night", "night", "morning", "morning", "afternoon", "afternoon", "evening", "evening"]
    assert {r["day_of_week"] for r in df} == {5} and {r["is_weekend"] for r in df} == {1}
    scores = spark.createDataFrame([(s, 0) for s in (0, 1, 10, 11, 100, 101, -1, -2)], "score bigint, num_comments bigint")
    rows = {int(r["score"]): r for r in E.engagement_base(scores).collect()}
    assert [rows[s]["engagement_level"] for s in (0, 1, 10, 11, 100, 101)] == ["negative", "low", "low", "medium", "medium", "high"]
    assert rows[-1]["engagement_ratio"] is None and rows[-1]["log_score"] is None and rows[-2]["log_score"] is None


def test_word_and_polarity_bins(spark):
    df = spark.createDataFrame([(w, w, 0, w, 1.0) for w in (0, 50, 51, 150, 151, 301)],
                               "word_count int, unique_word_count int, sentence_count int, char_count int, avg_word_length double")
    got = [r["complexity_level"] for r in E.text_complexity(df).orderBy("word_count").collect()]
    assert got == [None, "very_short", "short", "short", "medium", "long"]
    df = spark.createDataFrame([(p, 0.6) for p in (-1.0, -0.1, 0.1, 1.0)], "sentiment_polarity double, sentiment_subjectivity double")
    got = [r["sentiment_category"] for r in E.sentiment_derived(df).orderBy("sentiment_polarity").collect()]
    assert got == [None, "negative", "neutral", "positive"]  # -1 lies outside the left-open first bin


def test_parse_created(spark):
    assert str(one(spark, "1704067200", E.parse_created)) == "2024-01-01 00:00:00"
    assert str(one(spark, "2024-01-01 05:00:00", E.parse_created)) == "2024-01-01 05:00:00"
    assert one(spark, "soon", E.parse_created) is None


def test_valence_negation_and_boost(spark):
    df = spark.createDataFrame([("good",), ("very good",), ("not good",), ("table",), ("",)], "full_text string")
    c = [r["vader_compound"] for r in S.valence_score(df).collect()]
    assert c[1] > c[0] > 0 > c[2] and c[3] == 0 and c[4] == 0


def vote_frame(spark, first, second, third, text="x"):
    row = {"cleaned_text": text, "textblob_prediction": first, "vader_prediction": second, "finbert_prediction": third}
    for name, picked in (("first", first), ("second", second), ("third", third)):
        row |= {f"{name}_{x}": float(x == picked) for x in ("negative", "neutral", "positive")}
    return spark.createDataFrame([row])


def test_vote_ties_and_agreement(spark):
    row = S.ensemble_label(vote_frame(spark, "positive", "positive", "negative"), text_col="cleaned_text").first()
    assert row["auto_label"] == "negative" and row["label_confidence"] == 0.5  # tie 0.5 : 0.5 goes to the earlier label
    assert row["label_agreement"] == pytest.approx(1 / 3)
    row = S.ensemble_label(vote_frame(spark, "positive", "neutral", "positive"), text_col="cleaned_text").first()
    assert row["auto_label"] == "positive" and row["label_agreement"] < 0.67  # two of three never reach 0.67
    row = S.ensemble_label(vote_frame(spark, "positive", "positive", "positive", ""), text_col="cleaned_text").first()
    assert (row["auto_label"], row["label_confidence"], row["label_agreement"]) == ("neutral", 0.0, 0.0)


@pytest.mark.parametrize("text, probs, want", [
    ("plain", (0.3, 0.35, 0.35), ("positive", 0.35)),    # 0.35 is not above the limit, but 0.65 > 1.5 * 0.35
    ("plain", (0.2, 0.55, 0.25), ("neutral", 0.55)),
    ("moon", (0.1, 0.55, 0.35), ("positive", 0.6)),      # boosted by a keyword
    ("crash", (0.1, 0.7, 0.2), ("neutral", 0.7)),        # boost to 0.6 stays below neutral and 0.8 < 1.05
    ("moon crash", (0.36, 0.34, 0.3), ("negative", 0.36)),
])
def test_threshold_classifier(spark, text, probs, want):
    df = spark.createDataFrame([(text, *probs)], "text string, p_negative double, p_neutral double, p_positive double")
    row = S.threshold_classifier(df).first()
    assert (row["prediction"], row["confidence"]) == want


def test_reason(spark):
    df = spark.createDataFrame([(0.1, 0.2, 0.7, 0.7), (0.8, 0.1, 0.1, 0.8)], "p_negative double, p_neutral double, p_positive double, confidence double")
    rows = S.explain_reason(df).collect()
    assert rows[0]["reason"] == "Text shows positive sentiment (confidence: 70.0%)" and rows[0]["confidence_level"] == "medium"
    assert rows[1]["confidence_level"] == "high"
