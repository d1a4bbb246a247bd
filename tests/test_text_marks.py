"""The counts taken together are those of the single patterns, also for odd texts, and the features go over a text once for all of them."""

import random

from pyspark.sql import functions as F

from sentiloom.functions import patterns as P
from sentiloom.functions import text as X
from sentiloom.functions.marks import MARKS, text_marks
from sentiloom.plans.features import production_features

ODD = [
    None, "", " ", "\n\t ", "a", "A.", "..!?. x", "Hello,  World!\r\nYes?", "İİa İ", "aİe", "٣٤ 12３", "a b　c d\u0085e\u001cf",
    "Été naïve Σσς", "\U0001f680\U0001f48e!!", "\U0001d7ce\U0001d7cf", "x​y", "éa", "\x00a\x7f", "K ſ y",
]


def texts():
    rng = random.Random(3)
    parts = [x for t in ODD[1:] for x in t] + list("aeiouyAEIOUYbcdXYZ019 .!?,;-\t\n")
    return ODD + ["".join(rng.choices(parts, k=rng.randint(1, 80))) for _ in range(400)]


def table(spark):
    return spark.createDataFrame(list(enumerate(texts())), "post_id long, t string")


def test_marks_are_the_patterns_counts(spark):
    t = F.col("t")
    patterns = dict(zip(MARKS, [P.NWS + "+", "[A-Z]", "[a-z]", P.DIGIT, P.WS, "!", r"\?", ",", r"\.", P.SENTENCE_END]))
    want = [X.count_matches(t, p).alias(f"want_{m}") for m, p in patterns.items()] + [X.count_matches(F.lower(t), P.VOWEL_GROUP).alias("want_vowel_groups")]
    for row in table(spark).withColumn("m", text_marks(t)).select("t", "m", *want).collect():
        assert [row.m[m] if row.m else None for m in MARKS] == [row[f"want_{m}"] for m in MARKS], row.t


def test_features_are_those_of_the_single_functions(spark):
    df = table(spark)
    posts = df.select("*", F.lit(3).alias("score"), F.lit(0.5).alias("upvote_ratio"), F.lit(2).alias("num_comments"))
    plain = X.char_class_counts(df, "t")
    plain = X.sentence_features(X.avg_word_length(X.readability(plain, "t"), "t"), "t")
    names = [c for c in plain.columns if c != "t"]
    made = production_features(posts, "t")
    assert X.MARKED not in made.columns
    assert made.select(names).orderBy("post_id").collect() == plain.select(names).orderBy("post_id").collect()


def test_features_have_no_regex_per_character_class(spark, capsys):
    posts = table(spark).select("*", F.lit(3).alias("score"), F.lit(0.5).alias("upvote_ratio"), F.lit(2).alias("num_comments"))
    production_features(posts, "t").explain(True)
    plan = capsys.readouterr().out
    assert "[A-Z]" not in plan and P.VOWEL_GROUP not in plan and P.SENTENCE_END not in plan
    assert plan.split("== Physical Plan ==")[1].count("ArrowEvalPython") == 1
