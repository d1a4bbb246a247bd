"""Engagement, time, bins, column selection and row filters."""

from pyspark.sql import functions as F

from sentiloom import lexicons as L
from sentiloom.functions import engagement as E
from sentiloom.functions import sentiment as S
from sentiloom.functions import text as X
from sentiloom.operators import frames, statistics
from sentiloom.plans import oracle as O
from sentiloom.functions import patterns as P
from sentiloom.plans.catalog.c_text import CLEANED, COUNTS, PREPROCESSED, TEXTS, r6
from sentiloom.plans.registry import query


def _ln1p(e):
    return f"CASE WHEN ({e}) > -1 THEN round(ln(1 + ({e})::DOUBLE), 6) END"


@query("engagement_base", f"""
SELECT post_id, round(c / nullif(s + 1, 0), 6) AS engagement_ratio, c - s AS controversy_score,
 {_ln1p('s')} AS log_score, {_ln1p('c')} AS log_comments,
 CASE WHEN s <= 0 THEN 'negative' WHEN s <= 10 THEN 'low' WHEN s <= 100 THEN 'medium' ELSE 'high' END AS engagement_level,
 CAST(c > s * 0.5 AS INT) AS viral_potential
FROM (SELECT post_id, coalesce(score, 0)::DOUBLE AS s, coalesce(num_comments, 0)::DOUBLE AS c FROM posts) x""", "posts")
def _engagement_base(v):
    return E.engagement_base(v.posts).select(
        "post_id", *r6("engagement_ratio"), "controversy_score", *r6("log_score", "log_comments"),
        "engagement_level", "viral_potential")


@query("engagement_post", f"""
SELECT post_id, {_ln1p('coalesce(score, 0)')} AS score_log, {_ln1p('coalesce(num_comments, 0)')} AS num_comments_log,
 coalesce(upvote_ratio, 0.5::DOUBLE) AS upvote_ratio_norm,
 round(num_comments::DOUBLE / nullif(score + 1, 0), 6) AS engagement_ratio,
 round(abs(upvote_ratio - 0.5) * 2, 6) AS controversy_score,
 CAST(num_comments > score * 0.5 AS INT) AS viral_potential, CAST(is_self AS INT) AS is_self_post FROM posts""", "posts")
def _engagement_post(v):
    return E.engagement_post(v.posts).select(
        "post_id", *r6("score_log", "num_comments_log"), "upvote_ratio_norm",
        *r6("engagement_ratio", "controversy_score"), "viral_potential", "is_self_post")


@query("temporal_base", """
SELECT post_id, hour(created_utc) AS hour, isodow(created_utc) - 1 AS day_of_week, day(created_utc) AS day_of_month,
 month(created_utc) AS month, CAST(isodow(created_utc) >= 6 AS INT) AS is_weekend,
 CASE WHEN hour(created_utc) <= 6 THEN 'night' WHEN hour(created_utc) <= 12 THEN 'morning'
  WHEN hour(created_utc) <= 18 THEN 'afternoon' ELSE 'evening' END AS time_of_day,
 CAST(hour(created_utc) BETWEEN 9 AND 17 AS INT) AS is_business_hours FROM posts""", "posts")
def _temporal_base(v):
    return E.temporal_base(v.posts).select(
        "post_id", "hour", "day_of_week", "day_of_month", "month", "is_weekend", "time_of_day", "is_business_hours")


@query("temporal_cyclic", """
SELECT post_id, CAST(hour(created_utc) >= 22 OR hour(created_utc) <= 6 AS INT) AS is_night,
 round(sin(2 * pi() * hour(created_utc) / 24), 6) + 0 AS hour_sin, round(cos(2 * pi() * hour(created_utc) / 24), 6) + 0 AS hour_cos,
 round(sin(2 * pi() * (isodow(created_utc) - 1) / 7), 6) + 0 AS day_sin,
 round(cos(2 * pi() * (isodow(created_utc) - 1) / 7), 6) + 0 AS day_cos FROM posts""", "posts")
def _temporal_cyclic(v):
    # adding 0 turns a rounded -0.0 into 0.0
    cyclic = [(F.round(F.col(n), 6) + 0).alias(n) for n in ("hour_sin", "hour_cos", "day_sin", "day_cos")]
    return E.temporal_cyclic(v.posts).select("post_id", "is_night", *cyclic)


@query("parse_created", """
SELECT post_id, form, CASE form WHEN 'text' THEN date_trunc('second', created_utc)
 WHEN 'epoch' THEN date_trunc('second', created_utc) END AS parsed
FROM posts, unnest(['epoch', 'text', 'broken']) t(form)""", "posts")
def _parse_created(v):
    second = F.date_trunc("second", "created_utc").cast("timestamp_ntz")
    since_epoch = F.datediff(second, F.lit("1970-01-01")).cast("bigint") * 86400 + F.hour(second) * 3600 \
        + F.minute(second) * 60 + F.second(second)
    raw = v.posts.select("post_id", F.explode(F.create_map(
        F.lit("epoch"), since_epoch.cast("string"),
        F.lit("text"), F.date_format(second, "yyyy-MM-dd HH:mm:ss"),
        F.lit("broken"), F.lit("not a time"))).alias("form", "raw"))
    return raw.select("post_id", "form", E.parse_created(F.col("raw")).alias("parsed"))


def polarity_sql(expr, key="post_id", src="posts"):
    """Polarity and subjectivity by joining the words with the lexicon as a table."""
    rows = ", ".join(f"({O.q(w)}, {p}::DOUBLE, {s}::DOUBLE)" for p, s, words in L.POLARITY_GROUPS for w in words)
    return f"""
SELECT p.{key}, coalesce(h.pol, 0.0) AS sentiment_polarity, coalesce(h.sub, 0.0) AS sentiment_subjectivity,
 coalesce(h.n, 0) AS hits
FROM {src} p LEFT JOIN (
 SELECT {key}, avg(pol) AS pol, avg(sub) AS sub, count(*) AS n
 FROM (SELECT {key}, unnest(regexp_extract_all(lower({expr}), {O.q(O.P.WORD + '+')})) AS word FROM {src}) w
 JOIN (VALUES {rows}) l(word, pol, sub) USING (word) GROUP BY {key}) h ON h.{key} = p.{key}"""


POLAR = polarity_sql(O.clean(O.FULL_TEXT))


@query("polarity_score", f"""
SELECT post_id, round(sentiment_polarity, 6) AS sentiment_polarity, round(sentiment_subjectivity, 6) AS sentiment_subjectivity
FROM ({POLAR}) x""", "posts")
def _polarity_score(v):
    return S.polarity_score(v.cleaned).select("post_id", *r6("sentiment_polarity", "sentiment_subjectivity"))


@query("sentiment_derived", f"""
SELECT post_id, round(abs(p), 6) AS sentiment_strength,
 CASE WHEN p > -1 AND p <= -0.1 THEN 'negative' WHEN p > -0.1 AND p <= 0.1 THEN 'neutral'
  WHEN p > 0.1 AND p <= 1 THEN 'positive' END AS sentiment_category, round(1 - s, 6) AS objectivity,
 CAST(abs(p) > 0.5 AND s > 0.5 AS INT) AS strong_opinion, CAST(abs(p) < 0.1 AND s > 0.5 AS INT) AS neutral_subjective
FROM (SELECT post_id, round(sentiment_polarity, 6) AS p, round(sentiment_subjectivity, 6) AS s FROM ({POLAR}) x) y""", "posts")
def _sentiment_derived(v):
    # scores are rounded first so that a bin edge does not hang on the order of a sum
    scored = S.polarity_score(v.cleaned).withColumns({
        n: F.round(n, 6) for n in ("sentiment_polarity", "sentiment_subjectivity")})
    return E.sentiment_derived(scored).select(
        "post_id", *r6("sentiment_strength"), "sentiment_category", *r6("objectivity"), "strong_opinion",
        "neutral_subjective")


@query("heuristic_label", f"""
SELECT post_id, CASE WHEN g > b THEN 2 WHEN b > g THEN 0 ELSE 1 END AS heuristic_label
FROM (SELECT post_id, {O.present('lower(full_text)', L.HEURISTIC_POSITIVE)} AS g,
 {O.present('lower(full_text)', L.HEURISTIC_NEGATIVE)} AS b FROM {TEXTS}) x""", "posts")
def _heuristic_label(v):
    return v.texts.select("post_id", S.heuristic_label(F.col("full_text")).alias("heuristic_label"))


@query("subreddit_label_profile", f"""
SELECT subreddit, label, count(*) AS posts, round(avg(score), 6) AS mean_score, sum(bull)::BIGINT AS bullish_hits
FROM (SELECT subreddit, score, CASE WHEN g > b THEN 'positive' WHEN b > g THEN 'negative' ELSE 'neutral' END AS label, bull
 FROM (SELECT subreddit, score, {O.present('t', L.HEURISTIC_POSITIVE)} AS g, {O.present('t', L.HEURISTIC_NEGATIVE)} AS b,
  {O.present('t', L.BULLISH)} AS bull FROM (SELECT *, {O.clean(O.FULL_TEXT)} AS t FROM posts) s) x) y
GROUP BY subreddit, label""", "posts")
def subreddit_label_profile(v):
    """Posts to cleaned text, keyword counts and heuristic label, rolled up per forum and label."""
    t = F.col("cleaned_text")
    return (
        v.cleaned.select("subreddit", "score", S.label_name(S.heuristic_label(t)).alias("label"),
                         X.present(t, L.BULLISH).alias("bull"))
        .groupBy("subreddit", "label")
        .agg(F.count(F.lit(1)).alias("posts"), F.round(F.avg("score"), 6).alias("mean_score"),
             F.sum("bull").cast("bigint").alias("bullish_hits"))
    )


@query("map_label_names", """
SELECT post_id, a_id AS label_id, CASE a_id WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' WHEN 2 THEN 'positive' END AS label,
 a_id AS back_id FROM annotations""", "annotations")
def _map_label_names(v):
    named = v.annotations.select("post_id", F.col("a_id").alias("label_id"), S.label_name(F.col("a_id")).alias("label"))
    return named.withColumn("back_id", S.label_id(F.col("label")))


# --- column selection ---------------------------------------------------------------


def _with_leaks(v):
    """Labelled posts with a few features, as a training table would look."""
    counted = X.char_class_counts(v.texts).withColumns({"vader_compound": F.lit(0.5), "old_prediction": F.lit("neutral")})
    return counted.join(v.labeled, "post_id")


_LEAK_SRC = f"(SELECT x.*, l.* EXCLUDE (post_id), 0.5::DOUBLE AS vader_compound, 'neutral' AS old_prediction FROM ({COUNTS}) x JOIN labeled l USING (post_id)) s"
_BASE = "post_id, title, content, author, created_utc, score, upvote_ratio, num_comments, subreddit, is_self, full_text, " \
        "text_length, word_count, uppercase_count, lowercase_count, digit_count, space_count, exclamation_count, " \
        "question_count, comma_count, period_count"


@query("drop_leakage_exact", f"SELECT {_BASE}, vader_compound, old_prediction FROM {_LEAK_SRC}", "posts labeled")
def _drop_leakage_exact(v):
    return frames.drop_leakage_exact(_with_leaks(v))


@query("drop_leakage_pattern", f"SELECT {_BASE} FROM {_LEAK_SRC}", "posts labeled")
def _drop_leakage_pattern(v):
    return frames.drop_leakage_pattern(_with_leaks(v))


@query("select_legitimate", f"SELECT post_id, score, upvote_ratio, num_comments, text_length, word_count FROM {_LEAK_SRC}",
       "posts labeled")
def _select_legitimate(v):
    return frames.select_legitimate(_with_leaks(v), ["post_id"])


@query("select_clean_numeric", f"""SELECT post_id, score, upvote_ratio, num_comments, text_length, word_count,
 uppercase_count, lowercase_count, digit_count, space_count, exclamation_count, question_count, comma_count,
 period_count FROM {_LEAK_SRC}""", "posts labeled")
def _select_clean_numeric(v):
    return frames.select_clean_numeric(_with_leaks(v), ["post_id"])


@query("select_production_43", f"""SELECT post_id, score, upvote_ratio, num_comments, text_length, word_count,
 uppercase_count, lowercase_count, digit_count, space_count, exclamation_count, question_count, comma_count,
 period_count FROM {_LEAK_SRC}""", "posts labeled")
def _select_production_43(v):
    return frames.select_production_43(_with_leaks(v), ["post_id"])


@query("feature_summary", """
SELECT feature, dtype, round(100.0 * missing / total, 6) AS missing_pct, unique_values FROM (
 SELECT 'hour' AS feature, 'int' AS dtype, count(*) AS total, count(*) - count(hour(created_utc)) AS missing,
  count(DISTINCT hour(created_utc)) AS unique_values FROM posts
 UNION ALL SELECT 'day_of_week', 'int', count(*), count(*) - count(created_utc), count(DISTINCT isodow(created_utc)) FROM posts
 UNION ALL SELECT 'day_of_month', 'int', count(*), count(*) - count(created_utc), count(DISTINCT day(created_utc)) FROM posts
 UNION ALL SELECT 'is_weekend', 'int', count(*), count(*) - count(created_utc), count(DISTINCT isodow(created_utc) >= 6) FROM posts
 UNION ALL SELECT 'is_business_hours', 'int', count(*), count(*) - count(created_utc), count(DISTINCT hour(created_utc) BETWEEN 9 AND 17) FROM posts
 UNION ALL SELECT 'is_self', 'boolean', count(*), count(*) - count(is_self), count(DISTINCT is_self) FROM posts
 UNION ALL SELECT 'engagement_ratio', 'double', count(*), count(*) - count(r), count(DISTINCT r)
  FROM (SELECT num_comments::DOUBLE / nullif(score + 1, 0) AS r FROM posts) x
 UNION ALL SELECT 'engagement_level', 'string', count(*), 0,
  count(DISTINCT CASE WHEN score <= 0 THEN 1 WHEN score <= 10 THEN 2 WHEN score <= 100 THEN 3 ELSE 4 END) FROM posts
 UNION ALL SELECT 'log_score', 'double', count(*), count(*) - count(r), count(DISTINCT r)
  FROM (SELECT CASE WHEN score > -1 THEN score END AS r FROM posts) x
 UNION ALL SELECT 'log_comments', 'double', count(*), count(*) - count(num_comments), count(DISTINCT num_comments) FROM posts
) y""", "posts")
def _feature_summary(v):
    summary = statistics.feature_summary(E.engagement_base(E.temporal_base(v.posts)))
    return summary.select("feature", "dtype", F.round("missing_pct", 6).alias("missing_pct"), "unique_values")


def _production_sql():
    """The 43 features from the preprocessed text, spelled out column by column."""
    words, ends = O.n_words("t"), O.cnt("t", P.SENTENCE_END)
    vowels = O.cnt("lower(t)", P.VOWEL_GROUP)
    base = f"""SELECT post_id, score, upvote_ratio, num_comments, t, length(t) AS text_length, {words} AS word_count,
 {O.cnt('t', '[A-Z]')} AS uppercase_count, {O.cnt('t', '[a-z]')} AS lowercase_count, {O.cnt('t', P.DIGIT)} AS digit_count,
 {O.cnt('t', P.WS)} AS space_count, {O.cnt('t', '!')} AS exclamation_count, {O.cnt('t', '[?]')} AS question_count,
 {O.cnt('t', ',')} AS comma_count, {O.cnt('t', '[.]')} AS period_count, {vowels} AS y, {ends} AS sentence_count,
 {O.toks('t')} AS w, {O.present('lower(t)', L.BULLISH)} AS bullish_keyword_count,
 {O.present('lower(t)', L.BEARISH)} AS bearish_keyword_count, {O.present('lower(t)', L.UNCERTAINTY)} AS uncertainty_keyword_count,
 {', '.join(f"{O.has('lower(t)', P.whole_word(ws))} AS mentions_{c}" for c, ws in L.COINS_PRODUCTION.items())},
 {O.has('t', P.PRICE)} AS has_price_mention, {O.cnt('t', P.PRICE)} AS price_mention_count, {O.has('t', P.PERCENT)} AS has_percentage
 FROM (SELECT post_id, score, upvote_ratio, num_comments, {PREPROCESSED} AS t FROM {CLEANED}) b"""
    total = "bullish_keyword_count + bearish_keyword_count + uncertainty_keyword_count"
    flesch = "greatest(1, sentence_count)::DOUBLE"
    return f"""
SELECT post_id, score, upvote_ratio, num_comments, text_length, word_count, uppercase_count, lowercase_count, digit_count,
 space_count, exclamation_count, question_count, comma_count, period_count,
 round(uppercase_count::DOUBLE / (text_length + 1), 6) AS uppercase_ratio, round(digit_count::DOUBLE / (text_length + 1), 6) AS digit_ratio,
 round((exclamation_count + question_count)::DOUBLE / (text_length + 1), 6) AS punctuation_ratio,
 CASE WHEN word_count >= 3 THEN round(206.835 - 1.015 * (word_count / {flesch}) - 84.6 * (y::DOUBLE / word_count), 6) ELSE 0 END AS flesch_reading_ease,
 CASE WHEN word_count >= 3 THEN round(0.39 * (word_count / {flesch}) + 11.8 * (y::DOUBLE / word_count) - 15.59, 6) ELSE 0 END AS flesch_kincaid_grade,
 CASE WHEN word_count >= 3 THEN y::INT ELSE 0 END AS syllable_count,
 round(coalesce(len(list_distinct(w))::DOUBLE / nullif(len(w), 0), 0.0), 6) AS lexical_diversity,
 round(coalesce((text_length - space_count)::DOUBLE / nullif(word_count, 0), 0.0), 6) AS avg_word_length, sentence_count,
 round(word_count::DOUBLE / (sentence_count + 1), 6) AS avg_sentence_length, bullish_keyword_count, bearish_keyword_count,
 uncertainty_keyword_count, round(bullish_keyword_count::DOUBLE / (bearish_keyword_count + 1), 6) AS bullish_bearish_ratio,
 {total} AS total_keyword_count, round(({total})::DOUBLE / (word_count + 1), 6) AS keyword_density,
 mentions_btc, mentions_eth, mentions_ada, mentions_sol, mentions_doge,
 mentions_btc + mentions_eth + mentions_ada + mentions_sol + mentions_doge AS total_crypto_mentions,
 has_price_mention, price_mention_count, has_percentage, {_ln1p('coalesce(score, 0)')} AS score_log,
 {_ln1p('coalesce(num_comments, 0)')} AS num_comments_log, coalesce(upvote_ratio, 0.5::DOUBLE) AS upvote_ratio_norm,
 round(num_comments::DOUBLE / nullif(score + 1, 0), 6) AS engagement_ratio, round(abs(upvote_ratio - 0.5) * 2, 6) AS controversy_score
FROM ({base}) f"""


@query("production_features", _production_sql(), "posts")
def _production_features(v):
    """The 43 model features from the served text column."""
    from sentiloom.plans.features import production_features

    made = frames.select_production_43(production_features(v.cleaned.withColumn(
        "preprocessed_text", X.preprocess_text(F.col("cleaned_text")))), ["post_id"])
    return made.withColumns({c: F.round(c, 6) for c, kind in made.dtypes if kind == "double"})


# --- row filters ----------------------------------------------------------------------


@query("confidence_filter", """
SELECT post_id, strict_band, strict_band = 'high' AS complement_is_empty, either_band, two_of_three_band FROM (
 SELECT post_id,
 CASE WHEN label_confidence >= 0.6 AND label_agreement >= 0.67 THEN 'high' ELSE 'low' END AS strict_band,
 CASE WHEN label_confidence >= 0.6 OR label_agreement >= 0.67 THEN 'high' ELSE 'low' END AS either_band,
 CASE WHEN label_confidence >= 0.6 AND label_agreement >= 0.6 THEN 'high' ELSE 'low' END AS two_of_three_band
 FROM labeled) x""", "labeled")
def _confidence_filter(v):
    def band(**limits):
        return F.when(frames.is_high_confidence(**limits), "high").otherwise("low")

    high, low = frames.confidence_filter(v.labeled)
    both = high.withColumn("strict_band", F.lit("high")).union(low.withColumn("strict_band", F.lit("low")))
    return both.select("post_id", "strict_band", (F.col("strict_band") == "high").alias("complement_is_empty"),
                       band(both=False).alias("either_band"), band(min_agreement=0.6).alias("two_of_three_band"))


@query("complement_split", """
SELECT post_id FROM labeled WHERE NOT coalesce(label_confidence >= 0.6 AND label_agreement >= 0.67, false)""", "labeled")
def _complement_split(v):
    return frames.complement_split(v.labeled, frames.is_high_confidence()).select("post_id")


@query("train_row_filter", """
SELECT post_id, auto_label_id FROM labeled WHERE label_confidence >= 0.6 AND label_agreement >= 0.67""", "labeled")
def _train_row_filter(v):
    return frames.train_row_filter(v.labeled).select("post_id", "auto_label_id")


@query("label_slice", "SELECT post_id, label_confidence FROM labeled WHERE auto_label = 'negative'", "labeled")
def _label_slice(v):
    return frames.label_slice(v.labeled, "negative").select("post_id", "label_confidence")


@query("require_columns", "SELECT post_id, subreddit FROM posts", "posts")
def _require_columns(v):
    return frames.require_columns(v.posts, ["post_id", "subreddit"]).select("post_id", "subreddit")


@query("coerce_schema", """
SELECT post_id, CASE WHEN is_self THEN score ELSE 0 END AS score, num_comments FROM posts""", "posts")
def _coerce_schema(v):
    messy = v.posts.withColumns({
        "score": F.when(F.col("is_self"), F.col("score").cast("string")).otherwise("n/a"),
        "num_comments": F.concat(F.col("num_comments").cast("string"), F.lit(".9")),
    })
    return frames.coerce_schema(messy).select("post_id", "score", "num_comments")


@query("validate_requests", """
WITH requests AS (SELECT conv_id, list(text ORDER BY turn) AS texts FROM conversations GROUP BY conv_id
 UNION ALL SELECT -1 - doc_id, [text, CASE WHEN lang = 'en' THEN 'and' ELSE '  ' END] FROM documents)
SELECT conv_id AS request_id, CAST(len(texts) AS INT) AS n_texts, reason IS NULL AS is_valid, reason,
 CAST(list_sum(list_transform(texts, lambda t: length(trim(t, ' ')))) AS BIGINT) AS kept_chars
FROM (SELECT *, CASE WHEN len(texts) <= 0 THEN 'no texts' WHEN len(texts) > 100 THEN 'too many texts'
 WHEN len(list_filter(texts, lambda t: coalesce(trim(t, ' '), '') = '')) > 0 THEN 'blank text'
 WHEN len(list_filter(texts, lambda t: length(t) > 10000)) > 0 THEN 'text too long' END AS reason FROM requests) x""")
def _validate_requests(v):
    chats = v.table("conversations").groupBy(F.col("conv_id").alias("request_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda e: e["text"]).alias("texts"))
    docs = v.table("documents").select(
        (-1 - F.col("doc_id")).alias("request_id"),
        F.array("text", F.when(F.col("lang") == "en", "and").otherwise("  ")).alias("texts"))
    checked = frames.validate_requests(chats.unionByName(docs))
    chars = F.aggregate(F.transform("texts", lambda t: F.length(t).cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return checked.select("request_id", F.size("texts").alias("n_texts"), "is_valid", "reason", chars.alias("kept_chars"))


@query("stream_request_filter", """
SELECT p.post_id, p.subreddit, l.label_confidence AS confidence FROM posts p JOIN labeled l USING (post_id)
WHERE p.subreddit IN ('src0', 'src1', 'src2') AND l.label_confidence >= 0.7
ORDER BY p.created_utc DESC, p.post_id LIMIT 100""", "posts labeled")
def _stream_request_filter(v):
    posts = v.posts.join(v.labeled.select("post_id", F.col("label_confidence").alias("confidence")), "post_id")
    return frames.stream_request_filter(posts, ["src0", "src1", "src2"], 0.7, 100).select("post_id", "subreddit", "confidence")
