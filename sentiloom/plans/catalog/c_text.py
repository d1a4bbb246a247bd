"""Text cleaning and text features."""

from pyspark.sql import functions as F

from sentiloom import lexicons as L
from sentiloom.functions import patterns as P
from sentiloom.functions import text as X
from sentiloom.operators import frames
from sentiloom.plans import oracle as O
from sentiloom.plans.registry import query

TEXTS = f"(SELECT *, {O.FULL_TEXT} AS full_text FROM posts) s"
CLEANED = f"(SELECT *, {O.clean(O.FULL_TEXT)} AS cleaned_text FROM posts) s"


def r6(*names):
    return [F.round(F.col(n), 6).alias(n) for n in names]


@query("full_text", f"SELECT post_id, {O.FULL_TEXT} AS full_text FROM posts", "posts")
def _full_text(v):
    return v.texts.select("post_id", "full_text")


@query("clean_text", f"SELECT post_id, {O.clean(O.FULL_TEXT)} AS cleaned_text FROM posts", "posts")
def _clean_text(v):
    return v.cleaned.select("post_id", "cleaned_text")


@query("strip_special", f"""
SELECT post_id, {O.sub('full_text', P.NOT_PLAIN_KEEP_DOLLAR, '')} AS with_dollar,
 {O.sub('full_text', P.NOT_PLAIN, '')} AS without_dollar FROM {TEXTS}""", "posts")
def _strip_special(v):
    t = F.col("full_text")
    return v.texts.select("post_id", X.strip_special(t).alias("with_dollar"),
                          X.strip_special(t, False).alias("without_dollar"))


def _kept(expr):
    return f"list_filter({O.toks(expr)}, lambda t: lower(t) NOT IN {O.in_list(L.STOP_FILTER)})"


def _lemmas(expr):
    cases = " ".join(f"WHEN {O.q(k)} THEN {O.q(w)}" for k, w in L.LEMMAS.items())
    return f"list_transform({expr}, lambda t: CASE t {cases} ELSE t END)"


def _joined(expr):
    return f"array_to_string({expr}, ' ')"


PREPROCESSED = _joined(_lemmas(_kept(O.sub(O.clean("cleaned_text"), P.NOT_PLAIN_KEEP_DOLLAR, ""))))


@query("remove_stopwords", f"SELECT post_id, {_joined(_kept('cleaned_text'))} AS kept_text FROM {CLEANED}", "posts")
def _remove_stopwords(v):
    return v.cleaned.select("post_id", X.remove_stopwords(F.col("cleaned_text")).alias("kept_text"))


@query("preprocess_text", f"SELECT post_id, {PREPROCESSED} AS preprocessed_text FROM {CLEANED}", "posts")
def _preprocess_text(v):
    # the table path cleans text that is already clean
    return v.cleaned.select("post_id", X.preprocess_text(F.col("cleaned_text")).alias("preprocessed_text"))


@query("serving_clean", f"""
SELECT post_id, {O.squeeze(O.sub(O.sub('lower(full_text)', 'http' + P.NWS + '+', ''), P.NOT_WORD_OR_SPACE, ' '))}
 AS serving_text FROM {TEXTS}""", "posts")
def _serving_clean(v):
    return v.texts.select("post_id", X.serving_clean(F.col("full_text")).alias("serving_text"))


def _mean_word(t):
    return f"coalesce(length({O.sub(t, P.WS + '+', '')})::DOUBLE / nullif({O.n_words(t)}, 0), 0.0)"


STATS = f"""SELECT *, length(cleaned_text) AS char_count, {O.n_words('cleaned_text')} AS word_count,
 CASE WHEN cleaned_text = '' THEN 0 ELSE greatest(1, {O.cnt('cleaned_text', P.SENTENCE_END_SPACED)}) END
  AS sentence_count, {_mean_word('cleaned_text')} AS avg_word_length,
 len(list_distinct({O.toks('cleaned_text')})) AS unique_word_count FROM {CLEANED}"""


@query("text_statistics", f"""
SELECT post_id, char_count, word_count, sentence_count, round(avg_word_length, 6) AS avg_word_length,
 unique_word_count FROM ({STATS}) x""", "posts")
def _text_statistics(v):
    return X.text_statistics(v.cleaned).select(
        "post_id", "char_count", "word_count", "sentence_count", *r6("avg_word_length"), "unique_word_count")


COUNTS = f"""SELECT *, length(full_text) AS text_length, {O.n_words('full_text')} AS word_count,
 {O.cnt('full_text', '[A-Z]')} AS uppercase_count, {O.cnt('full_text', '[a-z]')} AS lowercase_count,
 {O.cnt('full_text', P.DIGIT)} AS digit_count, {O.cnt('full_text', P.WS)} AS space_count,
 {O.cnt('full_text', '!')} AS exclamation_count, {O.cnt('full_text', '[?]')} AS question_count,
 {O.cnt('full_text', ',')} AS comma_count, {O.cnt('full_text', '[.]')} AS period_count FROM {TEXTS}"""
_COUNT_COLS = ["text_length", "word_count", "uppercase_count", "lowercase_count", "digit_count", "space_count",
               "exclamation_count", "question_count", "comma_count", "period_count"]


@query("char_class_counts", f"SELECT post_id, {', '.join(_COUNT_COLS)} FROM ({COUNTS}) x", "posts")
def _char_class_counts(v):
    return X.char_class_counts(v.texts).select("post_id", *_COUNT_COLS)


@query("url_mention_hashtag", f"""
SELECT post_id, {O.has('full_text', 'http|www')} AS has_url, {O.cnt('full_text', 'https?://' + P.NWS + '+')} AS url_count,
 {O.cnt('full_text', P.AT_NAME)} AS mention_count, {O.cnt('full_text', '#' + P.WORD + '+')} AS hashtag_count
FROM {TEXTS}""", "posts")
def _url_mention_hashtag(v):
    return X.url_mention_hashtag(v.texts).select("post_id", "has_url", "url_count", "mention_count", "hashtag_count")


@query("char_ratios", f"""
SELECT post_id, {O.r6('uppercase_count::DOUBLE / (text_length + 1)', 'uppercase_ratio')},
 {O.r6('digit_count::DOUBLE / (text_length + 1)', 'digit_ratio')},
 {O.r6('(exclamation_count + question_count + comma_count)::DOUBLE / (text_length + 1)', 'punctuation_ratio')},
 {O.r6('(exclamation_count + question_count)::DOUBLE / (text_length + 1)', 'production_punctuation_ratio')}
FROM ({COUNTS}) x""", "posts")
def _char_ratios(v):
    counted = X.char_class_counts(v.texts)
    plain = X.char_ratios(counted, commas=False).withColumnRenamed("punctuation_ratio", "production_punctuation_ratio")
    return X.char_ratios(plain).select("post_id", *r6(
        "uppercase_ratio", "digit_ratio", "punctuation_ratio", "production_punctuation_ratio"))


def _flesch(min_words, prefix=""):
    return f"""
 CASE WHEN w >= {min_words} THEN round(206.835 - 1.015 * (w / s) - 84.6 * (y / w), 6) ELSE 0.0 END AS {prefix}flesch_reading_ease,
 CASE WHEN w >= {min_words} THEN round(0.39 * (w / s) + 11.8 * (y / w) - 15.59, 6) ELSE 0.0 END AS {prefix}flesch_kincaid_grade"""


@query("readability", f"""
SELECT post_id, {_flesch(3)}, CASE WHEN w >= 3 THEN y::INT ELSE 0 END AS syllable_count, {_flesch(6, 'advanced_')}
FROM (SELECT post_id, {O.n_words('full_text')}::DOUBLE AS w,
 greatest(1, {O.cnt('full_text', P.SENTENCE_END)})::DOUBLE AS s,
 {O.cnt('lower(full_text)', P.VOWEL_GROUP)}::DOUBLE AS y FROM {TEXTS}) x""", "posts")
def _readability(v):
    strict = X.readability(v.texts, min_words=6).drop("syllable_count").withColumnsRenamed({
        "flesch_reading_ease": "advanced_flesch_reading_ease", "flesch_kincaid_grade": "advanced_flesch_kincaid_grade"})
    return X.readability(strict).select("post_id", "syllable_count", *r6(
        "flesch_reading_ease", "flesch_kincaid_grade", "advanced_flesch_reading_ease", "advanced_flesch_kincaid_grade"))


@query("lexical_diversity", f"""
SELECT post_id, round(coalesce(len(list_distinct(t))::DOUBLE / nullif(len(t), 0), 0.0), 6) AS lexical_diversity
FROM (SELECT post_id, {O.toks('lower(full_text)')} AS t FROM {TEXTS}) x""", "posts")
def _lexical_diversity(v):
    return X.lexical_diversity(v.texts).select("post_id", *r6("lexical_diversity"))


@query("avg_word_length", f"SELECT post_id, round({_mean_word('full_text')}, 6) AS avg_word_length FROM {TEXTS}", "posts")
def _avg_word_length(v):
    return X.avg_word_length(v.texts).select("post_id", *r6("avg_word_length"))


@query("sentence_features", f"""
SELECT post_id, {O.cnt('full_text', P.SENTENCE_END)} AS sentence_count,
 round({O.n_words('full_text')}::DOUBLE / ({O.cnt('full_text', P.SENTENCE_END)} + 1), 6) AS avg_sentence_length
FROM {TEXTS}""", "posts")
def _sentence_features(v):
    return X.sentence_features(v.texts).select("post_id", "sentence_count", *r6("avg_sentence_length"))


def _keywords(advanced=False):
    lists = {"bullish": L.BULLISH, "bearish": L.BEARISH, "uncertainty": L.UNCERTAINTY, "urgency": L.URGENCY}
    if advanced:
        return {f"advanced_{k}": O.present("t", w[:L.ADVANCED_SIZES[k]]) for k, w in lists.items()}
    return {f"{k}_keyword_count": O.present("t", w) for k, w in lists.items()}


KEYWORDS = "SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in {**_keywords(), **_keywords(True)}.items()) + \
    f" FROM (SELECT *, lower(full_text) AS t FROM {TEXTS}) k"


@query("keyword_counts", f"SELECT post_id, {', '.join([*_keywords(), *_keywords(True)])} FROM ({KEYWORDS}) x", "posts")
def _keyword_counts(v):
    advanced = X.keyword_counts(v.texts, advanced=True).withColumnsRenamed({
        "bullish_keyword_count": "advanced_bullish", "bearish_keyword_count": "advanced_bearish",
        "uncertainty_score": "advanced_uncertainty", "urgency_score": "advanced_urgency"})
    return X.keyword_counts(advanced).select("post_id", *_keywords(), *_keywords(True))


@query("keyword_ratios", f"""
SELECT post_id, {O.r6('bullish_keyword_count::DOUBLE / (bearish_keyword_count + 1)', 'bullish_bearish_ratio')},
 bullish_keyword_count + bearish_keyword_count + uncertainty_keyword_count + urgency_keyword_count AS total_keyword_count,
 round((bullish_keyword_count + bearish_keyword_count + uncertainty_keyword_count + urgency_keyword_count)::DOUBLE
  / ({O.n_words('full_text')} + 1), 6) AS keyword_density,
 bullish_keyword_count + bearish_keyword_count + uncertainty_keyword_count AS production_total
FROM ({KEYWORDS}) x""", "posts")
def _keyword_ratios(v):
    counted = X.keyword_counts(v.texts)
    short = X.keyword_ratios(counted, urgency=False).withColumnRenamed("total_keyword_count", "production_total")
    return X.keyword_ratios(short).select(
        "post_id", "total_keyword_count", "production_total", *r6("bullish_bearish_ratio", "keyword_density"))


def _flags(coins):
    return {f"mentions_{c}": O.has("lower(full_text)", P.whole_word(w)) for c, w in coins.items()}


_FLAGS = _flags(L.COINS_CLEAN)


@query("coin_flags", f"""
SELECT post_id, {', '.join(f'{e} AS {n}' for n, e in _FLAGS.items())}, {' + '.join(_FLAGS.values())} AS total_crypto_mentions,
 {' + '.join(_flags(L.COINS_PRODUCTION).values())} AS production_total FROM {TEXTS}""", "posts")
def _coin_flags(v):
    short = X.coin_flags(v.texts, coins=L.COINS_PRODUCTION).withColumnRenamed("total_crypto_mentions", "production_total")
    return X.coin_flags(short).select("post_id", *_FLAGS, "total_crypto_mentions", "production_total")


@query("price_percent", f"""
SELECT post_id, {O.has('full_text', P.PRICE)} AS has_price_mention, {O.cnt('full_text', P.PRICE)} AS price_mention_count,
 {O.has('full_text', P.PERCENT)} AS has_percentage, {O.cnt('full_text', P.PERCENT)} AS percentage_mention_count,
 {O.has('full_text', P.ADVANCED_PERCENT)} AS has_percentage_mention,
 {O.cnt('full_text', P.ADVANCED_PRICE)} AS advanced_price_count FROM {TEXTS}""", "posts")
def _price_percent(v):
    advanced = X.price_percent(v.texts, advanced=True).withColumnRenamed("price_mention_count", "advanced_price_count")
    return X.price_percent(advanced).select(
        "post_id", "has_price_mention", "price_mention_count", "has_percentage", "percentage_mention_count",
        "has_percentage_mention", "advanced_price_count")


@query("trading_terms", f"SELECT post_id, {O.present('lower(full_text)', L.TRADING_TERMS)} AS trading_term_count FROM {TEXTS}",
       "posts")
def _trading_terms(v):
    return X.trading_terms(v.texts).select("post_id", "trading_term_count")


_GOOD, _BAD = O.present("full_text", L.POSITIVE_EMOJI), O.present("full_text", L.NEGATIVE_EMOJI)
_AGOOD = O.present("full_text", L.POSITIVE_EMOJI[:L.ADVANCED_EMOJI_SIZES[0]])
_ABAD = O.present("full_text", L.NEGATIVE_EMOJI[:L.ADVANCED_EMOJI_SIZES[1]])


@query("emoji_features", f"""
SELECT post_id, {_GOOD} AS positive_emoji_count, {_BAD} AS negative_emoji_count, {_GOOD} + {_BAD} AS total_emoji_count,
 {_GOOD} - {_BAD} AS emoji_sentiment_score, CAST({_GOOD} + {_BAD} > 0 AS INT) AS has_emoji,
 {_AGOOD} - {_ABAD} AS emoji_sentiment FROM {TEXTS}""", "posts")
def _emoji_features(v):
    return X.emoji_features(X.emoji_features(v.texts, advanced=True)).select(
        "post_id", "positive_emoji_count", "negative_emoji_count", "total_emoji_count", "emoji_sentiment_score",
        "has_emoji", "emoji_sentiment")


@query("basic_clean_flags", f"""
SELECT post_id, length(full_text) AS text_length, {O.n_words('full_text')} AS word_count,
 {O.has('full_text', 'http')} AS has_url, {O.has('full_text', '[😀-🙏]')} AS has_emoji,
 {O.cnt('full_text', '!')} AS exclamation_count, {O.cnt('full_text', '[?]')} AS question_count FROM {TEXTS}""", "posts")
def _basic_clean_flags(v):
    return X.basic_clean_flags(v.texts).select(
        "post_id", "text_length", "word_count", "has_url", "has_emoji", "exclamation_count", "question_count")


def _mention_rows(expr, raw):
    words = f"string_split_regex(lower({expr}), {O.q(P.NWORD + '+')})"
    rows = [f"SELECT post_id, {O.q(c)} AS coin, array_to_string(list_filter({words}, lambda w: w IN {O.in_list(n)}), ',') AS found FROM {{src}}"
            for c, n in L.COINS_MENTIONED.items()]
    searched = expr if raw else f"lower({expr})"
    rows.append(f"SELECT post_id, 'tickers', array_to_string(regexp_extract_all({searched}, {O.q(P.TICKER)}, 1), ',') FROM {{src}}")
    return " UNION ALL ".join(rows)


@query("coin_mentions_map", f"""
SELECT post_id, coin, found, CAST(1 AS INT) AS has_crypto_mention
FROM ({_mention_rows('cleaned_text', False).replace('{src}', CLEANED)}) m WHERE found <> ''
UNION ALL
SELECT post_id, 'raw_' || coin, found, CAST(1 AS INT)
FROM ({_mention_rows('full_text', True).replace('{src}', TEXTS)}) m WHERE found <> ''""", "posts")
def _coin_mentions_map(v):
    plain = X.coin_mentions_map(v.cleaned).withColumn("prefix", F.lit(""))
    raw = X.coin_mentions_map(v.texts, "full_text", raw_case=True).withColumn("prefix", F.lit("raw_"))
    wanted = ["post_id", "prefix", F.col("has_crypto_mention").cast("int").alias("has_crypto_mention"),
              F.explode_outer("crypto_mentions").alias("coin", "words")]
    # explode() would add a size filter below the text cleaning and so run it twice
    return plain.select(*wanted).union(raw.select(*wanted)).filter(F.col("coin").isNotNull()).select(
        "post_id", F.concat("prefix", "coin").alias("coin"), F.array_join("words", ",").alias("found"),
        "has_crypto_mention")


@query("min_length_filter", f"SELECT post_id, length(full_text) AS text_length FROM {TEXTS} WHERE length(full_text) > 50", "posts")
def _min_length_filter(v):
    return frames.min_length_filter(v.texts).select("post_id", F.length("full_text").alias("text_length"))


@query("text_complexity", f"""
SELECT post_id, round(unique_word_count::DOUBLE / (word_count + 1), 6) AS lexical_diversity,
 round(word_count::DOUBLE / (sentence_count + 1), 6) AS avg_sentence_length,
 round(char_count::DOUBLE / (word_count + 1), 6) AS text_density,
 round(206.835 - 1.015 * (word_count::DOUBLE / (sentence_count + 1)) - 84.6 * avg_word_length, 6) AS readability_score,
 CASE WHEN word_count <= 0 THEN NULL WHEN word_count <= 50 THEN 'very_short' WHEN word_count <= 150 THEN 'short'
  WHEN word_count <= 300 THEN 'medium' ELSE 'long' END AS complexity_level FROM ({STATS}) x""", "posts")
def _text_complexity(v):
    from sentiloom.functions.engagement import text_complexity

    return text_complexity(X.text_statistics(v.cleaned)).select(
        "post_id", *r6("lexical_diversity", "avg_sentence_length", "text_density", "readability_score"), "complexity_level")
