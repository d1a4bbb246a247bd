"""Text cleaning and counting as column expressions (no Python workers)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentiloom import lexicons as L
from sentiloom.functions import patterns as P
from sentiloom.functions.marks import text_marks

#: Column with all counts of :func:`with_marks`; the counting functions below take them from there if the table has it.
MARKED = "_marks"


def lit_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once per row, however often ``use`` mentions it."""
    return F.transform(F.array(value), use)[0]


def count_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("int")


def has_match(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(pattern), F.lit(False)).cast("int")


def count_char(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def count_marked(text: Column, mark: str, pattern: str) -> Column:
    """Matches of a pattern that always holds ``mark``; texts without it skip the regex."""
    return F.when(F.contains(text, F.lit(mark)), count_matches(text, pattern)).when(text.isNotNull(), 0)


def has_word(text: Column, words: list[str]) -> Column:
    """1 if any of ``words`` stands in ``text`` as a whole word; cheap substring test first."""
    near = F.lit(False)
    for w in words:
        near = near | F.contains(text, F.lit(w))
    return F.coalesce(near & text.rlike(P.whole_word(words)), F.lit(False)).cast("int")


def present(text: Column, words: list[str]) -> Column:
    """How many of ``words`` occur in ``text`` as substrings (each counts once)."""
    total = F.lit(0)
    for word in words:
        total = total + F.contains(text, F.lit(word)).cast("int")
    return F.coalesce(total, F.lit(0))


def tokens(text: Column) -> Column:
    """Words between white space; no empty entries."""
    return F.filter(F.split(text, P.WS + "+"), lambda t: t != "")


def word_count(text: Column) -> Column:
    return count_matches(text, P.NWS + "+")


def squeeze(text: Column) -> Column:
    """White-space runs become one blank, ends trimmed."""
    return F.trim(F.regexp_replace(text, P.WS + "+", " "))


def full_text(title: Column, content: Column) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(content, F.lit("")))


def _where_marked(text: Column, marks: list[str], pattern: str, to: str = "") -> Column:
    """Replace a pattern, but only run the regex on texts that hold one of its fixed characters."""

    def replaced(t: Column) -> Column:
        marked = F.lit(False)
        for mark in marks:
            marked = marked | F.contains(t, F.lit(mark))
        return F.when(marked, F.regexp_replace(t, pattern, to)).otherwise(t)

    return bind(text, replaced)


def _unlinked(text: Column) -> Column:
    """Lower case without links, addresses, names and hash marks; white space is left as it is."""
    out = F.lower(F.coalesce(text, F.lit("")))
    out = _where_marked(out, ["http", "www"], P.URL)
    # starting only at a word's first character keeps the match linear in Java
    out = _where_marked(out, ["@"], f"(?<!{P.NWS})" + P.EMAIL)
    for mark, pattern in (("@", P.AT_NAME), ("u/", P.USER_PATH), ("r/", P.FORUM_PATH)):
        out = _where_marked(out, [mark], pattern)
    return _where_marked(out, ["#"], P.HASHTAG, "$1")


def clean_text(text: Column) -> Column:
    """Lower case without links, addresses, names and hash marks."""
    return squeeze(_unlinked(text))


def strip_special(text: Column, keep_dollar: bool = True) -> Column:
    return F.regexp_replace(text, P.NOT_PLAIN_KEEP_DOLLAR if keep_dollar else P.NOT_PLAIN, "")


def remove_stopwords(text: Column) -> Column:
    kept = F.filter(tokens(text), lambda t: ~F.lower(t).isin(L.STOP_FILTER))
    return F.array_join(kept, " ")


def lemma_of(token: Column) -> Column:
    """Dictionary lookup; the hashed ``isin`` keeps misses off the map."""
    table = F.create_map(*[F.lit(x) for pair in L.LEMMAS.items() for x in pair])
    return F.when(token.isin(list(L.LEMMAS)), F.element_at(table, token)).otherwise(token)


def lemmatize(text: Column) -> Column:
    return F.array_join(F.transform(tokens(text), lemma_of), " ")


def preprocess_text(text: Column, full: bool = True) -> Column:
    """Clean, strip, drop stop words and lemmatise in one token pass; the words are cut at any white space, so it isn't squeezed before."""
    if not full:
        return clean_text(text)
    kept = F.filter(F.split(strip_special(_unlinked(text)), P.WS + "+"), lambda t: ~t.isin(["", *L.STOP_FILTER]))
    return F.array_join(F.transform(kept, lemma_of), " ")


def serving_clean(text: Column) -> Column:
    out = F.regexp_replace(F.lower(text), "http" + P.NWS + "+", "")
    return squeeze(F.regexp_replace(out, P.NOT_WORD_OR_SPACE, " "))


def letters_in_words(text: Column) -> Column:
    """Characters that are not white space."""
    return F.length(F.regexp_replace(text, P.WS + "+", ""))


def mean_word_length(text: Column) -> Column:
    return F.coalesce(F.try_divide(letters_in_words(text).cast("double"), word_count(text).cast("double")), F.lit(0.0))


def distinct_words(text: Column) -> Column:
    return F.size(F.array_distinct(tokens(text)))


def with_marks(df: DataFrame, text_col: str) -> DataFrame:
    """Add the counts of ``text_col`` that several feature functions share, taken in one go over the text."""
    return df.withColumn(MARKED, text_marks(F.col(text_col)))


def _mark(df: DataFrame, name: str, otherwise: Column) -> Column:
    return F.col(f"{MARKED}.{name}") if MARKED in df.columns else otherwise


def text_statistics(df: DataFrame, text_col: str = "cleaned_text") -> DataFrame:
    t = F.col(text_col)
    ends = count_matches(t, P.SENTENCE_END_SPACED)
    return df.withColumns({
        "char_count": F.coalesce(F.length(t), F.lit(0)),
        "word_count": F.coalesce(word_count(t), F.lit(0)),
        "sentence_count": F.when(F.coalesce(t, F.lit("")) == "", 0).otherwise(F.greatest(F.lit(1), ends)),
        "avg_word_length": F.coalesce(mean_word_length(t), F.lit(0.0)),
        "unique_word_count": F.coalesce(distinct_words(t), F.lit(0)),
    })


def char_class_counts(df: DataFrame, text_col: str = "full_text") -> DataFrame:
    t = F.col(text_col)
    return df.withColumns({
        "text_length": F.length(t),
        "word_count": _mark(df, "words", word_count(t)),
        "uppercase_count": _mark(df, "uppercase", count_matches(t, "[A-Z]")),
        "lowercase_count": _mark(df, "lowercase", F.length(F.regexp_replace(t, "[^a-z]+", ""))),
        "digit_count": _mark(df, "digits", count_matches(t, P.DIGIT)),
        "space_count": _mark(df, "spaces", count_matches(t, P.WS)),
        "exclamation_count": _mark(df, "exclamations", count_char(t, "!")),
        "question_count": _mark(df, "questions", count_char(t, "?")),
        "comma_count": _mark(df, "commas", count_char(t, ",")),
        "period_count": _mark(df, "periods", count_char(t, ".")),
    })


def url_mention_hashtag(df: DataFrame, text_col: str = "full_text") -> DataFrame:
    t = F.col(text_col)
    return df.withColumns({
        "has_url": has_match(t, "http|www"),
        "url_count": count_marked(t, "http", "https?://" + P.NWS + "+"),
        "mention_count": count_marked(t, "@", P.AT_NAME),
        "hashtag_count": count_marked(t, "#", "#" + P.WORD + "+"),
    })


def char_ratios(df: DataFrame, commas: bool = True) -> DataFrame:
    """Ratios over length + 1; the clean set counts commas, the production set does not."""
    size = F.col("text_length") + 1
    marks = F.col("exclamation_count") + F.col("question_count")
    if commas:
        marks = marks + F.col("comma_count")
    return df.withColumns({
        "uppercase_ratio": F.col("uppercase_count") / size,
        "digit_ratio": F.col("digit_count") / size,
        "punctuation_ratio": marks / size,
    })


def readability(df: DataFrame, text_col: str = "full_text", min_words: int = 3) -> DataFrame:
    """Flesch scores; a syllable is a vowel group, shorter texts score 0."""
    t = F.lower(F.col(text_col))
    counted = df.withColumns({
        "_words": _mark(df, "words", word_count(t)).cast("double"),
        "_ends": F.greatest(F.lit(1), _mark(df, "ends", count_matches(t, P.SENTENCE_END))).cast("double"),
        "_syllables": _mark(df, "vowel_groups", count_matches(t, P.VOWEL_GROUP)),
    })
    enough = F.coalesce(F.col("_words"), F.lit(0.0)) >= min_words
    per_sentence, per_word = F.col("_words") / F.col("_ends"), F.try_divide(F.col("_syllables").cast("double"), F.col("_words"))
    return counted.withColumns({
        "flesch_reading_ease": F.when(enough, 206.835 - 1.015 * per_sentence - 84.6 * per_word).otherwise(0.0),
        "flesch_kincaid_grade": F.when(enough, 0.39 * per_sentence + 11.8 * per_word - 15.59).otherwise(0.0),
        "syllable_count": F.when(enough, F.col("_syllables")).otherwise(0),
    }).drop("_words", "_ends", "_syllables")


def lexical_diversity(df: DataFrame, text_col: str = "full_text") -> DataFrame:
    words = tokens(F.lower(F.coalesce(F.col(text_col), F.lit(""))))
    share = F.try_divide(F.size(F.array_distinct(words)).cast("double"), F.size(words).cast("double"))
    return df.withColumn("lexical_diversity", F.coalesce(share, F.lit(0.0)))


def avg_word_length(df: DataFrame, text_col: str = "full_text") -> DataFrame:
    t = F.col(text_col)
    mean = mean_word_length(t)
    if MARKED in df.columns:
        letters = F.length(t) - F.col(f"{MARKED}.spaces")
        mean = F.try_divide(letters.cast("double"), F.col(f"{MARKED}.words").cast("double"))
    return df.withColumn("avg_word_length", F.coalesce(mean, F.lit(0.0)))


def _words_in(df: DataFrame, text_col: str) -> Column:
    """The table's word count if it has one, else counted here."""
    return F.col("word_count") if "word_count" in df.columns else word_count(F.col(text_col))


def sentence_features(df: DataFrame, text_col: str = "full_text") -> DataFrame:
    ends = _mark(df, "ends", count_matches(F.col(text_col), P.SENTENCE_END))
    return df.withColumns({
        "sentence_count": ends,
        "avg_sentence_length": _words_in(df, text_col) / (ends + 1),
    })


def keyword_counts(df: DataFrame, text_col: str = "full_text", advanced: bool = False) -> DataFrame:
    t = F.lower(F.col(text_col))
    lists = {"bullish": L.BULLISH, "bearish": L.BEARISH, "uncertainty": L.UNCERTAINTY, "urgency": L.URGENCY}
    if advanced:
        lists = {k: v[:L.ADVANCED_SIZES[k]] for k, v in lists.items()}
        names = {"bullish": "bullish_keyword_count", "bearish": "bearish_keyword_count",
                 "uncertainty": "uncertainty_score", "urgency": "urgency_score"}
    else:
        names = {k: f"{k}_keyword_count" for k in lists}
    return df.withColumns({names[k]: present(t, words) for k, words in lists.items()})


def keyword_ratios(df: DataFrame, text_col: str = "full_text", urgency: bool = True) -> DataFrame:
    total = F.col("bullish_keyword_count") + F.col("bearish_keyword_count") + F.col("uncertainty_keyword_count")
    if urgency:
        total = total + F.col("urgency_keyword_count")
    return df.withColumns({
        "bullish_bearish_ratio": F.col("bullish_keyword_count") / (F.col("bearish_keyword_count") + 1),
        "total_keyword_count": total,
        "keyword_density": total / (_words_in(df, text_col) + 1),
    })


def coin_flags(df: DataFrame, text_col: str = "full_text", coins: dict | None = None) -> DataFrame:
    coins = coins or L.COINS_CLEAN
    t = F.lower(F.col(text_col))
    flags = {f"mentions_{c}": has_word(t, words) for c, words in coins.items()}
    out = df.withColumns(flags)
    return out.withColumn("total_crypto_mentions", sum((F.col(c) for c in flags), F.lit(0)))


def price_percent(df: DataFrame, text_col: str = "full_text", advanced: bool = False) -> DataFrame:
    t = F.col(text_col)
    if advanced:
        return df.withColumns({
            "has_price_mention": has_match(t, P.ADVANCED_PRICE),
            "has_percentage_mention": has_match(t, P.ADVANCED_PERCENT),
            "price_mention_count": count_marked(t, "$", P.ADVANCED_PRICE),
        })
    return df.withColumns({
        "has_price_mention": has_match(t, P.PRICE),
        "price_mention_count": count_marked(t, "$", P.PRICE),
        "has_percentage": has_match(t, P.PERCENT),
        "percentage_mention_count": count_marked(t, "%", P.PERCENT),
    })


def trading_terms(df: DataFrame, text_col: str = "full_text") -> DataFrame:
    return df.withColumn("trading_term_count", present(F.lower(F.col(text_col)), L.TRADING_TERMS))


def emoji_features(df: DataFrame, text_col: str = "full_text", advanced: bool = False) -> DataFrame:
    t = F.col(text_col)
    if advanced:
        good, bad = L.ADVANCED_EMOJI_SIZES
        out = df.withColumns({
            "positive_emoji_count": present(t, L.POSITIVE_EMOJI[:good]),
            "negative_emoji_count": present(t, L.NEGATIVE_EMOJI[:bad]),
        })
        return out.withColumn("emoji_sentiment", F.col("positive_emoji_count") - F.col("negative_emoji_count"))
    out = df.withColumns({
        "positive_emoji_count": present(t, L.POSITIVE_EMOJI),
        "negative_emoji_count": present(t, L.NEGATIVE_EMOJI),
    })
    total = F.col("positive_emoji_count") + F.col("negative_emoji_count")
    return out.withColumns({
        "total_emoji_count": total,
        "emoji_sentiment_score": F.col("positive_emoji_count") - F.col("negative_emoji_count"),
        "has_emoji": (total > 0).cast("int"),
    })


def basic_clean_flags(df: DataFrame, text_col: str = "full_text") -> DataFrame:
    t = F.col(text_col)
    return df.withColumns({
        "text_length": F.length(t),
        "word_count": word_count(t),
        "has_url": has_match(t, "http"),
        "has_emoji": has_match(t, "[😀-🙏]"),
        "exclamation_count": count_char(t, "!"),
        "question_count": count_char(t, "?"),
    })


def _is_one_of(names: list[str]):
    return lambda word: word.isin(names)


def coin_mentions_map(df: DataFrame, text_col: str = "cleaned_text", raw_case: bool = False) -> DataFrame:
    """Add ``crypto_mentions`` (coin -> matched words, plus ``tickers``) and ``has_crypto_mention``.

    ``raw_case`` finds tickers in text that kept its capitals; the table path
    of the reference works on lower-cased text, where no ticker can match.
    """
    text = F.col(text_col)
    every = [n for names in L.COINS_MENTIONED.values() for n in names]
    hits = F.filter(F.split(F.lower(text), P.NWORD + "+"), _is_one_of(every))
    found = F.regexp_extract_all(text if raw_case else F.lower(text), F.lit(P.TICKER), F.lit(1))
    entries = [F.struct(F.lit(coin).alias("k"), F.filter("_hits", _is_one_of(names)).alias("v"))
               for coin, names in L.COINS_MENTIONED.items()]
    entries.append(F.struct(F.lit("tickers").alias("k"), F.col("_tickers").alias("v")))
    mentions = F.map_from_entries(F.filter(F.array(*entries), lambda e: F.size(e["v"]) > 0))
    out = df.withColumns({"_hits": hits, "_tickers": found}).withColumn("crypto_mentions", mentions)
    return out.withColumn("has_crypto_mention", F.size("crypto_mentions") > 0).drop("_hits", "_tickers")
