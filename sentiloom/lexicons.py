"""Word lists, patterns and thresholds the results depend on."""

# --- fixed values: words kept by the stop-word filter -----------------------
CRYPTO_TERMS = [
    "btc", "bitcoin", "eth", "ethereum", "crypto", "cryptocurrency",
    "blockchain", "defi", "nft", "altcoin", "hodl", "moon", "lambo",
    "satoshi", "wei", "gwei", "dapp", "dao", "ico", "ido", "airdrop",
]
SENTIMENT_WORDS = [
    "not", "no", "never", "nothing", "nowhere", "neither", "nobody",
    "none", "very", "too", "so", "really", "quite", "extremely",
]
# English stop words (the common public list, single words)
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers "
    "herself it its itself they them their theirs themselves what which who whom this that these those am is are "
    "was were be been being have has had having do does did doing a an the and but if or because as until while "
    "of at by for with about against between into through during before after above below to from up down in out "
    "on off over under again further then once here there when where why how all any both each few more most "
    "other some such no nor not only own same so than too very s t can will just don should now d ll m o re ve y "
    "ain aren couldn didn doesn hadn hasn haven isn ma mightn mustn needn shan shouldn wasn weren won wouldn"
).split()
STOP_FILTER = [w for w in STOP_WORDS if w not in SENTIMENT_WORDS and w not in CRYPTO_TERMS]

# --- fixed values: keyword lists of the feature sets -------------------------
BULLISH = [
    "moon", "bullish", "pump", "rally", "surge", "breakout", "gain",
    "profit", "buy", "long", "hodl", "accumulate", "uptrend", "bull",
    "green", "lambo", "rocket", "winning", "success",
]
BEARISH = [
    "crash", "dump", "bearish", "drop", "fall", "loss", "sell",
    "short", "downtrend", "bear", "decline", "plummet", "collapse",
    "red", "rekt", "scam", "rug", "fail",
]
UNCERTAINTY = [
    "maybe", "perhaps", "possibly", "might", "could", "uncertain",
    "doubt", "question", "unclear", "confused", "unsure", "idk",
    "not sure", "dunno",
]
URGENCY = [
    "now", "immediately", "urgent", "quick", "fast", "asap",
    "hurry", "rush", "soon", "today", "breaking", "alert",
]
# the advanced feature set uses the first entries of each list
ADVANCED_SIZES = {"bullish": 14, "bearish": 13, "uncertainty": 11, "urgency": 10}
TRADING_TERMS = ["buy", "sell", "trade", "hold", "hodl", "dip", "ath", "fomo", "fud"]

POSITIVE_EMOJI = ["🚀", "🌙", "💎", "🙌", "💰", "📈", "🔥", "✨", "⭐", "💪", "👍", "😊", "😁", "🎉"]
NEGATIVE_EMOJI = ["📉", "💀", "😢", "😭", "🤡", "⚠️", "❌", "🔻", "👎", "😞", "😔"]
ADVANCED_EMOJI_SIZES = (10, 8)

# --- fixed values: coins by feature set ----------------------------------------
COINS_CLEAN = {
    "btc": ["bitcoin", "btc"], "eth": ["ethereum", "eth"], "ada": ["cardano", "ada"], "sol": ["solana", "sol"],
    "doge": ["dogecoin", "doge"], "xrp": ["ripple", "xrp"], "bnb": ["binance", "bnb"],
}
COINS_PRODUCTION = {k: COINS_CLEAN[k] for k in ("btc", "eth", "ada", "sol", "doge")}
COINS_MENTIONED = {
    "bitcoin": ["bitcoin", "btc"], "ethereum": ["ethereum", "eth"], "cardano": ["cardano", "ada"],
    "solana": ["solana", "sol"], "polkadot": ["polkadot", "dot"], "dogecoin": ["dogecoin", "doge"],
    "ripple": ["ripple", "xrp"],
}

# --- fixed values: keyword rules ------------------------------------------------
HEURISTIC_POSITIVE = [
    "moon", "bullish", "pump", "rally", "surge", "breakout", "gain",
    "profit", "buy", "long", "hodl", "great", "amazing", "excellent",
    "love", "best", "awesome", "fantastic", "incredible",
]
HEURISTIC_NEGATIVE = [
    "crash", "dump", "bearish", "drop", "fall", "loss", "sell", "short",
    "scam", "rug", "fail", "worst", "terrible", "horrible", "disaster",
    "bad", "decline", "plummet", "collapse",
]
STRONG_POSITIVE = [
    "great", "amazing", "excellent", "moon", "bullish", "pump", "rally",
    "surge", "breakout", "gain", "profit", "buy", "long", "hodl", "love",
    "best", "awesome", "fantastic", "incredible", "wonderful",
]
STRONG_NEGATIVE = [
    "crash", "dump", "bearish", "drop", "fall", "loss", "sell", "short",
    "downtrend", "decline", "plummet", "collapse", "scam", "rug", "fail",
    "worst", "terrible", "horrible", "disaster", "bad",
]

# --- fixed values: columns ----------------------------------------------------------
LEAKAGE_EXACT = [
    "label_confidence", "label_agreement", "auto_label", "auto_label_id", "textblob_prediction",
    "vader_prediction", "finbert_prediction", "score_negative", "score_neutral", "score_positive",
]
LEAKAGE_VALENCE = ["vader_compound", "vader_pos", "vader_neg", "vader_neu"]
LEAKAGE_MARKS = ["label", "prediction"]
LEGITIMATE = [
    "score", "upvote_ratio", "num_comments", "is_self",
    "text_length", "word_count", "char_count", "sentence_count", "avg_word_length", "unique_word_count",
    "lexical_diversity", "avg_sentence_length", "text_density", "readability_score",
    "bullish_keyword_count", "bearish_keyword_count", "uncertainty_score", "urgency_score",
    "bullish_bearish_ratio", "flesch_reading_ease", "flesch_kincaid_grade",
    "has_price_mention", "has_percentage_mention", "price_mention_count", "positive_emoji_count",
    "negative_emoji_count", "emoji_sentiment", "mentions_btc", "mentions_eth", "mentions_ada", "mentions_sol",
    "mentions_doge", "total_crypto_mentions", "hashtag_count",
    "hour", "day_of_week", "day_of_month", "month", "is_weekend", "is_business_hours",
    "engagement_ratio", "controversy_score", "log_score", "log_comments", "viral_potential",
]
NOT_CLEAN_FEATURES = [
    "post_id", "title", "content", "author", "subreddit", "url", "permalink", "link_flair_text", "collected_at",
    "full_text", "preprocessed_text", "created_utc", "is_self",
    "auto_label", "auto_label_id", "label_confidence", "label_agreement", "score_negative", "score_neutral",
    "score_positive", "textblob_prediction", "vader_prediction", "finbert_prediction",
    "vader_compound", "vader_pos", "vader_neg", "vader_neu",
]
PRODUCTION_43 = [
    "score", "upvote_ratio", "num_comments", "text_length", "word_count",
    "uppercase_count", "lowercase_count", "digit_count", "space_count",
    "exclamation_count", "question_count", "comma_count", "period_count",
    "uppercase_ratio", "digit_ratio", "punctuation_ratio", "flesch_reading_ease",
    "flesch_kincaid_grade", "syllable_count", "lexical_diversity", "avg_word_length",
    "sentence_count", "avg_sentence_length", "bullish_keyword_count", "bearish_keyword_count",
    "uncertainty_keyword_count", "bullish_bearish_ratio", "total_keyword_count",
    "keyword_density", "mentions_btc", "mentions_eth", "mentions_ada", "mentions_sol",
    "mentions_doge", "total_crypto_mentions", "has_price_mention", "price_mention_count",
    "has_percentage", "score_log", "num_comments_log", "upvote_ratio_norm",
    "engagement_ratio", "controversy_score",
]
SUMMARY_PREFIXES = [
    "hour", "day_", "is_", "engagement_", "log_", "lexical_", "avg_", "sentiment_", "subreddit_", "tfidf_", "topic_",
]

# --- our own small dictionaries (they stand in for external word libraries) --------------
# word groups that share (polarity, subjectivity)
POLARITY_GROUPS = [
    (0.8, 0.8, ["great", "amazing", "excellent", "awesome", "fantastic", "wonderful", "incredible", "best"]),
    (0.5, 0.6, ["good", "love", "bullish", "winning", "success", "happy", "rally", "moon", "profit"]),
    (0.3, 0.4, ["gain", "buy", "up", "surge", "green", "like", "nice", "strong", "breaks", "new"]),
    (-0.3, 0.4, ["drop", "sell", "down", "short", "fall", "weak", "red", "dump", "decline", "fees"]),
    (-0.5, 0.6, ["loss", "bearish", "fail", "crash", "scam", "rug", "bad", "warning", "plummet"]),
    (-0.8, 0.9, ["terrible", "horrible", "worst", "disaster", "awful", "rekt", "collapse"]),
]
# word groups that share a valence, on the usual -4..4 scale
VALENCE_GROUPS = [
    (3.0, ["great", "amazing", "excellent", "awesome", "fantastic", "wonderful", "incredible", "best", "love"]),
    (2.0, ["good", "bullish", "winning", "success", "happy", "profit", "rally", "moon", "strong"]),
    (1.2, ["gain", "buy", "surge", "up", "green", "like", "nice"]),
    (-1.2, ["drop", "sell", "short", "fall", "down", "weak", "decline", "red"]),
    (-2.0, ["loss", "bearish", "fail", "dump", "bad", "warning", "rug", "plummet"]),
    (-3.0, ["terrible", "horrible", "worst", "disaster", "awful", "scam", "crash", "collapse", "rekt"]),
]
NEGATORS = ["not", "no", "never", "nothing", "nowhere", "neither", "nobody", "none", "without", "cannot"]
BOOSTERS = ["very", "too", "so", "really", "quite", "extremely", "totally", "absolutely"]
# published constants of the valence rule set: booster step, negation factor, normaliser
BOOST_STEP, NEGATION_FACTOR, VALENCE_ALPHA = 0.293, -0.74, 15

LEMMAS = {
    "coins": "coin", "prices": "price", "fees": "fee", "gains": "gain", "losses": "loss", "profits": "profit",
    "tokens": "token", "markets": "market", "traders": "trader", "trades": "trade", "bulls": "bull",
    "bears": "bear", "wallets": "wallet", "scams": "scam", "yields": "yield", "rallies": "rally",
    "exchanges": "exchange", "currencies": "currency", "stocks": "stock", "days": "day", "weeks": "week",
    "months": "month", "years": "year", "hours": "hour", "posts": "post", "breaks": "break", "says": "say",
    "men": "man", "women": "woman", "children": "child", "people": "people", "lives": "life", "wives": "wife",
    "words": "word", "lines": "line", "times": "time", "things": "thing", "cities": "city", "stories": "story",
}
SYNONYMS = {
    "rally": ["rise", "surge"], "crash": ["slump", "collapse"], "buy": ["purchase", "acquire"],
    "sell": ["offload", "unload"], "gain": ["profit", "advance"], "loss": ["deficit", "setback"],
    "drop": ["fall", "decline"], "fall": ["drop", "decline"], "scam": ["fraud", "swindle"],
    "moon": ["soar", "skyrocket"], "pump": ["boost", "inflate"], "dump": ["discard", "unload"],
    "weekly": ["hebdomadal", "periodic"], "discussion": ["debate", "talk"], "thread": ["topic", "chain"],
    "terrible": ["awful", "dreadful"], "warning": ["alert", "caution"], "new": ["fresh", "recent"],
    "breaks": ["shatters", "snaps"], "fees": ["charges", "costs"], "soon": ["shortly", "presently"],
    "today": ["nowadays", "now"], "see": ["view", "notice"], "sure": ["certain", "confident"],
    "contact": ["reach", "touch"], "hodl": ["hold", "keep"], "the": ["this", "that"], "and": ["plus", "also"],
    "is": ["equals", "exists"], "of": ["from", "about"],
}
