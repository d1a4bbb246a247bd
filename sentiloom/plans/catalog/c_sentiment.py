"""Lexicon scores, annotators, vote, serving rules and dictionary joins."""

from pyspark.sql import functions as F

from sentiloom import lexicons as L
from sentiloom.functions import patterns as P
from sentiloom.functions import sentiment as S
from sentiloom.functions import text as X
from sentiloom.operators import joins as J
from sentiloom.plans import oracle as O
from sentiloom.plans.catalog.c_features import POLAR, polarity_sql
from sentiloom.plans.catalog.c_text import CLEANED, TEXTS, _joined, _lemmas, r6
from sentiloom.plans.registry import query
from sentiloom.schemas import LABEL_NAMES


def words_frame(df, text_col):
    """One row per word with its position."""
    return df.select("post_id", F.posexplode_outer(S.words_of(F.col(text_col))).alias("pos", "word")) \
        .filter(F.col("word").isNotNull())


@query("lexicon_join", f"""
SELECT post_id, round(sentiment_polarity, 6) AS sentiment_polarity, round(sentiment_subjectivity, 6) AS sentiment_subjectivity, hits
FROM ({POLAR}) x WHERE hits > 0""", "posts")
def _lexicon_join(v):
    rows = [(w, float(p), float(s)) for p, s, words in L.POLARITY_GROUPS for w in words]
    lexicon = v.spark.createDataFrame(rows, "word string, polarity double, subjectivity double")
    return J.lexicon_join(words_frame(v.cleaned, "cleaned_text"), lexicon).select(
        "post_id", *r6("sentiment_polarity", "sentiment_subjectivity"), "hits")


@query("lemma_join", f"""
SELECT post_id, {_joined(_lemmas(O.toks('cleaned_text')))} AS lemmatized_text FROM {CLEANED}
WHERE cleaned_text <> ''""", "posts")
def _lemma_join(v):
    lemmas = v.spark.createDataFrame(list(L.LEMMAS.items()), "word string, lemma string")
    posts = v.cleaned.select("post_id", X.tokens(F.col("cleaned_text")).alias("words")).filter(F.size("words") > 0)
    return J.lemma_join(posts, "words", lemmas)


_SYN = ", ".join(f"({O.q(w)}, {O.q(s[0])}, {len(s)})" for w, s in L.SYNONYMS.items())


@query("synonym_join", f"""
SELECT post_id, word, first_synonym, count(*) AS n, max(choices)::INT AS choices
FROM (SELECT post_id, unnest(regexp_extract_all(lower(cleaned_text), {O.q(P.WORD + '+')})) AS word FROM {CLEANED}) w
LEFT JOIN (VALUES {_SYN}) y(word, first_synonym, choices) USING (word)
WHERE first_synonym IS NOT NULL GROUP BY post_id, word, first_synonym""", "posts")
def _synonym_join(v):
    table = v.spark.createDataFrame(list(L.SYNONYMS.items()), "word string, synonyms array<string>")
    found = J.synonym_join(words_frame(v.cleaned, "cleaned_text"), table).filter(F.col("synonyms").isNotNull())
    return found.groupBy("post_id", "word", F.col("synonyms")[0].alias("first_synonym")).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("synonyms")).alias("choices"))


def valence_sql(expr, src):
    """Valence rules by joining word positions with the lexicon and looking back with lag."""
    lex = ", ".join(f"({O.q(w)}, {val}::DOUBLE)" for val, words in L.VALENCE_GROUPS for w in words)
    neg = O.in_list(L.NEGATORS)
    return f"""
SELECT post_id, coalesce(total, 0) / sqrt(coalesce(total, 0) * coalesce(total, 0) + {L.VALENCE_ALPHA}) AS compound,
 coalesce(abs(minus) / nullif(mass, 0), 0.0) AS neg, coalesce(flat / nullif(mass, 0), 0.0) AS neu,
 coalesce(plus / nullif(mass, 0), 0.0) AS pos
FROM (SELECT *, plus + abs(minus) + flat AS mass FROM (
 SELECT post_id, sum(val) AS total, coalesce(sum(CASE WHEN val > 0 THEN val + 1 END), 0) AS plus,
  coalesce(sum(CASE WHEN val < 0 THEN val - 1 END), 0) AS minus,
  coalesce(sum(CASE WHEN val = 0 THEN 1 ELSE 0 END), 0)::DOUBLE AS flat
 FROM (SELECT post_id, CASE WHEN base IS NULL THEN 0.0::DOUBLE ELSE
   (base + CASE WHEN w1 IN {O.in_list(L.BOOSTERS)} THEN sign(base) * {L.BOOST_STEP}::DOUBLE ELSE 0 END)
   * CASE WHEN w1 IN {neg} OR w2 IN {neg} OR w3 IN {neg} THEN {L.NEGATION_FACTOR}::DOUBLE ELSE 1 END END AS val, word
  FROM (SELECT t.post_id, t.word, l.base, lag(t.word, 1) OVER o AS w1, lag(t.word, 2) OVER o AS w2, lag(t.word, 3) OVER o AS w3
   FROM (SELECT post_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos
     FROM (SELECT post_id, regexp_extract_all(lower({expr}), {O.q(P.WORD + '+')}) AS ws FROM {src}) a) t
   LEFT JOIN (VALUES {lex}) l(word, base) ON l.word = t.word
   WINDOW o AS (PARTITION BY t.post_id ORDER BY t.pos)) b) c GROUP BY post_id) d) e"""


VALENCE = valence_sql("full_text", TEXTS)


@query("valence_score", f"""
SELECT p.post_id, round(coalesce(compound, 0.0), 6) AS vader_compound, round(coalesce(neg, 0.0), 6) AS vader_neg,
 round(coalesce(neu, 0.0), 6) AS vader_neu, round(coalesce(pos, 0.0), 6) AS vader_pos
FROM posts p LEFT JOIN ({VALENCE}) v USING (post_id)""", "posts")
def _valence_score(v):
    return S.valence_score(v.texts).select("post_id", *r6("vader_compound", "vader_neg", "vader_neu", "vader_pos"))


def annotated(v):
    """Posts with the three annotators; the third one's probabilities are given by a table."""
    third = v.model_probs.filter(F.col("model") == "baseline").select(
        "post_id", *[F.col(f"p_{x}").alias(f"third_{x}") for x in LABEL_NAMES])
    scored = S.valence_score(S.polarity_score(v.cleaned))
    rounded = scored.withColumns({n: F.round(n, 6) for n in (
        "sentiment_polarity", "vader_compound", "vader_neg", "vader_neu", "vader_pos")})
    return S.annotator_labels(rounded.join(third, "post_id"))


_ANNOTATED = f"""
SELECT post_id, cleaned_text, polarity, compound,
 CASE WHEN polarity > 0.1 THEN 'positive' WHEN polarity < -0.1 THEN 'negative' ELSE 'neutral' END AS first,
 CASE WHEN compound >= 0.05 THEN 'positive' WHEN compound <= -0.05 THEN 'negative' ELSE 'neutral' END AS second,
 CASE WHEN p_negative >= p_neutral AND p_negative >= p_positive THEN 'negative' WHEN p_neutral >= p_positive THEN 'neutral'
  ELSE 'positive' END AS third,
 CASE WHEN neg + neu + pos > 0 THEN neg / (neg + neu + pos) ELSE 0 END AS s_negative,
 CASE WHEN neg + neu + pos > 0 THEN neu / (neg + neu + pos) ELSE 1 END AS s_neutral,
 CASE WHEN neg + neu + pos > 0 THEN pos / (neg + neu + pos) ELSE 0 END AS s_positive,
 p_negative, p_neutral, p_positive
FROM (SELECT c.post_id, c.cleaned_text, round(a.sentiment_polarity, 6) AS polarity,
  round(coalesce(b.compound, 0), 6) AS compound, round(coalesce(b.neg, 0), 6) AS neg, round(coalesce(b.neu, 0), 6) AS neu,
  round(coalesce(b.pos, 0), 6) AS pos, m.p_negative, m.p_neutral, m.p_positive
 FROM {CLEANED.rsplit(' ', 1)[0]} c JOIN ({POLAR}) a USING (post_id) LEFT JOIN ({VALENCE}) b USING (post_id)
 JOIN model_probs m ON m.post_id = c.post_id AND m.model = 'baseline') x"""


@query("annotator_labels", f"""
SELECT post_id, first AS textblob_prediction, second AS vader_prediction, third AS finbert_prediction,
 round(abs(polarity), 6) AS textblob_confidence, round(abs(compound), 6) AS vader_confidence,
 round(greatest(p_negative, p_neutral, p_positive), 6) AS finbert_confidence, round(s_negative, 6) AS second_negative,
 round(s_neutral, 6) AS second_neutral, round(s_positive, 6) AS second_positive
FROM ({_ANNOTATED}) a""", "posts model_probs")
def _annotator_labels(v):
    return annotated(v).select(
        "post_id", "textblob_prediction", "vader_prediction", "finbert_prediction",
        *r6("textblob_confidence", "vader_confidence", "finbert_confidence", "second_negative", "second_neutral",
            "second_positive"))


def _score(x):
    return (f"0.2::DOUBLE * CAST(first = '{x}' AS INT) + 0.3::DOUBLE * s_{x} + 0.5::DOUBLE * p_{x} AS score_{x}")


_VOTED = f"""(SELECT *, CASE WHEN score_negative >= score_neutral AND score_negative >= score_positive THEN 'negative'
  WHEN score_neutral >= score_positive THEN 'neutral' ELSE 'positive' END AS auto_label
 FROM (SELECT *, {_score('negative')}, {_score('neutral')}, {_score('positive')} FROM ({_ANNOTATED}) a WHERE cleaned_text <> '') b) c"""


@query("ensemble_label", f"""
SELECT post_id, auto_label, CASE auto_label WHEN 'negative' THEN 0 WHEN 'neutral' THEN 1 ELSE 2 END AS auto_label_id,
 round(greatest(score_negative, score_neutral, score_positive), 8) AS label_confidence,
 round((CAST(first = auto_label AS INT) + CAST(second = auto_label AS INT) + CAST(third = auto_label AS INT)) / 3.0, 8)
  AS label_agreement, round(score_negative, 8) AS score_negative, round(score_neutral, 8) AS score_neutral,
 round(score_positive, 8) AS score_positive
FROM {_VOTED}
UNION ALL SELECT post_id, 'neutral', 1, 0.0, 0.0, 0.0, 1.0, 0.0 FROM ({_ANNOTATED}) a WHERE cleaned_text = ''""",
       "posts model_probs")
def _ensemble_label(v):
    return S.ensemble_label(annotated(v), text_col="cleaned_text").select(
        "post_id", "auto_label", "auto_label_id", *[F.round(c, 8).alias(c) for c in (
            "label_confidence", "label_agreement", "score_negative", "score_neutral", "score_positive")])


@query("label_argmax", """
SELECT post_id, CASE WHEN score_negative >= score_neutral AND score_negative >= score_positive THEN 'negative'
 WHEN score_neutral >= score_positive THEN 'neutral' ELSE 'positive' END AS label FROM votes""", "votes")
def _label_argmax(v):
    return v.votes.select("post_id", S.argmax_label(
        F.col("score_negative"), F.col("score_neutral"), F.col("score_positive")).alias("label"))


def served(v):
    """Posts with one model's probabilities."""
    probs = v.model_probs.filter(F.col("model") == "boosted").select("post_id", "p_negative", "p_neutral", "p_positive")
    return v.texts.join(probs, "post_id")


_SERVED = f"""(SELECT *, CASE WHEN g > b THEN greatest(p_positive, 0.6) ELSE p_positive END AS pos,
 CASE WHEN b > g THEN greatest(p_negative, 0.6) ELSE p_negative END AS neg, p_neutral AS neu
 FROM (SELECT t.post_id, {O.present('lower(t.full_text)', L.STRONG_POSITIVE)} AS g,
  {O.present('lower(t.full_text)', L.STRONG_NEGATIVE)} AS b, m.p_negative, m.p_neutral, m.p_positive
  FROM {TEXTS.rsplit(' ', 1)[0]} t JOIN model_probs m ON m.post_id = t.post_id AND m.model = 'boosted') x) y"""
_DECIDED = f"""(SELECT *, CASE WHEN pos > neg AND pos > neu AND pos > 0.35 THEN 'positive'
 WHEN neg > pos AND neg > neu AND neg > 0.35 THEN 'negative'
 WHEN pos + neg > neu * 1.5 THEN CASE WHEN pos > neg THEN 'positive' ELSE 'negative' END ELSE 'neutral' END AS prediction
 FROM {_SERVED}) z"""
_CONFIDENCE = "CASE prediction WHEN 'positive' THEN pos WHEN 'negative' THEN neg ELSE neu END"


@query("threshold_classifier", f"SELECT post_id, prediction, round({_CONFIDENCE}, 6) AS confidence FROM {_DECIDED}",
       "posts model_probs")
def _threshold_classifier(v):
    return S.threshold_classifier(served(v), "full_text").select("post_id", "prediction", *r6("confidence"))


@query("explain_reason", f"""
SELECT post_id, CASE WHEN c > 0.7 THEN 'high' WHEN c > 0.5 THEN 'medium' ELSE 'low' END AS confidence_level,
 CASE WHEN p_positive >= p_negative AND p_positive >= p_neutral
  THEN 'Text shows positive sentiment (confidence: ' || printf('%.1f', round(p_positive * 100, 1)) || '%)'
  WHEN p_negative >= p_neutral
  THEN 'Text shows negative sentiment (confidence: ' || printf('%.1f', round(p_negative * 100, 1)) || '%)'
  ELSE 'Text is neutral or mixed (confidence: ' || printf('%.1f', round(p_neutral * 100, 1)) || '%)' END AS reason
FROM (SELECT *, {_CONFIDENCE} AS c FROM {_DECIDED}) w""", "posts model_probs")
def _explain_reason(v):
    decided = S.threshold_classifier(served(v), "full_text")
    return S.explain_reason(decided).select("post_id", "confidence_level", "reason")
