"""TF-IDF, vocabularies, balancing and votes."""

from pyspark.sql import functions as F

from sentiloom import lexicons as L
from sentiloom.functions import patterns as P
from sentiloom.functions import sentiment as S
from sentiloom.operators import augment as A
from sentiloom.operators import terms as TM
from sentiloom.operators import voting as V
from sentiloom.plans import oracle as O
from sentiloom.plans.catalog.c_text import CLEANED, TEXTS, r6
from sentiloom.plans.registry import query
from sentiloom.session import measured

_WORDS = f"(SELECT post_id, regexp_extract_all(lower(cleaned_text), {O.q(P.TERM)}) AS w FROM {CLEANED})"


def _tfidf(features, sublinear):
    tf = "(1 + ln(tf))" if sublinear else "tf"
    return f"""
WITH g AS (SELECT post_id, unnest(w) AS term FROM {_WORDS} a
  UNION ALL SELECT post_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM {_WORDS} b),
 n AS (SELECT count(*) AS n FROM posts),
 tf AS (SELECT post_id, term, count(*)::DOUBLE AS tf FROM g GROUP BY post_id, term),
 vocab AS (SELECT term, ln((1 + n) / (1 + df)::DOUBLE) + 1 AS idf FROM (SELECT term, sum(tf) AS cf, count(*) AS df FROM tf GROUP BY term) c, n
  WHERE df >= 2 AND df <= 0.95 * n ORDER BY cf DESC, term LIMIT {features}),
 ranked AS (SELECT *, row_number() OVER (ORDER BY term) - 1 AS term_index FROM vocab),
 raw AS (SELECT post_id, term, term_index, {tf} * idf AS raw FROM tf JOIN ranked USING (term))
SELECT post_id, term, term_index, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY post_id)), 6) AS weight FROM raw"""


def _with_cte(sql):
    return sql.strip()


@query("tfidf", _with_cte(_tfidf(100, False)), "posts")
def _tfidf_query(v):
    texts = measured(v.cleaned.select("post_id", "cleaned_text"), "texts")  # joined and cleaned once
    vocabulary = TM.fit_vocabulary(texts, "cleaned_text", 100)
    return TM.tfidf(texts, "cleaned_text", vocabulary).select("post_id", "term", "term_index", *r6("weight"))


@query("tfidf_sublinear", _with_cte(_tfidf(5000, True)), "posts")
def _tfidf_sublinear(v):
    texts = measured(v.cleaned.select("post_id", "cleaned_text"), "texts")  # joined and cleaned once
    vocabulary = TM.fit_vocabulary(texts, "cleaned_text", 5000)
    return TM.tfidf(texts, "cleaned_text", vocabulary, sublinear=True).select("post_id", "term", "term_index", *r6("weight"))


_VOCAB = f"""(SELECT word, count, row_number() OVER (ORDER BY count DESC, word) + 1 AS token_id FROM (
 SELECT word, count(*) AS count FROM (SELECT unnest({O.toks('lower(cleaned_text)')}) AS word FROM {CLEANED}) t GROUP BY word
 ORDER BY count DESC, word LIMIT 9998) c)"""


@query("vocab_count", f"SELECT word, count, token_id FROM {_VOCAB} v", "posts")
def _vocab_count(v):
    return TM.vocab_count(v.cleaned, "cleaned_text")


@query("token_ids", f"""
SELECT post_id, array_to_string(list_concat(coalesce(ids, []), list_transform(range(200 - len(coalesce(ids, []))), lambda i: 0)), ' ') AS token_ids
FROM posts LEFT JOIN (SELECT post_id, list(coalesce(token_id, 1) ORDER BY pos) AS ids FROM (
 SELECT post_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM (SELECT post_id, {O.toks('lower(cleaned_text)')}[1:200] AS ws FROM {CLEANED}) a) b
 LEFT JOIN {_VOCAB} v USING (word) GROUP BY post_id) c USING (post_id)""", "posts")
def _token_ids(v):
    vocabulary = TM.vocab_count(v.cleaned, "cleaned_text")
    ids = TM.token_ids(v.cleaned, "cleaned_text", vocabulary)
    return ids.select("post_id", F.array_join(F.transform("token_ids", lambda x: x.cast("string")), " ").alias("token_ids"))


# --- votes ------------------------------------------------------------------------------
WEIGHTS = {"baseline": 0.2, "boosted": 0.3, "stacked": 0.5}
_W = "CASE model WHEN 'baseline' THEN 0.2::DOUBLE WHEN 'boosted' THEN 0.3 ELSE 0.5 END"


@query("soft_vote", f"""
SELECT post_id, round(a, 6) AS p_negative, round(b, 6) AS p_neutral, round(c, 6) AS p_positive FROM (
SELECT post_id, sum({_W} * p_negative) AS a, sum({_W} * p_neutral) AS b, sum({_W} * p_positive) AS c FROM model_probs GROUP BY post_id) x""",
       "model_probs")
def _soft_vote(v):
    return V.soft_vote(v.model_probs, WEIGHTS).select("post_id", *r6(*V.PROBS))


@query("hard_vote", """
SELECT post_id, label_id::INT AS label_id, votes FROM (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY votes DESC, label_id) AS r
 FROM (SELECT post_id, label_id, count(*) AS votes FROM model_probs GROUP BY post_id, label_id) c) d WHERE r = 1""", "model_probs")
def _hard_vote(v):
    return V.hard_vote(v.model_probs)


@query("model_contributions", """
SELECT post_id, """ + ", ".join(f"round(max(CASE WHEN model = '{m}' THEN {p} END), 6) AS {m}_{p}" for m in WEIGHTS for p in V.PROBS) +
       " FROM model_probs GROUP BY post_id", "model_probs")
def _model_contributions(v):
    return V.model_contributions(v.model_probs, list(WEIGHTS)).select(
        "post_id", *r6(*[f"{m}_{p}" for m in WEIGHTS for p in V.PROBS]))


@query("ensemble_uncertainty", """
SELECT post_id, round(avg(p_negative), 6) AS p_negative, round(avg(p_neutral), 6) AS p_neutral, round(avg(p_positive), 6) AS p_positive,
 round(greatest(stddev_pop(p_negative), stddev_pop(p_neutral), stddev_pop(p_positive)), 6) AS uncertainty FROM model_probs GROUP BY post_id""",
       "model_probs")
def _ensemble_uncertainty(v):
    return V.ensemble_uncertainty(v.model_probs).select("post_id", *r6(*V.PROBS, "uncertainty"))


# --- balancing ------------------------------------------------------------------------------


def skewed(v):
    """Labelled texts with one small class."""
    labels = v.truth.select("post_id", F.col("y_true").alias("auto_label_id"))
    return v.cleaned.select("post_id", "cleaned_text").join(labels, "post_id")


_QUOTA = "(SELECT y_true AS auto_label_id, count, {want} AS quota FROM (SELECT y_true, count(*) AS count, max(count(*)) OVER () AS top FROM truth GROUP BY y_true) c)"


@query("class_quotas", f"""
SELECT a.auto_label_id, a.count, a.quota::BIGINT AS conservative_quota, b.quota::BIGINT AS ratio_quota
FROM {_QUOTA.format(want='least(greatest(0, floor(top * 0.3) - count), 2 * count)')} a
JOIN {_QUOTA.format(want='greatest(0, floor(top * 0.5) - count)')} b USING (auto_label_id)""", "truth")
def _class_quotas(v):
    rows = v.truth.withColumnRenamed("y_true", "auto_label_id")
    a = A.class_quotas(rows, "auto_label_id", A.CONSERVATIVE_SHARE, A.MAX_COPIES).withColumnRenamed("quota", "conservative_quota")
    b = A.class_quotas(rows, "auto_label_id", A.RATIO, None).select("auto_label_id", F.col("quota").alias("ratio_quota"))
    return a.join(b, "auto_label_id")


@query("union_augmented", f"""
SELECT post_id, copy_no, auto_label_id, method FROM (
 SELECT post_id, 0::BIGINT AS copy_no, y_true AS auto_label_id, 'original' AS method FROM truth
 UNION ALL SELECT post_id, unnest(range(1, 1 + greatest(0, ceil((quota - pos) / n))::BIGINT)), y_true, 'copy'
 FROM (SELECT t.*, q.quota, row_number() OVER (PARTITION BY y_true ORDER BY md5('42|' || post_id), post_id) - 1 AS pos,
  count(*) OVER (PARTITION BY y_true)::DOUBLE AS n FROM truth t
  JOIN {_QUOTA.format(want='greatest(0, floor(top * 0.5) - count)')} q ON q.auto_label_id = t.y_true) x) y""", "truth")
def _union_augmented(v):
    rows = v.truth.withColumnRenamed("y_true", "auto_label_id")
    made = A.replicas(rows, "auto_label_id", A.RATIO, None, "post_id", 42).withColumn("augmentation_method", F.lit("copy"))
    both = A.union_augmented(rows.withColumn("copy_no", F.lit(0).cast("long")), made)
    return both.select("post_id", "copy_no", "auto_label_id", F.col("augmentation_method").alias("method"))


def _summary(df, label):
    return df.groupBy(label, "is_augmented", "augmentation_method").agg(F.count(F.lit(1)).alias("count"))


_SYNONYM_WORDS = O.in_list(L.SYNONYMS)


def _balanced(labeled, text, changed):
    """Rows per class, originals and kept copies, for a table expression (post_id, label, text)."""
    return f"""
WITH kept AS ({labeled}), counts AS (SELECT label, count(*) AS count, max(count(*)) OVER () AS top FROM kept GROUP BY label),
 quotas AS (SELECT label, least(greatest(0, floor(top * 0.3) - count), 2 * count) AS quota FROM counts),
 placed AS (SELECT kept.*, quota, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || post_id), post_id) - 1 AS pos,
  count(*) OVER (PARTITION BY label)::DOUBLE AS n FROM kept JOIN quotas USING (label)),
 copies AS (SELECT label, {text}, unnest(range(greatest(0, ceil((quota - pos) / n))::BIGINT)) AS copy_no FROM placed)
SELECT label AS {{name}}, false AS is_augmented, 'original' AS augmentation_method, count(*) AS count FROM kept GROUP BY label
UNION ALL SELECT label, true, 'synonym', count(*) FROM copies WHERE {O.n_words(text)} >= 5 AND {changed} GROUP BY label"""


def _has_synonym(text):
    return f"len(list_filter({O.toks(text)}, lambda t: lower(t) IN {_SYNONYM_WORDS})) > 0"


@query("augment_minority_conservative", _balanced(
    f"SELECT s.post_id, y_true AS label, cleaned_text FROM {CLEANED} JOIN truth USING (post_id)", "cleaned_text",
    _has_synonym("cleaned_text")).replace("{name}", "auto_label_id"), "posts truth")
def _augment_minority_conservative(v):
    return _summary(A.augment_minority_conservative(skewed(v), "cleaned_text"), "auto_label_id")


_COPIES = f"""(SELECT post_id, unnest(range(1, 1 + greatest(0, ceil((quota - pos) / n))::BIGINT)) AS copy_no, auto_label_id
 FROM (SELECT t.post_id, t.y_true AS auto_label_id, q.quota, row_number() OVER (PARTITION BY y_true ORDER BY md5('42|' || post_id), post_id) - 1 AS pos,
  count(*) OVER (PARTITION BY y_true)::DOUBLE AS n FROM truth t
  JOIN {_QUOTA.format(want='greatest(0, floor(top * 0.5) - count)')} q ON q.auto_label_id = t.y_true) x) y"""


@query("augment_minority_ratio", f"""
SELECT y_true AS auto_label_id, false AS is_augmented, 'original' AS augmentation_method, count(*) AS count FROM truth GROUP BY y_true
UNION ALL SELECT auto_label_id, true, (['synonym', 'insertion', 'swap'])[1 + least(2, floor(('0x' || substr(md5('49|' || post_id || '|' || copy_no), 1, 8))::BIGINT::DOUBLE
 / 4294967296 * 3))::BIGINT] AS m, count(*) FROM {_COPIES} GROUP BY auto_label_id, m""", "truth")
def _augment_minority_ratio(v):
    return _summary(A.augment_minority_ratio(skewed(v), "cleaned_text"), "auto_label_id")


_HEX = "('0x' || substr(md5('42|' || post_id || '|' || {i}), 1, 8))::BIGINT::DOUBLE / 4294967296"


@query("random_deletion", f"""
SELECT post_id, CASE WHEN len(w) < 5 OR len(k) < len(w) * 0.8 THEN cleaned_text ELSE array_to_string(k, ' ') END AS edited
FROM (SELECT post_id, cleaned_text, w, list_transform(list_filter(range(1, len(w) + 1), lambda i: {_HEX.format(i='(i - 1)')} > 0.05), lambda i: w[i]) AS k
 FROM (SELECT post_id, cleaned_text, {O.toks('cleaned_text')} AS w FROM {CLEANED}) a) b""", "posts")
def _random_deletion(v):
    return v.cleaned.select("post_id", A.random_deletion(F.col("cleaned_text"), ["post_id"]).alias("edited"))


def _unit(part, seed=42):
    return f"('0x' || substr(md5('{seed}|' || post_id || '|' || {part}), 1, 8))::BIGINT::DOUBLE / 4294967296"


def _place(part, n):
    return f"least(floor({_unit(part)} * ({n})), {n} - 1)::BIGINT"


_SYN = "MAP {" + ", ".join(f"{O.q(w)}: [{', '.join(O.q(x) for x in s)}]" for w, s in L.SYNONYMS.items()) + "}"


def _choice(word, unit):
    return f"list_extract(map_extract_value({_SYN}, lower({word})), 1 + least(floor({unit} * len(map_extract_value({_SYN}, lower({word})))), len(map_extract_value({_SYN}, lower({word}))) - 1)::BIGINT)"


def _swap(w, a, b):
    return f"list_transform(range(len({w})), lambda i: CASE WHEN i = {a} THEN {w}[{b} + 1] WHEN i = {b} THEN {w}[{a} + 1] ELSE {w}[i + 1] END)"


_DELETED = f"""SELECT post_id, CASE WHEN len(w) < 5 OR len(k) < len(w) * 0.8 THEN cleaned_text ELSE array_to_string(k, ' ') END AS deletion
FROM (SELECT post_id, cleaned_text, w, list_transform(list_filter(range(1, len(w) + 1), lambda i: {_HEX.format(i='(i - 1)')} > 0.05), lambda i: w[i]) AS k FROM base) b"""


@query("text_edits", f"""
WITH base AS (SELECT post_id, cleaned_text, {O.toks('cleaned_text')} AS w FROM {CLEANED}),
 spots AS (SELECT *, list_sort(list_transform(list_filter(range(len(w)), lambda i: lower(w[i + 1]) IN {_SYNONYM_WORDS}),
  lambda i: {{'h': md5('42|' || post_id || '|' || i), 'i': i}}))[1].i AS spot,
  {_place("'word'", 'len(w)')} AS src, {_place("'place'", '(len(w) + 1)')} AS slot, {_place("'a0'", 'len(w)')} AS a0, {_place("'a1'", 'len(w)')} AS a1,
  1 + {_place("'b0'", '(len(w) - 1)')} AS s0, 1 + {_place("'b1'", '(len(w) - 1)')} AS s1 FROM base),
 picked AS (SELECT *, {_choice('w[spot + 1]', _unit('spot', 43))} AS other, {_choice('w[src + 1]', _unit("'synonym'"))} AS extra,
  {_swap('w', 'a0', '((a0 + s0) % greatest(len(w), 1))')} AS once FROM spots),
 gone AS ({_DELETED})
SELECT post_id, CASE WHEN len(w) < 5 THEN cleaned_text ELSE array_to_string(list_transform(range(len(w)), lambda i: CASE WHEN i = spot THEN other ELSE w[i + 1] END), ' ') END AS synonym,
 CASE WHEN len(w) < 3 OR extra IS NULL THEN cleaned_text ELSE array_to_string(list_concat(list_slice(w, 1, slot), [extra], list_slice(w, slot + 1, len(w))), ' ') END AS insertion,
 CASE WHEN len(w) < 3 THEN cleaned_text ELSE array_to_string({_swap('once', 'a1', '((a1 + s1) % greatest(len(w), 1))')}, ' ') END AS swap, deletion
FROM picked JOIN gone USING (post_id)""", "posts")
def _text_edits(v):
    t, key, words = F.col("cleaned_text"), ["post_id"], F.col("_words")
    return v.cleaned.select("post_id", "cleaned_text").withColumn("_words", A.words_of(t)).select(
        "post_id", A.synonym_replacement(t, key, words=words).alias("synonym"), A.random_insertion(t, key, words=words).alias("insertion"),
        A.random_swap(t, key, words=words).alias("swap"), A.random_deletion(t, key, words=words).alias("deletion"))


def _half(words, who):
    return f"""list_slice(list_sort(list_transform({words}, lambda x, i: {{'h': md5('42|' || post_id || '|{who}|' || (i - 1)), 'w': x}})),
 1, floor(len({words}) * 0.5)::BIGINT)"""


@query("text_mixup", f"""
WITH texts AS (SELECT s.post_id, y_true AS label, {O.toks('cleaned_text')} AS w FROM {CLEANED} JOIN truth USING (post_id)),
 placed AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || post_id), post_id) - 1 AS pos, count(*) OVER (PARTITION BY label) AS n FROM texts),
 pairs AS (SELECT a.post_id, b.post_id AS partner_id, a.label, a.w AS wa, b.w AS wb FROM placed a JOIN placed b
  ON a.label = b.label AND a.pos = (b.pos - 1 + b.n) % b.n)
SELECT post_id, partner_id, label AS auto_label_id, array_to_string(list_transform(list_sort(list_transform(
 list_concat({_half('wa', 'a')}, {_half('wb', 'b')}), lambda e: {{'h': md5(e.h), 'w': e.w}})), lambda e: e.w), ' ') AS mixed_text FROM pairs""",
       "posts truth")
def _text_mixup(v):
    return A.text_mixup(skewed(v), "cleaned_text", "auto_label_id")


@query("smart_balance", _balanced(f"""
 SELECT post_id, full_text, CASE WHEN g > b THEN 'positive' WHEN b > g THEN 'negative' ELSE 'neutral' END AS label
 FROM (SELECT post_id, full_text, {O.present('lower(full_text)', L.HEURISTIC_POSITIVE)} AS g,
  {O.present('lower(full_text)', L.HEURISTIC_NEGATIVE)} AS b FROM {TEXTS} WHERE length(full_text) > 50) h""", "full_text",
    f"({_has_synonym('full_text')} OR array_to_string({O.toks('full_text')}, ' ') <> full_text)").replace("{name}", "auto_label"), "posts")
def _smart_balance(v):
    return _summary(A.smart_balance(v.posts.select("post_id", "title", "content")), "auto_label")
