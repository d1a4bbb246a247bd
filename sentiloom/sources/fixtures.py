"""Post, prediction and annotation views over the given tables.

The same SQL text runs in Spark and in DuckDB; only three spellings differ.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_DIALECT = {
    "spark": {"STR": "STRING", "K": "get_json_object(e.props,'$.k')", "MICROS": "timestamp_micros",
              "MODELS": "LATERAL VIEW explode(array(0,1,2)) t AS m"},
    "duckdb": {"STR": "VARCHAR", "K": "json_extract_string(e.props,'$.k')", "MICROS": "make_timestamp",
               "MODELS": ", unnest([0,1,2]) t(m)"},
}

# view -> (views it reads, SQL)
_SQL: dict[str, tuple[list[str], str]] = {}

_SQL["posts"] = ([], """
SELECT CAST(d.doc_id AS <STR>) AS post_id,
 CASE d.doc_id % 8
  WHEN 0 THEN 'Bitcoin rally! BTC breaks $125,000, up 12% 🚀💎 #crypto'
  WHEN 1 THEN 'ETH gas fees crash again?? see https://example.com/gas @vitalik'
  WHEN 2 THEN 'Maybe not sure about $SOL, could dump or pump soon'
  WHEN 3 THEN 'Warning: new scam and rug alert, contact me@mail.example now'
  WHEN 4 THEN 'Hodl and buy the dip, says u/satoshi in r/defi 📈'
  WHEN 5 THEN 'Terrible loss today 😭 ADA and doge fall 3.5%'
  WHEN 6 THEN NULL
  ELSE 'Weekly discussion thread' END AS title,
 CASE WHEN d.doc_id % 37 = 36 THEN NULL ELSE d.text END AS content,
 CASE WHEN d.doc_id % 23 = 22 THEN '[deleted]' ELSE concat('user', CAST(e.user_id AS <STR>)) END AS author,
 e.ts AS created_utc,
 CAST(floor(e.value) AS BIGINT) - 20 AS score,
 CASE WHEN d.doc_id % 29 = 28 THEN NULL ELSE CAST((d.doc_id * 7) % 101 AS DOUBLE) / 100e0 END AS upvote_ratio,
 CAST(<K> AS BIGINT) AS num_comments,
 d.source AS subreddit,
 (d.doc_id % 2 = 0) AS is_self
FROM documents d JOIN events e ON e.event_id = d.doc_id""")

_SQL["predictions"] = ([], """
SELECT e.event_id AS prediction_id,
 CASE WHEN e.event_id % 97 = 96 THEN concat('missing-', CAST(e.event_id AS <STR>))
      ELSE CAST(e.event_id % 150 AS <STR>) END AS post_id,
 CASE WHEN e.user_id % 2 = 0 THEN 'logreg' ELSE 'gbt' END AS model_name,
 CASE e.event_type WHEN 'purchase' THEN 'positive' WHEN 'signup' THEN 'positive'
                   WHEN 'error' THEN 'negative' ELSE 'neutral' END AS sentiment_label,
 CAST((e.event_id * 13) % 101 AS DOUBLE) / 100e0 AS confidence_score,
 e.value AS response_time_ms,
 (e.event_type <> 'error') AS success,
 concat('key', CAST(e.user_id % 5 AS <STR>)) AS api_key,
 e.ts AS predicted_at
FROM events e""")

_SQL["annotations"] = ([], """
SELECT CAST(doc_id AS <STR>) AS post_id, doc_id % 3 AS a_id,
 CASE WHEN doc_id % 5 = 0 THEN (doc_id + 1) % 3 ELSE doc_id % 3 END AS b_id,
 CASE WHEN doc_id % 7 = 0 THEN (doc_id + 2) % 3 ELSE doc_id % 3 END AS c_id,
 CAST((doc_id * 31) % 101 AS DOUBLE) / 100e0 AS label_confidence
FROM documents""")

_SQL["truth"] = ([], """
SELECT CAST(doc_id AS <STR>) AS post_id,
 CASE WHEN toxic = 1 THEN 0 WHEN quality = 1 THEN 2 ELSE 1 END AS y_true
FROM labels""")

_SQL["requests"] = ([], """
SELECT event_id AS request_id, concat('client', CAST(user_id % 2 AS <STR>)) AS client,
 <MICROS>(1704067200000000 + event_id * 200000) AS ts
FROM events""")

# vote over the three annotators as one-hot scores
_SQL["votes"] = (["annotations"], """
SELECT post_id, a_id, b_id, c_id, label_confidence,
 0.2e0 * CAST(a_id = 0 AS INT) + 0.3e0 * CAST(b_id = 0 AS INT) + 0.5e0 * CAST(c_id = 0 AS INT) AS score_negative,
 0.2e0 * CAST(a_id = 1 AS INT) + 0.3e0 * CAST(b_id = 1 AS INT) + 0.5e0 * CAST(c_id = 1 AS INT) AS score_neutral,
 0.2e0 * CAST(a_id = 2 AS INT) + 0.3e0 * CAST(b_id = 2 AS INT) + 0.5e0 * CAST(c_id = 2 AS INT) AS score_positive
FROM annotations""")

_SQL["labeled"] = (["votes"], """
SELECT post_id, auto_label_id,
 CASE auto_label_id WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' ELSE 'positive' END AS auto_label,
 CASE a_id WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' ELSE 'positive' END AS textblob_prediction,
 CASE b_id WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' ELSE 'positive' END AS vader_prediction,
 CASE c_id WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' ELSE 'positive' END AS finbert_prediction,
 label_confidence,
 (CAST(a_id = auto_label_id AS INT) + CAST(b_id = auto_label_id AS INT) + CAST(c_id = auto_label_id AS INT))
  / 3e0 AS label_agreement,
 score_negative, score_neutral, score_positive
FROM (SELECT *, CASE WHEN score_negative >= score_neutral AND score_negative >= score_positive THEN 0
                     WHEN score_neutral >= score_positive THEN 1 ELSE 2 END AS auto_label_id FROM votes) v""")

# class probabilities of three models, one row per post and model
_SQL["model_probs"] = (["annotations"], """
SELECT post_id, model, label_id, q0 / (q0 + q1 + q2) AS p_negative, q1 / (q0 + q1 + q2) AS p_neutral,
 q2 / (q0 + q1 + q2) AS p_positive
FROM (SELECT post_id, CASE m WHEN 0 THEN 'baseline' WHEN 1 THEN 'boosted' ELSE 'stacked' END AS model, label_id,
  CAST(1 + 4 * CAST(label_id = 0 AS INT) + (CAST(post_id AS BIGINT) * (3 + m)) % 7 AS DOUBLE) AS q0,
  CAST(1 + 4 * CAST(label_id = 1 AS INT) + (CAST(post_id AS BIGINT) * (4 + m)) % 7 AS DOUBLE) AS q1,
  CAST(1 + 4 * CAST(label_id = 2 AS INT) + (CAST(post_id AS BIGINT) * (5 + m)) % 7 AS DOUBLE) AS q2
  FROM (SELECT post_id, m, CASE m WHEN 0 THEN a_id WHEN 1 THEN b_id ELSE c_id END AS label_id
        FROM annotations <MODELS>) x) y""")

# labelled posts with one model's prediction and probabilities
_SQL["scored"] = (["truth", "model_probs"], """
SELECT t.post_id, t.y_true, CAST(p.label_id AS INT) AS y_pred, p.model, p.p_negative, p.p_neutral, p.p_positive
FROM truth t JOIN model_probs p ON p.post_id = t.post_id""")

# reference and new samples of three features in long form
_SQL["samples"] = ([], """
SELECT 'value' AS feature, CASE WHEN ts < TIMESTAMP '2024-01-16 00:00:00' THEN 'ref' ELSE 'new' END AS side,
 value AS x FROM events
UNION ALL
SELECT 'value_shifted', CASE WHEN ts < TIMESTAMP '2024-01-16 00:00:00' THEN 'ref' ELSE 'new' END,
 CASE WHEN ts < TIMESTAMP '2024-01-16 00:00:00' THEN value ELSE value * 1.5e0 END FROM events
UNION ALL
SELECT 'k', CASE WHEN e.ts < TIMESTAMP '2024-01-16 00:00:00' THEN 'ref' ELSE 'new' END,
 CAST(<K> AS DOUBLE) FROM events e""")

# one landing record per post, as the forum API returns it
_SQL["raw_posts"] = ([], """
SELECT CAST(d.doc_id AS <STR>) AS id, concat('Post ', CAST(d.doc_id AS <STR>)) AS title, d.text AS selftext,
 CASE WHEN d.doc_id % 23 = 22 THEN NULL ELSE concat('user', CAST(e.user_id AS <STR>)) END AS author,
 CAST(1704067200 + d.doc_id * 60 AS DOUBLE) AS created_utc,
 CAST(floor(e.value) AS BIGINT) AS score, CAST((d.doc_id * 7) % 101 AS DOUBLE) / 100e0 AS upvote_ratio,
 CAST(<K> AS BIGINT) AS num_comments, d.source AS subreddit,
 concat('https://forum.example/', CAST(d.doc_id AS <STR>)) AS url,
 concat('/r/', d.source, '/comments/', CAST(d.doc_id AS <STR>)) AS permalink,
 (d.doc_id % 2 = 0) AS is_self, CAST(NULL AS <STR>) AS link_flair_text
FROM documents d JOIN events e ON e.event_id = d.doc_id""")

# three overlapping collection runs of the same posts, in arrival order
_SQL["collections"] = (["posts"], """
SELECT post_id, title, subreddit, score, 'first' AS category, 1 AS run FROM posts WHERE score > 0
UNION ALL SELECT post_id, title, subreddit, score + 1, 'second', 2 FROM posts WHERE is_self
UNION ALL SELECT post_id, title, subreddit, score + 2, 'third', 3 FROM posts""")

# per minute of the log: share of failed calls
_SQL["error_series"] = (["predictions"], """
SELECT model_name, date_trunc('hour', predicted_at) AS slot,
 CAST(sum(CASE WHEN success THEN 0 ELSE 1 END) AS DOUBLE) / count(*) AS error_rate
FROM predictions GROUP BY model_name, date_trunc('hour', predicted_at)""")

TABLES = ("documents", "events", "labels")
TEXT_TABLES = ("documents", "pages", "conversations")


DEAL = "spark.sentiloom.dealTexts"


def spread(df: DataFrame) -> DataFrame:
    """Deal text rows out to as many tasks as the session asks for, and not at all unless it does.

    Meant for the small given files of one row group; real tables have plenty of splits.
    """
    parts = int(df.sparkSession.conf.get(DEAL, "0"))
    return df.repartition(parts) if parts else df


def _closure(names) -> list[str]:
    ordered: list[str] = []

    def visit(name):
        for dep in _SQL[name][0]:
            visit(dep)
        if name not in ordered:
            ordered.append(name)

    for n in names:
        visit(n)
    return ordered


def _spell(sql: str, dialect: str) -> str:
    for key, value in _DIALECT[dialect].items():
        sql = sql.replace(f"<{key}>", value)
    return sql


def with_views(body: str, *names: str) -> str:
    """DuckDB SQL: ``body`` with the named views as common table expressions in front."""
    ctes = [f"{n} AS ({_spell(_SQL[n][1], 'duckdb')})" for n in _closure(names)]
    body = body.strip()
    if body[:4].upper() == "WITH":
        return "WITH " + ",\n".join(ctes) + ",\n" + body[4:].lstrip()
    return "WITH " + ",\n".join(ctes) + "\n" + body


class Views:
    """Lazy DataFrames of the views for one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._made: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return spread(df) if name in TEXT_TABLES else df

    def view(self, name: str) -> DataFrame:
        if name not in self._made:
            sql = _spell(_SQL[name][1], "spark")
            inputs = {n: self.view(n) for n in _SQL[name][0]}
            inputs |= {t: self.table(t) for t in TABLES if re.search(rf"(FROM|JOIN) {t}\b", sql)}
            used = {n: df for n, df in inputs.items() if re.search(rf"(FROM|JOIN) {n}\b", sql)}
            for n in used:
                sql = re.sub(rf"(FROM|JOIN) {n}\b", rf"\1 {{{n}}}", sql)
            self._made[name] = self.spark.sql(sql, **used)
        return self._made[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name in _SQL:
            return self.view(name)
        raise AttributeError(name)

    @cached_property
    def texts(self) -> DataFrame:
        """Posts with ``full_text``."""
        from sentiloom.functions.text import full_text

        return self.posts.withColumn("full_text", full_text(F.col("title"), F.col("content")))

    @cached_property
    def cleaned(self) -> DataFrame:
        from sentiloom.functions.text import clean_text

        return self.texts.withColumn("cleaned_text", clean_text(F.col("full_text")))
