"""Line deduplication by overlapping three-line windows, in DataFrame functions only.

A text is cut at ``\\n``.  Lines that hold something besides white space, trimmed, are numbered; every three in a row form a
window, known by a 128-bit hash.  The first occurrence of a window in the whole corpus (by doc_id, then line) stays; all lines
that a later occurrence covers go.  Overlapping occurrences cover the union of their lines.  Blank lines between covered
lines of one window go with them.

Windows travel as two hashes, a doc_id and a line number.  Counts and first places are pre-aggregated before the shuffle, and the join back is
a plain sort-merge join, which adaptive execution splits when one window fills a partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentiloom.llm.common import release, table
from sentiloom.llm.registry import llm_query

_EDGES = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"
_WINDOWS = "array<struct<h1:bigint,h2:bigint,first:int,last:int>>"


def _let(value: Column, use) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _three(h: Column) -> Column:
    def window(i: Column) -> Column:
        x, y, z = F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)
        return F.struct(F.xxhash64(x["a"], y["a"], z["a"]).alias("h1"), F.xxhash64(x["b"], y["b"], z["b"]).alias("h2"), x["i"].alias("first"), z["i"].alias("last"))

    return F.transform(F.sequence(F.lit(0), F.size(h) - 3), window)


def _windows(text: Column) -> Column:
    """Array of (h1, h2, first, last): hashes of three filled lines in a row and the indices of the first and last."""
    trimmed = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(F.regexp_replace(x, _EDGES, "").alias("t"), i.alias("i")))
    hashed = F.transform(F.filter(trimmed, lambda x: x["t"] != ""), lambda x: F.struct(
        F.xxhash64(x["t"]).alias("a"), F.xxhash64(F.lit(1), x["t"]).alias("b"), x["i"].alias("i")))
    return _let(hashed, lambda h: F.when(F.size(h) >= 3, _three(h)).otherwise(F.array().cast(_WINDOWS)))


def _text_hash(docs: DataFrame) -> Column:
    """Tells rows of one doc_id apart by their texts (null counts as empty)."""
    return F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, covered): per text with repeats, the sorted indices of the lines to go.

    Rows without a doc_id take no part.  Unlike texts with one doc_id have lines of their own, in the order of their hashes; equal
    rows count as one.
    """
    places = docs.filter(F.col("doc_id").isNotNull()).select(
        "doc_id", _text_hash(docs).alias("text_hash"), F.explode(_windows(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("w")).select(
        "doc_id", "text_hash", F.col("w.h1").alias("h1"), F.col("w.h2").alias("h2"), F.col("w.first").alias("first"), F.col("w.last").alias("last"))
    start = F.struct("doc_id", "text_hash", "first")
    firsts = places.groupBy("h1", "h2").agg(F.min(start).alias("origin"), F.max(start).alias("latest")).filter("origin <> latest").select("h1", "h2", "origin")
    later = places.join(firsts, ["h1", "h2"]).filter(start > F.col("origin"))
    return later.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("first", "last")).alias("spans")).select(
        "doc_id", "text_hash", F.array_sort(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["first"], s["last"]))))).alias("covered"))


def _with_covered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_llm_covered`` (null without repeats) and ``_llm_text`` (the text without repeated lines)."""
    gone = repeated_lines(docs).withColumnsRenamed({"doc_id": "_llm_id", "text_hash": "_llm_hash", "covered": "_llm_covered"})
    text = F.col("text").cast("string")
    # array_except hashes and keeps order, so the texts are rebuilt in linear time
    rebuilt = _let(F.split(text, "\n", -1), lambda x: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(x) - 1), "_llm_covered"), lambda i: F.get(x, i)), "\n"))
    return docs.join(gone, (docs["doc_id"] == gone["_llm_id"]) & (_text_hash(docs) == gone["_llm_hash"]), "left").drop("_llm_id", "_llm_hash").withColumn(
        "_llm_text", F.when(F.col("_llm_covered").isNull(), text).otherwise(rebuilt))


def line_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_removed`` and ``deduped``: the text without its repeated lines.

    A text with nothing to remove comes back unchanged; null stays null (no lines).  Other columns are carried along; columns of
    the three names are replaced.
    """
    lines = F.size(F.split(F.col("text").cast("string"), "\n", -1))
    return _with_covered(docs).withColumns({
        "n_lines": F.when(F.col("text").isNull(), F.lit(0)).otherwise(lines).cast("long"),
        "n_removed": F.when(F.col("_llm_covered").isNull(), F.lit(0)).otherwise(F.size("_llm_covered")).cast("long"),
        "deduped": F.col("_llm_text"),
    }).drop("_llm_covered", "_llm_text")


def dedup_lines(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: repeated lines leave the texts; every document stays, its n_chars follows its text."""
    release(spark)
    new = {"text": F.col("_llm_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("_llm_covered").isNull(), F.col("n_chars")).otherwise(F.length("_llm_text").cast("long"))
    return _with_covered(docs).withColumns(new).select(*docs.columns)


_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
f AS (SELECT doc_id, i, regexp_replace(line, '^[ 	-
]+|[ 	-
]+$', '', 'g') AS t FROM l),
w AS (SELECT doc_id, i AS first, lead(i, 2) OVER d AS last, t AS a, lead(t, 1) OVER d AS b, lead(t, 2) OVER d AS c FROM f WHERE t <> ''
  WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT *, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, first) AS nth FROM w WHERE last IS NOT NULL),
g AS (SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS i FROM r WHERE nth > 1),
k AS (SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL), '') AS deduped
  FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id)
SELECT doc_id, n_lines, n_removed, length(deduped) AS kept_chars, deduped FROM k
"""


@llm_query("op9_line_dedup", _SQL)
def op9_line_dedup(spark, folder):
    out = line_dedup(table(spark, folder, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.length("deduped").cast("long").alias("kept_chars"), "deduped")
