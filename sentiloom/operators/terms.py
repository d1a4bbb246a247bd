"""Vocabularies, TF-IDF in long form and token ids."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentiloom.functions import patterns as P
from sentiloom.functions.text import bind, tokens
from sentiloom.operators.dictionary import hashed_dictionary, runs_of_equal
from sentiloom.operators.joins import dictionary_join

PAD, UNK, FIRST_ID = 0, 1, 2  # fixed values


def grams(text: Column) -> Column:
    """Lower-case terms of two or more word characters and their neighbours' pairs."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(P.TERM), F.lit(0))
    return bind(words, lambda w: F.concat(w, F.array_compact(F.zip_with(
        w, F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b)))))


def plain_words(text: Column) -> Column:
    """Lower-case text with one blank in place of everything between words."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), P.NWORD + "+", " ")


PIECE = 4_000_000  # bytes of text that are counted at a time, in whole texts


def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list[pa.Array], pa.Array]]:
    """(other columns, texts) of stretches of rows with some ``PIECE`` bytes; the text is the last column, without nulls."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(batch.num_columns - 1)).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + PIECE, side="right")))
            part = batch.slice(start, stop - start)
            yield part.columns[:-1], part.columns[-1]
            start = stop


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Terms of two or more characters of :func:`plain_words` texts: the row and the word of each, in order."""
    listed = pc.split_pattern(texts, " ")
    words = pc.list_flatten(listed)
    long = pc.greater_equal(pc.utf8_length(words), 2)
    return pc.list_parent_indices(listed).filter(long).to_numpy(zero_copy_only=False), words.filter(long)


def _counted(texts: pa.Array) -> pa.RecordBatch:
    """Terms and pairs of a piece with how often they occur and in how many texts."""
    rows, words = split_words(texts)
    coded = words.dictionary_encode()
    names, ids = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n, size = len(texts), max(len(names), 1)
    same = rows[1:] == rows[:-1]
    sums = []
    for code, row in ((ids, rows), ((ids[:-1] * size + ids[1:])[same], rows[1:][same])):
        order = np.argsort(code, kind="stable")  # rows stay in order within a code
        code, row = code[order], row[order]
        first = np.flatnonzero(np.diff(code, prepend=-1))
        fresh = (np.diff(code, prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0)
        df = np.add.reduceat(fresh.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
        sums.append((code[first], np.diff(first, append=len(code)), df))
    (single, tf, df), (pair, tf2, df2) = sums
    both = pc.binary_join_element_wise(names.take(pa.array(pair // size)), names.take(pa.array(pair % size)), " ")
    terms = pa.concat_arrays([names.take(pa.array(single)), both.cast(names.type)])
    return pa.RecordBatch.from_arrays([terms, pa.array(np.append(tf, tf2)), pa.array(np.append(df, df2))], names=["term", "tf", "df"])


def fit_vocabulary(df: DataFrame, text_col: str, max_features: int = 100, min_df: int = 2, max_df: float = 0.95,
                   key: str = "post_id") -> DataFrame:
    """Terms with index and smooth idf: at most ``max_features`` rows, ties by term.

    Terms are counted in Arrow batches, some megabytes of text at a time, so each distinct term of such a piece is one row with both
    counts, summed map-side per term.
    """
    n = df.select(F.count(F.lit(1))).scalar()

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in pieces(batches):
            counted = _counted(texts)
            yield from (counted.slice(i, 50_000) for i in range(0, counted.num_rows, 50_000))

    counted = df.select(plain_words(F.col(text_col)).alias("text")).mapInArrow(count, "term string, tf long, df long")
    counts = counted.groupBy("term").agg(F.sum("tf").alias("corpus_count"), F.sum("df").alias("doc_count"))
    kept = counts.filter((F.col("doc_count") >= min_df) & (F.col("doc_count") <= max_df * n))
    top = kept.orderBy(F.desc("corpus_count"), "term").limit(max_features)
    # at most max_features rows reach this window
    return top.withColumns({
        "term_index": F.row_number().over(Window.orderBy("term")) - 1,
        "idf": F.log((1 + n) / (1 + F.col("doc_count"))) + 1.0})


def term_frequency(n: np.ndarray, sublinear: bool) -> np.ndarray:
    """The counts themselves, or 1 + ln(count), taken once per distinct count."""
    sizes, at = np.unique(n, return_inverse=True)
    return np.array([math.log(x) + 1.0 if sublinear else float(x) for x in sizes.tolist()], float)[at]


class Weights:
    """TF-IDF of texts for a vocabulary that a task holds: words become numbers once, pairs are looked up by both numbers."""

    def __init__(self, terms: list[str], idf: list[float], sublinear: bool):
        split = [t.split(" ") for t in terms]
        self.words = pa.array(sorted({w for parts in split for w in parts}), pa.string())
        number = {w: i for i, w in enumerate(self.words.to_pylist())}
        self.single = np.full(len(number), -1, np.int64)
        pairs = []
        for i, parts in enumerate(split):
            if len(parts) == 1:
                self.single[number[parts[0]]] = i
            elif len(parts) == 2:
                pairs.append((number[parts[0]] * len(number) + number[parts[1]], i))
        self.pairs, self.pair_terms = np.array(sorted(pairs), np.int64).reshape(-1, 2).T
        self.idf, self.sublinear = np.array(idf, float), sublinear

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, term and weight of every known term of :func:`plain_words` texts, by row and term; each text is scaled to length 1."""
        rows, words = split_words(texts)
        ids = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        known = ids >= 0
        beside = known[1:] & known[:-1] & (rows[1:] == rows[:-1])
        size = len(self.idf)
        hits = [(rows[known], self.single[ids[known]])]
        if len(self.pairs):
            code = (ids[:-1] * len(self.words) + ids[1:])[beside]
            at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            hits.append((rows[1:][beside], np.where(self.pairs[at] == code, self.pair_terms[at], -1)))
        row, term = (np.concatenate([h[i] for h in hits]).astype(np.int64) for i in (0, 1))
        code, n = np.unique((row * size + term)[term >= 0], return_counts=True)
        row, term = np.divmod(code, max(size, 1))
        raw = term_frequency(n, self.sublinear) * self.idf[term]
        return row, term, raw / np.sqrt(np.bincount(row, raw * raw))[row]  # added up in the order of the terms


def _weighted(df: DataFrame, key: str, found: Column, sublinear: bool) -> DataFrame:
    """Rows from an array of vocabulary entries per post: counted, weighted and scaled inside the row."""
    known = F.array_sort(F.transform(F.array_compact(found), lambda e: F.struct(e["term_index"].alias("term_index"), e["term"].alias("term"), e["idf"].alias("idf"))))

    @F.arrow_udf("array<double>")
    def frequencies(counts: pa.Array) -> pa.Array:
        n = counts.values.to_numpy(zero_copy_only=False)
        return pa.ListArray.from_arrays(counts.offsets, pa.array(term_frequency(n, sublinear)))

    counted = df.select(key, runs_of_equal(known, "term_index").alias("_runs"))
    counted = counted.withColumn("_tf", frequencies(F.transform("_runs", lambda r: r["n"].cast("long"))))
    raw = F.zip_with("_runs", "_tf", lambda r, tf: F.struct(
        r["item"]["term_index"].alias("term_index"), r["item"]["term"].alias("term"), (tf * r["item"]["idf"]).alias("raw")))
    # one array from one expression, so that nothing above it is worked out twice
    scaled = bind(raw, lambda x: bind(F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, e: a + e["raw"] * e["raw"])), lambda norm: F.transform(
        x, lambda e: F.struct(e["term_index"].alias("term_index"), e["term"].alias("term"), (e["raw"] / norm).alias("weight")))))
    return counted.select(key, F.inline(scaled))


def tfidf(df: DataFrame, text_col: str, vocabulary: DataFrame, sublinear: bool = False, key: str = "post_id") -> DataFrame:
    """(key, term_index, term, weight) rows, each post scaled to length 1.

    Terms are looked up, counted and weighted in Arrow batches, row by row: no shuffle but that of the vocabulary, which comes to
    the driver up to the bound of :mod:`sentiloom.operators.dictionary`.  A larger one is joined, and one row per post and known
    term is gathered.
    """
    table, hashed = hashed_dictionary(vocabulary.select("term", "term_index", "idf"), "term")
    if hashed is not None:
        ordered = table.orderBy("term_index").collect()
        terms, weights = [r["term"] for r in ordered], Weights([r["term"] for r in ordered], [r["idf"] for r in ordered], sublinear)
        index, names = pa.array([r["term_index"] for r in ordered], pa.int32()), pa.array(terms, pa.string())

        def weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for (keys,), texts in pieces(batches):
                row, term, weight = weights(texts)
                for i in range(0, len(row), 50_000):
                    at, known = pa.array(row[i : i + 50_000]), pa.array(term[i : i + 50_000])
                    yield pa.RecordBatch.from_arrays([keys.take(at), index.take(known), names.take(known), pa.array(weight[i : i + 50_000])],
                                                     names=[key, "term_index", "term", "weight"])

        rows = df.select(key, plain_words(F.col(text_col)).alias("_text"))
        schema = T.StructType([rows.schema[key], T.StructField("term_index", T.IntegerType()), T.StructField("term", T.StringType()),
                               T.StructField("weight", T.DoubleType())])
        return rows.mapInArrow(weigh, schema)
    hits = dictionary_join(df.select(key, F.explode_outer(grams(F.col(text_col))).alias("term")), table, "term").groupBy(key).agg(
        F.collect_list(F.struct("term_index", "term", "idf")).alias("_found"))
    return _weighted(hits, key, F.col("_found"), sublinear)


def vocab_count(df: DataFrame, text_col: str, max_vocab: int = 10000) -> DataFrame:
    """Most frequent words with ids from 2; 0 pads and 1 stands for unknown words."""
    counts = (
        df.select(F.explode_outer(tokens(F.lower(F.col(text_col)))).alias("word")).filter(F.col("word").isNotNull())
        .groupBy("word").agg(F.count(F.lit(1)).alias("count"))
    )
    top = counts.orderBy(F.desc("count"), "word").limit(max_vocab - FIRST_ID)
    order = Window.orderBy(F.desc("count"), "word")  # at most max_vocab rows
    return top.withColumn("token_id", F.row_number().over(order) + (FIRST_ID - 1))


def token_ids(df: DataFrame, text_col: str, vocabulary: DataFrame, max_len: int = 200, key: str = "post_id") -> DataFrame:
    """Fixed-length id lists: unknown words 1, padded with 0, cut at ``max_len``.  Words are looked up inside the row."""
    words = F.slice(F.coalesce(tokens(F.lower(F.col(text_col))), F.array().cast("array<string>")), 1, max_len)
    table, hashed = hashed_dictionary(vocabulary.select("word", "token_id"))
    if hashed is not None:
        ids = F.transform(hashed.entries(F.col("_w")), lambda e: F.coalesce(e["token_id"].cast("int"), F.lit(UNK)))
        listed = hashed.attach(df.select(key, words.alias("_w"))).select(key, ids.alias("ids"))
    else:
        coded = dictionary_join(df.select(key, F.posexplode_outer(words).alias("pos", "word")), table, "word", "left")
        # a post has at most max_len rows
        pairs = F.when(F.col("pos").isNotNull(), F.struct("pos", F.coalesce(F.col("token_id").cast("int"), F.lit(UNK)).alias("id")))
        listed = coded.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(pairs)), lambda e: e["id"]).alias("ids"))
    return listed.select(key, F.slice(F.concat("ids", F.array_repeat(F.lit(PAD), max_len)), 1, max_len).alias("token_ids"))
