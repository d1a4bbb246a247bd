"""Terms are counted in Arrow batches, a piece of the texts at a time, with the same counts and weights as a plain count."""

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from sentiloom.models.stages import TextVectors, vector_parts
from sentiloom.operators import terms

TEXTS = ["", None, "a", "Ab ab AB", "x y z", "aa bb aa bb  aa", "ÉÉ日本 🚀 aa_b aa_b", "aa", "cc aa\tbb-aa 12 1", "bb aa " * 300, "𝒜𝒜 𝒜 ɐɐ aa bb"]


def _grams(text):
    words = re.findall(r"\w{2,}", (text or "").lower())
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def _frame(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS * 3)], "post_id long, t string")


def test_counts_and_weights(spark, monkeypatch):
    df = _frame(spark)
    counts = [Counter(_grams(t)) for t in TEXTS * 3]
    corpus, docs = Counter(), Counter()
    for c in counts:
        corpus.update(c)
        docs.update(c.keys())
    rows = terms.fit_vocabulary(df, "t", 15).collect()
    top = sorted((t for t in corpus if 2 <= docs[t] <= 0.95 * len(counts)), key=lambda t: (-corpus[t], t))[:15]
    assert [r.term for r in sorted(rows, key=lambda r: r.term_index)] == sorted(top, key=lambda t: t.encode())
    assert all((r.corpus_count, r.doc_count) == (corpus[r.term], docs[r.term]) for r in rows)
    idf = {r.term: r.idf for r in rows}
    want = {}
    for i, c in enumerate(counts):
        raw = {t: (1 + math.log(n)) * idf[t] for t, n in c.items() if t in idf}
        want |= {(i, t): w / math.sqrt(sum(x * x for x in raw.values())) for t, w in raw.items()}
    got = terms.tfidf(df, "t", spark.createDataFrame(rows), sublinear=True).collect()
    assert len(got) == len(want) and all(abs(want[r.post_id, r.term] - r.weight) < 1e-12 for r in got)
    monkeypatch.setattr(terms, "PIECE", 40)  # the driver's own pieces: one or a few texts each
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"t": [" ".join(re.findall(r"\w+", (t or "").lower())) for t in TEXTS]})
    parts = [terms._counted(x).to_pylist() for _, x in terms.pieces([batch])]
    assert len(parts) > 3 and sum((Counter({r["term"]: r["tf"] * 3 for r in p}) for p in parts), Counter()) == corpus


def test_counting_leaves_no_expression_per_term(spark):
    """The plan counts in Python; before, each term of a text went through interpreted lambdas (sort, runs, filter)."""
    df = _frame(spark)
    plan = terms.fit_vocabulary(df, "t", 15)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "lambda" not in plan
    model = TextVectors(inputCol="t", outputCol="v", maxFeatures=15).fit(df)
    plan = model.transform(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan


def test_vectors_of_texts_without_terms(spark):
    df = _frame(spark)
    model = TextVectors(inputCol="t", outputCol="v", maxFeatures=15).fit(df)
    rows = model.transform(df).select("t", vector_parts(F.col("v")).alias("p")).collect()
    assert all(r.p.size == len(model.stages[0].terms()) and list(r.p.indices) == sorted(set(r.p.indices)) for r in rows)
    assert all(len(r.p.indices) == 0 for r in rows if not r.t)
    single = terms.fit_vocabulary(df.filter("t = 'aa' or t = 'Ab ab AB'"), "t", 5)
    assert sorted(r.term for r in single.collect()) == ["aa", "ab", "ab ab"]
