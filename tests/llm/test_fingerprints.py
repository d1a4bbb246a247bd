"""Fingerprints against a plain walk over the documents, and their likeness against the exact similarity."""

import hashlib
from collections import Counter

import numpy as np

from sentiloom.llm.fingerprints import Sampler, _gamma_quantiles, edited, fingerprints, likeness
from sentiloom.llm.registry import QUERIES


def walk(rows):
    rows = sorted(rows, key=lambda r: -r[0])
    return {a[0]: (a[1] or "", edited(a[1] or "", b[1] or ""), b[1] or "") for a, b in zip(rows, rows[1:] + rows[:1])}


def check(spark, rows, got):
    s, want = Sampler(), walk(rows)
    assert sorted(r.doc_id for r in got) == sorted(want)
    for r in got:
        text, changed, following = want[r.doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert r.fingerprint == s.of(text).tobytes().hex() and r.edited_fingerprint == s.of(changed).tobytes().hex()
        assert r.near_edited == likeness(s.of(text), s.of(changed)) and r.near_next == likeness(s.of(text), s.of(following))


def test_documents(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    check(spark, rows, QUERIES["op3_fingerprints"](spark, folder).collect())


def test_odd_rows(spark):
    rows = [(5, None), (3, ""), (9, "a"), (7, "é😀 b c d e"), (-4, "x " * 30_000), (100, "one two"), (101, "one two")]
    df = spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id long, text string, bucket long")
    got = fingerprints(df).collect()
    check(spark, rows, got)
    by_id = {r.doc_id: r for r in got}
    assert by_id[100].fingerprint == by_id[101].fingerprint and by_id[101].near_next == 1.0
    assert fingerprints(df.limit(0)).count() == 0
    alone = fingerprints(df.filter("doc_id = 7")).collect()
    assert alone[0].near_next == 1.0
    twice = spark.createDataFrame([(1, "p q"), (1, "p q"), (1, "r s"), (None, "t u")], "doc_id long, text string")
    assert fingerprints(twice).count() == 4


def test_samples_estimate_generalised_jaccard():
    rng, s = np.random.default_rng(1), Sampler(2048)
    for _ in range(6):
        a = Counter(rng.integers(0, 60, rng.integers(20, 400)).tolist())
        b = Counter(rng.integers(0, 60, 100).tolist()) + Counter({k: v for k, v in a.items() if k % 2})
        exact = sum((a & b).values()) / sum((a | b).values())
        prints = [s.sample(np.array(sorted(x), np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.array([x[k] for k in sorted(x)])) for x in (a, b)]
        assert abs(likeness(*prints) - exact) < 0.05


def test_weights_above_the_table():
    s, term = Sampler(2048), np.array([0x9E3779B97F4A7C15], np.uint64)
    prints = {n: s.sample(term, np.array([n])) for n in (32_767, 40_000, 100_000, 400_000)}
    for a, b in [(40_000, 100_000), (40_000, 400_000), (32_767, 100_000)]:
        assert abs(likeness(prints[a], prints[b]) - a / b) < 0.05
    # two pairs of words in a whole text, one counted far more often than the table reaches
    whole = [Sampler(512).of("x " * n + "y") for n in (40_001, 100_001)]
    assert abs(likeness(*whole) - 0.4) < 0.1


def test_quantiles():
    x = _gamma_quantiles(np.array([1e-9, 0.1, 0.5, 0.9, 0.999999]))
    assert np.allclose(1 - (1 + x) * np.exp(-x), [1e-9, 0.1, 0.5, 0.9, 0.999999], rtol=1e-4)


def test_samples_of_two_texts_at_once_are_those_of_each(spark):
    import random

    from sentiloom.llm.fingerprints import Sampler

    s, rnd = Sampler(), random.Random(3)
    texts = ["", "one", "x " * 5000, *[" ".join(rnd.choice("abcdefghij") for _ in range(rnd.choice([3, 40, 900]))) for _ in range(30)],
             *[" ".join(f"w{rnd.randint(0, 3000)}" for _ in range(2500)) for _ in range(4)]]
    for a in texts:
        b = rnd.choice(texts)
        mixed = a[: len(a) * 2 // 3] + b[: len(a) // 3]
        for other in (b, mixed, a):
            together = s.of_both(a, other)
            assert (together[0] == s.of(a)).all() and (together[1] == s.of(other)).all()
