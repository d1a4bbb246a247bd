"""Registered queries against their SQL, the classifier on held-out rows, the mixture against a plain computation."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from compare import compare, duck
from helpers import words
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sentiloom.llm import mixing, near_duplicates
from sentiloom.llm.registry import QUERIES, SQL

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def test_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 14))
    assert set(QUERIES) <= set(entry.queries()) and "pipeline" in entry.queries() and set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", [n for n in SQL if n != "pipeline"])
def test_matches_sql(spark, name):
    class Query:
        oracle = SQL[name]

        def __call__(self, *args):
            return QUERIES[name](*args)

    state, note = compare(spark, duck(SMALL), Query(), SMALL)
    assert state == "ok", note


def test_toxicity_of_held_out_rows(spark):
    rows = QUERIES["op1_toxicity"](spark, MIDDLE).collect()
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()}
    assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    scores = [(r.score, toxic[r.doc_id]) for r in rows if r.held_out and r.doc_id in toxic]
    good, bad = [s for s, t in scores if t], [s for s, t in scores if not t]
    auc = np.mean([(a > b) + (a == b) / 2 for a in good for b in bad])
    wrong = sum((s >= 0.7) != t for s, t in scores) / len(scores)
    assert auc > 0.8 and wrong < 0.12  # some thirty toxic rows to learn from


def test_mixture_reaches_its_targets(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").collect()}
    rows = QUERIES["op8_mixing"](spark, MIDDLE).collect()
    again = {r.doc_id: r.taken for r in QUERIES["op8_mixing"](spark, MIDDLE).collect()}
    assert again == {r.doc_id: r.taken for r in rows} and len(rows) == len(docs)
    size, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r.size == len(words(docs[r.doc_id].text)) and 0 <= r.taken <= 2 * r.size
        size[r.source] += r.size
        taken[r.source] += r.taken
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(size))}
    full, total = set(), sum(size.values())
    while True:
        free = [s for s in size if s not in full]
        level = (1.5 * total - sum(2 * size[s] for s in full)) / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 2 * size[s]}
        if not over:
            break
        full |= over
    for r in rows:
        assert r.source_size == size[r.source]
        assert r.target == pytest.approx(2 * size[r.source] if r.source in full else weight[r.source] * level)
        assert abs(taken[r.source] - r.target) <= mixing.BLOCK


def test_seats_are_sainte_lague(spark):
    aims = spark.createDataFrame([(0, 530.0), (1, 240.0), (2, 155.0), (3, 75.0), (4, 0.0)], "sid long, target double")
    rows = mixing.shard_quotas(aims, block=10, shard=7).collect()
    shares, seats, order = [530.0, 240.0, 155.0, 75.0, 0.0], defaultdict(int), []
    for _ in range(100):
        best = max(range(5), key=lambda s: (shares[s] / (2 * seats[s] + 1), -s))
        seats[best] += 1
        order.append(best)
    want = defaultdict(int)
    for i, s in enumerate(order):
        want[i // 7, s] += 1
    assert {(r.shard, r.sid): r.quota for r in rows} == dict(want)


def test_seats_of_many_tiny_sources(spark):
    # one source of 100,000 words and 100 of 100 words, in blocks of 256: all 430 seats are the large one's by quotient
    aims = spark.createDataFrame([(0, 100_000.0), *[(k, 100.0) for k in range(1, 101)]], "sid long, target double")
    got = {r.sid: r.q for r in mixing.shard_quotas(aims, block=256, shard=64).groupBy("sid").agg({"quota": "sum"}).toDF("sid", "q").collect()}
    quotients = sorted((-t / (2 * k + 1), s, k) for s, t in [(0, 100_000.0), *[(i, 100.0) for i in range(1, 101)]] for k in range(600))
    want = defaultdict(int)
    for _, s, _ in quotients[: round(110_000 / 256)]:
        want[s] += 1
    assert got == dict(want) and got[0] == 430
    tiny = spark.range(5000).select(F.col("id").alias("sid"), F.lit(0.5).alias("target"))
    assert {(r.sid, r.quota) for r in mixing.shard_quotas(tiny, block=256).collect()} == {(k, 1) for k in range(10)}


def test_odd_sketch_estimates_and_bounds():
    rng = np.random.default_rng(3)
    factors, shifts = near_duplicates._hash_functions()
    missed = 0
    for j in (0.75, 0.8, 0.95):
        for _ in range(60):
            n = 400
            common = int(round(2 * n * j / (1 + j)))
            pool = rng.integers(0, 2**63, 2 * n, dtype=np.int64).astype(np.uint64)
            a, b = np.unique(pool[:n]), np.unique(pool[n - common : 2 * n - common])
            sa, sb = (near_duplicates.minhash(x, factors, shifts) for x in (a, b))
            differ = int(np.unpackbits((near_duplicates.odd_sketch(sa, 512) ^ near_duplicates.odd_sketch(sb, 512)).view(np.uint8)).sum())
            missed += differ > near_duplicates.most_differing(near_duplicates.LEAST_ESTIMATE)
            bound = int(np.unpackbits((near_duplicates.parity_bitmap(a, 512) ^ near_duplicates.parity_bitmap(b, 512)).view(np.uint8)).sum())
            assert bound <= len(set(a.tolist()) ^ set(b.tolist()))
            assert set(near_duplicates.band_keys(sa, 45, 5)) & set(near_duplicates.band_keys(sb, 45, 5))
    assert missed == 0
