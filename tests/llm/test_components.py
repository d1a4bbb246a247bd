"""Components against union-find; buckets of many unlike members."""

import random

import pytest
from helpers import near_components

from sentiloom.llm.components import components
from sentiloom.llm.near_duplicates import _buckets, _moved, near_duplicates


def least_nodes(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_are_those_of_union_find(spark, seed):
    rng = random.Random(seed)
    path = [(1000 + i, 1001 + i) for i in range(60)]
    star = [(5000, 5001 + i) for i in range(80)]
    edges = path + star + [(rng.randrange(200), 300 + rng.randrange(200)) for _ in range(150)]
    edges = [rng.choice([(u, v), (v, u)]) for u, v in edges] + [(7, 7)]
    got = [(r.node, r.root) for r in components(spark.createDataFrame(edges, "u long, v long")).collect()]
    assert len(got) == len(dict(got)) and dict(got) == least_nodes([e for e in edges if e[0] != e[1]])
    assert components(spark.createDataFrame([(3, 3)], "u long, v long")).count() == 0


def test_rounds_are_put_together(spark):
    first = spark.createDataFrame([(1, 1), (2, 1), (5, 5), (6, 5)], "node long, root long")
    later = spark.createDataFrame([(1, 1), (5, 1), (9, 1), (7, 7), (8, 7)], "node long, root long")
    assert {(r.node, r.root) for r in _moved(first, later).collect()} == {(1, 1), (2, 1), (5, 1), (6, 1), (9, 1), (7, 7), (8, 7)}


def test_every_pair_of_a_bucket_falls_due_once(spark):
    classes = spark.createDataFrame([(i, [1, 10 + i // 2], 5, [0] * 8, [0] * 8) for i in range(40)],
                                    "cid long, bands array<long>, n long, odd array<long>, whole array<long>")
    rows = _buckets(classes).select("key", "size", "rank", "cid").collect()
    for key in {r.key for r in rows}:
        bucket = [r for r in rows if r.key == key]
        assert sum(r["rank"] == 0 for r in bucket) == 1 and all(r["rank"] < r["size"] == len(bucket) for r in bucket)
    assert len(rows) == 80


def test_hot_bucket_of_unlike_texts(spark):
    rng = random.Random(4)
    shared = " ".join(f"s{i}" for i in range(120))
    texts = [shared + " " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.choice([30, 60, 90]))) for _ in range(60)]
    texts += [t + " end" for t in texts[:20]]
    rows = list(enumerate(texts))
    got = {(r.doc_id, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(d, c) for d, _, c in near_components(rows)}
