"""Prefix trie against a plain one, with shards of all sizes."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from sentiloom.llm.prefix_trie import SlotTable, accumulate, prefix_trie


def plain_trie(rows: list[tuple]) -> list[tuple]:
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            text = text or ""
            own[conv].append(((turn is not None, turn or 0), role or "", hashlib.sha256(text.encode()).hexdigest(), text))
    whole = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 6
        whole[conv] = tuple((role, text) for _, role, _, text in sorted(own.get(conv - conv % 100, []))[:h] + sorted(turns)[h:])
    members, children, ends = defaultdict(list), defaultdict(set), defaultdict(list)
    for conv in sorted(whole):
        path = whole[conv]
        for d in range(len(path) + 1):
            members[path[:d]].append(conv)
            if d:
                children[path[: d - 1]].add(path[:d])
        ends[path].append(conv)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in members:
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children.get(node)
            saved[node[:d]] += (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
    return [(m[0], len(node), members[node[:-1]][0] if node else None, len(m), len(children.get(node, ())), leaves[node], saved[node],
             hashlib.sha256(",".join(map(str, ends.get(node, []))).encode()).hexdigest()) for node, m in members.items()]


def made_up(rnd: random.Random, count: int, longest: int) -> list[tuple]:
    rows, earlier = [], []
    for conv in rnd.sample(range(0, 5 * count), count):
        turns = [(rnd.choice(["user", "assistant"]), rnd.choice(["a", "b", "ü😀", "", "hello there"])) for _ in range(rnd.randint(1, longest))]
        if earlier and rnd.random() < 0.6:
            old = rnd.choice(earlier)
            turns = old[: rnd.randint(1, len(old))] + turns[: rnd.randint(0, 2)]
        earlier.append(turns)
        rows += [(conv, k, *t) for k, t in enumerate(turns)]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, depth string, chars int, length string"


def compared(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", 1, "x") for r in rows], SCHEMA).repartition(6)
    got = [tuple(r) for r in prefix_trie(df, **more).collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain_trie(rows)))


@pytest.mark.parametrize("least_shard", [2, 12, 1000])
def test_trie(spark, least_shard):
    rnd = random.Random(least_shard)
    rows = made_up(rnd, 150, 9)
    # one conversation many times, a long one twice, and a ladder of conversations that leave it one after the other
    rows += [(10_000 + c, k, "user", t) for c in range(60) for k, t in enumerate("abcdefgh")]
    rows += [(20_000 + c, k, "user", str(k % 7)) for c in range(2) for k in range(90)]
    rows += [(30_000 + 7 * c, k, "user", str(k)) for c in range(40) for k in range(c)]
    compared(spark, rows, least_shard=least_shard)


def test_odd_rows(spark):
    compared(spark, [(None, 1, "user", "lost"), (100, None, None, None), (100, 3, "user", "x"), (100, 3, "user", "x"), (101, 5, "user", "y"), (-7, 0, "user", ""),
                     (205, 0, "a", "b" * 50_000), (205, 0, "a", "c"), (207, 1, None, ""), (103, 0, "user", "z"), (104, 0, "user", "z")])
    compared(spark, [(5, 0, "user", "alone"), (5, 1, "user", "alone")])
    assert prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_slot_table():
    rng = np.random.default_rng(1)
    pairs = np.unique(rng.integers(0, 300, (20_000, 2)), axis=0)
    inside = rng.random(len(pairs)) < 0.5
    slots = SlotTable(*pairs[inside].T.copy())
    assert sorted(slots.find(*pairs[inside].T).tolist()) == list(range(int(inside.sum()))) and (slots.find(*pairs[~inside].T) == -1).all()
    with pytest.raises(ValueError):
        SlotTable(np.array([1, 1]), np.array([2, 2]))
    empty = np.zeros(0, dtype=np.int64)
    assert [len(x) for x in accumulate(*[empty] * 8)] == [0, 0, 0]
