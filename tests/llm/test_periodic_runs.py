"""Periodic runs against a search over all periods."""

from __future__ import annotations

import hashlib
import random
import time
import zlib

from sentiloom.llm.periodic_runs import Grammar, periodic_runs, planted, runs_of


def all_runs(words: list[bytes], least: int = 12) -> list[tuple[int, int, int]]:
    out: dict[tuple[int, int], int] = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            start = i
            while i + p < len(words) and words[i] == words[i + p]:
                i += 1
            if i > start and i + p - start >= max(least, 2 * p):
                out.setdefault((start, i + p), p)
            i += 1
    return sorted(((s, e, p) for (s, e), p in out.items()), key=lambda r: (r[0], r[2]))


def texts_of(rnd: random.Random, count: int) -> list[list[bytes]]:
    tenth = [k for k in range(2000) if zlib.crc32(str(k).encode()) % 10 == 0]
    out = []
    for _ in range(count):
        words = [b"%d" % rnd.randint(0, rnd.choice([0, 1, 2, 30])) for _ in range(rnd.randint(0, 130))]
        if rnd.random() < 0.5:
            words = planted(rnd.choice(tenth), words)
        if rnd.random() < 0.3:
            words = words + words[: rnd.randint(1, 25)] * rnd.randint(2, 5)
        out.append(words)
    return out


def test_runs():
    rnd = random.Random(2)
    for _ in range(60):
        texts = texts_of(rnd, rnd.randint(1, 9))
        for words, runs in zip(texts, runs_of(texts)):
            assert [tuple(r) for r in runs.tolist()] == all_runs(words)


def test_agreement():
    import numpy as np

    rng = np.random.default_rng(4)
    for kinds in (1, 2, 5, 60):
        symbols = np.append(rng.integers(0, kinds, 400), kinds)
        i, j = rng.integers(0, 401, 3000), rng.integers(0, 401, 3000)
        i, j = i[i != j], j[i != j]
        for a, b, n in zip(i, j, Grammar(symbols).agreement(i, j)):
            stop = 0
            while max(a, b) + stop < 401 and symbols[a + stop] == symbols[b + stop]:
                stop += 1
            assert n == stop


def test_planted():
    assert planted(None, [b"a"] * 3) == [b"a"] * 3 and planted(5, []) == []
    for doc_id in range(300):
        words, h = [b"%d" % k for k in range(50)], zlib.crc32(str(doc_id).encode())
        a, wanted = h // 10 % 50, list(words)
        p = 1 + (50 - a) // (3 + h // 10 % 8)
        if h % 10 == 0:
            wanted = [words[i] if i < a else words[a + (i - a) % p] for i in range(50)]
        assert planted(doc_id, words) == wanted


def test_very_long_texts():
    start = time.time()
    assert runs_of([[b"x"] * 400_000])[0].tolist() == [[0, 400_000, 1]]
    words = [b"%d" % (k * k % 9973) for k in range(150_000)]
    assert runs_of([words])[0].tolist() == [[0, 150_000, 9973]]
    assert time.time() - start < 60


def test_documents(spark):
    rnd = random.Random(9)
    rows = [(k, b" ".join(words).decode(), "x", 1) for k, words in enumerate(texts_of(rnd, 80))]
    rows += [(None, None, "x", 1), (None, "a b " * 9, "x", 1), (7, "", "x", 1), (7, "Ä x y\t" * 20, "x", 1), rows[5], rows[5]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string, period long").repartition(4)
    wanted = []
    for doc_id, text, *_ in rows:
        words = planted(doc_id, (text or "").encode().split())
        runs = all_runs(words)
        best = min(runs, key=lambda r: (r[0] - r[1], r[0], r[2])) if runs else None
        dropped = {k for s, e, q in runs for k in range(s + q, e)}
        wanted.append((
            doc_id, len(runs), *((best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else [None] * 4),
            hashlib.sha256("".join(f"{s},{e - s},{q}\n" for s, e, q in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for k, w in enumerate(words) if k not in dropped)).hexdigest()))
    got = [tuple(r) for r in periodic_runs(docs, plant=True).collect()]
    assert sorted(map(str, got)) == sorted(map(str, wanted))
    assert periodic_runs(docs.limit(0)).count() == 0
