"""Packing: whole coverage, gapless offsets, ids, and the number of sequences."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from sentiloom.llm.packing import SIZE, Tokens, cut_lengths, pack, pack_documents, tokenizer_folder


def sequences(counts: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    """Every slot of the plan, by sequence."""
    runs, out = pack(counts), {}
    for length in range(1, len(counts)):
        mine = np.flatnonzero(runs["length"] == length)
        firsts = runs["first"][mine].tolist()
        assert (firsts[:1] or [0]) == [0] and (counts[length] > 0) == bool(len(mine))
        for run, first, after in zip(mine, firsts, [*firsts[1:], int(counts[length])]):
            assert after > first
            for nth in range(after - first):
                out.setdefault(int(runs["sequence"][run]) + nth, []).append((int(runs["offset"][run]), length))
    return out


def checked(counts: np.ndarray) -> int:
    size, made = len(counts) - 1, sequences(counts)
    for slots in made.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= size
    return len(made)


def best_fit_decreasing(lengths: list[int], size: int) -> int:
    rooms: list[int] = []
    for length in sorted(lengths, reverse=True):
        fits = [k for k, room in enumerate(rooms) if room >= length]
        if fits:
            rooms[min(fits, key=rooms.__getitem__)] -= length
        else:
            rooms.append(size - length)
    return len(rooms)


def histogram(lengths, size: int) -> np.ndarray:
    return np.bincount(np.asarray(lengths, dtype=np.int64), minlength=size + 1)


@pytest.mark.parametrize("lengths", [[], [1], [5] * 7, [64] * 3, [33] * 50, [40, 24] * 30])
def test_small_plans(lengths):
    assert checked(histogram(lengths, 64)) == best_fit_decreasing(lengths, 64)


def test_number_of_sequences():
    rng = np.random.default_rng(3)
    for lengths in (rng.integers(1, 257, 4000), np.clip(rng.normal(85, 12, 4000), 1, 256).astype(int), rng.choice([86, 85, 129, 87, 37], 4000)):
        made = checked(histogram(lengths, 256))
        assert made <= 1.01 * best_fit_decreasing(lengths.tolist(), 256)


def test_large_counts():
    counts = np.bincount(np.clip(np.random.default_rng(5).lognormal(4, 1, 5000), 1, 256).astype(int), minlength=257) * 10**8
    runs = pack(counts)
    assert len(runs["length"]) < 50_000
    after = np.append(runs["first"][1:], 0)
    ends = np.where(np.append(runs["length"][1:], 0) == runs["length"], after, counts[runs["length"]])
    total = int((runs["sequence"] + ends - runs["first"]).max())
    assert total <= 1.01 * (counts * np.arange(257)).sum() / 256


def test_both_encoders_agree():
    tokens, rnd = Tokens(tokenizer_folder()), random.Random(7)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{chr(c)}{chr(c)}b1{chr(c)}2 {chr(c)}.{chr(c)}'s {chr(c)}" for c in [*points[:0x600], *points[0x2000:0x2100], *points[::97]]]
    texts += ["".join(chr(rnd.choice(points[:0x500])) for _ in range(rnd.randint(0, 200))) for _ in range(500)]
    texts += ["", "  \n\n x", "<|endoftext|> a", " " * 200_000 + "x", "a" * 200_000]
    whole = tokens.whole.encode_batch_fast(texts, add_special_tokens=False)
    assert all(tokens.ids(text).tolist() == one.ids for text, one in zip(texts, whole))


def test_documents(spark):
    rnd = random.Random(1)
    texts = [" ".join(rnd.choice(["alpha", "be", "ta\n", "Größe", "7"]) for _ in range(rnd.choice([0, 1, 40, 700, 5000]))) for _ in range(60)]
    rows = [(k, text, "x", k) for k, text in enumerate(texts)] + [(None, None, "x", 1), (None, "a b", "x", 1), (3, texts[3], "x", 2), (3, "", "x", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string, task long").repartition(5)
    got = [tuple(r) for r in pack_documents(docs).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset").collect()]
    tokens, wanted = Tokens(tokenizer_folder()), []
    for doc_id, text, *_ in rows:
        ids = np.append(tokens.ids(text or ""), 0).astype("<u4")
        start = 0
        for piece, length in enumerate(cut_lengths(len(ids), SIZE)):
            wanted.append((doc_id, piece, start, length, zlib.crc32(ids[start : start + length].tobytes())))
            start += length
        assert start == len(ids)
    assert sorted(map(str, wanted)) == sorted(str(r[:5]) for r in got)
    for sequence in {r[5] for r in got}:
        at = 0
        for _, _, _, length, _, _, offset in sorted((r for r in got if r[5] == sequence), key=lambda r: r[6]):
            assert offset == at
            at += length
        assert at <= SIZE
    assert len({r[5] for r in got}) <= best_fit_decreasing([r[3] for r in got], SIZE) + 1
    assert pack_documents(docs.limit(0)).count() == 0
