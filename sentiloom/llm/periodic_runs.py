"""Periodic runs of words by recompression.

A run is a stretch of words with smallest period q that is at least ``max(12, 2 q)`` words long and cannot be extended with that period.
The words of a text get numbers.  Recompression then shortens the sequence in turns: a block step replaces each maximal repetition of one
symbol by one symbol, a pair step splits the alphabet in two by a fixed bit of the symbols and replaces each neighbouring pair (left side, right
side) by one symbol.  Equal stretches are parsed alike but for a few symbols at their ends, so the levels form a run-length grammar that
answers how far the text agrees from two places on: climb while the symbols agree, then descend and compare what is left.  Names are given by
sorting whole pairs, so the answers are exact; no suffix array is built.

Two words p apart that agree are a candidate of period p.  The agreeing stretch of a run is at least ``max(p, 12 - p)`` long, so it holds a
multiple of that number: only such places are tried (n ln n of them for all periods).  A candidate must agree at three more words on one
side, which any stretch of six does, before the grammar extends it to both sides.  Stretches with the same ends keep their least period.

Rows are independent: no shuffle.  A task gathers short texts of similar length into groups of bounded size, separated by symbols that occur
once, so that numpy works on long arrays; a very long text is a group of its own and takes memory in proportion to its words.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sentiloom.llm.common import mix, table
from sentiloom.llm.registry import llm_query

LEAST = 12  # words of a run
GROUP_WORDS = 1 << 17  # texts are gathered up to about this many words
_CHUNK = 1 << 18  # places tried, and candidates extended, at once
_SIDE = 3  # more agreeing words asked for on one side: a stretch of LEAST / 2 has them


class _Names(dict):
    """Numbers of words in the order of their first use."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


class Grammar:
    """Levels of a recompressed sequence; the last symbol of the sequence must occur once.

    Of each level but the last: ``up``, the next level's symbol that holds a symbol; ``first``, whether it is the first in it; ``left``, how
    many equal symbols follow in it, itself included.  ``down``: the first symbol, one level below, of each symbol.
    """

    def __init__(self, symbols: np.ndarray):
        symbols = symbols.astype(np.int64)
        self.symbols, self.up, self.first, self.left, self.down = [symbols.astype(np.int32)], [], [], [], [None]
        free, turn, stuck = int(symbols.max(initial=0)) + 1, 0, 0
        while len(symbols) > 2 and stuck < 24:
            n = len(symbols)
            if turn % 2 == 0:
                heads = np.flatnonzero(np.concatenate(([True], symbols[1:] != symbols[:-1])))
                lengths = np.diff(np.append(heads, n))
                made, several = symbols[heads], lengths > 1
                second = lengths[several]
            else:
                bit = mix((symbols + (turn << 40)).astype(np.uint64)) & np.uint64(1)
                joins = bit[:-1] < bit[1:]
                heads = np.flatnonzero(np.concatenate(([True], ~joins)))
                made, several = symbols[heads], np.append(joins, False)[heads]
                second = symbols[heads[several] + 1]
            turn += 1
            stuck = stuck + 1 if len(heads) == n else 0
            if len(heads) == n:
                continue
            kinds, number = np.unique((made[several] << np.int64(32)) | second, return_inverse=True)
            made = made.copy()
            made[several] = free + number
            free += len(kinds)
            ends = np.append(heads[1:], n)
            first = np.zeros(n, dtype=bool)
            first[heads] = True
            up = np.cumsum(first, dtype=np.int32) - 1
            self.first.append(first)
            self.up.append(up)
            self.left.append((ends[up] - np.arange(n)).astype(np.int32) if turn % 2 else np.ones(n, dtype=np.int32))
            self.down.append(heads.astype(np.int32))
            symbols = made
            self.symbols.append(symbols.astype(np.int32))

    def agreement(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols of the sequence agree from places ``i`` and ``j`` on (i <> j everywhere)."""
        a, b = i.astype(np.int64), j.astype(np.int64)
        stopped = np.full(len(a), -1, dtype=np.int64)
        rising, top = np.arange(len(a)), len(self.symbols) - 1
        for level in range(top):
            symbols, first, left, up = self.symbols[level], self.first[level], self.left[level], self.up[level]
            waiting = rising
            ready = []
            while len(waiting):
                x, y = a[waiting], b[waiting]
                same = symbols[x] == symbols[y]
                stopped[waiting[~same]] = level
                waiting, x, y = waiting[same], x[same], y[same]
                even = first[x] & first[y]
                ready.append(waiting[even])
                waiting, x, y = waiting[~even], x[~even], y[~even]
                step = np.minimum(left[x], left[y])
                a[waiting] += step
                b[waiting] += step
            rising = np.concatenate(ready) if ready else rising[:0]
            a[rising], b[rising] = up[a[rising]], up[b[rising]]
            if not len(rising):
                break
        stopped[rising] = top
        falling = np.zeros(0, dtype=np.int64)
        for level in range(int(stopped.max(initial=-1)), -1, -1):
            falling = np.concatenate((falling, np.flatnonzero(stopped == level)))
            symbols, left = self.symbols[level], self.left[level] if level < top else None
            going = falling
            while len(going):
                x, y = a[going], b[going]
                same = symbols[x] == symbols[y]
                going, x, y = going[same], x[same], y[same]
                step = np.minimum(left[x], left[y]) if left is not None else 1
                a[going] += step
                b[going] += step
            if level:
                down = self.down[level]
                a[falling], b[falling] = down[a[falling]], down[b[falling]]
        return a - i


def _agree(symbols: np.ndarray, i: np.ndarray, p: np.ndarray) -> np.ndarray:
    last = len(symbols) - 1
    return symbols[np.clip(i, 0, last)] == symbols[np.clip(i + p, 0, last)]


def _candidates(symbols: np.ndarray, most: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and periods up to ``most`` at which a run may be: on the harmonic grid, agreeing there and at three words on one side."""
    n = len(symbols)
    periods = np.arange(1, most + 1)
    grids = np.maximum(periods, least - periods)
    counts = np.maximum(0, -(-(n - periods) // grids))
    bounds = np.searchsorted(np.cumsum(counts), np.arange(_CHUNK, int(counts.sum()) + _CHUNK, _CHUNK), side="left") + 1
    start = 0
    for stop in np.unique(np.minimum(bounds, most)):
        each = counts[start:stop]
        p = np.repeat(periods[start:stop], each)
        nth = np.arange(len(p)) - np.repeat(np.cumsum(each) - each, each)
        i = nth * np.repeat(grids[start:stop], each)
        start = stop
        hit = symbols[i] == symbols[i + p]
        i, p = i[hit], p[hit]
        right, left = np.ones(len(i), dtype=bool), np.ones(len(i), dtype=bool)
        for k in range(1, _SIDE + 1):
            right &= _agree(symbols, i + k, p)
            left &= _agree(symbols, i - k, p)
        yield i[right | left], p[right | left]


def find_runs(symbols: np.ndarray, longest: int, least: int = LEAST) -> np.ndarray:
    """Runs of a sequence whose first and last symbol occur once, as rows (start, end, period) in order.

    ``longest`` bounds the length of a stretch without a symbol that occurs once.
    """
    if longest < least:
        return np.zeros((0, 3), dtype=np.int64)
    n, found = len(symbols), np.zeros((0, 3), dtype=np.int64)
    ahead = back = None
    for places, periods in _candidates(symbols, longest // 2, least):
        for s, e, q in found[np.argsort(found[:, 0] - found[:, 1])[:8]]:  # inside a known run its multiples say nothing new
            if e - s > 4 * least and len(places):
                new = (places < s) | (places + periods >= e) | (periods % q != 0)
                places, periods = places[new], periods[new]
        if not len(places):
            continue
        if ahead is None:
            ahead, back = Grammar(symbols), Grammar(symbols[::-1])
        for k in range(0, len(places), _CHUNK):
            i, p = places[k : k + _CHUNK], periods[k : k + _CHUNK]
            start = i - back.agreement(n - i, n - i - p)
            end = i + p + ahead.agreement(i, i + p)
            whole = end - start >= np.maximum(least, 2 * p)
            found = np.concatenate((found, np.stack((start[whole], end[whole], p[whole]), axis=1)))
            found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
            if len(found):
                found = found[np.concatenate(([True], (found[1:, :2] != found[:-1, :2]).any(axis=1)))]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def runs_of(texts: list[list[bytes]], least: int = LEAST) -> list[np.ndarray]:
    """Runs of each sequence of words, rows (start, end, period) by start, then period."""
    names, sizes = _Names(), np.array([len(t) for t in texts], dtype=np.int64)
    symbols = np.empty(int(sizes.sum()) + len(texts) + 1, dtype=np.int64)
    begins = np.cumsum(sizes + 1) - sizes
    for begin, size, text in zip(begins, sizes, texts):
        symbols[begin : begin + size] = np.fromiter(map(names.__getitem__, text), np.int64, size)
    borders = np.append(begins - 1, len(symbols) - 1)
    symbols[borders] = len(names) + np.arange(len(borders))
    runs = find_runs(symbols, int(sizes.max(initial=0)), least)
    owner = np.searchsorted(begins, runs[:, 0], side="right") - 1
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [runs[a:b] - np.array([begin, begin, 0]) for a, b, begin in zip(cuts, cuts[1:], begins)]


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a document as the query reads them: the end of every tenth is made periodic; without a doc_id they stay."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    piece = words[a : a + p]
    return words[:a] + (piece * (-(-(n - a) // p)))[: n - a]


def digest_row(words: list[bytes], runs: np.ndarray) -> tuple:
    lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in runs.tolist())
    best: list[int | None] = [None] * 4
    kept = words
    if len(runs):
        s, e, q = min(runs.tolist(), key=lambda r: (r[0] - r[1], r[0], r[2]))
        best = [s, e - s, q, 1000 * (e - s) // q]
        cover = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(cover, runs[:, 0] + runs[:, 2], 1)
        np.add.at(cover, runs[:, 1], -1)
        kept = [words[k] for k in np.flatnonzero(np.cumsum(cover[:-1]) == 0).tolist()]
    return (len(runs), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()),
                     ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])


def _rows(group: list[tuple[int | None, list[bytes]]], least: int) -> pa.RecordBatch:
    runs = runs_of([words for _, words in group], least)
    rows = [(doc_id, *digest_row(words, r)) for (doc_id, words), r in zip(group, runs)]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)


def periodic_runs(docs: DataFrame, plant: bool = False, least: int = LEAST) -> DataFrame:
    """Number of runs, longest run, digest of all runs and of the text without repeated periods, a row per row of ``docs``.

    Words are maximal runs of characters other than space and ``\\t \\n \\v \\f \\r``, case kept.  Null and empty texts have no runs and the
    digests of nothing; repeated rows and rows without a doc_id are texts like any other; ties for the longest go to the smallest
    start, then period.  ``plant`` makes the ends of some texts periodic first (see :func:`planted`).  Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = {}
        held: dict[int, int] = {}
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = (text.as_py() or "").encode().split()
                if plant:
                    words = planted(doc_id, words)
                kind = len(words).bit_length() // 2  # texts of similar length, so that few periods are tried on too short ones
                waiting.setdefault(kind, []).append((doc_id, words))
                held[kind] = held.get(kind, 0) + len(words) + 16
                if held[kind] >= GROUP_WORDS:
                    yield _rows(waiting.pop(kind), least)
                    held[kind] = 0
        for group in waiting.values():
            yield _rows(group, least)

    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, schema)


@llm_query("op13_periodic_runs")
def op13(spark, folder):
    return periodic_runs(table(spark, folder, "documents"), plant=True)
