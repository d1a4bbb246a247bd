"""Packing documents into sequences by a configuration linear program.

Texts become token ids and an end id; those longer than a sequence are cut into whole sequences, the first piece taking the remainder.  Only the
number of pieces of each length matters for the packing, so the driver gets one row per length (at most ``size``) and plans there.

A configuration is a multiset of lengths that fits one sequence; the program covers all pieces with as few configurations as possible.
Multiplicative weights solve it: each length has a price, an unbounded knapsack finds by dynamic programming the best filling of every capacity at
these prices, which gives a column for every length at once (that length and the best filling beside it).  Columns count by how near they come to
the best value; prices fall where a length was asked for more than it has and rise where less.  Rounding goes on at these prices: in each round
the columns near the best take their share of what is left, in whole copies.  What no column wants any more goes, longest first, to the
sequence it fits best.  All steps work on counts of equal lengths, so planning costs the same for any number of documents (some four seconds).

The plan lists runs of equal slots: length, first slot, first sequence, offset.  Each task numbers its pieces of a length while it makes
them; the sums of the tasks before it turn that into a global number, hence a slot.  No text and no id is shuffled, and a length that holds a
third of all pieces is dealt out like any other.
"""

from __future__ import annotations

import base64
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentiloom.llm.common import stored, table
from sentiloom.llm.registry import llm_query

SIZE = 2048
END = 0
WARM = 80  # rounds that only move the prices
ROUNDS = 12  # rounds in which the pieces are shared out
_STEP = 0.5  # learning rate of the prices
_NEAR = 0.02  # a column this share below the best counts 1/e as much
_MOST_ROUNDS = 96
_PLAN_RUNS = 4_000_000  # 128 MB; rounds x lengths x pieces of a configuration stay far below it


class Tokens:
    """Ids of whole texts by the tokenizer in ``folder``/byte_bpe_50k.json, without special tokens added.

    The library's own encoder takes half a second a megabyte, so the same vocabulary, stored as ranks, is read by tiktoken's; the two agree on
    every code point (tests).  Texts that hold an added token's string or that the faster one refuses go to the first.
    """

    def __init__(self, folder: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(f"{folder}/byte_bpe_50k.json")
        self.added = [token.content for token in self.whole.get_added_tokens_decoder().values()]
        with open(f"{folder}/byte_bpe_50k.tiktoken", "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if not any(token in text for token in self.added):
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=())
            except ValueError:  # its pattern needs too much stack for a very long stretch of blanks
                pass
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


_tokens: dict[str, Tokens] = {}


def tokenizer_folder() -> str:
    import public_tokenizers

    return os.path.dirname(public_tokenizers.path("byte_bpe_50k.json"))


def _best_fillings(prices: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unbounded knapsack: worth of the best filling of each capacity, its longest-first choice, and the tokens it really uses."""
    size = len(prices) - 1
    worth, pick, used = np.zeros(size + 1), np.zeros(size + 1, dtype=np.int64), np.zeros(size + 1, dtype=np.int64)
    falling = prices[::-1].copy()
    for room in range(1, size + 1):
        offers = falling[size - room : size] + worth[:room]  # of the lengths room, room - 1, ..., 1
        best = int(offers.argmax())
        if offers[best] > worth[room - 1]:
            worth[room], pick[room], used[room] = offers[best], room - best, room
        else:
            worth[room], used[room] = worth[room - 1], used[room - 1]
    return worth, pick, used


def _filling(pick: np.ndarray, used: np.ndarray, room: int) -> dict[int, int]:
    out: dict[int, int] = {}
    room = int(used[room])
    while room:
        length = int(pick[room])
        out[length] = out.get(length, 0) + 1
        room = int(used[room - length])
    return out


def _turn(left: np.ndarray, share: np.ndarray, prices: np.ndarray, step: float, near: float | None, plan: list) -> np.ndarray:
    """One round: columns for every length at ``prices``; whole copies of those at most ``near`` below the best go from ``left`` into ``plan``
    (none if ``near`` is None).  Returns the new prices."""
    size, here = len(left) - 1, left > 0
    worth, pick, used = _best_fillings(np.where(here, prices, -1.0))
    due, asked = share.copy(), np.zeros(size + 1)
    for length in np.flatnonzero(share)[::-1].tolist():
        if due[length] <= 0 or not left[length]:
            continue
        column = _filling(pick, used, size - length)
        column[length] = column.get(length, 0) + 1
        lengths, times = np.fromiter(column, np.int64, len(column)), np.fromiter(column.values(), np.int64, len(column))
        copies = -(-int(due[length]) // column[length])
        below = 1 - (prices[length] + worth[size - length]) / worth[size]
        asked[lengths] += copies * times * np.exp(-below / _NEAR)
        if near is None:
            due[lengths] -= copies * times
        elif below <= near and (copies := min(copies, int((left[lengths] // times).min()))):
            left[lengths] -= copies * times
            due[lengths] -= copies * times
            plan.append((copies, column))
    return prices * np.where(here, np.exp(step * (1 - np.minimum(asked / np.maximum(share, 1), 3))), 1.0)


def solve(counts: np.ndarray, rounds: int = ROUNDS) -> tuple[list[tuple[int, dict[int, int]]], np.ndarray]:
    """Whole copies of configurations for ``counts`` pieces of each length (index 0 unused), and the pieces left over."""
    size = len(counts) - 1
    left, plan = counts.copy(), []
    prices, idle = np.arange(size + 1) / size, 0
    for turn in range(WARM):
        prices = _turn(left, left, prices, _STEP / (1 + turn / 8), None, plan)
    for turn in range(_MOST_ROUNDS):
        before = int(left.sum())
        if before <= 2 * size and turn >= rounds or idle > 8:
            break
        prices = _turn(left, -(-left // max(1, rounds - turn)), prices, _STEP / 4, _NEAR if turn < rounds else 1.0, plan)
        idle = idle + 1 if turn >= rounds and before - int(left.sum()) < before // 64 else 0
    return plan, left


def pack(counts: np.ndarray, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Runs of slots for ``counts`` pieces of each length: ``length``, ``first`` (slot of that length), ``sequence`` (of the first slot, the
    next slots follow) and ``offset``, sorted by length and first slot; every piece has one slot and sequences are filled from 0 on."""
    size = len(counts) - 1
    plan, left = solve(counts, rounds)
    opened: dict[int, list] = {}  # by free room: (first sequence, copies, lengths so far)
    free, total = np.zeros(size + 1, dtype=np.int64), 0

    def add(first: int, copies: int, lengths: list[int]) -> None:
        room = size - sum(lengths)
        opened.setdefault(room, []).append((first, copies, lengths))
        free[room] += copies

    for copies, column in plan:
        add(total, copies, [length for length in sorted(column, reverse=True) for _ in range(column[length])])
        total += copies
    for length in range(size, 0, -1):
        need = int(left[length])
        while need:
            rooms = np.flatnonzero(free[length:])
            if len(rooms):
                room = int(rooms[0]) + length
                first, copies, lengths = opened[room].pop()
                take = min(need, copies)
                free[room] -= copies
                if take < copies:
                    add(first + take, copies - take, lengths)
                add(first, take, [*lengths, length])
                need -= take
            else:
                each = size // length
                fresh = max(1, need // each)
                add(total, fresh, [length] * min(each, need))
                total, need = total + fresh, need - fresh * min(each, need)
    slots: list[tuple[int, int, int, int]] = []
    for first, copies, lengths in sorted(group for groups in opened.values() for group in groups):
        at = 0
        for length in lengths:
            slots.append((length, copies, first, at))
            at += length
    if len(slots) > _PLAN_RUNS:
        raise ValueError(f"the plan has {len(slots)} runs of slots")
    runs = np.array(slots, dtype=np.int64).reshape(-1, 4)
    runs = runs[np.argsort(runs[:, 0], kind="stable")]
    ends = np.cumsum(runs[:, 1])
    starts = ends - runs[:, 1]
    begins = starts[np.searchsorted(runs[:, 0], runs[:, 0])]
    return {"length": runs[:, 0], "first": starts - begins, "sequence": runs[:, 2], "offset": runs[:, 3]}


def cut_lengths(n: int, size: int) -> list[int]:
    """Lengths of the pieces of ``n`` tokens: whole sequences, the first piece takes the remainder."""
    head = n % size
    return ([head] if head else []) + [size] * (n // size)


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                     ("task", pa.int64()), ("nth", pa.int64())])


def pieces(docs: DataFrame, size: int = SIZE, folder: str | None = None) -> DataFrame:
    """A row per piece of each text, numbered within its task and length."""
    place = folder or tokenizer_folder()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if place not in _tokens:
            _tokens[place] = Tokens(place)
        tokens, task = _tokens[place], TaskContext.get().partitionId()
        seen = np.zeros(size + 1, dtype=np.int64)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(tokens.ids(text.as_py() or ""), np.uint32(END)).astype("<u4")
                start = 0
                for piece, length in enumerate(cut_lengths(len(ids), size)):
                    rows.append((doc_id, piece, start, length, zlib.crc32(ids[start : start + length].tobytes()), task, int(seen[length])))
                    seen[length] += 1
                    start += length
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PIECES)], schema=_PIECES)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, nth long"
    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, schema)


def pack_documents(docs: DataFrame, size: int = SIZE, folder: str | None = None, rounds: int = ROUNDS) -> DataFrame:
    """``docs`` cut and packed: doc_id, piece, start, length, ids_crc32, sequence_id, offset, a row per piece.

    A null or empty text is the end id alone.  Each row is a document of its own: rows without a doc_id, repeated rows and equal ids are
    packed like any other, so all their pieces are there.  An empty table gives no rows; other columns are ignored.  The pieces are
    written to the shared folder once, because their numbers must not change between counting and placing them.
    """
    made = stored(pieces(docs, size, folder), "pieces")
    held = made.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(size + 1, dtype=np.int64)
    for length, n in held.groupBy("length").agg(F.sum("n")).collect():  # at most ``size`` rows
        counts[length] = n
    plan = pack(counts, rounds)
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = held.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    numbered = made.join(bases, ["task", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("slot"))
    shared = docs.sparkSession.sparkContext.broadcast(plan)  # runs of slots: bounded by ``_PLAN_RUNS``, checked in ``pack``

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = shared.value
        span = np.int64(1) << np.int64(50)
        keys = runs["length"] * span + runs["first"]
        for batch in batches:
            length, slot = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            at = np.searchsorted(keys, length * span + slot, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(runs["sequence"][at] + slot - runs["first"][at]), pa.array(runs["offset"][at])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return numbered.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


@llm_query("op11_packing")
def op11(spark, folder):
    return pack_documents(table(spark, folder, "documents"))
