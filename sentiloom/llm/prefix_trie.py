"""Prefix trie of conversations: members, children, leaves, tokens saved by sharing, and who ends where, for every distinct prefix.

Turns are slim: a digest of role and text, and the number of characters.  The digest of a prefix is the sum of the digests of (place, turn) in four
lanes of 32 bits, so prefix digests are running totals over a range sort and a conversation of any length spans several tasks.  Grouping by
them enumerates the prefixes; a group whose rows differ in place or last turn stops the job, so that by induction equal digests are equal prefixes.

Prefixes with the same members form a chain without branches, named by its least conversation and their number: only such chains need a
table.  Chains of one conversation are answered at once.  The others are cut into shards, subtrees of a bounded number of
members, found by pointer doubling.  In each shard a minimal perfect hash (a cascade of bitmaps, ranked) gives a chain its slot; the key kept
in a slot is compared, so a foreign key is never taken for one.  Counts are scattered into flat arrays over the slots and added up through
the array of parent slots, deepest chains first.  The chains above the shards get their sums, and one more table of the same kind covers
them: there are at most (conversations / members of a shard) x (branches on a path) of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentiloom.llm.common import mix, seeds, stored, table
from sentiloom.llm.registry import llm_query
from sentiloom.operators.joins import group_join
from sentiloom.operators.ranking import running_totals, with_group_position

FAMILY = 100  # conversations that start alike
MOST_HEAD = 5
LEAST_SHARD, MOST_SHARD, SHARDS = 1_000, 500_000, 1_000  # members of a shard: a thousandth of all, between these
_ROWS = 100_000  # chains of a task
_CHUNK = 512  # ids of a piece of a digest's text
_LANES = ["e0", "e1", "e2", "e3"]


class SlotTable:
    """Minimal perfect hash over distinct pairs of integers, with the pairs kept in slot order."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.levels: list[tuple[np.uint64, np.ndarray, np.ndarray]] = []
        waiting, taken = np.arange(len(a)), 0
        slots = np.empty(len(a), dtype=np.int64)
        for seed in seeds(64, 12):
            if not len(waiting):
                break
            at = self._place(a[waiting], b[waiting], seed, 2 * len(waiting))
            alone = np.bincount(at, minlength=2 * len(waiting)) == 1
            rank = (taken + np.cumsum(alone) - 1).astype(np.int64)
            self.levels.append((seed, alone, rank))
            hit = alone[at]
            slots[waiting[hit]] = rank[at[hit]]
            waiting, taken = waiting[~hit], taken + int(alone.sum())
        if len(waiting):
            raise ValueError("keys are not distinct")
        self.own = slots
        self.a, self.b = np.empty_like(a), np.empty_like(b)
        self.a[slots], self.b[slots] = a, b

    @staticmethod
    def _place(a: np.ndarray, b: np.ndarray, seed: np.uint64, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix(mix(a.astype(np.uint64) ^ seed) + b.astype(np.uint64)) % np.uint64(size)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slots of pairs; -1 for a pair that is not in the table."""
        out, waiting = np.full(len(a), -1, dtype=np.int64), np.arange(len(a))
        for seed, alone, rank in self.levels:
            at = self._place(a[waiting], b[waiting], seed, len(alone))
            hit = alone[at]
            out[waiting[hit]] = rank[at[hit]]
            waiting = waiting[~hit]
        known = out >= 0
        known[known] = (self.a[out[known]] == a[known]) & (self.b[out[known]] == b[known])
        return np.where(known, out, -1)


def accumulate(conv: np.ndarray, members: np.ndarray, up_conv: np.ndarray, up_members: np.ndarray, depth: np.ndarray, children: np.ndarray,
               leaves: np.ndarray, saved: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Children, leaves and saved characters of whole subtrees, from what each chain has by itself and from outside the table.

    A parent that is not in the table (-1 in ``up_members`` where there is none) gets nothing.
    """
    slots = SlotTable(conv, members)
    parent = slots.find(up_conv, up_members)
    flat = np.zeros((3, len(conv)), dtype=np.int64)
    flat[0, slots.own], flat[2, slots.own] = children, saved
    np.add.at(flat[0], parent[parent >= 0], 1)
    flat[1, slots.own] = leaves
    flat[1, flat[0] == 0] = 1
    order = np.argsort(-depth, kind="stable")
    order = order[parent[order] >= 0]
    _, starts = np.unique(-depth[order], return_index=True)
    for level in np.split(order, starts[1:]):
        np.add.at(flat[1], parent[level], flat[1, slots.own[level]])
        np.add.at(flat[2], parent[level], flat[2, slots.own[level]])
    return tuple(flat[:, slots.own])


_TOTALS = "conv_id long, n_convs long, tail long, up_conv long, up_members long, n_children long, n_leaves long, total long"


def _tables(chains: DataFrame) -> DataFrame:
    """A slot table per partition of ``chains``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        whole = pa.Table.from_batches(parts)
        conv, members, tail, up_conv, up_members, depth, children, leaves, saved = (
            whole.column(c).combine_chunks().fill_null(-1).to_numpy(zero_copy_only=False) for c in whole.column_names)
        children, leaves, total = accumulate(conv, members, up_conv, up_members, depth, children, leaves, saved)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (conv, members, tail, up_conv, up_members, children, leaves, total)],
                                         names=[c.split()[0] for c in _TOTALS.split(", ")])

    return chains.select("conv_id", "n_convs", "tail", "up_conv", "up_members", "depth", "n_children", "n_leaves", "saved").mapInArrow(run, _TOTALS)


def head_length(conv_id: Column) -> Column:
    """How many turns a conversation borrows."""
    return F.crc32(conv_id.cast("string").cast("binary")) % (MOST_HEAD + 1)


def _hex(digest: Column, start: int, digits: int) -> Column:
    return F.conv(F.substring(digest, start, digits), 16, 10).cast("long")


def paths(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations: (conv_id, length), and a row per turn: conv_id, depth, a, b (digest of the turn), chars, length, e0-e3 (of place and turn)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.sha2(text, 256).alias("said"),
        F.length(text).cast("long").alias("chars"))
    turns = with_group_position(turns, ["conv_id"], [F.col("turn").asc_nulls_first(), "role", "said"])
    digest = F.sha2(F.concat_ws(":", F.length("role"), "role", "said"), 256)
    rows = stored(turns.select("conv_id", "pos", F.col("group_size").alias("own"), _hex(digest, 1, 15).alias("a"), _hex(digest, 16, 15).alias("b"), "chars"),
                  "turns")
    heads = rows.filter(f"conv_id % {FAMILY} = 0 AND pos < {MOST_HEAD}").groupBy(F.col("conv_id").alias("base")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "a", "b", "chars"))).alias("head"))
    h = head_length(F.col("conv_id"))
    convs = rows.groupBy("conv_id").agg(F.min("own").alias("own")).withColumn("base", F.expr(f"conv_id - conv_id % {FAMILY}")).join(heads, "base", "left")
    head = F.slice(F.coalesce("head", F.array().cast("array<struct<pos:bigint,a:bigint,b:bigint,chars:bigint>>")), 1, h.cast("int"))
    convs = stored(convs.select("conv_id", head.alias("head"), (F.size(head) + F.greatest(F.lit(0), F.col("own") - h)).cast("long").alias("length"),
                                F.size(head).cast("long").alias("borrowed")), "conversations")
    lead = convs.select("conv_id", "length", F.posexplode("head").alias("at", "t")).select(
        "conv_id", (F.col("at") + 1).cast("long").alias("depth"), "t.a", "t.b", "t.chars", "length")
    rest = group_join(rows.filter(F.col("pos") >= h), convs.select("conv_id", "length", "borrowed"), ["conv_id"]).select(
        "conv_id", (F.col("borrowed") + F.col("pos") - h + 1).cast("long").alias("depth"), "a", "b", "chars", "length")
    placed = F.sha2(F.concat_ws(":", "depth", "a", "b"), 256)
    return convs.select("conv_id", "length"), lead.unionByName(rest).withColumns({c: _hex(placed, 8 * k + 1, 8) for k, c in enumerate(_LANES)})


def _key(lanes: list[Column]) -> list[Column]:
    low = [F.pmod(x, F.lit(1 << 32)) for x in lanes]
    return [F.shiftleft(low[k], 32).bitwiseOR(low[k + 1]).alias(n) for k, n in ((0, "k1"), (2, "k2"))]


def _ends(path: DataFrame, convs: DataFrame) -> DataFrame:
    """Digest of the ids that end at each prefix.  Ids become pieces of text in sorted order; a digest then reads few rows, also of a hot prefix."""
    last = path.filter("depth = length").select("k1", "k2", "conv_id").unionByName(
        convs.filter("length = 0").select(F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), "conv_id"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            k1, k2, conv = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            starts = np.flatnonzero(np.concatenate(([True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]))))
            stops = np.append(starts[1:], len(conv))
            cuts = np.concatenate([np.arange(a, b, _CHUNK) for a, b in zip(starts, stops)])
            ids = conv.tolist()
            ends = np.append(cuts[1:], len(conv)).tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(k1[cuts]), pa.array(k2[cuts]), pa.array(conv[cuts]), pa.array([",".join(map(str, ids[a:b])) for a, b in zip(cuts.tolist(), ends)])],
                names=["k1", "k2", "first", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, running, out = None, None, []

        def batch_of(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["k1", "k2", "ends_sha256"])

        for batch in batches:
            for k1, k2, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)):
                if (k1, k2) != now:
                    if running is not None:
                        out.append((*now, running.hexdigest()))
                    now, running = (k1, k2), hashlib.sha256()
                    running.update(ids.as_py().encode())
                else:
                    running.update(b"," + ids.as_py().encode())
            if out:
                yield batch_of(out)
                out = []
        if running is not None:
            yield batch_of([(*now, running.hexdigest())])

    chunks = last.orderBy("k1", "k2", "conv_id").mapInArrow(pieces, "k1 long, k2 long, first long, ids string")
    return chunks.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first").mapInArrow(digests, "k1 long, k2 long, ends_sha256 string")


def _shards(low: DataFrame, bound: int) -> DataFrame:
    """Chains with the topmost chain of their shard (shard_conv, shard_members), by pointer doubling: rounds grow with the logarithm of the branches on a path."""
    inside = F.coalesce(F.col("up_members") <= bound, F.lit(False))
    low = stored(low.withColumns({"shard_conv": F.when(inside, F.col("up_conv")).otherwise(F.col("conv_id")),
                                  "shard_members": F.when(inside, F.col("up_members")).otherwise(F.col("n_convs"))}), "shards")
    while True:
        ups = low.select(F.col("conv_id").alias("_c"), F.col("n_convs").alias("_n"), F.col("shard_conv").alias("_sc"), F.col("shard_members").alias("_sn"))
        moved = (F.col("_sc") != F.col("shard_conv")) | (F.col("_sn") != F.col("shard_members"))
        low = stored(low.join(ups, (low["shard_conv"] == ups["_c"]) & (low["shard_members"] == ups["_n"])).withColumn("_moved", moved).withColumns(
            {"shard_conv": F.col("_sc"), "shard_members": F.col("_sn")}).drop("_c", "_n", "_sc", "_sn"), "shards")
        going, low = low.filter("_moved"), low.drop("_moved")
        if going.isEmpty():
            return low


def prefix_trie(conversations: DataFrame, least_shard: int = LEAST_SHARD) -> DataFrame:
    """Every distinct prefix of the rebuilt conversations; see the query for the columns.

    Turns go by number (null first), then role, then digest of the text; null roles and texts are empty, repeated rows are turns of their own.
    Rows without a conv_id belong to no conversation and are left out.  An empty table gives no rows, not even a root; other
    columns are ignored.
    """
    convs, turns = paths(conversations)
    sums = running_totals(turns, ["conv_id"], ["depth"], _LANES)
    up = [x.alias(n) for x, n in zip(_key([F.col(f"cum_{c}") - F.col(c) for c in _LANES]), ("p1", "p2"))]
    path = stored(sums.select("conv_id", "depth", "a", "b", "chars", "length", *_key([F.col(f"cum_{c}") for c in _LANES]), *up), "paths")

    differ = F.lit(False)
    for c in ("depth", "a", "b"):
        differ = differ | (F.min(c) != F.max(c))
    depth = F.when(differ, F.raise_error(F.lit("two prefixes have one digest")).cast("long")).otherwise(F.min("depth"))
    nodes = path.groupBy("k1", "k2").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), depth.alias("depth"), F.min("chars").alias("chars"), F.min("p1").alias("p1"),
        F.min("p2").alias("p2"), F.max(F.col("length") > F.col("depth")).alias("goes_on"))
    nothing = F.lit(0).cast("long")
    root = convs.groupBy(nothing.alias("k1"), nothing.alias("k2")).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), nothing.alias("depth"), nothing.alias("chars"),
        F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"), F.max(F.col("length") > 0).alias("goes_on"))
    nodes = stored(nodes.unionByName(root), "prefixes")
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("up_conv"), F.col("n_convs").alias("up_members"))
    nodes = stored(nodes.join(parents, ["p1", "p2"], "left").select(
        "k1", "k2", "conv_id", "n_convs", "depth", "goes_on", "up_conv", "up_members", ((F.col("n_convs") - 1) * F.col("chars")).alias("value")), "prefixes")

    single, shared = nodes.filter("n_convs = 1"), nodes.filter("n_convs > 1")
    branches = single.filter("up_members > 1").groupBy(F.col("up_conv").alias("conv_id"), F.col("up_members").alias("n_convs")).agg(
        F.count(F.lit(1)).alias("n_children"))
    chains = shared.groupBy("conv_id", "n_convs").agg(
        F.min("depth").alias("depth"), F.max("depth").alias("tail"), F.sum("value").alias("saved"), F.min_by("up_conv", "depth").alias("up_conv"),
        F.min_by("up_members", "depth").alias("up_members")).join(branches, ["conv_id", "n_convs"], "left").withColumns({
            "n_children": F.coalesce("n_children", nothing), "n_leaves": F.coalesce("n_children", nothing)})
    chains = stored(chains, "chains")
    members = convs.count()
    bound = max(least_shard, min(MOST_SHARD, members // SHARDS))
    low_count = chains.filter(F.col("n_convs") <= bound).count()
    low = _shards(chains.filter(F.col("n_convs") <= bound), bound)
    done = stored(_tables(low.repartition(-(-low_count // _ROWS) + 7, "shard_conv", "shard_members")), "totals")
    above = done.filter(F.col("up_members") > bound).groupBy(F.col("up_conv").alias("conv_id"), F.col("up_members").alias("n_convs")).agg(
        F.count(F.lit(1)).alias("_c"), F.sum("n_leaves").alias("_l"), F.sum("total").alias("_s"))
    top = chains.filter(F.col("n_convs") > bound).join(above, ["conv_id", "n_convs"], "left").withColumns({
        c: F.col(c) + F.coalesce(x, nothing) for c, x in (("n_children", "_c"), ("n_leaves", "_l"), ("saved", "_s"))})
    totals = done.unionByName(_tables(top.repartition(1))).select("conv_id", "n_convs", "tail", "n_children", "n_leaves", "total")

    runs = running_totals(shared, ["conv_id", "n_convs"], ["depth"], ["value"])
    runs = group_join(runs, totals, ["conv_id", "n_convs"]).select(
        "k1", "k2", "conv_id", "depth", F.col("up_conv").alias("parent_conv_id"), "n_convs",
        F.when(F.col("depth") == F.col("tail"), F.col("n_children")).otherwise(F.lit(1)).cast("long").alias("n_children"), "n_leaves",
        (F.col("total") - F.col("cum_value") + F.col("value")).alias("saved_tokens"))
    alone = single.select("k1", "k2", "conv_id", "depth", F.col("up_conv").alias("parent_conv_id"), "n_convs", F.col("goes_on").cast("long").alias("n_children"),
                          F.lit(1).cast("long").alias("n_leaves"), nothing.alias("saved_tokens"))
    return runs.unionByName(alone).join(_ends(path, convs), ["k1", "k2"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


# crc32 of a decimal number, four bits at a time; its table of sixteen follows from the polynomial.
_NIBBLES = ", ".join(str(x) for x in (lambda step: [step(step(step(step(k)))) for k in range(16)])(lambda v: (v >> 1) ^ (0xEDB88320 if v & 1 else 0)))
_CRC = f"""xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(c AS VARCHAR), ''),
 lambda x: [CAST(ascii(x) & 15 AS BIGINT), CAST(ascii(x) >> 4 AS BIGINT)]))), lambda s, x: xor(s >> 4, ([{_NIBBLES}])[CAST(xor(s, x) & 15 AS INT) + 1])), 4294967295)"""

_SQL = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT c AS conv_id, c - c % 100 AS base, {_CRC} % 6 AS h FROM (SELECT DISTINCT conv_id AS c FROM t)),
r AS (SELECT c.conv_id, 0 AS own, pos, role, text FROM c JOIN t ON t.conv_id = c.base AND t.pos < c.h
 UNION ALL SELECT c.conv_id, 1, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos >= c.h),
p AS (SELECT conv_id, row_number() OVER w AS depth, length(text) AS chars, string_agg(sha256(length(role) || ':' || role || text), ',') OVER w AS key FROM r
  WINDOW w AS (PARTITION BY conv_id ORDER BY own, pos)
 UNION ALL SELECT conv_id, 0, 0, '' FROM c),
m AS (SELECT p.*, depth = max(depth) OVER (PARTITION BY conv_id) AS last FROM p),
n AS (SELECT key, min(conv_id) AS conv_id, min(depth) AS depth, min(chars) AS chars, count(*) AS n_convs,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256 FROM m GROUP BY key),
e AS (SELECT DISTINCT a.key, b.key AS up FROM p a JOIN p b ON a.conv_id = b.conv_id AND a.depth = b.depth + 1),
k AS (SELECT up AS key, count(*) AS n_children FROM e GROUP BY up),
s AS (SELECT p.key, count(*) FILTER (WHERE k.key IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.chars) AS saved_tokens
  FROM n LEFT JOIN k ON k.key = n.key JOIN p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY p.key)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves,
 CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN s ON s.key = n.key LEFT JOIN k ON k.key = n.key LEFT JOIN e ON e.key = n.key LEFT JOIN n u ON u.key = e.up
"""


@llm_query("op12_prefix_trie", _SQL)
def op12(spark, folder):
    """conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: a row per prefix."""
    return prefix_trie(table(spark, folder, "conversations"))
