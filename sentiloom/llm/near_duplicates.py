"""MinHash near-duplicates with odd sketches.

1. Every text becomes its set of five-word shingles.  Equal sets form a class (128-bit digest of the whole set), so exact
   copies cost one row per document and one sketch per class.
2. 225 MinHash samples make 45 bands of 5; a pair at similarity 0.75 misses all of them with probability 5e-6.
3. The same samples are folded into a 512-bit parity bitmap (odd sketch).  The population count of the XOR of two bitmaps
   estimates their similarity; candidates estimated under 0.5 (some five deviations below 0.75) are dropped unread.  A second
   bitmap folds the whole set; its XOR count never exceeds the symmetric difference, so it drops pairs without any risk, and is sharp
   for small sets, where one passage shared by many documents makes large buckets.
4. The rest is confirmed on the full shingle sets.

A bucket never yields all its pairs.  Members have a rank; round ``t`` compares the members of ranks ``[16^(t-1), 16^t)``
(first: rank 0) with the later members *of other components found so far*.  In a group of near copies the first rounds
link nearly all, and later rounds have nothing left to compare.  No rank is left out: the rounds go on until no bucket
holds two components with a rank not yet compared.  Rank 0 is the member with the least digest; the others draw theirs below
the bucket's size from their digest, ties in order of their numbers, so a bucket is never sorted and may span many tasks.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentiloom.llm.common import WORD, long_lists, map_batches, mix, release, row_key, seeds, shingle_set, stored, table
from sentiloom.llm.components import components
from sentiloom.llm.registry import llm_query
from sentiloom.session import cut

BANDS, ROWS, BITS, GROWTH = 45, 5, 512, 16
PERCENT = 75
LEAST_ESTIMATE = 0.5
_SAMPLES = BANDS * ROWS
_LONGS = BITS // 64
_ODD, _WHOLE = [f"o{i}" for i in range(_LONGS)], [f"w{i}" for i in range(_LONGS)]
_CHUNK = 512


def minhash(shingles: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """One 32-bit minimum per hash function ``factor * x + shift``; memory is bounded by the chunk."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(factors), 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(x), _CHUNK):
        block = x[i : i + _CHUNK, None] * factors
        block += shifts
        np.minimum(least, block.min(axis=0), out=least)
    return least


def band_keys(samples: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = samples.reshape(bands, rows).astype(np.uint64)
    key = seeds(bands, 7)
    for j in range(rows):
        key = mix(key ^ parts[:, j]) + np.uint64(j)
    return key


def parity_bitmap(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Parity of the number of hashes at each of ``bits`` places, packed into 64-bit words."""
    parity = np.bincount((hashes % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.uint64)


def odd_sketch(samples: np.ndarray, bits: int) -> np.ndarray:
    """Parity bitmap of MinHash samples, each with the number of its function."""
    return parity_bitmap(mix(samples.astype(np.uint64) ^ seeds(len(samples), 11)), bits)


def most_differing(estimate: float, samples: int = _SAMPLES, bits: int = BITS) -> int:
    """Largest XOR count of two odd sketches whose estimated similarity still reaches ``estimate``."""
    return math.floor(bits / 2 * (1 - math.exp(-4 * samples * (1 - estimate) / bits)))


def _hash_functions() -> tuple[np.ndarray, np.ndarray]:
    return (seeds(_SAMPLES, 3) >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seeds(_SAMPLES, 5) >> np.uint64(32)).astype(np.uint32)


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, class, bands, odd, whole) per row; class is null and the lists are empty without words.

    A column ``key`` of ``docs`` (binary) is carried along.
    """
    factors, shifts = _hash_functions()
    carried = ["key"] if "key" in docs.columns else []

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, classes, bands, odds, wholes = [], [], [], [], []
        none = np.zeros(0, np.uint64)
        for text in batch.column("text"):
            s = shingle_set(text.as_py())
            sizes.append(len(s))
            if len(s):
                samples = minhash(s, factors, shifts)
                classes.append(_digest(s))
                bands.append(band_keys(samples, BANDS, ROWS))
                odds.append(odd_sketch(samples, BITS))
                wholes.append(parity_bitmap(s, BITS))
            else:
                classes.append(None)
                bands.append(none)
                odds.append(none)
                wholes.append(none)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), long_lists(bands), long_lists(odds),
             long_lists(wholes), *[batch.column(c) for c in carried]],
            names=["doc_id", "n_shingles", "class", "bands", "odd", "whole", *carried])

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *carried), each,
                       "doc_id long, n_shingles long, class binary, bands array<long>, odd array<long>, whole array<long>" + "".join(f", {c} binary" for c in carried))


def _sets(docs: DataFrame) -> DataFrame:
    """(class, shingles) of the given rows."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingle_set(t.as_py()) for t in batch.column("text")]
        return pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in found], pa.binary()), long_lists(found)], names=["class", "shingles"])

    return map_batches(docs.select(F.col("text").cast("string")), each, "class binary, shingles array<long>")


def _classes(rows: DataFrame) -> DataFrame:
    """One row per distinct set: its number ``cid``, size, bands, odd sketch and least doc_id."""
    least = rows.groupBy("class").agg(F.min("doc_id").alias("least_id"))
    one = rows.join(least, "class").filter(F.col("doc_id").eqNullSafe(F.col("least_id"))).dropDuplicates(["class"])
    return one.select(F.monotonically_increasing_id().alias("cid"), "class", "least_id", F.col("n_shingles").alias("n"), "bands", "odd", "whole")


def _buckets(classes: DataFrame) -> DataFrame:
    """(key, size, rank, cid, n, root, o0..., w0...): members of buckets with two classes or more."""
    banded = classes.select(F.explode("bands").alias("key"), "cid")
    drawn = F.struct(F.xxhash64("cid").alias("digest"), "cid")
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min(drawn).alias("first")).filter("size > 1")
    later = 1 + F.pmod(F.xxhash64("cid", "key"), F.col("size") - 1)
    members = banded.join(shared, "key").withColumn("rank", F.when(F.col("cid") == F.col("first.cid"), F.lit(0)).otherwise(later).cast("long")).drop("first")
    facts = classes.select("cid", "n", *[F.get("odd", F.lit(i)).alias(c) for i, c in enumerate(_ODD)],
                           *[F.get("whole", F.lit(i)).alias(c) for i, c in enumerate(_WHOLE)])
    return members.join(facts, "cid").withColumn("root", F.col("cid"))


def _candidates(members: DataFrame, start: int, stop: int) -> DataFrame:
    """Pairs (u, v, cu, cv) of the ranks due in this round: other component, fitting size, near by their odd sketches.

    The tests are the join's condition, so a pair that fails one is never a row.
    """
    left, right = (members.select("key", *[F.col(c).alias(f"{side}_{c}") for c in ("rank", "cid", "n", "root", *_ODD, *_WHOLE)]) for side in ("u", "v"))
    both = F.col("u_n") + F.col("v_n")

    def apart(names: list[str]) -> Column:
        return sum((F.bit_count(F.col(f"u_{c}").bitwiseXOR(F.col(f"v_{c}"))) for c in names), F.lit(0))

    due = left.filter((F.col("u_rank") >= start) & (F.col("u_rank") < stop)).withColumnRenamed("key", "u_key")
    later = (F.col("u_rank") < F.col("v_rank")) | ((F.col("u_rank") == F.col("v_rank")) & (F.col("u_cid") < F.col("v_cid")))
    near = due.join(right, (F.col("u_key") == F.col("key")) & later & (F.col("u_root") != F.col("v_root"))
                    & (100 * F.least("u_n", "v_n") >= PERCENT * F.greatest("u_n", "v_n")) & (apart(_ODD) <= most_differing(LEAST_ESTIMATE))
                    & ((100 + PERCENT) * apart(_WHOLE) <= (100 - PERCENT) * both))
    return near.select(F.col("u_cid").alias("u"), F.col("v_cid").alias("v"), F.col("u_root").alias("cu"), F.col("v_root").alias("cv")).distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (u, v) between the components of the pairs whose full sets are similar enough."""
    both = F.size(F.array_intersect("su", "sv"))
    return (
        pairs.join(sets.select(F.col("cid").alias("u"), F.col("shingles").alias("su")), "u")
        .join(sets.select(F.col("cid").alias("v"), F.col("shingles").alias("sv")), "v")
        .filter(100 * both >= PERCENT * (F.size("su") + F.size("sv") - both)).select(F.col("cu").alias("u"), F.col("cv").alias("v"))
    )


def _moved(roots: DataFrame, now: DataFrame) -> DataFrame:
    """(node, root) after the components ``now`` of a later round, whose nodes are roots of ``roots`` or new."""
    both = roots.join(now.select(F.col("node").alias("_old"), F.col("root").alias("_new")), F.col("root") == F.col("_old"), "full")
    return cut(both.select(F.coalesce("node", "_old").alias("node"), F.coalesce("_new", "root").alias("root")))


def _linked(classes: DataFrame, docs: DataFrame) -> DataFrame | None:
    """(node, root) of the classes with links, None without any."""
    members = stored(_buckets(classes), "buckets")
    candidates = classes.join(members.select("cid").distinct(), "cid", "left_semi").select("cid", "class", "least_id")
    chosen = candidates.select(F.col("least_id").alias("_llm_id")).distinct()
    texts = docs.join(chosen, docs["doc_id"].eqNullSafe(chosen["_llm_id"]), "left_semi")
    sets = stored(_sets(texts).dropDuplicates(["class"]).join(candidates.select("cid", "class"), "class").select("cid", "shingles"), "sets")
    release(docs.sparkSession)
    roots, start = None, 0
    while True:
        stop = max(1, start * GROWTH)
        found = cut(_confirmed(_candidates(members, start, stop), sets))
        start = stop
        if not found.isEmpty():
            now = components(found)
            roots = now if roots is None else _moved(roots, now)
            moved = now.select(F.col("node").alias("root"), F.col("root").alias("_new"))
            members = members.join(moved, "root", "left").withColumn("root", F.coalesce("_new", "root")).drop("_new")
        # a bucket is settled once it holds one component, or once all its ranks have been compared; components only grow
        mixed = members.filter(F.col("size") > max(start, 2)).groupBy("key").agg(F.min("root").alias("_a"), F.max("root").alias("_b")).filter("_a <> _b").select("key")
        members = cut(members.join(mixed, "key", "left_semi"))
        release(members.sparkSession)
        if members.isEmpty():
            break
    return roots


def _grouped(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """(class, root, component_id) of all classes of the sketched ``rows``; ``root`` tells components without an id apart."""
    classes = stored(_classes(rows.filter(F.col("class").isNotNull())), "classes")
    roots = _linked(classes, docs)
    final = classes.select("class", "cid", "least_id")
    if roots is None:
        return final.select("class", F.col("cid").alias("root"), F.col("least_id").alias("component_id"))
    rooted = final.join(roots.select(F.col("node").alias("cid"), "root"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return rooted.join(least, "root").select("class", "root", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> one row per row: doc_id, n_shingles, component_id, kept.

    Texts without words (null, empty, blank) are linked with nothing.  Equal texts, repeated rows and different rows with
    one doc_id are all linked by their texts only; ``component_id`` is the least non-null doc_id of the component, null if it has
    none.  An empty table gives no rows.  Other columns of ``docs`` are ignored.
    """
    rows = stored(sketches(docs.select("doc_id", "text")), "sketches")
    final = _grouped(rows, docs)
    linked = rows.select("doc_id", "n_shingles", "class").join(final.select("class", "component_id"), "class").drop("class")
    alone = rows.filter(F.col("class").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near-duplicates one row stays, with the smallest doc_id, or none if the group has no ids.

    Rows are told apart by id and text, so unlike texts with one doc_id or without any are groups of their own.  Texts without
    words are linked with nothing and all stay.
    """
    release(spark)
    rows = stored(sketches(docs.select("doc_id", "text", row_key(docs).alias("key"))), "sketches")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    kept = rows.select("doc_id", "key", "class").join(_grouped(rows, docs).select("class", "root"), "class").groupBy("root").agg(
        best.alias("best")).select(F.col("best.key").alias("_llm_key"))
    worded = F.coalesce(F.regexp_like(F.col("text").cast("string"), F.lit(WORD)), F.lit(False))
    one = docs.withColumn("_llm_key", row_key(docs)).filter(worded).join(kept, "_llm_key", "left_semi").dropDuplicates(["_llm_key"])
    return one.select(*docs.columns).unionByName(docs.filter(~worded))


_SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (
 SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
   '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS MATERIALIZED (
 SELECT DISTINCT doc_id, md5_number(g) AS g FROM (
  SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
   ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * common >= 75 * (x.n + y.n - common)),
r AS (SELECT doc_id, doc_id AS seen FROM documents UNION SELECT r.doc_id, l.v FROM r JOIN l ON l.u = r.seen)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)
"""


@llm_query("op2_near_duplicates", _SQL)
def op2_near_duplicates(spark, folder):
    return near_duplicates(table(spark, folder, "documents"))
