"""Benchmark items inside documents: size-partitioned MinHash search, confirmed by exact shingle containment.

The similarity of a short item and a long text is tiny even when the text holds the whole item, so the search
partitions by size.  Items fall into classes by the power of two ``u`` that bounds their shingles; for each class a
document is cut into windows of ``2u`` shingles, every ``u``.  A passage of an item then lies whole in some window, at a similarity of
at least 0.17 even for the smallest items of the class, three quarters of which are copied.  64 single-row bands miss that with
probability 5e-6.  Minima of wider windows are minima of narrower ones, so each shingle is hashed once per function for all classes.

Window minima are first looked up in a Bloom filter of the items' minima, whose size is a constant: at a spot of 32-bit arithmetic, and only
those found there get their 64-bit key and a second look.  What passes is joined with the items' minima on the cluster.  A long text is gone over in pieces that overlap by one window, so the memory for its windows
does not grow with its length.  So the benchmark may grow without bound: a full filter costs speed, not results.
A candidate's containment is counted on the full sets of item and document.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentiloom.llm.common import grams, hash_words, long_lists, map_batches, mix, release, row_key, seeds, shingle_set, stored, table, words
from sentiloom.llm.registry import llm_query

FUNCTIONS = 64
FILTER_BITS = 1 << 25
PERCENT = 75
_WORD_BITS = 64
_CHUNK = 2048
_PIECE = 8192  # shingles of a text whose windows are held at once


def _functions() -> tuple[np.ndarray, np.ndarray]:
    return (seeds(FUNCTIONS, 21) >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seeds(FUNCTIONS, 23) >> np.uint64(32)).astype(np.uint32)


def size_class(n: int) -> int:
    return 1 << math.ceil(math.log2(n)) if n else 0


def block_minima(shingles: np.ndarray, block: int, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """(blocks, functions): minima over runs of ``block`` shingles."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.empty((-(-len(x) // block), len(factors)), np.uint32)
    step = max(block, _CHUNK // block * block)
    full = len(x) // block * block
    for i in range(0, full, step):
        values = x[i : min(i + step, full), None] * factors
        values += shifts
        values = values.reshape(-1, block, len(factors))
        values.min(axis=1, out=out[i // block : i // block + len(values)])
    if full < len(x):
        out[-1] = (x[full:, None] * factors + shifts).min(axis=0)
    return out


def _key_seeds(of_class: int) -> np.ndarray:
    return seeds(FUNCTIONS, 25) + np.uint64(of_class)


def _keys(minima: np.ndarray, of_class: int) -> np.ndarray:
    """64-bit band keys of rows of minima: function number, class and value mixed."""
    return mix(minima.astype(np.uint64) ^ _key_seeds(of_class))


def _spot_terms(of_class: int) -> tuple[np.ndarray, np.ndarray]:
    """Factor and shift of each function for :func:`_first_spots`."""
    return (seeds(FUNCTIONS, 27) >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (mix(_key_seeds(of_class)) >> np.uint64(32)).astype(np.uint32)


def _first_spots(minima: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Filter bits of rows of minima, by the high bits of a product: far cheaper than their keys."""
    spots = minima * factors
    spots += shifts
    spots >>= np.uint32(32 - FILTER_BITS.bit_length() + 1)
    return spots


def item_keys(shingles: np.ndarray, factors, shifts) -> tuple[np.ndarray, np.ndarray]:
    """Band keys of an item and the first filter bit of each."""
    n = len(shingles)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    minima = block_minima(shingles, n, factors, shifts)
    return _keys(minima, size_class(n))[0], _first_spots(minima, *_spot_terms(size_class(n)))[0].astype(np.uint64)


def window_keys(shingles: np.ndarray, classes: list[int], factors, shifts, piece: int = _PIECE):
    """Band keys of all windows (2-d arrays), piece by piece and class by class; ``classes`` ascend, and a window may come twice."""
    for minima, u in _windows(shingles, classes, factors, shifts, piece):
        yield _keys(minima, u)


def _windows(shingles: np.ndarray, classes: list[int], factors, shifts, piece: int = _PIECE):
    """(minima, class) of all windows, as :func:`window_keys` has their keys.

    A piece is a whole number of the largest blocks and one more, which the next piece begins with: every window starts in a block before
    that one, and so lies whole in a piece.  Memory grows with the piece or, if it is larger, the largest item, not with the text.
    """
    if len(shingles) == 0 or not classes:
        return
    most = classes[-1]
    step = max(most, piece // most * most)
    for i in range(0, max(1, len(shingles) - most), step):
        yield from _piece_windows(shingles[i : i + step + most], classes, factors, shifts)


def _piece_windows(shingles: np.ndarray, classes: list[int], factors, shifts):
    width, minima = classes[0], block_minima(shingles, classes[0], factors, shifts)
    for u in classes:
        while width < u:  # fold pairs of blocks
            even = len(minima) // 2 * 2
            folded = np.minimum(minima[0:even:2], minima[1:even:2])
            minima = folded if even == len(minima) else np.concatenate([folded, minima[even:]])
            width *= 2
        yield np.minimum(minima[:-1], minima[1:]) if len(minima) > 1 else minima, u


def _second_spots(keys: np.ndarray) -> np.ndarray:
    return ((keys >> np.uint64(32)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)


def _set(spots: np.ndarray, loaded: np.ndarray) -> np.ndarray:
    """Whether the filter (bytes) has the bits."""
    return loaded.take(spots >> 3) >> (spots & 7).astype(np.uint8) & 1 > 0


def _passing(minima: np.ndarray, terms: tuple, key_seeds: np.ndarray, loaded: np.ndarray) -> np.ndarray:
    """Band keys of the minima of windows whose two bits are set in the filter."""
    at, function = np.nonzero(_set(_first_spots(minima, *terms), loaded))
    keys = mix(minima[at, function].astype(np.uint64) ^ key_seeds[function])
    return keys[_set(_second_spots(keys), loaded)]


def items_of(benchmark: DataFrame) -> DataFrame:
    """(item_id, n_item_shingles, class, keys, spots, item_shingles) of the items that have words."""
    factors, shifts = _functions()

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingle_set(t.as_py()) for t in batch.column("text")]
        keyed = [item_keys(s, factors, shifts) for s in found]
        return pa.RecordBatch.from_arrays(
            [batch.column("item_id"), pa.array([len(s) for s in found], pa.int64()), pa.array([size_class(len(s)) for s in found], pa.int64()),
             long_lists([k for k, _ in keyed]), long_lists([s for _, s in keyed]), long_lists(found)],
            names=["item_id", "n_item_shingles", "class", "keys", "spots", "item_shingles"])

    return map_batches(benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")), each,
                       "item_id long, n_item_shingles long, class long, keys array<long>, spots array<long>, item_shingles array<long>").filter("n_item_shingles > 0")


def _bloom(items: DataFrame) -> np.ndarray:
    """The items' keys as a bit array of ``FILTER_BITS``; at most that many bits reach the driver, whatever the benchmark."""
    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        first, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("spots", "keys"))
        spots = np.unique(np.concatenate([first, _second_spots(keys.view(np.uint64))]))
        at, start = np.unique(spots // _WORD_BITS, return_index=True)
        bits = np.bitwise_or.reduceat(np.uint64(1) << (spots % _WORD_BITS).astype(np.uint64), start) if len(spots) else np.zeros(0, np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(bits.view(np.int64))], names=["at", "bits"])

    set_words = map_batches(items.select(F.inline(F.arrays_zip("keys", "spots"))), each, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits"))
    out = np.zeros(FILTER_BITS // _WORD_BITS, np.uint64)
    got = set_words.toArrow()
    out[got.column("at").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return out


def _hits(docs: DataFrame, bits: np.ndarray, classes: list[int]) -> DataFrame:
    """(doc_id, n_doc_shingles, keys, doc_shingles) of the rows with a key in the filter; ``doc_id`` may be of any type."""
    factors, shifts = _functions()
    shared = docs.sparkSession.sparkContext.broadcast(bits.view(np.uint8))  # 4 MB, a constant
    terms, key_seeds = {u: _spot_terms(u) for u in classes}, {u: _key_seeds(u) for u in classes}

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        loaded = shared.value
        ids, sizes, keys, sets = [], [], [], []
        for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
            ordered = grams(hash_words(words(text.as_py())))
            found = [k for m, u in _windows(ordered, classes, factors, shifts) if len(k := _passing(m, terms[u], key_seeds[u], loaded))]
            found = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
            if len(found):
                whole = np.unique(ordered)
                ids.append(doc_id.as_py())
                sizes.append(len(whole))
                keys.append(found)
                sets.append(whole)
        return pa.RecordBatch.from_arrays([pa.array(ids, batch.column("doc_id").type), pa.array(sizes, pa.int64()), long_lists(keys), long_lists(sets)],
                                          names=["doc_id", "n_doc_shingles", "keys", "doc_shingles"])

    return map_batches(docs.select("doc_id", F.col("text").cast("string")), each,
                       f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_doc_shingles long, keys array<long>, doc_shingles array<long>")


def contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (doc_id, item_id, n_item_shingles, n_common, containment) where the document holds ``percent`` of the item's shingles.

    Null, empty and blank texts on either side match nothing; an empty table on either side gives no rows.  Rows that repeat
    a doc_id or an item_id give one pair each per distinct count; rows without an id keep a null there.  Other columns are ignored.
    """
    return _pairs(docs.select(F.col("doc_id").cast("long"), "text"), benchmark, percent)


def _pairs(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    items = stored(items_of(benchmark), "items")
    classes = sorted(r[0] for r in items.select("class").distinct().collect())  # powers of two: some thirty at most
    hits = stored(_hits(docs, _bloom(items), classes).withColumn("row", F.monotonically_increasing_id()), "hits")
    keyed = items.select("item_id", "class", "n_item_shingles", "item_shingles", F.explode("keys").alias("key"), F.xxhash64("item_shingles").alias("item"))
    candidates = (
        hits.select("row", F.explode("keys").alias("key")).join(keyed.select("key", "item_id", "item"), "key").select("row", "item_id", "item").distinct()
    )
    both = F.size(F.array_intersect("doc_shingles", "item_shingles")).cast("long")
    return (
        candidates.join(hits.select("row", "doc_id", "doc_shingles"), "row")
        .join(items.select(F.col("item_id").alias("_llm_id"), F.xxhash64("item_shingles").alias("_item"), "n_item_shingles", "item_shingles"),
              F.col("item_id").eqNullSafe(F.col("_llm_id")) & (F.col("item") == F.col("_item")))
        .select("doc_id", "item_id", "n_item_shingles", both.alias("n_common"))
        .filter(100 * F.col("n_common") >= percent * F.col("n_item_shingles"))
        .withColumn("containment", F.col("n_common") / F.col("n_item_shingles")).distinct()
    )


def decontaminate(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a benchmark item go; each row by its own text, whatever rows share its doc_id or have none."""
    release(spark)
    found = _pairs(docs.select(row_key(docs).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_llm_key")).distinct()
    return docs.withColumn("_llm_key", row_key(docs)).join(found, "_llm_key", "left_anti").select(*docs.columns)


_SQL = r"""
WITH t AS (SELECT doc_id AS id, true AS doc, text FROM documents UNION ALL SELECT item_id, false, text FROM benchmark),
w AS MATERIALIZED (
 SELECT id, doc, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
   '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM t),
s AS MATERIALIZED (
 SELECT DISTINCT id, doc, g FROM (
  SELECT id, doc, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
   ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w)),
n AS (SELECT id, count(*) AS n FROM s WHERE NOT doc GROUP BY id),
c AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_common FROM s d JOIN s i ON d.g = i.g AND d.doc AND NOT i.doc GROUP BY 1, 2)
SELECT doc_id, item_id, n AS n_item_shingles, n_common, n_common / n AS containment FROM c JOIN n ON n.id = item_id WHERE 100 * n_common >= 75 * n
"""


@llm_query("op7_decontamination", _SQL)
def op7_decontamination(spark, folder):
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
