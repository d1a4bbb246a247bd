"""Helpers shared by the training-data operators: words, hashes, shingles, stored tables.

A word is a maximal run of characters other than space and ``\\t \\n \\v \\f \\r``; A-Z are lower-cased first.  On UTF-8
bytes that is ``lower().split()``, which touches ASCII only.  All hashes are fixed functions of the bytes, so every
executor and every rerun gets the same values.
"""

from __future__ import annotations

import gc
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentiloom.session import measured

WORD = r"[^\x20\x09-\x0D]+"
WIDTH = 5

_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)
_CLEANING = 0.5  # seconds


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a fresh folder below the shared one and read again: computed once, lineage cut."""
    return measured(df, name)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffles, broadcasts and checkpoints that no table refers to any more.

    It follows the driver's garbage collection, which may not happen for a long time while many small jobs run; loops over
    jobs call this once a round.  The cleaner drops blocks behind the first collection; the second gives their memory back, and the heap
    shrinks to what is in use.  Then the allocator of the driver's JVM returns what it keeps of freed buffers, where the JVM has a command for it.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    time.sleep(_CLEANING)
    spark.sparkContext._jvm.System.gc()
    _trim(spark)


def _trim(spark: SparkSession) -> bool:
    """The JDK's diagnostic command ``System.trim_native_heap`` on the driver; False where there is none (before 17.0.9, not Linux)."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    beans, name = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    methods = jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods()  # the server's own class is not exported, its interface is
    invoke = next(m for m in methods if m.getName() == "invoke")
    words = gateway.new_array(jvm.java.lang.Object, 4)
    words[0], words[1] = name, "systemTrimNativeHeap"
    try:
        invoke.invoke(beans, words)
    except Py4JJavaError:
        return False
    return True


def row_key(docs: DataFrame) -> Column:
    """128-bit digest of a row's doc_id and text, null for a null text: rows that share an id or have none keep apart by their texts."""
    doc_id = F.coalesce(docs["doc_id"].cast("long").cast("string"), F.lit(""))
    return F.substring(F.unhex(F.sha2(F.concat(doc_id, F.lit(":"), docs["text"].cast("string")), 256)), 1, 16)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: each input bit reaches each output bit."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


def seeds(count: int, seed: int) -> np.ndarray:
    """``count`` fixed 64-bit numbers."""
    return mix((np.arange(1, count + 1, dtype=np.uint64) + np.uint64(seed << 20)) * _STEP)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def hash_words(parts: list[bytes]) -> np.ndarray:
    """One hash per word, without a cache: looking words up in a large one costs more than hashing them."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, parts)), ">u8").astype(np.uint64)


def grams(hashes: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Hash of every run of ``width`` words, in order; of the whole sequence if it is shorter."""
    if len(hashes) == 0:
        return hashes
    n = max(1, len(hashes) - width + 1)
    span = min(width, len(hashes))
    with np.errstate(over="ignore"):
        out = np.full(n, span, dtype=np.uint64)
        for j in range(span):
            out = out * _STEP + hashes[j : j + n]
        return mix(out)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit shingles of a whole text; empty without words."""
    return np.unique(grams(hash_words(words(text))))


def map_batches(df: DataFrame, each: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``mapInArrow`` with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = each(batch)
            if out is not None:
                yield out

    return df.mapInArrow(run, schema)


def long_lists(values: list[np.ndarray], kind=pa.int64()) -> pa.ListArray:
    """One Arrow list per array, without a Python object per element."""
    offsets = np.zeros(len(values) + 1, dtype=np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = np.concatenate(values) if values else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)).cast(kind))
