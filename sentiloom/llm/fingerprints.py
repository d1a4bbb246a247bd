"""Fingerprints by improved consistent weighted sampling.

A text is a set of terms, its pairs of neighbouring words, weighted by their counts.  For each sample and term, r and c are drawn
from Gamma(2, 1) and b uniformly, all by hashing; with t = floor(ln w / r + b), the term with the least
ln c - r (t - b + 1) and its t are the sample.  Two texts share a sample with the probability of their generalised Jaccard similarity, the
sum of the smaller over the sum of the larger weights.  The gamma quantiles and logarithms are tables made on the driver, so all
executors compute the same samples, whatever their processors; only counts above 32,767 take their logarithm on the executor, rounded to
single precision.

The operator compares every text with an edited one that borrows the beginning of the next document.  Texts are shuffled once: runs of ids
have one bucket each, the first document of a run is copied to the end of the run before, and a task walks its sorted rows with
one row of lookahead.  A text and its edited form share most terms; those are sampled once for both.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentiloom.llm.common import grams, hash_words, seeds, table, words
from sentiloom.llm.registry import llm_query

SAMPLES = 64
_BITS = 16  # of a sample in the fingerprint
_CHUNK = 512
_LOG_STEPS = 11  # bits of mantissa in the table of small quantiles


def _gamma_quantiles(p: np.ndarray) -> np.ndarray:
    """Quantiles of Gamma(2, 1), whose distribution function is 1 - (1 + x) exp(-x), by bisection."""
    low, high = np.zeros_like(p), np.full_like(p, 60.0)
    for _ in range(80):
        mid = (low + high) / 2
        # series for small x, where the closed form cancels
        cdf = np.where(mid < 1e-3, mid**2 / 2 - mid**3 / 3 + mid**4 / 8, -np.expm1(-mid) - mid * np.exp(-mid))
        low, high = np.where(cdf < p, mid, low), np.where(cdf < p, high, mid)
    return (low + high) / 2


class Sampler:
    """Tables and seeds; built once on the driver and sent to the tasks (some 600 KB)."""

    def __init__(self, samples: int = SAMPLES):
        self.samples = samples
        self.seeds = seeds(samples, 31)
        self.r = _gamma_quantiles((np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.float32)
        # ln c by the exponent and first bits of a 32-bit number: as fine for small quantiles as for large ones
        steps = np.arange(33 << _LOG_STEPS, dtype=np.int64)
        exponent, part = steps >> _LOG_STEPS, (steps & ((1 << _LOG_STEPS) - 1)) + 0.5
        u = np.minimum((1 + part / (1 << _LOG_STEPS)) * 2.0 ** (exponent - 32), 1 - 2.0**-33)
        self.log_c = np.log(_gamma_quantiles(u)).astype(np.float32)
        self.log_w = np.log(np.arange(1, 1 << 15)).astype(np.float32)

    def _logs(self, weights: np.ndarray) -> np.ndarray:
        logs = self.log_w[np.minimum(weights, len(self.log_w)) - 1]
        above = weights > len(self.log_w)
        if above.any():
            logs[above] = np.log(weights[above]).astype(np.float32)
        return logs

    def sample(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The samples of one set of weighted terms."""
        return self.samples_of(terms, weights, np.ones(len(terms), dtype=bool))[0]

    def samples_of(self, terms: np.ndarray, weights: np.ndarray, *members: np.ndarray) -> list[np.ndarray]:
        """For each set of terms, a mask over ``terms``: a number of ``_BITS`` bits per sample, a hash of the chosen term and its t; zero without terms.

        ``terms`` ascend, and among equal values the first term is chosen, so a set has the same samples whatever it is sampled with.
        """
        best = np.full((len(members), self.samples), np.inf, np.float32)
        chosen = np.zeros((len(members), self.samples), np.uint64)
        columns = np.arange(self.samples)
        for i in range(0, len(terms), _CHUNK):
            term, log_w = terms[i : i + _CHUNK], self._logs(weights[i : i + _CHUNK])
            x = (term[:, None] ^ self.seeds) * np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(32)
            x *= np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(29)
            u = (x >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
            spot = (u.astype(np.float32).view(np.int32) >> (23 - _LOG_STEPS)) - (127 << _LOG_STEPS)
            r = self.r[(x & np.uint64(0xFFFF)).astype(np.int32)]
            b = ((x >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.float32) / np.float32(65536)
            if log_w.any():
                t = np.floor(log_w[:, None] / r + b)
                value = self.log_c[spot] - r * (t - b + 1)
            else:
                t = None
                value = self.log_c[spot] - r * (1 - b)
            for m, member in enumerate(members):
                mine = np.flatnonzero(member[i : i + _CHUNK])
                if not len(mine):
                    continue
                at = mine[(value[mine] if len(mine) < len(term) else value).argmin(axis=0)]
                least = value[at, columns]
                better = least < best[m]
                kind = term[at] if t is None else term[at] + t[at, columns].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                best[m, better] = least[better]
                chosen[m, better] = kind[better]
        y = (chosen ^ self.seeds) * np.uint64(0xBF58476D1CE4E5B9)
        return [row if member.any() else np.zeros(self.samples, np.uint16) for row, member in zip((y >> np.uint64(64 - _BITS)).astype(np.uint16), members)]

    def of(self, text: str) -> np.ndarray:
        terms, weights = np.unique(grams(hash_words(words(text)), 2), return_counts=True)
        return self.sample(terms, weights)

    def of_both(self, text: str, other: str) -> list[np.ndarray]:
        """The samples of two texts; a term that has one weight in both is worked out once."""
        (terms, weights), (more, counts) = (np.unique(grams(hash_words(words(x)), 2), return_counts=True) for x in (text, other))
        at = np.searchsorted(terms, more)
        at[at == len(terms)] = 0
        shared = (terms[at] == more) & (weights[at] == counts) if len(terms) else np.zeros(len(more), dtype=bool)
        second = np.zeros(len(terms), dtype=bool)
        second[at[shared]] = True
        all_terms = np.concatenate((terms, more[~shared]))
        order = np.argsort(all_terms, kind="stable")
        first = np.arange(len(all_terms)) < len(terms)
        second = np.concatenate((second, np.ones(len(all_terms) - len(terms), dtype=bool)))
        return self.samples_of(all_terms[order], np.concatenate((weights, counts[~shared]))[order], first[order], second[order])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal samples, an estimate of the generalised Jaccard similarity."""
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as much of the beginning of ``following``."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut] if cut else text


def _bucket(key: Column, cuts: list[int]) -> Column:
    """How many of the descending ``cuts`` are above the key: a binary search as an expression."""
    steps = max(1, len(cuts).bit_length())
    padded = F.array(*[F.lit(c).cast("long") for c in cuts], *[F.lit(None).cast("long")] * ((1 << steps) - len(cuts)))
    return F.aggregate(F.array(*[F.lit(1 << k) for k in reversed(range(steps))]), F.lit(0), lambda low, step: F.when(
        F.coalesce(F.get(padded, low + step - 1) > key, F.lit(False)), low + step).otherwise(low))


_LAST = -(1 << 63)  # rows without an id come after all others


def _in_runs(docs: DataFrame) -> DataFrame:
    """(bucket, copy, doc_id, text): each bucket sorted by descending id, the head of the next bucket copied to its end.

    Cuts and heads are a few numbers per shuffle partition.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))
    ids = docs.select(key.alias("key"))
    wanted = min(4 * parts, 4000)
    found = ids.approxQuantile("key", [k / wanted for k in range(1, wanted)], 0.2 / wanted)
    cuts = sorted({int(x) for x in found}, reverse=True)
    tops = ids.groupBy(_bucket(F.col("key"), cuts).alias("bucket")).agg(F.max("key").alias("top")).orderBy("bucket").collect()
    # the head of each bucket also ends the one before; the very first one ends the last
    ends = {tops[i].top: tops[i - 1].bucket for i in range(len(tops))}
    rows = docs.select(key.alias("key"), F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = rows.withColumns({"bucket": _bucket(F.col("key"), cuts), "copy": F.lit(False)})
    before = F.create_map(*[F.lit(x) for top, bucket in ends.items() for x in (top, bucket)]) if ends else F.lit(None).cast("map<bigint,int>")
    heads = rows.filter(F.col("key").isin(list(ends))).withColumns({"bucket": F.try_element_at(before, F.col("key")), "copy": F.lit(True)})
    return (
        own.unionByName(heads).repartitionById(parts, F.col("bucket") % parts)
        .sortWithinPartitions("bucket", "copy", F.desc("key"), F.xxhash64("text"), "text").select("bucket", "copy", "doc_id", "text")
    )


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the one with the next lower doc_id, after the last the first; rows with one doc_id stand by the hash of their text,
    rows without any come last.  A null text is empty; a text without words has the fingerprint of zeros.  A single document is its own
    next; an empty table gives no rows.  Other columns are ignored.
    """
    sampler = docs.sparkSession.sparkContext.broadcast(Sampler(samples))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # `waiting` has a next document but no samples yet, `sampled` lacks the samples of its next document only
        s, waiting, sampled = sampler.value, None, None
        for batch in batches:
            out = []

            def done(row: tuple | None, following: np.ndarray) -> None:
                if row is not None:
                    doc_id, chars, digest, own, changed = row
                    out.append((doc_id, chars, digest, own.tobytes().hex(), changed.tobytes().hex(), likeness(own, changed), likeness(own, following)))

            for bucket, copy, doc_id, text in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                if waiting is not None:
                    before_id, before = waiting
                    changed = edited(before, text)
                    own, own_changed = s.of_both(before, changed)
                    done(sampled, own)
                    sampled = (before_id, len(before), hashlib.sha256(changed.encode()).hexdigest(), own, own_changed)
                waiting = None if copy else (doc_id, text)
                if copy:
                    done(sampled, s.of(text))
                    sampled = None
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], schema=schema)
        if waiting is not None or sampled is not None:
            raise ValueError("the table changed while it was read")

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    schema = pa.schema(list(zip(names, kinds)))
    return _in_runs(docs).mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


@llm_query("op3_fingerprints")
def op3_fingerprints(spark, folder):
    return fingerprints(table(spark, folder, "documents"))
