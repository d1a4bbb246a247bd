"""The scorer turns only a few texts of an Arrow batch into Python strings at a time."""

import tracemalloc

import numpy as np
import pyarrow as pa

from sentiloom.models.scorer import BATCH, scorer_udf


def test_a_large_batch_is_scored_in_small_parts(spark):
    sizes = []

    def predict(texts):
        sizes.append(len(texts))
        return np.tile([0.25, 0.25, 0.5], (len(texts), 1))

    column = pa.array(["🚀" + "a" * 5_000] * 5_000 + [None])
    score = scorer_udf(lambda: predict)
    tracemalloc.start()
    out = list(score.func(iter([column, column.slice(0, 0)])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out[0].to_pylist()[-1] == [0.25, 0.25, 0.5] and [len(x) for x in out] == [5_001, 0]
    assert max(sizes) <= BATCH and peak < 20e6  # all texts at once are 100 MB
