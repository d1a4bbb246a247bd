"""Scores by sets of open leaves equal those by walking the trees, and a meta-model's rows are scored once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentiloom.models import boosting as B
from sentiloom.models import classifiers as C


def trained(leaves, depth, rounds=6, n=3000):
    r = np.random.default_rng(7)
    x = r.integers(0, B.BINS, (n, 5)).astype(np.uint8)
    label = ((x[:, 0] > 30).astype(np.int8) + (x[:, 1].astype(int) * x[:, 2] > 900)).astype(np.int8)
    block = B.Block((x, label, np.ones(n), np.zeros(n, np.int16), np.zeros(n, bool), r.integers(0, 2**63, n).astype(np.uint64)), 3)
    model = B.Model(B.Settings(rounds=rounds, num_leaves=leaves, max_depth=depth, min_child_samples=3))
    return B.boost([model], 3, 5, B._One(block))[0], x


@pytest.mark.parametrize("leaves, depth", [(31, 7), (64, 12), (100, 12), (2, 1), (4, 0)])
def test_scores_equal_those_of_walked_trees(leaves, depth):
    model, x = trained(leaves, depth)
    walked = np.tile(model.start, (len(x), 1))
    for trees in model.trees:
        walked = walked + np.stack([np.asarray(t.value)[t.route(x)] for t in trees], axis=1)
    assert np.array_equal(B.margins(model, x), walked)
    assert B.margins(model, x[:0]).shape == (0, 3)
    if leaves <= 64:
        assert all(B.leaf_tables(t) is not None for trees in model.trees for t in trees)
    elif leaves == 100:
        assert any(B.leaf_tables(t) is None for trees in model.trees for t in trees)


def test_meta_rows_are_scored_once(spark):
    rows = spark.range(200, numPartitions=4).select(F.col("id").cast("string").alias("post_id"), (F.col("id") % 3).cast("int").alias("auto_label_id"))
    seen = spark.sparkContext.accumulator(0)

    class Counted:
        def transform(self, df):
            @F.udf("double")
            def p(label):
                seen.add(1)
                return 0.2 + 0.2 * label

            return df.withColumns({c: p("auto_label_id") if i == 0 else F.lit(0.3) for i, c in enumerate(C.PROBS)}).withColumn("label_id", F.lit(0))

    for kind in ("logistic", "boosted"):
        seen.value = 0
        C.Stacked({"a": Counted()}, meta_type=kind).fit(rows)
        assert seen.value == 200
