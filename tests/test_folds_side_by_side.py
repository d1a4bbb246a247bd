"""Models of the folds are fitted at the same time, results in the order of the folds."""

import threading

import pytest
from pyspark.sql import functions as F

from sentiloom.models import classifiers as C


def test_calls_run_at_once_and_keep_their_order(spark):
    meet = threading.Barrier(3, timeout=30)

    def call(i):
        meet.wait()  # breaks unless all three are there
        return i

    assert C.side_by_side(spark, [C.partial(call, i) for i in range(3)]) == [0, 1, 2]
    assert C.side_by_side(spark, []) == []
    with pytest.raises(KeyError):
        C.side_by_side(spark, [C.partial({}.__getitem__, "none"), C.partial(int, 1)])


def test_folds_are_fitted_at_once(spark):
    meet = threading.Barrier(4, timeout=60)
    rows = spark.range(80).select(F.col("id").cast("string").alias("post_id"), (F.col("id") % 2).cast("int").alias("y"))

    class Size:
        def fit(self, df):
            meet.wait()
            self.rows = df.count()
            return self

        def transform(self, df):
            return df.withColumns({p: F.lit(float(self.rows)) for p in C.PROBS}).withColumn("label_id", F.lit(0))

    held = C.out_of_fold(rows, {"size": Size}, "y", 4, "post_id", 42)
    assert {(r.fold, r.size_p_neutral) for r in held.collect()} == {(f, 60.0) for f in range(4)} and held.count() == 80
