"""Models on resamples fitted together equal models fitted one by one."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentiloom.models.resamples import Resampled, softmax, times_drawn


def table(spark, n=400):
    rng = np.random.default_rng(3)
    x = rng.normal(2, 3, (n, 3))
    y = np.clip(np.round(x[:, 0] - x[:, 1] + rng.normal(0, 2, n)), -1, 1).astype(int) + 1
    rows = [(f"k{i}", *[None if (i + c) % 40 == 0 else float(v) for c, v in enumerate(x[i])], int(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "post_id string, a double, b double, c double, auto_label_id int").repartition(4)


def test_together_equals_one_by_one(spark):
    df, features = table(spark), ["a", "b", "c"]
    together = Resampled(features, 3, 4).fit(df)
    assert together.passes < 15
    for i in range(4):
        alone = Resampled(features, 3, 1, seed=1000 + i).fit(df)
        gap = together.coefficients[i] - alone.coefficients[0]
        assert np.abs(gap - gap.mean(axis=0)).max() < 1e-5  # one vector may be added to all classes' intercepts
    scored = together.scores(df)
    assert scored.count() == 1600 and scored.agg(F.max(F.abs(F.aggregate("p", F.lit(0.0), lambda s, v: s + v) - 1))).first()[0] < 1e-9


def test_a_fit_is_the_optimum(spark):
    df = table(spark)
    model = Resampled(["a", "b", "c"], 3, 2).fit(df)
    rows = df.select("auto_label_id", times_drawn(2, "post_id").alias("w"), F.array(*model._standard()).alias("x")).toPandas()
    x, y, w = np.hstack([np.stack(rows["x"]), np.ones((400, 1))]), rows["auto_label_id"].to_numpy(), np.stack(rows["w"])
    assert w.mean() == pytest.approx(1, abs=0.15) and set(np.unique(w)) <= set(range(10))

    def loss(i, c):
        p = softmax(x @ c.T)[np.arange(400), y]
        return -(w[:, i] * np.log(p)).sum() + 0.01 * w[:, i].sum() / 2 * (c[:, :-1] ** 2).sum()

    rng = np.random.default_rng(1)
    for i in range(2):
        best = loss(i, model.coefficients[i])
        assert all(loss(i, model.coefficients[i] + rng.normal(0, s, (3, 4))) > best - 1e-9 for s in (1e-3, 1e-2, 0.1, 1) for _ in range(20))


def test_no_rows(spark):
    with pytest.raises(ValueError):
        Resampled(["a"], 3).fit(table(spark).limit(0))
