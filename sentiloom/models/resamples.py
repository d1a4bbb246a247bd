"""Logistic regressions on many resamples at once.

A row carries a vector of Poisson weights, one per resample, drawn from digests of its key.  A pass over the rows adds up, for all resamples
together, the gradient and the Hessian of the multinomial loss; a Newton step on the driver follows.  A dozen passes fit them all,
however many there are.  What is added up has resamples x (classes x columns)^2 numbers, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentiloom.operators.sampling import seeded_unit
from sentiloom.session import measured

#: Distribution function of Poisson(1) at 0, 1, 2, ...: how often a row is drawn.
_POISSON = np.cumsum([np.exp(-1.0) / np.prod(range(1, k + 1)) for k in range(9)])


def times_drawn(resamples: int, key: str, seed: int = 1000) -> Column:
    """Array of how often a row is in each resample."""
    def drawn(u: Column) -> Column:
        return sum(((u >= F.lit(float(p))).cast("int") for p in _POISSON), F.lit(0)).cast("double")

    return F.array(*[drawn(seeded_unit(seed + i, key)) for i in range(resamples)])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _sums(x: np.ndarray, y: np.ndarray, weights: np.ndarray, coefficients: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per resample the gradient (classes x columns) and the Hessian, flat, of the weighted loss."""
    r, k, d = coefficients.shape
    gradient, hessian = np.zeros((r, k * d)), np.zeros((r, k * d, k * d))
    hit = np.eye(k)[y]
    for i in range(r):
        use = weights[:, i] > 0
        xs, w = x[use], weights[use, i]
        p = softmax(xs @ coefficients[i].T)
        gradient[i] = ((p - hit[use]) * w[:, None]).T.dot(xs).ravel()
        for a in range(k):
            for b in range(a, k):
                part = (xs * (w * p[:, a] * ((a == b) - p[:, b]))[:, None]).T @ xs
                hessian[i, a * d : (a + 1) * d, b * d : (b + 1) * d] = part
                hessian[i, b * d : (b + 1) * d, a * d : (a + 1) * d] = part.T
    return gradient, hessian


class Resampled:
    """``resamples`` multinomial logistic regressions on standardised columns, nulls as the mean, with an L2 penalty of ``penalty`` per row."""

    def __init__(self, features: list[str], classes: int, resamples: int = 10, penalty: float = 0.01, label: str = "auto_label_id", key: str = "post_id",
                 most_passes: int = 30, tolerance: float = 1e-7, seed: int = 1000):
        self.features, self.classes, self.resamples, self.penalty = features, classes, resamples, penalty
        self.label, self.key, self.most_passes, self.tolerance, self.seed = label, key, most_passes, tolerance, seed

    def _standard(self) -> list[Column]:
        value = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in self.features]
        return [F.coalesce((v - F.lit(m)) / F.lit(s), F.lit(0.0)) for v, m, s in zip(value, self.means, self.scales)]

    def fit(self, df: DataFrame) -> "Resampled":
        value = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in self.features]
        rows = df.filter(F.col(self.label).isNotNull())
        stats = rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(v).alias(f"m{i}") for i, v in enumerate(value)],
                         *[F.stddev_pop(v).alias(f"s{i}") for i, v in enumerate(value)]).first()
        if not stats["n"]:
            raise ValueError("no labelled rows to learn from")
        self.means = [float(stats[f"m{i}"] or 0.0) for i in range(len(self.features))]
        self.scales = [float(stats[f"s{i}"] or 0.0) or 1.0 for i in range(len(self.features))]
        ready = measured(rows.select(F.col(self.label).cast("int").alias("y"), times_drawn(self.resamples, self.key, self.seed).alias("w"),
                                     F.array(*self._standard()).alias("x")), "resamples")
        r, k, d = self.resamples, self.classes, len(self.features) + 1
        drawn = np.array(ready.select(F.posexplode("w").alias("i", "t")).groupBy("i").agg(F.sum("t").alias("t")).orderBy("i").toPandas()["t"])
        ridge = np.tile(np.append(np.ones(d - 1), 0.0), k)  # no penalty on the intercepts
        self.coefficients, self.passes = np.zeros((r, k, d)), 0
        for _ in range(self.most_passes):
            gradient, hessian = self._pass(ready)
            flat = self.coefficients.reshape(r, -1)
            moved = 0.0
            for i in range(r):
                scale = self.penalty * max(drawn[i], 1.0)
                step = np.linalg.lstsq(hessian[i] + np.diag(scale * ridge), gradient[i] + scale * ridge * flat[i], rcond=1e-12)[0]
                flat[i] -= step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-300))
                moved = max(moved, float(np.abs(step).max()))
            self.coefficients, self.passes = flat.reshape(r, k, d), self.passes + 1
            if moved < self.tolerance:
                break
        return self

    def _pass(self, ready: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """One pass: a partial sum per task, cut into slices by resample so that no task and no message holds the sums of all tasks."""
        coefficients, r, size = self.coefficients, self.resamples, self.classes * (len(self.features) + 1)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            gradient, hessian = np.zeros((r, size)), np.zeros((r, size, size))
            for batch in batches:
                if batch.num_rows:
                    y = batch.column(0).to_numpy(zero_copy_only=False)
                    w, x = (batch.column(i).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for i in (1, 2))
                    g, h = _sums(np.hstack([x, np.ones((len(x), 1))]), y, w, coefficients)
                    gradient += g
                    hessian += h
            rows = np.concatenate([gradient[:, None, :], hessian], axis=1)  # (resample, size + 1, size)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.arange(r), size + 1)), pa.array(np.tile(np.arange(size + 1), r)), pa.array(list(rows.reshape(-1, size)))], names=["i", "row", "v"])

        parts = ready.mapInArrow(run, "i long, row long, v array<double>")
        summed = parts.groupBy("i", "row").agg(*[F.sum(F.get("v", F.lit(j))).alias(f"v{j}") for j in range(size)])
        table = summed.orderBy("i", "row").toPandas()
        values = table[[f"v{j}" for j in range(size)]].to_numpy().reshape(r, size + 1, size)
        return values[:, 0], values[:, 1:]

    def scores(self, df: DataFrame) -> DataFrame:
        """Rows (key, round, probabilities) of every resample's model."""
        coefficients = self.coefficients

        @F.pandas_udf("array<array<double>>")
        def score(x: pd.Series) -> pd.Series:
            values = np.hstack([np.stack(x.to_numpy()), np.ones((len(x), 1))]) if len(x) else np.zeros((0, coefficients.shape[2]))
            every = np.stack([softmax(values @ c.T) for c in coefficients], axis=1)
            return pd.Series([list(map(list, row)) for row in every])

        return df.select(self.key, F.posexplode(score(F.array(*self._standard()))).alias("round", "p"))
