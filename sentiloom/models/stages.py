"""Pipeline stages that turn text into the checked TF-IDF vectors, row by row, in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, PipelineModel, Transformer
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentiloom.operators.terms import Weights, fit_vocabulary, pieces, plain_words

@F.arrow_udf(VectorUDT.sqlType())
def vector_parts(vector: pa.Array) -> pa.Array:
    """Struct with type, size, indices and values of a vector column: the batch as it is."""
    return vector


class TermVectors(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Text column to its TF-IDF vector of length 1, in Arrow batches; the vocabulary is saved with the stage."""

    vocabulary = Param(Params._dummy(), "vocabulary", "terms by index", TypeConverters.toListString)
    idf = Param(Params._dummy(), "idf", "inverse document frequency by index", TypeConverters.toListFloat)
    sublinear = Param(Params._dummy(), "sublinear", "use 1+ln(tf)", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, inputCol=None, outputCol=None, vocabulary=None, idf=None, sublinear=True):
        super().__init__()
        self._setDefault(sublinear=True)
        self._set(**self._input_kwargs)

    def terms(self) -> list[str]:
        return self.getOrDefault("vocabulary")

    def _transform(self, df: DataFrame) -> DataFrame:
        size = len(self.terms())
        weights = Weights(self.terms(), self.getOrDefault("idf"), self.getOrDefault("sublinear"))

        @F.arrow_udf(VectorUDT())
        def vectors(texts: pa.Array) -> pa.Array:
            parts, sizes, done = [], np.zeros(len(texts), np.int64), 0
            for _, piece in pieces([pa.RecordBatch.from_arrays([texts], names=["text"])]):
                row, term, weight = weights(piece)
                sizes[done : done + len(piece)] = np.bincount(row, minlength=len(piece))
                parts.append((term.astype(np.int32), weight))
                done += len(piece)
            ends = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
            term, weight = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, kind) for i, kind in ((0, np.int32), (1, float)))
            n = len(texts)
            return pa.StructArray.from_arrays(
                [pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size, np.int32)), pa.ListArray.from_arrays(ends, pa.array(term)),
                 pa.ListArray.from_arrays(ends, pa.array(weight))], names=["type", "size", "indices", "values"])

        return df.withColumn(self.getOutputCol(), vectors(plain_words(F.col(self.getInputCol()))))


class TextVectors(Estimator, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Fits the vocabulary and returns a savable pipeline model that needs no shuffle to score.

    Only the vocabulary (at most ``maxFeatures`` terms) comes to the driver.
    """

    maxFeatures = Param(Params._dummy(), "maxFeatures", "vocabulary bound", TypeConverters.toInt)
    sublinear = Param(Params._dummy(), "sublinear", "use 1+ln(tf)", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, inputCol=None, outputCol=None, maxFeatures=5000, sublinear=True):
        super().__init__()
        self._setDefault(maxFeatures=5000, sublinear=True)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> PipelineModel:
        text, out = self.getInputCol(), self.getOutputCol()
        vocabulary = fit_vocabulary(df, text, self.getOrDefault("maxFeatures")).orderBy("term_index").collect()
        if not vocabulary:
            raise ValueError("no term occurs in two texts")
        return PipelineModel([TermVectors(inputCol=text, outputCol=out, vocabulary=[r["term"] for r in vocabulary],
                                          idf=[r["idf"] for r in vocabulary], sublinear=self.getOrDefault("sublinear"))])
