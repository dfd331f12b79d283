"""Kernel machines as linear machines over random Fourier features."""

from __future__ import annotations

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def draw(dimensions: int, features: int, gamma: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and phases whose features z have E[z(a) . z(b)] = exp(-gamma |a - b|^2)."""
    rng = np.random.default_rng(seed)
    return rng.standard_normal((dimensions, features)) * np.sqrt(2 * gamma), rng.uniform(0, 2 * np.pi, dimensions)


class FourierFeatures(Transformer, HasInputCol, HasOutputCol, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    """A vector x becomes sqrt(2 / D) cos(W x + b). The product of two such vectors is their Gaussian kernel, with a standard
    deviation of at most 1 / sqrt(D). Column expressions only; W follows from the seed, so it is never stored.

    gamma <= 0 stands for 1 / features, which is right for features of unit variance."""

    dimensions = Param(Params._dummy(), "dimensions", "number of random features", TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "width of the kernel; 1 / features if not positive", TypeConverters.toFloat)
    features = Param(Params._dummy(), "features", "length of the input vectors", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, features=None, dimensions=128, gamma=0.0, seed=42):
        super().__init__()
        self._setDefault(dimensions=128, gamma=0.0, seed=42)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        length = self.getOrDefault("features") if self.isDefined("features") else len(dataset.select(self.getInputCol()).first()[0])
        gamma, n = self.getOrDefault("gamma"), self.getOrDefault("dimensions")
        w, b = draw(n, length, gamma if gamma > 0 else 1.0 / length, self.getSeed())
        waves = F.array(*[F.struct(F.array(*[F.lit(float(v)) for v in row]).alias("w"), F.lit(float(p)).alias("b")) for row, p in zip(w, b, strict=True)])
        x = vector_to_array(self.getInputCol())
        dot = lambda wave: F.aggregate(F.zip_with(wave["w"], x, lambda a, c: a * c), F.lit(0.0), lambda s, v: s + v)
        z = F.transform(waves, lambda wave: F.cos(dot(wave) + wave["b"]) * F.lit(float(np.sqrt(2.0 / n))))
        return dataset.withColumn(self.getOutputCol(), array_to_vector(z))
