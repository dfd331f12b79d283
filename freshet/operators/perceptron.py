"""Multilayer perceptrons trained data-parallel: tasks sum gradients of their rows, a shuffle sums those of the tasks."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasMaxIter, HasSeed, HasTol, HasWeightCol
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.session import settled, shipped

Layers = list[tuple[np.ndarray, np.ndarray]]


def shapes(features: int, hidden: Sequence[int]) -> list[tuple[int, int]]:
    sizes = [features, *hidden, 1]
    return list(zip(sizes[:-1], sizes[1:], strict=True))


def start(layout: Sequence[tuple[int, int]], seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.concatenate([np.r_[(rng.standard_normal((a, b)) / np.sqrt(a)).ravel(), np.zeros(b)] for a, b in layout])


def unpack(flat: np.ndarray, layout: Sequence[tuple[int, int]]) -> Layers:
    out, at = [], 0
    for a, b in layout:
        out.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def forward(layers: Layers, x: np.ndarray) -> list[np.ndarray]:
    """The input, what each hidden layer makes of it (tanh), and the last layer's sums."""
    seen = [x]
    for k, (w, b) in enumerate(layers):
        sums = seen[-1] @ w + b
        seen.append(np.tanh(sums) if k < len(layers) - 1 else sums)
    return seen


def loss_and_gradient(flat: np.ndarray, layout: Sequence[tuple[int, int]], x: np.ndarray, y: np.ndarray, weight: np.ndarray, classify: bool) -> np.ndarray:
    """The summed loss of the rows (weighted cross-entropy of 0/1 labels, or weighted half squares), then its gradient."""
    layers = unpack(flat, layout)
    seen = forward(layers, x)
    out = seen[-1][:, 0]
    if classify:
        loss = weight * (np.logaddexp(0, out) - y * out)
        back = weight * (1 / (1 + np.exp(-out)) - y)
    else:
        loss, back = weight * (out - y) ** 2 / 2, weight * (out - y)
    error, parts = back[:, None], []
    for k in range(len(layers) - 1, -1, -1):
        parts.append(np.r_[(seen[k].T @ error).ravel(), error.sum(axis=0)])
        if k:
            error = (error @ layers[k][0].T) * (1 - seen[k] ** 2)
    return np.r_[loss.sum(), np.concatenate(parts[::-1])]


def descend(objective: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int, tolerance: float, memory: int = 8) -> np.ndarray:
    """Limited-memory quasi-Newton steps, halved until the loss falls; each look at the objective is a pass over the rows."""
    value, slope = objective(x)
    pairs: deque[tuple[np.ndarray, np.ndarray]] = deque(maxlen=memory)
    for _ in range(steps):
        if np.abs(slope).max(initial=0) <= tolerance:
            break
        q, kept = slope.copy(), []
        for s, y in reversed(pairs):
            a = (s @ q) / (s @ y)
            q -= a * y
            kept.append((a, s, y))
        if pairs:
            s, y = pairs[-1]
            q *= (s @ y) / (y @ y)
        else:
            q /= max(1.0, float(np.linalg.norm(slope)))
        for a, s, y in reversed(kept):
            q += (a - (y @ q) / (s @ y)) * s
        size = 1.0
        while True:
            new = x - size * q
            got, turned = objective(new)
            if got <= value - 1e-4 * size * float(slope @ q) or size < 1e-4:
                break
            size /= 2
        if got >= value:
            break
        if (turned - slope) @ (new - x) > 1e-12:
            pairs.append((new - x, turned - slope))
        gain, x, value, slope = value - got, new, got, turned
        if gain <= tolerance * max(1.0, abs(value)):
            break
    return x


def fit_flat(rows: DataFrame, features: int, hidden: Sequence[int], classify: bool, steps: int, tolerance: float, penalty: float, seed: int) -> np.ndarray:
    """Parameters for rows of x (array), y and w. What reaches the driver is a row for each parameter and pass."""
    layout = shapes(features, hidden)
    size = sum(a * b + b for a, b in layout) + 1
    total = float(rows.agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0])
    shipped(rows)

    def objective(flat: np.ndarray) -> tuple[float, np.ndarray]:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(size)
            for batch in batches:
                x = pc.list_flatten(batch.column(0)).to_numpy(zero_copy_only=False).reshape(-1, features)
                out += loss_and_gradient(flat, layout, x, batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False), classify)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(out)], names=["k", "v"])

        got = rows.mapInArrow(work, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).toArrow()
        both = np.zeros(size)
        both[got["k"].to_numpy()] = got["v"].to_numpy()
        both /= max(total, 1e-300)
        return both[0] + penalty / 2 * float(flat @ flat), both[1:] + penalty * flat

    return descend(objective, start(layout, seed), steps, tolerance) if total else start(layout, seed)


class NetworkModel(Model):
    """Adds `rawPrediction` (two sums, of opposite sign) and `prediction` for a classifier, `prediction` for a regressor."""

    def __init__(self, flat: np.ndarray, features: int, hidden: Sequence[int], classify: bool, column: str):
        super().__init__()
        self.flat, self.n, self.hidden, self.classify, self.column = flat, features, tuple(hidden), classify, column

    def layers(self) -> Layers:
        return unpack(self.flat, shapes(self.n, self.hidden))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        layers, n = self.layers(), self.n
        shipped(dataset)

        @F.arrow_udf("double")
        def score(x: pa.Array) -> pa.Array:
            return pa.array(forward(layers, pc.list_flatten(x).to_numpy(zero_copy_only=False).reshape(-1, n))[-1][:, 0])

        raw = score(vector_to_array(self.column))
        if not self.classify:
            return dataset.withColumn("prediction", raw)
        out = dataset.withColumn("_raw_sum", raw)
        return out.withColumns({"rawPrediction": array_to_vector(F.array(-F.col("_raw_sum"), F.col("_raw_sum"))), "prediction": (F.col("_raw_sum") >= 0).cast("double")}).drop("_raw_sum")


class Network(Estimator, HasFeaturesCol, HasLabelCol, HasWeightCol, HasMaxIter, HasTol, HasSeed):
    """A perceptron with tanh layers. A classifier weighs its rows by weightCol, so positives can weigh more.

    The result is the same for the same rows and seed up to rounding, however the rows are dealt to tasks."""

    @keyword_only
    def __init__(self, *, classify=True, hidden=(16, 8), featuresCol="features", labelCol="label", weightCol=None, maxIter=30, tol=1e-6, seed=42, penalty=1e-4):
        super().__init__()
        given = dict(self._input_kwargs)
        self.classify, self.hidden, self.penalty = classify, tuple(hidden), penalty
        for own in ("classify", "hidden", "penalty"):
            given.pop(own, None)
        self._setDefault(maxIter=30, tol=1e-6, seed=42)
        self._set(**{k: v for k, v in given.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> NetworkModel:
        weight = F.col(self.getWeightCol()).cast("double") if self.isDefined("weightCol") else F.lit(1.0)
        rows = settled(dataset.select(vector_to_array(self.getFeaturesCol()).alias("x"), F.col(self.getLabelCol()).cast("double").alias("y"), weight.alias("w")))
        first = rows.first()
        n = len(first["x"]) if first else 1
        flat = fit_flat(rows, n, self.hidden, self.classify, self.getMaxIter(), self.getTol(), self.penalty, self.getSeed())
        return NetworkModel(flat, n, self.hidden, self.classify, self.getFeaturesCol())
