"""Models over stored windows: any function of arrays, sent to the executors once and applied to Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.session import shipped

#: (sequences of shape rows x steps x features, static features of shape rows x features) -> a score for each row.
Scorer = Callable[[np.ndarray, np.ndarray], np.ndarray]

#: What a node's windows are summed up to, by the task of the model.
TASKS: dict[str, dict[str, Callable[[Column], Column]]] = {
    "classification": {
        "max_flood_prob": F.max,
        "mean_flood_prob": F.avg,
        "windows_total": F.count,
        "windows_flood_predicted": lambda p: F.count_if(p >= 0.5),
    },
    "regression": {"max_peak_flooding_lps_pred": F.max, "mean_peak_flooding_lps_pred": F.avg, "windows_total": F.count},
}
ACTUAL = {"classification": "actual_flooded", "regression": "actual_peak_flooding_lps"}


def output_columns(task: str) -> list[str]:
    if task not in TASKS:
        raise ValueError(f"{task} is neither classification nor regression")
    return ["node_id", *TASKS[task], ACTUAL[task]]


def score_windows(windows: DataFrame, model: Scorer, keep: Sequence[str], sequence: str = "sequence", static: Sequence[str] = ()) -> DataFrame:
    """keep and score: the model's value for each window (an array of steps, each an array of features) beside static
    features, of which missing ones count as 0. Windows of a batch may differ in length; each length is a call."""
    shared = windows.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = cloudpickle.loads(shared.value)
        for batch in batches:
            column = batch.column("_sequence")
            steps = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            flat = pc.list_flatten(pc.list_flatten(column)).cast(pa.float64()).to_numpy(zero_copy_only=False)
            beside = np.nan_to_num(np.stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in batch.columns[len(keep) + 1 :]], axis=1)) if static else np.zeros((len(steps), 0))
            ends = np.cumsum(steps)
            width = len(flat) // max(1, int(ends[-1]) if len(ends) else 1)
            rows, scores = flat.reshape(-1, max(width, 1)), np.full(len(steps), np.nan)
            for n in np.unique(steps[steps > 0]):
                which = np.flatnonzero(steps == n)
                places = (ends[which] - n)[:, None] + np.arange(n)
                scores[which] = np.asarray(run(rows[places], beside[which]), np.float64).reshape(-1)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(scores, from_pandas=True)], names=[*keep, "score"])

    slim = windows.select(*keep, F.col(sequence).alias("_sequence"), *[F.col(c).cast("double").alias(f"_static{k}") for k, c in enumerate(static)])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in windows.select(*keep).schema.fields)
    return shipped(slim).mapInArrow(work, f"{schema}, score double")


def node_scores(scored: DataFrame, actual: DataFrame, task: str, node: str = "node_id", score: str = "score") -> DataFrame:
    """The columns of `output_columns` for every node of `actual` (node and its true value); a node without windows has a
    total of 0 and no scores."""
    names = output_columns(task)
    per = scored.groupBy(F.col(node).alias("node_id")).agg(*[f(F.col(score)).alias(n) for n, f in TASKS[task].items()])
    counts = [n for n in names if n.startswith("windows_")]
    return actual.withColumnRenamed(node, "node_id").join(per, "node_id", "left").fillna(0, counts).select(*names)
