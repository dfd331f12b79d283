"""Batches of sequences of about equal length, padded inside each batch only."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from freshet.operators.ranks import before_each


def _chain(cells: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = first = batch = 0  # of the first key with this length; of the first batch that starts from there on
        for rows in batches:
            out = []
            for length, n in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                size = max(1, cells // length)
                out.append((length, first, batch, size))
                rank += n
                if first < rank:
                    started = -(-(rank - first) // size)
                    first, batch = first + started * size, batch + started
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 4, names=["length", "first", "batch", "size"])

    return work


def batch_plan(sizes: DataFrame, keys: Sequence[str], cells: int) -> DataFrame:
    """keys, length, batch and pad_to for a table of keys and their lengths (1 at least).

    Keys are taken by falling length (ties by key); a batch takes as many as keep its longest length times its keys within
    `cells`, and one key at least. How many keys a batch takes depends on its longest length alone, so batches are laid out
    over the table of distinct lengths (with its counts; a row each, in one task), and a key's batch follows from its rank."""
    numbered = before_each(sizes.select(*keys, F.col("length").cast("long").alias("length")).withColumns({"_one": F.lit(1), "_short": -F.col("length").cast("long")}), (), ["_short", *keys], _rank="_one")
    lengths = sizes.groupBy(F.col("length").cast("long").alias("length")).agg(F.count(F.lit(1)).alias("n"))
    laid = lengths.repartition(1).sortWithinPartitions(F.desc("length")).mapInArrow(_chain(cells), "length long, first long, batch long, size long")
    behind = F.col("_rank") - F.col("first")
    of = F.when(behind < 0, F.col("batch") - 1).otherwise(F.col("batch") + F.floor(behind / F.col("size")).cast("long"))
    placed = numbered.join(laid.withColumnRenamed("batch", "_b").select("length", "first", F.col("_b").alias("batch"), "size"), "length").withColumn("batch", of)
    return placed.select(*keys, "length", "batch", F.max("length").over(Window.partitionBy("batch")).alias("pad_to"))


def batched_rows(rows: DataFrame, plan: DataFrame, keys: Sequence[str], position: str, features: Sequence[str]) -> DataFrame:
    """The rows of all keys (position from 0, features) with their batch, and rows of zeros up to the batch's longest key;
    `padding` tells them apart. A key of any length is as many rows."""
    own = rows.select(*keys, position, *features).join(plan.select(*keys, "batch"), list(keys)).withColumn("padding", F.lit(False))
    short = plan.filter(F.col("length") < F.col("pad_to"))
    steps = F.sequence(F.col("length").cast(rows.schema[position].dataType), (F.col("pad_to") - 1).cast(rows.schema[position].dataType))
    zeros = short.select(*keys, F.explode(steps).alias(position), *[F.lit(0.0).alias(c) for c in features], "batch", F.lit(True).alias("padding"))
    return own.unionByName(zeros)
