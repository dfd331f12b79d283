"""Joins between tables of runs, nodes, results and predictions, and set comparisons."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.functions.scalars import missing_if_nan
from freshet.operators.ranks import before_each
from freshet.session import settled


def training_view(runs: DataFrame, scenarios: DataFrame, features: DataFrame, results: DataFrame, nodes: DataFrame, done: str = "COMPLETE") -> DataFrame:
    """Completed runs with their scenario, and a row per node that has features and a result."""
    complete = runs.filter(F.col("status") == done).drop("status")
    return features.join(results, ["run_id", "node_id"]).join(complete, "run_id").join(scenarios, "scenario_id").join(nodes, "node_id")


def assemble(static: DataFrame, dynamic: DataFrame, labels: DataFrame, key: str = "node_id", fill: Sequence[str] = ()) -> DataFrame:
    """Static features with dynamic ones and labels; nodes without labels get 0."""
    return static.join(dynamic, key, "left").join(labels, key, "left").fillna(0, list(fill))


def key_mismatches(left: DataFrame, right: DataFrame, keys: Sequence[str], names: tuple[str, str]) -> DataFrame:
    """Keys that one side lacks: the keys and which side it is."""
    keys = list(keys)
    lacking = [a.join(b, keys, "left_anti").select(*keys, F.lit(n).alias("missing_in")) for a, b, n in ((left, right, names[1]), (right, left, names[0]))]
    return lacking[0].unionByName(lacking[1])


def compare(truth: DataFrame, pred: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Truth beside prediction, with errors and whether the class is right."""
    both = truth.join(pred, list(keys))
    error = F.col("vol_pred") - F.col("vol")
    return both.withColumns({"error": error, "abs_error": F.abs(error), "correct": (F.col("inunda") == F.col("inunda_pred")).cast("int")})


def lookup_or(nodes: DataFrame, found: DataFrame, key: str, **defaults: float) -> DataFrame:
    """All nodes with what was found for them, else defaults."""
    return nodes.select(key).join(found, key, "left").fillna(defaults)


def first_seen(df: DataFrame, key: str, *order: str) -> DataFrame:
    """key, position: distinct keys in the order in which they are first met, numbered from 0 over parts of that order."""
    firsts = df.groupBy(key).agg(F.min(F.struct(*order)).alias("_first"))
    flat = firsts.select(key, *[F.col(f"_first.{c}").alias(f"_o{k}") for k, c in enumerate(order)], F.lit(1).alias("_one"))
    # numbering looks at its rows several times, so they are found once
    return before_each(settled(flat), (), [*[f"_o{k}" for k in range(len(order))], key], position="_one").select(key, "position")


def latest(df: DataFrame, key: str | Sequence[str], *order: str) -> DataFrame:
    """The row of each key that is last by the order."""
    keys = [key] if isinstance(key, str) else list(key)
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth")


def undominated(df: DataFrame, key: str, score: Column, valid: Column) -> DataFrame:
    """Valid rows of each key that no other valid row beats."""
    w = Window.partitionBy(key)
    return df.filter(valid).withColumn("_best", F.min(score).over(w)).filter(score == F.col("_best")).drop("_best")


def counted_children(parents: DataFrame, key: str, expected: str, **children: DataFrame) -> DataFrame:
    """Parents beside the number of children in each table, and whether all equal what is expected."""
    out = parents.select(key, expected)
    for name, child in children.items():
        out = out.join(child.groupBy(key).agg(F.count(F.lit(1)).alias(f"n_{name}")), key, "left").fillna(0, [f"n_{name}"])
    good = F.lit(True)
    for name in children:
        good &= F.col(f"n_{name}") == F.col(expected)
    return out.withColumn("complete", good & (F.col(expected) > 0))


def json_members(df: DataFrame, key: str, array_json: str) -> DataFrame:
    """A row per element of a JSON array of whole numbers."""
    return df.select(key, F.explode(F.from_json(array_json, "array<bigint>")).alias("member"))


def overlay(base: DataFrame, report: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Base values, overwritten by those that the report has; flooded if either says so."""
    wide = base.join(report.select(key, *[missing_if_nan(F.col(f)).alias(f"_{f}") for f in fields]), key, "left")
    out = wide.withColumns({f: F.coalesce(F.col(f"_{f}"), F.col(f)) for f in fields}).drop(*[f"_{f}" for f in fields])
    return out.withColumn("flooded", ((F.col("flooded") == 1) | (F.col("vol") > 0)).cast("int"))


def backfill(df: DataFrame, source: DataFrame, key: str, column: str, missing: Column) -> DataFrame:
    """The column, taken from the source where it counts as missing."""
    there = source.select(key, F.col(column).alias("_there"))
    return df.join(there, key, "left").withColumn(column, F.when(missing, F.coalesce("_there", F.col(column))).otherwise(F.col(column))).drop("_there")


def uncovered(expected: DataFrame, got: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many expected keys are missing, and how many came that weren't expected."""
    keys = list(keys)
    a, b = expected.select(*keys).distinct(), got.select(*keys).distinct()
    missing, extra = a.join(b, keys, "left_anti"), b.join(a, keys, "left_anti")
    both = missing.select(F.lit(1).alias("m"), F.lit(0).alias("e")).unionAll(extra.select(F.lit(0).alias("m"), F.lit(1).alias("e")))
    return both.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("missing"), F.coalesce(F.sum("e"), F.lit(0)).alias("extra"))


def active_leaves(selections: DataFrame, valid: DataFrame) -> DataFrame:
    """Selections that nothing supersedes and whose promotion is valid."""
    superseded = selections.filter(F.col("supersedes").isNotNull()).select(F.col("supersedes").alias("selection_id")).distinct()
    return selections.join(superseded, "selection_id", "left_anti").join(valid, "promotion_id", "left_semi")


def upsert(current: DataFrame, batch: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """The current rows with those of a later batch in place of rows that have the same key."""
    keys = [key] if isinstance(key, str) else list(key)
    return current.join(batch, keys, "left_anti").unionByName(batch, allowMissingColumns=True)


def select_network(networks: DataFrame, text: str) -> DataFrame:
    """Networks that a text names: by file, by whole hash or by the hash's start."""
    return networks.filter((F.col("file") == text) | (F.col("hash") == text) | F.col("hash").startswith(text))


def paired_members(df: DataFrame, key: str, role: str, left: str, right: str) -> DataFrame:
    """Rows of one role beside rows of another with the same key."""
    a, b = df.filter(F.col(role) == left).alias("a"), df.filter(F.col(role) == right).alias("b")
    return a.join(b, key).select(key, F.col("a.member").alias(left), F.col("b.member").alias(right))


def window_runs(windows: DataFrame, regressions: DataFrame, runs: DataFrame) -> DataFrame:
    """Windows beside the regression that scored them and the run they come from; windows that lack either are left out."""
    return windows.join(regressions, "regression_id").join(runs, "run_id")


def split_off(tables: dict[str, DataFrame], doomed: DataFrame, key: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables without the rows of doomed keys, and (table, deleted, kept) of each table."""
    marks = doomed.select(key).distinct().withColumn("_doomed", F.lit(True))
    marked = {name: df.join(marks, key, "left") for name, df in tables.items()}
    counts = [df.agg(F.count("_doomed").alias("deleted"), F.count_if(F.col("_doomed").isNull()).alias("kept")).select(F.lit(name).alias("table"), "deleted", "kept") for name, df in marked.items()]
    return {name: df.filter("_doomed IS NULL").drop("_doomed") for name, df in marked.items()}, reduce(DataFrame.unionByName, counts)
