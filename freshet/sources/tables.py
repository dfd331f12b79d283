"""Readers of tables: typed CSV, hydrograph shapes, scenarios, runs of node series, prepared datasets, configuration."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet.operators.validation import raise_if_any, scenario_rules

SHAPE = "time_h double, q_norm double"
#: Columns of a node series, in order.
SERIES = "run_id string, network_hash string, node_id string, step_index int, time_sec double, time_min double, total_inflow_lps double, lateral_inflow_lps double, depth_m double, depth_ratio double, flooding_lps double, total_outflow_lps double, failed_now int"
PREPARED = ("keys", "features", "targets", "folds")


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """A CSV table with a header; types as given, or inferred for a review."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(path)


def read_shapes(spark: SparkSession, path: str) -> DataFrame:
    """All shapes of a folder (or one file): shape_id (the file's stem), time_h, q_norm. A shape must have points and start
    at 0."""
    stem = lambda file: F.url_decode(F.regexp_extract(file, r"([^/]+)\.csv$", 1)).alias("shape_id")
    shapes = read_csv(spark, path, SHAPE).select(stem(F.input_file_name()), "time_h", "q_norm")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path).select(stem(F.col("path")))
    raise_if_any(files.join(shapes.select("shape_id").distinct(), "shape_id", "left_anti"), "a shape has no points")
    firsts = shapes.groupBy("shape_id").agg(F.min("time_h").alias("first"))
    raise_if_any(firsts.filter("first IS NULL OR first <> 0"), "shapes must start at time 0")
    return shapes


def read_scenario(spark: SparkSession, path: str, nodes: DataFrame) -> DataFrame:
    """A validated inflow table: node_id, time, value (texts), with exactly the columns node_id, time and value_lps."""
    raw = spark.read.option("header", True).csv(path)
    if sorted(raw.columns) != ["node_id", "time", "value_lps"]:
        raise ValueError(f"columns are {raw.columns}")
    rows = raw.select("node_id", "time", F.col("value_lps").alias("value"))
    raise_if_any(scenario_rules(rows, nodes), "the inflow table breaks a rule")
    return rows


def read_runs(spark: SparkSession, path: str, run_ids: Sequence[str] | None = None) -> DataFrame:
    """Node series of runs in a folder of `write_series`; a selection skips files and row groups of other runs."""
    series = spark.read.schema(SERIES).parquet(path)
    return series.filter(F.col("run_id").isin(list(run_ids))) if run_ids is not None else series


def read_registered(spark: SparkSession, registry: DataFrame) -> DataFrame:
    """Node series of the files that a registry (artifact_id, run_id, parquet_path) names. The registry is a catalogue of
    files, as small as a folder listing."""
    paths = [r["parquet_path"] for r in registry.select("parquet_path").distinct().collect()]
    return spark.read.schema(SERIES).parquet(*paths)


@dataclass(frozen=True)
class Prepared:
    """A prepared dataset: four tables by sample_idx, and a manifest."""

    keys: DataFrame
    features: DataFrame
    targets: DataFrame
    folds: DataFrame
    manifest: dict


def read_prepared(spark: SparkSession, path: str) -> Prepared:
    tables = {n: spark.read.parquet(f"{path}/{n}.parquet") for n in PREPARED}
    manifest = json.loads(spark.read.text(f"{path}/manifest", wholetext=True).first()[0])
    return Prepared(**tables, manifest=manifest)


def resolve_prepared(spark: SparkSession, folder: str, prep_id: str | None = None) -> str:
    """The path of the prepared set with an id below a folder, or of the one whose manifest was written last."""
    manifests = spark.read.format("binaryFile").load(f"{folder}/*/manifest/part-*").select("path", "modificationTime", F.get_json_object(F.decode("content", "UTF-8"), "$.prep_id").alias("prep_id"))
    asked = manifests if prep_id is None else manifests.filter(F.col("prep_id") == prep_id)
    found = asked.agg(F.max(F.struct("modificationTime", "path")).alias("m")).first()["m"]
    if found is None:
        raise FileNotFoundError(f"no prepared set {prep_id or ''} in {folder}")
    return found["path"].rsplit("/manifest/", 1)[0]


def newest(spark: SparkSession, pattern: str) -> str:
    """The path of the file that was modified last."""
    files = spark.read.format("binaryFile").load(pattern).select("path", "modificationTime")
    return files.agg(F.max(F.struct("modificationTime", "path")).alias("m")).first()["m"]["path"]


def aliased(df: DataFrame, aliases: Mapping[str, Sequence[str]]) -> DataFrame:
    """The columns under the library's names: each takes the first of its aliases that the frame has, whatever the case.
    Columns of no alias are left out; a name without any is an error."""
    have = {c.lower(): c for c in reversed(df.columns)}
    found = {name: next((have[a.lower()] for a in (name, *others) if a.lower() in have), None) for name, others in aliases.items()}
    lacking = [name for name, c in found.items() if c is None]
    if lacking:
        raise ValueError(f"no column for {lacking}")
    return df.select(*[F.col(c).alias(name) for name, c in found.items()])


def minutes_column(df: DataFrame, key: str, time: str = "time") -> DataFrame:
    """The series with time_min: minutes since the key's first time stamp, or the time itself where it is a number already."""
    if not isinstance(df.schema[time].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return df.withColumn("time_min", F.col(time).cast("double"))
    first = df.groupBy(key).agg(F.min(time).alias("_first"))
    micros = F.timestamp_diff("MICROSECOND", F.col("_first").cast("timestamp_ntz"), F.col(time).cast("timestamp_ntz"))
    return df.join(first, key).withColumn("time_min", micros / F.lit(6e7)).drop("_first")
