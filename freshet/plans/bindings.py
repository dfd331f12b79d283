"""The driver's tables in the terms of the library, as DataFrames and as SQL for the oracles.

A sample is an order (run) and a supplier (node); its volume is the discount of its lines, in exact ten-thousandths. The
drainage network is a binary tree over suppliers, whose root is the outfall. A node's series are a user's events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.functions.scalars import flood_label
from freshet.session import dealt, read_table

THRESHOLD = 1500.0
STEP = 60  # minutes

SAMPLES = """
samples AS (
  SELECT run_id, node_id, shape_id, scenario_type, network_id, factor_mult, t, CASE WHEN raw >= 1500 THEN raw ELSE 0.0 END AS vol, CAST(raw >= 1500 AS INTEGER) AS inunda,
    CASE WHEN raw >= 1500 THEN raw ELSE 0.0 END * (0.8e0 + CAST(node_id % 9 AS DOUBLE) * 0.05e0) + CAST(run_id % 7 AS DOUBLE) AS vol_pred,
    CAST(raw >= 1500 AS INTEGER) * 0.5e0 + CAST((run_id * 7 + node_id * 13) % 100 AS DOUBLE) / 200e0 AS prob,
    CAST(CAST(raw >= 1500 AS INTEGER) * 0.5e0 + CAST((run_id * 7 + node_id * 13) % 100 AS DOUBLE) / 200e0 >= 0.4e0 AS INTEGER) AS inunda_pred
  FROM (
    SELECT l_orderkey AS run_id, l_suppkey AS node_id, min(o_orderstatus) AS shape_id, min(o_orderpriority) AS scenario_type, min(s_nationkey) AS network_id,
      1e0 + CAST(l_orderkey % 5 AS DOUBLE) * 0.5e0 AS factor_mult, min(l_linenumber) AS t,
      CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / 10000e0 AS raw
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY l_orderkey, l_suppkey)
)"""
NODES = "nodes AS (SELECT s_suppkey AS node_id, CAST(s_suppkey % 13 AS DOUBLE) AS q_peak, CAST(s_suppkey % 11 AS DOUBLE) * 10 AS elevation, s_nationkey AS network_id, s_acctbal AS base FROM supplier)"
EDGES = """edges AS (
  SELECT s_suppkey AS from_node, CAST((s_suppkey - 1) // 2 AS BIGINT) AS to_node, CAST(s_suppkey % 7 + 1 AS DOUBLE) AS length, 0.2e0 + CAST(s_suppkey % 5 AS DOUBLE) * 0.1e0 AS diameter, 0.001e0 * CAST(s_suppkey % 9 + 1 AS DOUBLE) AS slope, 0.013e0 AS roughness
  FROM supplier WHERE s_suppkey > 0)"""
EVENTS = """ev AS (
  SELECT user_id, event_id, event_type, value, CAST(floor(epoch(ts - TIMESTAMP '2024-01-01') / 3600) AS INTEGER) * 60 AS t FROM events
), series AS (
  SELECT user_id, t, value, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, t ORDER BY event_id DESC) AS k FROM ev) WHERE k = 1
)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_discount")
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    suppliers = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long") * F.round(F.col("l_discount") * 100).cast("long")
    # lines are dealt by run once: their sums, the join with orders and whatever groups by run need no other shuffle of them
    dealt_lines = dealt(lines.select("l_orderkey", "l_suppkey", "l_linenumber", cents.alias("cents")), "l_orderkey")
    summed = dealt_lines.groupBy("l_orderkey", "l_suppkey").agg(F.sum("cents").alias("e"), F.min("l_linenumber").alias("t"))
    joined = summed.join(orders, F.col("o_orderkey") == F.col("l_orderkey")).join(suppliers, F.col("s_suppkey") == F.col("l_suppkey"))
    raw = F.col("e").cast("double") / 10000.0
    base = joined.select(F.col("l_orderkey").alias("run_id"), F.col("l_suppkey").alias("node_id"), F.col("o_orderstatus").alias("shape_id"), F.col("o_orderpriority").alias("scenario_type"), F.col("s_nationkey").alias("network_id"), (1.0 + (F.col("l_orderkey") % 5).cast("double") * 0.5).alias("factor_mult"), "t", F.when(raw >= THRESHOLD, raw).otherwise(0.0).alias("vol"), flood_label(raw, THRESHOLD).alias("inunda"))
    prob = F.col("inunda") * 0.5 + ((F.col("run_id") * 7 + F.col("node_id") * 13) % 100).cast("double") / 200.0
    return base.withColumns({"vol_pred": F.col("vol") * (0.8 + (F.col("node_id") % 9).cast("double") * 0.05) + (F.col("run_id") % 7).cast("double"), "prob": prob, "inunda_pred": (prob >= 0.4).cast("int")})


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read_table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("node_id"), (F.col("s_suppkey") % 13).cast("double").alias("q_peak"), ((F.col("s_suppkey") % 11).cast("double") * 10).alias("elevation"), F.col("s_nationkey").alias("network_id"), F.col("s_acctbal").alias("base"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return read_table(spark, sf_dir, "supplier").filter(k > 0).select(k.alias("from_node"), F.floor((k - 1) / 2).cast("long").alias("to_node"), (k % 7 + 1).cast("double").alias("length"), (0.2 + (k % 5).cast("double") * 0.1).alias("diameter"), (0.001 * (k % 9 + 1).cast("double")).alias("slope"), F.lit(0.013).alias("roughness"))


def outfalls(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.col("id").alias("node_id"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.timestamp_diff("SECOND", F.lit("2024-01-01").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))
    return read_table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", "props", (F.floor(seconds / 3600) * STEP).cast("int").alias("t"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    from freshet.operators.timeseries import keep_last

    return keep_last(events(spark, sf_dir).drop("props"), ["user_id", "t"], "event_id")
