"""Queries of fitted regressions, guards of base inputs and artifacts, and resets. Least squares has a closed form, so SQL
states the results of the fits as well."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.operators import aggregates as A
from freshet.operators import datasets as D
from freshet.operators import features as X
from freshet.operators import relations as R
from freshet.operators import trials as L
from freshet.operators import validation as V
from freshet.plans import bindings as B
from freshet.plans.columns import folder
from freshet.plans.datasets import run_tables
from freshet.plans.registry import query
from freshet.plans.scores import rounded
from freshet.session import read_table
from freshet.sources import sinks, tables

FEATURES, TARGET = ["l_quantity", "l_discount"], "l_extendedprice"
#: Least squares over the lines of all other return flags, by moments: with both features (ef) and with quantity alone (er).
_FITS = """WITH g AS (SELECT DISTINCT l_returnflag AS fold FROM lineitem), m AS (
  SELECT fold, avg(l_quantity) AS mq, avg(l_discount) AS md, avg(l_extendedprice) AS my, var_pop(l_quantity) AS qq, var_pop(l_discount) AS dd, covar_pop(l_quantity, l_discount) AS qd,
    covar_pop(l_extendedprice, l_quantity) AS yq, covar_pop(l_extendedprice, l_discount) AS yd FROM lineitem JOIN g ON l_returnflag <> fold GROUP BY fold
), e AS (
  SELECT fold, l_extendedprice AS y, l_extendedprice - my - (yq * dd - yd * qd) / (qq * dd - qd * qd) * (l_quantity - mq) - (yd * qq - yq * qd) / (qq * dd - qd * qd) * (l_discount - md) AS ef,
    l_extendedprice - my - yq / qq * (l_quantity - mq) AS er FROM lineitem JOIN m ON l_returnflag = fold
) """
_R2 = "round(1 - sum(ef * ef) / (var_pop(y) * count(*)), 7)"


def lines(spark, sf):
    return read_table(spark, sf, "lineitem").select("l_returnflag", TARGET, *FEATURES)


@query("k23_ablation", _FITS + "SELECT fold AS l_returnflag, round(sqrt(avg(ef * ef)), 3) AS full_rmse, round(sqrt(avg(er * er)), 3) AS reduced_rmse FROM e GROUP BY fold")
def k23(spark, sf):
    got = L.ablation(lines(spark, sf), "l_returnflag", FEATURES, ["l_discount"], TARGET, L.REGRESSORS["least_squares"])
    return rounded(got, full_rmse=3, reduced_rmse=3).drop("added")


@query("r25_grouped_evaluation", _FITS + f"SELECT 'least_squares' AS model, fold AS l_returnflag, round(sqrt(avg(ef * ef)), 3) AS rmse, round(avg(abs(ef)), 3) AS mae, {_R2} AS r2, count(*) AS n FROM e GROUP BY fold")
def r25(spark, sf):
    got = L.evaluated(lines(spark, sf), "l_returnflag", FEATURES, TARGET, {"least_squares": L.REGRESSORS["least_squares"]})
    return rounded(got, rmse=3, mae=3, r2=7).select("model", "l_returnflag", "rmse", "mae", "r2", "n")


@query("r23_components_pipeline", _FITS + f", s AS (SELECT fold, sqrt(avg(ef * ef)) AS rmse, {_R2} AS r2 FROM e GROUP BY fold) SELECT 'components' AS model, round(avg(rmse), 3) AS rmse, round(avg(r2), 6) AS r2, count(*) AS folds FROM s")
def r23(spark, sf):
    """All components of the features span the same plane, so the errors are those of the features."""
    got = L.evaluated(lines(spark, sf), "l_returnflag", FEATURES, TARGET, {"components": L.REGRESSORS["least_squares"]}, components=5)
    return rounded(L.ranked_models(got), rmse=3, r2=6).drop("mae")


@query(
    "f13_saved_predictions",
    "WITH b AS (SELECT regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS intercept FROM lineitem) SELECT s_suppkey AS node_id, f AS factor_mult, round(greatest(intercept + slope * (s_suppkey % 50 - 5) * f, 0e0), 4) AS predicted FROM supplier, b, (VALUES (1e0), (1.5e0), (2e0)) v(f)",
)
def f13(spark, sf):
    place = folder(spark)
    fitted = L.fit_regression(lines(spark, sf), ["l_quantity"], TARGET, L.REGRESSORS["least_squares"])
    L.save(fitted, f"{place}/candidate", spark, family="least_squares")
    L.promote(spark, f"{place}/candidate", f"{place}/current", TARGET, ranking_id=1)
    current, _ = L.load(spark, f"{place}/current", TARGET)
    nodes = read_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("node_id"), (F.col("s_suppkey") % 50 - 5).cast("double").alias("l_quantity"))
    factors = X.factor_range(spark, 1.0, 2.0, 0.5)
    return rounded(L.network_predictions(current, nodes, factors, "l_quantity"), predicted=4)


@query("j14_window_runs", "SELECT l_orderkey AS run_id, l_partkey AS regression_id, l_linenumber AS start, p_retailprice AS rmse, o_orderpriority AS scenario_id FROM lineitem JOIN part ON p_partkey = l_partkey AND p_partkey % 3 > 0 JOIN orders ON o_orderkey = l_orderkey AND o_orderstatus = 'F'")
def j14(spark, sf):
    windows = read_table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_partkey").alias("regression_id"), F.col("l_linenumber").alias("start"))
    return R.window_runs(windows, *regressions_and_runs(spark, sf))


def regressions_and_runs(spark, sf):
    regressions = read_table(spark, sf, "part").filter("p_partkey % 3 > 0").select(F.col("p_partkey").alias("regression_id"), F.col("p_retailprice").alias("rmse"))
    runs = read_table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("scenario_id"))
    return regressions, runs


@query("r38_window_summary", "WITH w AS (SELECT l_orderkey AS run_id, p_retailprice AS rmse FROM lineitem JOIN part ON p_partkey = l_partkey AND p_partkey % 3 > 0 JOIN orders ON o_orderkey = l_orderkey AND o_orderstatus = 'F') SELECT run_id, count(*) AS windows, min(rmse) AS best, max(rmse) AS worst FROM w GROUP BY run_id")
def r38(spark, sf):
    return j14(spark, sf).groupBy("run_id").agg(F.count(F.lit(1)).alias("windows"), F.min("rmse").alias("best"), F.max("rmse").alias("worst"))


@query(
    "v12_base_guards",
    "WITH n AS (SELECT s_suppkey AS network_id, CASE s_suppkey % 4 WHEN 0 THEN 'CMS' WHEN 1 THEN ' lps ' WHEN 2 THEN 'LPS' END AS units, s_suppkey % 6 = 0 AS ponding, s_suppkey % 5 = 0 AND s_suppkey % 10 > 0 AS differs FROM supplier) SELECT network_id, 'error' AS level, 'flow_units' AS rule FROM n WHERE units IS NULL OR units = 'CMS' UNION ALL SELECT network_id, 'error', 'content' FROM n WHERE differs UNION ALL SELECT network_id, 'warning', 'ponding' FROM n WHERE ponding",
)
def v12(spark, sf):
    k = F.col("s_suppkey")
    units = F.when(k % 4 == 0, "CMS").when(k % 4 == 1, " lps ").when(k % 4 == 2, "LPS")
    networks = read_table(spark, sf, "supplier").select(
        k.alias("network_id"), units.alias("flow_units"), (k % 6 == 0).alias("ponding"), F.col("s_name").alias("content"),
        F.when(k % 5 == 0, F.md5(F.lit("other").cast("binary"))).otherwise(F.upper(F.md5(F.col("s_name").cast("binary")))).alias("expected_md5"), (k % 10 == 0).alias("overridden"),
    )
    return V.base_guards(networks)


@query("v15_low_multipliers", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber = 3 OR l_tax < 0.03")
def v15(spark, sf):
    asked = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") != 3, F.col("l_tax").cast("string")).otherwise("x").alias("multiplier"))
    return V.low_multipliers(asked, "multiplier", 0.03).drop("multiplier")


@query("v11_other_definitions", "SELECT o_orderkey, o_orderpriority AS part FROM orders WHERE o_orderkey % 7 = 0 OR o_orderpriority NOT IN (SELECT max(o_orderpriority) FROM orders UNION SELECT min(o_orderpriority) FROM orders)")
def v11(spark, sf):
    orders = read_table(spark, sf, "orders")
    part = F.col("o_orderpriority")
    manifest = orders.agg(F.array(F.min(part), F.max(part)).alias("p")).select(F.explode("p").alias("part")).withColumn("prep_id", F.substring(F.sha2("part", 256), 1, 16))
    parts = orders.select("o_orderkey", part.alias("part"), F.when(F.col("o_orderkey") % 7 != 0, F.substring(F.sha2(part, 256), 1, 16)).otherwise("stale").alias("prep_id"))
    return V.other_definitions(parts, manifest, "part", "prep_id").drop("prep_id")


@query("r7_numeric_missing", "WITH c AS (SELECT count(*) FILTER (event_id % 5 = 0) AS v, count(*) FILTER (user_id IS NULL) AS u, count(*) FILTER (event_id IS NULL) AS e FROM events) SELECT 'value' AS \"column\", v AS missing FROM c UNION ALL SELECT 'user_id', u FROM c UNION ALL SELECT 'event_id', e FROM c UNION ALL SELECT 'total', v + u + e FROM c")
def r7(spark, sf):
    events = read_table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type", F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("value"))
    return A.numeric_missing(events.withColumn("event_type", F.nullif("event_type", F.lit("click"))))


_COLUMNS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


@query("r5_column_roles", "WITH f AS (" + " UNION ALL ".join(f"SELECT '{c}' AS name, count(CASE WHEN l_linenumber <> 2 THEN {c} END) AS filled FROM lineitem" for c in _COLUMNS) + ") SELECT name, filled, CASE WHEN name IN ('l_orderkey', 'l_partkey', 'l_suppkey') THEN 'keys' WHEN name IN ('l_quantity', 'l_discount', 'l_tax') THEN 'features' WHEN name = 'l_extendedprice' THEN 'targets' ELSE 'unclassified' END AS role FROM f")
def r5(spark, sf):
    roles = {"keys": ["l_orderkey", "l_partkey", "l_suppkey"], "features": ["l_quantity", "l_discount", "l_tax", "absent"], "targets": ["l_extendedprice"]}
    lines_ = read_table(spark, sf, "lineitem").select(*[F.when(F.col("l_linenumber") != 2, F.col(c)).alias(c) for c in _COLUMNS])
    found = {name: role for role, names in D.column_roles(lines_.columns, roles).items() for name in names}
    role = F.create_map(*[F.lit(x) for pair in found.items() for x in pair])
    filled = lines_.agg(*[F.count(c).alias(c) for c in lines_.columns]).unpivot([], list(_COLUMNS), "name", "filled")
    return filled.withColumn("role", role[F.col("name")])


@query("snk18_reset_counts", "WITH d AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') SELECT 'orders' AS \"table\", count(*) FILTER (o_orderkey IN (FROM d)) AS deleted, count(*) FILTER (o_orderkey NOT IN (FROM d)) AS kept FROM orders UNION ALL SELECT 'lineitem', count(*) FILTER (l_orderkey IN (FROM d)), count(*) FILTER (l_orderkey NOT IN (FROM d)) FROM lineitem")
def snk18(spark, sf):
    orders = read_table(spark, sf, "orders").withColumnRenamed("o_orderkey", "run_id")
    tables_ = {"orders": orders, "lineitem": read_table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run_id"))}
    return R.split_off(tables_, orders.filter("o_orderstatus = 'P'"), "run_id")[1]


@query("snk5_flat_dataset", f"WITH {B.SAMPLES} SELECT s.run_id, s.node_id, s.network_id, s.inunda, round(s.vol, 4) AS vol, p.quantity FROM samples s JOIN (SELECT l_orderkey AS run_id, l_suppkey AS node_id, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1, 2) p USING (run_id, node_id) JOIN orders ON o_orderkey = s.run_id AND o_orderstatus = 'F'")
def snk5(spark, sf):
    """A flat dataset written as CSV by network and read back."""
    runs, features, _ = run_tables(spark, sf)
    done = runs.filter("status = 'COMPLETE'").select("run_id")
    flat = B.samples(spark, sf).select("run_id", "node_id", "network_id", "inunda", F.round("vol", 4).alias("vol")).join(done, "run_id", "left_semi").join(features.select("run_id", "node_id", "quantity"), ["run_id", "node_id"])
    path = folder(spark)
    sinks.write_csv(flat, path)
    return tables.read_csv(spark, path, flat.schema)


@query("snk14_training_results", _FITS + "SELECT 'folds' AS \"table\", fold, round(sqrt(avg(ef * ef)), 3) AS score FROM e GROUP BY fold UNION ALL SELECT 'oof', fold, count(*) FROM e GROUP BY fold")
def snk14(spark, sf):
    """Scores of folds and sizes of what they predict, appended to tables whose columns a batch may lack, and read back."""
    scores = L.evaluated(lines(spark, sf), "l_returnflag", FEATURES, TARGET, {"least_squares": L.REGRESSORS["least_squares"]})
    scores = scores.select(F.col("l_returnflag").alias("fold"), F.round("rmse", 3).alias("score"), F.col("n").cast("double").alias("size"))
    path = folder(spark)
    schemas = {"folds": ["fold", "score", "note"], "oof": ["fold", "score", "note"]}
    sinks.append_results({"folds": scores.select("fold", "score"), "oof": scores.select("fold", F.col("size").alias("score"))}, path, schemas)
    read = [spark.read.parquet(f"{path}/{t}").filter("note IS NULL").select(F.lit(t).alias("table"), "fold", "score") for t in schemas]
    return read[0].unionByName(read[1])
