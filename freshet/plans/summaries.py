"""Queries of grouped summaries, projections and sorts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from freshet.functions import scalars as S
from freshet.operators import aggregates as A
from freshet.operators import features as X
from freshet.operators import timeseries as T
from freshet.plans import bindings as B
from freshet.plans.registry import query
from freshet.session import read_table

WITH = f"WITH {B.SAMPLES} "


@query("a1_resilience_curve", WITH + "SELECT factor_mult, round(avg(CASE WHEN inunda = 0 THEN 1e0 ELSE 0e0 END), 9) AS resilience, count(*) AS n_nodes FROM samples GROUP BY factor_mult")
def a1(spark, sf):
    return A.resilience_curve(B.samples(spark, sf)).withColumn("resilience", F.round("resilience", 9))


@query("a2_volume_curve", WITH + "SELECT factor_mult, round(sum(vol), 4) AS truth, round(sum(CASE WHEN inunda_pred = 1 THEN vol_pred ELSE 0 END), 6) AS pred FROM samples GROUP BY factor_mult")
def a2(spark, sf):
    got = A.volume_curve(B.samples(spark, sf), ["factor_mult"], truth=F.col("vol"), pred=F.when(F.col("inunda_pred") == 1, F.col("vol_pred")).otherwise(0.0))
    return got.select("factor_mult", F.round("truth", 4).alias("truth"), F.round("pred", 6).alias("pred"))


@query("a3_rows_per_node", WITH + "SELECT node_id, count(*) AS rows FROM samples GROUP BY node_id")
def a3(spark, sf):
    return A.group_sizes(B.samples(spark, sf), "node_id")


@query("a4_rows_by_scenario", WITH + "SELECT scenario_type, count(*) AS rows, count(DISTINCT run_id) AS runs, count(DISTINCT node_id) AS nodes FROM samples GROUP BY scenario_type")
def a4(spark, sf):
    return A.group_profile(B.samples(spark, sf), "scenario_type", runs="run_id", nodes="node_id")


@query("a5_rows_by_network", WITH + "SELECT network_id, count(*) AS rows, count(DISTINCT run_id) AS runs, count(DISTINCT node_id) AS nodes FROM samples GROUP BY network_id")
def a5(spark, sf):
    return A.group_profile(B.samples(spark, sf), "network_id", runs="run_id", nodes="node_id")


@query("a6_group_size_range", WITH + "SELECT min(n) AS least, max(n) AS most, round(avg(n), 9) AS mean FROM (SELECT count(*) AS n FROM samples GROUP BY run_id)")
def a6(spark, sf):
    return A.group_size_range(B.samples(spark, sf), "run_id").withColumn("mean", F.round("mean", 9))


@query("a7_distinct_counts", WITH + "SELECT count(DISTINCT run_id) AS n_run_id, count(DISTINCT node_id) AS n_node_id, count(DISTINCT network_id) AS n_network_id, count(DISTINCT scenario_type) AS n_scenario_type FROM samples")
def a7(spark, sf):
    return A.distinct_counts(B.samples(spark, sf), "run_id", "node_id", "network_id", "scenario_type")


@query("a8_duplicates", "SELECT count(*) AS rows, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS duplicates FROM lineitem")
def a8(spark, sf):
    return A.duplicate_counts(read_table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber")


_GAPS = "CASE WHEN l_quantity > 40 THEN NULL ELSE l_quantity END AS quantity, CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_returnflag END AS flag, l_tax AS tax"


@query("a9_missing_by_column", f"WITH g AS (SELECT {_GAPS} FROM lineitem), n AS (SELECT count(*) AS n, count(quantity) AS q, count(flag) AS f, count(tax) AS t FROM g) SELECT 'quantity' AS \"column\", n - q AS missing, round(100e0 * (n - q) / n, 9) AS missing_pct FROM n UNION ALL SELECT 'flag', n - f, round(100e0 * (n - f) / n, 9) FROM n UNION ALL SELECT 'tax', n - t, round(100e0 * (n - t) / n, 9) FROM n")
def a9(spark, sf):
    gaps = read_table(spark, sf, "lineitem").selectExpr(*_GAPS.split(", "))
    return A.missing_by_column(gaps).withColumn("missing_pct", F.round("missing_pct", 9))


@query("a10_column_profile", f"WITH g AS (SELECT {_GAPS} FROM lineitem) SELECT 'quantity' AS \"column\", 'double' AS dtype, count(quantity) AS non_null, count(DISTINCT quantity) AS \"unique\" FROM g UNION ALL SELECT 'flag', 'string', count(flag), count(DISTINCT flag) FROM g UNION ALL SELECT 'tax', 'double', count(tax), count(DISTINCT tax) FROM g")
def a10(spark, sf):
    return A.column_profile(read_table(spark, sf, "lineitem").selectExpr(*_GAPS.split(", ")))


@query(
    "a11_target_describe",
    WITH
    + ", long AS (SELECT 'vol' AS target, vol AS x FROM samples UNION ALL SELECT 'vol_pred', vol_pred FROM samples) SELECT target, count(x) AS n, round(avg(x), 5) AS mean, round(stddev_samp(x), 5) AS std, min(x) AS least, round(quantile_cont(x, 0.25), 6) AS q25, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.75), 6) AS q75, max(x) AS most, round(avg(CASE WHEN x > 0 THEN 1e0 ELSE 0e0 END), 9) AS positive_rate FROM long GROUP BY target",
)
def a11(spark, sf):
    got = A.describe_targets(B.samples(spark, sf), ["vol", "vol_pred"])
    digits = {"mean": 5, "std": 5, "q25": 6, "median": 6, "q75": 6, "positive_rate": 9}
    return got.withColumns({c: F.round(c, d) for c, d in digits.items()})


@query(
    "a12_feature_percentiles",
    "WITH long AS (SELECT 'l_quantity' AS feature, l_quantity AS x FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem) SELECT feature, min(x) AS least, "
    + ", ".join(f"round(quantile_cont(x, {p}), 4) AS p{round(100 * p)}" for p in (0.01, 0.25, 0.5, 0.75, 0.99))
    + ", max(x) AS most FROM long GROUP BY feature",
)
def a12(spark, sf):
    got = A.feature_percentiles(read_table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"])
    return got.withColumns({c: F.round(c, 4) for c in ("p1", "p25", "p50", "p75", "p99")})


@query("a13_quality_report", WITH + "SELECT count(*) AS n_rows, count(DISTINCT run_id) AS n_runs, count(*) FILTER (inunda = 1) AS n_flooded, count(*) FILTER (inunda <> 1) AS n_dry, count(*) FILTER (CAST(vol > 1800 AS INTEGER) <> inunda) AS disagreements FROM samples")
def a13(spark, sf):
    return A.quality_report(B.samples(spark, sf), 1800.0)


@query("a13_flooded_by_factor", WITH + "SELECT factor_mult, count(*) AS rows, count(*) FILTER (inunda = 1) AS flooded FROM samples GROUP BY factor_mult")
def a13b(spark, sf):
    return A.conditional_counts(B.samples(spark, sf), "factor_mult", flooded=F.col("inunda") == 1)


@query("a15_snapshot_check", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1 ORDER BY n DESC, l_orderkey, l_linenumber LIMIT 3")
def a15(spark, sf):
    return A.repeated_keys(read_table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], 3)


@query("a17_first_by_order", "SELECT l_suppkey, min_by(l_quantity, l_orderkey * 1000000 + l_linenumber * 1000 + l_quantity) AS l_quantity FROM lineitem GROUP BY l_suppkey")
def a17(spark, sf):
    lines = read_table(spark, sf, "lineitem").withColumn("ord", F.col("l_orderkey") * 1000000 + F.col("l_linenumber") * 1000 + F.col("l_quantity"))
    return A.first_by(lines, "l_suppkey", "l_quantity", "ord")


@query("a18_largest_volume", WITH + "SELECT CASE WHEN max(vol) > 0 THEN max(vol) ELSE 1e0 END AS largest FROM samples")
def a18(spark, sf):
    return A.largest_or(B.samples(spark, sf), "vol", 1.0)


@query("a20_run_summary", WITH + "SELECT run_id, count(*) AS total_nodes, count(*) FILTER (vol > 0) AS failed_nodes, round(sum(vol), 4) AS total_volume, round(100e0 * count(*) FILTER (vol > 0) / count(*), 6) AS pct_flooded, round(1e0 - CAST(count(*) FILTER (vol > 0) AS DOUBLE) / count(*), 9) AS resilience_index, min(CASE WHEN vol > 0 THEN t END) AS first_flood FROM samples GROUP BY run_id")
def a20(spark, sf):
    return A.run_summary(B.samples(spark, sf)).withColumns({"total_volume": F.round("total_volume", 4), "pct_flooded": F.round("pct_flooded", 6), "resilience_index": F.round(1 - F.col("failed_nodes") / F.col("total_nodes"), 9)})


@query(
    "a21_link_aggregates",
    f"WITH {B.EDGES}, c AS (SELECT *, 1e0 / roughness * 3.141592653589793e0 * power(diameter, 2) / 4 * power(diameter / 4, 2e0 / 3e0) * sqrt(slope) * 1000 AS capacity FROM edges), "
    + ", ".join(f"{tag} AS (SELECT {end} AS node_id, count(*) AS n_{tag}, max(diameter) AS diameter_max_{tag}, min(diameter) AS diameter_min_{tag}, round(avg(diameter), 9) AS diameter_avg_{tag}, max(abs(slope)) AS slope_max_{tag}, round(sum(capacity), 5) AS capacity_{tag} FROM c GROUP BY {end})" for end, tag in (("to_node", "up"), ("from_node", "down"))).replace("_up", "_in").replace("_down", "_out")
    + " SELECT node_id, coalesce(n_in, 0) AS n_in, diameter_max_in, diameter_min_in, diameter_avg_in, slope_max_in, capacity_in, coalesce(n_out, 0) AS n_out, diameter_max_out, diameter_min_out, diameter_avg_out, slope_max_out, capacity_out FROM up FULL JOIN down USING (node_id)",
)
def a21(spark, sf):
    e = B.edges(spark, sf).withColumn("capacity", S.full_flow_lps(F.col("diameter"), F.col("slope"), F.col("roughness")))
    return A.link_aggregates(e).withColumns({c: F.round(c, d) for c, d in {"diameter_avg_in": 9, "diameter_avg_out": 9, "capacity_in": 5, "capacity_out": 5}.items()})


@query("a25_peaks", f"WITH {B.EVENTS} SELECT user_id, max(value) AS peak, min(t) FILTER (value = m) AS time_of_peak, max(abs(value)) AS peak_abs FROM (SELECT *, max(value) OVER (PARTITION BY user_id) AS m FROM series) GROUP BY user_id")
def a25(spark, sf):
    return A.peaks(B.series(spark, sf), "user_id", "t", "value")


@query("a26_json_peaks", f"WITH {B.EVENTS}, b AS (SELECT user_id, event_type, CAST(floor(max(value)) AS BIGINT) AS v FROM series GROUP BY ALL HAVING max(value) > 0 AND floor(max(value)) > 0) SELECT user_id, '{{' || string_agg('\"' || event_type || '\":' || v, ',' ORDER BY event_type) || '}}' AS peaks FROM b GROUP BY user_id")
def a26(spark, sf):
    flows = B.series(spark, sf).withColumn("value", F.floor("value").cast("long"))
    return A.json_map_of_peaks(flows, "user_id", "event_type", "value")


@query("a27_window_votes", WITH + "SELECT node_id, max(prob) AS most, round(avg(prob), 9) AS mean, count(prob) AS windows, count(*) FILTER (prob >= 0.5) AS votes FROM samples GROUP BY node_id")
def a27(spark, sf):
    return A.window_votes(B.samples(spark, sf), "node_id", "prob").withColumn("mean", F.round("mean", 9))


@query("a28_scenario_totals", WITH + "SELECT scenario_type, round(sum(vol), 4) AS total_truth, round(sum(vol_pred), 6) AS total_pred, round(sum(vol_pred) - sum(vol), 6) AS error, round(CASE WHEN sum(vol) > 0 THEN 100 * (sum(vol_pred) - sum(vol)) / sum(vol) END, 6) AS error_pct, count(*) FILTER (vol_pred > 4000) AS n_flagged FROM samples GROUP BY scenario_type")
def a28(spark, sf):
    got = A.scenario_totals(B.samples(spark, sf).withColumn("flag", F.col("vol_pred") > 4000), "scenario_type", "vol", "vol_pred", "flag")
    return got.withColumns({c: F.round(c, d) for c, d in {"total_truth": 4, "total_pred": 6, "error": 6, "error_pct": 6}.items()})


@query("a29_speed_ups", "SELECT round(sum(l_quantity), 2) AS total_slow, round(sum(l_tax), 2) AS total_fast, round(avg(CASE WHEN l_tax <> 0 THEN l_quantity / l_tax END), 6) AS mean_speed_up FROM lineitem")
def a29(spark, sf):
    return A.speed_ups(read_table(spark, sf, "lineitem"), "l_quantity", "l_tax").select(F.round("total_slow", 2).alias("total_slow"), F.round("total_fast", 2).alias("total_fast"), F.round("mean_speed_up", 6).alias("mean_speed_up"))


@query("a31_not_exactly_one", WITH + "SELECT run_id, count(*) FILTER (inunda = 1) AS n FROM samples GROUP BY run_id HAVING count(*) FILTER (inunda = 1) <> 1")
def a31(spark, sf):
    return A.not_exactly_one(B.samples(spark, sf), "run_id", F.col("inunda") == 1)


@query("a34_plausible_depths", "SELECT count(s_acctbal) AS n, round(avg(CASE WHEN s_acctbal > 10 THEN 1e0 ELSE 0e0 END), 9) AS deep_share, round(median(s_acctbal), 6) AS median, count(s_acctbal) >= 20 AND avg(CASE WHEN s_acctbal > 10 THEN 1e0 ELSE 0e0 END) >= 0.25 AS suspicious FROM supplier")
def a34(spark, sf):
    return A.plausible_depths(read_table(spark, sf, "supplier"), "s_acctbal").withColumns({"deep_share": F.round("deep_share", 9), "median": F.round("median", 6)})


@query("a35_numeric_range", "SELECT min(try_cast(regexp_extract(c_name, '[0-9]+') AS DOUBLE)) AS least, max(try_cast(regexp_extract(c_name, '[0-9]+') AS DOUBLE)) AS most FROM customer")
def a35(spark, sf):
    return A.numeric_range(read_table(spark, sf, "customer").select(F.regexp_extract("c_name", "[0-9]+", 0).alias("v")), "v")


@query("a36_unfinished", f"WITH {B.EVENTS}, g AS (SELECT user_id, max(value) AS peak, max_by(value, t) AS last FROM series GROUP BY user_id) SELECT * FROM g WHERE last > 0.5 * peak")
def a36(spark, sf):
    return A.unfinished(B.series(spark, sf), "user_id", "t", "value", share=0.5)


@query("p2_dynamic_features", f"WITH {B.NODES} SELECT node_id, q_peak, f AS factor_mult, q_peak * f AS q_pico_nodo, q_peak * 2 * f AS q_pico_acum_escalado, q_peak * 2 AS total FROM nodes, (VALUES (1e0), (1.5e0), (2e0)) v(f)")
def p2(spark, sf):
    factors = X.factor_range(spark, 1.0, 2.0, 0.5)
    return X.dynamic_features(B.nodes(spark, sf).select("node_id", "q_peak", (F.col("q_peak") * 2).alias("total")), factors, "q_peak", "total")


@query("p4_factor_slice", WITH + "SELECT factor_mult, count(*) AS rows FROM samples WHERE abs(factor_mult - 1.5e0) < 1e-6 GROUP BY factor_mult")
def p4(spark, sf):
    return X.factor_slice(B.samples(spark, sf), 1.5).groupBy("factor_mult").agg(F.count(F.lit(1)).alias("rows"))


@query("p12_scenario_keys", WITH + "SELECT DISTINCT shape_id, factor_mult, printf('%s__f%.2f', shape_id, factor_mult) AS scenario_key FROM samples")
def p12(spark, sf):
    return B.samples(spark, sf).select("shape_id", "factor_mult").distinct().withColumn("scenario_key", S.scenario_key(F.col("shape_id"), F.col("factor_mult")))


@query("p17_label_normalise", r"SELECT DISTINCT o_orderpriority AS raw, trim(regexp_replace(lower(trim(o_orderpriority)), '[^a-z0-9]+', '_', 'g'), '_') AS label FROM orders")
def p17(spark, sf):
    return read_table(spark, sf, "orders").select(F.col("o_orderpriority").alias("raw")).distinct().withColumn("label", S.scenario_label(F.col("raw")))


@query("s7_captions", f"WITH {B.SAMPLES} SELECT run_id, node_id, shape_id || '__f' || printf('%.2f', factor_mult) AS scenario, printf('%d:%02d', t * 50 // 60, t * 50 % 60) AS clock, CASE WHEN t > 3 THEN printf('%.2f s', t / 4e0) ELSE printf('%.4f s', t / 4e0) END AS runtime FROM samples")
def s7(spark, sf):
    rows = B.samples(spark, sf)
    hours, seconds = F.col("t") * 50 / F.lit(60.0), F.col("t") / F.lit(4.0)
    return rows.select("run_id", "node_id", S.scenario_key(F.col("shape_id"), F.col("factor_mult")).alias("scenario"), S.hours_to_clock(hours).alias("clock"), S.runtime_caption(seconds).alias("runtime"))


@query("p19_one_hot", "SELECT l_orderkey, l_linenumber, l_returnflag, CAST(l_returnflag = 'N' AS INTEGER) AS l_returnflag_N, CAST(l_returnflag = 'R' AS INTEGER) AS l_returnflag_R FROM lineitem")
def p19(spark, sf):
    return X.one_hot(read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), "l_returnflag", ["R", "A", "N"])


@query("p24_extrapolation", "SELECT l_orderkey, l_linenumber, l_quantity, l_discount, CASE WHEN l_discount > 0 THEN l_quantity / l_discount < 300 OR l_quantity / l_discount > 700 ELSE l_quantity > 0 END AS outside FROM lineitem")
def p24(spark, sf):
    lines = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return lines.withColumn("outside", S.extrapolates(F.col("l_quantity"), F.col("l_discount"), F.lit(300.0), F.lit(700.0)))


@query("p31_midpoints", WITH + "SELECT (f + n) / 2 AS factor_mult FROM (SELECT f, lead(f) OVER (ORDER BY f) AS n FROM (SELECT DISTINCT factor_mult AS f FROM samples)) WHERE n IS NOT NULL")
def p31(spark, sf):
    return T.midpoints(B.samples(spark, sf), "factor_mult")


@query("p32_spread_pairs", "WITH n AS (SELECT s_suppkey AS node_id, CAST(s_suppkey // 2 AS DOUBLE) AS x, CAST(s_suppkey % 40 // 2 AS DOUBLE) AS y FROM supplier) SELECT node_id, CASE WHEN count(*) OVER (PARTITION BY x, y) = 2 THEN x + CASE WHEN row_number() OVER (PARTITION BY x, y ORDER BY node_id) = 1 THEN -2 ELSE 2 END ELSE x END AS x, y FROM n")
def p32(spark, sf):
    k = F.col("s_suppkey")
    return X.spread_pairs(read_table(spark, sf, "supplier").select(k.alias("node_id"), F.floor(k / 2).cast("double").alias("x"), F.floor((k % 40) / 2).cast("double").alias("y")))


@query("p33_marker_size", WITH + ", v AS (SELECT node_id, max(vol) AS vol FROM samples GROUP BY node_id) SELECT node_id, round(20 + least(greatest(vol / (SELECT max(vol) FROM v), 0), 1) * 180, 6) AS size FROM v")
def p33(spark, sf):
    v = B.samples(spark, sf).groupBy("node_id").agg(F.max("vol").alias("vol"))
    return v.withColumn("m", F.max("vol").over(Window.partitionBy())).select("node_id", F.round(S.marker_size(F.col("vol"), F.col("m"), 20.0, 200.0), 6).alias("size"))


@query("p36_regimes", WITH + ", r AS (SELECT min(factor_mult) AS a, max(factor_mult) AS b FROM samples WHERE shape_id = 'F' AND run_id % 5 BETWEEN 1 AND 3) SELECT run_id, node_id, factor_mult, CASE WHEN factor_mult BETWEEN a AND b THEN 'INTERPOLATION' ELSE 'EXTRAPOLATION' END AS regime FROM samples, r")
def p36(spark, sf):
    s = B.samples(spark, sf)
    return X.regimes(s.select("run_id", "node_id", "factor_mult"), s.filter("shape_id = 'F' AND run_id % 5 BETWEEN 1 AND 3"), "factor_mult")


@query("s1_scalar_functions", r"SELECT n_name AS name, regexp_extract(n_nationkey || 'C', '^(\d+)', 1) AS node_label, printf('%d:%02d', (n_nationkey * 7) // 60, (n_nationkey * 7) % 60) AS clock, CAST(n_nationkey * 7 AS DOUBLE) / 60 AS hours, CASE WHEN n_nationkey >= 1 THEN printf('%.2f s', CAST(n_nationkey AS DOUBLE)) ELSE printf('%.4f s', CAST(n_nationkey AS DOUBLE)) END AS caption, sha256(n_name) AS digest, md5(n_name) AS md5 FROM nation")
def s1(spark, sf):
    k = F.col("n_nationkey")
    hours = (k * 7).cast("double") / 60
    return read_table(spark, sf, "nation").select(F.col("n_name").alias("name"), S.node_label(F.concat(k.cast("string"), F.lit("C"))).alias("node_label"), S.hours_to_clock(hours).alias("clock"), hours.alias("hours"), S.runtime_caption(k.cast("double")).alias("caption"), S.sha256(F.col("n_name")).alias("digest"), F.md5("n_name").alias("md5"))


@query("o6_top_nodes", WITH + "SELECT node_id, round(sum(vol), 4) AS vol FROM samples GROUP BY node_id ORDER BY sum(vol) DESC, node_id LIMIT 10")
def o6(spark, sf):
    return B.samples(spark, sf).groupBy("node_id").agg(F.sum("vol").alias("v")).orderBy(F.desc("v"), "node_id").limit(10).select("node_id", F.round("v", 4).alias("vol"))


@query("o8_node_profile", WITH + "SELECT run_id, node_id, vol, vol_pred FROM samples WHERE vol > 0 OR inunda_pred = 1")
def o8(spark, sf):
    return B.samples(spark, sf).filter("vol > 0 OR inunda_pred = 1").select("run_id", "node_id", "vol", "vol_pred").orderBy(F.desc("vol"), "run_id", "node_id")


@query("u12_distinct_factors", WITH + "SELECT DISTINCT factor_mult FROM samples")
def u12(spark, sf):
    return B.samples(spark, sf).select("factor_mult").distinct().orderBy("factor_mult")
