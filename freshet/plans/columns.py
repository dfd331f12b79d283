"""Queries of column functions and projections, over whole tables: arithmetic, texts, times, JSON, labels, features."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.functions import scalars as S
from freshet.operators import aggregates as A
from freshet.operators import datasets as D
from freshet.operators import evidence as E
from freshet.operators import features as X
from freshet.operators import folds as K
from freshet.operators import metrics as M
from freshet.operators import relations as R
from freshet.operators import timeseries as T
from freshet.operators import validation as V
from freshet.plans import bindings as B
from freshet.plans.registry import query
from freshet.session import new_folder, read_table, settled
from freshet.sources import sinks, tables
from freshet.streaming import events as events_

WITH = f"WITH {B.SAMPLES} "
_KEYS = ("l_orderkey", "l_linenumber")


def lines(spark, sf, *columns):
    return read_table(spark, sf, "lineitem").select(*_KEYS, *columns)


@query("m1_rounding", "SELECT l_orderkey, l_linenumber, round_even(l_orderkey / 8e0, 2) AS half_even, round(l_orderkey / 8e0, 2) AS half_up, CASE WHEN l_linenumber <> 3 THEN round_even(l_orderkey / 8e0, 0) END AS safe FROM lineitem")
def m1(spark, sf):
    x = F.col("l_orderkey") / 8.0
    return lines(spark, sf, S.half_even(x, 2).alias("half_even"), F.round(x, 2).alias("half_up"), S.half_even(F.when(F.col("l_linenumber") != 3, x)).alias("safe"))


@query(
    "m2_guarded_arithmetic",
    "SELECT l_orderkey, l_linenumber, least(greatest(l_quantity - 25, -10), 10) AS clipped, abs(l_quantity - 25) AS size, CASE WHEN l_discount <> 0 THEN l_tax / l_discount END AS ratio, CASE WHEN l_discount <> 0 THEN l_tax / l_discount ELSE 0 END AS ratio_or_zero, round(1 / (1 + exp(-(l_quantity - 25) / 10)), 9) AS p, CAST(1 / (1 + exp(-(l_quantity - 25) / 10)) >= 0.5 AS INTEGER) AS cls, round(exp(ln(1 + l_quantity)) - 1, 6) AS back, greatest(exp(l_tax - 0.04) - 1, 0) > 0 AS positive, CASE WHEN l_linenumber > 1 THEN l_quantity END AS finite FROM lineitem",
)
def m2(spark, sf):
    q, tax, discount = F.col("l_quantity"), F.col("l_tax"), F.col("l_discount")
    z = (q - 25) / 10
    odd = F.when(F.col("l_linenumber") == 1, F.lit(float("nan"))).otherwise(q)
    return lines(
        spark, sf, S.clip(q - 25, -10.0, 10.0).alias("clipped"), F.abs(q - 25).alias("size"), S.ratio(tax, discount).alias("ratio"), S.ratio_or_zero(tax, discount).alias("ratio_or_zero"),
        F.round(S.sigmoid(z), 9).alias("p"), (S.sigmoid(z) >= 0.5).cast("int").alias("cls"), F.round(F.expm1(F.log1p(q)), 6).alias("back"), (F.greatest(F.expm1(tax - 0.04), F.lit(0.0)) > 0).alias("positive"), S.missing_if_nan(odd).alias("finite"),
    )


@query("m8_coercion", "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k, try_cast(CASE WHEN event_type = 'error' THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS value FROM events")
def m8(spark, sf):
    e = read_table(spark, sf, "events")
    return e.select("event_id", S.as_number(F.get_json_object("props", "$.k")).alias("k"), S.as_number(F.when(F.col("event_type") == "error", "n/a").otherwise(F.col("value").cast("string"))).alias("value"))


@query("p1_labels", WITH + "SELECT run_id, node_id, CAST(vol_pred >= 2000 AS INTEGER) AS above, CAST(vol > 0 AS INTEGER) AS positive, CASE WHEN inunda_pred = 1 THEN greatest(vol_pred, 0) ELSE 0 END AS routed, vol_pred - vol AS error, abs(vol_pred - vol) AS abs_error, CAST(inunda = inunda_pred AS INTEGER) AS correct FROM samples")
def p1(spark, sf):
    s = B.samples(spark, sf)
    pred = s.select("run_id", "node_id", "vol_pred", "inunda_pred")
    both = R.compare(s.select("run_id", "node_id", "vol", "inunda"), pred, ["run_id", "node_id"])
    return both.select("run_id", "node_id", S.flood_label(F.col("vol_pred"), 2000.0).alias("above"), S.flood_label(F.col("vol"), 0.0).alias("positive"), F.when(F.col("inunda_pred") == 1, F.greatest(F.col("vol_pred"), F.lit(0.0))).otherwise(0.0).alias("routed"), "error", "abs_error", "correct")


@query("p3_shape_rows", WITH + "SELECT 'base' AS part, count(*) AS n FROM samples WHERE shape_id = 'F' UNION ALL SELECT 'augmented', count(*) FROM samples WHERE shape_id <> 'F' UNION ALL SELECT 'unshaped', count(*) FROM samples UNION ALL SELECT 'unshaped_augmented', 0")
def p3(spark, sf):
    s = B.samples(spark, sf)
    bare = s.drop("shape_id")
    parts = {"base": X.base_rows(s, "F"), "augmented": X.augmented_rows(s, "F"), "unshaped": X.base_rows(bare), "unshaped_augmented": X.augmented_rows(bare)}
    out = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n") for name, df in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("p5_numeric_features", "SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END, 0) AS target FROM orders")
def p5(spark, sf):
    o = read_table(spark, sf, "orders").withColumn("target", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")))
    return X.numeric_features(o, "target", ["o_custkey", "o_totalprice"])


@query("p7_aligned", "SELECT CAST(NULL AS DOUBLE) AS capacity, s_acctbal, s_suppkey FROM supplier")
def p7(spark, sf):
    return X.aligned(read_table(spark, sf, "supplier"), ["capacity", "s_acctbal", "s_suppkey"])


@query("p10_surrogate_keys", "SELECT sha256(n_name) AS content, row_number() OVER (ORDER BY sha256(n_name)) AS network_id FROM nation")
def p10(spark, sf):
    return sinks.with_surrogate_keys(read_table(spark, sf, "nation").select(S.sha256(F.col("n_name")).alias("content")), ["content"], "network_id")


@query("p11_first_of_each", "SELECT l_suppkey AS node_id, l_orderkey, l_linenumber, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_quantity) AS k FROM lineitem) WHERE k = 1")
def p11(spark, sf):
    first = F.min(F.struct(*_KEYS, "l_quantity")).alias("m")
    return read_table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("node_id")).agg(first).select("node_id", "m.*")


@query("p14_prediction_rows", "SELECT l_suppkey AS node_id, q.quantity, f AS factor_mult, 4e0 AS duration FROM (SELECT l_suppkey, arg_min(l_quantity, l_orderkey * 1000 + l_linenumber + l_quantity / 1000) AS quantity FROM lineitem GROUP BY 1) q, (VALUES (1e0), (1.5e0), (2e0)) v(f)")
def p14(spark, sf):
    order = F.col("l_orderkey") * 1000 + F.col("l_linenumber") + F.col("l_quantity") / 1000
    nodes = read_table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("node_id"), F.col("l_quantity").alias("quantity"), order.alias("ord"))
    return X.prediction_rows(nodes, X.factor_range(spark, 1.0, 2.0, 0.5), duration=F.lit(4.0))


@query("p15_steady_rows", "SELECT s_suppkey AS node_id, s_nationkey AS network_id, f AS inflow_multiplier, 'ml_steady_prediction' AS scenario_type, p AS spatial_pattern FROM supplier, (VALUES (1e0), (1.5e0), (2e0)) v(f), (VALUES ('all_nodes'), ('selected_nodes')) w(p) WHERE p = 'all_nodes' OR s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)")
def p15(spark, sf):
    """Rows for predictions at all nodes, and at those with large deliveries."""
    nodes = read_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("node_id"), F.col("s_nationkey").alias("network_id"), F.col("s_suppkey").alias("ord"))
    asked = read_table(spark, sf, "lineitem").filter("l_quantity > 49").select(F.col("l_suppkey").alias("node_id"))
    by = X.factor_range(spark, 1.0, 2.0, 0.5).withColumnRenamed("factor_mult", "inflow_multiplier")
    return X.steady_prediction_rows(nodes, by).unionByName(X.steady_prediction_rows(nodes, by, asked))


_MODE_NAMES = {"1-URGENT": " Time_Series", "2-HIGH": "HYDROGRAPH", "3-MEDIUM": "steady-flow ", "4-NOT SPECIFIED": None, "5-LOW": "baseline"}


@query("p18_scenario_modes", "SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'timeseries' WHEN o_orderpriority = '4-NOT SPECIFIED' AND o_orderkey % 2 = 0 THEN 'timeseries' ELSE 'steady' END AS mode FROM orders")
def p18(spark, sf):
    """Names as users write them; orders without one take what their network suggests."""
    named = F.create_map(*[F.lit(x) for kv in _MODE_NAMES.items() for x in kv])
    suggested = F.when(F.col("o_orderkey") % 2 == 0, "timeseries").otherwise("steady")
    return read_table(spark, sf, "orders").select("o_orderkey", S.scenario_mode(F.try_element_at(named, F.col("o_orderpriority")), suggested).alias("mode"))


@query("r27_scenario_input", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity ELSE l_tax END AS scenario FROM lineitem")
def r27(spark, sf):
    """Even lines come from a dataset with multipliers, odd ones from an older one."""
    rows = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_tax").alias("delta_inflow_lps"), F.col("l_quantity").alias("inflow_multiplier"))
    parts = [rows.filter("l_linenumber % 2 = 0"), rows.filter("l_linenumber % 2 = 1").drop("inflow_multiplier")]
    new, old = [p.select("l_orderkey", "l_linenumber", F.col(X.scenario_input(p)).alias("scenario")) for p in parts]
    return new.unionByName(old)


@query("p20_static_fill", "SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 0 THEN c_acctbal END, 0) AS balance, CAST(c_mktsegment = 'BUILDING' AS DOUBLE) AS segment_BUILDING, CAST(c_mktsegment = 'MACHINERY' AS DOUBLE) AS segment_MACHINERY FROM customer")
def p20(spark, sf):
    table = read_table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).otherwise(float("nan")).alias("balance"), F.col("c_mktsegment").alias("segment"))
    return D.static_features(table, ["c_custkey"], [], {"segment": ["MACHINERY", "BUILDING", "AUTOMOBILE"]})


@query("p29_factor_ranges", "SELECT s_suppkey AS node_id, 'included' AS kind, round(1e0 + k * 0.1e0, 6) AS factor_mult FROM supplier, range(30) t(k) WHERE k <= s_suppkey % 29 + 1 UNION ALL SELECT s_suppkey, 'excluded', round(1e0 + k * 0.1e0, 6) FROM supplier, range(30) t(k) WHERE k < s_suppkey % 29 + 1")
def p29(spark, sf):
    """Every node's own range of factors: as numbers with both ends, and as a text without the last."""
    tenths = F.col("s_suppkey") % 29 + 11
    nodes = read_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("node_id"), tenths.alias("tenths"))
    whole = nodes.select("node_id", F.lit("included").alias("kind"), F.explode(X.inclusive_range(F.lit(1.0), F.col("tenths") / 10, F.lit(0.1))).alias("factor_mult"))
    text = F.format_string("range(1, %d.%d, 0.1)", F.floor(F.col("tenths") / 10), F.col("tenths") % 10)
    return whole.unionByName(nodes.select("node_id", F.lit("excluded").alias("kind"), F.explode(D.number_list(text)).alias("factor_mult")))


@query("p34_shown_metric", WITH + ", n AS (SELECT node_id, network_id, sum(vol) AS vol, max(prob) AS peak FROM samples GROUP BY 1, 2) SELECT node_id, CASE WHEN (SELECT max(abs(vol)) FROM n) > 0 THEN round(vol, 1) ELSE peak END AS shown, CASE WHEN (SELECT max(abs(0 * vol)) FROM n) > 0 THEN 0 ELSE peak END AS without FROM n")
def p34(spark, sf):
    n = B.samples(spark, sf).groupBy("node_id", "network_id").agg(F.sum("vol").alias("vol"), F.max("prob").alias("peak"))
    dry = X.shown_metric(n.withColumn("vol", F.lit(0.0))).select("node_id", F.col("shown").alias("without"))
    return X.shown_metric(n).select("node_id", F.round("shown", 1).alias("shown")).join(dry, "node_id")


@query(
    "s3_texts",
    "SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN 'Low cost' ELSE upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) END AS title, printf('%.3f', p_retailprice) AS price, printf('%02d', p_size % 100) AS size, CASE p_size % 4 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE p_name END AS series, string_split(p_name, ' ')[1] AS first_token, len(string_split(p_name, ' ')) AS n_tokens FROM part",
)
def s3(spark, sf):
    k = F.col("p_size") % 4
    raw = F.when(k == 0, "  ").when(k == 1, '""').when(k == 2, "''").otherwise(F.concat(F.lit(" "), F.col("p_name")))
    parts = D.tokens(F.regexp_replace("p_name", " ", " ,; "))
    return read_table(spark, sf, "part").select("p_partkey", S.title(F.col("p_type"), {"ECONOMY": "Low cost"}).alias("title"), F.format_string("%.3f", "p_retailprice").alias("price"), F.format_string("%02d", F.col("p_size") % 100).alias("size"), S.series_name(raw).alias("series"), parts[0].alias("first_token"), F.size(parts).cast("long").alias("n_tokens"))


@query("s6_number_lists", "SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 2 THEN NULL WHEN n_nationkey % 3 = 1 THEN 2 ELSE n_nationkey END AS n, CASE WHEN n_nationkey % 3 = 2 THEN NULL WHEN n_nationkey % 3 = 1 THEN CAST(n_nationkey + 0.5 AS DOUBLE) WHEN n_nationkey > 0 THEN round((n_nationkey * (n_nationkey - 1)) / 4e0, 6) ELSE 0 END AS total FROM nation")
def s6(spark, sf):
    k = F.col("n_nationkey")
    text = F.when(k % 3 == 2, F.concat(k.cast("string"), F.lit(" x"))).when(k % 3 == 1, F.concat(k.cast("string"), F.lit("; 0.5"))).otherwise(F.concat(F.lit("range(0, "), (k / 2).cast("string"), F.lit(", 0.5)")))
    numbers = D.number_list(text)
    return read_table(spark, sf, "nation").select("n_nationkey", F.when(numbers.isNotNull(), F.size(numbers)).alias("n"), F.round(F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("d1_times", "SELECT event_id, strftime(ts + INTERVAL 90 MINUTE, '%Y-%m-%d') AS day, strftime(ts + INTERVAL 90 MINUTE, '%H:%M:%S') AS clock, CAST(floor(epoch(ts - TIMESTAMP '2024-01-01')) AS BIGINT) AS seconds, CAST(floor(epoch(ts - TIMESTAMP '2024-01-01') / 60) AS BIGINT) AS minutes FROM events")
def d1(spark, sf):
    ts = F.col("ts").cast("timestamp_ntz")
    start, later = F.lit("2024-01-01").cast("timestamp_ntz"), ts + F.expr("INTERVAL 90 MINUTES")
    return read_table(spark, sf, "events").select("event_id", F.date_format(later, "yyyy-MM-dd").alias("day"), F.date_format(later, "HH:mm:ss").alias("clock"), T.elapsed(ts, start).alias("seconds"), T.elapsed(ts, start, "MINUTE").alias("minutes"))


@query("d3_minutes_to_peak", "SELECT o_orderkey, greatest(0, round((date_diff('day', DATE '0001-01-01', CAST(o_orderdate AS DATE)) + 1 + (o_orderkey % 50 - 5) / 96e0 - (date_diff('day', DATE '0001-01-01', CAST(o_orderdate AS DATE)) + 1 + (extract('hour' FROM o_orderdate) * 3600 + extract('minute' FROM o_orderdate) * 60 + CAST(floor(extract('second' FROM o_orderdate)) AS INTEGER)) / 86400e0)) * 1440, 3)) AS minutes FROM orders")
def d3(spark, sf):
    at = F.col("o_orderdate").cast("timestamp_ntz")
    peak = F.datediff(at, F.lit("0001-01-01").cast("date")) + 1 + (F.col("o_orderkey") % 50 - 5) / 96.0
    return read_table(spark, sf, "orders").select("o_orderkey", F.round(D.minutes_to_peak(peak, at), 3).alias("minutes"))


@query("js4_nested_metrics", "SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k, CAST(json_extract(props, '$.k') AS DOUBLE) / 100 AS f1, CAST(NULL AS DOUBLE) AS missing FROM events")
def js4(spark, sf):
    nested = F.to_json(F.struct(F.struct(F.struct((F.get_json_object("props", "$.k").cast("double") / 100).alias("f1")).alias("test")).alias("classifier")))
    return read_table(spark, sf, "events").select("event_id", D.nested_metric(F.col("props"), "k").alias("k"), D.nested_metric(nested, "classifier.test.f1").alias("f1"), D.nested_metric(nested, "classifier.train.f1").alias("missing"))


@query("j8_probabilities", WITH + "SELECT run_id, node_id, vol, prob, inunda FROM samples")
def j8(spark, sf):
    s = B.samples(spark, sf)
    return s.select("run_id", "node_id", "vol", "inunda").join(s.select("run_id", "node_id", "prob"), ["run_id", "node_id"])


@query("j12_run_summaries", WITH + "SELECT o_orderkey AS run_id, coalesce(n.n, 0) AS total_nodes, coalesce(n.f, 0) AS failed_nodes, coalesce(round(n.v, 4), 0) AS total_volume FROM orders LEFT JOIN (SELECT run_id, count(*) AS n, count(*) FILTER (vol > 0) AS f, sum(vol) AS v FROM samples GROUP BY 1) n ON n.run_id = o_orderkey")
def j12(spark, sf):
    found = A.run_summary(B.samples(spark, sf)).select("run_id", "total_nodes", "failed_nodes", F.round("total_volume", 4).alias("total_volume"))
    return R.lookup_or(read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id")), found, "run_id", total_nodes=0, failed_nodes=0, total_volume=0.0)


@query("j17_valid_runs", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def j17(spark, sf):
    returned = read_table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return read_table(spark, sf, "orders").select("o_orderkey").join(returned, "o_orderkey", "left_anti")


@query("a19_largest_peak", WITH + "SELECT CASE WHEN max(prob) > 0 THEN max(prob) ELSE 1e0 END AS largest FROM samples")
def a19(spark, sf):
    return A.largest_or(B.samples(spark, sf), "prob", 1.0)


@query("a22_safe_aggregates", f"WITH {B.EDGES} SELECT s_suppkey AS node_id, round(max(e.diameter), 6) AS most, round(min(e.diameter), 6) AS least, round(avg(e.diameter), 6) AS mean, round(sum(e.slope), 6) AS total FROM supplier LEFT JOIN edges e ON e.to_node = s_suppkey GROUP BY 1")
def a22(spark, sf):
    e = B.edges(spark, sf).groupBy(F.col("to_node").alias("node_id")).agg(F.max("diameter").alias("most"), F.min("diameter").alias("least"), F.avg("diameter").alias("mean"), F.sum("slope").alias("total"))
    return B.nodes(spark, sf).select("node_id").join(e, "node_id", "left").select("node_id", *[F.round(c, 6).alias(c) for c in ("most", "least", "mean", "total")])


@query("a23_first_outgoing", f"WITH {B.EDGES} SELECT from_node AS node_id, count(*) AS n_out, round(max(diameter), 6) AS diameter_max, round(max(abs(slope)), 6) AS slope_max, round(arg_min(slope, to_node), 6) AS slope_out FROM edges GROUP BY 1")
def a23(spark, sf):
    e = B.edges(spark, sf).withColumnRenamed("from_node", "node_id")
    both = e.groupBy("node_id").agg(F.count(F.lit(1)).alias("n_out"), F.max("diameter").alias("diameter_max"), F.max(F.abs("slope")).alias("slope_max"))
    first = A.first_by(e, "node_id", "slope", "to_node").withColumnRenamed("slope", "slope_out")
    return both.join(first, "node_id").select("node_id", "n_out", *[F.round(c, 6).alias(c) for c in ("diameter_max", "slope_max", "slope_out")])


@query("t15_peaks", f"WITH {B.EVENTS} SELECT user_id, max(value) AS peak, min(t) FILTER (value = m) AS time_of_peak FROM (SELECT *, max(value) OVER (PARTITION BY user_id) AS m FROM series) GROUP BY user_id")
def t15(spark, sf):
    return A.peaks(B.series(spark, sf), "user_id", "t", "value").select("user_id", "peak", "time_of_peak")


@query("w13_not_rising", f"WITH {B.EVENTS} SELECT event_id FROM (SELECT *, lag(t) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM ev) WHERE t <= p")
def w13(spark, sf):
    w = T.ordered(["user_id"], "event_id")
    return B.events(spark, sf).withColumn("_p", F.lag("t").over(w)).filter("t <= _p").select("event_id")


@query("o2_export_order", WITH + "SELECT row_number() OVER (ORDER BY network_id, scenario_type, factor_mult, node_id, run_id) - 1 AS sample_idx, run_id, node_id FROM samples")
def o2(spark, sf):
    s = B.samples(spark, sf).select("network_id", "scenario_type", "factor_mult", "node_id", "run_id")
    return K.sample_index(s, "network_id", "scenario_type", "factor_mult", "node_id", "run_id").select("sample_idx", "run_id", "node_id")


@query("o3_mixed_order", WITH + ", g AS (SELECT scenario_type, network_id, count(*) AS rows FROM samples GROUP BY 1, 2) SELECT row_number() OVER (ORDER BY rows DESC, scenario_type, network_id DESC) - 1 AS sample_idx, scenario_type, network_id, rows FROM g")
def o3(spark, sf):
    g = B.samples(spark, sf).groupBy("scenario_type", "network_id").agg(F.count(F.lit(1)).alias("rows"))
    return K.sample_index(g, "rows", "scenario_type", "network_id", falling=["rows", "network_id"])


@query("u1_stacked_folds", WITH + ", f AS (SELECT run_id, node_id, CAST(run_id % 3 AS INTEGER) AS a, CAST(run_id % 5 AS INTEGER) AS b FROM samples) SELECT 'three' AS protocol, a AS fold_id, count(*) AS n FROM f GROUP BY 1, 2 UNION ALL SELECT 'five', b, count(*) FROM f GROUP BY 1, 2")
def u1(spark, sf):
    s = B.samples(spark, sf)
    part = lambda name, k: s.select(F.lit(name).alias("protocol"), (F.col("run_id") % k).cast("int").alias("fold_id"))
    return part("three", 3).unionByName(part("five", 5)).groupBy("protocol", "fold_id").agg(F.count(F.lit(1)).alias("n"))


@query("v2_incomplete_runs", "SELECT l_orderkey AS run_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'F' GROUP BY 1")
def v2(spark, sf):
    asked = read_table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run_id")).distinct()
    done = read_table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("run_id"))
    return asked.join(done, "run_id", "left_anti")


@query("v9_hard_errors", WITH + ", p AS (SELECT run_id, node_id, count(*) AS n FROM (SELECT l_orderkey AS run_id, l_suppkey AS node_id FROM lineitem) GROUP BY 1, 2) SELECT (SELECT count(*) FROM p WHERE n > 1) AS repeated, (SELECT CAST(sum(inunda) AS BIGINT) FROM samples) = 0 AS none_flooded, (SELECT count(vol) FROM samples) = 0 AS no_volume")
def v9(spark, sf):
    rows = read_table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_suppkey").alias("node_id"))
    repeated = V.rule_unique(rows, "samples", "run_id", "node_id").select(F.col("violations").alias("repeated"))
    facts = B.samples(spark, sf).agg((F.sum("inunda") == 0).alias("none_flooded"), (F.count("vol") == 0).alias("no_volume"))
    return repeated.join(F.broadcast(facts))


@query("v17_conflicts", "SELECT l_orderkey AS run_id, l_suppkey AS node_id FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_linestatus) > 1")
def v17(spark, sf):
    rows = read_table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_suppkey").alias("node_id"), F.col("l_linestatus").alias("s"))
    return rows.distinct().groupBy("run_id", "node_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("run_id", "node_id")


@query("v19_membership", "SELECT fold_id, n_train, n_test, 0 AS shared FROM (SELECT f AS fold_id, count(*) FILTER (o_custkey % 5 <> f) AS n_train, count(*) FILTER (o_custkey % 5 = f) AS n_test FROM orders, range(5) t(f) GROUP BY f)")
def v19(spark, sf):
    s = read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("sample_idx"), (F.col("o_custkey") % 5).alias("g"))
    folds = spark.range(5).select(F.col("id").alias("g"), F.col("id").alias("fold_id"))
    long = K.long_form(s, folds, "g", "LOSO")
    per = long.groupBy("fold_id", "sample_idx").agg(F.count_if(F.col("split") == "train").alias("a"), F.count_if(F.col("split") == "test").alias("b"))
    return per.groupBy("fold_id").agg(F.sum("a").alias("n_train"), F.sum("b").alias("n_test"), F.count_if((F.col("a") > 0) & (F.col("b") > 0)).cast("int").alias("shared"))


@query("r12_map_slices", WITH + "SELECT shape_id, factor_mult, count(*) AS nodes, round(sum(vol), 4) AS volume FROM samples GROUP BY 1, 2")
def r12(spark, sf):
    return B.samples(spark, sf).groupBy("shape_id", "factor_mult").agg(F.count(F.lit(1)).alias("nodes"), F.round(F.sum("vol"), 4).alias("volume"))


@query("r21_ordered_labels", r"SELECT trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '_', 'g'), '_') AS label, min(o_orderkey) AS first FROM orders GROUP BY 1")
def r21(spark, sf):
    return D.ordered_labels(read_table(spark, sf, "orders"), S.scenario_label(F.col("o_orderpriority")), "o_orderkey")


@query("r31_fold_numbers", "SELECT count(DISTINCT c_nationkey) AS groups, count(DISTINCT c_nationkey) AS loso, least(5, count(DISTINCT c_nationkey)) AS kfold FROM customer")
def r31(spark, sf):
    n = D.enough_groups(read_table(spark, sf, "customer"), "c_nationkey")
    return spark.range(1).select(F.lit(n).cast("long").alias("groups"), F.lit(D.folds_for(n, "LOSO")).cast("long").alias("loso"), F.lit(D.folds_for(n, "KFOLD")).cast("long").alias("kfold"))


@query("f17_definition_ids", """SELECT p_partkey, substr(sha256('{"factors":[' || p_size || ',' || (p_size + 1) || '],"name":"' || p_name || '","note":null}'), 1, 16) AS prep_id, sha256('{"columns":["' || p_brand || '","' || p_type || '"]}') AS contract FROM part""")
def f17(spark, sf):
    """Ids of the definitions that the rows of a table are."""
    size = F.col("p_size")
    prep = E.definition_column(name=F.col("p_name"), factors=F.array(size, size + 1), note=F.lit(None).cast("string"))
    return read_table(spark, sf, "part").select("p_partkey", F.substring(prep, 1, 16).alias("prep_id"), E.definition_column(columns=F.array("p_brand", "p_type")).alias("contract"))


@query("snk2_series_round_trip", "SELECT user_id AS run_id, count(*) AS rows, round(sum(value), 4) AS inflow, max(event_id) AS last FROM events GROUP BY 1")
def snk2(spark, sf):
    """Written by run, read back by a selection of all runs."""
    e = read_table(spark, sf, "events")
    zero = F.lit(0.0)
    rows = e.select(F.col("user_id").cast("string").alias("run_id"), F.lit("n").alias("network_hash"), F.col("event_id").cast("string").alias("node_id"), F.lit(0).alias("step_index"), *[zero.alias(c) for c in ("time_sec", "time_min")], F.col("value").alias("total_inflow_lps"), *[zero.alias(c) for c in ("lateral_inflow_lps", "depth_m", "depth_ratio", "flooding_lps", "total_outflow_lps")], F.lit(0).alias("failed_now"))
    path = f"{folder(spark)}/series"
    sinks.write_series(rows, path)
    back = tables.read_runs(spark, path)
    return back.groupBy(F.col("run_id").cast("long").alias("run_id")).agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("total_inflow_lps"), 4).alias("inflow"), F.max(F.col("node_id").cast("long")).alias("last"))


@query("src7_registered_series", "SELECT user_id AS run_id, count(*) AS rows, round(sum(value), 4) AS inflow, max(event_id) AS last FROM events GROUP BY 1")
def src7(spark, sf):
    """Series of runs in files that a registry names: what isn't registered, here a file of other rows, isn't read."""
    zero, path = F.lit(0.0), folder(spark)
    e = read_table(spark, sf, "events")
    rows = e.select(F.col("user_id").cast("string").alias("run_id"), F.lit("n").alias("network_hash"), F.col("event_id").cast("string").alias("node_id"), F.lit(0).alias("step_index"), *[zero.alias(c) for c in ("time_sec", "time_min")], F.col("value").alias("total_inflow_lps"), *[zero.alias(c) for c in ("lateral_inflow_lps", "depth_m", "depth_ratio", "flooding_lps", "total_outflow_lps")], F.lit(0).alias("failed_now"))
    rows.repartition(4, "run_id").write.parquet(path)
    registry = spark.read.parquet(path).select(F.input_file_name().alias("parquet_path")).distinct().withColumn("artifact_id", F.xxhash64("parquet_path"))
    registry = settled(registry)
    rows.withColumn("run_id", F.lit("-1")).coalesce(1).write.mode("append").parquet(path)
    back = tables.read_registered(spark, registry)
    return back.groupBy(F.col("run_id").cast("long").alias("run_id")).agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("total_inflow_lps"), 4).alias("inflow"), F.max(F.col("node_id").cast("long")).alias("last"))


@query("snk1_csv_round_trip", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def snk1(spark, sf):
    path = f"{folder(spark)}/csv"
    sinks.write_csv(read_table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal"), path)
    return tables.read_csv(spark, path, "s_suppkey long, s_name string, s_acctbal double")


@query("snk7_json_rows", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber > 2 THEN l_tax END AS tax FROM lineitem")
def snk7(spark, sf):
    rows = lines(spark, sf, F.when(F.col("l_linenumber") == 1, float("nan")).when(F.col("l_linenumber") == 2, float("inf")).otherwise(F.col("l_tax")).alias("tax"))
    return sinks.json_rows(rows).select(F.from_json("value", "l_orderkey long, l_linenumber int, tax double").alias("v")).select("v.*")


@query("st_stream_totals", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, max(value) AS peak FROM events GROUP BY 1, 2")
def st_totals(spark, sf):
    """The same windows as st_windowed_events, from a stream that reads the file and is drained to a table."""
    path = f"{folder(spark)}/stream"
    read_table(spark, sf, "events").repartition(4).write.parquet(path)
    got = events_.drain_to(events_.windowed(events_.event_stream(spark, path)), f"{path}-out", "complete")
    return got.withColumn("start", F.col("start").cast("timestamp_ntz"))


def folder(spark) -> str:
    """A new folder in the place that the session names for checkpoints."""
    return new_folder(spark, "trip")
