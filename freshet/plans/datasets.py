"""Queries of training datasets, run results and sequences beside static features."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.operators import datasets as D
from freshet.operators import features as X
from freshet.operators import metrics as M
from freshet.operators import timeseries as T
from freshet.plans import bindings as B
from freshet.plans.networks import GRID, filled, shapes
from freshet.plans.registry import query
from freshet.plans.scores import _NSE, _SCORES, rounded
from freshet.session import read_table

WITH = f"WITH {B.SAMPLES} "
EV = f"WITH {B.EVENTS} "
_SHAPES = "shapes AS (SELECT event_type AS shape_id, CAST(t % 1440 AS INTEGER) // 60 AS time_h, CAST(sum(CAST(floor(value) AS BIGINT)) AS DOUBLE) AS q FROM ev GROUP BY 1, 2)"
#: Runs are orders; a run's features are the quantities of its lines by node, its results their discounts.
_RUNS = """, per AS (SELECT l_orderkey AS run_id, l_suppkey AS node_id, sum(l_quantity) AS quantity, count(*) AS n_lines FROM lineitem GROUP BY 1, 2),
runs AS (SELECT o_orderkey AS run_id, CASE o_orderstatus WHEN 'F' THEN 'COMPLETE' WHEN 'O' THEN 'RUNNING' ELSE 'FAILED' END AS status, o_orderpriority AS scenario_id, (SELECT count(*) FROM per WHERE per.run_id = o_orderkey) AS node_count FROM orders) """


def run_tables(spark, sf):
    lines = read_table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("run_id"), F.col("l_suppkey").alias("node_id")).agg(F.sum("l_quantity").alias("quantity"), F.count(F.lit(1)).alias("n_lines"))
    sizes = lines.groupBy("run_id").agg(F.count(F.lit(1)).alias("node_count"))
    status = F.when(F.col("o_orderstatus") == "F", "COMPLETE").when(F.col("o_orderstatus") == "O", "RUNNING").otherwise("FAILED")
    runs = read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), status.alias("status"), F.col("o_orderpriority").alias("scenario_id")).join(sizes, "run_id", "left").fillna(0, ["node_count"])
    return runs, lines, B.samples(spark, sf).select("run_id", "node_id", "vol", "inunda")


@query(
    "r1_training_samples",
    WITH + _RUNS + "SELECT p.run_id, p.node_id, r.scenario_id, r.node_count, p.quantity, p.n_lines, s.vol, s.inunda, length(r.scenario_id) AS label_length, u.s_acctbal AS base FROM per p JOIN samples s USING (run_id, node_id) JOIN runs r ON r.run_id = p.run_id AND r.status = 'COMPLETE' JOIN supplier u ON u.s_suppkey = p.node_id",
)
def r1(spark, sf):
    runs, features, results = run_tables(spark, sf)
    runs = runs.filter("node_count > 0")
    scenarios = read_table(spark, sf, "orders").select(F.col("o_orderpriority").alias("scenario_id")).distinct().withColumn("label_length", F.length("scenario_id").cast("long"))
    nodes = read_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("node_id"), F.col("s_acctbal").alias("base"))
    return D.training_samples(runs, scenarios, features, results, nodes, ["quantity", "n_lines"])


@query(
    "r1_violations",
    WITH
    + _RUNS
    + """, asked AS (SELECT o_orderkey AS run_id FROM orders WHERE o_totalprice > 1000), c AS (SELECT * FROM runs WHERE status = 'COMPLETE' AND run_id IN (SELECT run_id FROM asked)),
x AS (SELECT run_id, node_id, CASE WHEN node_id % 17 <> 0 THEN quantity END AS quantity FROM per WHERE quantity < 48 AND run_id IN (SELECT run_id FROM c)),
y AS (SELECT run_id, node_id, CASE WHEN node_id % 19 = 0 THEN -1e0 ELSE vol END AS vol, inunda FROM samples WHERE run_id IN (SELECT run_id FROM c))
SELECT 'run_not_complete' AS rule, (SELECT count(*) FROM asked WHERE run_id NOT IN (SELECT run_id FROM c)) AS violations
UNION ALL SELECT 'node_count', (SELECT count(*) FROM c WHERE node_count = 0 OR node_count <> (SELECT count(*) FROM x WHERE x.run_id = c.run_id) OR node_count <> (SELECT count(*) FROM y WHERE y.run_id = c.run_id))
UNION ALL SELECT 'key_mismatch', (SELECT count(*) FROM x FULL JOIN y USING (run_id, node_id) WHERE x.run_id IS NULL OR y.run_id IS NULL)
UNION ALL SELECT 'feature_value', (SELECT count(*) FROM x WHERE quantity IS NULL)
UNION ALL SELECT 'target_value', (SELECT count(*) FROM y WHERE vol < 0)""",
)
def r1_violations(spark, sf):
    runs, features, results = run_tables(spark, sf)
    asked = read_table(spark, sf, "orders").filter("o_totalprice > 1000").select(F.col("o_orderkey").alias("run_id"))
    features = features.filter("quantity < 48").withColumn("quantity", F.when(F.col("node_id") % 17 != 0, F.col("quantity")))
    results = results.withColumn("vol", F.when(F.col("node_id") % 19 == 0, -1.0).otherwise(F.col("vol")))
    return D.training_violations(runs, features, results, ["quantity"], asked)


@query("src23_run_results", WITH + _RUNS + "SELECT s.run_id, CAST(s.node_id AS VARCHAR) AS node_id, greatest(coalesce(CASE WHEN s.node_id % 5 <> 0 THEN s.vol_pred - 30 END, 0), 0) AS vol, CAST(inunda AS DOUBLE) AS flooded, 1 + s.run_id % 5 AS inflow_multiplier, 'runs' AS source FROM samples s JOIN runs r ON r.run_id = s.run_id AND r.status = 'COMPLETE'")
def src23(spark, sf):
    runs, _, _ = run_tables(spark, sf)
    results = B.samples(spark, sf).select("run_id", "node_id", F.when(F.col("node_id") % 5 != 0, F.col("vol_pred") - 30).alias("vol"), F.col("inunda").alias("flooded"))
    return D.run_results(results, runs.withColumn("inflow_multiplier", 1 + F.col("run_id") % 5), {"vol": 0.0, "flooded": 0}, "runs")


_TEXT = "array_to_string(list_transform({x}, lambda v: printf('%.4f', v)), ';')"


def text_of(sequence):
    return F.array_join(F.transform(sequence, lambda v: F.format_string("%.4f", v)), ";")


@query(
    "t3_window_sequences",
    f"WITH {GRID}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n, list(value) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS xs, max(value) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN 6 FOLLOWING AND 8 FOLLOWING) AS y FROM filled) SELECT user_id, t AS start, {_TEXT.format(x='xs')} AS sequence, CAST(y > 0 AS INTEGER) AS label, y FROM n WHERE i % 4 = 0 AND i + 9 <= n",
)
def t3_sequences(spark, sf):
    got = T.sliding_windows(filled(spark, sf), ["user_id"], "t", ["value"], "value", width=6, horizon=3, stride=4)
    return got.select("user_id", "start", text_of(F.transform("sequence", lambda x: x[0])).alias("sequence"), "label", "y")


@query("t6_sequence_rows", EV + "SELECT user_id, CAST(row_number() OVER w - 1 AS INTEGER) AS position, t, value, count(*) OVER (PARTITION BY user_id) AS length, max(CAST(value > 90 AS INTEGER)) OVER (PARTITION BY user_id) AS label, max(value - 90) OVER (PARTITION BY user_id) AS y FROM series WINDOW w AS (PARTITION BY user_id ORDER BY t)")
def t6_rows(spark, sf):
    s = B.series(spark, sf).withColumn("over", F.col("value") - 90)
    return T.sequence_rows(s, ["user_id"], "t", ["value"], "over")


_STATIC = "static AS (SELECT c_custkey AS user_id, coalesce(CASE WHEN c_acctbal > 0 THEN c_acctbal END, 0) AS balance, CAST(c_mktsegment = 'BUILDING' AS DOUBLE) AS building, CAST(c_mktsegment = 'MACHINERY' AS DOUBLE) AS machinery FROM customer WHERE c_mktsegment <> 'FURNITURE')"


def static_and_sequences(spark, sf):
    table = read_table(spark, sf, "customer").filter("c_mktsegment <> 'FURNITURE'").select(F.col("c_custkey").alias("user_id"), "c_name", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("balance"), F.col("c_mktsegment").alias("segment"))
    static = D.static_features(table, ["user_id"], ["c_name"], {"segment": ["AUTOMOBILE", "BUILDING", "MACHINERY"]})
    static = static.withColumnsRenamed({"segment_BUILDING": "building", "segment_MACHINERY": "machinery"})
    grid = filled(spark, sf)
    packed = grid.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("t", "value"))).alias("_s"), F.max((F.col("value") > 90).cast("int")).alias("label"), F.max("value").alias("y"))
    return static, packed.select("user_id", F.size("_s").cast("long").alias("length"), text_of(F.transform("_s", lambda x: x["value"])).alias("sequence"), "label", "y")


@query("t7_unified_dataset", f"WITH {GRID}, {_STATIC}, seqs AS (SELECT user_id, count(*) AS length, string_agg(printf('%.4f', value), ';' ORDER BY t) AS sequence, max(CAST(value > 90 AS INTEGER)) AS label, max(value) AS y FROM filled WHERE value IS NOT NULL GROUP BY user_id) SELECT * FROM seqs JOIN static USING (user_id)")
def t7(spark, sf):
    static, sequences = static_and_sequences(spark, sf)
    return D.with_static(sequences, static, ["user_id"])[0]


@query("j10_skipped", f"WITH {B.EVENTS}, {_STATIC} SELECT DISTINCT user_id FROM series WHERE user_id NOT IN (SELECT user_id FROM static)")
def j10(spark, sf):
    static, sequences = static_and_sequences(spark, sf)
    return D.with_static(sequences, static, ["user_id"])[1]


@query("t12_scaled_baselines", "SELECT s_suppkey AS node_id, s_acctbal * 1.25e0 AS baseline, s_acctbal <> 0 AS changed FROM supplier")
def t12(spark, sf):
    return D.scaled_baselines(read_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("node_id"), F.col("s_acctbal").alias("baseline")), 1.25)


@query("t16_first_filled_series", EV + f", {_SHAPES}, f AS (SELECT shape_id, time_h, CASE WHEN shape_id <> 'click' THEN q END AS q FROM shapes), one AS (SELECT * FROM f WHERE q IS NOT NULL AND shape_id = (SELECT min(shape_id) FROM f WHERE q IS NOT NULL)) SELECT shape_id, max(time_h) AS duration, min(time_h) FILTER (q = (SELECT max(q) FROM one)) AS time_to_peak FROM one GROUP BY shape_id")
def t16(spark, sf):
    s = shapes(spark, sf).withColumn("q", F.when(F.col("shape_id") != "click", F.col("q"))).withColumn("ord", F.col("shape_id"))
    return D.first_filled(s, "ord", "shape_id", "time_h", "q")


@query(
    "t18_scaled_inputs",
    f"WITH {GRID}, base AS (SELECT user_id, CAST(user_id % 4 + 1 AS DOUBLE) AS own FROM (SELECT DISTINCT user_id FROM series)), lowest AS (SELECT min(own) AS m FROM base), one AS (SELECT user_id, own FROM base, lowest WHERE own = m ORDER BY user_id LIMIT 1) SELECT user_id, t, m.f AS multiplier, value * m.f / own AS value FROM filled JOIN one USING (user_id), (VALUES (0.5e0), (1e0), (2.5e0)) m(f) WHERE value IS NOT NULL",
)
def t18(spark, sf):
    from freshet.operators.evidence import first_run

    s = filled(spark, sf)
    artifacts = s.select("user_id").distinct().select("user_id", (F.col("user_id") % 4 + 1).cast("double").alias("multiplier"), F.lit("all").alias("g"))
    base = first_run(artifacts, "g", "multiplier", "user_id")
    factors = X.factor_range(spark, 0.5, 2.5, 0.5).filter("factor_mult IN (0.5, 1.0, 2.5)").withColumnRenamed("factor_mult", "multiplier")
    return D.scaled_inputs(s, base, factors, "user_id", "value").select("user_id", "t", "multiplier", "value")


@query("t20_peak_node", WITH + ", p AS (SELECT run_id, node_id, max(vol_pred) AS peak FROM samples GROUP BY 1, 2) SELECT run_id, node_id, peak FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY peak DESC, node_id) AS k FROM p) WHERE k = 1")
def t20(spark, sf):
    return D.peak_node(B.samples(spark, sf), "run_id", "node_id", "vol_pred")


@query("p28_link_capacity", "SELECT l_suppkey AS link, max(l_extendedprice) AS peak_flow, CASE WHEN max(CASE WHEN l_suppkey % 6 > 0 THEN l_suppkey % 6 * 9.7e3 ELSE 0 END) > 0 THEN round(max(l_extendedprice) / (l_suppkey % 6 * 9.7e3), 4) END AS capacity_ratio, coalesce(max(l_tax - 0.05) > 0, false) AS surcharged FROM lineitem GROUP BY l_suppkey")
def p28(spark, sf):
    k = F.col("l_suppkey")
    lines = read_table(spark, sf, "lineitem").select(k.alias("link"), "l_extendedprice", (k % 6).cast("double").alias("c"), (F.col("l_tax") - 0.05).alias("full"))
    return D.link_capacity(lines.withColumn("capacity", F.col("c") * 9700.0), "link", "l_extendedprice", "capacity", "full")


@query("p27_step_projections", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 4 > 0 THEN round_even(l_quantity / (l_linenumber % 4), 6) END AS depth_ratio, CAST(coalesce(l_discount, 0) > 0 AS INTEGER) AS failed_now FROM lineitem")
def p27(spark, sf):
    lines = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", (F.col("l_linenumber") % 4).alias("full"))
    return D.step_projections(lines, "l_quantity", "full", "l_discount").select("l_orderkey", "l_linenumber", "depth_ratio", "failed_now")


@query("r35_shared_scale", WITH + "SELECT shape_id, factor_mult, greatest(max(vol), max(vol_pred), 1e0) AS scale FROM samples GROUP BY 1, 2")
def r35(spark, sf):
    return D.shared_scale(B.samples(spark, sf), ["shape_id", "factor_mult"], "vol", "vol_pred")


@query(
    "v13_unpaired_series",
    "WITH i AS (SELECT DISTINCT l_suppkey AS node_id, 'S' || CAST(l_suppkey % 40 AS VARCHAR) || CASE WHEN l_suppkey % 9 = 0 AND l_linenumber > 3 THEN 'b' ELSE '' END AS series FROM lineitem) SELECT 'node_with_several_series' AS problem, CAST(node_id AS VARCHAR) AS name FROM i GROUP BY node_id HAVING count(*) > 1 UNION ALL SELECT 'series_of_several_nodes', series FROM i GROUP BY series HAVING count(*) > 1 UNION ALL SELECT DISTINCT 'series_without_points', series FROM i WHERE series LIKE '%b' OR series = 'S0'",
)
def v13(spark, sf):
    k = F.col("l_suppkey")
    name = F.concat(F.lit("S"), (k % 40).cast("string"), F.when((k % 9 == 0) & (F.col("l_linenumber") > 3), "b").otherwise(""))
    inflows = read_table(spark, sf, "lineitem").select(k.alias("node_id"), name.alias("series"))
    points = spark.range(1, 40).select(F.concat(F.lit("S"), F.col("id").cast("string")).alias("series"))
    return D.unpaired_series(inflows, points)


@query(
    "f14_batch_validation",
    WITH
    + ", t AS (SELECT * FROM samples WHERE t < 6), p AS (SELECT run_id, node_id, scenario_type, vol_pred, inunda_pred FROM samples WHERE prob >= 0.01) SELECT coalesce(t.scenario_type, p.scenario_type) AS scenario_type, count(t.run_id) AS n_truth, count(p.run_id) AS n_pred, count(*) FILTER (t.run_id IS NULL OR p.run_id IS NULL) AS unmatched, count(*) FILTER (inunda = 1 AND p.inunda_pred = 1) AS tp, count(*) FILTER (inunda = 0 AND p.inunda_pred = 1) AS fp, count(*) FILTER (inunda = 1 AND p.inunda_pred = 0) AS fn, round(sum(t.vol), 4) AS total_truth, round(sum(p.vol_pred), 3) AS total_pred, round(CASE WHEN sum(t.vol) > 0 THEN 100 * (sum(p.vol_pred) - sum(t.vol)) / sum(t.vol) END, 6) AS error_pct FROM t FULL JOIN p USING (run_id, node_id) GROUP BY 1",
)
def f14(spark, sf):
    s = B.samples(spark, sf)
    truth = s.filter("t < 6").select("scenario_type", "run_id", "node_id", "vol", "inunda")
    pred = s.filter("prob >= 0.01").select("scenario_type", "run_id", "node_id", F.col("vol_pred").alias("vol"), F.col("inunda_pred").alias("inunda"))
    return rounded(D.batch_validation(truth, pred, ["run_id", "node_id"], "scenario_type"), total_truth=4, total_pred=3, error_pct=6)


_LABELS = ", labels AS (SELECT DISTINCT scenario_type AS label FROM samples UNION SELECT 'never')"


@query("k15_regression_by_label", WITH + _LABELS + f", r AS (SELECT scenario_type AS label, count(*) AS n, round(avg(abs(vol - vol_pred)), 5) AS mae, round(sqrt(avg((vol - vol_pred) * (vol - vol_pred))), 5) AS rmse, round(CASE WHEN count(*) >= 2 THEN {_NSE.format(t='vol', p='vol_pred')} END, 7) AS r2 FROM samples GROUP BY 1) SELECT label, coalesce(n, 0) AS rows, mae, rmse, r2 FROM labels LEFT JOIN r USING (label)")
def k15(spark, sf):
    s = B.samples(spark, sf).withColumnRenamed("scenario_type", "label")
    scored = rounded(M.regression(s, "vol", "vol_pred", ["label"]), mae=5, rmse=5, r2=7).select("label", "n", "mae", "rmse", "r2")
    return M.by_label(scored, s.select("label").union(spark.range(1).select(F.lit("never"))))


@query("k15_classification_by_label", WITH + _LABELS + ", c AS (SELECT scenario_type AS label, count(*) FILTER (inunda = 1 AND inunda_pred = 1) AS tp, count(*) FILTER (inunda = 0 AND inunda_pred = 0) AS tn, count(*) FILTER (inunda = 0 AND inunda_pred = 1) AS fp, count(*) FILTER (inunda = 1 AND inunda_pred = 0) AS fn FROM samples GROUP BY 1), s AS (SELECT label, tp + tn + fp + fn AS n, " + _SCORES + " FROM c) SELECT label, coalesce(n, 0) AS rows, accuracy, precision, recall, f1 FROM labels LEFT JOIN s USING (label)")
def k15_classes(spark, sf):
    s = B.samples(spark, sf).withColumnRenamed("scenario_type", "label")
    scored = rounded(M.confusion(s, "inunda", "inunda_pred", ["label"]), accuracy=9, precision=9, recall=9, f1=9).drop("csi")
    return M.by_label(scored, s.select("label").union(spark.range(1).select(F.lit("never"))))


@query("k13_held_out", WITH + f"SELECT CAST(run_id % 5 AS INTEGER) AS fold_id, round(avg(abs(vol - vol_pred)), 5) AS mae, round(sqrt(avg((vol - vol_pred) * (vol - vol_pred))), 5) AS rmse, round({_NSE.format(t='vol', p='vol_pred')}, 7) AS r2, count(*) AS n FROM samples GROUP BY 1")
def k13(spark, sf):
    s = B.samples(spark, sf).withColumn("fold_id", (F.col("run_id") % 5).cast("int"))
    return rounded(M.regression(s, "vol", "vol_pred", ["fold_id"]), mae=5, rmse=5, r2=7).select("fold_id", "mae", "rmse", "r2", "n")


@query("k26_side_by_side", WITH + ", f AS (SELECT CAST(run_id % 5 AS INTEGER) AS fold_id, sqrt(avg((vol - vol_pred) * (vol - vol_pred))) AS a, sqrt(avg((vol - vol_pred * 0.9e0) * (vol - vol_pred * 0.9e0))) AS b FROM samples GROUP BY 1) SELECT fold_id, round(a, 5) AS full_rmse, round(b, 5) AS damped_rmse FROM f")
def k26(spark, sf):
    from functools import reduce

    s = B.samples(spark, sf).withColumn("fold_id", (F.col("run_id") % 5).cast("int"))
    models = {"full": F.col("vol_pred"), "damped": F.col("vol_pred") * 0.9}
    per = reduce(lambda a, b: a.unionByName(b), [M.regression(s.withColumn("p", p), "vol", "p", ["fold_id"]).select("fold_id", F.lit(f"{m}_rmse").alias("model"), F.round("rmse", 5).alias("rmse")) for m, p in models.items()])
    return per.groupBy("fold_id").pivot("model", [f"{m}_rmse" for m in models]).agg(F.first("rmse"))


@query("k18_feature_target", "WITH c AS (SELECT " + ", ".join(f"corr({c}, l_extendedprice) AS {c}" for c in ("l_quantity", "l_discount", "l_tax")) + " FROM lineitem) " + " UNION ALL ".join(f"SELECT '{c}' AS feature, round({c}, 7) AS r FROM c" for c in ("l_quantity", "l_discount", "l_tax")))
def k18(spark, sf):
    features = ["l_quantity", "l_discount", "l_tax"]
    pairs = M.correlation_pairs(read_table(spark, sf, "lineitem"), [*features, "l_extendedprice"]).filter("b = 'l_extendedprice'")
    return pairs.select(F.col("a").alias("feature"), F.round("r", 7).alias("r")).orderBy(F.desc(F.abs("r")), "feature")


@query("g3_accumulate_tree", f"WITH RECURSIVE {B.EDGES}, {B.NODES}, reach(ancestor, node) AS (SELECT from_node, to_node FROM edges UNION SELECT r.ancestor, e.to_node FROM reach r JOIN edges e ON e.from_node = r.node) SELECT n.node_id, n.q_peak + coalesce((SELECT sum(a.q_peak) FROM reach r JOIN nodes a ON a.node_id = r.ancestor WHERE r.node = n.node_id), 0) AS q_peak_acum FROM nodes n")
def g3_tree(spark, sf):
    from freshet.operators import graph as G

    return G.accumulate_tree(B.nodes(spark, sf), B.edges(spark, sf), "q_peak")
