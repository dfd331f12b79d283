"""Queries of joins, sets and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.operators import folds as D
from freshet.operators import relations as R
from freshet.operators import validation as V
from freshet.plans import bindings as B
from freshet.plans.registry import query
from freshet.session import dealt, kept, read_table
from freshet.sources.sinks import with_surrogate_keys

WITH = f"WITH {B.SAMPLES} "
_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'COMPLETE' WHEN 'O' THEN 'RUNNING' ELSE 'FAILED' END"


@query(
    "j1_training_view",
    f"SELECT l_orderkey AS run_id, l_suppkey AS node_id, l_linenumber AS line, o_orderpriority AS scenario_id, l_quantity AS feature, l_extendedprice AS result, s_acctbal AS base FROM lineitem JOIN orders ON o_orderkey = l_orderkey AND {_STATUS} = 'COMPLETE' JOIN supplier ON s_suppkey = l_suppkey WHERE l_shipdate >= TIMESTAMP '1990-01-01'",
)
def j1(spark, sf):
    lines = read_table(spark, sf, "lineitem").filter(F.col("l_shipdate") >= F.lit("1990-01-01").cast("timestamp_ntz"))
    orders = read_table(spark, sf, "orders").filter("o_orderstatus = 'F'")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(read_table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.select(F.col("l_orderkey").alias("run_id"), F.col("l_suppkey").alias("node_id"), F.col("l_linenumber").alias("line"), F.col("o_orderpriority").alias("scenario_id"), F.col("l_quantity").alias("feature"), F.col("l_extendedprice").alias("result"), F.col("s_acctbal").alias("base"))


@query(
    "j1_five_way",
    WITH + ", runs AS (SELECT o_orderkey AS run_id, o_orderpriority AS scenario_id FROM orders WHERE o_orderstatus = 'F') SELECT s.run_id, s.node_id, r.scenario_id, x.rows, s.vol, s.prob, p.s_acctbal AS base FROM samples s JOIN runs r USING (run_id) JOIN (SELECT o_orderpriority AS scenario_id, count(*) AS rows FROM orders GROUP BY 1) x ON x.scenario_id = r.scenario_id JOIN supplier p ON p.s_suppkey = s.node_id",
)
def j1b(spark, sf):
    orders = read_table(spark, sf, "orders")
    runs = orders.select(F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("scenario_id"), F.when(F.col("o_orderstatus") == "F", "COMPLETE").otherwise("RUNNING").alias("status"))
    scenarios = orders.groupBy(F.col("o_orderpriority").alias("scenario_id")).agg(F.count(F.lit(1)).alias("rows"))
    s = B.samples(spark, sf)
    nodes = read_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("node_id"), F.col("s_acctbal").alias("base"))
    return R.training_view(runs, scenarios, s.select("run_id", "node_id", "vol"), s.select("run_id", "node_id", "prob"), nodes).select("run_id", "node_id", "scenario_id", "rows", "vol", "prob", "base")


@query("j3_key_mismatch", "SELECT o_orderkey AS run_id, 'results' AS missing_in FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT DISTINCT l_orderkey, 'features' FROM lineitem WHERE l_orderkey % 2 = 0 AND l_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def j3(spark, sf):
    features = read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"))
    # in parts of a bounded number of lines, which the joins take over
    results = dealt(read_table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run_id")), "run_id").distinct()
    return R.key_mismatches(features, results, ["run_id"], ("features", "results"))


@query("j6_assemble", WITH + ", l AS (SELECT node_id, sum(inunda) AS floods FROM samples WHERE factor_mult = 3 GROUP BY node_id) SELECT s_suppkey AS node_id, s_acctbal AS base, p.p_size AS size, CAST(coalesce(floods, 0) AS BIGINT) AS floods FROM supplier LEFT JOIN part p ON p_partkey = s_suppkey AND p_size > 25 LEFT JOIN l ON l.node_id = s_suppkey")
def j6(spark, sf):
    static = read_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("node_id"), F.col("s_acctbal").alias("base"))
    dynamic = read_table(spark, sf, "part").filter("p_size > 25").select(F.col("p_partkey").alias("node_id"), F.col("p_size").alias("size"))
    labels = B.samples(spark, sf).filter("factor_mult = 3").groupBy("node_id").agg(F.sum("inunda").alias("floods"))
    return R.assemble(static, dynamic, labels, fill=["floods"])


@query("j7_comparison", WITH + "SELECT run_id, node_id, vol, vol_pred, vol_pred - vol AS error, abs(vol_pred - vol) AS abs_error, inunda, inunda_pred, CAST(inunda = inunda_pred AS INTEGER) AS correct FROM samples")
def j7(spark, sf):
    s = B.samples(spark, sf)
    return R.compare(s.select("run_id", "node_id", "vol", "inunda"), s.select("run_id", "node_id", "vol_pred", "inunda_pred"), ["run_id", "node_id"])


@query("j9_lookup_default", WITH + "SELECT s_suppkey AS node_id, coalesce(v, 0e0) AS vol FROM supplier LEFT JOIN (SELECT node_id, max(vol) AS v FROM samples WHERE shape_id = 'P' GROUP BY node_id) x ON x.node_id = s_suppkey")
def j9(spark, sf):
    found = B.samples(spark, sf).filter("shape_id = 'P'").groupBy("node_id").agg(F.max("vol").alias("vol"))
    return R.lookup_or(read_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("node_id")), found, "node_id", vol=0.0)


@query("j19_latest_per_target", "SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1")
def j19(spark, sf):
    return R.latest(read_table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", "o_orderdate", "o_orderkey")


@query("j21_dominant_winner", "SELECT p_brand, p_partkey, p_retailprice FROM part a WHERE p_size > 5 AND NOT EXISTS (SELECT 1 FROM part b WHERE b.p_brand = a.p_brand AND b.p_size > 5 AND b.p_retailprice < a.p_retailprice)")
def j21(spark, sf):
    part = read_table(spark, sf, "part").select("p_brand", "p_partkey", "p_retailprice", "p_size")
    return R.undominated(part, "p_brand", F.col("p_retailprice"), F.col("p_size") > 5).drop("p_size")


@query("j26_overlay", WITH + ", r AS (SELECT run_id, CASE WHEN run_id % 3 = 0 THEN NULL ELSE vol_pred END AS v FROM samples WHERE node_id % 2 = 0 AND node_id = (SELECT min(node_id) FROM samples s WHERE s.run_id = samples.run_id)), b AS (SELECT run_id, max(vol) AS vol, max(inunda_pred) AS flooded FROM samples GROUP BY run_id) SELECT b.run_id, coalesce(r.v, b.vol) AS vol, CAST(flooded = 1 OR coalesce(r.v, b.vol) > 0 AS INTEGER) AS flooded FROM b LEFT JOIN r USING (run_id)")
def j26(spark, sf):
    s = B.samples(spark, sf)
    first = s.groupBy("run_id").agg(F.min(F.struct("node_id", "vol_pred")).alias("m")).select("run_id", "m.*").filter("node_id % 2 = 0")
    report = first.select("run_id", F.when(F.col("run_id") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("vol_pred")).alias("vol"))
    base = s.groupBy("run_id").agg(F.max("vol").alias("vol"), F.max("inunda_pred").alias("flooded"))
    return R.overlay(base, report, "run_id", ["vol"])


@query("j27_cardinality", WITH + ", e AS (SELECT l_orderkey AS run_id, count(DISTINCT l_suppkey) AS node_count FROM lineitem GROUP BY 1) SELECT run_id, node_count, n_features, n_results, n_features = node_count AND n_results = node_count AND node_count > 0 AS complete FROM e LEFT JOIN (SELECT run_id, count(*) AS n_features FROM samples GROUP BY 1) USING (run_id) LEFT JOIN (SELECT o_orderkey AS run_id, coalesce(c, 0) AS n_results FROM orders LEFT JOIN (SELECT run_id AS r, count(*) AS c FROM samples WHERE vol > 0 OR run_id % 2 = 0 GROUP BY 1) ON r = o_orderkey) USING (run_id)")
def j27(spark, sf):
    s = B.samples(spark, sf)
    runs = read_table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.count_distinct("l_suppkey").alias("node_count"))
    return R.counted_children(runs, "run_id", "node_count", features=s, results=s.filter("vol > 0 OR run_id % 2 = 0"))


@query("j28_backfill", "SELECT o_orderkey AS id, CASE WHEN o_totalprice < 50000 OR o_custkey % 7 = 0 THEN coalesce(c_acctbal, m) ELSE m END AS m FROM (SELECT *, CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_totalprice END AS m FROM orders) LEFT JOIN customer ON c_custkey = o_custkey")
def j28(spark, sf):
    orders = read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", F.when(F.col("o_custkey") % 7 != 0, F.col("o_totalprice")).alias("m"))
    source = read_table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_acctbal").alias("m"))
    return R.backfill(orders, source, "o_custkey", "m", F.col("m").isNull() | (F.col("m") < 50000)).select("id", "m")


@query("j29_json_membership", "SELECT event_id, CAST(props->>'k' AS BIGINT) AS member FROM events UNION ALL SELECT event_id, user_id FROM events")
def j29(spark, sf):
    packed = read_table(spark, sf, "events").select("event_id", F.concat(F.lit("["), F.get_json_object("props", "$.k"), F.lit(","), F.col("user_id").cast("string"), F.lit("]")).alias("ids"))
    return R.json_members(packed, "event_id", "ids")


@query("j16_active_selections", "SELECT o_orderkey AS selection_id, o_custkey AS promotion_id FROM orders o WHERE NOT EXISTS (SELECT 1 FROM orders x WHERE x.o_orderkey > 10 AND x.o_orderkey - 10 = o.o_orderkey AND x.o_orderkey % 3 = 0) AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def j16(spark, sf):
    k = F.col("o_orderkey")
    selections = read_table(spark, sf, "orders").select(k.alias("selection_id"), F.col("o_custkey").alias("promotion_id"), F.when((k > 10) & (k % 3 == 0), k - 10).alias("supersedes"))
    valid = read_table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("promotion_id"))
    return R.active_leaves(selections, valid).select("selection_id", "promotion_id")


@query("j15_paired_models", WITH + "SELECT a.run_id, a.node_id AS classifier, b.node_id AS regressor FROM samples a JOIN samples b ON a.run_id = b.run_id WHERE a.inunda = 1 AND b.inunda = 0")
def j15(spark, sf):
    s = B.samples(spark, sf)
    role = F.when(F.col("inunda") == 1, "classifier").otherwise("regressor")
    return R.paired_members(s.select("run_id", role.alias("role"), F.col("node_id").alias("member")), "run_id", "role", "classifier", "regressor")


@query("snk11_upsert", "SELECT c_custkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 5 <> 0 UNION ALL SELECT c_custkey, c_acctbal + 1, c_mktsegment FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT c_custkey + 1000000, 0e0, NULL FROM customer WHERE c_custkey % 50 = 0")
def snk11(spark, sf):
    c = read_table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    batch = c.filter("c_custkey % 5 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1).unionByName(c.filter("c_custkey % 50 = 0").select((F.col("c_custkey") + 1000000).alias("c_custkey"), F.lit(0.0).alias("c_acctbal")), allowMissingColumns=True)
    return R.upsert(c, batch, "c_custkey")


@query("p16_network_selector", "SELECT n_name AS file, sha256(n_name) AS hash FROM nation WHERE n_name = 'x' OR sha256(n_name) = 'a' OR starts_with(sha256(n_name), 'a')")
def p16(spark, sf):
    networks = read_table(spark, sf, "nation").select(F.col("n_name").alias("file"), F.sha2("n_name", 256).alias("hash"))
    return R.select_network(networks, "a")


@query("u5_intersect", WITH + "SELECT DISTINCT node_id FROM samples WHERE shape_id = 'F' INTERSECT SELECT DISTINCT node_id FROM samples WHERE shape_id = 'P'")
def u5(spark, sf):
    s = B.samples(spark, sf)
    return D.overlap(s.filter("shape_id = 'F'"), s.filter("shape_id = 'P'"), ["node_id"])


@query("u7_coverage_diff", "SELECT (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber > 1)) AS missing, (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_linenumber > 1 AND l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS extra")
def u7(spark, sf):
    return R.uncovered(read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("k")), read_table(spark, sf, "lineitem").filter("l_linenumber > 1").select(F.col("l_orderkey").alias("k")), ["k"])


@query("v5_target_domain", WITH + ", b AS (SELECT run_id, node_id, CASE WHEN run_id % 11 = 0 THEN NULL WHEN run_id % 13 = 0 THEN 2 ELSE inunda END AS inunda, CASE WHEN node_id % 17 = 0 THEN -vol - 1 ELSE vol END AS vol FROM samples) SELECT * FROM b WHERE inunda IS NULL OR inunda NOT IN (0, 1) OR vol < 0")
def v5(spark, sf):
    s = B.samples(spark, sf)
    bad = s.select("run_id", "node_id", F.when(F.col("run_id") % 11 == 0, F.lit(None)).when(F.col("run_id") % 13 == 0, 2).otherwise(F.col("inunda")).alias("inunda"), F.when(F.col("node_id") % 17 == 0, -F.col("vol") - 1).otherwise(F.col("vol")).alias("vol"))
    return V.bad_targets(bad)


@query("v7_contract", "SELECT 'l_quantity' AS feature, count(*) FILTER (l_quantity > 40) AS nulls, CAST(0 AS BIGINT) AS infinite, count(*) FILTER (l_quantity > 40) > 0 AS violated FROM lineitem UNION ALL SELECT 'l_tax', 0, 0, false")
def v7(spark, sf):
    gaps = read_table(spark, sf, "lineitem").select(F.when(F.col("l_quantity") <= 40, F.col("l_quantity")).alias("l_quantity"), "l_tax")
    return V.contract_counts(gaps, [("l_quantity", False), ("l_tax", True)])


@query("v8_dataset_facts", WITH + "SELECT count(*) AS rows, CAST(0 AS BIGINT) AS null_labels, count(*) FILTER (vol < 0) AS negative, count(*) FILTER (inunda NOT IN (0, 1)) AS not_binary, CAST(sum(inunda) AS BIGINT) AS flooded, round(avg(inunda), 9) AS flooded_share FROM samples")
def v8(spark, sf):
    return V.dataset_facts(B.samples(spark, sf)).withColumn("flooded_share", F.round("flooded_share", 9))


@query("v16_rules", "SELECT 'orders.o_custkey not null' AS rule, count(*) FILTER (o_custkey IS NULL) AS violations FROM orders UNION ALL SELECT 'lineitem(l_orderkey, l_linenumber) unique', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) UNION ALL SELECT 'lineitem to orders', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'discount below a twentieth', count(*) FROM lineitem WHERE NOT l_discount < 0.05")
def v16(spark, sf):
    orders, lines = read_table(spark, sf, "orders"), read_table(spark, sf, "lineitem")
    return (
        V.rule_not_null(orders, "orders", "o_custkey")
        .unionByName(V.rule_unique(lines, "lineitem", "l_orderkey", "l_linenumber"))
        .unionByName(V.rule_references(lines, orders, "lineitem to orders", "l_orderkey", "o_orderkey"))
        .unionByName(V.rule_check(lines, "discount below a twentieth", F.col("l_discount") < 0.05))
    )


@query("v18_status_machine", "SELECT user_id, event_id, before, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE NOT ((before IS NULL AND event_type = 'view') OR (before IS NOT DISTINCT FROM 'view' AND event_type = 'click') OR (before IS NOT DISTINCT FROM 'click' AND event_type = 'purchase'))")
def v18(spark, sf):
    return V.broken_transitions(read_table(spark, sf, "events"), "user_id", "event_id", "event_type", [(None, "view"), ("view", "click"), ("click", "purchase")])


@query("v20_oof_domain", WITH + ", o AS (SELECT run_id, node_id, run_id % 5 AS fold_id, CASE WHEN node_id % 19 = 0 THEN vol + 1 ELSE vol END AS observed, CASE WHEN run_id % 23 = 0 THEN NULL ELSE vol_pred END AS predicted FROM samples) SELECT o.run_id, o.node_id, o.fold_id, o.observed, o.predicted FROM o JOIN samples s USING (run_id, node_id) WHERE o.run_id % 29 = 0 OR o.observed <> s.vol OR o.predicted IS NULL")
def v20(spark, sf):
    s = B.samples(spark, sf)
    oof = s.select("run_id", "node_id", (F.col("run_id") % 5).alias("fold_id"), F.when(F.col("node_id") % 19 == 0, F.col("vol") + 1).otherwise(F.col("vol")).alias("observed"), F.when(F.col("run_id") % 23 != 0, F.col("vol_pred")).alias("predicted"))
    memberships = s.filter("run_id % 29 <> 0").select((F.col("run_id") % 5).alias("fold_id"), "run_id", F.lit("test").alias("split"))
    return V.bad_oof(oof, memberships, s).select("run_id", "node_id", "fold_id", "observed", "predicted")


@query("v25_hash_check", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 4 = 0")
def v25(spark, sf):
    stored = F.when(F.col("n_nationkey") % 4 == 0, F.sha2(F.concat("n_name", F.lit("!")), 256)).otherwise(F.sha2("n_name", 256))
    return V.hash_mismatches(read_table(spark, sf, "nation").select("n_nationkey", "n_name", stored.alias("h")), "n_name", "h").drop("h")


@query("f1_loso", WITH + "SELECT factor_mult, dense_rank() OVER (ORDER BY factor_mult) - 1 AS fold_id FROM (SELECT DISTINCT factor_mult FROM samples)")
def f1(spark, sf):
    return D.leave_one_out(B.samples(spark, sf), "factor_mult")


@query("f2_group_folds", WITH + ", g AS (SELECT network_id, count(*) AS n FROM samples GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, network_id DESC) AS k FROM g), deal AS (WITH RECURSIVE d(k, loads, network_id, fold_id) AS (SELECT CAST(0 AS BIGINT), [0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT], CAST(NULL AS INTEGER), CAST(NULL AS INTEGER) UNION ALL SELECT r.k, list_transform(loads, lambda x, i: CASE WHEN i = list_position(loads, list_min(loads)) THEN x + r.n ELSE x END), r.network_id, CAST(list_position(loads, list_min(loads)) - 1 AS INTEGER) FROM d JOIN r ON r.k = d.k + 1) SELECT * FROM d) SELECT network_id, fold_id FROM deal WHERE k > 0")
def f2(spark, sf):
    return D.balanced(B.samples(spark, sf), "network_id")


@query("f3_fold_long", WITH + ", s AS (SELECT row_number() OVER (ORDER BY run_id, node_id) - 1 AS sample_idx, CAST((factor_mult - 1) * 2 AS INTEGER) AS own FROM samples), f AS (SELECT DISTINCT own AS fold_id FROM s) SELECT 'LOSO' AS protocol, fold_id, sample_idx, CASE WHEN own = fold_id THEN 'test' ELSE 'train' END AS split FROM s, f")
def f3(spark, sf):
    s = D.sample_index(B.samples(spark, sf).select("run_id", "node_id", "factor_mult"), "run_id", "node_id")
    return D.long_form(s, D.leave_one_out(s, "factor_mult"), "factor_mult", "LOSO")


@query("u11_first_seen", "SELECT o_custkey, row_number() OVER (ORDER BY day, o_orderkey) - 1 AS position FROM (SELECT o_custkey, o_orderdate AS day, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) WHERE k = 1")
def u11(spark, sf):
    return R.first_seen(read_table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey"), "o_custkey", "o_orderdate", "o_orderkey")


@query("o11_order_parity", WITH + ", r AS (SELECT *, dense_rank() OVER (ORDER BY shape_id, factor_mult, run_id) AS run_no FROM samples) SELECT run_id, node_id, row_number() OVER (ORDER BY shape_id, factor_mult, run_id, node_id) - 1 AS position_a, row_number() OVER (ORDER BY run_no, node_id) - 1 AS position_b FROM r")
def o11(spark, sf):
    """The order in which rows are assembled beside that in which a database gives them, whose runs are numbered as they came."""
    s = kept(B.samples(spark, sf).select("shape_id", "factor_mult", "run_id", "node_id"))
    numbered = with_surrogate_keys(s, ["shape_id", "factor_mult", "run_id"], "run_no")
    both = D.order_parity(s.join(numbered, ["shape_id", "factor_mult", "run_id"]), ["shape_id", "factor_mult", "run_id", "node_id"], ["run_no", "node_id"])
    return both.select("run_id", "node_id", "position_a", "position_b")
