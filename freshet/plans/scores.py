"""Queries of metrics, correlations and rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.operators import metrics as M
from freshet.plans import bindings as B
from freshet.plans.registry import query
from freshet.session import read_table

WITH = f"WITH {B.SAMPLES} "
FOLDED = f"WITH {B.SAMPLES}, folded AS (SELECT *, CAST(run_id % 5 AS INTEGER) AS fold_id, 'LOSO' AS protocol FROM samples) "
_COUNTS = "count(*) FILTER (inunda = 1 AND inunda_pred = 1) AS tp, count(*) FILTER (inunda = 0 AND inunda_pred = 0) AS tn, count(*) FILTER (inunda = 0 AND inunda_pred = 1) AS fp, count(*) FILTER (inunda = 1 AND inunda_pred = 0) AS fn"
_SCORES = "round(CAST(tp + tn AS DOUBLE) / (tp + tn + fp + fn), 9) AS accuracy, round(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 9) AS precision, round(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 9) AS recall, round(CASE WHEN tp > 0 THEN 2e0 * tp / (2 * tp + fp + fn) END, 9) AS f1, round(tp / CAST(nullif(tp + fp + fn, 0) AS DOUBLE), 9) AS csi"
_NSE = "CASE WHEN var_pop({t}) > 0 THEN 1 - sum(({t} - {p}) * ({t} - {p})) / (var_pop({t}) * count({t})) WHEN sum(({t} - {p}) * ({t} - {p})) = 0 THEN 1e0 ELSE 0e0 END"
_ROUTED = "CASE WHEN inunda_pred = 1 THEN greatest(vol_pred, 0) ELSE 0e0 END"


def rounded(df, **digits):
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})


def folded(spark, sf):
    return B.samples(spark, sf).withColumns({"fold_id": (F.col("run_id") % 5).cast("int"), "protocol": F.lit("LOSO")})


@query("k1_confusion", WITH + f", c AS (SELECT scenario_type, {_COUNTS} FROM samples GROUP BY 1) SELECT scenario_type, tp, tn, fp, fn, {_SCORES} FROM c")
def k1(spark, sf):
    return rounded(M.confusion(B.samples(spark, sf), "inunda", "inunda_pred", ["scenario_type"]), accuracy=9, precision=9, recall=9, f1=9, csi=9)


@query("k2_zero_division", WITH + "SELECT node_id, count(*) FILTER (inunda = 1 AND prob > 0.97) AS tp, coalesce(round(count(*) FILTER (inunda = 1 AND prob > 0.97) / CAST(nullif(count(*) FILTER (prob > 0.97), 0) AS DOUBLE), 9), 0) AS precision, coalesce(round(count(*) FILTER (inunda = 1 AND prob > 0.97) / CAST(nullif(count(*) FILTER (inunda = 1), 0) AS DOUBLE), 9), 0) AS recall FROM samples GROUP BY node_id")
def k2(spark, sf):
    s = B.samples(spark, sf).withColumn("p", (F.col("prob") > 0.97).cast("int"))
    return rounded(M.confusion(s, "inunda", "p", ["node_id"], zero=0.0).select("node_id", "tp", "precision", "recall"), precision=9, recall=9)


@query("k3_roc_auc", WITH + ", r AS (SELECT *, rank() OVER (PARTITION BY scenario_type ORDER BY prob) + (count(*) OVER (PARTITION BY scenario_type, prob) - 1) / 2e0 AS rk FROM samples) SELECT scenario_type, CAST(sum(inunda) AS BIGINT) AS n_pos, CAST(sum(1 - inunda) AS BIGINT) AS n_neg, round((sum(rk) FILTER (inunda = 1) - sum(inunda) * (sum(inunda) + 1) / 2e0) / (sum(inunda) * sum(1 - inunda)), 9) AS roc_auc FROM r GROUP BY 1")
def k3(spark, sf):
    return rounded(M.roc_auc(B.samples(spark, sf), "inunda", "prob", ["scenario_type"]), roc_auc=9)


@query("k4_pr_auc", WITH + ", d AS (SELECT scenario_type, prob, sum(inunda) AS p, count(*) AS n FROM samples GROUP BY 1, 2), c AS (SELECT *, sum(p) OVER w / CAST(sum(n) OVER w AS DOUBLE) AS prec FROM d WINDOW w AS (PARTITION BY scenario_type ORDER BY prob DESC)) SELECT scenario_type, round(sum(p * prec) / sum(p), 9) AS pr_auc FROM c GROUP BY 1")
def k4(spark, sf):
    return rounded(M.average_precision(B.samples(spark, sf), "inunda", "prob", ["scenario_type"]), pr_auc=9)


@query("k5_nse", WITH + f"SELECT node_id, round({_NSE.format(t='vol', p='vol_pred')}, 7) AS nse FROM samples GROUP BY node_id")
def k5(spark, sf):
    return B.samples(spark, sf).groupBy("node_id").agg(F.round(M.efficiency(F.col("vol"), F.col("vol_pred")), 7).alias("nse"))


@query("k6_oracle_regression", WITH + f"SELECT scenario_type, round({_NSE.format(t='vol', p='vol_pred')}, 7) AS nse, round({_NSE.format(t='ln(1 + vol)', p='ln(1 + greatest(vol_pred, 0))')}, 7) AS log_nse, round(sqrt(avg((vol - vol_pred) * (vol - vol_pred))), 5) AS rmse, round(avg(abs(vol - vol_pred)), 5) AS mae, round(CASE WHEN count(*) >= 2 THEN {_NSE.format(t='vol', p='vol_pred')} END, 7) AS r2, count(*) AS n FROM samples WHERE inunda = 1 GROUP BY 1")
def k6(spark, sf):
    return rounded(M.regression(B.samples(spark, sf).filter("inunda = 1"), "vol", "vol_pred", ["scenario_type"]), nse=7, log_nse=7, rmse=5, mae=5, r2=7)


@query("k7_end_to_end", WITH + f"SELECT scenario_type, round(avg(CASE WHEN inunda = inunda_pred THEN 1e0 ELSE 0e0 END), 9) AS accuracy, round(sqrt(avg((vol - {_ROUTED}) * (vol - {_ROUTED}))), 5) AS rmse, round(sum({_ROUTED}), 6) AS total_pred, round(sum(vol), 4) AS total_truth FROM samples GROUP BY 1")
def k7(spark, sf):
    return rounded(M.end_to_end(B.samples(spark, sf), ["scenario_type"]), accuracy=9, rmse=5, total_pred=6, total_truth=4)


@query("k8_fold_mean_vs_pooled", FOLDED + ", f AS (SELECT fold_id, sqrt(avg((vol - vol_pred) * (vol - vol_pred))) AS rmse FROM folded WHERE inunda = 1 GROUP BY 1) SELECT 'LOSO' AS protocol, round((SELECT avg(rmse) FROM f), 5) AS fold_mean, round((SELECT sqrt(avg((vol - vol_pred) * (vol - vol_pred))) FROM folded WHERE inunda = 1), 5) AS pooled")
def k8(spark, sf):
    s = folded(spark, sf).filter("inunda = 1")
    means = M.fold_means(M.regression(s, "vol", "vol_pred", ["protocol", "fold_id"]), ["protocol"], ["rmse"]).withColumnRenamed("rmse", "fold_mean")
    pooled = M.regression(s, "vol", "vol_pred", ["protocol"]).select("protocol", F.col("rmse").alias("pooled"))
    return rounded(means.join(pooled, "protocol"), fold_mean=5, pooled=5)


@query("k9_by_factor", FOLDED + f", f AS (SELECT protocol, fold_id, factor_mult, avg(CASE WHEN inunda = inunda_pred THEN 1e0 ELSE 0e0 END) AS accuracy, sqrt(avg((vol - {_ROUTED}) * (vol - {_ROUTED}))) AS rmse FROM folded GROUP BY 1, 2, 3) SELECT protocol, printf('%.2f', factor_mult) AS factor, round(avg(accuracy), 9) AS accuracy, round(avg(rmse), 5) AS rmse FROM f GROUP BY 1, 2")
def k9(spark, sf):
    per = M.end_to_end(folded(spark, sf), ["protocol", "fold_id", "factor_mult"])
    return rounded(M.fold_means(per.withColumn("factor", F.format_string("%.2f", "factor_mult")), ["protocol", "factor"], ["accuracy", "rmse"]), accuracy=9, rmse=5)


@query("k10_volume_errors", WITH + "SELECT shape_id, round(avg(abs(vol_pred - vol)), 5) AS mae, round(sqrt(avg((vol - vol_pred) * (vol - vol_pred))), 5) AS rmse, round(sum(vol), 4) AS total_truth, round(sum(vol_pred), 6) AS total_pred, round(sum(vol_pred) - sum(vol), 6) AS error, round(CASE WHEN sum(vol) > 0 THEN 100 * (sum(vol_pred) - sum(vol)) / sum(vol) END, 6) AS error_pct FROM samples GROUP BY 1")
def k10(spark, sf):
    return rounded(M.volume_errors(B.samples(spark, sf), "vol", "vol_pred", ["shape_id"]), mae=5, rmse=5, total_truth=4, total_pred=6, error=6, error_pct=6)


@query("k11_conditional", WITH + "SELECT node_id, count(*) AS n, round(avg(abs(vol_pred - vol)), 5) AS mae, round(sqrt(avg((vol - vol_pred) * (vol - vol_pred))), 5) AS rmse FROM samples WHERE vol > 0 GROUP BY node_id")
def k11(spark, sf):
    return rounded(M.regression(B.samples(spark, sf).filter("vol > 0"), "vol", "vol_pred", ["node_id"]).select("node_id", "n", "mae", "rmse"), mae=5, rmse=5)


@query("k12_per_node_r2", WITH + "SELECT node_id, count(*) AS n, round(CASE WHEN count(*) >= 2 AND var_pop(vol) > 0 THEN 1 - sum((vol - vol_pred) * (vol - vol_pred)) / (var_pop(vol) * count(*)) END, 7) AS r2 FROM samples GROUP BY node_id")
def k12(spark, sf):
    return rounded(M.r2_per_node(B.samples(spark, sf), "node_id", "vol", "vol_pred"), r2=7)


@query("k14_fold_spread", FOLDED + ", f AS (SELECT protocol, fold_id, avg(CASE WHEN inunda = inunda_pred THEN 1e0 ELSE 0e0 END) AS accuracy FROM folded GROUP BY 1, 2) SELECT protocol, round(avg(accuracy), 9) AS accuracy_mean, round(stddev_pop(accuracy), 9) AS accuracy_std FROM f GROUP BY 1")
def k14(spark, sf):
    return rounded(M.fold_spread(M.end_to_end(folded(spark, sf), ["protocol", "fold_id"]), ["protocol"], ["accuracy"]), accuracy_mean=9, accuracy_std=9)


_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_PAIRS = [(a, b) for i, a in enumerate(_COLUMNS) for b in _COLUMNS[i + 1 :]]


@query("k16_correlation", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 7) AS r FROM lineitem" for a, b in _PAIRS))
def k16(spark, sf):
    return rounded(M.correlation_pairs(read_table(spark, sf, "lineitem"), _COLUMNS), r=7)


@query("k17_high_corr_pairs", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 7) AS r FROM lineitem" for a, b in _PAIRS) + ") WHERE abs(r) >= 0.005")
def k17(spark, sf):
    return rounded(M.high_pairs(M.correlation_pairs(read_table(spark, sf, "lineitem"), _COLUMNS), 0.005), r=7)


@query("k19_spearman", "WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2e0 AS x, rank() OVER (ORDER BY l_tax) + (count(*) OVER (PARTITION BY l_tax) - 1) / 2e0 AS y FROM lineitem) SELECT 'l_quantity' AS a, 'l_tax' AS b, round(corr(x, y), 7) AS r FROM r")
def k19(spark, sf):
    return rounded(M.spearman(read_table(spark, sf, "lineitem"), [("l_quantity", "l_tax")]), r=7)


@query("k21_ranking", WITH + ", m AS (SELECT scenario_type AS family, CASE WHEN scenario_type LIKE '2%' THEN NULL ELSE sqrt(avg((vol - vol_pred) * (vol - vol_pred))) END AS rmse, avg(prob) AS f1 FROM samples GROUP BY 1) SELECT row_number() OVER (ORDER BY (rmse IS NULL), rmse, -f1, family) AS rank, family, CAST(rmse IS NOT NULL AS INTEGER) AS valid, CASE WHEN rmse IS NULL THEN 'rmse has no value' END AS reason, round(rmse, 5) AS rmse FROM m")
def k21(spark, sf):
    s = B.samples(spark, sf).groupBy(F.col("scenario_type").alias("family")).agg(M.rmse(F.col("vol"), F.col("vol_pred")).alias("rmse"), F.avg("prob").alias("f1"))
    return rounded(M.ranking(s.withColumn("rmse", F.when(~F.col("family").startswith("2"), F.col("rmse"))), "rmse", [("f1", True)]), rmse=5)


@query("k25_quantile_threshold", WITH + "SELECT round(greatest(quantile_cont(vol_pred, 0.75), 1e-6), 6) AS threshold FROM samples")
def k25(spark, sf):
    return rounded(M.quantile_threshold(B.samples(spark, sf), "vol_pred"), threshold=6)


@query("k27_class_weight", FOLDED + "SELECT fold_id, round(coalesce(count(*) FILTER (inunda = 0) / CAST(nullif(count(*) FILTER (inunda = 1), 0) AS DOUBLE), 1e0), 9) AS pos_weight FROM folded GROUP BY fold_id")
def k27(spark, sf):
    return rounded(M.class_weight(folded(spark, sf), "inunda", ["fold_id"]), pos_weight=9)


@query("w8_topk_per_group", "SELECT p_brand AS component, p_partkey AS feature, p_retailprice - 1200 AS loading, rank FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY abs(p_retailprice - 1200) DESC, p_partkey) AS rank FROM part) WHERE rank <= 3")
def w8(spark, sf):
    part = read_table(spark, sf, "part").select(F.col("p_brand").alias("component"), F.col("p_partkey").alias("feature"), (F.col("p_retailprice") - 1200).alias("loading"))
    return M.top_loadings(part, 3).withColumn("rank", F.col("rank").cast("long"))
