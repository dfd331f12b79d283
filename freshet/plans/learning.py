"""Queries of rank correlations, batches of sequences, scored windows, exact splits, components and left-out fits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from freshet.operators import batches as Q
from freshet.operators import components as C
from freshet.operators import folds as K
from freshet.operators import metrics as M
from freshet.operators import models
from freshet.operators import scoring as W
from freshet.operators import timeseries as T
from freshet.operators import trials as L
from freshet.operators.ordinal import kendall
from freshet.plans import bindings as B
from freshet.plans.networks import GRID, filled
from freshet.plans.registry import query
from freshet.plans.scores import rounded
from freshet.plans.trials import _FITS, FEATURES, TARGET, lines
from freshet.session import read_table

WITH = f"WITH {B.SAMPLES} "
EV = f"WITH {B.EVENTS} "


def _tau(table: str, a: str, b: str) -> str:
    counted = f"SELECT {a} AS x, {b} AS y, CAST(count(*) AS DOUBLE) AS n FROM {table} GROUP BY 1, 2"
    ties = "SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY {})"
    return f"""SELECT '{a}' AS a, '{b}' AS b, (WITH c AS ({counted}), t AS (SELECT sum(n) * (sum(n) - 1) / 2 AS n0 FROM c)
      SELECT round((SELECT sum(p.n * q.n * sign((p.x - q.x) * (p.y - q.y))) / 2 FROM c p, c q) / sqrt((n0 - ({ties.format("x")})) * (n0 - ({ties.format("y")}))), 9) FROM t) AS r"""


_LINE_PAIRS = [("l_quantity", "l_discount"), ("l_quantity", "l_tax"), ("l_discount", "l_tax")]


@query("k16_kendall", " UNION ALL ".join([*[_tau("lineitem", a, b) for a, b in _LINE_PAIRS], _tau("supplier", "s_acctbal", "s_nationkey"), _tau("customer", "c_acctbal", "c_nationkey")]))
def k16_kendall(spark, sf):
    found = kendall(read_table(spark, sf, "lineitem"), _LINE_PAIRS)
    for table, pair in (("supplier", ("s_acctbal", "s_nationkey")), ("customer", ("c_acctbal", "c_nationkey"))):
        found = found.unionByName(kendall(read_table(spark, sf, table), [pair]))
    return rounded(found, r=9)


def _ranks(table: str, c: str) -> str:
    return f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2e0"


@query("k16_spearman", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr(x, y), 7) AS r FROM (SELECT {_ranks('lineitem', a)} AS x, {_ranks('lineitem', b)} AS y FROM lineitem)" for a, b in _LINE_PAIRS))
def k16_spearman(spark, sf):
    return rounded(M.correlations(read_table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "spearman"), r=7)


#: Steps, padding included, that a batch of the queries may hold.
CELLS = 640
_PLAN = f"""WITH RECURSIVE {B.EVENTS}, ranked AS (
  SELECT user_id, n AS length, row_number() OVER (ORDER BY n DESC, user_id) - 1 AS r FROM (SELECT user_id, count(*) AS n FROM series GROUP BY user_id)
), starts(batch, s, size) AS (
  SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), greatest(1, {CELLS} // length) FROM ranked WHERE r = 0
  UNION ALL SELECT batch + 1, s + size, greatest(1, {CELLS} // length) FROM starts JOIN ranked ON r = s + size
), plan AS (
  SELECT user_id, length, batch, max(length) OVER (PARTITION BY batch) AS pad_to FROM ranked JOIN starts ON r >= s AND r < s + size
) """


def planned(spark, sf):
    s = B.series(spark, sf)
    return s, Q.batch_plan(s.groupBy("user_id").agg(F.count(F.lit(1)).alias("length")), ["user_id"], CELLS)


@query("t6_batches", _PLAN + "SELECT user_id, length, batch, pad_to FROM plan")
def t6_batches(spark, sf):
    return planned(spark, sf)[1]


@query("t6_padded_sequences", _PLAN + "SELECT user_id, batch, CAST(row_number() OVER (PARTITION BY user_id ORDER BY t) - 1 AS INTEGER) AS position, value, false AS padding FROM series JOIN plan USING (user_id) UNION ALL SELECT user_id, batch, CAST(unnest(range(length, pad_to)) AS INTEGER), 0e0, true FROM plan")
def t6(spark, sf):
    """The contents of all sequences, each padded to its batch's longest."""
    s, plan = planned(spark, sf)
    rows = T.sequence_rows(s.withColumn("over", F.col("value") - 90), ["user_id"], "t", ["value"], "over")
    return Q.batched_rows(rows, plan, ["user_id"], "position", ["value"])


def linear_scorer(sequences: np.ndarray, static: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-(0.01 * sequences.sum(axis=(1, 2)) + 0.0001 * static[:, 0] - 3)))


_SCORED = f"""WITH {GRID}, n AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n, sum(value) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS total FROM filled
), scored AS (
  SELECT user_id AS node_id, t AS start, 1 / (1 + exp(-(0.01e0 * total + 0.0001e0 * coalesce(c_acctbal, 0) - 3))) AS score FROM n LEFT JOIN customer ON c_custkey = user_id AND c_mktsegment <> 'FURNITURE' WHERE i % 4 = 0 AND i + 9 <= n
) """


def scored(spark, sf):
    windows = T.sliding_windows(filled(spark, sf), ["user_id"], "t", ["value"], "value", width=6, horizon=3, stride=4)
    static = read_table(spark, sf, "customer").filter("c_mktsegment <> 'FURNITURE'").select(F.col("c_custkey").alias("user_id"), "c_acctbal")
    beside = windows.join(static, "user_id", "left").withColumnRenamed("user_id", "node_id")
    return W.score_windows(beside, linear_scorer, ["node_id", "start"], static=["c_acctbal"])


@query("f19_window_scores", _SCORED + "SELECT node_id, start, round(score, 9) AS score FROM scored")
def f19(spark, sf):
    return rounded(scored(spark, sf), score=9)


@query("f19_node_scores", _SCORED + "SELECT u.user_id AS node_id, round(max(score), 9) AS max_flood_prob, round(avg(score), 9) AS mean_flood_prob, count(score) AS windows_total, count(*) FILTER (score >= 0.5) AS windows_flood_predicted, any_value(u.flooded) AS actual_flooded FROM (SELECT user_id, max(CAST(value > 90 AS INTEGER)) AS flooded FROM series GROUP BY 1) u LEFT JOIN scored s ON s.node_id = u.user_id GROUP BY 1")
def f19_nodes(spark, sf):
    actual = B.series(spark, sf).groupBy(F.col("user_id").alias("node_id")).agg(F.max((F.col("value") > 90).cast("int")).alias("actual_flooded"))
    return rounded(W.node_scores(scored(spark, sf), actual, "classification"), max_flood_prob=9, mean_flood_prob=9)


@query("f19_node_peaks", _SCORED + "SELECT u.user_id AS node_id, round(max(score), 9) AS max_peak_flooding_lps_pred, round(avg(score), 9) AS mean_peak_flooding_lps_pred, count(score) AS windows_total, any_value(u.peak) AS actual_peak_flooding_lps FROM (SELECT user_id, max(value) AS peak FROM series GROUP BY 1) u LEFT JOIN scored s ON s.node_id = u.user_id GROUP BY 1")
def f19_peaks(spark, sf):
    actual = B.series(spark, sf).groupBy(F.col("user_id").alias("node_id")).agg(F.max("value").alias("actual_peak_flooding_lps"))
    return rounded(W.node_scores(scored(spark, sf), actual, "regression"), max_peak_flooding_lps_pred=9, mean_peak_flooding_lps_pred=9)


@query("f4_grouped_split", "WITH g AS (SELECT o_custkey, row_number() OVER (ORDER BY md5('42:' || o_custkey)) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT o_custkey FROM orders)) SELECT o_orderkey, o_custkey, CASE WHEN k <= ceil(0.2e0 * n) THEN 'test' ELSE 'train' END AS split FROM orders JOIN g USING (o_custkey)")
def f4(spark, sf):
    return K.grouped_split(read_table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey")


_FEATURES = ["vol", "vol_pred", "prob"]
#: Eigenvalues of the correlation matrix of three columns in closed form, and eigenvectors as cross products of its rows.
_EIGEN = WITH + """, m AS (
  SELECT corr(vol, vol_pred) AS a, corr(vol, prob) AS b, corr(vol_pred, prob) AS c, avg(vol) AS m1, avg(vol_pred) AS m2, avg(prob) AS m3, stddev_pop(vol) AS s1, stddev_pop(vol_pred) AS s2, stddev_pop(prob) AS s3, count(*) AS n FROM samples
), w AS (
  SELECT *, sqrt((a * a + b * b + c * c) / 3) AS p FROM m
), f AS (
  SELECT *, acos(greatest(-1, least(1, a * b * c / (p * p * p)))) / 3 AS phi FROM w
), e AS (
  SELECT *, 1 + 2 * p * cos(phi) AS l1, 1 - 2 * p * (cos(phi) + cos(phi + 2 * pi() / 3)) AS l2, 1 + 2 * p * cos(phi + 2 * pi() / 3) AS l3 FROM f
), v AS (
  SELECT k, l, n, a * c - b * (1 - l) AS x1, a * b - (1 - l) * c AS x2, (1 - l) * (1 - l) - a * a AS x3, m1, m2, m3, s1, s2, s3 FROM (SELECT *, unnest([1, 2, 3]) AS k, unnest([l1, l2, l3]) AS l FROM e)
), u AS (
  SELECT k, l, n, m1, m2, m3, s1, s2, s3, x1 / z AS u1, x2 / z AS u2, x3 / z AS u3 FROM (SELECT *, sqrt(x1 * x1 + x2 * x2 + x3 * x3)
    * sign(CASE WHEN abs(x1) >= abs(x2) AND abs(x1) >= abs(x3) THEN x1 WHEN abs(x2) >= abs(x3) THEN x2 ELSE x3 END) AS z FROM v)
) """


@query("k20_variances", _EIGEN + "SELECT 'PC' || k AS component, round(l * n / (n - 1), 7) AS eigenvalue, round(l / 3, 7) AS share, round(sum(l) OVER (ORDER BY k) / 3, 7) AS cumulative FROM u")
def k20_variances(spark, sf):
    s = B.samples(spark, sf)
    return rounded(C.fit_components(s, _FEATURES).variance_table(s), eigenvalue=7, share=7, cumulative=7)


@query("k20_loadings", _EIGEN + "SELECT 'PC' || k AS component, feature, round(loading, 6) AS loading, row_number() OVER (PARTITION BY k ORDER BY abs(loading) DESC, feature) AS rank FROM (SELECT k, unnest(['vol', 'vol_pred', 'prob']) AS feature, unnest([u1, u2, u3]) AS loading FROM u) QUALIFY rank <= 2")
def k20_loadings(spark, sf):
    s = B.samples(spark, sf)
    top = M.top_loadings(C.fit_components(s, _FEATURES).loading_table(s), 2)
    return rounded(top.withColumn("rank", F.col("rank").cast("long")), loading=6)


@query("k20_projection", _EIGEN + "SELECT run_id, node_id, " + ", ".join(f"(SELECT round(u1 * (vol - m1) / s1 + u2 * (vol_pred - m2) / s2 + u3 * (prob - m3) / s3, 4) + 0e0 FROM u WHERE k = {k}) AS PC{k}" for k in (1, 2, 3)) + " FROM samples")
def k20_projection(spark, sf):
    s = B.samples(spark, sf)
    rows = C.fit_components(s, _FEATURES).project(s, ["run_id", "node_id"])
    return rows.select("run_id", "node_id", *[(F.round(c, 4) + 0.0).alias(c) for c in ("PC1", "PC2", "PC3")])


@query("w9_cumulative_variance", _EIGEN + ", t AS (SELECT k, round(sum(l) OVER (ORDER BY k) / 3, 7) AS cumulative FROM u) SELECT CAST(k AS INTEGER) AS component, cumulative, CAST((SELECT min(o.k) FROM t o WHERE o.cumulative >= t.cumulative - 1e-6) AS INTEGER) AS needed FROM t")
def w9(spark, sf):
    total = np.cumsum(C.fit_components(B.samples(spark, sf), _FEATURES).shares).round(7).tolist()
    rows = [(k + 1, x, M.components_needed(total, x - 1e-6)) for k, x in enumerate(total)]
    return spark.createDataFrame(rows, "component int, cumulative double, needed int")


@query("f7_left_out_predictions", _FITS + "SELECT fold AS l_returnflag, y AS l_extendedprice, round(y - ef, 2) AS prediction FROM e")
def f7(spark, sf):
    """Every line's price by a fit on the lines of all other flags."""
    return rounded(L.left_out_predictions(lines(spark, sf), "l_returnflag", FEATURES, TARGET), prediction=2)


@query(
    "f10_fold_preparation",
    "WITH g AS (SELECT DISTINCT l_returnflag AS fold FROM lineitem), t AS (SELECT fold, unnest(['l_quantity', 'l_tax']) AS feature, unnest([CASE WHEN l_linenumber <> 2 THEN l_quantity END, l_tax]) AS x FROM lineitem JOIN g ON l_returnflag <> fold), m AS (SELECT fold, feature, median(x) AS middle FROM t GROUP BY 1, 2) SELECT fold, feature, round(any_value(middle), 6) AS median, round(avg(coalesce(x, middle)), 6) AS mean, round(stddev_pop(coalesce(x, middle)), 6) AS deviation FROM t JOIN m USING (fold, feature) GROUP BY 1, 2",
)
def f10(spark, sf):
    """What each fold's training rows alone say of the features: medians for what is missing, then means and deviations."""
    rows = read_table(spark, sf, "lineitem").select("l_returnflag", F.when(F.col("l_linenumber") != 2, F.col("l_quantity")).alias("l_quantity"), "l_tax")
    out = []
    for (fold,) in rows.select("l_returnflag").distinct().orderBy("l_returnflag").collect():  # a handful of folds
        prep = models.Preparation.fit(rows.filter(F.col("l_returnflag") != fold), ["l_quantity", "l_tax"], scaled=True)
        out += [(fold, *row) for row in zip(prep.columns, prep.medians, prep.means, prep.deviations, strict=True)]
    return rounded(spark.createDataFrame(out, "fold string, feature string, median double, mean double, deviation double"), median=6, mean=6, deviation=6)


_CASCADE = ["factor_mult", "t", "network_id"]


@query(
    "f6_cascade",
    WITH + "SELECT 'balance' AS fact, 0.5e0 AS value FROM (SELECT 1 FROM samples LIMIT 1) UNION ALL SELECT 'log_volume', round(avg(ln(1 + vol)), 4) FROM samples WHERE inunda = 1 "
    "UNION ALL SELECT 'rows', CAST(count(*) AS DOUBLE) FROM samples UNION ALL SELECT 'routed_wrongly', 0e0 FROM (SELECT 1 FROM samples LIMIT 1)",
)
def f6(spark, sf):
    """A cascade of linear models, fitted on all samples and flooded ones, by what its fits must meet: with classes weighted
    to balance, the weighted mean probability is a half; the mean logarithm of predicted volumes is that of flooded rows; and
    volumes are predicted where a flood is, only there."""
    s = B.samples(spark, sf).select("run_id", "node_id", "inunda", "vol", *_CASCADE)
    found = models.fit_cascade(s, _CASCADE, models.FAMILIES["linear"]).predict(s, ["inunda", "vol"])
    flooded = F.col("inunda") == 1
    totals = found.agg(
        F.avg(F.when(flooded, F.col("prob"))).alias("p1"), F.avg(F.when(~flooded, F.col("prob"))).alias("p0"), F.avg(F.when(flooded, F.log1p("vol_raw"))).alias("log"),
        F.count(F.lit(1)).cast("double").alias("rows"), F.count_if((F.col("inunda_pred") == 0) & (F.col("vol_pred") != 0) | (F.col("inunda_pred") == 1) & (F.col("vol_pred") != F.col("vol_raw"))).cast("double").alias("wrong"),
    )
    facts = {"balance": F.round((F.col("p1") + F.col("p0")) / 2, 4), "log_volume": F.round("log", 4), "rows": F.col("rows"), "routed_wrongly": F.col("wrong")}
    return totals.select(F.explode(F.array(*[F.struct(F.lit(k).alias("fact"), v.alias("value")) for k, v in facts.items()])).alias("e")).select("e.*")
