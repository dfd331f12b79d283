"""Literal results on small fixtures."""

import math

import pytest
from pyspark.sql import functions as F

from freshet.functions import scalars as S
from freshet.operators import aggregates as A
from freshet.operators import features as X
from freshet.operators import folds as D
from freshet.operators import graph as G
from freshet.operators import metrics as M
from freshet.operators import relations as R
from freshet.operators import timeseries as T
from freshet.operators import validation as V


def rows(df, *columns):
    return sorted(tuple(r[c] for c in (columns or df.columns)) for r in df.collect())


def dataset(spark):
    out = []
    for shape in ("base", "storm_a"):
        for factor in (1.0, 2.0, 3.0):
            for i in range(4):
                wet = i < 2 and factor >= 2
                out.append((f"N{i}", shape, factor, 50.0 * factor if wet else 0.0, int(wet), f"{shape}{factor}"))
    return spark.createDataFrame(out, "node_id string, shape_id string, factor_mult double, vol double, inunda int, run_id string")


def test_flood_integration(spark):
    df = spark.createDataFrame([("J1", 60.0, 10.0), ("J1", 120.0, 20.0), ("J1", 180.0, 0.0), ("J2", 60.0, 0.0), ("J2", 120.0, 5.0)], "node_id string, t double, q double")
    got = dict(rows(T.integrate_m3(df, "node_id", "t", "q")))
    assert got == {"J1": pytest.approx(1.8), "J2": pytest.approx(0.3)}


def test_shapes(spark):
    shape = spark.createDataFrame([("s", float(t), q) for t, q in enumerate((0.0, 0.5, 1.0, 0.3, 0.0))], "shape_id string, time_h double, q double")
    assert rows(T.shape_stats(shape, "shape_id", "time_h", "q")) == [("s", 4.0, 2.0)]
    two = spark.createDataFrame([("s", 0.0, 0.0), ("s", 1.0, 1.0), ("s", 2.0, 0.0)], "shape_id string, time_h double, q_norm double")
    nodes = spark.createDataFrame([("A", 10.0), ("B", 5.0), ("C", 0.0)], "node_id string, base double")
    flow = T.apply_shape(two, nodes, spark.createDataFrame([(2.0,)], "factor_mult double"))
    assert rows(flow.groupBy("node_id").agg(F.max("flow").alias("peak"))) == [("A", 20.0), ("B", 10.0)]
    raw = spark.createDataFrame([("s", 0, 0.0), ("s", 1, 40.0), ("s", 2, 20.0)], "k string, t int, q double")
    assert [r[3] for r in sorted(map(tuple, T.normalised(raw, "k", "q").collect()))] == [0.0, 1.0, 0.5]
    with pytest.raises(Exception, match="positive peak"):
        T.normalised(raw.withColumn("q", F.lit(0.0)), "k", "q").collect()


def test_first_peak_wins(spark):
    df = spark.createDataFrame([("k", 1, 5.0), ("k", 3, 5.0), ("k", 2, 1.0)], "k string, t int, v double")
    assert rows(A.peaks(df, "k", "t", "v")) == [("k", 5.0, 1, 5.0)]


def test_resilience(spark):
    df = spark.createDataFrame([(f"J{i}", f, int(i > 1 and f == 2), 0.0) for f in (1.0, 2.0) for i in range(4)], "node_id string, factor_mult double, inunda int, vol double")
    assert rows(A.resilience_curve(df), "factor_mult", "resilience") == [(1.0, 1.0), (2.0, 0.5)]


def test_quality(spark):
    df = dataset(spark).filter("shape_id = 'base'")
    one = A.quality_report(df, 0.0).first()
    assert (one["n_rows"], one["n_runs"], one["n_flooded"], one["n_dry"], one["disagreements"]) == (12, 3, 4, 8, 0)
    assert rows(A.conditional_counts(df, "factor_mult", flooded=F.col("inunda") == 1)) == [(1.0, 4, 0), (2.0, 4, 2), (3.0, 4, 2)]


@pytest.mark.parametrize(("truth", "pred", "want"), [([1, 2, 3, 4], [1, 2, 3, 4], 1.0), ([1, 2, 3, 4], [2.5] * 4, 0.0), ([5, 5, 5], [5, 5, 5], 1.0), ([5, 5, 5], [5, 5, 6], 0.0)])
def test_efficiency(spark, truth, pred, want):
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(truth, pred)], "t double, p double")
    assert df.agg(M.efficiency(F.col("t"), F.col("p")).alias("x")).first()["x"] == pytest.approx(want)


def test_regression(spark):
    df = spark.createDataFrame([(1.0, 2.0), (10.0, 8.0), (100.0, 110.0), (1000.0, 900.0)], "t double, p double")
    got = M.regression(df, "t", "p").first()
    assert got["nse"] == pytest.approx(0.9855955793182168)
    assert got["log_nse"] == pytest.approx(0.98972348644384)
    assert got["rmse"] == pytest.approx(50.2618145315109)
    assert got["mae"] == pytest.approx(28.25)


def test_pooled_is_not_the_mean_of_folds(spark):
    df = spark.createDataFrame([(0, 10.0, 12.0), (0, 20.0, 18.0), (1, 1000.0, 900.0)], "fold_id int, t double, p double")
    pooled = M.regression(df, "t", "p").first()
    assert pooled["rmse"] == pytest.approx(57.758116312774604)
    assert pooled["nse"] == pytest.approx(0.9845284963413378)
    folds = M.fold_means(M.regression(df, "t", "p", ["fold_id"]).withColumn("k", F.lit(1)), ["k"], ["nse", "rmse"]).first()
    assert folds["rmse"] == pytest.approx(51.0)


def test_classifier_metrics(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (1, 0, 0.4), (0, 0, 0.2), (0, 0, 0.1)], "y int, p int, s double")
    got = M.confusion(df, "y", "p").first()
    assert (got["precision"], got["recall"], got["f1"]) == (1.0, 0.5, pytest.approx(2 / 3))
    assert M.roc_auc(df, "y", "s").first()["roc_auc"] == 1.0
    assert M.roc_auc(df.filter("y = 1"), "y", "s").first()["roc_auc"] is None
    assert M.average_precision(df.filter("y = 1"), "y", "s").first()["pr_auc"] is None
    assert M.confusion(df.filter("y = 0"), "y", "p").first()["precision"] is None
    assert M.confusion(df.filter("y = 0"), "y", "p", zero=0.0).first()["precision"] == 0.0


def test_end_to_end(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0, 0), (100.0, 90.0, 1, 1), (0.0, 0.0, 0, 0), (50.0, 0.0, 1, 0)], "vol double, vol_pred double, inunda int, inunda_pred int")
    got = M.end_to_end(df).first()
    assert (got["accuracy"], got["total_pred"], got["total_truth"]) == (0.75, 90.0, 150.0)
    assert got["rmse"] == pytest.approx(math.sqrt(2600 / 4))


def test_fold_means_ignore_nan(spark):
    df = spark.createDataFrame([("a", 0.8, float("nan")), ("a", 0.6, 0.9)], "k string, f1 double, auc double")
    assert rows(M.fold_means(df, ["k"], ["f1", "auc"])) == [("a", pytest.approx(0.7), pytest.approx(0.9))]


def test_ranking(spark):
    df = spark.createDataFrame([("xgboost", 3.0, 0.5), ("svm", 9.0, 0.5), ("linear", 6.0, 0.5), ("odd", float("nan"), 0.9), ("a", 3.0, 0.4)], "family string, rmse double, f1 double")
    got = [(r["family"], r["valid"]) for r in M.ranking(df, "rmse", [("f1", True)]).orderBy("rank").collect()]
    assert got == [("xgboost", 1), ("a", 1), ("linear", 1), ("svm", 1), ("odd", 0)]


def test_folds(spark):
    df = spark.createDataFrame([(g / 5, k) for g in range(1, 26) for k in range(28)], "factor_mult double, k int")
    loso = D.leave_one_out(df, "factor_mult")
    assert loso.count() == 25
    assert loso.filter("fold_id = 0").first()["factor_mult"] == 0.2
    five = D.balanced(df, "factor_mult")
    assert rows(five.groupBy("fold_id").count()) == [(k, 5) for k in range(5)]
    indexed = D.sample_index(df, "factor_mult", "k")
    assert sorted(r[0] for r in indexed.select("sample_idx").collect()) == list(range(700))
    long = D.long_form(indexed, five, "factor_mult", "GroupKFold")
    assert rows(long.filter("split = 'test'").groupBy("sample_idx").agg(F.count(F.lit(1)).alias("n")).groupBy("n").count()) == [(1, 700)]
    with pytest.raises(Exception, match="fewer than 5"):
        D.balanced(df.filter("factor_mult < 0.7"), "factor_mult").collect()


@pytest.mark.parametrize("n_folds", [2, 3, 7])
def test_balanced_folds_are_those_of_dealing_one_by_one(spark, n_folds):
    sizes = [(k * 37) % 11 + 1 for k in range(60)] + [400, 90, 90, 1, 1, 1]
    df = spark.createDataFrame([(g if g else None, k) for g, n in enumerate(sizes) for k in range(n)], "g int, k int")
    loads, want = [0] * n_folds, {}
    for n, g in sorted(((n, g) for g, n in enumerate(sizes)), reverse=True):
        lightest = loads.index(min(loads))
        loads[lightest] += n
        want[g or None] = lightest
    assert dict(map(tuple, D.balanced(df, "g", n_folds).collect())) == want


def test_dealt_groups_fill_the_lightest_folds():
    assert D.dealt([0, 0, 0], 5, 4) == [2, 1, 1]
    assert D.dealt([100, 0, 3], 1, 7) == [0, 5, 2]


def test_labels(spark):
    df = spark.createDataFrame([(1.0,), (0.5,), (0.0,)], "v double")
    assert [r[0] for r in df.select(S.flood_label(F.col("v"), 1.0)).collect()] == [1, 0, 0]
    assert [r[0] for r in df.select(S.flood_label(F.col("v"), 0.0)).collect()] == [1, 1, 0]


def test_resample_discards_what_is_off_the_grid(spark):
    df = spark.createDataFrame([("n", 0, None), ("n", 5, 1.0), ("n", 7, 9.0), ("n", 20, 2.0)], "k string, t int, v double")
    assert rows(T.resample(df, ["k"], "t", 5, ["v"])) == [("n", 5, 1.0), ("n", 10, 1.0), ("n", 15, 1.0), ("n", 20, 2.0)]


def test_windows(spark):
    df = spark.createDataFrame([("n", t * 5, float(t), 5.0 if t == 4 else 0.0) for t in range(20)], "k string, t int, x double, f double")
    got = T.sliding_windows(df, ["k"], "t", ["x", "f"], "f", width=4, horizon=1, stride=1).orderBy("start").collect()
    assert len(got) == 16
    assert (got[0]["label"], got[0]["y"], got[1]["label"]) == (1, 5.0, 0)
    assert got[3]["sequence"] == [[3.0, 0.0], [4.0, 5.0], [5.0, 0.0], [6.0, 0.0]]
    assert T.sliding_windows(df.filter("t < 15"), ["k"], "t", ["x"], "f", 4, 1, 1).count() == 0


def test_interpolation_is_held_at_the_ends(spark):
    points = spark.createDataFrame([("k", 10.0, 1.0), ("k", 20.0, 3.0)], "k string, t double, v double")
    at = spark.createDataFrame([("k", x) for x in (0.0, 10.0, 15.0, 20.0, 30.0)], "k string, t double")
    assert [r[2] for r in rows(T.interpolate(points, at, ["k"], "t", "v"))] == [1.0, 1.0, 2.0, 3.0, 3.0]


def test_padding_and_drain(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 0.0), ("b", 0, 0.0)], "k string, t int, v double")
    got = {r["k"]: (r["length"], r["sequence"], r["label"]) for r in T.padded_sequences(df, ["k"], "t", ["v"], "v").collect()}
    assert got == {"a": (2, [[1.0], [0.0]], 1), "b": (1, [[0.0], [0.0]], 0)}
    assert T.with_drain_down(df, "k", "t", "v", 6).count() == 5


def test_graph(spark):
    edges = spark.createDataFrame([("a", "c", 1.0), ("b", "c", 2.0), ("c", "d", 3.0), ("a", "d", 9.0), ("d", "out", 1.0), ("x", "y", 1.0)], "from_node string, to_node string, length double")
    nodes = spark.createDataFrame([(n, v) for n, v in (("a", 1.0), ("b", 2.0), ("c", 3.0), ("d", 4.0), ("out", 0.0), ("x", 5.0))], "node_id string, q double")
    reach = G.closure(edges)
    assert dict(rows(G.ancestor_counts(nodes, reach))) == {"a": 0, "b": 0, "c": 2, "d": 3, "out": 4, "x": 0}
    assert dict(rows(G.accumulate(nodes, reach, "q")))["d"] == 10.0
    distance = G.distance_to_outfall(nodes, edges, nodes.filter("node_id = 'out'"))
    assert {r["node_id"]: r["distance"] for r in distance.collect()} == {"a": 5.0, "b": 6.0, "c": 4.0, "d": 1.0, "out": 0.0, "x": None}
    cycle = spark.createDataFrame([("p", "q"), ("q", "p")], "from_node string, to_node string")
    assert rows(G.closure(cycle)) == [("p", "q"), ("q", "p")]
    assert G.unique_edges(edges.unionByName(edges.filter("from_node = 'a'")).withColumn("o", F.monotonically_increasing_id()), "o").count() == 6


def test_supersession_follows_chains_beyond_the_recursion_limit(spark):
    limit, deep = "spark.sql.cteRecursionLevelLimit", 70
    links = [(i, i - 1 if i else None) for i in range(deep)] + [(5000, 60), (6000, 9999), (7000, 7001), (7001, 7000), (7002, 7001), (8000, 3), (8000, 5)]
    before = spark.conf.get(limit)
    spark.conf.set(limit, "10")
    try:
        got = sorted(tuple(r) for r in G.supersession(spark.createDataFrame(links, "id long, supersedes long")).collect())
    finally:
        spark.conf.set(limit, before)
    assert got == [*((i, 0, i) for i in range(deep)), (5000, 0, 61), (8000, 0, 4), (8000, 0, 6)]
    assert G.supersession(spark.createDataFrame([], "id long, supersedes long")).count() == 0
    with pytest.raises(ValueError, match="cycle"):
        G.supersession(spark.createDataFrame([(1, None), (1, 2), (2, 1)], "id long, supersedes long"))


def test_scenario_rules(spark):
    nodes = spark.createDataFrame([("1C",), ("2C",)], "node_id string")
    good = [("1C", "0:00", "0.6"), ("1C", "0:03", "0.9"), ("2C", "0:00", "0.8"), ("2C", "0:03", "1.2")]
    frame = lambda r: spark.createDataFrame(r, "node_id string, time string, value string").coalesce(1)
    broken = lambda r: {x["rule"] for x in V.scenario_rules(frame(r), nodes).collect()}
    assert broken(good) == set()
    assert "unknown_node" in broken([*good, ("9C", "0:00", "1"), ("9C", "0:03", "1")])
    assert broken(good[:2]) == {"missing_node"}
    assert "too_few_steps" in broken(good[:3])
    assert "start" in broken([("1C", "0:01", "1"), *good[1:]])
    assert "time_format" in broken([*good[:3], ("2C", "0:3", "1")])
    assert "repeated_time" in broken([*good, good[0]])
    assert "not_rising" in broken([good[1], good[0], *good[2:]])
    assert "grid" in broken([*good[:3], ("2C", "0:04", "1")])
    assert broken([*good[:3], ("2C", "0:03", "-1")]) == {"value"}
    assert broken([*good[:3], ("2C", "0:03", "nan")]) == {"value"}


def test_rules(spark):
    assert V.check_run_ids([3, 1, 3]) == [3, 1]
    for bad in ([], [0], [True], [2**63], ["1"]):
        with pytest.raises(V.RuleError):
            V.check_run_ids(bad)
    df = spark.createDataFrame([(1, 0, 0.0), (2, None, 1.0), (3, 2, 1.0), (4, 1, -1.0), (5, 1, float("nan"))], "k int, inunda int, vol double")
    assert [r[0] for r in rows(V.bad_targets(df), "k")] == [2, 3, 4, 5]
    with pytest.raises(V.RuleError):
        V.guarded_append(df, df.filter("k = 1"), ["k"])
    assert V.guarded_append(df, df.filter("k = 1").withColumn("k", F.lit(9)), ["k"]).count() == 6
    assert V.contract_violations(df, [("k", False), ("vol", False), ("inunda", True)]) != []


def test_relations(spark):
    base = spark.createDataFrame([("a", 1.0, 0), ("b", 2.0, 0)], "k string, vol double, flooded int")
    report = spark.createDataFrame([("a", float("nan"))], "k string, vol double")
    assert rows(R.overlay(base, report, "k", ["vol"])) == [("a", 1.0, 1), ("b", 2.0, 1)]
    later = spark.createDataFrame([("b", 9.0, 1), ("c", 3.0, 0)], "k string, vol double, flooded int")
    assert [r[1] for r in rows(R.upsert(base, later, "k"))] == [1.0, 9.0, 3.0]


def test_features(spark):
    assert [r[0] for r in X.factor_range(spark, 0.2, 1.0, 0.2).collect()] == [0.2, 0.4, 0.6, 0.8, 1.0]
    df = dataset(spark)
    assert X.base_rows(df).count() == 12
    assert X.augmented_rows(df.drop("shape_id")).count() == 0
    assert X.aligned(df, ["vol", "extra"]).columns == ["vol", "extra"]
    clock = spark.createDataFrame([("0:03",), ("12:30",), ("1:60",), ("x",)], "t string").select(S.clock_to_hours(F.col("t")).alias("h"))
    assert [r[0] for r in clock.collect()] == [0.05, 12.5, None, None]


def test_metric_helpers(spark):
    df = spark.createDataFrame([(float(i), float(i * i), 1.0 if i % 2 else None, 7.0) for i in range(1, 12)], "a double, b double, c double, d double")
    pairs = {(r["a"], r["b"]): r["r"] for r in M.correlation_pairs(df, ["a", "b", "c", "d"]).collect()}
    assert pairs["a", "d"] is None and pairs["a", "c"] is None
    assert M.spearman(df, [("a", "b")]).first()["r"] == pytest.approx(1.0)
    shares, _ = M.explained_variance(df, ["a", "b"])
    assert shares.sum() == pytest.approx(1.0)
    assert M.components_needed([0.5, 0.8, 1.0], 0.8) == 2
