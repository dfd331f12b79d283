"""Rank correlations, batches, splits, components, kernel machines, perceptrons, scored windows and left-out fits."""

import random
from itertools import combinations
from math import ceil, sqrt

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from freshet.operators import batches, components, folds, metrics, models, ordinal, perceptron, ranks, scoring, trials
from freshet.operators.kernels import FourierFeatures, draw


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 9), max_size=60), st.randoms())
def test_inversions(weights, rng):
    order = list(range(len(weights)))
    rng.shuffle(order)
    want = sum(weights[i] * weights[j] for i, j in combinations(range(len(order)), 2) if order[i] > order[j])
    assert ordinal.inversions(np.array(order, np.int64), np.array(weights, np.int64)) == want


def test_inversions_of_huge_weights():
    assert ordinal.inversions(np.array([1, 0]), np.array([2**40, 2**41])) == 2**81


def tau(rows):
    both = [(x, y) for x, y in rows if x is not None and y is not None]
    sign = lambda v: (v > 0) - (v < 0)
    s = sum(sign(a[0] - b[0]) * sign(a[1] - b[1]) for a, b in combinations(both, 2))
    x = sum(a[0] != b[0] for a, b in combinations(both, 2))
    y = sum(a[1] != b[1] for a, b in combinations(both, 2))
    return s / sqrt(x * y) if x and y else None


@pytest.mark.parametrize("kind", ["spread", "hot_x", "hot_y", "few", "constant", "empty", "same"])
def test_kendall(spark, kind):
    rng = random.Random(kind)
    rows = [(rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(300)]
    if kind == "hot_x":
        rows = [(0.5 if k % 3 else x, y) for k, (x, y) in enumerate(rows)]
    if kind == "hot_y":
        rows = [(x, -1.0 if k % 3 else y) for k, (x, y) in enumerate(rows)]
    if kind == "few":
        rows = [(float(rng.randint(0, 3)), float(rng.randint(0, 2))) for _ in rows] + [(None, 1.0), (1.0, None)]
    rows = {"constant": [(1.0, y) for _, y in rows], "empty": [(None, 2.0)], "same": [(x, x) for x, _ in rows]}.get(kind, rows)
    got = ordinal.kendall(spark.createDataFrame(rows, "a double, b double").repartition(5), [("a", "b")]).first()["r"]
    want = tau(rows)
    assert got is want if want is None else got == pytest.approx(want, abs=1e-12)


def test_kendall_makes_no_pairs(spark):
    frame = spark.range(50).select(F.col("id").cast("double").alias("x"), (F.col("id") * 7 % 11).cast("double").alias("y"), F.lit(1).alias("n"))
    plan = frame.withColumn("p", ranks.part_of(frame, ["x", "y"], ranks.bounds(frame, ["x", "y"], 4)))._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    with pytest.raises(ValueError, match="pearson"):
        metrics.correlations(frame, ["x", "y"], "cosine")


def test_parts_of_an_order(spark):
    rows = [(v, k) for k, v in enumerate([None, float("nan"), -1.0, 2.0, 2.0, 7.5, 1e9, float("inf")])]
    frame = spark.createDataFrame(rows, "v double, k int")
    cuts = [(None,), (-1.0,), (2.0,), (7.5,), (float("nan"),)]
    got = {r["k"]: r["p"] for r in frame.withColumn("p", ranks.part_of(frame, ["v"], cuts)).collect()}
    assert got == {0: 1, 1: 5, 2: 2, 3: 3, 4: 3, 5: 4, 6: 4, 7: 4}


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums(spark, descending):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(40)]), rng.randint(1, 5)) for _ in range(500)]
    distinct = list({(k, v): (k, v, n) for k, v, n in rows}.values())
    got = ranks.before_each(spark.createDataFrame(distinct, "k string, v int, n int"), ["k"], ["v"], ["v"] if descending else [], True, below="n").collect()
    level = lambda v: -1 if v is None else v
    for r in got:
        same = [d for d in distinct if d[0] == r["k"]]
        before = [d for d in same if (level(d[1]) > level(r["v"]) if descending else level(d[1]) < level(r["v"]))]
        assert r["below"] == sum(d[2] for d in before) and r["total_below"] == sum(d[2] for d in same)
    assert len(got) == len(distinct)


def test_one_shuffle_of_the_rows(spark, data):
    lines = spark.read.parquet(f"{data}/lineitem.parquet").select("l_linenumber", "l_extendedprice")
    got = ranks.before_each(lines, ["l_linenumber"], ["l_extendedprice"], below="l_extendedprice")
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("REPARTITION_BY_COL") == 1 and "Scan ExistingRDD" not in plan
    below = [x for x in plan.splitlines() if "Exchange" in x and "REPARTITION" not in x]
    assert len(below) <= 3 and "partial_sum" in plan  # sums of parts only


@pytest.mark.parametrize("cells", [1, 7, 20, 1000])
def test_batches(spark, cells):
    rng = random.Random(cells)
    sizes = [(f"k{k}", rng.randint(1, 9)) for k in range(60)]
    got = batches.batch_plan(spark.createDataFrame(sizes, "k string, length int"), ["k"], cells).collect()
    want, at = {}, 0
    ordered = sorted(sizes, key=lambda s: (-s[1], s[0]))
    while at < len(ordered):
        size = max(1, cells // ordered[at][1])
        want |= {k: (at, ordered[at][1]) for k, _ in ordered[at : at + size]}
        at += size
    starts = sorted({a for a, _ in want.values()})
    assert {r["k"]: (starts[r["batch"]], r["pad_to"]) for r in got} == want
    for b in {r["batch"] for r in got}:
        mine = [r for r in got if r["batch"] == b]
        assert len(mine) == 1 or len(mine) * mine[0]["pad_to"] <= cells


def test_batched_rows(spark):
    rows = spark.createDataFrame([(k, p, float(k)) for k, n in ((1, 4), (2, 2), (3, 1)) for p in range(n)], "k int, position int, x double")
    plan = batches.batch_plan(rows.groupBy("k").agg(F.count(F.lit(1)).alias("length")), ["k"], 6)
    got = sorted((r["batch"], r["k"], r["position"], r["x"], r["padding"]) for r in batches.batched_rows(rows, plan, ["k"], "position", ["x"]).collect())
    assert got == [(0, 1, p, 1.0, False) for p in range(4)] + [(1, 2, 0, 2.0, False), (1, 2, 1, 2.0, False), (1, 3, 0, 3.0, False), (1, 3, 1, 0.0, True)]


@pytest.mark.parametrize("share", [0.2, 0.5, 0.01])
def test_grouped_split_is_exact(spark, share):
    df = spark.range(900).select((F.col("id") % 137).alias("g"), "id")
    got = folds.grouped_split(df, "g", share)
    sides = got.groupBy("g").agg(F.collect_set("split").alias("s")).collect()
    assert all(len(r["s"]) == 1 for r in sides) and sum(r["s"] == ["test"] for r in sides) == ceil(share * 137)
    again = folds.grouped_split(df.repartition(7), "g", share)
    assert again.exceptAll(got).isEmpty() and not folds.grouped_split(df, "g", share, seed=1).exceptAll(got).isEmpty()


def test_grouped_split_needs_both_sides(spark):
    with pytest.raises(ValueError, match="empty"):
        folds.grouped_split(spark.range(1).withColumn("g", F.lit(None).cast("string")), "g")


def test_components_are_what_they_claim(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((200, 3)) @ np.array([[1, 0.6, 0], [0, 1, 0.3], [0, 0, 1]])
    rows = [(k, *(None if k % 17 == i else float(v) for i, v in enumerate(r)), 5.0) for k, r in enumerate(x)]
    df = spark.createDataFrame(rows, "k int, a double, b double, c double, constant double")
    found = components.fit_components(df, ["a", "b", "c", "constant"])
    projected = found.project(df, ["k"]).toPandas().set_index("k").sort_index().to_numpy()
    assert np.allclose(found.loadings.T @ found.loadings, np.eye(4)) and found.variances.sum() == pytest.approx(3)
    assert np.allclose(projected.mean(axis=0), 0) and np.allclose(np.cov(projected.T, ddof=0), np.diag(found.variances), atol=1e-12)
    filled = np.array([[np.median([r[i + 1] for r in rows if r[i + 1] is not None]) if v is None else v for i, v in enumerate(r[1:4])] for r in rows])
    scaled = (filled - filled.mean(axis=0)) / filled.std(axis=0)
    assert np.allclose(found.variances[:3], np.linalg.eigvalsh(scaled.T @ scaled / 200)[::-1])
    assert found.variance_table(df).orderBy("component").first()["eigenvalue"] == pytest.approx(found.variances[0] * 200 / 199)
    assert "PC1 explains" in components.interpretation(found) and found.summary()["components_for_95pct_variance"] <= 3


def ring(spark, n=400):
    """Two classes that no line separates."""
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, (n, 2))
    return spark.createDataFrame([(k, float(a), float(b), int(a * b > 0), float(10 * abs(a * b)) if a * b > 0 else 0.0, k % 3) for k, (a, b) in enumerate(x)], "sample_idx long, a double, b double, inunda int, vol double, fold_id int")


def test_fourier_features_approximate_the_kernel(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((30, 3))
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "k int, v array<double>").withColumn("features", array_to_vector("v"))
    mapped = FourierFeatures(inputCol="features", outputCol="kernel", dimensions=2000, gamma=0.4)
    z = np.array([r["z"] for r in mapped.transform(df).select(vector_to_array("kernel").alias("z"), "k").orderBy("k").collect()])
    kernel = np.exp(-0.4 * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert np.abs(z @ z.T - kernel).max() < 5 / np.sqrt(2000)
    w, b = draw(2000, 3, 0.4, 42)
    assert np.allclose(z, np.sqrt(2 / 2000) * np.cos(x @ w.T + b))


@pytest.mark.parametrize("family", ["svm", "mlp"])
def test_families_separate_what_no_line_does(spark, family):
    samples = ring(spark).cache()
    cascade = models.fit_cascade(samples.filter("fold_id > 0"), ["a", "b"], models.FAMILIES[family])
    held = cascade.predict(samples.filter("fold_id = 0"), ["sample_idx", "inunda", "vol"])
    right = held.agg(F.avg((F.col("inunda") == F.col("inunda_pred")).cast("double"))).first()[0]
    linear = models.fit_cascade(samples.filter("fold_id > 0"), ["a", "b"], models.FAMILIES["linear"]).predict(samples.filter("fold_id = 0"), ["inunda"])
    assert right > 0.85 > 0.7 > linear.agg(F.avg((F.col("inunda") == F.col("inunda_pred")).cast("double"))).first()[0]
    assert held.filter("prob < 0 OR prob > 1 OR vol_pred < 0 OR vol_pred IS NULL").isEmpty()


@pytest.mark.parametrize("classify", [True, False])
def test_gradients_against_differences(classify):
    rng = np.random.default_rng(5)
    layout = perceptron.shapes(3, (4, 2))
    flat = perceptron.start(layout, 1) + 0.1 * rng.standard_normal(sum(a * b + b for a, b in layout))
    x, y, w = rng.standard_normal((20, 3)), rng.integers(0, 2, 20).astype(float), rng.uniform(0.5, 3, 20)
    got = perceptron.loss_and_gradient(flat, layout, x, y, w, classify)[1:]
    for k in range(len(flat)):
        step = np.zeros_like(flat)
        step[k] = 1e-6
        up, down = (perceptron.loss_and_gradient(flat + s * step, layout, x, y, w, classify)[0] for s in (1, -1))
        assert got[k] == pytest.approx((up - down) / 2e-6, rel=1e-4, abs=1e-6)


def test_networks_do_not_depend_on_partitions(spark):
    df = ring(spark, 120).withColumn("features", array_to_vector(F.array("a", "b"))).withColumn("weight", F.when(F.col("inunda") == 1, 4.0).otherwise(1.0))
    one, two = (perceptron.Network(labelCol="inunda", weightCol="weight", maxIter=8).fit(df.repartition(n)) for n in (1, 6))
    plain = perceptron.Network(labelCol="inunda", maxIter=8).fit(df.repartition(1))
    assert np.allclose(one.flat, two.flat, atol=1e-6) and not np.allclose(one.flat, plain.flat, atol=1e-3)
    positives = lambda m: m.transform(df).filter("prediction = 1").count()
    assert positives(one) >= positives(plain)


def test_networks_of_nothing(spark):
    df = spark.createDataFrame([], "a double, label double").withColumn("features", array_to_vector(F.array("a")))
    assert np.isfinite(perceptron.Network(maxIter=2).fit(df).flat).all()


def test_scored_windows(spark):
    rows = [(1, 0, [[1.0, 2.0], [3.0, 4.0]], 10.0), (1, 1, [[0.0, 1.0]], None), (2, 0, [], 1.0), (3, 0, None, 2.0), (2, 5, [[5.0, 5.0], [1.0, 1.0]], -1.0)]
    frame = spark.createDataFrame(rows, "node_id int, start int, sequence array<array<double>>, area double")
    shift = 0.5
    got = {(r["node_id"], r["start"]): r["score"] for r in scoring.score_windows(frame, lambda s, x: s.sum(axis=(1, 2)) + x[:, 0] + shift, ["node_id", "start"], static=["area"]).collect()}
    assert got == {(1, 0): 20.5, (1, 1): 1.5, (2, 0): None, (3, 0): None, (2, 5): 11.5}


@pytest.mark.parametrize("task", ["classification", "regression"])
def test_node_scores(spark, task):
    scored = spark.createDataFrame([("a", 0.2), ("a", 0.8), ("b", 0.1)], "node_id string, score double")
    actual = spark.createDataFrame([("a", 1), ("b", 0), ("c", 1)], f"node_id string, {scoring.ACTUAL[task]} int")
    got = {r["node_id"]: tuple(r)[1:] for r in scoring.node_scores(scored, actual, task).collect()}
    want = {"a": (0.8, 0.5, 2, 1, 1), "b": (0.1, 0.1, 1, 0, 0), "c": (None, None, 0, 0, 1)}
    assert got == {k: v if task == "classification" else (*v[:3], v[4]) for k, v in want.items()}
    with pytest.raises(ValueError, match="classification.*regression"):
        scoring.output_columns("ranking")


def test_left_out_fits_agree_with_fits(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((90, 2)) + 50
    rows = [("abc"[k % 3], float(a), float(b), float(3 * a - b + rng.normal())) for k, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "g string, a double, b double, y double")
    for wanted in (None, 1, 2):
        for r in trials.left_out_predictions(df, "g", ["a", "b"], "y", wanted).filter("g = 'a'").limit(3).collect():
            train = np.array([row[1:] for row in rows if row[0] != "a"])
            mean, scale = train[:, :2].mean(axis=0), train[:, :2].std(axis=0)
            z = (train[:, :2] - mean) / scale
            basis = np.linalg.eigh(z.T @ z)[1][:, ::-1][:, : wanted or 2]
            slopes = basis @ np.linalg.lstsq(z @ basis, train[:, 2] - train[:, 2].mean(), rcond=None)[0]
            own = next(row for row in rows if row[3] == r["y"])
            assert r["prediction"] == pytest.approx(train[:, 2].mean() + ((np.array(own[1:3]) - mean) / scale) @ slopes)


def test_left_out_fits_with_missing_features(spark):
    df = spark.createDataFrame([("ab"[k % 2], float(k) if k % 5 else None, float(k)) for k in range(40)], "g string, a double, y double")
    got = trials.evaluated(df, "g", ["a"], "y", {"least_squares": trials.REGRESSORS["least_squares"]})
    assert got.count() == 2 and got.filter("rmse IS NULL").isEmpty()
