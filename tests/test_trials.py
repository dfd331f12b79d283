"""Regressions: components, rankings, saved artifacts and their guards."""

import pytest
from pyspark.sql import functions as F

from freshet.operators import relations as R
from freshet.operators import trials as L
from freshet.operators import validation as V


@pytest.fixture(scope="module")
def rows(spark):
    k = F.col("id").cast("double")
    a, b = (k * 7) % 11, (k * 5) % 13
    return spark.range(90).select("id", (F.col("id") % 3).alias("fold"), F.when(F.col("id") != 4, a).alias("a"), b.alias("b"), (3 * a - 2 * b + 1).alias("y")).cache()


def test_components_are_bounded():
    assert [L.pca_components(n, 5) for n in (0, 1, 3, 9)] == [1, 1, 3, 5]


def test_exact_plane_is_found(rows):
    clean = rows.filter("a IS NOT NULL")
    fitted = L.fit_regression(clean, ["a", "b"], "y", L.REGRESSORS["least_squares"])
    got = fitted.predict(clean, ["id", "a", "y"]).collect()
    assert all(r["prediction"] == pytest.approx(r["y"]) for r in got)
    assert {r["id"]: r["a"] for r in got} == {r["id"]: r["a"] for r in clean.collect()}


def test_missing_features_and_targets(rows):
    odd = rows.withColumn("y", F.when(F.col("id") != 5, F.col("y")))
    fitted = L.fit_regression(odd, ["a", "b"], "y", L.REGRESSORS["ridge"], components=1)
    assert fitted.predict(odd, ["id"]).filter("prediction IS NULL").count() == 0
    assert fitted.predict(odd.limit(0), ["id"]).count() == 0


def test_ranking(rows):
    scores = L.evaluated(rows, "fold", ["a", "b"], "y", {n: L.REGRESSORS[n] for n in ("least_squares", "lasso")})
    assert scores.count() == 6 and scores.agg(F.sum("n")).first()[0] == 180
    ranked = L.ranked_models(scores).collect()
    assert ranked[0]["rmse"] <= ranked[1]["rmse"] and all(r["folds"] == 3 for r in ranked)


def test_one_group_is_an_error(rows):
    with pytest.raises(V.RuleError):
        L.evaluated(rows.withColumn("fold", F.lit(1)), "fold", ["a"], "y", {})


def test_saved_and_promoted(spark, rows, tmp_path):
    fitted = L.fit_regression(rows, ["a", "b"], "y", L.REGRESSORS["least_squares"])
    L.save(fitted, f"{tmp_path}/one", spark, family="least_squares")
    record = L.promote(spark, f"{tmp_path}/one", f"{tmp_path}/two", "y", ranking_id=7)
    again, manifest = L.load(spark, f"{tmp_path}/two", "y")
    assert record == {**manifest, "preparation": record["preparation"]} and manifest["ranking_id"] == 7 and manifest["family"] == "least_squares"
    assert again.preparation == fitted.preparation
    assert again.predict(rows, ["id"]).exceptAll(fitted.predict(rows, ["id"])).count() == 0
    with pytest.raises(V.RuleError):
        L.load(spark, f"{tmp_path}/two", "other")


def test_reset_keeps_the_rest(spark):
    tables = {"runs": spark.createDataFrame([(1,), (2,), (None,)], "k int"), "none": spark.createDataFrame([], "k int")}
    kept, counts = R.split_off(tables, spark.createDataFrame([(2,), (2,)], "k int"), "k")
    assert [tuple(r) for r in counts.orderBy("table").collect()] == [("none", 0, 0), ("runs", 1, 2)]
    assert sorted((r["k"] for r in kept["runs"].collect()), key=str) == [1, None]


def test_guards_of_nothing(spark):
    schema = "network_id int, flow_units string, ponding boolean, content string, expected_md5 string, overridden boolean"
    assert V.base_guards(spark.createDataFrame([], schema)).count() == 0
    bare = V.base_guards(spark.createDataFrame([(1, None, None, None, None, None)], schema)).collect()
    assert [(r["level"], r["rule"]) for r in bare] == [("error", "flow_units")]
