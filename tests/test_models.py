"""Cascades, preparation without leaks, and out-of-fold predictions."""

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from freshet.operators import folds as D
from freshet.operators import metrics as M
from freshet.operators import models


@pytest.fixture(scope="module")
def samples(spark):
    rows = []
    for factor in (1.0, 1.5, 2.0, 2.5, 3.0):
        for node in range(24):
            x = node / 24
            wet = factor * x > 1.2
            rows.append((node, factor, x if node % 7 else None, wet * 100 * (factor * x - 1), int(wet)))
    df = spark.createDataFrame(rows, "node_id int, factor_mult double, x double, vol double, inunda int")
    return D.sample_index(df, "factor_mult", "node_id").cache()


def test_preparation_uses_exact_medians(spark):
    df = spark.range(60).select(F.col("id").cast("double").alias("a"))
    prep = models.Preparation.fit(df, ["a"], scaled=True)
    assert prep.medians == (29.5,)
    assert prep.deviations[0] == pytest.approx(17.318102282486574)
    assert prep.apply(spark.createDataFrame([(None,)], "a double")).first()["a"] == pytest.approx(0.0)


@pytest.mark.parametrize("family", ["linear", "random_forest"])
def test_out_of_fold(samples, family):
    folds = D.long_form(samples, D.balanced(samples, "factor_mult"), "factor_mult", "GroupKFold")
    oof = models.out_of_fold(samples, folds.filter("fold_id < 2"), ["x", "factor_mult"], models.FAMILIES[family]).cache()
    tested = folds.filter("fold_id < 2 AND split = 'test'")
    assert oof.count() == tested.count() == oof.select("sample_idx").distinct().count()
    scored = oof.join(samples, "sample_idx")
    assert M.end_to_end(scored).first()["accuracy"] > 0.7
    assert scored.filter("inunda_pred = 0 AND vol_pred <> 0").count() == 0


def test_importances(samples):
    cascade = models.fit_cascade(samples, ["x", "factor_mult"], models.FAMILIES["random_forest"])
    got = models.importances(cascade)
    assert {n for n, _ in got} == {"x", "factor_mult"} and got[0][1] >= got[1][1]


@pytest.mark.parametrize("family", list(models.FAMILIES))
def test_cascades_in_a_session_that_has_observed_metrics(spark, samples, family):
    seen = Observation()
    spark.range(5).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get == {"n": 5}
    got = models.fit_cascade(samples, ["x", "factor_mult"], models.FAMILIES[family]).predict(samples, ["sample_idx"])
    assert got.filter("prob IS NOT NULL").count() == samples.count()
