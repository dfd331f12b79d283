"""Regressions on prepared features: pipelines, evaluation by groups left out, ablation, saved artifacts and promotion."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass
from functools import reduce

import numpy as np
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.operators import metrics as M
from freshet.operators.kernels import FourierFeatures
from freshet.operators.models import Preparation
from freshet.operators.validation import RuleError
from freshet.session import settled, small_side

_COLUMNS = {"featuresCol": "features", "labelCol": "_target"}

#: Each entry makes an estimator that hasn't been fit.
REGRESSORS: dict[str, Callable[[], Estimator]] = {
    "least_squares": lambda: LinearRegression(solver="normal", **_COLUMNS),
    "ridge": lambda: LinearRegression(regParam=0.1, elasticNetParam=0.0, **_COLUMNS),
    "lasso": lambda: LinearRegression(regParam=0.1, elasticNetParam=1.0, **_COLUMNS),
    "svr": lambda: Pipeline(stages=[FourierFeatures(inputCol="features", outputCol="kernel"), LinearRegression(regParam=0.001, featuresCol="kernel", labelCol="_target")]),
    "boosted_trees": lambda: GBTRegressor(maxIter=20, seed=42, **_COLUMNS),
}


def pca_components(n_features: int, wanted: int) -> int:
    """At least one component, at most one a feature."""
    return max(1, min(n_features, wanted))


@dataclass(frozen=True)
class Regression:
    """A fitted pipeline, what its features were prepared with, and the name of its target."""

    preparation: Preparation
    model: PipelineModel
    target: str

    def predict(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """keep as it was, and prediction."""
        ready = self.preparation.apply(df.select(F.struct(*keep).alias("_keep"), *self.preparation.columns))
        return self.model.transform(ready).select("_keep.*", "prediction")


def fit_regression(train: DataFrame, features: Sequence[str], target: str, estimator: Callable[[], Estimator], components: int | None = None) -> Regression:
    """Medians for missing values, standard scales, principal components if asked for, then the estimator; all of it is
    fit on the rows given, those without a target left out."""
    rows = train.select(*features, F.col(target).cast("double").alias("_target")).filter("_target IS NOT NULL")
    prep = Preparation.fit(rows, features, scaled=True)
    stages = [VectorAssembler(inputCols=list(features), outputCol="vector" if components else "features")]
    if components:
        stages.append(PCA(k=pca_components(len(features), components), inputCol="vector", outputCol="features"))
    return Regression(prep, Pipeline(stages=[*stages, estimator()]).fit(prep.apply(rows)), target)


def group_moments(rows: DataFrame, by: str, columns: Sequence[str]) -> dict:
    """For each group: rows, means and sums of centred products of the columns, from one pass; a row a group."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    x = [F.col(c).cast("double") for c in columns]
    got = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.avg(c) for c in x]).alias("m"), F.array(*[F.covar_pop(x[i], x[j]) for i, j in pairs]).alias("c")).collect()
    out = {}
    for r in got:
        products = np.zeros((len(columns), len(columns)))
        for (i, j), v in zip(pairs, r["c"], strict=True):
            products[i, j] = products[j, i] = v * r["n"]
        out[r[by]] = (r["n"], np.array(r["m"]), products)
    return out


def left_out_fits(moments: Mapping, components: int | None = None) -> dict:
    """For each group, intercept and coefficients of least squares on all other groups (the last column is the target): the
    moments of all, without its own. With components, the fit is on the leading ones of the standardised features."""
    n = sum(m[0] for m in moments.values())
    mean = sum(m[0] * m[1] for m in moments.values()) / n
    whole = sum(c + k * np.outer(m - mean, m - mean) for k, m, c in moments.values())
    out = {}
    for group, (k, m, c) in moments.items():
        rest = n - k
        centre = (n * mean - k * m) / rest
        # of the others, about their own mean: all products about the mean of all, without the group's, moved to that mean
        products = whole - c - k * np.outer(m - mean, m - mean) - rest * np.outer(centre - mean, centre - mean)
        xx, xy = products[:-1, :-1], products[:-1, -1]
        if components:
            scale = np.sqrt(np.diag(xx) / rest)
            scale[scale == 0] = 1.0
            values, vectors = np.linalg.eigh(xx / np.outer(scale, scale))
            basis = vectors[:, ::-1][:, : pca_components(len(scale), components)] / scale[:, None]
            slopes = basis @ np.linalg.lstsq(basis.T @ xx @ basis, basis.T @ xy, rcond=None)[0]
        else:
            slopes = np.linalg.lstsq(xx, xy, rcond=None)[0]
        out[group] = (float(centre[-1] - slopes @ centre[:-1]), [float(v) for v in slopes])
    return out


def left_out_predictions(rows: DataFrame, by: str, features: Sequence[str], target: str, components: int | None = None) -> DataFrame:
    """by, target and prediction of every row by least squares on the other groups. Two scans whatever the number of groups:
    one of moments, one that scores each row by its group's coefficients. Features and target mustn't be missing."""
    moments = group_moments(rows, by, [*features, target])
    if len(moments) < 2:
        raise RuleError(f"{by} has fewer than two groups")
    fits = [(g, a, b) for g, (a, b) in left_out_fits(moments, components).items()]
    kind = rows.schema[by].dataType.simpleString()
    table = rows.sparkSession.createDataFrame(fits, f"_group {kind}, _a double, _b array<double>")
    line = reduce(lambda s, k: s + F.col("_b")[k] * F.col(features[k]).cast("double"), range(len(features)), F.col("_a"))
    # a row a group, which the driver made: broadcast, as a shuffle by group would put a whole group's rows in one task
    return rows.join(F.broadcast(table), F.col(by).eqNullSafe(F.col("_group"))).select(by, target, line.alias("prediction"))


def evaluated(samples: DataFrame, by: str, features: Sequence[str], target: str, estimators: Mapping[str, Callable[[], Estimator]], components: int | None = None) -> DataFrame:
    """model, the group left out, and the scores of `metrics.regression` on it by a model of the other groups; fewer than two
    groups are an error. Least squares on complete rows comes from moments; for any other model the groups are protocols'
    folds, a handful, and each is a fit."""
    rows = samples.select(*dict.fromkeys([by, target, *features])).filter(F.col(target).isNotNull())
    exact = [n for n, e in estimators.items() if e is REGRESSORS["least_squares"]]
    if exact and rows.filter(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in features])).isEmpty():
        scores = M.regression(left_out_predictions(rows, by, features, target, components), target, "prediction", [by])
        named = reduce(DataFrame.unionByName, [scores.select(F.lit(n).alias("model"), *scores.columns) for n in exact])
        others = {n: e for n, e in estimators.items() if n not in exact}
        return named.unionByName(evaluated(samples, by, features, target, others, components)) if others else named
    rows = settled(rows)
    groups = [r[0] for r in rows.select(by).distinct().orderBy(by).collect()]
    if len(groups) < 2:
        raise RuleError(f"{by} has fewer than two groups")
    parts = []
    for name, estimator in estimators.items():
        for g in groups:
            inside = F.col(by).eqNullSafe(F.lit(g))
            fitted = fit_regression(rows.filter(~inside), features, target, estimator, components)
            parts.append(fitted.predict(rows.filter(inside), [by, target]).withColumn("model", F.lit(name)))
    return M.regression(reduce(DataFrame.unionByName, parts), target, "prediction", ["model", by])


def ranked_models(scores: DataFrame) -> DataFrame:
    """Mean scores of each model over its folds, the smallest error first."""
    return scores.groupBy("model").agg(*[F.avg(c).alias(c) for c in ("rmse", "mae", "r2")], F.count(F.lit(1)).alias("folds")).orderBy("rmse", "model")


def ablation(samples: DataFrame, by: str, features: Sequence[str], dropped: Sequence[str], target: str, estimator: Callable[[], Estimator]) -> DataFrame:
    """For each group left out: the error with all features, without those dropped, and what dropping them adds."""
    less = [c for c in features if c not in set(dropped)]
    full, reduced = (evaluated(samples, by, fs, target, {"m": estimator}).select(by, F.col("rmse").alias(f"{tag}_rmse")) for tag, fs in (("full", features), ("reduced", less)))
    return full.join(reduced, by).withColumn("added", F.col("reduced_rmse") - F.col("full_rmse"))


def network_predictions(fitted: Regression, nodes: DataFrame, factors: DataFrame, base: str, key: str = "node_id", factor: str = "factor_mult") -> DataFrame:
    """key, factor and the predicted value (at least 0) of every node at every factor; a factor scales the node's base.
    Factors are a range of a few dozen rows."""
    rows = nodes.join(small_side(factors.select(factor))).withColumn(base, F.col(base) * F.col(factor))
    return fitted.predict(rows, [key, factor]).select(key, factor, F.greatest("prediction", F.lit(0.0)).alias("predicted"))


def save(fitted: Regression, path: str, spark: SparkSession, **facts) -> dict:
    """Writes the pipeline and a manifest of its target, preparation and facts; gives the manifest."""
    manifest = {**facts, "target": fitted.target, "preparation": asdict(fitted.preparation)}
    fitted.model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return manifest


def load(spark: SparkSession, path: str, target: str) -> tuple[Regression, dict]:
    """What `save` wrote; an artifact of another target is an error."""
    manifest = json.loads(spark.read.text(f"{path}/manifest", wholetext=True).first()[0])
    if manifest["target"] != target:
        raise RuleError(f"the artifact predicts {manifest['target']}, not {target}")
    prep = Preparation(**{k: tuple(v) for k, v in manifest["preparation"].items()})
    return Regression(prep, PipelineModel.load(f"{path}/model"), target), manifest


def promote(spark: SparkSession, candidate: str, place: str, target: str, **record) -> dict:
    """Copies a candidate's artifact to its place of use, with a record of the promotion in the manifest."""
    fitted, manifest = load(spark, candidate, target)
    facts = {k: v for k, v in manifest.items() if k not in ("target", "preparation")}
    return save(fitted, place, spark, **facts, promoted_from=candidate, **record)
