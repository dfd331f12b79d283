"""Two-stage cascades (flood classifier, then log-volume regressor of flooded nodes) with pyspark.ml."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.operators.kernels import FourierFeatures
from freshet.operators.metrics import medians as exact_medians
from freshet.operators.perceptron import Network
from freshet.session import new_folder, remove


@dataclass(frozen=True)
class Family:
    """A kind of model: how its classifier and regressor are made, and whether features are scaled for it."""

    name: str
    classifier: Callable[[], Estimator]
    regressor: Callable[[], Estimator]
    scaled: bool = False


def _of(kind: type, **options) -> Callable[[], Estimator]:
    return lambda: kind(featuresCol="features", **options)


def _kernel(kind: type, **options) -> Callable[[], Estimator]:
    """A linear machine over random Fourier features: a Gaussian kernel's machine."""
    return lambda: Pipeline(stages=[FourierFeatures(inputCol="features", outputCol="kernel"), kind(featuresCol="kernel", **options)])


def _network(**options) -> Callable[[], Estimator]:
    return lambda: Network(featuresCol="features", **options)


#: Boosted trees and forests, linear models, kernel machines (squared errors where others use an insensitive band) and
#: perceptrons.
FAMILIES = {
    f.name: f
    for f in (
        Family("boosted_trees", _of(GBTClassifier, labelCol="label", weightCol="weight", maxIter=20, seed=42), _of(GBTRegressor, labelCol="target", maxIter=20, seed=42)),
        Family("random_forest", _of(RandomForestClassifier, labelCol="label", weightCol="weight", numTrees=30, seed=42), _of(RandomForestRegressor, labelCol="target", numTrees=30, seed=42)),
        Family("linear", _of(LogisticRegression, labelCol="label", weightCol="weight"), _of(LinearRegression, labelCol="target", regParam=0.1), scaled=True),
        Family("svm", _kernel(LinearSVC, labelCol="label", weightCol="weight", regParam=0.001), _kernel(LinearRegression, labelCol="target", regParam=0.001), scaled=True),
        Family("mlp", _network(labelCol="label", weightCol="weight"), _network(labelCol="target", classify=False), scaled=True),
    )
}


@dataclass(frozen=True)
class Preparation:
    """Exact medians, means and population deviations of training rows; applied to any rows, so nothing leaks."""

    columns: tuple[str, ...]
    medians: tuple[float, ...]
    means: tuple[float, ...]
    deviations: tuple[float, ...]

    @staticmethod
    def fit(train: DataFrame, columns: Sequence[str], scaled: bool) -> Preparation:
        found = exact_medians(train, columns)
        medians = tuple(found.get(c, 0.0) for c in columns)
        if not scaled:
            return Preparation(tuple(columns), medians, (0.0,) * len(medians), (1.0,) * len(medians))
        filled = [F.coalesce(F.col(c).cast("double"), F.lit(x)) for c, x in zip(columns, medians, strict=True)]
        s = train.agg(*[f for k, x in enumerate(filled) for f in (F.avg(x).alias(f"m{k}"), F.stddev_pop(x).alias(f"s{k}"))]).first()
        return Preparation(tuple(columns), medians, tuple(float(s[f"m{k}"] or 0.0) for k in range(len(columns))), tuple(float(s[f"s{k}"] or 1.0) or 1.0 for k in range(len(columns))))

    def apply(self, df: DataFrame) -> DataFrame:
        parts = zip(self.columns, self.medians, self.means, self.deviations, strict=True)
        return df.withColumns({c: (F.coalesce(F.col(c).cast("double"), F.lit(x)) - m) / s for c, x, m, s in parts})


@dataclass(frozen=True)
class Cascade:
    preparation: Preparation
    classifier: PipelineModel
    regressor: PipelineModel | None

    def predict(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """keep, prob, inunda_pred, vol_pred (0 where no flood is predicted)."""
        ready = self.preparation.apply(df.select(*keep, *[F.col(c).alias(c) for c in self.preparation.columns if c not in keep]))
        scored = self.classifier.transform(ready)
        if "probability" in scored.columns:
            prob = vector_to_array("probability")[1]
        else:
            prob = 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1]))
        scored = scored.withColumn("prob", prob).withColumn("inunda_pred", (F.col("prob") >= 0.5).cast("int")).drop("features", "kernel", "prediction", "rawPrediction", "probability")
        raw = self.regressor.transform(scored).withColumn("_raw", F.greatest(F.expm1("prediction"), F.lit(0.0))) if self.regressor else scored.withColumn("_raw", F.lit(0.0))
        return raw.select(*keep, "prob", "inunda_pred", F.col("_raw").alias("vol_raw"), F.when(F.col("inunda_pred") == 1, F.col("_raw")).otherwise(0.0).alias("vol_pred"))


def without_summaries(spark: SparkSession, fitted: PipelineModel) -> PipelineModel:
    """The pipeline with the summaries of its training left behind, by writing and reading the models that have one. A
    classifier's summary holds the session, which can't be sent to tasks once it has observed metrics (as a review does)."""
    stages = []
    for stage in fitted.stages:
        if isinstance(stage, PipelineModel):
            stage = without_summaries(spark, stage)
        elif getattr(stage, "hasSummary", False):
            path = new_folder(spark, "model")
            try:
                stage.save(path)
                stage = type(stage).load(path)
            finally:
                remove(spark, path)
        stages.append(stage)
    return PipelineModel(stages)


def fit_cascade(train: DataFrame, features: Sequence[str], family: Family, label: str = "inunda", volume: str = "vol") -> Cascade:
    """Preparation, classifier and regressor of the rows given. They are looked at a dozen times, so what is needed of them
    is written once to the shared folder, and removed when the models are there."""
    spark = train.sparkSession
    path = new_folder(spark, "training")
    try:
        doubles = [F.col(c).cast("double").alias(c) for c in features]
        train.select(*doubles, F.col(label).cast("double").alias("label"), F.col(volume).cast("double").alias("_v")).write.parquet(path)
        rows = spark.read.parquet(path)
        prep = Preparation.fit(rows, features, family.scaled)
        counts = rows.agg(F.count_if(F.col("label") == 0).alias("neg"), F.count_if(F.col("label") == 1).alias("pos")).first()
        weight = counts["neg"] / counts["pos"] if counts["pos"] else 1.0
        ready = prep.apply(rows).withColumn("weight", F.when(F.col("label") == 1, weight).otherwise(1.0))
        vector = VectorAssembler(inputCols=list(features), outputCol="features")
        fitted = lambda estimator, df: without_summaries(spark, Pipeline(stages=[vector, estimator()]).fit(df))
        classifier = fitted(family.classifier, ready)
        regressor = fitted(family.regressor, ready.filter("label = 1").withColumn("target", F.log1p("_v"))) if counts["pos"] else None
    finally:
        remove(spark, path)
    return Cascade(prep, classifier, regressor)


def out_of_fold(samples: DataFrame, folds: DataFrame, features: Sequence[str], family: Family, key: str = "sample_idx") -> DataFrame:
    """Predictions of every sample by the model of the fold that tests it: protocol, fold_id and `predict`'s columns."""
    out = None
    for protocol, fold in sorted((r["protocol"], r["fold_id"]) for r in folds.select("protocol", "fold_id").distinct().collect()):  # a handful of folds, one fit each
        mine = folds.filter((F.col("protocol") == protocol) & (F.col("fold_id") == fold))
        part = lambda side: samples.join(mine.filter(F.col("split") == side).select(key), key, "left_semi")  # noqa: B023, E731
        got = fit_cascade(part("train"), features, family).predict(part("test"), [key]).select(F.lit(protocol).alias("protocol"), F.lit(fold).alias("fold_id"), key, "prob", "inunda_pred", "vol_raw", "vol_pred")
        out = got if out is None else out.unionByName(got)
    return out


def importances(cascade: Cascade) -> list[tuple[str, float]]:
    """Features of a tree classifier by falling importance."""
    values = cascade.classifier.stages[-1].featureImportances.toArray().tolist()
    return sorted(zip(cascade.preparation.columns, values, strict=True), key=lambda x: (-x[1], x[0]))
