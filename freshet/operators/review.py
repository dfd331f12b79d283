"""The review of a dataset in one go: what can be summed is observed while it is written, what has to be grouped is grouped once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from freshet.operators.ranks import percentiles
from freshet.session import settled


@dataclass(frozen=True)
class Review:
    """Sums of the pass that wrote the dataset, and how often each column has each value (column, value, n)."""

    sums: Mapping[str, float | None]
    values: DataFrame
    dtypes: Mapping[str, str]
    targets: tuple[str, ...]
    keys: tuple[str, ...]

    def columns(self) -> DataFrame:
        """column, dtype, non_null, missing and unique."""
        rows = self.values.groupBy("column").agg(F.count("value").alias("unique"), F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("non_null"))
        kinds = F.create_map(*[F.lit(x) for pair in self.dtypes.items() for x in pair])
        own = rows.filter(F.col("column").isin(list(self.dtypes)))
        return own.select("column", kinds[F.col("column")].alias("dtype"), "non_null", (F.lit(self.sums["rows"]).cast("long") - F.col("non_null")).alias("missing"), "unique")

    def group_sizes(self, column: str) -> DataFrame:
        """Rows of each value of a column, the largest first."""
        return self.values.filter(F.col("column") == column).select(F.col("value").alias(column), F.col("n").alias("rows")).orderBy(F.desc("rows"), column)

    def duplicates(self) -> DataFrame:
        """Rows beyond the first of each combination of the keys, and combinations with more than one row."""
        of = self.values.filter(F.col("column") == "_keys")
        return of.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"), F.count_if(F.col("n") > 1).alias("repeated_keys"))

    def target_summary(self) -> DataFrame:
        """Counts, moments and extremes as observed, and exact quartiles from the counted values."""
        spark = self.values.sparkSession
        names = ("n", "mean", "std", "least", "most", "positive_rate")
        rows = [(t, *[self.sums[f"{t}.{n}"] for n in names]) for t in self.targets]
        own = spark.createDataFrame(rows, "target string, n long, mean double, std double, least double, most double, positive_rate double")
        counted = self.values.filter(F.col("column").isin(list(self.targets))).select(F.col("column").alias("target"), F.col("value").try_cast("double").alias("x"), "n")
        quartiles = percentiles(counted, "target", "x", (0.25, 0.5, 0.75), weight="n")
        return own.join(quartiles, "target", "left").select("target", "n", "mean", "std", "least", F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75"), "most", "positive_rate")


def review(df: DataFrame, path: str, keys: Sequence[str], targets: Sequence[str]) -> Review:
    """Writes a dataset to a path and reviews it. The dataset is read once; the written table once more, by one grouping that
    serves unique values, group sizes, duplicates of the keys and quartiles alike."""
    seen = Observation("review")
    x = {t: F.col(t).cast("double") for t in targets}
    sums = [F.count(F.lit(1)).alias("rows")]
    for t, v in x.items():
        sums += [F.count(v).alias(f"{t}.n"), F.avg(v).alias(f"{t}.mean"), F.when(F.count(v) == 1, 0.0).otherwise(F.stddev_samp(v)).alias(f"{t}.std"), F.min(v).alias(f"{t}.least"), F.max(v).alias(f"{t}.most"), F.avg((v > 0).cast("double")).alias(f"{t}.positive_rate")]
    df.observe(seen, *sums).write.parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    whole = F.to_json(F.array(*[F.col(k).cast("string") for k in keys]), {"ignoreNullFields": "false"})
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in df.columns]
    long = written.select(F.explode(F.array(*cells, F.struct(F.lit("_keys").alias("column"), whole.alias("value")))).alias("c")).select("c.*")
    values = settled(long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))
    return Review(seen.get, values, dict(df.dtypes), tuple(targets), tuple(keys))
