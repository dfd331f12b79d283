"""Grouped summaries: curves, profiles of a table, and reports on its quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from freshet.functions.scalars import ratio
from freshet.operators.ranks import percentiles


def resilience_curve(samples: DataFrame, by: Sequence[str] = ("factor_mult",), flag: str = "inunda") -> DataFrame:
    """Share of nodes that stay dry, for each group."""
    return samples.groupBy(*by).agg(F.avg((F.col(flag) == 0).cast("double")).alias("resilience"), F.count(F.lit(1)).alias("n_nodes"))


def volume_curve(samples: DataFrame, by: Sequence[str], **volumes: Column) -> DataFrame:
    """Sums of named volumes for each group."""
    return samples.groupBy(*by).agg(*[F.sum(v).alias(k) for k, v in volumes.items()])


def group_sizes(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of each group (a NULL key is a group), the largest first."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), *keys)


def group_profile(df: DataFrame, key: str, **distinct: str) -> DataFrame:
    """Rows and distinct values of the named columns, for each key."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), *[F.count_distinct(c).alias(k) for k, c in distinct.items()])


def group_size_range(df: DataFrame, *keys: str) -> DataFrame:
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    return sizes.agg(F.min("rows").alias("least"), F.max("rows").alias("most"), F.avg("rows").alias("mean"))


def distinct_counts(df: DataFrame, *columns: str) -> DataFrame:
    return df.agg(*[F.count_distinct(c).alias(f"n_{c}") for c in columns])


def duplicate_counts(df: DataFrame, *keys: str) -> DataFrame:
    """Rows beyond the first of each key, by one aggregation on the key (no expand, no distinct list)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("rows"), F.sum(F.col("n") - 1).alias("duplicates"))


def repeated_keys(df: DataFrame, keys: Sequence[str], most: int) -> DataFrame:
    """A sample of keys with more than one row: a report of the `most` largest."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").orderBy(F.desc("n"), *keys).limit(most)


def missing_by_column(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column, missing, missing_pct of every column, from one pass."""
    columns = list(columns or df.columns)
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    long = one.unpivot("_n", columns, "column", "missing")
    return long.select("column", "missing", (100 * ratio(F.col("missing"), F.col("_n"))).alias("missing_pct"))


def numeric_missing(df: DataFrame) -> DataFrame:
    """column, missing of the numeric columns and of their `total`; texts and dates aren't looked at."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]
    long = missing_by_column(df, names).select("column", "missing")
    return long.unionByName(long.agg(F.lit("total").alias("column"), F.coalesce(F.sum("missing"), F.lit(0)).alias("missing")))


def column_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column, dtype, non_null and unique of every column, from one scan: values are counted by column first."""
    types = dict(df.dtypes)
    columns = list(columns or df.columns)
    long = df.unpivot([], [F.col(c).cast("string").alias(c) for c in columns], "column", "_v")
    values = long.groupBy("column", "_v").agg(F.count("_v").alias("_n"))
    got = values.groupBy("column").agg(F.sum("_n").alias("non_null"), F.count("_v").alias("unique"))
    kinds = F.create_map(*[F.lit(x) for c in columns for x in (c, types[c])])
    return got.select("column", kinds[F.col("column")].alias("dtype"), "non_null", "unique")


def describe_targets(df: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Mean, sample deviation (0 for a single row), quartiles and share of positive values of each target."""
    long = df.unpivot([], [F.col(t).cast("double").alias(t) for t in targets], "target", "x")
    out = long.groupBy("target").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.coalesce(F.stddev_samp("x"), F.lit(0.0)).alias("std"), F.min("x").alias("least"), F.max("x").alias("most"), F.avg((F.col("x") > 0).cast("double")).alias("positive_rate"))
    out = out.join(percentiles(long, "target", "x", (0.25, 0.5, 0.75)), "target", "left")
    return out.select("target", "n", "mean", "std", "least", F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75"), "most", "positive_rate")


def feature_percentiles(df: DataFrame, features: Sequence[str], at: Sequence[float] = (0.01, 0.25, 0.5, 0.75, 0.99)) -> DataFrame:
    """Least, exact percentiles (linear between ranks) and most of each feature."""
    long = df.unpivot([], [F.col(c).cast("double").alias(c) for c in features], "feature", "x")
    names = [f"p{round(100 * p)}" for p in at]
    out = long.groupBy("feature").agg(F.min("x").alias("least"), F.max("x").alias("most")).join(percentiles(long, "feature", "x", at), "feature", "left")
    return out.select("feature", "least", *[F.col("q")[k].alias(n) for k, n in enumerate(names)], "most")


def quality_report(samples: DataFrame, threshold: float) -> DataFrame:
    """One row: class balance, runs, and how often the stored label disagrees with volume > threshold."""
    flooded = F.col("inunda") == 1
    return samples.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("run_id").alias("n_runs"), F.count_if(flooded).alias("n_flooded"), F.count_if(~flooded).alias("n_dry"),
        F.count_if((F.col("vol") > threshold).cast("int") != F.col("inunda")).alias("disagreements"),
    )


def conditional_counts(df: DataFrame, key: str, **conditions: Column) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(k) for k, c in conditions.items()])


def first_by(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The value with the least order of each key; ties take the least value."""
    return df.groupBy(key).agg(F.min(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))).alias("m")).select(key, F.col("m.v").alias(value))


def largest_or(df: DataFrame, value: str, default: float) -> DataFrame:
    """The largest value; the default where there is none above 0."""
    top = F.max(value)
    return df.agg(F.when(top > 0, top).otherwise(F.lit(default)).alias("largest"))


def run_summary(samples: DataFrame, key: str = "run_id", time: str = "t") -> DataFrame:
    """Totals of each run, the resilience index and the time of the first flood."""
    failed = F.count_if(F.col("vol") > 0)
    total = F.count(F.lit(1))
    return samples.groupBy(key).agg(
        total.alias("total_nodes"), failed.alias("failed_nodes"), F.sum("vol").alias("total_volume"), (100 * failed / total).alias("pct_flooded"),
        F.bround(1 - failed / total, 4).alias("resilience_index"), F.min(F.when(F.col("vol") > 0, F.col(time))).alias("first_flood"),
    )


def scenario_totals(compared: DataFrame, key: str, truth: str, pred: str, flag: str) -> DataFrame:
    """Totals of each scenario, the error and its share of the truth (NULL unless the truth is positive)."""
    t, p = F.sum(truth), F.sum(pred)
    return compared.groupBy(key).agg(t.alias("total_truth"), p.alias("total_pred"), (p - t).alias("error"), F.when(t > 0, 100 * (p - t) / t).alias("error_pct"), F.count_if(F.col(flag)).alias("n_flagged"))


def link_aggregates(edges: DataFrame) -> DataFrame:
    """For every node with a conduit: counts and greatest, least, mean of diameters, and greatest |slope|, up and down."""

    def side(end: str, tag: str) -> DataFrame:
        return edges.groupBy(F.col(end).alias("node_id")).agg(
            F.count(F.lit(1)).alias(f"n_{tag}"), F.max("diameter").alias(f"diameter_max_{tag}"), F.min("diameter").alias(f"diameter_min_{tag}"), F.avg("diameter").alias(f"diameter_avg_{tag}"),
            F.max(F.abs("slope")).alias(f"slope_max_{tag}"), F.sum("capacity").alias(f"capacity_{tag}"),
        )

    both = side("to_node", "in").join(side("from_node", "out"), "node_id", "full_outer")
    return both.fillna(0, ["n_in", "n_out"])


def peaks(series: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """The peak of each key and when it is first reached."""
    top = F.max(F.struct(F.col(value).alias("v"), (-F.col(time)).alias("t")))
    return series.groupBy(key).agg(top.alias("m"), F.max(F.abs(value)).alias("peak_abs")).select(key, F.col("m.v").alias("peak"), (-F.col("m.t")).alias("time_of_peak"), "peak_abs")


def json_map_of_peaks(flows: DataFrame, key: str, name: str, value: str) -> DataFrame:
    """For each key a JSON object of the positive peaks of its names, names in order."""
    best = flows.groupBy(key, name).agg(F.max(value).alias("v")).filter("v > 0")
    packed = F.array_sort(F.collect_list(F.struct(F.col(name).cast("string").alias("key"), F.col("v").alias("value"))))
    return best.groupBy(key).agg(F.to_json(F.map_from_entries(packed)).alias("peaks"))


def window_votes(scored: DataFrame, key: str, probability: str) -> DataFrame:
    p = F.col(probability)
    return scored.groupBy(key).agg(F.max(p).alias("most"), F.avg(p).alias("mean"), F.count(p).alias("windows"), F.count_if(p >= 0.5).alias("votes"))


def not_exactly_one(df: DataFrame, key: str, condition: Column) -> DataFrame:
    """Keys for which the condition doesn't hold in exactly one row."""
    return df.groupBy(key).agg(F.count_if(condition).alias("n")).filter("n <> 1")


def unfinished(series: DataFrame, key: str, order: str, value: str, share: float = 0.01) -> DataFrame:
    """Keys whose last value is above a share of their peak."""
    got = series.groupBy(key).agg(F.max(value).alias("peak"), F.max(F.struct(order, value)).alias("m"))
    return got.select(key, "peak", F.col(f"m.{value}").alias("last")).filter(F.col("last") > share * F.col("peak"))


def plausible_depths(nodes: DataFrame, depth: str, deep: float = 10.0, least_nodes: int = 20, share: float = 0.25) -> DataFrame:
    """Are so many junctions so deep that the unit must be wrong?"""
    d = F.col(depth)
    out = nodes.agg(F.count(d).alias("n"), F.avg((d > deep).cast("double")).alias("deep_share"), F.median(d).alias("median"))
    return out.withColumn("suspicious", (F.col("n") >= least_nodes) & (F.col("deep_share") >= share))


def numeric_range(df: DataFrame, value: str) -> DataFrame:
    x = F.col(value).try_cast("double")
    return df.agg(F.min(x).alias("least"), F.max(x).alias("most"))


def speed_ups(timings: DataFrame, slow: str, fast: str) -> DataFrame:
    return timings.agg(F.sum(slow).alias("total_slow"), F.sum(fast).alias("total_fast"), F.avg(ratio(F.col(slow), F.col(fast))).alias("mean_speed_up"))
