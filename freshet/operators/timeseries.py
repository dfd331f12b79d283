"""Series of nodes over time: grids, filling, windows, interpolation, integration, shapes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered(keys: Sequence[str], *order: str):
    return Window.partitionBy(*keys).orderBy(*order)


def keep_last(series: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The row with the greatest order of each key, by a partial aggregation (no window sort)."""
    rest = [c for c in series.columns if c not in keys and c != order]
    last = F.max(F.struct(order, *rest)).alias("_m")
    return series.groupBy(*keys).agg(last).select(*keys, F.col(f"_m.{order}"), *[F.col(f"_m.{c}") for c in rest])


def forward_fill(series: DataFrame, keys: Sequence[str], time: str, columns: Sequence[str]) -> DataFrame:
    w = ordered(keys, time).rowsBetween(Window.unboundedPreceding, 0)
    return series.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def grid(series: DataFrame, keys: Sequence[str], time: str, step: int) -> DataFrame:
    """The regular times of each key: from its first on, as many steps as fit its span when rounded."""
    span = series.groupBy(*keys).agg(F.min(time).alias("_first"), F.max(time).alias("_last"))
    n = F.bround((F.col("_last") - F.col("_first")) / step).cast("int")
    return span.select(*keys, "_first", F.explode(F.sequence(F.lit(0), n)).alias("_k")).select(*keys, (F.col("_first") + F.col("_k") * step).alias(time))


def resample(series: DataFrame, keys: Sequence[str], time: str, step: int, columns: Sequence[str]) -> DataFrame:
    """Values on the regular grid, filled from the last grid time that has one. Observations off the grid don't count;
    times before the first value of all columns go."""
    on_grid = grid(series, keys, time, step).join(series.select(*keys, time, *columns), [*keys, time], "left")
    return forward_fill(on_grid, keys, time, columns).dropna(subset=list(columns))


def sliding_windows(series: DataFrame, keys: Sequence[str], time: str, features: Sequence[str], target: str, width: int, horizon: int, stride: int) -> DataFrame:
    """Windows of `width` rows with a label from the `horizon` rows behind them; a window starts every `stride` rows where
    both fit. sequence: the rows' features in order; label: any target > 0; y: the greatest target."""
    w = ordered(keys, time)
    ahead = w.rowsBetween(width, width + horizon - 1)
    numbered = series.select(*keys, time, F.array(*[F.col(c).cast("double") for c in features]).alias("_x"), F.col(target).alias("_y"), (F.row_number().over(w) - 1).alias("_i"), F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("_n"))
    framed = numbered.withColumns({"sequence": F.collect_list("_x").over(w.rowsBetween(0, width - 1)), "y": F.max("_y").over(ahead), "_any": F.max((F.col("_y") > 0).cast("int")).over(ahead)})
    kept = framed.filter((F.col("_i") % stride == 0) & (F.col("_i") + width + horizon <= F.col("_n")))
    return kept.select(*keys, F.col(time).alias("start"), "sequence", F.col("_any").alias("label"), "y")


def interpolate(points: DataFrame, at: DataFrame, keys: Sequence[str], time: str, value: str) -> DataFrame:
    """Piecewise linear values at the times of `at`, held before the first and after the last point. Points and times are
    put into one order per key, so no range join is needed."""
    both = points.select(*keys, time, value, F.lit(0).alias("_ask")).unionByName(at.select(*keys, time, F.lit(None).cast("double").alias(value), F.lit(1).alias("_ask")))
    back, ahead = ordered(keys, time, "_ask").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys).orderBy(time, "_ask").rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col("_ask") == 0, F.struct(F.col(time).alias("t"), F.col(value).alias("v")))
    wide = both.withColumns({"_a": F.last(known, ignorenulls=True).over(back), "_b": F.first(known, ignorenulls=True).over(ahead)}).filter("_ask = 1")
    a, b = F.col("_a"), F.col("_b")
    line = F.when(a.isNull(), b["v"]).when(b.isNull() | (a["t"] == F.col(time)), a["v"]).otherwise(a["v"] + (b["v"] - a["v"]) * (F.col(time) - a["t"]) / (b["t"] - a["t"]))
    return wide.select(*keys, time, line.alias(value)).distinct()


def steps_since(keys: Sequence[str], time: str, first: Column | None = None) -> Column:
    """Time since the row before; since `first` (0) for the first."""
    return F.col(time) - F.coalesce(F.lag(time).over(ordered(keys, time)), first if first is not None else F.lit(0.0))


def integrate_m3(series: DataFrame, key: str, time_sec: str, flow_lps: str) -> DataFrame:
    """Volume in cubic metres: each flow holds since the row before (since 0 for the first)."""
    dt = series.withColumn("_dt", steps_since([key], time_sec))
    return dt.groupBy(key).agg(F.coalesce(F.sum(F.when(F.col("_dt") > 0, F.col(flow_lps) * F.col("_dt"))) / 1000, F.lit(0.0)).alias("volume_m3"))


def depth_rate(series: DataFrame, key: str, time: str, depth: str) -> DataFrame:
    """The greatest rise of depth per unit of time, at least 0; the first step's length counts for every step."""
    w = ordered([key], time)
    step = F.min("_dt0").over(Window.partitionBy(key))
    rises = series.withColumns({"_rise": F.col(depth) - F.lag(depth).over(w), "_n": F.row_number().over(w), "_gap": F.col(time) - F.lag(time).over(w)})
    rises = rises.withColumn("_dt0", F.when(F.col("_n") == 2, F.col("_gap"))).withColumn("_dt", step)
    return rises.groupBy(key).agg(F.greatest(F.coalesce(F.max(F.when(F.col("_dt") > 0, F.col("_rise") / F.col("_dt"))), F.lit(0.0)), F.lit(0.0)).alias("depth_rate"))


def padded_sequences(series: DataFrame, keys: Sequence[str], time: str, features: Sequence[str], target: str) -> DataFrame:
    """All rows of each key in order, with rows of zeros up to the longest key's length."""
    row = F.struct(F.col(time).alias("t"), F.array(*[F.col(c).cast("double") for c in features]).alias("x"))
    packed = series.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("_rows"), F.max((F.col(target) > 0).cast("int")).alias("label"), F.max(target).alias("y"))
    longest = packed.agg(F.max(F.size("_rows")).alias("_most"))
    zeros = F.array(*[F.lit(0.0) for _ in features])
    wide = packed.crossJoin(F.broadcast(longest))  # one row
    return wide.select(*keys, F.size("_rows").alias("length"), F.concat(F.transform("_rows", lambda r: r["x"]), F.array_repeat(zeros, F.col("_most") - F.size("_rows"))).alias("sequence"), "label", "y")


def sequence_rows(series: DataFrame, keys: Sequence[str], time: str, features: Sequence[str], target: str) -> DataFrame:
    """A row per step of each key: position, features, and the key's length, label and y. Nothing is gathered or padded, so a
    key of any length is as many rows; a batch that a model reads is padded to its own longest key."""
    whole = series.groupBy(*keys).agg(F.count(F.lit(1)).alias("length"), F.max((F.col(target) > 0).cast("int")).alias("label"), F.max(target).alias("y"))
    placed = series.select(*keys, (F.row_number().over(ordered(keys, time)) - 1).alias("position"), time, *[F.col(c).cast("double").alias(c) for c in features])
    return placed.join(whole, list(keys))


def shape_stats(shapes: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """Duration (the last time) and time of the first peak."""
    peak = F.max(F.struct(F.col(value).alias("v"), (-F.col(time)).alias("t")))
    return shapes.groupBy(key).agg(F.max(time).alias("duration"), peak.alias("_m")).select(key, "duration", (-F.col("_m.t")).alias("time_to_peak"))


def apply_shape(shapes: DataFrame, nodes: DataFrame, factors: DataFrame, base: str = "base") -> DataFrame:
    """Flow of every node with a positive base, at every factor and time of every shape. Shapes and factors are the small
    sides: a few rows for each scenario."""
    return nodes.filter(F.col(base) > 0).crossJoin(shapes.crossJoin(factors)).withColumn("flow", F.col(base) * F.col("factor_mult") * F.col("q_norm")).drop("q_norm", base)


def normalised(series: DataFrame, key: str, value: str) -> DataFrame:
    """Values over their key's peak; keys without a positive peak are errors."""
    peak = F.max(value).over(Window.partitionBy(key))
    safe = F.when(peak > 0, peak).otherwise(F.raise_error(F.lit("a series without a positive peak can't be normalised")).cast("double"))
    return series.withColumn("q_norm", F.col(value) / safe)


def scale_series(inflows: DataFrame, points: DataFrame, factor: float, node: str = "node_id", name: str = "series") -> DataFrame:
    """Scaled copies of the series of some nodes, each under a name of its own, so nodes that share a series keep it."""
    own = inflows.select(node, name, F.concat(F.col(name), F.lit("__scaled_"), F.col(node).cast("string")).alias("new_series"))
    return own.join(points, name).select(node, "new_series", "t", (F.col("value") * factor).alias("value"))


def with_drain_down(series: DataFrame, key: str, time: str, value: str, hours: float) -> DataFrame:
    """The series with a zero some hours behind each key's last time."""
    ends = series.groupBy(key).agg((F.max(time) + hours).alias(time)).withColumn(value, F.lit(0.0))
    return series.select(key, time, value).unionByName(ends)


def elapsed(time: Column, start: Column, unit: str = "SECOND") -> Column:
    return F.timestamp_diff(unit, start, time)


def midpoints(df: DataFrame, value: str) -> DataFrame:
    """Values half-way between neighbours among the distinct values."""
    w = Window.orderBy(value)  # distinct scenario factors: a handful
    return df.select(value).distinct().select(((F.col(value) + F.lead(value).over(w)) / 2).alias(value)).dropna()
