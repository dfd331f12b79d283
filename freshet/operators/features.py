"""Feature columns of samples: scaling by factor, encodings, slices, display helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.operators.validation import raise_if_any
from freshet.session import small_side

#: The feature contract, in order (name, may be null).
FEATURES = [
    ("elev_fondo", False), ("prof_max", False), ("n_tuberias_in", False), ("n_tuberias_out", False), ("diam_max_in", True), ("diam_max_out", True), ("pendiente_max_in", True),
    ("pendiente_out", True), ("base_inflow_lps", False), ("dist_outfall_m", True), ("n_nodos_aguas_arriba", False), ("q_pico_acum_base", False), ("upstream_capacity_lps", True),
    ("q_pico_nodo", False), ("q_pico_acum_escalado", False), ("duracion_horas", False), ("tiempo_al_pico_h", False),
]


def dynamic_features(static: DataFrame, factors: DataFrame, node_peak: str, total_peak: str) -> DataFrame:
    """Every node at every factor, with both peaks scaled; factors are a handful."""
    wide = static.crossJoin(small_side(factors.select(F.round("factor_mult", 6).alias("factor_mult"))))
    return wide.withColumns({"q_pico_nodo": F.col(node_peak) * F.col("factor_mult"), "q_pico_acum_escalado": F.col(total_peak) * F.col("factor_mult")})


def base_rows(df: DataFrame, base: str = "base") -> DataFrame:
    """Rows of the base shape; all rows where shapes aren't told apart."""
    return df.filter(F.col("shape_id") == base) if "shape_id" in df.columns else df


def augmented_rows(df: DataFrame, base: str = "base") -> DataFrame:
    return df.filter(F.col("shape_id") != base) if "shape_id" in df.columns else df.limit(0)


def factor_slice(df: DataFrame, factor: float, tolerance: float = 1e-6) -> DataFrame:
    return df.filter(F.abs(F.col("factor_mult") - factor) < tolerance)


def numeric_features(df: DataFrame, target: str, drop: Sequence[str] = ()) -> DataFrame:
    """Numeric columns but those dropped, with NULL targets as 0."""
    numbers = [n for n, kind in df.dtypes if kind in ("int", "bigint", "smallint", "tinyint", "double", "float") or kind.startswith("decimal")]
    return df.select(*[c for c in numbers if c not in drop]).fillna(0, [target])


def aligned(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns in order; those that are missing are NULL."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in columns])


def one_hot(df: DataFrame, column: str, categories: Sequence[str]) -> DataFrame:
    """An indicator for each category but the first in order."""
    return df.withColumns({f"{column}_{c}": (F.col(column) == c).cast("int") for c in sorted(categories)[1:]})


def spread_pairs(nodes: DataFrame, dx: float = 2.0) -> DataFrame:
    """Where exactly two nodes share a point, they move apart by dx on either side."""
    here = Window.partitionBy("x", "y")
    k, n = F.row_number().over(here.orderBy("node_id")), F.count(F.lit(1)).over(here)
    return nodes.withColumns({"_k": k, "_n": n}).withColumn("x", F.when(F.col("_n") == 2, F.col("x") + F.when(F.col("_k") == 1, -dx).otherwise(dx)).otherwise(F.col("x"))).drop("_k", "_n")


def prediction_rows(nodes: DataFrame, multipliers: DataFrame, **constants: Column) -> DataFrame:
    """A row per node and multiplier; a node that occurs twice counts once (the first by order)."""
    w = Window.partitionBy("node_id").orderBy("ord")
    once = nodes.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k", "ord")
    return once.crossJoin(small_side(multipliers)).withColumns(constants) if constants else once.crossJoin(small_side(multipliers))


def steady_prediction_rows(nodes: DataFrame, multipliers: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """A row per node of a network and multiplier, for predictions at steady inflows. With `targets` (node_id) only those
    nodes; one that the network lacks is an error."""
    if targets is not None:
        asked = targets.select("node_id").distinct()
        raise_if_any(asked.join(nodes, "node_id", "left_anti"), "nodes that aren't in the network")
        nodes = nodes.join(asked, "node_id", "left_semi")
    given = multipliers.select(F.col("inflow_multiplier").cast("double").alias("inflow_multiplier"))
    return prediction_rows(nodes, given, scenario_type=F.lit("ml_steady_prediction"), spatial_pattern=F.lit("all_nodes" if targets is None else "selected_nodes"))


def scenario_input(df: DataFrame) -> str:
    """The column that tells scenarios apart: the multiplier, or the added inflow of older datasets."""
    for name in ("inflow_multiplier", "delta_inflow_lps"):
        if name in df.columns:
            return name
    raise ValueError("neither inflow_multiplier nor delta_inflow_lps")


def shown_metric(nodes: DataFrame) -> DataFrame:
    """The volume, unless no node has any; then the peak."""
    largest = nodes.agg(F.max(F.abs("vol")).alias("_most"))  # one row
    return nodes.join(F.broadcast(largest)).withColumn("shown", F.when(F.col("_most") > 0, F.col("vol")).otherwise(F.col("peak"))).drop("_most")


def factor_range(spark, first: float, last: float, step: float) -> DataFrame:
    """first, first + step, ..., last included, rounded to 6 places."""
    n = round((last - first) / step)
    return spark.range(n + 1).select(F.round(F.lit(first) + F.col("id") * step, 6).alias("factor_mult"))


def inclusive_range(first: Column, last: Column, step: Column) -> Column:
    """first, first + step, ..., last included, rounded to 6 places, as an array."""
    n = F.bround((last - first) / step).cast("int")
    return F.transform(F.sequence(F.lit(0), n), lambda k: F.round(first + k * step, 6))


def regimes(df: DataFrame, trained: DataFrame, value: str) -> DataFrame:
    """Inside or outside of the trained range of a value."""
    span = trained.agg(F.min(value).alias("_a"), F.max(value).alias("_b"))
    return df.crossJoin(F.broadcast(span)).withColumn("regime", F.when(F.col(value).between(F.col("_a"), F.col("_b")), "INTERPOLATION").otherwise("EXTRAPOLATION")).drop("_a", "_b")
