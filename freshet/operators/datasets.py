"""Datasets that models read: training samples of runs, results of runs, sequences beside static features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.operators import relations as R
from freshet.operators import validation as V
from freshet.operators.features import one_hot
from freshet.session import small_side


def chosen(df: DataFrame, run_ids: DataFrame | None) -> DataFrame:
    return df if run_ids is None else df.join(run_ids.select("run_id").distinct(), "run_id", "left_semi")


def training_violations(runs: DataFrame, features: DataFrame, results: DataFrame, feature_names: Sequence[str], run_ids: DataFrame | None = None) -> DataFrame:
    """rule, violations: selected runs that don't exist or aren't COMPLETE, runs whose counts differ from node_count, keys
    that one side lacks, features that are missing or infinite, targets that are missing or out of range."""
    complete = chosen(runs.filter("status = 'COMPLETE'"), run_ids)
    asked = (run_ids if run_ids is not None else runs.limit(0)).select("run_id").distinct()
    keep = complete.select("run_id")
    x, y = (t.join(keep, "run_id", "left_semi") for t in (features, results))
    counted = R.counted_children(complete, "run_id", "node_count", features=x, results=y)
    bad = reduce(Column.__or__, [F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf")) for c in feature_names])
    parts = {
        "run_not_complete": asked.join(keep, "run_id", "left_anti"),
        "node_count": counted.filter("NOT complete"),
        "key_mismatch": R.key_mismatches(x, y, ["run_id", "node_id"], ("features", "results")),
        "feature_value": x.filter(bad),
        "target_value": V.bad_targets(y),
    }
    return reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(rule).alias("rule"), "violations") for rule, df in parts.items()])


def training_samples(runs: DataFrame, scenarios: DataFrame, features: DataFrame, results: DataFrame, nodes: DataFrame, feature_names: Sequence[str], run_ids: DataFrame | None = None) -> DataFrame:
    """The canonical training rows: COMPLETE runs (those of a selection, if given), a row per node with features and a
    result, in the order of run and node. Anything that breaks a rule is an error; so is a selection without rows."""
    V.raise_if_any(training_violations(runs, features, results, feature_names, run_ids).filter("violations > 0"), "the training samples break a rule", 5)
    view = R.training_view(chosen(runs, run_ids), scenarios, features, results, nodes)
    if view.isEmpty():
        raise V.RuleError("no complete training samples")
    return view.orderBy("run_id", "node_id")


def run_results(results: DataFrame, runs: DataFrame, defaults: Mapping[str, float], source: str) -> DataFrame:
    """Results of all completed runs (or of the runs given) in one join: missing values get defaults, volumes and peaks are
    at least 0, and each row says where it comes from."""
    done = runs.filter("status = 'COMPLETE'").select("run_id", "inflow_multiplier")
    clipped = {c: F.greatest(F.coalesce(F.col(c).cast("double"), F.lit(float(d))), F.lit(0.0)) for c, d in defaults.items()}
    return results.join(done, "run_id").withColumns({**clipped, "node_id": F.col("node_id").cast("string"), "source": F.lit(source)})


def with_static(sequences: DataFrame, static: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Sequences beside the static features of their node, and the keys that have none (they are skipped; count them)."""
    return sequences.join(static, list(keys)), sequences.select(*keys).distinct().join(static.select(*keys), list(keys), "left_anti")


def static_features(table: DataFrame, keys: Sequence[str], drop: Sequence[str], encode: Mapping[str, Sequence[str]]) -> DataFrame:
    """The columns but those dropped; categories as indicators (all but the first), missing numbers as 0."""
    out = table.drop(*drop)
    for column, categories in encode.items():
        out = one_hot(out, column, categories).drop(column)
    numbers = [c for c in out.columns if c not in keys]
    return out.select(*keys, *[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(0.0)).alias(c) for c in numbers])


def column_roles(columns: Sequence[str], roles: Mapping[str, Sequence[str]]) -> dict[str, list[str]]:
    """The columns of each role, in their order; those of no role are `unclassified`."""
    named = {c for cs in roles.values() for c in cs}
    return {role: [c for c in columns if c in set(cs)] for role, cs in roles.items()} | {"unclassified": [c for c in columns if c not in named]}


def ordered_labels(df: DataFrame, label: Column, order: str) -> DataFrame:
    """Distinct labels in the order in which they first occur."""
    return df.groupBy(label.alias("label")).agg(F.min(order).alias("first")).orderBy("first")


def enough_groups(df: DataFrame, group: str, least: int = 2) -> int:
    """How many distinct groups there are; fewer than `least` is an error."""
    n = df.agg(F.count_distinct(group)).first()[0]
    if n < least:
        raise V.RuleError(f"{n} groups of {group}, {least} are needed")
    return n


def folds_for(n_groups: int, protocol: str, most: int = 5) -> int:
    """Folds of a protocol: one for each group, or `most` (as many as there are groups, at least 2)."""
    return n_groups if protocol == "LOSO" else max(2, min(most, n_groups))


def first_filled(series: DataFrame, order: str, key: str, time: str, value: str) -> DataFrame:
    """Duration and time of the first peak of the first series (by order) that has a value: one row."""
    from freshet.operators.timeseries import shape_stats

    filled = series.filter(F.col(value).isNotNull())
    first = filled.agg(F.min(F.struct(order, key)).alias("m")).select(F.col(f"m.{key}").alias(key))
    return shape_stats(filled.join(F.broadcast(first), key), key, time, value)  # one row


def scaled_baselines(inflows: DataFrame, factor: float, baseline: str = "baseline") -> DataFrame:
    """Baselines times a factor; `changed` says which rows had one."""
    return inflows.withColumns({"changed": F.coalesce(F.col(baseline) != 0, F.lit(False)), baseline: F.col(baseline) * factor})


def scaled_inputs(filled: DataFrame, base: DataFrame, multipliers: DataFrame, run: str, value: str) -> DataFrame:
    """The input series of a base run at every multiplier, over the multiplier of the base run."""
    return filled.join(base.select(run, F.col("multiplier").alias("_own")), run).join(small_side(multipliers)).withColumn(value, F.col(value) * F.col("multiplier") / F.col("_own")).drop("_own")


def peak_node(series: DataFrame, by: str, node: str, value: str) -> DataFrame:
    """The node with the greatest value of each group; ties take the least node."""
    best = F.struct(F.col(value).isNotNull(), F.col(value), -F.col(node))
    return series.groupBy(by).agg(F.max_by(F.struct(F.col(node).alias("node"), F.col(value).alias("peak")), best).alias("_top")).select(by, F.col("_top.node").alias(node), F.col("_top.peak").alias("peak"))


def link_capacity(flows: DataFrame, link: str, flow: str, capacity: str, hours_full: str) -> DataFrame:
    """Peak flow over full-pipe capacity (4 places, NULL without capacity), and whether the link ran full."""
    out = flows.groupBy(link).agg(F.max(flow).alias("peak_flow"), F.max(capacity).alias("capacity"), F.max(hours_full).alias("_full"))
    return out.select(link, "peak_flow", F.when(F.col("capacity") > 0, F.round(F.col("peak_flow") / F.col("capacity"), 4)).alias("capacity_ratio"), F.coalesce(F.col("_full") > 0, F.lit(False)).alias("surcharged"))


def step_projections(steps: DataFrame, depth: str, full_depth: str, flooding: str, digits: int = 6) -> DataFrame:
    """depth_ratio (NULL without a full depth), failed_now and rounded values of each time step."""
    return steps.withColumns({"depth_ratio": F.when(F.col(full_depth) > 0, F.bround(F.col(depth) / F.col(full_depth), digits)), "failed_now": (F.coalesce(F.col(flooding), F.lit(0.0)) > 0).cast("int")})


def shared_scale(pairs: DataFrame, by: Sequence[str], truth: str, pred: str) -> DataFrame:
    """The largest of truth and prediction of each group, at least 1: one colour scale for both maps."""
    return pairs.groupBy(*by).agg(F.greatest(F.max(truth), F.max(pred), F.lit(1.0)).alias("scale"))


def unpaired_series(inflows: DataFrame, points: DataFrame, node: str = "node_id", name: str = "series") -> DataFrame:
    """What keeps nodes and series from being one to one: (problem, name) of nodes with several series, series of several
    nodes, and series that have no points."""
    pairs = inflows.select(node, name).distinct()

    def repeated(key: str, problem: str) -> DataFrame:
        return pairs.groupBy(F.col(key).cast("string").alias("name")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit(problem).alias("problem"), "name")

    lacking = pairs.select(name).distinct().join(points.select(name).distinct(), name, "left_anti").select(F.lit("series_without_points").alias("problem"), F.col(name).alias("name"))
    return repeated(node, "node_with_several_series").unionByName(repeated(name, "series_of_several_nodes")).unionByName(lacking)


def batch_validation(truth: DataFrame, pred: DataFrame, keys: Sequence[str], by: str) -> DataFrame:
    """Every scenario of a batch in one plan: nodes, keys that one side lacks, hits and misses, volumes and their error."""
    side = lambda df, tag: df.select(by, *keys, *[F.col(c).alias(f"_{tag}_{c}") for c in ("vol", "inunda")], F.lit(1).alias(f"_{tag}"))
    both = side(truth, "t").join(side(pred, "p"), [by, *keys], "full_outer")
    t, p = F.col("_t_inunda") == 1, F.col("_p_inunda") == 1
    total, error = F.sum("_t_vol"), F.sum("_p_vol") - F.sum("_t_vol")
    return both.groupBy(by).agg(
        F.count("_t").alias("n_truth"), F.count("_p").alias("n_pred"), F.count_if(F.col("_t").isNull() | F.col("_p").isNull()).alias("unmatched"), F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"),
        total.alias("total_truth"), F.sum("_p_vol").alias("total_pred"), F.when(total > 0, 100 * error / total).alias("error_pct"),
    )


def nested_metric(metrics: Column, path: str) -> Column:
    """The number at a dotted path of nested JSON metrics; NULL where a step is missing or isn't a number."""
    return F.get_json_object(metrics, "$." + path).try_cast("double")


def tokens(text: Column) -> Column:
    """The pieces of a text between commas, semicolons and white space."""
    return F.filter(F.split(text, r"[,;\s]+"), lambda x: x != "")


def number_list(text: Column) -> Column:
    """The numbers of `range(first, end, step)` (end excluded) or of a list of numbers; NULL for anything else."""
    parts = F.transform(tokens(F.regexp_replace(text, r"^\s*range\s*\(|\)\s*$", "")), lambda x: x.try_cast("double"))
    a, b, step = (F.get(parts, k) for k in range(3))
    n = F.ceil((b - a) / step - 1e-9)
    steps = F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1), lambda k: F.round(a + k * step, 6))).otherwise(F.array().cast("array<double>"))
    ranged = F.when((F.size(parts) == 3) & (step > 0), steps)
    return F.when(F.exists(parts, lambda x: x.isNull()) | (F.size(parts) == 0), F.lit(None)).when(text.rlike(r"^\s*range\s*\("), ranged).otherwise(parts)


def minutes_to_peak(peak_ordinal: Column, start: Column) -> Column:
    """Minutes from a start to a peak that is given as a fractional day number (1 is the first of January of year 1); at
    least 0."""
    day = F.datediff(start, F.lit("0001-01-01").cast("date")) + 1
    seconds = F.hour(start) * 3600 + F.minute(start) * 60 + F.second(start)
    return F.greatest(F.lit(0.0), (peak_ordinal - (day + seconds / 86400.0)) * 1440.0)
