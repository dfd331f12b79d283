"""Scores of classifiers and regressors, correlations and rankings, as aggregations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.functions.scalars import missing_if_nan, ratio
from freshet.operators.ranks import before_each, percentiles


def confusion(df: DataFrame, truth: str, pred: str, by: Sequence[str] = (), zero: float | None = None) -> DataFrame:
    """Counts and scores of 0/1 columns; a score with denominator 0 is `zero` (NULL by default)."""
    t, p = F.col(truth) == 1, F.col(pred) == 1
    out = df.groupBy(*by).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & ~p).alias("tn"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"))
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    scores = {"accuracy": ratio(tp + tn, tp + tn + fp + fn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": F.when((tp + fp > 0) & (tp + fn > 0), ratio(2 * tp, 2 * tp + fp + fn)), "csi": ratio(tp, tp + fp + fn)}
    scores["f1"] = F.when(tp > 0, scores["f1"])  # undefined where precision + recall is 0
    return out.withColumns({k: v if zero is None else F.coalesce(v, F.lit(zero)) for k, v in scores.items()})


def roc_auc(df: DataFrame, truth: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Rank-sum area, ties at their mean rank; NULL for a single class. Scores are collapsed first, so what is ordered is
    the table of distinct scores, not the rows."""
    per = df.groupBy(*by, score).agg(F.sum(F.col(truth).cast("long")).alias("_pos"), F.sum(1 - F.col(truth).cast("long")).alias("_neg"))
    wins = before_each(per, by, [score], _before="_neg").withColumn("_wins", F.col("_pos") * (F.col("_before") + F.col("_neg") / 2))
    out = wins.groupBy(*by).agg(F.sum("_wins").alias("_w"), F.sum("_pos").alias("n_pos"), F.sum("_neg").alias("n_neg"))
    return out.select(*by, "n_pos", "n_neg", ratio(F.col("_w"), F.col("n_pos") * F.col("n_neg")).alias("roc_auc"))


def average_precision(df: DataFrame, truth: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Sum of recall steps times precision over falling distinct scores; NULL for a single class."""
    per = df.groupBy(*by, score).agg(F.sum(F.col(truth).cast("long")).alias("_pos"), F.count(F.lit(1)).alias("_n"))
    cum = before_each(per, by, [score], falling=[score], _pos_above="_pos", _n_above="_n").withColumn("_p", (F.col("_pos_above") + F.col("_pos")) / (F.col("_n_above") + F.col("_n")))
    out = cum.groupBy(*by).agg(F.sum(F.col("_pos") * F.col("_p")).alias("_s"), F.sum("_pos").alias("_np"), F.sum("_n").alias("_nn"))
    return out.select(*by, F.when((F.col("_np") > 0) & (F.col("_np") < F.col("_nn")), F.col("_s") / F.col("_np")).alias("pr_auc"))


def efficiency(truth: Column, pred: Column) -> Column:
    """1 - squared errors / squared deviations; for constant truth 1 if there is no error, else 0."""
    n, total = F.count(truth), F.var_pop(truth)
    errors = F.sum((truth - pred) * (truth - pred))
    return F.when(total > 0, 1 - errors / (total * n)).when(errors == 0, F.lit(1.0)).otherwise(F.lit(0.0))


def rmse(truth: Column, pred: Column) -> Column:
    return F.sqrt(F.avg((truth - pred) * (truth - pred)))


def regression(df: DataFrame, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """nse, log_nse, rmse, mae, r2 and n. r2 is NULL for fewer than two rows."""
    t, p = F.col(truth), F.col(pred)
    floor, r2 = F.greatest(p, F.lit(0.0)), F.when(F.count(F.lit(1)) >= 2, efficiency(t, p))
    return df.groupBy(*by).agg(efficiency(t, p).alias("nse"), efficiency(F.log1p(t), F.log1p(floor)).alias("log_nse"), rmse(t, p).alias("rmse"), F.avg(F.abs(t - p)).alias("mae"), r2.alias("r2"), F.count(F.lit(1)).alias("n"))


def by_label(scored: DataFrame, labels: DataFrame, label: str = "label") -> DataFrame:
    """Scores of one frame (as `regression` or `confusion` give them by label) for every label of a list: rows is 0 and the
    scores are NULL where no row has the label."""
    count = "n" if "n" in scored.columns else None
    rows = F.col("n") if count else F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")
    return labels.select(label).distinct().join(scored.withColumn("rows", rows), label, "left").fillna(0, ["rows"]).drop(*([count] if count else ["tp", "tn", "fp", "fn"]))


def end_to_end(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Classifier and regressor together: the volume counts where the class is predicted."""
    routed = F.when(F.col("inunda_pred") == 1, F.greatest(F.col("vol_pred"), F.lit(0.0))).otherwise(F.lit(0.0))
    return df.groupBy(*by).agg(F.avg((F.col("inunda") == F.col("inunda_pred")).cast("double")).alias("accuracy"), rmse(F.col("vol"), routed).alias("rmse"), F.sum(routed).alias("total_pred"), F.sum("vol").alias("total_truth"))


def fold_means(per_fold: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Means over folds, without those that have no value."""
    return per_fold.groupBy(*by).agg(*[F.avg(missing_if_nan(F.col(m))).alias(m) for m in metrics])


def fold_spread(per_fold: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Means and population deviations over folds."""
    return per_fold.groupBy(*by).agg(*[f for m in metrics for f in (F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"))])


def r2_per_node(df: DataFrame, key: str, truth: str, pred: str) -> DataFrame:
    """NULL for fewer than two rows or constant truth."""
    t, p = F.col(truth), F.col(pred)
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.when((F.count(F.lit(1)) >= 2) & (F.var_pop(t) > 0), 1 - F.sum((t - p) * (t - p)) / (F.var_pop(t) * F.count(t))).alias("r2"))


def volume_errors(df: DataFrame, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    t, p = F.col(truth), F.col(pred)
    total, error = F.sum(t), F.sum(p) - F.sum(t)
    return df.groupBy(*by).agg(F.avg(F.abs(p - t)).alias("mae"), rmse(t, p).alias("rmse"), total.alias("total_truth"), F.sum(p).alias("total_pred"), error.alias("error"), F.when(total > 0, 100 * error / total).alias("error_pct"))


def correlation_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """a, b, r for every pair, from moments of one pass over rows that have both; NULL for a constant column."""
    pairs = list(combinations(columns, 2))

    def moments(k: int, a: str, b: str) -> list[Column]:
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = F.when(both, F.col(a).cast("double")), F.when(both, F.col(b).cast("double"))
        return [F.covar_pop(x, y).alias(f"c{k}"), F.var_pop(x).alias(f"x{k}"), F.var_pop(y).alias(f"y{k}")]

    one = df.agg(*[m for k, (a, b) in enumerate(pairs) for m in moments(k, a, b)])
    rows = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), ratio(F.col(f"c{k}"), F.sqrt(F.col(f"x{k}") * F.col(f"y{k}"))).alias("r")) for k, (a, b) in enumerate(pairs)]
    return one.select(F.explode(F.array(*rows)).alias("p")).select("p.*")


def high_pairs(pairs: DataFrame, least: float) -> DataFrame:
    return pairs.filter(F.abs("r") >= least).orderBy(F.desc(F.abs("r")), "a", "b")


def mean_ranks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns replaced by their ranks, ties at the mean. Distinct values are counted first; ranks come from their table."""
    out = df
    for c in columns:
        per = df.groupBy(c).agg(F.count(F.lit(1)).alias("_n"))
        ranks = before_each(per.filter(F.col(c).isNotNull()), (), [c], _below="_n").select(F.col(c).alias("_v"), (F.col("_below") + (F.col("_n") + 1) / 2).alias(f"_r_{c}"))
        out = out.join(ranks, out[c] == ranks["_v"], "left").drop("_v")
    return out.select(*[x for x in df.columns if x not in columns], *[F.col(f"_r_{c}").alias(c) for c in columns])


def spearman(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Pearson correlation of mean ranks, pair by pair over rows that have both."""
    parts = []
    for a, b in pairs:
        ranked = mean_ranks(df.select(a, b).dropna(), [a, b])
        parts.append(correlation_pairs(ranked, [a, b]))
    return reduce(DataFrame.unionByName, parts)


def correlations(df: DataFrame, columns: Sequence[str], method: str = "pearson") -> DataFrame:
    """a, b, r for every pair of columns, by `pearson`, `spearman` or `kendall`."""
    from freshet.operators.ordinal import kendall

    if method == "pearson":
        return correlation_pairs(df, columns)
    if method not in ("spearman", "kendall"):
        raise ValueError(f"{method} is none of pearson, spearman, kendall")
    return (spearman if method == "spearman" else kendall)(df, list(combinations(columns, 2)))


def ranking(metrics: DataFrame, primary: str, ties: Sequence[tuple[str, bool]], name: str = "family", minimise: bool = True) -> DataFrame:
    """Candidates in order: valid primary first, by it, then by ties (column, larger is better), then by name."""
    x = missing_if_nan(F.col(primary))
    inf = F.lit(float("inf"))
    keys = [F.coalesce(x if minimise else -x, inf), *[F.coalesce(-missing_if_nan(F.col(c)) if larger else missing_if_nan(F.col(c)), inf) for c, larger in ties], F.col(name)]
    w = Window.orderBy(x.isNull().cast("int"), *keys)  # a row per candidate
    reason = F.when(x.isNull(), F.concat(F.lit(primary), F.lit(" has no value")))
    return metrics.select(F.row_number().over(w).alias("rank"), name, x.isNotNull().cast("int").alias("valid"), reason.alias("reason"), x.alias(primary))


def quantile_threshold(df: DataFrame, value: str, q: float = 0.75, floor: float = 1e-6) -> DataFrame:
    got = percentiles(df.select(F.lit(1).alias("_all"), value), "_all", value, [q])
    return got.select(F.greatest(F.col("q")[0], F.lit(floor)).alias("threshold"))


def class_weight(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Negatives per positive; 1 without positives."""
    pos, neg = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    return df.groupBy(*by).agg(F.coalesce(ratio(neg, pos), F.lit(1.0)).alias("pos_weight"))


def top_loadings(loadings: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("component").orderBy(F.desc(F.abs("loading")), "feature")
    return loadings.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """The exact median of each column that has values; a row per column reaches the driver."""
    long = df.unpivot([], [F.col(c).cast("double").alias(c) for c in columns], "_column", "_v")
    return {r["_column"]: r["q"][0] for r in percentiles(long, "_column", "_v", [0.5]).collect()}


def explained_variance(df: DataFrame, columns: Sequence[str]):
    """(variances, loadings) of a principal component analysis after median imputation and scaling by population deviation.
    Only the correlation matrix of the columns reaches the driver."""
    import numpy as np

    middle = medians(df, columns)
    filled = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(middle.get(c, 0.0))).alias(c) for c in columns])
    pairs = {(r["a"], r["b"]): r["r"] or 0.0 for r in correlation_pairs(filled, columns).collect()}
    matrix = np.array([[1.0 if a == b else pairs.get((a, b), pairs.get((b, a), 0.0)) for b in columns] for a in columns])
    values, vectors = np.linalg.eigh(matrix)
    order = np.argsort(-values)
    return values[order] / values.sum(), vectors[:, order]


def components_needed(cumulative: Sequence[float], share: float) -> int:
    return next((k + 1 for k, x in enumerate(cumulative) if x >= share), len(cumulative))
