"""Principal components of a dataset's features: variances, loadings, projections of rows, and what they amount to."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.operators.metrics import components_needed, correlation_pairs
from freshet.operators.models import Preparation
from freshet.session import kept


@dataclass(frozen=True)
class Components:
    """A fitted analysis. Columns of `loadings` are unit vectors by falling variance, signed so that the entry that is
    largest in size is positive."""

    preparation: Preparation
    rows: int
    variances: np.ndarray
    loadings: np.ndarray

    @property
    def shares(self) -> np.ndarray:
        return self.variances / self.variances.sum()

    def names(self) -> list[str]:
        return [f"PC{k + 1}" for k in range(len(self.variances))]

    def project(self, df: DataFrame, keep: Sequence[str], wanted: int = 5) -> DataFrame:
        """keep as it was, and the rows' coordinates along the first components."""
        columns = self.preparation.columns
        ready = self.preparation.apply(df.select(F.struct(*keep).alias("_keep"), *columns))
        sums = [sum((F.col(c) * F.lit(float(w)) for c, w in zip(columns, self.loadings[:, k], strict=True)), F.lit(0.0)) for k in range(min(wanted, len(columns)))]
        return ready.select("_keep.*", *[x.alias(n) for x, n in zip(sums, self.names(), strict=False)])

    def variance_table(self, df: DataFrame) -> DataFrame:
        """component, eigenvalue (of the sample's covariance), share and cumulative share."""
        scale = self.rows / (self.rows - 1) if self.rows > 1 else 1.0
        total = np.cumsum(self.shares)
        rows = [(n, float(v * scale), float(s), float(t)) for n, v, s, t in zip(self.names(), self.variances, self.shares, total, strict=True)]
        return df.sparkSession.createDataFrame(rows, "component string, eigenvalue double, share double, cumulative double")

    def loading_table(self, df: DataFrame) -> DataFrame:
        rows = [(n, c, float(self.loadings[i, k])) for k, n in enumerate(self.names()) for i, c in enumerate(self.preparation.columns)]
        return df.sparkSession.createDataFrame(rows, "component string, feature string, loading double")

    def summary(self) -> dict[str, float]:
        total = np.cumsum(self.shares).tolist()
        return {
            "feature_count": len(self.variances), "sample_count": self.rows,
            **{f"components_for_{int(100 * s)}pct_variance": components_needed(total, s) for s in (0.8, 0.9, 0.95)},
            "pc1_variance_ratio": total[0], "pc2_cumulative_variance_ratio": total[min(1, len(total) - 1)], "pc3_cumulative_variance_ratio": total[min(2, len(total) - 1)],
        }


def fit_components(df: DataFrame, columns: Sequence[str]) -> Components:
    """Medians for missing values, population deviations as scales, then the eigenvectors of the correlation matrix, which is
    all that reaches the driver. A constant column has no variance and its own component."""
    df = kept(df.select(*columns))  # several passes look at it
    prep = Preparation.fit(df, columns, scaled=True)
    ready = prep.apply(df.select(*columns))
    pairs = {(r["a"], r["b"]): r["r"] or 0.0 for r in correlation_pairs(ready, columns).collect()}
    own = df.agg(F.count(F.lit(1)).alias("n"), *[F.var_pop(F.coalesce(F.col(c).cast("double"), F.lit(m))).alias(f"v{k}") for k, (c, m) in enumerate(zip(columns, prep.medians, strict=True))]).first()
    matrix = np.array([[(1.0 if own[f"v{i}"] else 0.0) if i == j else pairs.get((a, b), pairs.get((b, a), 0.0)) for j, b in enumerate(columns)] for i, a in enumerate(columns)])
    values, vectors = np.linalg.eigh(matrix)
    values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(columns))])
    return Components(prep, own["n"], values, vectors * signs)


def interpretation(found: Components, top: int = 5) -> str:
    """The analysis in words: shares, components needed, and the strongest loadings of each component."""
    s = found.summary()
    lines = [f"{s['feature_count']} features, {s['sample_count']} rows", f"PC1 explains {s['pc1_variance_ratio']:.4f} of the variance, PC1 and PC2 {s['pc2_cumulative_variance_ratio']:.4f}, PC1 to PC3 {s['pc3_cumulative_variance_ratio']:.4f}"]
    lines += [f"{s[f'components_for_{p}pct_variance']} components for {p} %" for p in (80, 90, 95)]
    for k, name in enumerate(found.names()):
        order = sorted(range(len(found.variances)), key=lambda i: (-abs(found.loadings[i, k]), found.preparation.columns[i]))  # noqa: B023
        lines.append(f"{name}: " + ", ".join(f"{found.preparation.columns[i]} {found.loadings[i, k]:+.4f}" for i in order[:top]))
    return "\n".join(lines)
