"""Kendall's tau over tables, without pairs of rows."""

from __future__ import annotations

from collections.abc import Sequence
from math import sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.operators.ranks import bounds, part_of
from freshet.session import settled, shipped

#: Parts of either order at most; their square bounds the table of totals that the driver reads.
MOST_PARTS = 256


def inversions(ranks: np.ndarray, weights: np.ndarray) -> int:
    """The sum of weight products over pairs of which the first has the higher rank. Ranks are 0 to n - 1, each once.

    Two ranks are decided at the highest bit in which they differ: among ranks that agree above a bit, each with a 0 counts
    the weights with a 1 before it."""
    big = float(weights.sum()) ** 2 >= 2.0**62
    weights, total = weights.astype(object if big else np.int64), 0
    for bit in range(max(len(ranks) - 1, 0).bit_length()):
        above = ranks >> (bit + 1)
        order = np.argsort(above, kind="stable")
        group, ones, w = above[order], (ranks[order] >> bit & 1).astype(bool), weights[order]
        before = np.cumsum(np.where(ones, w, 0))
        first = np.r_[True, group[1:] != group[:-1]]
        base = np.where(ones, before - w, before)[first][np.cumsum(first) - 1]
        total += int((w * (before - base))[~ones].sum())
    return total


def _of_part(by: str):
    """Inversions among the rows of a part: along (x, y) in a part of it, along the parts of (x, y) in a part of (y, x)."""

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        x, y, n = rows["x"].to_numpy(), rows["y"].to_numpy(), rows["n"].to_numpy()
        ranks = np.empty(len(rows), np.int64)
        ranks[np.lexsort((x, y))] = np.arange(len(rows))
        along = np.lexsort((y, x)) if by == "p" else np.lexsort((ranks, rows["p"].to_numpy()))
        return pd.DataFrame({"d": [str(inversions(ranks[along], n[along]))]})

    return count


def discordant(counts: DataFrame) -> int:
    """Pairs of rows of which one has the larger x and the other the larger y, weighted by n; (x, y) are distinct.

    Rows have a place in the order (x, y) and one in the order (y, x), and a pair is discordant if these disagree. Both
    orders are cut into parts. Pairs in different parts of both are counted from the totals of the parts, pairs in one part
    of the first within it, and pairs in one part of the second, but not of the first, within that: two shuffles, no pairs."""
    parts = min(MOST_PARTS, int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    p, q = (part_of(counts, order, bounds(counts, order, parts)) for order in (["x", "y"], ["y", "x"]))
    placed = shipped(counts.withColumns({"p": p, "q": q}))
    grid = np.zeros((parts + 1, parts + 1), object)
    for row in placed.groupBy("p", "q").agg(F.sum("n").alias("n")).collect():  # a row for each pair of parts
        grid[row["p"], row["q"]] = row["n"]
    above = grid[:, ::-1].cumsum(axis=1)[:, ::-1].cumsum(axis=0)  # rows up to p in x, from q on in y
    total = int((grid[1:, :-1] * above[:-1, 1:]).sum())
    for by in ("p", "q"):
        found = placed.groupBy(by).applyInPandas(_of_part(by), "d string").agg(F.sum(F.col("d").cast("decimal(38,0)")))
        total += int(found.first()[0] or 0)
    return total


def kendall(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """a, b, r: tau-b of each pair of columns over rows that have both; NULL for a constant column.

    Rows are collapsed to distinct values with counts; ties are sums over the values of either column."""
    out = []
    choose = lambda n: n * (n - 1) // 2
    ties = F.sum((F.col("n").cast("decimal(19,0)") * (F.col("n") - 1)).cast("decimal(38,0)"))
    for a, b in pairs:
        both = df.select(F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")).dropna()
        counts = settled(both.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")))
        rows = int(counts.agg(F.sum("n")).first()[0] or 0)
        tx, ty = (int(counts.groupBy(c).agg(F.sum("n").alias("n")).agg(ties).first()[0] or 0) // 2 for c in ("x", "y"))
        txy = int(counts.agg(ties).first()[0] or 0) // 2
        x, y = choose(rows) - tx, choose(rows) - ty
        agreement = choose(rows) - tx - ty + txy - 2 * discordant(counts) if x and y else 0
        out.append((a, b, agreement / sqrt(x) / sqrt(y) if x and y else None))
    return df.sparkSession.createDataFrame(out, "a string, b string, r double")
