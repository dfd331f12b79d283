"""Grouped cross-validation folds as tables."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.operators.ranks import before_each
from freshet.session import kept, settled, small_side


def leave_one_out(df: DataFrame, group: str) -> DataFrame:
    """group, fold_id: a fold for each distinct group, in the order of groups, numbered over parts of that order."""
    groups = settled(df.select(group).distinct().withColumn("_one", F.lit(1)))  # looked at several times, so found once
    return before_each(groups, (), [group], fold_id="_one").select(group, F.col("fold_id").cast("int").alias("fold_id"))


def dealt(loads: Sequence[int], size: int, count: int) -> list[int]:
    """How many of `count` groups of one size each fold takes, if each group goes to the lightest fold (ties to the first)."""
    within = lambda w: sum((w - x) // size + 1 for x in loads if x <= w)
    low, high = min(loads), min(loads) + size * count
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if within(middle) >= count else (middle + 1, high)
    taken = [max(0, (low - 1 - x) // size + 1) for x in loads]
    for k, x in enumerate(loads):
        if sum(taken) < count and x <= low and (low - x) % size == 0:
            taken[k] += 1
    return taken


#: Groups of size `_n` that folds of weights `_loads` take before one of them weighs more than {}.
_TAKEN = "aggregate(_loads, 0L, (a, x) -> a + IF(x <= {0}, ({0} - x) div _n + 1, 0L))"
_MIDDLE = "(b.low + b.high) div 2"
#: The weight at which a fold takes the group of rank `_rank`, by halving, and the fold: of those that reach it, in their order.
_WEIGHT = f"""aggregate(sequence(1, 63), struct(array_min(_loads) AS low, array_min(_loads) + _n * (_rank + 1) AS high),
  (b, i) -> IF({_TAKEN.format(f"({_MIDDLE})")} > _rank, struct(b.low AS low, {_MIDDLE} AS high), struct(least({_MIDDLE} + 1, b.high) AS low, b.high AS high)), b -> b.low)"""
_FOLD = f"filter(sequence(0, size(_loads) - 1), f -> _loads[f] <= _weight AND (_weight - _loads[f]) % _n = 0)[int(_rank - {_TAKEN.format('(_weight - 1)')})]"


def balanced(df: DataFrame, group: str, n_folds: int = 5) -> DataFrame:
    """group, fold_id: groups by falling size (ties by falling group), each to the lightest fold so far (ties to the first).

    Groups of one size are dealt together: if folds weigh L before them, fold f takes its k-th group of size s when it weighs
    L[f] + k * s, so the r-th group of the size goes where the r-th smallest (L[f] + k * s, f) is. The driver holds how many
    groups each distinct size has (sizes add up to the rows, so distinct ones are few) and the folds' weights; a group finds
    its fold from its rank among those of its size, so no task holds all groups."""
    sizes = settled(df.groupBy(group).agg(F.count(F.lit(1)).alias("_n")))  # looked at several times, so counted once
    classes = sorted(((r["_n"], r["c"]) for r in sizes.groupBy("_n").agg(F.count(F.lit(1)).alias("c")).collect()), reverse=True)
    if sum(c for _, c in classes) < n_folds:
        raise ValueError(f"fewer than {n_folds} groups")
    loads, before = [0] * n_folds, []
    for size, count in classes:
        before.append((size, loads))
        loads = [x + size * k for x, k in zip(loads, dealt(loads, size, count), strict=True)]
    weights = small_side(df.sparkSession.createDataFrame(before, "_n bigint, _loads array<bigint>"))
    ranked = before_each(sizes.withColumn("_one", F.lit(1)), ["_n"], [group], falling=[group], _rank="_one")
    return ranked.join(weights, "_n").withColumn("_weight", F.expr(_WEIGHT)).select(group, F.expr(_FOLD).alias("fold_id"))


def long_form(samples: DataFrame, group_folds: DataFrame, group: str, protocol: str, key: str = "sample_idx") -> DataFrame:
    """protocol, fold_id, sample_idx, split: every sample once a fold. Whether the table of groups is broadcast is left to
    its size; the numbers of folds are one row."""
    of_group = group_folds.withColumnRenamed("fold_id", "own_fold")
    folds = group_folds.agg(F.sort_array(F.collect_set("fold_id")).alias("_folds"))
    wide = samples.select(key, group).join(of_group, group).join(F.broadcast(folds)).withColumn("fold_id", F.explode("_folds"))
    return wide.select(F.lit(protocol).alias("protocol"), "fold_id", key, F.when(F.col("fold_id") == F.col("own_fold"), "test").otherwise("train").alias("split"))


def grouped_split(df: DataFrame, group: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """split of each row: exactly ceil(test_share * groups) groups are `test`, those with the smallest hashes of seed and
    group. Groups are counted by the first digits of their hash (65,536 rows at most); only the digits at which the share is
    reached are looked at again, and of those only the smallest hashes."""
    text = F.concat(F.lit(f"{seed}:"), F.col(group).cast("string"))
    hashed = F.md5(F.coalesce(text, F.lit(str(seed))).cast("binary"))
    groups = df.select(group).distinct().select(hashed.alias("h"))
    start = F.substring("h", 1, 4)
    counts = sorted((r["s"], r["n"]) for r in groups.groupBy(start.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect())
    total = sum(n for _, n in counts)
    wanted = ceil(test_share * total)
    if not 0 < wanted < total:
        raise ValueError(f"{test_share} of {total} groups leave a side empty")
    before = 0
    for digits, n in counts:
        if before + n >= wanted:
            break
        before += n
    last = groups.filter(start == digits).orderBy("h").limit(wanted - before).agg(F.max("h")).first()[0]
    return df.withColumn("split", F.when(hashed <= last, "test").otherwise("train"))


def sample_index(df: DataFrame, *order: str, falling: Sequence[str] = ()) -> DataFrame:
    """Consecutive numbers from 0 in the order, by range partitions: counts of the partitions come first, so no task holds
    all rows."""
    return before_each(df.withColumn("_one", F.lit(1)), (), order, falling, sample_idx="_one").drop("_one")


def order_parity(df: DataFrame, a: Sequence[str], b: Sequence[str]) -> DataFrame:
    """The rows with their numbers in two orders, position_a and position_b: fits that draw rows by place agree where these
    do. Rows that neither order tells apart must be equal."""
    first = kept(sample_index(kept(df), *a).withColumnRenamed("sample_idx", "position_a"))  # numbering looks at rows several times
    return sample_index(first, *b).withColumnRenamed("sample_idx", "position_b")


def overlap(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of both sides; none where a split is sound."""
    return a.select(*columns).intersect(b.select(*columns))
