"""Rules as queries: each gives the rows that break it, and `raise_if_any` turns them into an error."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.functions.scalars import as_number, clock_to_hours


class RuleError(ValueError):
    pass


def raise_if_any(violations: DataFrame, message: str, shown: int = 3) -> None:
    found = violations.limit(shown).collect()
    if found:
        raise RuleError(f"{message}: {', '.join(str(r.asDict()) for r in found)}")


def check_run_ids(run_ids: Sequence[int]) -> list[int]:
    """Distinct positive 64-bit whole numbers in their first order; anything else is an error."""
    if not run_ids:
        raise RuleError("no run_id given")
    for r in run_ids:
        if isinstance(r, bool) or not isinstance(r, int) or not 0 < r < 1 << 63:
            raise RuleError(f"not a run_id: {r!r}")
    return list(dict.fromkeys(run_ids))


def bad_targets(df: DataFrame, label: str = "inunda", volume: str = "vol") -> DataFrame:
    """Rows whose targets are missing, not finite, outside {0, 1} or negative."""
    x, y = as_number(F.col(label)), as_number(F.col(volume))
    return df.filter(x.isNull() | y.isNull() | ~x.isin(0.0, 1.0) | (y < 0))


def contract_violations(df: DataFrame, contract: Sequence[tuple[str, bool]]) -> list[str]:
    """What is wrong with the order and types of the columns; contract: (name, may be null)."""
    problems = []
    if df.columns != [n for n, _ in contract]:
        problems.append("columns differ from the contract or its order")
    problems += [f"{name} isn't numeric" for name, kind in df.dtypes if kind in ("boolean", "string", "binary")]
    return problems


def contract_counts(df: DataFrame, contract: Sequence[tuple[str, bool]]) -> DataFrame:
    """feature, nulls, infinite and whether the nulls are forbidden, from one pass."""
    one = df.agg(*[F.count_if(F.col(n).isNull()).alias(f"n_{n}") for n, _ in contract], *[F.count_if(F.abs(F.col(n).cast("double")) == float("inf")).alias(f"i_{n}") for n, _ in contract])
    rows = [F.struct(F.lit(n).alias("feature"), F.col(f"n_{n}").alias("nulls"), F.col(f"i_{n}").alias("infinite"), (F.lit(not may) & (F.col(f"n_{n}") > 0) | (F.col(f"i_{n}") > 0)).alias("violated")) for n, may in contract]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def dataset_facts(df: DataFrame, label: str = "inunda", volume: str = "vol") -> DataFrame:
    """One row of the facts that a dataset is judged by."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(label).isNull()).alias("null_labels"), F.count_if(F.col(volume) < 0).alias("negative"), F.count_if(~F.col(label).isin(0, 1)).alias("not_binary"), F.sum(label).alias("flooded"), F.avg(F.col(label).cast("double")).alias("flooded_share"))


def scenario_rules(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """Violations (rule, node_id, detail) of an inflow table of texts: node_id, time (`H:MM`), value. Rules: unknown or
    missing nodes, fewer than two steps, a start other than 0:00, times that aren't H:MM, repeated times, times that don't
    rise, grids that differ between nodes, values that aren't numbers or are negative."""
    hours, value = clock_to_hours(F.col("time")), as_number(F.col("value"))
    parsed = rows.withColumns({"_h": hours, "_v": value, "_i": F.monotonically_increasing_id()})

    def rule(name: str, df: DataFrame, detail: Column) -> DataFrame:
        return df.select(F.lit(name).alias("rule"), "node_id", detail.cast("string").alias("detail"))

    w = Window.partitionBy("node_id").orderBy("_i")
    per = parsed.groupBy("node_id").agg(F.count(F.lit(1)).alias("n"), F.min("_h").alias("first"), F.array_sort(F.collect_set("_h")).alias("grid"))
    grids = per.select("grid").distinct()
    return reduce(
        DataFrame.unionByName,
        [
            rule("unknown_node", per.join(expected, "node_id", "left_anti"), F.col("n")),
            rule("missing_node", expected.join(per, "node_id", "left_anti"), F.lit(None)),
            rule("too_few_steps", per.filter("n < 2"), F.col("n")),
            rule("start", per.filter("first <> 0"), F.col("first")),
            rule("time_format", parsed.filter("_h IS NULL"), F.col("time")),
            rule("repeated_time", parsed.groupBy("node_id", "time").count().filter("count > 1"), F.col("time")),
            rule("not_rising", parsed.withColumn("_p", F.lag("_h").over(w)).filter("_h <= _p"), F.col("time")),
            rule("grid", per.join(F.broadcast(grids.agg(F.count(F.lit(1)).alias("k"), F.min("grid").alias("g"))), F.lit(True)).filter("k > 1 AND grid <> g"), F.size("grid")),
            rule("value", parsed.filter("_v IS NULL OR _v < 0"), F.col("value")),
        ],
    )


def broken_transitions(events: DataFrame, key: str, order: str, status: str, allowed: Sequence[tuple[str | None, str]]) -> DataFrame:
    """Status events that don't follow from the one before; (None, s) are the ones to start with."""
    w = Window.partitionBy(key).orderBy(order)
    before = events.withColumn("before", F.lag(status).over(w))
    fine = reduce(Column.__or__, [F.col("before").eqNullSafe(F.lit(a)) & (F.col(status) == b) for a, b in allowed])
    return before.filter(~fine).select(key, order, "before", status)


def rule_not_null(df: DataFrame, table: str, *columns: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.agg(F.count_if(F.col(c).isNull()).alias("violations")).select(F.lit(f"{table}.{c} not null").alias("rule"), "violations") for c in columns])


def rule_unique(df: DataFrame, table: str, *keys: str) -> DataFrame:
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("violations"))
    return repeated.select(F.lit(f"{table}({', '.join(keys)}) unique").alias("rule"), "violations")


def rule_references(child: DataFrame, parent: DataFrame, name: str, child_key: str, parent_key: str) -> DataFrame:
    """Children whose key isn't null and isn't a parent's."""
    there = parent.select(F.col(parent_key).alias(child_key)).distinct()
    missing = child.filter(F.col(child_key).isNotNull()).join(there, child_key, "left_anti")
    return missing.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("rule"), "violations")


def rule_check(df: DataFrame, name: str, condition: Column) -> DataFrame:
    return df.agg(F.count_if(~F.coalesce(condition, F.lit(True))).alias("violations")).select(F.lit(name).alias("rule"), "violations")


def bad_oof(oof: DataFrame, memberships: DataFrame, results: DataFrame) -> DataFrame:
    """Out-of-fold rows whose run isn't in the fold's test side, whose observed value isn't the stored one, or whose
    prediction isn't finite."""
    inside = memberships.filter(F.col("split") == "test").select("fold_id", "run_id").distinct().withColumn("_in", F.lit(True))
    wide = oof.join(inside, ["fold_id", "run_id"], "left").join(results.select("run_id", "node_id", F.col("vol").alias("_stored")), ["run_id", "node_id"], "left")
    fine = F.col("_in").isNotNull() & F.col("_stored").eqNullSafe(F.col("observed")) & as_number(F.col("predicted")).isNotNull()
    return wide.filter(~fine).drop("_in", "_stored")


def guarded_append(current: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Current rows and the batch; the batch may not hold a key that is there already (evidence is append-only)."""
    raise_if_any(batch.join(current.select(*keys), list(keys), "left_semi").select(*keys), "rows exist already")
    return current.unionByName(batch)


def hash_mismatches(networks: DataFrame, content: str, digest: str) -> DataFrame:
    """Rows whose stored digest isn't the content's SHA-256."""
    return networks.filter(F.sha2(F.col(content), 256) != F.lower(F.col(digest)))


def base_guards(networks: DataFrame) -> DataFrame:
    """network_id, level, rule of base inputs that shouldn't be run: errors for flow units other than LPS and for contents
    whose MD5 isn't the expected one (unless overridden), a warning where ponding is allowed. networks: network_id,
    flow_units, ponding, content, expected_md5, overridden."""
    units = ~F.coalesce(F.upper(F.trim("flow_units")) == "LPS", F.lit(False))
    differs = ~F.md5(F.col("content").cast("binary")).eqNullSafe(F.lower("expected_md5")) & ~F.coalesce("overridden", F.lit(False))
    found = F.array(*[F.when(bad, F.struct(F.lit(level).alias("level"), F.lit(rule).alias("rule"))) for bad, level, rule in ((units, "error", "flow_units"), (differs, "error", "content"), (F.coalesce("ponding", F.lit(False)), "warning", "ponding"))])
    return networks.select("network_id", F.explode(F.array_compact(found)).alias("r")).select("network_id", "r.level", "r.rule")


def low_multipliers(df: DataFrame, multiplier: str, least: float) -> DataFrame:
    """Rows whose multiplier is missing, not a number or under the least."""
    return df.filter(~F.coalesce(as_number(F.col(multiplier)) >= least, F.lit(False)))


def other_definitions(parts: DataFrame, manifest: DataFrame, part: str, definition: str) -> DataFrame:
    """Parts of a prepared set that were made by another definition than the manifest's, or by none."""
    wanted = manifest.select(F.col(part), F.col(definition).alias("_wanted"))
    return parts.join(wanted, part, "left").filter(~F.col(definition).eqNullSafe(F.col("_wanted"))).drop("_wanted")
