"""Work that grows with the input: no folder a run, no pairs of a recipe, no task that holds a group."""

import glob
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from freshet import session
from freshet.operators import datasets as D
from freshet.operators import evidence as E
from freshet.operators import ranks
from freshet.operators import trials as L
from freshet.operators import validation as V
from freshet.plans import bindings as B
from freshet.sources import sinks, tables


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_series_have_no_folder_a_run(spark, tmp_path):
    kinds = [c.split(" ") for c in tables.SERIES.split(", ")]
    series = spark.range(600).select(*[(F.concat(F.lit("r"), (F.col("id") % 300).cast("string")) if n == "run_id" else F.col("id").cast(t)).alias(n) for n, t in kinds])
    path = f"{tmp_path}/series"
    sinks.write_series(series, f"file://{path}")
    assert len(glob.glob(f"{path}/**/*.parquet", recursive=True)) <= 4
    back = tables.read_runs(spark, f"file://{path}")
    assert back.columns == [n for n, _ in kinds] and sorted(back.collect()) == sorted(series.collect())
    assert sorted(r["step_index"] for r in tables.read_runs(spark, f"file://{path}", ["r7", "r299"]).collect()) == [7, 299, 307, 599]


RECIPES = "candidate_id long, a string, b string"


def recipes(spark):
    candidates = spark.createDataFrame([(1, "x", "y"), (1, "x", "z"), (2, "x", None), (3, "x", "y"), (4, "q", "q"), (5, "x", "y")], RECIPES)
    artifacts = spark.createDataFrame([(10, "x", "y"), (11, "x", "y"), (12, "x", "z"), (12, "x", "z"), (13, "x", None)], RECIPES.replace("candidate", "model"))
    return candidates, candidates.filter("candidate_id <> 3"), artifacts


def test_unmatched_links_make_no_pairs(spark):
    candidates, done, artifacts = recipes(spark)
    links = spark.createDataFrame([(1, 10), (1, 12), (1, 12), (1, 13), (2, 13), (3, 10), (4, 10), (5, 11), (5, 12), (5, 12), (6, 10), (None, 10), (1, None)], "candidate_id long, model_id long")
    got = E.links_off_recipe(links, candidates, done, artifacts, ["a", "b"])
    want = E.unmatched_links(links, E.recipe_matches(candidates, done, artifacts, ["a", "b"]))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 9
    n = 3000  # one recipe for all: pairs would be n * n
    many = spark.range(n).select(F.col("id").alias("candidate_id"), F.lit("x").alias("a"), F.lit("y").alias("b"))
    all_links = many.select("candidate_id", ((F.col("candidate_id") * 7) % (2 * n)).alias("model_id"))
    off = E.links_off_recipe(all_links, many, many, many.withColumnRenamed("candidate_id", "model_id"), ["a", "b"])
    assert off.count() == all_links.filter(f"model_id >= {n}").count()
    assert all("model_id" in keys for keys in re.findall(r"Join \[([^\]]*)\]", physical(off)) if "a#" in keys)


def test_recipe_counts_make_no_pairs(spark):
    candidates, done, artifacts = recipes(spark)
    want = E.recipe_matches(candidates, done, artifacts, ["a", "b"]).groupBy("candidate_id").agg(F.count(F.lit(1)).alias("n"), F.min("model_id").alias("least"), F.max("model_id").alias("most"))
    got = E.recipe_counts(candidates, done, artifacts, ["a", "b"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) == [(1, 4, 10, 12), (5, 2, 10, 11)]
    many = spark.range(50_000).select(F.col("id").alias("candidate_id"), F.lit("x").alias("a"), F.lit("y").alias("b"))  # 2.5e9 pairs
    assert E.recipe_counts(many, many, many.withColumnRenamed("candidate_id", "model_id"), ["a", "b"]).filter("n = 50000 AND least = 0 AND most = 49999").count() == 50_000


def test_left_out_predictions_shuffle_no_rows(spark):
    rows = spark.range(40).selectExpr("cast(id % 2 as string) AS g", "cast(id as double) AS x", "cast(3 * id + 1 as double) AS y")
    got = L.left_out_predictions(rows, "g", ["x"], "y")
    assert "SortMergeJoin" not in physical(got) and "hashpartitioning" not in physical(got)
    assert all(abs(r["y"] - r["prediction"]) < 1e-6 for r in got.collect())


def test_one_file_is_found_by_many_tasks(spark, tmp_path):
    @F.udf("int")
    def task(_):
        from pyspark import TaskContext

        return TaskContext.get().partitionId()

    rows = spark.range(0, 400, 1, 4).select("id", task("id").alias("task"))
    path = sinks.export_file(rows, f"file://{tmp_path}/one.csv")
    got = spark.read.csv(path, header=True, inferSchema=True).collect()
    assert len({r["task"] for r in got}) == 4 and [r["id"] for r in got] == list(range(400))


def test_first_and_peak_are_found_before_the_shuffle(spark):
    runs = spark.createDataFrame([("n", 2.0, 1), ("n", 1.0, 9), ("n", 1.0, 4), ("n", None, 0), ("m", None, 3), (None, 5.0, 6)], "network string, multiplier double, run long")
    first = E.first_run(runs, "network", "multiplier", "run")
    assert sorted(map(str, map(tuple, first.collect()))) == sorted(map(str, [("n", 1.0, 4), ("m", None, 3), (None, 5.0, 6)]))
    series = spark.createDataFrame([(1, 7, 2.0), (1, 5, 2.0), (1, 4, 1.0), (2, 3, None), (2, 2, None), (3, 1, None), (3, 8, 0.5)], "run long, node long, v double")
    peak = D.peak_node(series, "run", "node", "v")
    assert sorted(map(tuple, peak.collect())) == [(1, 5, 2.0), (2, 2, None), (3, 8, 0.5)]
    assert "Window" not in physical(first) + physical(peak)


def test_samples_shuffle_lines_once(spark, data):
    assert len(re.findall(r"Exchange hashpartitioning\(l_orderkey", physical(B.samples(spark, data).groupBy("run_id").count()))) == 1


def test_numbers_of_some_tables(spark):
    flat = spark.createDataFrame([("h2", "a", "s", 1.0, 1), ("h1", "b", "s", 1.0, 2), ("h1", "a", "s", 2.0, 3)], "network_sha256 string, node_id string, shape_id string, factor_mult double, run_key long").withColumns({"x": F.lit(1), "y": F.lit(2)})
    some, whole = sinks.numbered(flat, ["nodes", "networks"], {}), sinks.backfill(flat, ["x"], ["y"])
    assert set(some) == {"nodes", "networks"}
    assert all(sorted(map(tuple, some[t].collect())) == sorted(map(tuple, whole[t].collect())) for t in some)


def test_numbers_follow_the_order_over_many_ranges(spark, monkeypatch):
    rows = spark.range(3000).selectExpr("nullif(cast(id * 7919 % 3001 % 40 as string), '7') AS g", "if(id % 50 = 1, double('NaN'), double(id)) AS x", "id").withColumn("x", F.when(F.col("id") % 60 > 1, F.col("x")))
    want = {(r["g"], str(r["x"]), r["id"]): k for k, r in enumerate(rows.orderBy("g", "x", "id").collect(), 8)}
    for part_rows in (100, 500_000):
        monkeypatch.setattr(ranks, "PART_ROWS", part_rows)
        got = ranks.numbered(session.kept(rows), ["g", "x", "id"], "n", 7)
        assert got.columns == ["g", "x", "id", "n"] and dict(got.dtypes)["n"] == "bigint"
        assert {(r["g"], str(r["x"]), r["id"]): r["n"] for r in got.collect()} == want
        assert not re.search("lambda|Window|Exchange", physical(got))
    assert ranks.numbered(session.kept(rows.filter("id < 0")), ["g", "x", "id"], "n").isEmpty()


FLAT = "network_sha256 string, shape_id string, factor_mult double, run_key string, node_id string, x int, y int"


def keyed(tables, first="node_features", value="x"):
    """Values beside the natural keys that their numbers stand for."""
    rows = tables[first].join(tables["nodes"], "node_pk").join(tables["runs"].withColumnRenamed("network_sha256", "net"), "run_id")
    assert rows.filter("NOT net <=> network_sha256").isEmpty()
    return sorted(str(tuple(r)) for r in rows.select("network_sha256", "shape_id", "factor_mult", "run_key", "node_id", value).collect())


def test_backfill_keeps_rows_without_a_key(spark):
    lines = [("h1", "s", 1.0, "r", "a", 1, 2), ("h1", None, 1.0, "r", "a", 3, 4), (None, None, None, None, None, 5, 6), (None, None, None, "r", None, 7, 8), ("h0", "s", 1.0, "r", "a", 9, 10)]
    flat = spark.createDataFrame(lines, FLAT)
    one = {n: session.kept(df) for n, df in sinks.backfill(flat, ["x"], ["y"]).items()}
    assert {n: df.count() for n, df in one.items()} == {"networks": 3, "nodes": 3, "scenarios": 4, "runs": 5, "node_features": 5, "node_results": 5}
    assert keyed(one) == sorted(str(r[:6]) for r in lines) and keyed(one, "node_results", "y") == sorted(str((*r[:5], r[6])) for r in lines)
    assert all(df.isEmpty() for df in sinks.backfill(flat, ["x"], ["y"], one).values())


def test_backfill_numbers_new_runs_behind_known_ones(spark):
    old = [("h1", s, f, k, n, 1, 2) for s in ("m", "q") for f in (1.0, 2.0) for k in ("r1", "r3") for n in "ab"]
    new = [("h0", "m", 1.0, "r9", "a", 3, 4), ("h1", "q", 2.0, "r2", "a", 3, 4), ("h1", "b", 2.0, "r5", "c", 3, 4), ("h1", "m", 1.0, "r2", "b", 3, 4), ("h1", "q", 2.0, "r3", "c", 3, 4)]
    one = {n: session.kept(df) for n, df in sinks.backfill(spark.createDataFrame(old, FLAT), ["x"], ["y"]).items()}
    more = sinks.backfill(spark.createDataFrame(old[:9] + new, FLAT), ["x"], ["y"], one)
    natural = lambda df, key: [tuple(r) for r in df.orderBy(key).drop("scenario_id" if key == "run_id" else "", "status").collect()]
    assert natural(more["networks"], "network_id") == [("h0", 2)] and natural(more["scenarios"], "scenario_id") == [("h0", "m", 1.0, 5), ("h1", "b", 2.0, 6)]
    assert natural(more["runs"], "run_id") == [("h0", "m", 1.0, "r9", 9), ("h1", "b", 2.0, "r5", 10), ("h1", "m", 1.0, "r2", 11), ("h1", "q", 2.0, "r2", 12)]
    assert natural(more["nodes"], "node_pk") == [("h0", "a", 3), ("h1", "c", 4)]
    assert all(a.columns == b.columns for a, b in zip(one.values(), more.values(), strict=True))
    whole = {n: df.unionByName(more[n]) for n, df in one.items()}
    assert keyed(whole) == sorted(str(r[:6]) for r in old + new) and whole["runs"].join(whole["scenarios"], ["network_sha256", "shape_id", "factor_mult", "scenario_id"]).count() == 12


def test_lookups_are_the_same_by_either_join(spark):
    left = spark.createDataFrame([("a", 1, "p"), (None, 1, "q"), (None, None, "r"), ("b", 2, "s"), ("b", None, "t")], "k string, j long, v string")
    table = spark.createDataFrame([("a", 1, 10), (None, 1, 20), (None, None, 30), ("c", 2, 40)], "k string, j long, n long")
    want = {"inner": [("p", 10), ("q", 20), ("r", 30)], "left": [("p", 10), ("q", 20), ("r", 30), ("s", None), ("t", None)], "left_anti": [("s",), ("t",)]}
    for how, rows in want.items():
        for most, join in ((4, "BroadcastHashJoin"), (3, "SortMergeJoin")):
            got = sinks.looked_up(left, table, ["k", "j"], "n", how=how, most=most).drop("k", "j")
            assert join in physical(got) and sorted(map(tuple, got.collect())) == rows


def test_backfill_shuffles_numbers_only(spark, data, monkeypatch):
    from freshet.plans import files, registry

    registry.load()
    written = []
    for module in (files, sinks, ranks):
        monkeypatch.setattr(module, "kept", lambda df: written.append(df) or session.kept(df))
    assert {r["table"]: r["added_again"] for r in registry.QUERIES["snk13_backfill"](spark, data).collect()} == dict.fromkeys([*sinks.DIMENSIONS, "node_features", "node_results"], 0)
    assert sum({"network_sha256", "vol"} <= set(df.columns) for df in written) == 1
    rows = [df for df in written if "vol" in df.columns and "run_id" in df.columns]
    assert rows and not any(re.search(r"(hashpartitioning|SortMergeJoin)[^\n]*(sha256|shape_id)", physical(df)) for df in rows)


def test_percentiles_shuffle_only_parts_that_hold_them(spark):
    rows = spark.range(20_000).select((F.col("id") % 2).cast("string").alias("k"), F.when(F.col("id") % 11 > 0, F.expr("cast((id * 7919) % 20011 as double)")).alias("v"), (F.col("id") % 3).alias("w"))
    rows = rows.unionByName(spark.sql("SELECT null AS k, 5.0D AS v, 1L AS w UNION ALL SELECT null, 6.0D, 1L"))
    at = (0.0, 0.25, 0.5, 0.99, 1.0)
    plain, weighted = ranks.percentiles(rows, "k", "v", at), ranks.percentiles(rows, "k", "v", at, weight="w")
    assert "BroadcastHashJoin [_key" in physical(plain)
    found = rows.filter("v IS NOT NULL").collect()
    for got, times in ((plain, lambda r: 1), (weighted, lambda r: r["w"])):
        for r in got.collect():
            values = [x["v"] for x in found if x["k"] == r["k"] for _ in range(times(x))]
            assert r["q"] == pytest.approx([float(np.percentile(values, 100 * p)) for p in at])
    assert plain.count() == 3


def test_parts_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(session, "PART_ROWS", 100)
    assert session.dealt(spark.range(1000), "id").rdd.getNumPartitions() == 10
    assert session.dealt(spark.range(100), "id").rdd.getNumPartitions() == 4


def test_mismatches_are_dealt_by_the_size_of_the_table(spark, data, monkeypatch):
    from freshet.plans import registry

    registry.load()
    monkeypatch.setattr(session, "PART_ROWS", 500)
    lines = spark.read.parquet(f"{data}/lineitem.parquet").count()
    assert f", {-(-lines // 500)}), REPARTITION_BY_NUM" in physical(registry.QUERIES["j3_key_mismatch"](spark, data))


ODD_AT = (0.0, 0.3, 0.5, 1.0)


def odd_values(spark):
    """Groups with a value that a third of the rows share, NaN and NULL, a NULL group, rows that come twice, one row, no value."""
    value = F.when(F.col("id") % 7 == 0, float("nan")).when(F.col("id") % 7 == 1, None).when(F.col("id") % 3 == 0, 0.0).otherwise(F.expr("cast((id * 7919) % 20011 - 9000 as double)"))
    rows = spark.range(20_000).select(F.when(F.col("id") % 4 > 0, (F.col("id") % 2).cast("string")).alias("k"), value.alias("v"))
    return rows.unionAll(rows).unionAll(spark.sql("SELECT 'one', -0.0D UNION ALL SELECT 'none', NULL"))


def linear_between_ranks(values, at):
    values = sorted(values, key=lambda v: (v != v, v))  # NaN is the greatest
    exact = [p * (len(values) - 1) for p in at]
    return [values[int(x)] + (values[-int(-x // 1)] - values[int(x)]) * (x % 1) for x in exact]


@pytest.mark.parametrize("part_rows", [session.PART_ROWS, 100])
@pytest.mark.parametrize("partitions", ["4", "200"])
def test_percentiles_cut_near_their_ranks(spark, monkeypatch, partitions, part_rows):
    rows, seen = odd_values(spark), []
    monkeypatch.setattr(ranks, "PART_ROWS", part_rows)
    monkeypatch.setattr(ranks, "bounds", lambda *a, f=ranks.bounds, **b: seen.append(f(*a, **b)) or seen[-1])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {r["k"]: r["q"] for r in ranks.percentiles(rows, "k", "v", ODD_AT).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    found = rows.filter("v IS NOT NULL").collect()
    assert set(got) == {None, "0", "1", "one"}
    for k, q in got.items():
        assert q == pytest.approx(linear_between_ranks([r["v"] for r in found if r["k"] == k], ODD_AT), nan_ok=True)
    assert 4 < len(seen[0]) <= 5 * len(ODD_AT) * 4  # a few a group and rank, whatever the number of partitions


def test_few_cuts_unless_groups_are_many(spark):
    rows = spark.range(20_000).select((F.col("id") % 500).cast("string").alias("k"), F.col("id").cast("double").alias("v"))
    assert len(ranks.bounds(rows, ["k", "v"], 8, shares=(0.5,))) == 7
    one = rows.withColumn("k", F.lit("all"))
    cuts = [v for _, v in ranks.bounds(one, ["k", "v"], 8, shares=(0.5,))]
    assert len(cuts) == 5 and cuts == sorted(cuts) and 9_000 < cuts[1] < 10_000 < cuts[3] < 11_000
    assert ranks.bounds(one.limit(0), ["k", "v"], 8, shares=(0.5,)) == []


@pytest.mark.parametrize("n", [1, 2, 3, 12, 64])
def test_a_search_written_out_finds_the_same_parts(spark, n):
    rows = odd_values(spark).unionByName(spark.sql("SELECT null AS k, cast(null AS double) AS v UNION ALL SELECT '1', 0.0D UNION ALL SELECT '1', double('-inf')"))
    cuts = ranks.bounds(rows, ["k", "v"], n + 1)
    cuts = [(None, None), *cuts, ("1", float("nan"))] if n == 12 else cuts
    parts = lambda w: ranks.part_of(rows, ["k", "v"], cuts, written_out=w)
    got = rows.select(parts(True).alias("a"), parts(False).alias("b"))
    assert got.filter("a IS DISTINCT FROM b").isEmpty() and got.select("a").distinct().count() > len(cuts) // 2


def test_percentiles_search_no_array_for_few_cuts(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        assert "lambdafunction" not in physical(ranks.percentiles(odd_values(spark), "k", "v", [0.5]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_percentiles_look_up_only_rows_of_parts_that_hold_them(spark):
    rows = spark.range(20_000).select((F.col("id") % 2).cast("string").alias("k"), F.expr("cast((id * 7919) % 20011 as double)").alias("v"))
    got = ranks.percentiles(rows, "k", "v", [0.5, 0.9])
    plan = physical(got)
    assert re.search(r"Filter [^\n]*struct\(k", plan[plan.index("BroadcastHashJoin [_key") :])
    found = rows.collect()
    assert {r["k"]: r["q"] for r in got.collect()} == {k: pytest.approx(linear_between_ranks([r["v"] for r in found if r["k"] == k], [0.5, 0.9])) for k in ("0", "1")}
    assert ranks.percentiles(rows.limit(0), "k", "v", [0.5]).isEmpty() and ranks.percentiles(rows.withColumn("v", F.lit(None).cast("double")), "k", "v", [0.5]).isEmpty()
