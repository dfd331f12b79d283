"""Reviews, reports, backfills, single files and prepared sets by id."""

import os

import pytest
from pyspark.sql import functions as F

from freshet.operators import aggregates as A
from freshet.operators.review import review
from freshet.operators.validation import RuleError
from freshet.sources import reports, sinks, tables

HEADED = """  Some Other Summary
  ---
  Z9  1 2 3.0

  ***********************
  Node Flooding Summary
  ***********************

  Flooding is all water that leaves a node.
  --------------------------------------------------------------------------
                                                             Total   Maximum
                                 Maximum   Time of Max       Flood    Ponded
                        Hours       Rate    Occurrence      Volume    Volume
  Node                 Flooded       LPS   days hr:min    10^6 ltr   1000 m3
  --------------------------------------------------------------------------
  1C                      0.50     12.30      0  01:15       0.045     0.700
  J7                      2.25      9.00      1  11:05       1.250     0.000

  ***********************
  Node Outflow Summary
  ***********************
  X1  9 9 9.0
"""
PLAIN = "Node Flooding Summary\n---\n  J7    1.20    150.00    0   12.50    0.003\n  short 1\n  J8  a b c d\n\nOUTFALL LOADING\n  J9 1 1 1 5.0\n"


def test_heads_name_the_columns():
    assert reports.parse_flooding(HEADED) == [("1C", 45.0, 30.0, "heads"), ("J7", 1250.0, 135.0, "heads")]


@pytest.mark.parametrize("text,want", [(PLAIN, [("J7", 3.0, None, "last column")]), ("", []), ("no table here\n1 2 3 4", []), ("Node Flooding Summary\n***\n", [])])
def test_fallback_and_reports_without_rows(text, want):
    assert [(n, round(v, 9), d, m) for n, v, d, m in reports.parse_flooding(text)] == want


def test_files_are_read_one_by_one(spark, tmp_path):
    for name, text in (("a.rpt", HEADED), ("b.rpt", PLAIN), ("c.rpt", "")):
        (tmp_path / name).write_text(text)
    got = reports.flooding_volumes(spark, f"file://{tmp_path}/*.rpt").withColumn("file", F.regexp_extract("file", r"([^/]+)$", 1))
    assert {(r["file"], r["node_id"]): (round(r["flooding_volume_m3"], 9), r["flooding_duration_min"]) for r in got.collect()} == {("a.rpt", "1C"): (45.0, 30.0), ("a.rpt", "J7"): (1250.0, 135.0), ("b.rpt", "J7"): (3.0, None)}
    nodes = spark.createDataFrame([("a.rpt", "1C"), ("a.rpt", "K"), ("b.rpt", "J7")], "file string, node_id string")
    assert {r["node_id"]: (round(r["vol_inundacion_m3"], 6), r["inunda"]) for r in reports.labelled(nodes, got, 3.5).collect()} == {"1C": (45.0, 1), "K": (0.0, 0), "J7": (3.0, 0)}


def test_a_file_appears_at_once(spark, tmp_path):
    path = f"file://{tmp_path}/samples.csv"
    sinks.export_file(spark.range(3).toDF("a"), path)
    assert (tmp_path / "samples.csv").read_text() == "a\n0\n1\n2\n"
    sinks.export_file(spark.range(2).toDF("b"), path)
    assert (tmp_path / "samples.csv").read_text() == "b\n0\n1\n"
    failing = spark.range(5).select(F.when(F.col("id") < 3, F.col("id")).otherwise(F.raise_error(F.lit("stop")).cast("long")).alias("b"))
    with pytest.raises(Exception, match="stop"):
        sinks.export_file(failing, path)
    assert (tmp_path / "samples.csv").read_text() == "b\n0\n1\n"
    assert [n for n in os.listdir(tmp_path) if not n.endswith(".crc")] == ["samples.csv"]


def flat(spark, shapes, factors):
    rows = [("net", s, f, f"{s}-{f}", f"n{k}", k * 1.0, int(k > 1), f * k) for s in shapes for f in factors for k in range(4)]
    return spark.createDataFrame(rows, "network_sha256 string, shape_id string, factor_mult double, run_key string, node_id string, depth double, inunda int, vol double")


def test_backfill(spark):
    one = sinks.backfill(flat(spark, ["base", "storm"], [1.0, 2.0, 3.0]), ["depth"], ["inunda", "vol"])
    assert {n: df.count() for n, df in one.items()} == {"networks": 1, "nodes": 4, "scenarios": 6, "runs": 6, "node_features": 24, "node_results": 24}
    assert sorted(r["run_id"] for r in one["runs"].collect()) == list(range(1, 7)) and one["runs"].select("status").distinct().first()[0] == "COMPLETE"
    assert one["node_results"].join(one["runs"], "run_id", "left_anti").isEmpty() and one["node_results"].join(one["nodes"], "node_pk", "left_anti").isEmpty()
    again = sinks.backfill(flat(spark, ["base", "storm"], [1.0, 2.0, 3.0]), ["depth"], ["inunda", "vol"], one)
    assert all(df.isEmpty() for df in again.values())
    more = sinks.backfill(flat(spark, ["storm", "late"], [3.0, 4.0]), ["depth"], ["inunda", "vol"], one)
    assert {n: df.count() for n, df in more.items()} == {"networks": 0, "nodes": 0, "scenarios": 3, "runs": 3, "node_features": 12, "node_results": 12}
    assert sorted(r["scenario_id"] for r in more["scenarios"].collect()) == [7, 8, 9]


def test_prepared_sets_by_id(spark, tmp_path):
    frame = spark.range(1)
    for prep in ("first", "second"):
        sinks.write_prepared(tables.Prepared(frame, frame, frame, frame, {"prep_id": prep}), f"file://{tmp_path}/{prep}")
        stamp = {"first": 1_000_000, "second": 2_000_000}[prep]
        for part in (tmp_path / prep / "manifest").glob("part-*"):
            os.utime(part, (stamp, stamp))
    where = f"file://{tmp_path}"
    assert tables.resolve_prepared(spark, where).endswith("/second") and tables.resolve_prepared(spark, where, "first").endswith("/first")
    assert tables.read_prepared(spark, tables.resolve_prepared(spark, where, "first")).manifest == {"prep_id": "first"}
    with pytest.raises(FileNotFoundError, match="third"):
        tables.resolve_prepared(spark, where, "third")


def test_review_equals_the_single_summaries(spark, tmp_path):
    rows = [(k % 5 or None, f"n{k % 3}", float(k % 7) if k % 4 else None, "x") for k in range(60)]
    df = spark.createDataFrame(rows, "run_id int, node_id string, vol double, note string")
    got = review(df, f"file://{tmp_path}/data", ["run_id", "node_id"], ["vol"])
    assert {r["column"]: (r["dtype"], r["non_null"], r["unique"]) for r in got.columns().collect()} == {r["column"]: (r["dtype"], r["non_null"], r["unique"]) for r in A.column_profile(df).collect()}
    assert {r["column"]: r["missing"] for r in got.columns().collect()} == {r["column"]: r["missing"] for r in A.missing_by_column(df).collect()}
    assert got.target_summary().first().asDict() == pytest.approx(A.describe_targets(df, ["vol"]).first().asDict())
    assert [tuple(r) for r in got.group_sizes("node_id").collect()] == [tuple(r) for r in A.group_sizes(df, "node_id").collect()]
    assert got.duplicates().first()["duplicate_rows"] == 60 - df.select("run_id", "node_id").distinct().count()
    assert spark.read.parquet(f"file://{tmp_path}/data").exceptAll(df).isEmpty()
    assert "FileScan" not in got.values._jdf.queryExecution().executedPlan().toString()  # the grouping is there already


def test_review_of_nothing(spark, tmp_path):
    got = review(spark.createDataFrame([], "a int, v double"), f"file://{tmp_path}/data", ["a"], ["v"])
    assert got.sums["rows"] == 0 and got.columns().isEmpty() and got.duplicates().first()["duplicate_rows"] == 0 and got.target_summary().first()["n"] == 0


@pytest.mark.parametrize("changes,error", [([(1, "RUNNING")], None), ([(2, "COMPLETE"), (1, "RUNNING")], None), ([(1, "COMPLETE")], "can't change"), ([(3, "RUNNING")], "can't change"), ([(9, "RUNNING")], "can't change"), ([(1, None)], "can't change"), ([(2, "COMPLETE"), (2, "FAILED")], "more than once")])
def test_status_updates_are_guarded(spark, changes, error):
    runs = spark.createDataFrame([(1, "PENDING"), (2, "RUNNING"), (3, "COMPLETE")], "run_id int, status string")
    asked = spark.createDataFrame(changes, "run_id int, status string")
    if error:
        with pytest.raises(RuleError, match=error):
            sinks.updated_status(runs, asked)
    else:
        assert {r["run_id"]: r["status"] for r in sinks.updated_status(runs, asked).collect()} == {1: "PENDING", 2: "RUNNING", 3: "COMPLETE"} | dict(changes)
