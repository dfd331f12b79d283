"""What small operators and readers do with input that is missing, unknown or empty."""

import pytest
from pyspark.sql import functions as F

from freshet.functions import scalars as S
from freshet.operators import features as X
from freshet.operators import folds as D
from freshet.operators import relations as R
from freshet.operators.validation import RuleError
from freshet.sources import network_text as N
from freshet.sources import sinks, tables


def modes(spark, names, *otherwise):
    return [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(S.scenario_mode(F.col("n"), *otherwise)).collect()]


def test_scenario_modes(spark):
    assert modes(spark, [" Hidrograma ", "TIME-SERIES", "Baseline_Inflow", "steady", None]) == ["timeseries", "timeseries", "steady", "steady", None]
    assert modes(spark, [None], F.lit("steady")) == ["steady"]
    with pytest.raises(Exception, match="no such scenario mode: tidal"):
        modes(spark, ["tidal"])


def test_steady_rows(spark):
    nodes = spark.createDataFrame([("a", 1, 7), ("a", 2, 8), ("b", 3, 9)], "node_id string, ord int, x int")
    by = spark.createDataFrame([(1.0,), (2.0,)], "inflow_multiplier double")
    got = X.steady_prediction_rows(nodes, by, nodes.filter("node_id = 'a'"))
    assert sorted((r["node_id"], r["x"], r["inflow_multiplier"], r["spatial_pattern"]) for r in got.collect()) == [("a", 7, 1.0, "selected_nodes"), ("a", 7, 2.0, "selected_nodes")]
    assert {r["spatial_pattern"] for r in X.steady_prediction_rows(nodes, by).collect()} == {"all_nodes"}
    with pytest.raises(RuleError):
        X.steady_prediction_rows(nodes, by, spark.createDataFrame([("z",)], "node_id string"))


def test_scenario_input(spark):
    both = spark.createDataFrame([(1.0, 2.0)], "delta_inflow_lps double, inflow_multiplier double")
    assert (X.scenario_input(both), X.scenario_input(both.drop("inflow_multiplier"))) == ("inflow_multiplier", "delta_inflow_lps")
    with pytest.raises(ValueError):
        X.scenario_input(spark.range(1))


def test_first_seen(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3), (None, 0), ("c", 2)], "k string, at int")
    # keys that are met at the same place follow their own order
    assert sorted(R.first_seen(df, "k", "at").collect(), key=lambda r: r["position"]) == [(None, 0), ("b", 1), ("a", 2), ("c", 3)]
    assert R.first_seen(df.limit(0), "k", "at").count() == 0


def test_orders_that_differ(spark):
    df = spark.createDataFrame([(1, 2), (2, 1), (3, 3)], "a int, b int")
    assert sorted(tuple(r) for r in D.order_parity(df, ["a"], ["b"]).select("a", "position_a", "position_b").collect()) == [(1, 0, 1), (2, 1, 0), (3, 2, 2)]


def test_expected_nodes(spark):
    flows = spark.createDataFrame([("f", "a", "S1"), ("f", "b", None), ("f", "a", "S2")], "file string, node_id string, series string")
    assert [tuple(r) for r in N.expected_nodes(flows).collect()] == [("f", "a")]
    with pytest.raises(RuleError):
        N.expected_nodes(flows.union(spark.createDataFrame([("g", "c", None)], flows.schema)))


def test_shapes_need_points(spark, tmp_path):
    (tmp_path / "flat top.csv").write_text("time_h,q_norm\n0,0.5\n1,1\n")
    assert [tuple(r) for r in tables.read_shapes(spark, f"file://{tmp_path}").orderBy("time_h").collect()] == [("flat top", 0.0, 0.5), ("flat top", 1.0, 1.0)]
    (tmp_path / "empty.csv").write_text("time_h,q_norm\n")
    with pytest.raises(RuleError, match="no points"):
        tables.read_shapes(spark, f"file://{tmp_path}")


def test_inflow_file(spark, tmp_path):
    shape = spark.createDataFrame([(0.0, 0.0), (0.5, 1.0), (1.25, 0.1)], "time_h double, q_norm double")
    nodes = spark.createDataFrame([("b", 2.0), ("a", 1.0), ("dry", 0.0), ("none", None)], "node_id string, base double")
    path = sinks.write_inflow_file(shape, nodes, 1.5, f"file://{tmp_path}", "click")
    assert path.endswith("/click_f1.500.csv")
    assert (tmp_path / "click_f1.500.csv").read_text().splitlines() == ["node_id,time,value_lps", "a,0:00,0.0", "a,0:30,1.5", "a,1:15,0.15", "b,0:00,0.0", "b,0:30,3.0", "b,1:15,0.3"]
    with pytest.raises(ValueError, match="positive base"):
        sinks.write_inflow_file(shape, nodes.filter("base = 0"), 1.5, f"file://{tmp_path}", "click")
