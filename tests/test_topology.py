"""A network's topology as one operation, and distances by doubling."""

import pytest

from freshet.operators import graph as G

LINK = "link_id string, from_node string, to_node string, kind string, diameter double, length double, roughness double, in_offset double, out_offset double"
NODE = "node_id string, kind string, elevation double, depth double, base double"


def test_topology(spark):
    nodes = spark.createDataFrame([("a", "junction", 10.0, 2.0, 1.5), ("b", "junction", 10.0, 1.0, None), ("c", "outfall", 9.0, None, None)], NODE)
    rows = [("1", "a", "b", "conduit", 0.4, 10.0, 0.013, 0.0, 0.0), ("2", "b", "c", "conduit", 0.5, 100.0, 0.013, 0.0, 0.0), ("3", "c", "b", "conduit", 0.3, 50.0, 0.013, 0.0, 0.0), ("4", "x", "b", "pump", None, None, None, 0.0, 0.0)]
    got = G.topology(nodes, spark.createDataFrame(rows, LINK))
    links = {r["link_id"]: r for r in got.links.collect()}
    # flat: a slope of 0 and no capacity; uphill: the slope keeps its sign and its size carries; an unknown end: no slope
    assert (links["1"]["slope_m_per_m"], links["1"]["capacity_lps"]) == (0.0, None)
    assert links["3"]["slope_m_per_m"] == -0.02 and links["3"]["capacity_lps"] > 0
    assert (links["4"]["slope_m_per_m"], links["4"]["link_type"]) == (None, "pump")
    b = got.nodes.filter("node_id = 'b'").first()
    assert (b["upstream_pipes"], b["downstream_pipes"], b["upstream_diam_max_m"], b["upstream_slope_max"]) == (3, 1, 0.4, 0.02)
    assert b["upstream_capacity_lps"] == links["3"]["capacity_lps"] and b["base_inflow_lps"] == 0.0
    a = got.nodes.filter("node_id = 'a'").first()
    assert (a["upstream_pipes"], a["upstream_diam_max_m"], a["downstream_capacity_lps"]) == (0, None, None)
    assert got.depths.first()["n"] == 2


def test_topology_of_nothing(spark):
    got = G.topology(spark.createDataFrame([], NODE), spark.createDataFrame([], LINK))
    assert (got.nodes.count(), got.links.count(), got.depths.first()["n"]) == (0, 0, 0)


def test_both_ends_are_one_exchange_of_links(spark):
    nodes = spark.createDataFrame([("a", "junction", 1.0, 1.0, 0.0)], NODE)
    links = spark.createDataFrame([("1", "a", "a", "conduit", 0.4, 10.0, 0.013, 0.0, 0.0)], LINK)
    plan = G.topology(nodes, links).nodes._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [node_id") == 1


def edges(spark, rows):
    return spark.createDataFrame(rows, "from_node string, to_node string, length double")


def ids(spark, text):
    return spark.createDataFrame([(x,) for x in text], "node_id string")


def test_distances_by_doubling(spark):
    # a chain of nine edges, an outfall with an edge below it, a cycle, a dead end, and a node without edges
    chain = [(chr(97 + k), chr(98 + k), float(k)) for k in range(9)]
    e = edges(spark, [*chain, ("j", "k", 5.0), ("x", "y", 1.0), ("y", "x", 1.0), ("w", "x", 1.0), ("u", "v", 1.0), ("t", "j", None)])
    got = dict(map(tuple, G.distance_in_forest(ids(spark, "abijkxywuvtz"), e, ids(spark, "jj")).collect()))
    assert got == {"a": 36.0, "b": 36.0, "i": 8.0, "j": 0.0, "k": None, "x": None, "y": None, "w": None, "u": None, "v": None, "t": 0.0, "z": None}
    tree = edges(spark, chain)
    assert sorted(map(tuple, G.distance_in_forest(ids(spark, "abcdefghij"), tree, ids(spark, "j")).collect())) == sorted(map(tuple, G.distance_to_outfall(ids(spark, "abcdefghij"), tree, ids(spark, "j")).collect()))


def test_distances_refuse_what_they_cannot_tell(spark):
    with pytest.raises(ValueError, match="several ways down"):
        G.distance_in_forest(ids(spark, "a"), edges(spark, [("a", "b", 1.0), ("a", "c", 1.0)]), ids(spark, "b"))
    with pytest.raises(Exception, match="below 0"):
        G.distance_in_forest(ids(spark, "a"), edges(spark, [("a", "b", -1.0)]), ids(spark, "b"))
