"""Queries of time series, shapes and drainage networks."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.operators import folds as D
from freshet.operators import graph as G
from freshet.operators import timeseries as T
from freshet.plans import bindings as B
from freshet.plans.registry import query
from freshet.session import read_table
from freshet.streaming import events as E

EV = f"WITH {B.EVENTS} "
GRID = f"{B.EVENTS}, g AS (SELECT user_id, unnest(generate_series(min(t), max(t), 60)) AS t FROM series GROUP BY user_id), filled AS (SELECT g.user_id, CAST(g.t AS INTEGER) AS t, last_value(s.value IGNORE NULLS) OVER (PARTITION BY g.user_id ORDER BY g.t) AS value FROM g LEFT JOIN series s ON s.user_id = g.user_id AND s.t = g.t)"
CLOSURE = f"WITH RECURSIVE {B.EDGES}, reach(ancestor, node) AS (SELECT from_node, to_node FROM edges UNION SELECT r.ancestor, e.to_node FROM reach r JOIN edges e ON e.from_node = r.node) "


def filled(spark, sf):
    return T.resample(B.series(spark, sf), ["user_id"], "t", B.STEP, ["value"])


@query("w1_sample_index", f"WITH {B.SAMPLES} SELECT run_id, node_id, row_number() OVER (ORDER BY run_id, node_id) - 1 AS sample_idx FROM samples")
def w1(spark, sf):
    return D.sample_index(B.samples(spark, sf).select("run_id", "node_id"), "run_id", "node_id")


@query("w2_keep_last", EV + "SELECT user_id, t, event_id, event_type, value FROM series")
def w2(spark, sf):
    return B.series(spark, sf).select("user_id", "t", "event_id", "event_type", "value")


@query("w3_ffill", EV + "SELECT user_id, t, last_value(CASE WHEN event_id % 3 = 0 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t) AS value FROM series")
def w3(spark, sf):
    s = B.series(spark, sf).select("user_id", "t", F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("value"))
    return T.forward_fill(s, ["user_id"], "t", ["value"])


@query("w5_depth_rate", EV + ", d AS (SELECT user_id, value - lag(value) OVER w AS rise, t - lag(t) OVER w AS gap, row_number() OVER w AS n FROM series WINDOW w AS (PARTITION BY user_id ORDER BY t)) SELECT user_id, greatest(coalesce(max(rise / dt), 0), 0) AS depth_rate FROM (SELECT *, min(CASE WHEN n = 2 THEN gap END) OVER (PARTITION BY user_id) AS dt FROM d) GROUP BY user_id")
def w5(spark, sf):
    return T.depth_rate(B.series(spark, sf), "user_id", "t", "value")


@query("t2_resample", f"WITH {GRID} SELECT user_id, t, value FROM filled WHERE value IS NOT NULL")
def t2(spark, sf):
    return filled(spark, sf)


@query("t3_windows", f"WITH {GRID}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n, list(value) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS xs, max(value - 60) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN 4 FOLLOWING AND 5 FOLLOWING) AS y FROM filled) SELECT user_id, t AS start, round(list_sum(xs), 6) AS sum_x, CAST(y > 0 AS INTEGER) AS label, y FROM n WHERE i % 3 = 0 AND i + 6 <= n")
def t3(spark, sf):
    s = filled(spark, sf).withColumn("over", F.col("value") - 60)
    got = T.sliding_windows(s, ["user_id"], "t", ["value"], "over", width=4, horizon=2, stride=3)
    total = F.aggregate("sequence", F.lit(0.0), lambda a, x: a + x[0])
    return got.select("user_id", "start", F.round(total, 6).alias("sum_x"), "label", "y")


@query("t4_interpolate", EV + ", q AS (SELECT DISTINCT user_id, t + 20 AS t FROM series), a AS (SELECT q.user_id, q.t, (SELECT max(s.t) FROM series s WHERE s.user_id = q.user_id AND s.t <= q.t) AS t0, (SELECT min(s.t) FROM series s WHERE s.user_id = q.user_id AND s.t >= q.t) AS t1 FROM q) SELECT a.user_id, a.t, round(CASE WHEN t1 IS NULL THEN x.value ELSE x.value + (y.value - x.value) * (a.t - t0) / (t1 - t0) END, 7) AS value FROM a JOIN series x ON x.user_id = a.user_id AND x.t = t0 LEFT JOIN series y ON y.user_id = a.user_id AND y.t = t1")
def t4(spark, sf):
    s = B.series(spark, sf)
    return T.interpolate(s, s.select("user_id", (F.col("t") + 20).alias("t")).distinct(), ["user_id"], "t", "value").withColumn("value", F.round("value", 7))


@query("t5_integrate", EV + ", d AS (SELECT user_id, value, (t - coalesce(lag(t) OVER (PARTITION BY user_id ORDER BY t), 0)) * 60 AS dt FROM series) SELECT user_id, round(coalesce(sum(CASE WHEN dt > 0 THEN value * dt END) / 1000, 0), 6) AS volume_m3 FROM d GROUP BY user_id")
def t5(spark, sf):
    s = B.series(spark, sf).withColumn("sec", F.col("t") * 60)
    return T.integrate_m3(s, "user_id", "sec", "value").withColumn("volume_m3", F.round("volume_m3", 6))


_SHAPES = "shapes AS (SELECT event_type AS shape_id, CAST(t % 1440 AS INTEGER) // 60 AS time_h, CAST(sum(CAST(floor(value) AS BIGINT)) AS DOUBLE) AS q FROM ev GROUP BY 1, 2)"


def shapes(spark, sf):
    return B.events(spark, sf).groupBy(F.col("event_type").alias("shape_id"), F.floor(F.col("t") % 1440 / 60).cast("int").alias("time_h")).agg(F.sum(F.floor("value").cast("long")).cast("double").alias("q"))


@query("t8_shape_stats", EV + f", {_SHAPES} SELECT shape_id, max(time_h) AS duration, min(time_h) FILTER (q = m) AS time_to_peak FROM (SELECT *, max(q) OVER (PARTITION BY shape_id) AS m FROM shapes) GROUP BY shape_id")
def t8(spark, sf):
    return T.shape_stats(shapes(spark, sf), "shape_id", "time_h", "q")


@query("t9_apply_shape", EV + f", {_SHAPES}, n AS (SELECT shape_id, time_h, q / max(q) OVER (PARTITION BY shape_id) AS q_norm FROM shapes) SELECT s_suppkey AS node_id, shape_id, time_h, f AS factor_mult, s_acctbal * f * q_norm AS flow FROM supplier, n, (VALUES (1e0), (2e0)) v(f) WHERE s_acctbal > 0")
def t9(spark, sf):
    nodes = read_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("node_id"), F.col("s_acctbal").alias("base"))
    factors = spark.range(1, 3).select(F.col("id").cast("double").alias("factor_mult"))
    return T.apply_shape(T.normalised(shapes(spark, sf), "shape_id", "q").drop("q"), nodes, factors)


@query("t10_normalise", EV + f", {_SHAPES} SELECT shape_id, time_h, q, q / max(q) OVER (PARTITION BY shape_id) AS q_norm FROM shapes")
def t10(spark, sf):
    return T.normalised(shapes(spark, sf), "shape_id", "q")


def scaled(spark, sf, chosen):
    k = F.col("s_suppkey")
    inflows = read_table(spark, sf, "supplier").filter(chosen).select(k.alias("node_id"), F.when(k % 2 == 0, "click").otherwise("view").alias("series"))
    points = shapes(spark, sf).select(F.col("shape_id").alias("series"), F.col("time_h").alias("t"), F.col("q").alias("value"))
    return T.scale_series(inflows, points, 1.5)


@query("t11_scale_series", EV + f", {_SHAPES} SELECT s_suppkey AS node_id, shape_id || '__scaled_' || s_suppkey AS new_series, time_h AS t, q * 1.5e0 AS value FROM supplier JOIN shapes ON shape_id = CASE WHEN s_suppkey % 2 = 0 THEN 'click' ELSE 'view' END")
def t11(spark, sf):
    return scaled(spark, sf, F.lit(True))


@query("t11_scale_series_all", EV + f", {_SHAPES} SELECT s_suppkey AS node_id, shape_id || '__scaled_' || s_suppkey AS new_series, time_h AS t, q * 1.5e0 AS value FROM supplier JOIN shapes ON shape_id = CASE WHEN s_suppkey % 2 = 0 THEN 'click' ELSE 'view' END")
def t11_all(spark, sf):
    return scaled(spark, sf, F.lit(True))


@query("t14_drain_down", EV + f", {_SHAPES} SELECT shape_id, time_h, q FROM shapes UNION ALL SELECT shape_id, max(time_h) + 6, 0e0 FROM shapes GROUP BY shape_id")
def t14(spark, sf):
    return T.with_drain_down(shapes(spark, sf), "shape_id", "time_h", "q", 6)


@query("g2_ancestors", CLOSURE + "SELECT s_suppkey AS node_id, coalesce(n, 0) AS n_ancestors FROM supplier LEFT JOIN (SELECT node, count(*) AS n FROM reach GROUP BY node) ON node = s_suppkey")
def g2(spark, sf):
    return G.ancestor_counts(B.nodes(spark, sf), G.closure(B.edges(spark, sf)))


@query("g3_accumulate", CLOSURE + f", {B.NODES} SELECT node_id, q_peak + coalesce((SELECT sum(a.q_peak) FROM reach r JOIN nodes a ON a.node_id = r.ancestor WHERE r.node = nodes.node_id), 0) AS q_peak_acum FROM nodes")
def g3(spark, sf):
    return G.accumulate(B.nodes(spark, sf), G.closure(B.edges(spark, sf)), "q_peak")


@query("g4_dist_outfall", f"WITH RECURSIVE {B.EDGES}, d(node_id, distance) AS (SELECT CAST(0 AS BIGINT), 0e0 UNION ALL SELECT e.from_node, d.distance + e.length FROM d JOIN edges e ON e.to_node = d.node_id) SELECT s_suppkey AS node_id, min(distance) AS distance FROM supplier LEFT JOIN d ON node_id = s_suppkey GROUP BY 1")
def g4(spark, sf):
    return G.distance_to_outfall(B.nodes(spark, sf), B.edges(spark, sf), B.outfalls(spark))


@query("g4_forest_distance", f"WITH RECURSIVE {B.EDGES}, d(node_id, distance) AS (SELECT CAST(0 AS BIGINT), 0e0 UNION ALL SELECT s_suppkey, 0e0 FROM supplier WHERE s_suppkey = 5 UNION ALL SELECT e.from_node, d.distance + e.length FROM d JOIN edges e ON e.to_node = d.node_id WHERE e.from_node NOT IN (5, 7)) SELECT s_suppkey AS node_id, min(distance) AS distance FROM supplier LEFT JOIN d ON node_id = s_suppkey GROUP BY 1")
def g4_forest(spark, sf):
    """Two outfalls, of which one has an edge below it, and a branch (from 7 on) that is cut off."""
    ends = B.outfalls(spark).union(B.nodes(spark, sf).filter("node_id = 5").select("node_id"))
    return G.distance_in_forest(B.nodes(spark, sf), B.edges(spark, sf).filter("from_node <> 7"), ends)


def network(spark, sf):
    """The suppliers' network with links of several kinds, some without a length or a size; some nodes aren't listed."""
    k = F.col("from_node")
    links = B.edges(spark, sf).select(k.alias("link_id"), "from_node", "to_node", F.when(k % 10 == 3, "weir").otherwise("conduit").alias("kind"), F.when(k % 10 != 3, F.col("diameter")).alias("diameter"), F.when(k % 12 == 1, 0.0).otherwise(F.col("length")).alias("length"), "roughness", F.lit(0.5).alias("in_offset"), F.lit(0.25).alias("out_offset"))
    id_ = F.col("node_id")
    nodes = B.nodes(spark, sf).select("node_id", F.when(id_ == 0, "outfall").otherwise("junction").alias("kind"), "elevation", (id_ % 4).cast("double").alias("depth"), F.when(id_ % 3 > 0, F.col("base")).alias("base"))
    return G.topology(nodes.filter("node_id % 17 <> 4"), links)


_SIDES = {"upstream": "to_node", "downstream": "from_node"}
_NETWORK = f"""WITH {B.EDGES}, n AS (
  SELECT s_suppkey AS node_id, CASE WHEN s_suppkey = 0 THEN 'outfall' ELSE 'junction' END AS node_type, CAST(s_suppkey % 11 AS DOUBLE) * 10 AS elevation, CAST(s_suppkey % 4 AS DOUBLE) AS depth, CASE WHEN s_suppkey % 3 > 0 THEN s_acctbal END AS base FROM supplier WHERE s_suppkey % 17 <> 4
), l AS (
  SELECT from_node AS link_id, from_node, to_node, CASE WHEN from_node % 10 = 3 THEN 'weir' ELSE 'conduit' END AS link_type, CASE WHEN from_node % 10 <> 3 THEN diameter END AS diameter_m, CASE WHEN from_node % 12 = 1 THEN 0e0 ELSE length END AS length_m, roughness FROM edges
), f AS (
  SELECT l.*, CASE WHEN length_m > 0 THEN round_even((a.elevation + 0.25e0 - b.elevation) / length_m, 6) END AS slope FROM l LEFT JOIN n a ON a.node_id = from_node LEFT JOIN n b ON b.node_id = to_node
), c AS (
  SELECT *, CASE WHEN abs(slope) > 0 THEN 1e0 / roughness * 3.141592653589793e0 * power(diameter_m, 2) / 4 * power(diameter_m / 4, 2e0 / 3e0) * sqrt(abs(slope)) * 1000 END AS capacity FROM f
) """


@query("r14_topology_links", _NETWORK + "SELECT link_id, from_node, to_node, link_type, round(diameter_m, 4) AS diameter_m, length_m, roughness, slope AS slope_m_per_m, round(capacity, 6) AS capacity_lps FROM c")
def r14_links(spark, sf):
    return network(spark, sf).links


@query(
    "r14_topology_nodes",
    _NETWORK
    + "SELECT n.node_id, node_type, elevation AS invert_elev_m, depth AS full_depth_m, round(coalesce(base, 0), 6) AS base_inflow_lps, "
    + ", ".join(f"coalesce({s}_pipes, 0) AS {s}_pipes, {s}_diam_max_m, {s}_diam_min_m, {s}_diam_avg_m, {s}_slope_avg, {s}_slope_max, {s}_capacity_lps" for s in _SIDES)
    + " FROM n "
    + " ".join(f"LEFT JOIN (SELECT {end} AS node_id, count(*) AS {s}_pipes, round(max(diameter_m), 6) AS {s}_diam_max_m, round(min(diameter_m), 6) AS {s}_diam_min_m, round(avg(diameter_m), 6) AS {s}_diam_avg_m, round_even(avg(CAST(round(abs(slope) * 1000000) AS BIGINT)), 0) / 1000000 AS {s}_slope_avg, max(abs(slope)) AS {s}_slope_max, round(sum(capacity), 6) AS {s}_capacity_lps FROM c GROUP BY 1) {s} ON {s}.node_id = n.node_id" for s, end in _SIDES.items()),
)
def r14_nodes(spark, sf):
    return network(spark, sf).nodes


@query("r14_topology_depths", _NETWORK + "SELECT count(depth) AS n, avg(CAST(depth > 10 AS DOUBLE)) AS deep_share, median(depth) AS median, count(depth) >= 20 AND avg(CAST(depth > 10 AS DOUBLE)) >= 0.25 AS suspicious FROM n WHERE node_type = 'junction'")
def r14_depths(spark, sf):
    return network(spark, sf).depths


@query("g5_capacity", f"WITH {B.EDGES} SELECT s_suppkey AS node_id, round(sum(1e0 / roughness * 3.141592653589793e0 * power(diameter, 2) / 4 * power(diameter / 4, 2e0 / 3e0) * sqrt(slope) * 1000), 5) AS upstream_capacity_lps FROM supplier LEFT JOIN edges ON to_node = s_suppkey GROUP BY 1")
def g5(spark, sf):
    return G.incoming_capacity(B.nodes(spark, sf), B.edges(spark, sf)).withColumn("upstream_capacity_lps", F.round("upstream_capacity_lps", 5))


@query("g6_degrees", f"WITH {B.EDGES} SELECT s_suppkey AS node_id, CAST((SELECT count(*) FROM edges WHERE to_node = s_suppkey) AS BIGINT) AS in_degree, CAST((SELECT count(*) FROM edges WHERE from_node = s_suppkey) AS BIGINT) AS out_degree FROM supplier")
def g6(spark, sf):
    return G.degrees(B.nodes(spark, sf), B.edges(spark, sf))


@query("g8_headwater", f"WITH {B.EDGES} SELECT from_node, to_node, CASE WHEN from_node IN (SELECT to_node FROM edges) THEN 'continuous' ELSE 'headwater' END AS kind FROM edges")
def g8(spark, sf):
    return G.classify_edges(B.edges(spark, sf)).select("from_node", "to_node", "kind")


@query("g9_supersession", "WITH RECURSIVE l AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey >= 10 THEN s_suppkey - 10 END AS supersedes FROM supplier), c(id, root, depth) AS (SELECT id, id, 0 FROM l WHERE supersedes IS NULL UNION ALL SELECT l.id, c.root, c.depth + 1 FROM l JOIN c ON l.supersedes = c.id) SELECT * FROM c")
def g9(spark, sf):
    k = F.col("s_suppkey")
    return G.supersession(read_table(spark, sf, "supplier").select(k.alias("id"), F.when(k >= 10, k - 10).alias("supersedes")))


@query("g10_slopes", f"WITH {B.EDGES}, {B.NODES} SELECT from_node, to_node, (a.elevation + 0.5e0 - b.elevation - 0.25e0) / length AS slope FROM edges LEFT JOIN nodes a ON a.node_id = from_node AND a.node_id % 5 <> 0 LEFT JOIN nodes b ON b.node_id = to_node AND b.node_id % 5 <> 0")
def g10(spark, sf):
    e = B.edges(spark, sf).drop("slope").withColumns({"in_offset": F.lit(0.5), "out_offset": F.lit(0.25)})
    return G.slopes(e, B.nodes(spark, sf).filter("node_id % 5 <> 0")).select("from_node", "to_node", "slope")


@query("st_windowed_events", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, max(value) AS peak FROM events GROUP BY 1, 2")
def st1(spark, sf):
    return E.windowed(read_table(spark, sf, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))
