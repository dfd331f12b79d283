"""Drainage networks as node and edge tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from freshet.functions.scalars import full_flow_lps, half_even
from freshet.operators.aggregates import plausible_depths
from freshet.session import settled

#: Doubling rounds reach paths of 2^ROUNDS edges.
ROUNDS = 40


def unique_edges(edges: DataFrame, order: str) -> DataFrame:
    """One edge for each pair of nodes: the last one read."""
    w = Window.partitionBy("from_node", "to_node").orderBy(F.desc(order))
    return edges.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth")


def closure(edges: DataFrame) -> DataFrame:
    """(ancestor, node) for every path, by doubling: a round joins the pairs that the last one found with all pairs, so pairs
    that are known aren't joined with each other again. Distinct pairs only, so diamonds don't multiply paths and cycles end;
    a node on a cycle isn't its own ancestor. The result has a row per pair; where sums over ancestors of a forest are all
    that is asked, `accumulate_tree` makes no pairs."""
    reach = settled(edges.select(F.col("from_node").alias("ancestor"), F.col("to_node").alias("node")).filter("ancestor <> node").distinct())
    fresh = reach
    for _ in range(ROUNDS):
        behind = fresh.select("ancestor", F.col("node").alias("mid")).join(reach.select(F.col("ancestor").alias("mid"), "node"), "mid").select("ancestor", "node")
        before = reach.select("ancestor", F.col("node").alias("mid")).join(fresh.select(F.col("ancestor").alias("mid"), "node"), "mid").select("ancestor", "node")
        fresh = settled(behind.union(before).filter("ancestor <> node").distinct().join(reach, ["ancestor", "node"], "left_anti"))
        if fresh.isEmpty():
            return reach
        reach = settled(reach.union(fresh))
    raise RuntimeError("paths are longer than the rounds can reach")


def accumulate_tree(nodes: DataFrame, edges: DataFrame, value: str) -> DataFrame:
    """`accumulate` for forests (a node has one way down at most), by pointer doubling: after k rounds each node holds the sum
    over ancestors up to 2^k - 1 edges above, and a pointer 2^k edges down. Rows stay as many as nodes."""
    repeated = edges.groupBy("from_node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if not repeated.isEmpty():
        raise ValueError("a node has several ways down; use accumulate")
    down = edges.select(F.col("from_node").alias("node_id"), F.col("to_node").alias("next"))
    state = settled(nodes.select("node_id", F.coalesce(F.col(value), F.lit(0)).alias("total")).join(down, "node_id", "left"))
    for _ in range(ROUNDS):
        open_ = state.filter("next IS NOT NULL")
        if open_.isEmpty():
            return state.select("node_id", F.col("total").alias(f"{value}_acum"))
        given = open_.groupBy(F.col("next").alias("node_id")).agg(F.sum("total").alias("more"))
        further = state.select(F.col("node_id").alias("next"), F.col("next").alias("then"))
        moved = state.join(given, "node_id", "left").join(further, "next", "left")
        state = settled(moved.select("node_id", (F.col("total") + F.coalesce("more", F.lit(0))).alias("total"), F.col("then").alias("next")))
    raise ValueError("a cycle, or a chain longer than the rounds can reach")


def ancestor_counts(nodes: DataFrame, reach: DataFrame) -> DataFrame:
    n = reach.groupBy(F.col("node").alias("node_id")).agg(F.count(F.lit(1)).alias("n_ancestors"))
    return nodes.select("node_id").join(n, "node_id", "left").fillna(0, ["n_ancestors"])


def accumulate(nodes: DataFrame, reach: DataFrame, value: str) -> DataFrame:
    """The sum of a value over each node and its ancestors; ancestors that aren't among the nodes add nothing."""
    own = nodes.select("node_id", value)
    above = reach.join(own.select(F.col("node_id").alias("ancestor"), F.col(value).alias("_v")), "ancestor").groupBy(F.col("node").alias("node_id")).agg(F.sum("_v").alias("_above"))
    return own.join(above, "node_id", "left").select("node_id", (F.coalesce(value, F.lit(0)) + F.coalesce("_above", F.lit(0))).alias(f"{value}_acum"))


def distance_to_outfall(nodes: DataFrame, edges: DataFrame, outfalls: DataFrame, length: str = "length") -> DataFrame:
    """The least length of a path to any outfall, NULL without one: relaxation from all outfalls at once, in which only
    nodes that came closer in a round are looked at in the next. Lengths below 0 are errors: a cycle of them has no least."""
    weight = F.coalesce(length, F.lit(0)).cast("double")
    sound = F.when(weight >= 0, weight).otherwise(F.raise_error(F.lit("an edge has a length below 0")).cast("double"))
    steps = settled(edges.select("from_node", "to_node", sound.alias("w")))
    best = outfalls.select("node_id", F.lit(0.0).alias("distance"), F.lit(True).alias("new"))
    while not best.filter("new").isEmpty():
        front = best.filter("new").select(F.col("node_id").alias("to_node"), "distance")
        offers = steps.join(front, "to_node").select(F.col("from_node").alias("node_id"), (F.col("w") + F.col("distance")).alias("distance"), F.lit(True).alias("new"))
        both = best.withColumn("new", F.lit(False)).unionByName(offers)
        # the least distance wins; at equal distances an old one, so that nothing is looked at twice
        best = both.groupBy("node_id").agg(F.min(F.struct("distance", "new")).alias("m")).select("node_id", "m.distance", "m.new")
        best = settled(best)
    return nodes.select("node_id").join(best.select("node_id", "distance"), "node_id", "left")


def distance_in_forest(nodes: DataFrame, edges: DataFrame, outfalls: DataFrame, length: str = "length") -> DataFrame:
    """`distance_to_outfall` where a node has one way down at most, by pointer doubling: after k rounds a node knows its
    length down to a node 2^k edges away, so a path of a million edges takes twenty rounds and not a million. Pointers end
    at outfalls, even at those with an edge below them; a node that ends elsewhere or runs round a cycle gets NULL."""
    repeated = edges.groupBy("from_node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if not repeated.isEmpty():
        raise ValueError("a node has several ways down; use distance_to_outfall")
    ends = outfalls.select("node_id").distinct().withColumn("_end", F.lit(True))
    weight = F.coalesce(length, F.lit(0)).cast("double")
    sound = F.when(weight >= 0, weight).otherwise(F.raise_error(F.lit("an edge has a length below 0")).cast("double"))
    down = edges.select(F.col("from_node").alias("node_id"), F.col("to_node").alias("next"), sound.alias("d"))
    # a lower end that is neither an outfall nor the start of an edge is a row too, so that pointers find it
    known = down.select("node_id").union(down.select("next")).union(outfalls.select("node_id")).distinct()
    wide = known.join(down, "node_id", "left").join(ends, "node_id", "left")
    at_end = F.coalesce("_end", F.lit(False))
    state = settled(wide.select("node_id", F.when(~at_end, F.col("next")).alias("next"), F.when(at_end, 0.0).otherwise(F.coalesce("d", F.lit(0.0))).alias("d"), at_end.alias("reached")))
    most, covered = state.count(), 1
    while covered <= most and not state.filter("next IS NOT NULL").isEmpty():
        below = state.select(F.col("node_id").alias("next"), F.col("next").alias("_next"), F.col("d").alias("_d"), F.col("reached").alias("_reached"))
        moved = state.join(below, "next", "left")
        state = settled(moved.select("node_id", F.col("_next").alias("next"), (F.col("d") + F.coalesce("_d", F.lit(0.0))).alias("d"), (F.col("reached") | F.coalesce("_reached", F.lit(False))).alias("reached")))
        covered *= 2
    return nodes.select("node_id").join(state.filter("reached").select("node_id", F.col("d").alias("distance")), "node_id", "left")


@dataclass(frozen=True)
class Topology:
    """What a network says of itself before any run: its nodes, its links, and one row on whether depths are plausible."""

    nodes: DataFrame
    links: DataFrame
    depths: DataFrame


def topology(nodes: DataFrame, links: DataFrame) -> Topology:
    """nodes: node_id, kind, elevation, depth, base; links: link_id, from_node, to_node, kind, diameter, length, roughness,
    in_offset, out_offset.

    A link's slope is signed, with six digits, and NULL where an end isn't among the nodes or there is no positive length;
    its capacity goes by the slope's size and is NULL where that is 0. A node's columns sum up the links that end
    (upstream_) and start (downstream_) there, in one aggregation over both ends, so links are shuffled by node once."""
    fallen = slopes(links, nodes).withColumn("slope", F.when(F.col("length") > 0, half_even(F.col("slope"), 6)))
    steep = F.abs("slope")
    carried = fallen.withColumn("capacity", full_flow_lps(F.col("diameter"), steep, F.col("roughness")))
    sides = (("upstream", "to_node"), ("downstream", "from_node"))
    ends = F.explode(F.array(*[F.struct(F.lit(side).alias("side"), F.col(end).alias("node_id")) for side, end in sides])).alias("e")
    long = carried.select("diameter", steep.alias("steep"), "capacity", ends).select("e.side", "e.node_id", "diameter", "steep", "capacity").filter("node_id IS NOT NULL")
    summed = []  # slopes are averaged as whole millionths: halves are exact, whatever the order of the links
    for side, _ in sides:
        of = lambda c, here=F.col("side") == side: F.when(here, F.col(c))
        measures = {"diam_max_m": F.max(of("diameter")), "diam_min_m": F.min(of("diameter")), "diam_avg_m": F.avg(of("diameter")), "slope_avg": half_even(F.avg(half_even(of("steep") * 1_000_000).cast("long"))) / 1_000_000, "slope_max": F.max(of("steep")), "capacity_lps": F.sum(of("capacity"))}
        summed += [F.count_if(F.col("side") == side).alias(f"{side}_pipes"), *[half_even(x, 6).alias(f"{side}_{name}") for name, x in measures.items()]]
    own = nodes.select("node_id", F.col("kind").alias("node_type"), half_even(F.col("elevation"), 4).alias("invert_elev_m"), half_even(F.col("depth"), 4).alias("full_depth_m"), half_even(F.coalesce("base", F.lit(0.0)), 6).alias("base_inflow_lps"))
    both = own.join(long.groupBy("node_id").agg(*summed), "node_id", "left").fillna(0, ["upstream_pipes", "downstream_pipes"])
    shown = carried.select("link_id", "from_node", "to_node", F.col("kind").alias("link_type"), half_even(F.col("diameter"), 4).alias("diameter_m"), half_even(F.col("length"), 4).alias("length_m"), half_even(F.col("roughness"), 6).alias("roughness"), F.col("slope").alias("slope_m_per_m"), half_even(F.col("capacity"), 6).alias("capacity_lps"))
    return Topology(both, shown, plausible_depths(nodes.filter("kind = 'junction'"), "depth"))


def incoming_capacity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Full-pipe flow of all conduits into each node; NULL where it is 0."""
    flow = edges.withColumn("_c", full_flow_lps(F.col("diameter"), F.col("slope"), F.col("roughness"))).groupBy(F.col("to_node").alias("node_id")).agg(F.sum("_c").alias("_c"))
    return nodes.select("node_id").join(flow, "node_id", "left").select("node_id", F.when(F.col("_c") > 0, F.col("_c")).alias("upstream_capacity_lps"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges in and out of each node, in one aggregation over both ends."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("to_node").alias("node_id"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("from_node").alias("node_id"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("e")).select("e.*")
    both = ends.groupBy("node_id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return nodes.select("node_id").join(both, "node_id", "left").fillna(0, ["in_degree", "out_degree"])


def classify_edges(edges: DataFrame) -> DataFrame:
    """Is an edge's start never an end (headwater)?"""
    ends = edges.select(F.col("to_node").alias("from_node")).distinct().withColumn("_fed", F.lit(True))
    return edges.join(ends, "from_node", "left").withColumn("kind", F.when(F.col("_fed").isNull(), "headwater").otherwise("continuous")).drop("_fed")


def slopes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Fall over length of each edge; NULL where an end isn't among the nodes or the length is 0."""
    a, b = nodes.select(F.col("node_id").alias("from_node"), F.col("elevation").alias("_a")), nodes.select(F.col("node_id").alias("to_node"), F.col("elevation").alias("_b"))
    wide = edges.join(a, "from_node", "left").join(b, "to_node", "left")
    fall = F.col("_a") + F.col("in_offset") - F.col("_b") - F.col("out_offset")
    return wide.withColumn("slope", F.try_divide(fall, F.col("length"))).drop("_a", "_b")


def supersession(links: DataFrame) -> DataFrame:
    """links: id, supersedes (NULL for a root). Every id with its root and depth, by pointer doubling: after k rounds a row
    has found its root or points 2^k links up. An id under several links has a row for each of its paths; one that leads to
    an id that isn't there, or into a cycle, has no root and no row."""
    done = F.col("supersedes").isNull()
    up = settled(links.select("id", F.coalesce("supersedes", "id").alias("root"), F.when(done, 0).otherwise(1).cast("long").alias("depth"), done.alias("done")))
    most, reached, open_ = up.count(), 1, up.filter("NOT done")
    while not open_.isEmpty() and reached <= most:
        above = up.select(F.col("id").alias("_id"), F.col("root").alias("_root"), F.col("depth").alias("_depth"), F.col("done").alias("_done"))
        further = open_.join(above, F.col("root") == F.col("_id")).select("id", F.col("_root").alias("root"), (F.col("depth") + F.col("_depth")).alias("depth"), F.col("_done").alias("done"))
        up, reached = settled(up.filter("done").unionByName(further)), 2 * reached
        open_ = up.filter("NOT done")
    found = up.filter("done")
    # more links than there are: what is still open ran into a cycle
    if not open_.join(found.select("id"), "id", "left_semi").isEmpty():
        raise ValueError("an id has a root and a cycle above it")
    return found.select("id", "root", F.col("depth").cast("int").alias("depth"))
