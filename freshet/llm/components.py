"""Connected components of an edge table, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm.storage import written

#: Rounds are logarithmic in the size of a component; more than this means that the input isn't an edge table.
MAX_ROUNDS = 100


def components(edges: DataFrame) -> DataFrame:
    """(a, b) edges of longs -> (id, component): the smallest id of each vertex's component, for vertices with an edge.

    Every round, a vertex and the root that it points to take the smallest label among the vertex's neighbours, and labels
    then skip to the labels of their labels. Labels are written each round, so joins on a hot vertex or label have an
    exchange on both sides, which adaptive execution can split, and the minimum is pre-aggregated.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("label")), "labels")
    for _ in range(MAX_ROUNDS):
        of_b = labels.select(F.col("id").alias("b"), F.col("label").alias("label_b"))
        offers = both.join(of_b, "b").groupBy(F.col("a").alias("id")).agg(F.min("label_b").alias("label"))
        hooked = labels.withColumnsRenamed({"label": "old"}).join(offers, "id")
        moves = hooked.select("id", "old", F.least("old", "label").alias("label"))
        roots = hooked.filter("label < old").groupBy(F.col("old").alias("id")).agg(F.min("label").alias("root_label"))
        moved = written(moves.join(roots, "id", "left").select("id", "old", F.least("label", "root_label").alias("label")), "moved")
        jump = moved.select(F.col("id").alias("label"), F.col("label").alias("next"))
        after = written(moved.join(jump, "label", "left").select("id", "old", F.coalesce("next", "label").alias("label")), "labels")
        labels = after.select("id", "label")
        if after.filter("label <> old").isEmpty():
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError("components did not settle")
