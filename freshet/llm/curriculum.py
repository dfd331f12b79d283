"""Mixing of sources to target weights by a time-varying curriculum.

Each source i has a weight (1, 2, 3, repeating by code point of its name, null last) that fixes its target share of all
words, and a schedule over training time t in [0, 1]: its share of the stream at t is target_i * (1 + a_i * (2t - 1)).
The integral of that schedule, D_i(t) = t + a_i * (t^2 - t), is the part of the source's target that is due by t. A
document that takes up the part [u, u + du) of its source's target is placed at the t with D_i(t) = u + du / 2. Sorting
by range of position then gives the stream in training order.

The order of documents within a source is that of the MD5 of doc_id, then of a random number with a fixed seed, which
depends on a row's place in its partition: the same table gives the same mix. Cumulative sizes are found in two levels
(source and hash cell, then rows within a cell). Cells are ranges of that order, cut by a sample, so a source, or a doc_id,
with a third of all rows (or with all of them) is spread over as many tasks as shuffles have. The sources themselves are ranked in one task: a row
for each, without texts.

Defined cases: a null or blank text has size 0 and is never taken; a null source is a source of its own, last; a null
doc_id sorts as the empty string; rows that repeat are documents of their own; an empty table gives an empty result;
columns other than doc_id, text and source are passed through by `stream` and never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from freshet.operators.ranks import bounds, part_of

#: Words as the mix counts them: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
#: How often a document can be taken.
MAX_EPOCHS = 3
#: Slopes of the schedules, repeating by rank of the source: early, steady and late sources.
SLOPES = (-0.6, 0.0, 0.6)
#: Hash cells of a source: as many as shuffles have partitions, up to the limit of `ranks`.
SALTS = 1 << 20


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cyclic(rank: Column, values: tuple) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (rank % len(values) + 1).cast("int"))


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, slopes: tuple[float, ...] = SLOPES, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size -> also weight, slope and target: words that the mix takes of each source.

    Sources fill by weight up to max_epochs times their size. In ascending order of capacity per weight, the level that
    remains for a source is (all words - capacities before it) / (weights from it on); the first source that doesn't
    fill at that level fixes the level for all that follow.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    everything = Window.partitionBy()
    return (
        totals.select("source", "source_size", (F.row_number().over(by_name) - 1).alias("rank"))
        .withColumns({"weight": cyclic(F.col("rank"), weights).cast("long"), "slope": cyclic(F.col("rank"), slopes), "cap": F.col("source_size") * max_epochs})
        .withColumns({"before": F.coalesce(F.sum("cap").over(fill), F.lit(0)), "weight_before": F.coalesce(F.sum("weight").over(fill), F.lit(0)), "nth": F.row_number().over(order)})
        .withColumn("level", (F.sum("source_size").over(everything) - F.col("before")).cast("double") / (F.sum("weight").over(everything) - F.col("weight_before")).cast("double"))
        .withColumn("level", F.min_by("level", F.when(F.col("cap") > F.col("weight") * F.col("level"), F.col("nth"))).over(everything))
        .select("source", "source_size", "weight", "slope", F.coalesce(F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level")), F.col("cap").cast("double")).alias("target"))
    )


def position(part: Column, slope: Column) -> Column:
    """The t with t + a (t^2 - t) = part."""
    b = 1 - slope
    root = (F.sqrt(F.greatest(b * b + 4 * slope * part, F.lit(0.0))) - b) / F.nullif(2 * slope, F.lit(0.0))
    return F.least(F.greatest(F.coalesce(root, part), F.lit(0.0)), F.lit(1.0))


def shuffled(doc_id: Column) -> Column:
    """What documents are in order of within a source. Rows that share doc_id are told apart by a random number, so that they
    spread over cells too."""
    return F.concat(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lpad(F.hex((F.rand(5) * SALTS).cast("long")), 5, "0"))


def plan(docs: DataFrame, keep: tuple[str, ...] = (), weights: tuple[int, ...] = WEIGHTS, slopes: tuple[float, ...] = SLOPES, max_epochs: int = MAX_EPOCHS, also: tuple[str, ...] = ()) -> DataFrame:
    """A row per row of docs: doc_id, source, size, source_size, target, taken and positions (one for each time it is
    taken, in [0, 1]). `keep` names columns of docs to carry along under `row`, `also` such as stay columns."""
    order = shuffled(F.col("doc_id"))
    cuts = bounds(docs.select(order.alias("h")), ["h"])
    of = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), F.col("source")))  # never null, so one shuffle by it serves the window and the join
    sized = docs.select(
        F.col("doc_id"), F.col("source"), of.alias("of"), words(F.col("text")).alias("size"), order.alias("h"), F.struct(*keep).alias("row") if keep else F.lit(None).cast("int").alias("row"), *also,
    )
    sized = sized.withColumn("cell", part_of(sized, ["h"], cuts))
    cells = sized.groupBy("source", "cell").agg(F.sum("size").alias("cell_size"))
    before = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    shares = targets(cells.groupBy("source").agg(F.sum("cell_size").alias("source_size")), weights, slopes, max_epochs)
    starts = cells.select("source", "cell", F.coalesce(F.sum("cell_size").over(before), F.lit(0)).alias("cell_start"))
    starts = starts.join(shares, starts["source"].eqNullSafe(shares["source"])).drop(shares["source"]).withColumn("of", of).drop("source")
    within = Window.partitionBy("of", "cell").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("start", F.coalesce(F.sum("size").over(within), F.lit(0)))
    both = placed.join(starts, ["of", "cell"])
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    offset = F.col("cell_start") + F.col("start")
    part = F.col("target") - F.col("whole") * F.col("source_size")
    extra = F.when((F.col("whole") < max_epochs) & (offset + F.col("size") / 2 <= part), 1).otherwise(0).cast("long")
    return (
        both.withColumn("whole", whole)
        .withColumn("copies", F.when(F.col("size") > 0, F.col("whole") + extra).otherwise(0))
        .withColumn("passes", F.when(F.col("copies") > 0, F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).otherwise(F.array().cast("array<bigint>")))
        .withColumn("positions", F.transform("passes", lambda k: position(F.least((offset + k * F.col("source_size") + F.col("size") / 2) / F.col("target"), F.lit(1.0)), F.col("slope"))))
        .select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "positions", *(["row"] if keep else []), *also)
    )


def in_order(placed: DataFrame) -> DataFrame:
    """Rows of `plan`, once for each position, in training order over the partitions; without a position, and without what
    they carry, rows that are never taken come first."""
    each = placed.select("*", F.explode_outer("positions").alias("position"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("h"))
    return each.withColumn("row", F.when(F.col("position").isNotNull(), F.col("row"))).repartitionByRange("position", "h").sortWithinPartitions("position", "h")


def stream(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that the mix takes, as often as it takes them, in training order over the partitions."""
    placed = plan(docs, keep=tuple(docs.columns), **options)
    return in_order(placed.filter(F.size("positions") > 0)).select("row.*")


def digest(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies of every row of docs, read off the ordered stream itself: taken are
    the words of the texts that it gives of the row."""
    marked = docs.withColumn("_row", F.monotonically_increasing_id())  # rows of one doc_id are told apart
    emitted = in_order(plan(marked, keep=("text",), also=("_row",), **options))
    facts = [F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target")]
    per = emitted.groupBy("_row").agg(*facts, F.sum(words(F.col("row.text"))).alias("taken"), F.count("position").cast("int").alias("copies"))
    return per.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op9_curriculum_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))


QUERIES = {"op9_curriculum_mixing": op9_curriculum_mixing}
ORACLES = {
    "op9_curriculum_mixing": r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), t AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS weight, source_size * 3 AS cap FROM t
), l AS (
  SELECT *, row_number() OVER o AS nth,
    CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS level
  FROM w WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST)
), s AS (
  SELECT source, source_size, coalesce(least(CAST(cap AS DOUBLE), weight * (SELECT arg_min(level, nth) FROM l WHERE cap > weight * level)), CAST(cap AS DOUBLE)) AS target
  FROM l
), p AS (
  SELECT d.doc_id, d.size, s.source_size, s.target,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
    CASE WHEN s.source_size > 0 THEN floor(s.target / s.source_size) ELSE 0 END AS whole
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source
), c AS (
  SELECT *, CASE WHEN size = 0 THEN 0 ELSE whole + CASE WHEN whole < 3 AND start + size / 2.0 <= target - whole * source_size THEN 1 ELSE 0 END END AS n
  FROM p
)
SELECT doc_id, size, source_size, target, CAST(size * n AS BIGINT) AS taken, CAST(n AS INTEGER) AS copies FROM c
""",
}
