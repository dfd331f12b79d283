"""Running totals and exact percentiles over parts of an order, so that no task holds all rows."""

from __future__ import annotations

import math
from collections.abc import Collection, Sequence
from functools import reduce
from itertools import accumulate, groupby, takewhile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.session import PART_ROWS, kept, small_side

#: Parts of an order at most, and sampled rows for each bound between them.
MOST_PARTS, SAMPLES = 1024, 16
#: Cuts near wanted shares, and cuts that a search is written out for, at most.
MOST_CUTS = 64


def around(picked: Sequence[tuple], shares: Sequence[float]) -> list[int]:
    """Places in a sorted sample: for each group (rows of one first value) where its shares are reached, and one and four times
    the error of a sampled rank to both sides."""
    places, first = set(), 0
    for _, same in groupby(picked, lambda row: row[0]):
        size = len(list(same))
        error = math.ceil(math.sqrt(size) / 2)
        found = (first + round(share * (size - 1)) + error * k for share in shares for k in (-4, -1, 0, 1, 4))
        places |= {k for k in found if first <= k < first + size}
        first += size
    return sorted(places)


def bounds(df: DataFrame, order: Sequence[str], parts: int | None = None, shares: Sequence[float] = ()) -> list[tuple]:
    """Ascending values of the order's columns that cut the rows into parts (as many as shuffles have partitions, unless
    told) of about equal size, from a sample of about SAMPLES * parts rows.

    With `shares`, cuts lie only near these shares of each group (rows of one first value), by a sample of about SAMPLES *
    MOST_PARTS rows: a few cuts a group, however many rows and partitions there are. If that takes more than MOST_CUTS, as
    groups are many, parts are of equal size all the same."""
    n = min(MOST_PARTS, parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if n < 2 and not shares:
        return []
    keys = df.select(*order)
    share = SAMPLES * (MOST_PARTS if shares else n) / max(1, keys.count())
    picked = [tuple(r) for r in (keys.sample(share, seed=11) if share < 1 else keys).collect()]
    rising = lambda row: [(v is not None, isinstance(v, float) and math.isnan(v), 0 if v is None or v != v else v) for v in row]
    picked.sort(key=rising)
    places = around(picked, shares)
    if not shares or len(places) > MOST_CUTS:
        places = [len(picked) * k // n for k in range(1, n)] if picked else []
    cuts = [picked[k] for k in places]
    return [c for k, c in enumerate(cuts) if k == 0 or rising(c) != rising(cuts[k - 1])]


def part_of(df: DataFrame, order: Sequence[str], cuts: Sequence[tuple], written_out: bool = False) -> Column:
    """How many of the cuts aren't behind the row: a pure function of the order's columns, by binary search.

    With `written_out` the search is nested conditions, which Spark compiles; a function over an array of cuts, which it
    doesn't compile, takes many times as long. For few cuts (up to MOST_CUTS), as code grows with them."""
    if not cuts:
        return F.lit(0)
    kinds = {f.name: f.dataType for f in df.select(*order).schema.fields}
    values = [F.struct(*[F.lit(v).cast(kinds[c]).alias(c) for c, v in zip(order, cut, strict=True)]) for cut in cuts]
    key = F.struct(*order)
    if written_out:

        def search(low: int, high: int) -> Column:
            if low == high:
                return F.lit(low)
            middle = (low + high) // 2
            return F.when(values[middle] <= key, search(middle + 1, high)).otherwise(search(low, middle))

        return search(0, len(cuts))
    table = F.array(*values)
    steps = [1 << k for k in reversed(range(len(cuts).bit_length()))]
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, s: F.when(F.get(table, at + s - 1) <= key, at + s).otherwise(at))


def before_each(df: DataFrame, by: Sequence[str], order: Sequence[str], falling: Collection[str] = (), totals: bool = False, **sums: str) -> DataFrame:
    """Adds, under each name, the sum of a column over the rows of the same `by` that come before a row in the order
    (in which the columns of `falling` fall), and with `totals`, under `total_<name>`, that over all rows of the same `by`.

    The part of the order that a row belongs to follows from the row itself, so nothing has to be settled: rows are shuffled
    once, by part and `by`, for their running sums, and sums of parts (a row per part and key in it) are added up before
    they are."""
    down = bool(order) and order[0] in falling
    leading = list(takewhile(lambda c: (c in falling) == down, order))  # struct comparison knows one direction
    part = part_of(df, leading, bounds(df, leading))
    keyed = df.withColumn("_key", F.struct((-part if down else part).alias("part"), *by))
    dealt = keyed.repartition("_key")
    per = keyed.groupBy("_key").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    same = Window.partitionBy(*[F.col(f"_key.`{k}`") for k in by])
    above = same.orderBy("_key.part").rowsBetween(Window.unboundedPreceding, -1)
    starts = [F.coalesce(F.sum(f"_t_{n}").over(above), F.lit(0)).alias(f"_s_{n}") for n in sums]
    whole = [F.sum(f"_t_{n}").over(same).alias(f"total_{n}") for n in sums] if totals else []
    within = Window.partitionBy("_key").orderBy(*[F.desc(c) if c in falling else F.asc(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    counted = dealt.withColumns({f"_w_{n}": F.coalesce(F.sum(c).over(within), F.lit(0)) for n, c in sums.items()})
    both = counted.join(per.select(F.col("_key").alias("_k"), *starts, *whole), F.col("_key") == F.col("_k"))
    return both.select(*df.columns, *[(F.col(f"_s_{n}") + F.col(f"_w_{n}")).alias(n) for n in sums], *[f"total_{n}" for n in sums if totals])


def numbered(rows: DataFrame, order: Sequence[str], key: str, start: int = 0) -> DataFrame:
    """Adds start + 1, start + 2 and so on in the order of columns in which all rows (a scan, which is counted) differ.

    Rows are shuffled once, by ranges of the order, and written sorted with their place in their range; how many rows the
    ranges before hold, which the driver adds up, gives the number. No row looks for its range by itself."""
    n = rows.count()
    least = min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // 10_000)  # few rows need few ranges
    ranges = rows.repartitionByRange(max(1, least, -(-n // PART_ROWS)), *order).sortWithinPartitions(*order)
    placed = kept(ranges.withColumn("_place", F.monotonically_increasing_id()))  # a range's index times 2^33, and places in it
    of = F.shiftright("_place", 33)
    sizes = dict(placed.groupBy(of.alias("of")).count().collect())
    above = F.array(*[F.lit(start + 1 + k).cast("long") for k in accumulate((sizes.get(i, 0) for i in range(max(sizes, default=0))), initial=0)])
    return placed.select(*rows.columns, (F.get(above, of.cast("int")) + F.col("_place").bitwiseAND((1 << 33) - 1)).alias(key))


def percentiles(long: DataFrame, by: str, value: str, at: Sequence[float], weight: str | None = None) -> DataFrame:
    """by, q: exact percentiles, linear between ranks, of the values that aren't NULL (each as often as its weight says).

    The order of (by, value) is cut into parts near the wanted ranks (which a sample tells about, unless rows have weights),
    whose rows are counted. What is wanted are the values at two ranks for each percentile, so only rows of the parts that
    hold such a rank are shuffled, counted by value and ranked within their part. If such a part has more than PART_ROWS rows,
    its values are ranked over parts of their own."""
    rows = long.filter(F.col(value).isNotNull()).select(F.col(by), F.col(value), (F.col(weight) if weight else F.lit(1)).cast("long").alias("_w"))
    cuts = bounds(rows, [by, value], shares=() if weight else at)
    few = len(cuts) <= MOST_CUTS
    keyed = rows.withColumn("_key", F.struct(part_of(rows, [by, value], cuts, written_out=few).alias("part"), F.col(by).alias("of")))
    parts = keyed.groupBy("_key").agg(F.sum("_w").alias("_size"))
    same = Window.partitionBy("_key.of")
    above = same.orderBy("_key.part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_key", "_size", F.coalesce(F.sum("_size").over(above), F.lit(0)).alias("_start"), F.sum("_size").over(same).alias("total__before"))
    exact = [F.lit(float(p)) * (F.col("total__before") - 1) for p in at]
    held = [(r >= F.col("_start")) & (r < F.col("_start") + F.col("_size")) for x in exact for r in (F.floor(x), F.ceil(x))]
    wanted = kept(parts.filter(reduce(lambda a, b: a | b, held)).select(F.col("_key").alias("_k"), "_size", "_start", "total__before"))
    same_key = F.col("_key") == F.struct(F.coalesce("_k.part", F.lit(0)).alias("part"), F.col("_k.of").alias("of"))  # parts aren't NULL, which a table that was written doesn't tell
    most, numbers = wanted.agg(F.coalesce(F.max("_size"), F.lit(0)), F.collect_set("_k.part")).first()
    wanted = small_side(wanted.drop("_size"))  # few rows unless groups are many; then both sides are shuffled
    near = keyed.filter(F.col("_key.part").isin(numbers)) if few else keyed  # most rows needn't be looked up
    counts = near.join(wanted, same_key).groupBy(F.col("_key.part").alias("_part"), by, value).agg(F.sum("_w").alias("_n"), F.first("_start").alias("_start"), F.first("total__before").alias("total__before"))
    if most > PART_ROWS:
        ranked = before_each(kept(counts), ["_part", by], [value], _below="_n")
    else:
        within = Window.partitionBy("_part", by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        ranked = counts.withColumn("_below", F.coalesce(F.sum("_n").over(within), F.lit(0)))
    placed = ranked.withColumn("_before", F.col("_start") + F.col("_below"))
    asked = placed.select(by, value, "_n", "_before", "total__before", F.posexplode(F.array(*[F.lit(float(p)) for p in at])).alias("_i", "_q"))
    asked = asked.withColumn("_exact", F.col("_q") * (F.col("total__before") - 1))
    inside = lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_n"))
    found = asked.filter(inside(F.floor("_exact")) | inside(F.ceil("_exact")))
    ends = found.groupBy(by, "_i", "_exact").agg(F.min(value).alias("_a"), F.max(value).alias("_b"))
    line = F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_exact") - F.floor("_exact"))
    packed = ends.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("_i", line.alias("_v")))).alias("_s"))
    return packed.select(by, F.transform("_s", lambda x: x["_v"]).alias("q"))
