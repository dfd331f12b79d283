"""Benchmark decontamination by SimHash of item-sized windows. Only DataFrame functions; nothing runs in Python.

Words are runs of letters and digits in lower case; shingles are five words, or all words of an item with fewer. A
document window is looked at where a shingle of it is one of an item's: aligned to that shingle and as many words long as
the item, so windows without a common shingle (similarity 0) are never made. Windows and items get fingerprints of 128
bits. Multi-index blocks find all fingerprints within RADIUS of an item: up to 31 differing bits over 8 blocks of 16 bits
leave a block with at most FLIPS = 3, so each item is entered under the 697 values within three bits of each of its
blocks, and windows look up their 8 exact values: 8 * 697 / 2^16 = 0.085 of all pairs of unrelated fingerprints meet. What
lies within the radius is verified: the weight of a shingle is its count, and the similarity is the sum of the lesser over
the sum of the greater weights.

At similarity 0.75 (equal sizes) a bit differs with probability 0.17, so 31 of 128 bits are 2.1 standard deviations above
the mean: about 2 % of pairs that have exactly the least similarity lie outside, 0.2 % at 0.8, none that are equal.

Shingles of items are broadcast only if they are at most MAX_BROADCAST_ROWS (24 bytes each); beyond that the same joins
shuffle. The index has 5,576 entries an item, about 200 bytes each in a broadcast, so it is sorted and shuffled from
MAX_BROADCAST_ENTRIES on (some twenty items). It grows with the benchmark, never with the corpus. Defined cases: null or wordless texts match nothing; rows that share doc_id are told apart by a digest of the
text: `contaminated` flags a doc_id if any row of it matches, `clean` drops the rows whose own text does; null item texts
are skipped; an item under five words matches whoever has all of its words in a row, so give no items of single common
words; empty tables give no match; columns other than doc_id, text, item_id are not read.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm.storage import written

SHINGLE = 5
THRESHOLD = 0.75
BLOCKS, BLOCK_BITS, FLIPS = 8, 16, 3
#: FLIPS + 1 or more differing bits in every block make at least one more than this.
RADIUS = BLOCKS * (FLIPS + 1) - 1
#: All values of a block with at most FLIPS bits set.
MASKS = [sum(1 << b for b in bits) for n in range(FLIPS + 1) for bits in combinations(range(BLOCK_BITS), n)]
MAX_BROADCAST_ROWS, MAX_BROADCAST_ENTRIES = 1_000_000, 100_000
#: Sums of 16 bits hold the votes of as many shingles.
LANE = (1 << 16) - 1


def word_hashes(text: Column) -> Column:
    """The 64-bit hashes of the words of a text, in order."""
    clean = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.when(F.length(clean) > 0, F.transform(F.split(clean, " "), lambda w: F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))


def shingles(hashes: Column, width: int) -> Column:
    """Hashes of every run of `width` words."""
    starts = F.slice(hashes, 1, F.greatest(F.size(hashes) - (width - 1), F.lit(0)))
    return F.transform(starts, lambda h, i: F.xxhash64(h, *[F.get(hashes, i + k) for k in range(1, width)]))


def fingerprint(column: str) -> list[Column]:
    """Two longs: the signs of 128 sums over the shingles, each counted as often as it occurs. Four bits, 16 apart, are
    counted by one pass while their counts fit; longer lists take a pass for each bit."""
    nothing, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    signs = lambda wins: F.aggregate(F.sequence(F.lit(0), F.lit(63)), nothing, lambda s, b: s.bitwiseOR(F.when(wins(b), F.call_function("shiftleft", one, b)).otherwise(nothing)))

    def half(hashes: Column) -> Column:
        n = F.size(hashes)
        lanes = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda b: F.aggregate(hashes, nothing, lambda s, h: s + F.call_function("shiftrightunsigned", h, b).bitwiseAND(F.lit(0x0001000100010001))))
        of = lambda sums, b: F.call_function("shiftrightunsigned", F.get(sums, b % 16), F.floor(b / 16).cast("int") * 16).bitwiseAND(F.lit(LANE))
        packed = F.get(F.transform(F.array(lanes), lambda sums: signs(lambda b: 2 * of(sums, b) > n)), F.lit(0))
        return F.when(n <= LANE, packed).otherwise(signs(lambda b: 2 * F.aggregate(hashes, nothing, lambda s, h: s + F.call_function("getbit", h, b)) > n))

    return [half(F.col(column)).alias("fp0"), half(F.transform(column, lambda h: F.xxhash64(h, F.lit(1)))).alias("fp1")]


def blocks() -> Column:
    """An array of the values of the blocks."""
    return F.array(*[F.shiftright(fp, BLOCK_BITS * k).bitwiseAND(F.lit(2**BLOCK_BITS - 1)).cast("int") for fp in ("fp0", "fp1") for k in range(64 // BLOCK_BITS)])


def item_table(benchmark: DataFrame) -> DataFrame:
    """item_id, item_words, width and grams (the shingles in order)."""
    items = benchmark.select("item_id", word_hashes(F.col("text")).alias("h")).withColumn("item_words", F.size("h")).filter("item_words > 0").withColumn("width", F.least("item_words", F.lit(SHINGLE)))
    grams = reduce(lambda other, k: F.when(F.col("width") == k, shingles(F.col("h"), k)).otherwise(other), range(1, SHINGLE), shingles(F.col("h"), SHINGLE))
    return items.select("item_id", "item_words", "width", grams.alias("grams"))


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """doc_id, item_id, start (of the window, in words), distance (in bits) and similarity of every verified match."""
    spark = docs.sparkSession
    items = written(item_table(benchmark), "items")
    entries = items.select("item_id", "item_words", "width", F.posexplode("grams").alias("at", "gram"))
    facts = items.agg(F.coalesce(F.sum(F.size("grams")), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("items"), F.collect_set("width").alias("widths")).first()
    widths = sorted(facts["widths"]) or [SHINGLE]
    small = lambda df, rows=facts["n"]: F.broadcast(df) if rows <= MAX_BROADCAST_ROWS else df

    keyed = docs.select("doc_id", F.xxhash64("text").alias("doc_key"), word_hashes(F.col("text")).alias("h"))
    tagged = lambda k: F.transform(shingles(F.col("h"), k), lambda g, i: F.struct(F.lit(k).alias("width"), i.alias("pos"), g.alias("gram")))
    runs = F.flatten(F.array(*[tagged(k) for k in widths])) if len(widths) > 1 else None
    if runs is None:
        seen = keyed.select("doc_id", "doc_key", F.size("h").alias("n_words"), F.posexplode(shingles(F.col("h"), widths[0])).alias("pos", "gram")).withColumn("width", F.lit(widths[0]))
    else:
        seen = keyed.select("doc_id", "doc_key", F.size("h").alias("n_words"), F.explode(runs).alias("r")).select("doc_id", "doc_key", "n_words", "r.pos", "r.gram", "r.width")
    start = F.greatest(F.least(F.col("pos") - F.col("at"), F.col("n_words") - F.col("item_words")), F.lit(0))
    seeds = seen.join(small(entries.select("item_words", "width", "at", "gram").distinct()), ["gram", "width"]).select("doc_id", "doc_key", "item_words", "width", start.alias("start")).distinct()
    seeds = written(seeds, "seeds")

    wanted = seeds.select(F.col("doc_id").alias("d"), F.col("doc_key").alias("k")).distinct()
    rows = docs.select("doc_id", F.xxhash64("text").alias("doc_key"), "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("doc_key") == F.col("k")), "left_semi").dropDuplicates(["doc_id", "doc_key"])
    rows = rows.select(F.col("doc_id").alias("d"), F.col("doc_key").alias("k"), word_hashes(F.col("text")).alias("h"))
    inside = F.slice("h", F.col("start") + 1, F.col("item_words"))
    grams = reduce(lambda other, k: F.when(F.col("width") == k, shingles(inside, k)).otherwise(other), [k for k in widths[:-1]], shingles(inside, widths[-1]))
    windows = seeds.join(rows, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("doc_key") == F.col("k"))).select("doc_id", "doc_key", "start", "item_words", "width", grams.alias("grams")).filter(F.size("grams") > 0)
    windows = written(windows.select("*", *fingerprint("grams")), "windows")

    values = F.explode(F.flatten(F.transform(blocks(), lambda v, k: F.transform(F.lit(MASKS), lambda flips: F.struct(k.alias("block"), v.bitwiseXOR(flips).alias("value"))))))
    probes = items.select("item_id", "item_words", F.size("grams").alias("item_grams"), *fingerprint("grams")).select("item_id", "item_words", "item_grams", "fp0", "fp1", values.alias("v"))
    probes = probes.select("item_id", "item_words", "item_grams", F.col("fp0").alias("i0"), F.col("fp1").alias("i1"), "v.block", "v.value")
    # the planner takes the index for as small as its items, so it has to be told
    index = F.broadcast(probes) if facts["items"] * BLOCKS * len(MASKS) <= MAX_BROADCAST_ENTRIES else probes.hint("merge")
    looked = windows.select("doc_id", "doc_key", "start", "item_words", "fp0", "fp1", F.size("grams").alias("window_grams"), F.posexplode(blocks()).alias("block", "value"))
    distance = F.bit_count(F.col("fp0").bitwiseXOR(F.col("i0"))) + F.bit_count(F.col("fp1").bitwiseXOR(F.col("i1")))
    near = looked.join(index, ["item_words", "block", "value"]).withColumn("distance", distance).filter(F.col("distance") <= radius)
    pairs = near.select("doc_id", "doc_key", "start", "item_words", "item_id", "distance", "window_grams", "item_grams").distinct()

    counted = windows.select("doc_id", "doc_key", "start", "item_words", F.explode("grams").alias("gram")).groupBy("doc_id", "doc_key", "start", "item_words", "gram").agg(F.count(F.lit(1)).alias("c"))
    counted = counted.withColumnsRenamed({"doc_id": "d", "doc_key": "k", "start": "s", "item_words": "m"})
    of_items = entries.groupBy("item_id", "gram").agg(F.count(F.lit(1)).alias("ci")).withColumnsRenamed({"item_id": "i", "gram": "g"})
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("doc_key") == F.col("k")) & (F.col("start") == F.col("s")) & (F.col("item_words") == F.col("m"))
    shared = pairs.join(counted, same).join(small(of_items), (F.col("item_id") == F.col("i")) & (F.col("gram") == F.col("g")))
    common = shared.groupBy("doc_id", "doc_key", "start", "item_id", "distance", "window_grams", "item_grams").agg(F.sum(F.least("c", "ci")).alias("common"))
    similarity = F.col("common") / (F.col("window_grams") + F.col("item_grams") - F.col("common"))
    return common.withColumn("similarity", similarity).filter(F.col("similarity") >= threshold).select("doc_id", "doc_key", "item_id", "start", "distance", "similarity")


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """A row per row of docs: doc_id, contaminated, n_items and max_similarity (0 without a match)."""
    found = matches(docs, benchmark, **options).groupBy(F.col("doc_id").alias("d")).agg(F.count_distinct("item_id").alias("n_items"), F.max("similarity").alias("max_similarity"))
    both = docs.select("doc_id").join(found, F.col("doc_id").eqNullSafe(F.col("d")), "left")
    return both.select("doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("max_similarity", F.lit(0.0)).alias("max_similarity"))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs whose own text has no match."""
    found = matches(docs, benchmark, **options).select(F.col("doc_id").alias("_leaked"), F.col("doc_key").alias("_key")).distinct()
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col("_leaked")) & (F.xxhash64("text") == F.col("_key")), "left_anti")


def op10_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op10_simhash_decontamination": op10_simhash_decontamination}
ORACLES = {
    "op10_simhash_decontamination": r"""
WITH dw AS (
  SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM documents WHERE trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) <> ''
), iw AS (
  SELECT item_id, string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM benchmark
), dg AS (
  SELECT doc_id, len(w) AS n, k - 1 AS pos, array_to_string(w[k:k+4], ' ') AS gram FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS k FROM dw)
), ig AS (
  SELECT item_id, len(w) AS m, k - 1 AS pos, array_to_string(w[k:k+4], ' ') AS gram FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - 4)) AS k FROM iw)
), seeds AS (
  SELECT DISTINCT d.doc_id, i.m, greatest(least(d.pos - i.pos, d.n - i.m), 0) AS start FROM dg d JOIN ig i USING (gram)
), wc AS (
  SELECT s.doc_id, s.m, s.start, d.gram, count(*) AS c FROM seeds s JOIN dg d ON d.doc_id = s.doc_id AND d.pos BETWEEN s.start AND s.start + s.m - 5 GROUP BY ALL
), wn AS (
  SELECT doc_id, m, start, sum(c) AS n FROM wc GROUP BY ALL
), ic AS (
  SELECT item_id, m, gram, count(*) AS c FROM ig GROUP BY ALL
), sims AS (
  SELECT wc.doc_id, ic.item_id, wc.start, sum(least(wc.c, ic.c)) AS common, any_value(wn.n) AS n, any_value(wc.m - 4) AS k
  FROM wc JOIN ic USING (m, gram) JOIN wn ON wn.doc_id = wc.doc_id AND wn.m = wc.m AND wn.start = wc.start GROUP BY wc.doc_id, ic.item_id, wc.start
), hits AS (
  SELECT doc_id, item_id, CAST(common AS DOUBLE) / CAST(n + k - common AS DOUBLE) AS similarity FROM sims WHERE common >= 0.75 * (n + k - common)
), per AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, max(similarity) AS max_similarity FROM hits GROUP BY doc_id
)
SELECT d.doc_id, p.n_items IS NOT NULL AS contaminated, coalesce(p.n_items, 0) AS n_items, coalesce(p.max_similarity, 0.0) AS max_similarity FROM documents d LEFT JOIN per p USING (doc_id)
""",
}
