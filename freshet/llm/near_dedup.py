"""MinHash near-dedup with sequential Bayesian verification.

A document's set is its distinct shingles of five lower-cased words. Documents with equal sets are one class; the class's
smallest doc_id stands for it. Classes get signatures of 64 bands of six minima; classes that share a band are
candidates. At similarity 0.75 a pair shares no band with probability (1 - 0.75^6)^64 = 3.6e-6.

Candidates are not expanded into all pairs of a band. First each band's members are compared with one centre: the member
that shares bands with the most others, which in a group of near copies is the text they derive from. What is confirmed
joins components. Then only pairs of different components within a band are compared, without those already done; in
bands of more than SMALL_BAND members, only pairs that `across_hub` can't rule out.

A comparison looks at 32 minima at a time. With a uniform prior, the chance that the similarity reaches the threshold
after m of n agree is P(Binomial(n + 1, threshold) <= m); the pair is pruned as soon as that falls below MISS. Survivors
are verified exactly on their whole sets.

Defined cases: null or wordless texts have no set and are linked with nothing (component = doc_id, kept); a null doc_id
has a null component and is kept; rows that share doc_id are one vertex; rows that repeat each get the same result; an
empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from freshet.llm.components import components
from freshet.llm.storage import shipped, written
from freshet.llm.textops import BYTE_VALUE, BYTES, LOWER, RUNS, SPACE, chunks, mix, owners, pieces, run_starts

SHINGLE = 5
THRESHOLD_PERCENT = 75
BANDS, ROWS = 64, 6
HASHES = BANDS * ROWS
BATCH = 32
#: Members up to which all pairs of different components within a band are compared; beyond, see `across_hub`.
SMALL_BAND = 32
#: Spokes that share one copy of their hub's text, about.
SPOKES = 1024
#: Chance at which a pair at the threshold may be pruned, for each look.
MISS = 1e-6
_rng = np.random.Generator(np.random.PCG64(11))
FACTORS = _rng.integers(0, 2**32, HASHES, dtype=np.uint32) | np.uint32(1)
SHIFTS = _rng.integers(0, 2**32, HASHES, dtype=np.uint32)
BAND_SALT = mix(_rng.integers(0, 2**64, BANDS, dtype=np.uint64))


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text of a chunk: hashes, and n + 1 offsets of texts into them."""
    starts, ends, words = pieces(SPACE[data], offsets)
    prefix = RUNS.prefix(BYTES.ranges(BYTES.prefix(BYTE_VALUE[LOWER[data]]), starts, ends))
    at = run_starts(words, SHINGLE)
    docs, hashes = owners(words)[at], RUNS.ranges(prefix, at, at + SHINGLE)
    counts = np.diff(words)
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):
        docs = np.r_[docs, short]
        hashes = np.r_[hashes, mix(RUNS.ranges(prefix, words[short], words[short + 1]) + counts[short].astype(np.uint64))]
    order = np.lexsort((hashes, docs))
    docs, hashes = docs[order], hashes[order]
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (hashes[1:] != hashes[:-1])
    return hashes[new], np.searchsorted(docs[new], np.arange(len(offsets)))


def signatures(hashes: np.ndarray, sets: np.ndarray) -> np.ndarray:
    """uint16 [texts that have a set, HASHES]: the low halves of the minima."""
    firsts = sets[:-1][np.diff(sets) > 0]
    out = np.empty((HASHES, len(firsts)), np.uint16)
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    for k in range(HASHES if len(firsts) else 0):
        out[k] = np.minimum.reduceat(x * FACTORS[k] + SHIFTS[k], firsts).astype(np.uint16)
    return np.ascontiguousarray(out.T)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """uint64 [texts, BANDS]: one key per band, different between bands."""
    parts = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    low = parts[:, :, 0] | parts[:, :, 1] << np.uint64(16) | parts[:, :, 2] << np.uint64(32) | parts[:, :, 3] << np.uint64(48)
    return mix(mix(low ^ BAND_SALT) + (parts[:, :, 4] | parts[:, :, 5] << np.uint64(16)))


def least_agreement(threshold: float = THRESHOLD_PERCENT / 100, miss: float = MISS) -> np.ndarray:
    """For each number of batches seen: the fewest agreeing minima with which a pair isn't pruned."""
    found = []
    for n in range(BATCH, HASHES + 1, BATCH):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += exp(lgamma(n + 2) - lgamma(m + 1) - lgamma(n + 2 - m) + m * log(threshold) + (n + 1 - m) * log(1 - threshold))
        found.append(m)
    return np.array(found)


def survivors(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of two signature arrays are not pruned at any batch; a pruned row is not looked at again."""
    alive, agree = np.arange(len(a)), np.zeros(len(a), np.int64)
    for k, least in enumerate(least_agreement()):
        part = slice(k * BATCH, (k + 1) * BATCH)
        agree[alive] += (a[alive, part] == b[alive, part]).sum(axis=1)
        alive = alive[agree[alive] >= least]
    kept = np.zeros(len(a), bool)
    kept[alive] = True
    return kept


def sketch(docs: DataFrame) -> DataFrame:
    """A row per row of docs: id, n_shingles, a digest of the set (d0, d1) and the signature (null for an empty set)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in chunks(batch):
                hashes, sets = shingle_sets(data, offsets)
                has = np.diff(sets) > 0
                sums = [np.r_[np.zeros(1, np.uint64), np.cumsum(h)] for h in (mix(hashes), mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)))]
                digests = [(s[sets[1:]] - s[sets[:-1]]).view(np.int64) for s in sums]
                signed = iter(signatures(hashes, sets))
                packed = pa.array([next(signed).tobytes() if x else None for x in has], pa.binary())
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(sets)), pa.array(digests[0]), pa.array(digests[1]), packed], names=["id", "n_shingles", "d0", "d1", "signature"])

    return shipped(docs.select(F.col("doc_id").cast("long").alias("id"), "text")).mapInArrow(work, "id long, n_shingles long, d0 long, d1 long, signature binary")


def explode_bands(classes: DataFrame) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                rows = batch.slice(at, 4096)
                keys = band_keys(np.frombuffer(b"".join(rows.column(1).to_pylist()), np.uint16).reshape(-1, HASHES))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64).ravel()), pa.array(np.repeat(rows.column(0).to_numpy(), BANDS))], names=["key", "id"])

    return shipped(classes.select("id", "signature")).mapInArrow(work, "key long, id long")


def around_hubs(spokes: DataFrame, docs: DataFrame) -> DataFrame:
    """spokes: hub, spoke -> rows of hub, part, kind, id and text, so partitioned and sorted that a part's hub (kind 0) comes
    before up to about SPOKES of its spokes (kind 1). A hub's text travels once a part, not once a pair."""
    counted = spokes.groupBy("hub").agg(F.count(F.lit(1)).alias("n"))
    part = F.pmod(F.xxhash64("spoke"), F.ceil(F.col("n") / SPOKES)).cast("int")
    placed = written(spokes.join(counted, "hub").select("hub", "spoke", part.alias("part")), "placed-spokes")
    route = lambda id_, kind: [F.col(id_).alias("id"), F.struct("hub", "part", F.lit(kind).alias("kind")).alias("r")]
    routes = placed.select(*route("spoke", 1)).union(placed.select("hub", "part").distinct().select(*route("hub", 0)))
    routes = routes.groupBy("id").agg(F.collect_list("r").alias("routes"))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(routes.hint("merge"), "id")  # texts are shuffled at any size
    sent = texts.select(F.explode("routes").alias("r"), "id", "text").select("r.hub", "r.part", "r.kind", "id", "text")
    return sent.repartition("hub", "part").sortWithinPartitions("hub", "part", "kind", F.when(F.col("kind") == 0, F.xxhash64("text")))


def beside_hubs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray], int, np.ndarray]]:
    """For rows of `around_hubs`: hub, the sets of its rows, and each spoke with its set."""
    at, held = None, []
    for batch in batches:
        for rows, data, offsets in chunks(batch):
            hashes, sets = shingle_sets(data, offsets)
            for k, (hub, part, kind, id_) in enumerate(zip(*[rows.column(c).to_pylist() for c in range(4)], strict=True)):
                own = hashes[sets[k] : sets[k + 1]]
                if at != (hub, part):
                    at, held = (hub, part), []
                if kind == 0:
                    held.append(own.copy())
                else:
                    yield hub, held, id_, own


def within(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which entries of the sorted x are in the sorted y."""
    return y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x if len(y) else np.zeros(len(x), bool)


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of class representatives that are similar enough: pruned on signatures, then verified on texts."""
    sides = [classes.select(F.col("id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("signature").alias(f"signature_{x}")) for x in "ab"]
    sized = pairs.join(sides[0], "a").join(sides[1], "b").filter(100 * F.least("n_a", "n_b") >= THRESHOLD_PERCENT * F.greatest("n_a", "n_b"))

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, HASHES) for k in (2, 3))
            yield batch.select([0, 1]).filter(pa.array(survivors(a, b)))

    alive = written(shipped(sized.select("a", "b", "signature_a", "signature_b")).mapInArrow(prune, "a long, b long"), "survivors")
    ends = written(alive.select(F.col("a").alias("id")).union(alive.select("b")).groupBy("id").agg(F.count(F.lit(1)).alias("n")), "ends")  # as a table, so that a hub's pairs can be split in the joins
    ranked = alive.join(ends.select(F.col("id").alias("a"), F.col("n").alias("n_a")), "a").join(ends.select(F.col("id").alias("b"), F.col("n").alias("n_b")), "b")
    first = F.col("n_a") >= F.col("n_b")
    spokes = ranked.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("spoke"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])
        for hub, sets, spoke, x in beside_hubs(batches):
            if len(found) >= 10_000:
                yield flush()
                found = []
            for y in sets:
                both = int(within(x, y).sum())
                if both > 0 and 100 * both >= THRESHOLD_PERCENT * (len(x) + len(y) - both):
                    found.append((min(hub, spoke), max(hub, spoke)))
                    break
        if found:
            yield flush()

    return written(shipped(around_hubs(spokes, docs)).mapInArrow(verify, "a long, b long"), "links")


def across_hub(members: DataFrame, of_class: DataFrame, degrees: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (a, b) among the members of large bands that may be similar across components, without comparing all of them.

    members: key, id, component. A component's hub is its vertex with most candidates, and the hub of a band is the greatest
    hub of its members' components. With o shingles in common with the hub, two members have at most
    min(o_a, o_b) + (shingles that both have and the hub hasn't) in common. So a pair at the threshold of 3/4, which has 3/7 (n_a + n_b) in common at least, either satisfies
    7 min(o_a, o_b) >= 3 (n_a + n_b) or shares a shingle that the hub hasn't. A pair across components has a member that
    isn't in the hub's: a stray. Strays look the first kind up by size (few sizes are left, as a stray has little in common
    with the hub) and the second by shingle. A stray that lacks k of the 3/4 n_a shingles that it must share has to find k
    among those that the hub hasn't, so all but its k - 1 most frequent ones are enough to look up.
    """
    best = F.max(F.struct("degree", (-F.col("id")).alias("m")))
    hubs = degrees.join(of_class, "id", "left").groupBy(F.coalesce("component", "id").alias("component")).agg(best.alias("top"))
    hubs = written(hubs.select("component", "top.degree", (-F.col("top.m")).alias("hub")), "hubs")
    chosen = members.join(hubs, "component").groupBy("key").agg(F.max(F.struct("degree", (-F.col("hub")).alias("m"), F.col("component").alias("home"))).alias("top"))
    chosen = written(chosen.select("key", (-F.col("top.m")).alias("hub"), "top.home"), "chosen")
    members = written(members.join(chosen, "key").select("id", "component", "home", "hub").distinct(), "hub-members")
    spokes = members.select("hub", F.col("id").alias("spoke")).distinct()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hub, sets, id_, x in beside_hubs(batches):
            rest = x[~within(x, sets[0])]
            yield pa.RecordBatch.from_arrays([pa.array([id_], pa.int64()), pa.array([hub], pa.int64()), pa.array([len(x)], pa.int64()), pa.array([len(x) - len(rest)], pa.int64()), pa.array([rest.view(np.int64)], pa.list_(pa.int64()))], names=["id", "hub", "n", "o", "rest"])

    measured = shipped(around_hubs(spokes, docs)).mapInArrow(measure, "id long, hub long, n long, o long, rest array<long>")
    measured = written(measured.join(members, ["id", "hub"]), "measured")
    strays = measured.filter("component <> home").select("hub", F.col("id").alias("a"), F.col("component").alias("component_a"), F.col("n").alias("n_a"), F.col("o").alias("o_a"), F.col("rest").alias("rest_a"))
    least = F.ceil(F.col("n_a") * THRESHOLD_PERCENT / 100).cast("long")
    most = F.least(F.floor(F.col("n_a") * 100 / THRESHOLD_PERCENT), F.floor(F.col("o_a") * 7 / 3 - F.col("n_a"))).cast("long")
    sized = strays.filter(least <= most).select("hub", "a", "component_a", "n_a", F.explode(F.sequence(least, most)).alias("n"))
    alike = sized.join(measured.select("hub", "id", "component", "n", "o"), ["hub", "n"]).filter("component <> component_a AND 7 * o >= 3 * (n + n_a)")
    tokens = measured.select("hub", "id", "component", F.explode("rest").alias("token"))
    common = tokens.groupBy("hub", "token").agg(F.count(F.lit(1)).alias("df"))
    short = F.greatest(F.ceil(F.col("n_a") * THRESHOLD_PERCENT / 100) - F.col("o_a"), F.lit(1))
    asked = strays.select("hub", "a", "component_a", (F.size("rest_a") - short + 1).alias("prefix"), F.explode("rest_a").alias("token")).join(common, ["hub", "token"])
    rarest = F.row_number().over(Window.partitionBy("hub", "a").orderBy("df", "token"))
    extra = asked.withColumn("nth", rarest).filter("nth <= prefix AND df > 1").join(tokens, ["hub", "token"]).filter("component <> component_a")
    return alike.select("a", "id").union(extra.select("a", "id")).select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b"))


def near_components(docs: DataFrame) -> DataFrame:
    """A row per row of docs: doc_id, n_shingles and component_id."""
    sketched = written(sketch(docs), "sketches")
    linked = sketched.filter("n_shingles > 0 AND id IS NOT NULL")
    classes_of = written(linked.groupBy("d0", "d1", "n_shingles").agg(F.min("id").alias("class")), "classes")
    stands = classes_of.select(F.col("class").alias("id"), "d0", "d1", "n_shingles")
    classes = written(linked.join(stands, ["id", "d0", "d1", "n_shingles"]).select("id", "n_shingles", "signature").distinct(), "signatures")

    banded = written(explode_bands(classes), "bands")
    shared = written(banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "shared")
    members = written(banded.join(shared, "key"), "members")
    degrees = written(members.groupBy("id").agg(F.sum("n").alias("degree")), "degrees")
    centres = members.join(degrees, "id").groupBy("key").agg(F.max(F.struct("degree", (-F.col("id")).alias("m"))).alias("top"))
    centres = written(centres.select("key", (-F.col("top.m")).alias("centre")), "centres")
    order = (F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b"))
    stars = written(members.join(centres, "key").filter("id <> centre").select(*order).distinct(), "stars")
    links = confirmed(stars, classes, docs)
    of_class = components(links)

    placed = members.select("key", "id").join(of_class, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    placed = written(placed, "placed")
    mixed = written(placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("key"), "mixed")
    mixed = written(placed.join(mixed, "key").join(shared, "key").select("key", "id", "component", "n"), "mixed")
    few = mixed.filter(F.col("n") <= SMALL_BAND)
    other = few.select("key", F.col("id").alias("b"), F.col("component").alias("component_b"))
    crossed = few.withColumnRenamed("id", "a").join(other, "key").filter("a < b AND component <> component_b").select("a", "b")
    many = mixed.filter(F.col("n") > SMALL_BAND).select("key", "id", "component")
    if not many.isEmpty():
        crossed = crossed.unionByName(across_hub(many, of_class, degrees, docs))
    crossed = crossed.distinct()
    crossed = written(crossed.join(stars, ["a", "b"], "left_anti"), "crossed")
    if not crossed.isEmpty():
        more = confirmed(crossed, classes, docs)
        if not more.isEmpty():
            of_class = components(links.union(more))

    roots = classes_of.join(of_class.withColumnRenamed("id", "class"), "class", "left").select("d0", "d1", "n_shingles", F.coalesce("component", "class").alias("root"))
    roots = written(roots, "roots")
    slim = sketched.select(F.col("id").alias("doc_id"), "n_shingles", "d0", "d1")
    return slim.join(roots, ["d0", "d1", "n_shingles"], "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("root", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs without near copies: of each group, the row of the smallest doc_id (null last, then by a digest of
    the text) stays, once if that row repeats. Rows that share a doc_id but not their text are told apart, and rows without
    a doc_id are grouped like others; rows without words all stay."""
    key = F.xxhash64(F.lit(3), F.coalesce("text", F.lit("")), F.col("text").isNull())
    odd = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("_odd"), F.lit(True).alias("_is_odd"))
    odd = written(odd, "odd-ids")
    marked = docs.join(odd, F.col("doc_id").eqNullSafe(F.col("_odd")), "left").drop("_odd")
    alone = F.xxhash64(F.lit(4), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce("text", F.lit("")))
    vertex = F.when(F.col("_is_odd"), alone).otherwise(F.col("doc_id")).cast("long")
    found = written(near_components(marked.select(vertex.alias("doc_id"), "text")).distinct(), "vertices")
    ids = marked.filter("_is_odd").select(alone.alias("doc_id"), F.col("doc_id").cast("long").alias("own"), key.alias("key")).distinct()
    named = found.join(ids.withColumnRenamed("doc_id", "_v"), F.col("doc_id") == F.col("_v"), "left").filter("n_shingles > 0")
    own = F.when(F.col("_v").isNull(), F.col("doc_id")).otherwise(F.col("own"))
    named = written(named.select("doc_id", "component_id", F.struct(own.isNull().alias("last"), own.alias("own"), F.col("key"), F.col("doc_id").alias("v")).alias("rank")), "ranked")
    stays = named.groupBy("component_id").agg(F.min("rank").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    stays = written(stays, "stays")  # as a table, so that a large group can be split in the join
    gone = named.join(stays, "component_id").filter(F.col("rank.v") != F.col("least.v")).select(F.col("doc_id").alias("_gone"))
    left = marked.join(gone.hint("merge"), vertex == F.col("_gone"), "left_anti")  # at any size, as above
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    again = left.filter(F.col("_is_odd") & worded).withColumn("_key", key).dropDuplicates(["doc_id", "_key"])
    return left.filter(F.col("_is_odd").isNull() | ~worded).unionByName(again.drop("_key")).drop("_is_odd")


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


QUERIES = {"op8_minhash_near_dedup": op8_minhash_near_dedup}
ORACLES = {
    "op8_minhash_near_dedup": r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[k:k+4], ' ') AS g FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) AS k FROM t WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), e AS (
  SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * shared >= 75 * (x.n + y.n - shared)
), r AS (
  SELECT doc_id AS v, doc_id AS c FROM t
  UNION
  SELECT e.b, r.c FROM r JOIN e ON e.a = r.v WHERE r.c < e.b
), c AS (
  SELECT v, min(c) AS component_id FROM r GROUP BY v
)
SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, t.doc_id = c.component_id AS kept FROM t LEFT JOIN n USING (doc_id) JOIN c ON c.v = t.doc_id
""",
}
