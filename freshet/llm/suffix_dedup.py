"""Removal of repeated strings by a distributed merge sort of suffixes that is aware of common prefixes.

Every byte covered by a string of WIDTH bytes that also starts elsewhere goes. Sorting a suffix at every byte isn't needed
for that: each string of WIDTH bytes holds the same anchor wherever it stands (the leftmost minimum of the hashes of its
runs of `grain` bytes), so it repeats exactly if two anchors agree on enough bytes to their left and right. Anchors lie
about (WIDTH - grain) / 2 bytes apart.

1. Anchors of all texts; those whose run of `grain` bytes occurs once in the corpus are done with.
2. For the rest, the right context (WIDTH bytes from the anchor on) and the left one (WIDTH - grain bytes before it, read
   backwards). Anchors with equal contexts are one class, so a passage in a third of all texts is sorted once.
3. The suffixes right + left are sorted, and so are left + right: each task sorts its part and cuts it into runs at
   splitters from a sample of bounded size (at two levels where one doesn't make ranges small enough); runs are
   front-coded (a prefix's length, then the rest) for the exchange; each range merges its runs with a loser tree whose
   nodes keep the prefix that a loser shares with the winner that beat it. Of two heads, the one that shares more with the
   last output is less, without a look at either; only equal lengths compare bytes, from there. A head's own length comes
   from its front code. The merge's prefixes are those of neighbours in suffix order.
4. A neighbour that agrees on R bytes to the right and L to the left repeats the strings that start j bytes before the
   anchor, WIDTH - R <= j <= L. No anchor can repeat a string outside of WIDTH - max R <= j <= max L. Where these bounds
   leave a j open (contexts that several others share in part), the strings themselves are grouped by digest (`settle`).

Defined cases: a null text counts as empty; texts that repeat (rows that repeat too) remove each other if they have WIDTH
bytes; bytes are UTF-8 and cuts may fall within characters; an empty table gives an empty result; columns other than
doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections import deque
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm.storage import shipped, written
from freshet.llm.textops import BYTE_VALUE, BYTES, chunks, mix

WIDTH = 400
#: Classes that a range of the merge holds, about, and samples for each splitter.
RANGE_CLASSES, SAMPLES = 40_000, 8
#: Ranges whose splitters go through the driver; beyond, each of as many parts is cut again, over SALTS tasks.
MOST_SPLITTERS, SALTS = 4096, 16
#: Bytes of contexts that a task sorts into one run.
RUN_BYTES = 8 << 20
#: Neighbours on either side that may settle what the next ones leave open.
LOOK = 2


def grain_of(width: int) -> int:
    return max(1, width // 4)


def anchors(data: np.ndarray, offsets: np.ndarray, width: int, grain: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors of a chunk's texts, ascending, and hashes of the `grain` bytes there."""
    n, span = len(data), width - grain + 1
    sizes = np.diff(offsets)
    if not (sizes >= width).any():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    prefix = BYTES.prefix(BYTE_VALUE[data])
    hashes = mix((prefix[grain:] - prefix[:-grain]) * BYTES.get(1, n - grain + 1))
    value = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(n - grain + 1, dtype=np.uint64)
    padded = np.full(-(-len(value) // span) * span + span, np.uint64(2**64 - 1))
    padded[: len(value)] = value
    blocks = padded.reshape(-1, span)
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    ok = np.zeros(n + 1, np.int64)
    long = sizes >= width
    np.add.at(ok, offsets[:-1][long], 1)
    np.add.at(ok, offsets[1:][long] - width + 1, -1)
    windows = np.flatnonzero(np.cumsum(ok)[:n] > 0)
    least = (np.minimum(after[windows], before[windows + span - 1]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    places = np.unique(least)
    return places, hashes[places]


def shared_prefix(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix, known to be at least `start`."""
    low, high = start, min(len(a), len(b))
    if a[low:high] == b[low:high]:
        return high
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def front_code(keys: list[bytes]) -> tuple[list[int], list[bytes]]:
    """For sorted keys: how much each shares with the one before, and the rest."""
    shared, rests, last = [], [], b""
    for key in keys:
        n = shared_prefix(last, key)
        shared.append(n)
        rests.append(key[n:])
        last = key
    return shared, rests


class LoserTree:
    """Merges front-coded runs; yields (key, run, index in the run, prefix shared with the key before)."""

    def __init__(self, runs: list[tuple[list[int], list[bytes]]]):
        self.runs, self.size = runs, 1
        while self.size < len(runs):
            self.size *= 2
        self.at = [0] * self.size
        self.heads: list[bytes | None] = [rests[0] if rests else None for _, rests in runs] + [None] * (self.size - len(runs))
        self.shared = [0] * self.size
        self.losers = [0] * self.size

    def play(self, i: int, j: int) -> tuple[int, int]:
        """(winner, loser) of two runs' heads; the loser's shared prefix becomes that with the winner."""
        a, b = self.heads[i], self.heads[j]
        if b is None:
            return i, j
        if a is None:
            return j, i
        if self.shared[i] != self.shared[j]:
            return (i, j) if self.shared[i] > self.shared[j] else (j, i)
        n = shared_prefix(a, b, self.shared[i])
        first = n == len(a) or (n < len(b) and a[n] < b[n])
        winner, loser = (i, j) if first else (j, i)
        self.shared[loser] = n
        return winner, loser

    def build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        winner, self.losers[node] = self.play(self.build(2 * node), self.build(2 * node + 1))
        return winner

    def __iter__(self) -> Iterator[tuple[bytes, int, int, int]]:
        top = self.build(1) if self.size > 1 else 0
        while (key := self.heads[top]) is not None:
            yield key, top, self.at[top], self.shared[top]
            shared, rests = self.runs[top]
            self.at[top] = k = self.at[top] + 1
            if k < len(rests):
                self.heads[top], self.shared[top] = key[: shared[k]] + rests[k], shared[k]
            else:
                self.heads[top] = None
            node = (top + self.size) // 2
            while node:
                top, self.losers[node] = self.play(top, self.losers[node])
                node //= 2


def distinct_keys(keyed: DataFrame, share: float) -> DataFrame:
    """The keys of about a share of all classes, each once: a class that many entries have is no more than another."""
    return keyed.filter(F.pmod("d1", F.lit(1 << 40)) < int(share * (1 << 40)) + 1).groupBy("d0", "d1").agg(F.first("key").alias("key"))


def coarse_splitters(keyed: DataFrame, total: int, n: int) -> list[bytes]:
    """At most n - 1 keys that cut the classes into parts of about equal size, from a sample of about SAMPLES * n keys: both
    are bounded by MOST_SPLITTERS, whatever the size of the input."""
    if n < 2:
        return []
    picked = sorted(set(distinct_keys(keyed, min(1.0, SAMPLES * n / max(1, total))).select("key").toArrow()["key"].to_pylist()))
    return sorted({picked[len(picked) * k // n] for k in range(1, n)}) if picked else []


def fine_splitters(keyed: DataFrame, coarse: list[bytes], share: float) -> DataFrame:
    """part, splitters: for each part that the coarse splitters make, the keys that cut it into ranges. A table of its own,
    as its size grows with the input."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([bisect_right(coarse, k) for k in batch.column(0).to_pylist()], pa.int32()), batch.column(0)], names=["part", "key"])

    placed = shipped(distinct_keys(keyed, share).select("key")).mapInArrow(place, "part int, key binary")
    ordered = placed.groupBy("part").agg(F.array_sort(F.collect_set("key")).alias("ordered"))
    nth = F.expr(f"transform(filter(sequence(0, size(ordered) - 1), k -> k > 0 AND k % {SAMPLES} = 0), k -> ordered[k])")
    return ordered.select("part", nth.alias("splitters"))


def cut_run(rows: list[tuple], splitters: list[bytes]) -> Iterator[tuple[int, dict]]:
    """A sorted run of (d0, d1, head, place, several, low, key), cut at the splitters: the number of each range that it
    reaches, and its rows there, front-coded."""
    cut = 0
    while cut < len(rows):
        k = bisect_right(splitters, rows[cut][-1])
        to = bisect_left(rows, splitters[k], cut, key=lambda r: r[-1]) if k < len(splitters) else len(rows)
        part = rows[cut:to]
        shared, rests = front_code([r[-1] for r in part])
        columns = [[r[c] for r in part] for c in range(6)]
        yield k, dict(zip(RUN_SCHEMA.names[2:], (*columns, shared, [len(r) for r in rests], b"".join(rests)), strict=True))
        cut = to


def run_keys(row: dict) -> list[bytes]:
    keys, last, at = [], b"", 0
    for n, size in zip(row["shared"], row["sizes"], strict=True):
        last = last[:n] + row["rests"][at : at + size]
        keys.append(last)
        at += size
    return keys


def add_entry(group: dict, d0: int, d1: int, head: int, place: int, several: bool, low: int) -> None:
    """Adds an entry to the classes of one key."""
    known = group.setdefault((d0, d1), [head, place, several, low])
    known[2] = known[2] or several or known[1] != place


def ranged_runs(keyed: DataFrame, total: int, n_ranges: int) -> tuple[DataFrame, int]:
    """Sorted, front-coded runs of the entries, cut into ranges of about RANGE_CLASSES classes, and the number of parts: the
    ranges of a part follow one another, and so do parts.

    Up to MOST_SPLITTERS ranges, each is a part. Beyond, runs go to the parts first and are cut there at splitters that
    travel as rows of that exchange, so no task gets those of other parts and none go through the driver."""
    coarse = coarse_splitters(keyed, total, min(n_ranges, MOST_SPLITTERS))

    def make_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: list[list] = [[] for _ in range(7)]
        held = 0

        def run() -> Iterator[pa.RecordBatch]:
            keys = columns[-1]
            rows: list[tuple] = []
            for key, same in groupby(sorted(range(len(keys)), key=keys.__getitem__), keys.__getitem__):
                group: dict = {}
                for i in same:
                    add_entry(group, *[c[i] for c in columns[:6]])
                rows += [(*c, *facts, key) for c, facts in group.items()]
            for k, facts in cut_run(rows, coarse):
                yield pa.RecordBatch.from_pylist([{"part": k, "range": 0} | facts], schema=RUN_SCHEMA)

        for batch in batches:
            for column, more in zip(columns, batch.columns, strict=True):
                column += more.to_pylist()
            held += batch.column(6).nbytes
            if held >= RUN_BYTES:
                yield from run()
                columns, held = [[] for _ in range(7)], 0
        yield from run()

    runs = shipped(keyed).mapInArrow(make_runs, RUN)
    parts = len(coarse) + 1
    if n_ranges <= MOST_SPLITTERS:
        return runs, parts

    def cut_finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitters: list[bytes] = []
        for batch in batches:
            for row in batch.to_pylist():
                if row["splitters"] is not None:
                    splitters = row["splitters"]
                    continue
                rows = list(zip(*[row[c] for c in RUN_SCHEMA.names[2:8]], run_keys(row), strict=True))
                for k, facts in cut_run(rows, splitters):
                    at = row["part"] * SALTS + k * SALTS // (len(splitters) + 1)
                    yield pa.RecordBatch.from_pylist([{"part": at, "range": k} | facts], schema=RUN_SCHEMA)

    fine = fine_splitters(keyed, coarse, min(1.0, SAMPLES * n_ranges / max(1, total)))
    fine = fine.select("part", "splitters", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = runs.withColumn("salt", F.pmod(F.xxhash64("rests"), F.lit(SALTS)).cast("int"))
    both = salted.unionByName(fine, allowMissingColumns=True).withColumn("first", F.col("splitters").isNull())
    both = both.repartitionById(parts * SALTS, F.col("part") * SALTS + F.col("salt")).sortWithinPartitions("first").select(*RUN_SCHEMA.names, "splitters")
    return both.mapInArrow(cut_finer, RUN), parts * SALTS


def suffix_sort(entries: DataFrame, right_first: bool, total: int, width: int, look: int) -> DataFrame:
    """entries (`total` of them): d0, d1 (class), right, left, place (a digest of where it stands), several, low (no j below
    it can repeat) -> a row per class in suffix order over parts (SORTED): whether it stands in several places, its key
    (first context, then the other; only kept for the first sort and for edges of parts), a bound (no class agrees on more
    of the first context), and what neighbours agree on to the right and to the left: the next ones on either side, and of
    up to `look` on either side those that settle further j.

    Entries of one class are merged within a task's run before the exchange, and within a range behind it. A task holds
    the runs of one range at a time."""
    first, second = ("right", "left") if right_first else ("left", "right")
    keyed = entries.select("d0", "d1", F.length(first).cast("int").alias("head"), "place", "several", "low", F.concat(first, second).alias("key"))
    runs, parts = ranged_runs(keyed, total, max(1, -(-total // RANGE_CLASSES)))

    def merged(rows: Iterator[dict]) -> Iterator[Neighbour]:
        """The classes of a part, in order; each knows what its key shares with the one before."""
        before = b""
        for _, of_range in groupby(rows, itemgetter("range")):
            held, coded = list(of_range), []
            for row in held:
                ends = np.cumsum([0, *row["sizes"]]).tolist()
                coded.append((row["shared"], [row["rests"][a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]))
            for nth, (key, same) in enumerate(groupby(LoserTree(coded), itemgetter(0))):
                group: dict = {}
                agrees = None if nth else shared_prefix(before, key)
                for _, run, i, shared in same:
                    agrees = shared if agrees is None else agrees
                    add_entry(group, *[held[run][c][i] for c in RUN_SCHEMA.names[2:8]])
                for (d0, d1), (head, _, several, low) in group.items():
                    yield Neighbour(d0, d1, head, several, low, key, agrees)
                    agrees = len(key)
                before = key

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in groupby((row for batch in batches for row in batch.to_pylist()), itemgetter("part")):
            out: list[tuple] = []
            recent: deque[Neighbour] = deque()
            edge: int | None = 1

            def leave(x: Neighbour, edge: int | None) -> tuple:
                return (x.d0, x.d1, x.head, x.several, x.key if right_first or edge else None, part, edge, x.bound, x.rights, x.lefts)  # noqa: B023

            for now in merged(rows):
                shared = now.shared
                for nth, other in enumerate(reversed(recent)):
                    if nth and other.settled(width) and now.settled(width):
                        shared = min(shared, other.shared)
                        continue
                    if nth and min(shared, now.head) < now.low and min(shared, other.head) < other.low:
                        break
                    other.meet(now, shared, right_first, width, nth == 0)
                    shared = min(shared, other.shared)
                recent.append(now)
                if len(recent) > look:
                    out.append(leave(recent.popleft(), edge))
                    edge = None
                if len(out) > 10_000:
                    yield to_batch(out, SORTED)
                    out = []
            while recent:
                x = recent.popleft()
                out.append(leave(x, edge if recent else 2 if edge is None else 3))
                edge = None
            if out:
                yield to_batch(out, SORTED)

    placed = runs.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "range")
    found = written(placed.mapInArrow(merge, SORTED_DDL), "sorted")
    return found.unionByName(across_parts(found, right_first, width), allowMissingColumns=True) if parts > 1 else found


class Neighbour:
    """A class in suffix order, with what it has learned from others."""

    __slots__ = ("d0", "d1", "head", "several", "low", "key", "shared", "bound", "rights", "lefts", "done")

    def __init__(self, d0: int, d1: int, head: int, several: bool, low: int, key: bytes, shared: int):
        self.d0, self.d1, self.head, self.several, self.low, self.key, self.shared = d0, d1, head, several, low, key, shared
        self.bound, self.rights, self.lefts, self.done = None, [], [], []

    def settled(self, width: int) -> bool:
        """Is every j from low to the bound (of a sort by left contexts) known to repeat?"""
        return self.several or any(a <= self.low and b >= (self.bound or 0) for a, b in self.done)

    def learn(self, bound: int, right: int, left: int, width: int, keep: bool) -> None:
        self.bound = max(bound, self.bound or 0)
        a, b = max(0, width - right), left
        if a <= b and not any(x <= a and b <= y for x, y in self.done):
            keep = True
            near = [r for r in self.done if r[0] <= b + 1 and a <= r[1] + 1]
            self.done = [r for r in self.done if r not in near] + [(min([a, *(r[0] for r in near)]), max([b, *(r[1] for r in near)]))]
        if keep:
            self.rights.append(right)
            self.lefts.append(left)

    def meet(self, other: Neighbour, shared: int, right_first: bool, width: int, keep: bool) -> None:
        """Both learn what they agree on; their keys share a prefix of the given length."""
        heads = min(shared, self.head, other.head)
        tails = shared_prefix(self.key[self.head :], other.key[other.head :])
        right, left = (heads, tails) if right_first else (tails, heads)
        self.learn(min(shared, self.head), right, left, width, keep)
        other.learn(min(shared, other.head), right, left, width, keep)


def across_parts(found: DataFrame, right_first: bool, width: int) -> DataFrame:
    """The last class of a part and the first of the next one are neighbours too: rows of d0, d1 and what they agree on."""
    used = sorted(r["part"] for r in found.filter("edge IN (1, 3)").select("part").collect())  # a number per part: MOST_SPLITTERS * SALTS at most
    following = found.sparkSession.createDataFrame([(a, b) for a, b in zip(used[:-1], used[1:], strict=True)], "part int, next int")
    side = lambda edge, k: found.filter(F.col("edge").isin(edge, 3)).select(F.col("part").alias("part" if k == "a" else "next"), *[F.col(c).alias(f"{k}_{c}") for c in ("d0", "d1", "head", "key")])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a0, a1, ah, ak, b0, b1, bh, bk in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                a, b = Neighbour(a0, a1, ah, False, 0, ak, 0), Neighbour(b0, b1, bh, False, 0, bk, 0)
                a.meet(b, shared_prefix(ak, bk), right_first, width, True)
                out += [(x.d0, x.d1, x.bound, x.rights, x.lefts) for x in (a, b)]
            if out:
                yield to_batch(out, pa.schema([SORTED.field(n) for n in ("d0", "d1", "bound", "rights", "lefts")]))

    pairs = side(2, "a").join(following, "part").join(side(1, "b"), "next")
    pairs = pairs.select(*[f"{k}_{c}" for k in "ab" for c in ("d0", "d1", "head", "key")])
    return pairs.mapInArrow(meet, "d0 long, d1 long, bound int, rights array<int>, lefts array<int>")


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


RUN = "part int, range int, d0 array<long>, d1 array<long>, heads array<int>, places array<long>, several array<boolean>, lows array<int>, shared array<int>, sizes array<int>, rests binary"
RUN_SCHEMA = pa.schema([("part", pa.int32()), ("range", pa.int32()), ("d0", pa.list_(pa.int64())), ("d1", pa.list_(pa.int64())), ("heads", pa.list_(pa.int32())), ("places", pa.list_(pa.int64())), ("several", pa.list_(pa.bool_())), ("lows", pa.list_(pa.int32())), ("shared", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32())), ("rests", pa.binary())])
SORTED_DDL = "d0 long, d1 long, head int, several boolean, key binary, part int, edge int, bound int, rights array<int>, lefts array<int>"
SORTED = pa.schema([("d0", pa.int64()), ("d1", pa.int64()), ("head", pa.int32()), ("several", pa.bool_()), ("key", pa.binary()), ("part", pa.int32()), ("edge", pa.int32()), ("bound", pa.int32()), ("rights", pa.list_(pa.int32())), ("lefts", pa.list_(pa.int32()))])


def digest(data: bytes) -> tuple[int, int]:
    whole = xxhash.xxh3_128_intdigest(data)
    return (whole >> 64) - (1 << 63), (whole & (1 << 64) - 1) - (1 << 63)


def repeated_starts(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """For each distinct text (t0, t1): a row of t0, t1, place and the ranges [low, high] of j, for anchors (at `place`)
    before which a string of `width` bytes that starts j bytes earlier repeats."""
    grain = grain_of(width)
    reach = width - grain

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in chunks(batch):
                places, hashes = anchors(data, offsets, width, grain)
                doc = np.searchsorted(offsets, places, "right") - 1
                columns = [rows.column(k).take(pa.array(doc)) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array((places - offsets[doc]).astype(np.int64)), pa.array(hashes.view(np.int64))], names=["doc_id", "t0", "t1", "place", "run"])

    keyed = keyed_texts(docs)
    found = shipped(keyed.filter(F.octet_length("text") >= width)).mapInArrow(find, "doc_id long, t0 long, t1 long, place long, run long")
    found = written(found.groupBy("run", "t0", "t1", "place").agg(F.min("doc_id").alias("doc_id")), "anchors")
    shared = written(found.groupBy("run").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("run"), "runs")
    wanted = found.join(shared, "run").groupBy("t0", "t1", "doc_id").agg(F.collect_list("place").alias("places"))
    wanted = written(wanted.withColumnsRenamed({"t0": "w0", "t1": "w1", "doc_id": "w"}), "wanted")
    both = keyed.join(wanted, (F.col("t0") == F.col("w0")) & (F.col("t1") == F.col("w1")) & F.col("doc_id").eqNullSafe(F.col("w")))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["t0", "t1", "place", "d0", "d1", "right", "left"]
        for batch in batches:
            for at in range(batch.num_rows):
                t0, t1, text, places = (batch.column(k)[at].as_py() for k in range(4))
                text, out = text.encode(), []
                for place in places:
                    right, left = text[place : place + width], text[max(0, place - reach) : place][::-1]
                    out.append((t0, t1, place, *digest(right + len(left).to_bytes(4, "little") + left), right, left))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n in ("right", "left") else pa.int64()) for n, c in zip(names, zip(*out, strict=True), strict=True)], names=names)

    around = written(shipped(both.select("t0", "t1", "text", "places")).mapInArrow(contexts, "t0 long, t1 long, place long, d0 long, d1 long, right binary, left binary"), "contexts")
    entries = around.select("d0", "d1", "right", "left", F.xxhash64("t0", "t1", "place").alias("place"), F.lit(False).alias("several"), F.lit(0).alias("low"))
    by_right = suffix_sort(entries, True, around.count(), width, 1)
    whole = by_right.filter(F.col("key").isNotNull())
    reps = whole.select("d0", "d1", F.substring("key", F.lit(1), F.col("head")).alias("right"), F.substring("key", F.col("head") + 1, F.length("key")).alias("left"), F.lit(0).cast("long").alias("place"), "several", F.greatest(F.lit(0), width - F.coalesce("bound", F.lit(0))).alias("low"))
    by_left = suffix_sort(reps, False, reps.count(), width, LOOK)
    pairs = F.coalesce(F.transform(F.arrays_zip("rights", "lefts"), lambda x: F.struct(x["rights"].alias("right_agrees"), x["lefts"].alias("left_agrees"))), F.array().cast("array<struct<right_agrees:int,left_agrees:int>>"))
    own = F.when(F.col("several"), F.array(F.struct(F.length("right").alias("right_agrees"), F.length("left").alias("left_agrees")))).otherwise(F.array().cast("array<struct<right_agrees:int,left_agrees:int>>"))
    none = F.lit(None).cast("int")
    said = [
        by_right.select("d0", "d1", F.col("bound").alias("right_bound"), none.alias("left_bound"), pairs.alias("agree")),
        by_left.select("d0", "d1", none.alias("right_bound"), F.col("bound").alias("left_bound"), pairs.alias("agree")),
        reps.filter("several").select("d0", "d1", F.length("right").alias("right_bound"), F.length("left").alias("left_bound"), own.alias("agree")),
    ]
    judged = said[0].unionByName(said[1]).unionByName(said[2]).groupBy("d0", "d1")
    agree = F.array_distinct(F.flatten(F.collect_list("agree")))
    judged = judged.agg(F.max("right_bound").alias("right_most"), F.max("left_bound").alias("left_most"), agree.alias("agree"))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for d0, d1, right_most, left_most, agree in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                low, high = max(0, width - (right_most or 0)), min(left_most or 0, reach)
                hit = sorted((max(0, width - x["right_agrees"]), min(x["left_agrees"], reach)) for x in agree)
                merged: list[list[int]] = []
                for a, b in hit:
                    if a <= b:
                        if merged and a <= merged[-1][1] + 1:
                            merged[-1][1] = max(merged[-1][1], b)
                        else:
                            merged.append([a, b])
                open_, at = [], low
                for a, b in merged:
                    open_ += range(at, min(a, high + 1))
                    at = max(at, b + 1)
                open_ += range(at, high + 1)
                rows.append((d0, d1, low, high, [{"low": a, "high": b} for a, b in merged], open_))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), DECIDED, strict=True)], schema=DECIDED)

    decided = written(shipped(judged).mapInArrow(decide, "d0 long, d1 long, low int, high int, ranges array<struct<low:int,high:int>>, open array<int>"), "decided")
    ranges = decided.select("d0", "d1", F.explode("ranges").alias("r")).select("d0", "d1", "r.low", "r.high")
    if not decided.filter(F.size("open") > 0).isEmpty():
        ranges = ranges.unionByName(settle(decided, reps, width, grain))
    ranges = written(ranges.groupBy("d0", "d1").agg(F.collect_set(F.struct("low", "high")).alias("ranges")), "ranges")
    return around.select("t0", "t1", "place", "d0", "d1").join(ranges, ["d0", "d1"]).select("t0", "t1", "place", "ranges")


def settle(decided: DataFrame, reps: DataFrame, width: int, grain: int) -> DataFrame:
    """The open j of classes for which the string repeats: d0, d1, low, high (equal).

    Whoever repeats a string that starts j bytes before its anchor agrees with it from the start of j's band to the end of
    what all j of the band have in common. So classes are first met by a digest of that stretch, and only those that meet
    an open class write digests of the strings themselves."""
    band = max(1, width // 20)

    def stretch(right: bytes, left: bytes, b: int) -> tuple[int, int] | None:
        before, behind = b * band, max(0, width - b * band - band + 1)
        return digest(left[:before][::-1] + right[:behind]) if before <= len(left) and behind <= len(right) else None

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for run, js, right, left in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for b in sorted({j // band for j in js}):
                    found = stretch(right, left, b)
                    if found:
                        rows += [(run, b, *found, j) for j in js if j // band == b]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["run", "band", "k0", "k1", "j"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for d0, d1, right, left, bands in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                rows += [(d0, d1, b, *found) for b in bands if (found := stretch(right, left, b))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["d0", "d1", "band", "k0", "k1"])

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for d0, d1, right, left, js, low, high, open_ in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for j in js:
                    if low <= j <= high and j <= len(left) and width - j <= len(right):
                        rows.append((d0, d1, j, *digest(left[:j][::-1] + right[: width - j]), int(j in open_)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["d0", "d1", "j", "s0", "s1", "asks"])

    facts = written(reps.select("d0", "d1", F.xxhash64(F.substring("right", 1, grain)).alias("run")).join(decided.select("d0", "d1", "low", "high", "open"), ["d0", "d1"]), "facts")
    bands = facts.select("run", F.explode("open").alias("j")).select("run", F.floor(F.col("j") / band).alias("band")).groupBy("run").agg(F.collect_set("band").alias("bands"))
    reached = F.filter("bands", lambda b: ((b + 1) * band > F.col("low")) & (b * band <= F.col("high")))
    wanted = facts.join(written(bands, "bands"), "run").withColumn("bands", reached).filter(F.size("bands") > 0)
    facing = written(reps.select("d0", "d1", "right", "left").join(wanted.hint("merge"), ["d0", "d1"]), "facing")
    asked = written(shipped(facing.filter(F.size("open") > 0).select("run", "open", "right", "left")).mapInArrow(ask, "run long, band long, k0 long, k1 long, j long").distinct(), "asked")
    met = shipped(facing.select("d0", "d1", "right", "left", "bands")).mapInArrow(meet, "d0 long, d1 long, band long, k0 long, k1 long")
    js = written(asked.groupBy("band", "k0", "k1").agg(F.collect_set("j").alias("js")), "js")
    met = met.join(js, ["band", "k0", "k1"]).groupBy("d0", "d1").agg(F.array_distinct(F.flatten(F.collect_list("js"))).alias("js"))
    full = facing.join(written(met, "met"), ["d0", "d1"])
    cut = written(shipped(full.select("d0", "d1", "right", "left", "js", "low", "high", "open")).mapInArrow(strings, "d0 long, d1 long, j long, s0 long, s1 long, asks long"), "strings")
    twice = written(cut.groupBy("s0", "s1", "j").agg(F.count(F.lit(1)).alias("n"), F.max("asks").alias("asks")).filter("n > 1 AND asks = 1").select("s0", "s1", "j"), "twice")
    return cut.filter("asks = 1").join(twice, ["s0", "s1", "j"]).select("d0", "d1", F.col("j").cast("int").alias("low"), F.col("j").cast("int").alias("high"))


DECIDED = pa.schema([("d0", pa.int64()), ("d1", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("ranges", pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))), ("open", pa.list_(pa.int32()))])


def keyed_texts(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and a key of 128 bits for it. Each column's hash seeds the next, so the literal goes first:
    behind the text, both halves would be functions of one hash of 64 bits."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(F.lit(1), text).alias("t0"), F.xxhash64(F.lit(2), text).alias("t1")).select("doc_id", "t0", "t1", "text")


def spans_of(n: int, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal removed runs, from low, high, low, high, ...: ranges of the starts of repeated strings."""
    low, high = starts[::2], starts[1::2]
    order = np.argsort(low)
    low, high = low[order], np.maximum.accumulate(high[order]) + width
    new = np.ones(len(low), bool)
    new[1:] = low[1:] > high[:-1]
    return low[new], np.minimum(high[np.append(np.flatnonzero(new)[1:] - 1, len(low) - 1)] if len(low) else high, n)


def dedup(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """A row per row of docs: doc_id, n_bytes, n_removed, spans ([start, end) of removed runs, in bytes) and kept (bytes)."""
    keyed = keyed_texts(docs)
    copies = keyed.groupBy("t0", "t1").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("t0", "t1", F.lit(True).alias("copied"), F.lit(None).cast("array<bigint>").alias("starts"))
    starts = repeated_starts(docs, width).select("t0", "t1", F.flatten(F.transform("ranges", lambda r: F.array(F.col("place") - r["high"], F.col("place") - r["low"]))).alias("starts"))
    starts = starts.groupBy("t0", "t1").agg(F.flatten(F.collect_list("starts")).alias("starts"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            places, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            merged = [np.stack([a, b - width], 1).ravel() for a, b in (spans_of(1 << 62, values[x:y], width) for x, y in zip(places[:-1], places[1:], strict=True))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(merged, pa.list_(pa.int64()))], names=["t0", "t1", "starts"])

    starts = shipped(starts).mapInArrow(merge, "t0 long, t1 long, starts array<long>").select("t0", "t1", F.lit(False).alias("copied"), "starts")
    found = copies.unionByName(starts).groupBy("t0", "t1").agg(F.max("copied").alias("copied"), F.first("starts", ignorenulls=True).alias("starts"))
    found = written(found.withColumnsRenamed({"t0": "w0", "t1": "w1"}), "starts").hint("merge")  # texts are shuffled at any size
    both = keyed.join(found, (F.col("t0") == F.col("w0")) & (F.col("t1") == F.col("w1")), "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "n_removed", "spans", "kept"]
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for rows, data, offsets in chunks(batch):
                copied, lists = rows.column(2).to_pylist(), rows.column(3)
                places, values = lists.offsets.to_numpy(), lists.values.to_numpy()
                removed, spans, kept = [], [], []
                for k in range(rows.num_rows):
                    text = data[offsets[k] : offsets[k + 1]]
                    if copied[k] and len(text) >= width:
                        firsts, ends = np.zeros(1, np.int64), np.array([len(text)])
                    else:
                        firsts, ends = spans_of(len(text), values[places[k] : places[k + 1]], width)
                    removed.append(int((ends - firsts).sum()))
                    spans.append([{"start": a, "end": b} for a, b in zip(firsts.tolist(), ends.tolist(), strict=True)])
                    edges = [0, *np.stack([firsts, ends], 1).ravel().tolist(), len(text)] if len(firsts) else [0, len(text)]
                    kept.append(b"".join(text[a:b].tobytes() for a, b in zip(edges[::2], edges[1::2], strict=True)))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], names=names)

    return shipped(both.select("doc_id", "text", "copied", "starts")).mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, spans array<struct<start:bigint,end:bigint>>, kept binary")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[str | None], width: int) -> list[tuple[int, int, int, str]]:
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text, by a table of all strings; for tests."""
    all_bytes = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for data in all_bytes:
        for s in range(len(data) - width + 1):
            seen[data[s : s + width]] = seen.get(data[s : s + width], 0) + 1
    out = []
    for data in all_bytes:
        gone = np.zeros(len(data) + 1, bool)
        for s in range(len(data) - width + 1):
            if seen[data[s : s + width]] > 1:
                gone[s : s + width] = True
        kept = bytes(np.frombuffer(data, np.uint8)[~gone[:-1]]) if data else b""
        out.append((len(data), int(gone.sum()), int((gone[:-1] & ~np.r_[False, gone[:-2]]).sum()) if data else 0, hashlib.sha256(kept).hexdigest()))
    return out


QUERIES = {"op4_suffix_dedup": op4_suffix_dedup}
ORACLES: dict[str, str] = {}
