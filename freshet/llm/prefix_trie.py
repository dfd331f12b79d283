"""The trie of all prefixes of conversations, by an external merge sort that knows common prefixes.

1. Each turn becomes 21 bytes: a 1, 16 bytes of SHA-256 of role and text, and the text's length. A conversation's key is its
   turns, then a 0 and its id, so keys in order of bytes list equal conversations side by side, by id, and a prefix before
   what continues it. Texts are read once and never shuffled.
2. Tasks sort their conversations in runs, front-code them (a prefix's length, then the rest) and cut them at splitters from a
   bounded sample, each shortened to the turn that sets it apart from the sample before. A hot conversation's copies are cut
   by their ids, so they spread over ranges like any other keys.
3. Each range merges its runs by a loser tree that never compares known prefixes again. The merged stream, with the prefix
   shared with the key before, drives a stack of open nodes: nodes deeper than that prefix are finished, and add what they
   counted to the node above.
4. A node can reach beyond its range only if it is a prefix of a splitter. What ranges count of such nodes is added up by
   (first splitter with that prefix, depth), an order in which a last stack passes subtrees on; it sees at most a row for each
   turn of each splitter. Ids of conversations that end at such a node are hashed as a stream of the ranges' lists.

A range holds about RANGE_ENTRIES turns, up to MOST_RANGES ranges; beyond, ranges get larger. A conversation's turns (21 bytes
each) must fit one row, and its depth the stack.

Defined cases: turns are in order of `turn`, null first, then by digest; repeated rows are turns of their own; null roles and
texts are empty; rows without conv_id belong to no conversation and are not read; a conversation that is rebuilt without turns
ends at the root; remainders of negative ids are SQL's (towards zero); an empty table has no members, so no node; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from freshet.llm.storage import shipped, written
from freshet.llm.suffix_dedup import LoserTree, front_code, shared_prefix

#: Bytes of a turn in a key.
TURN = 21
#: Turns of a range, about; ranges at most; sampled conversations for each.
RANGE_ENTRIES, MOST_RANGES, SAMPLES = 25_000, 65_536, 4
#: Turns that a task sorts into one run; partitions of the merge at most.
RUN_ENTRIES, MOST_TASKS = 200_000, 8192
#: Rows of shared nodes that are broadcast to those below them; beyond, they are joined by shuffle.
MAX_BROADCAST = 200_000
ROWS_AT_ONCE = 20_000
#: Rebuilding: groups of so many ids share the first one's opening, of fewer turns than HEADS.
FAMILY, HEADS = 5, 9


def turn_key(role: Column, text: Column) -> Column:
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    return F.unhex(F.concat(F.lit("01"), F.substring(digest, 1, 32), F.lpad(F.hex(F.octet_length(text).cast("long")), 8, "0")))


def turn_lists(conversations: DataFrame) -> DataFrame:
    """conv_id and turns, an array of their keys in order; rows of one family of ids are in one partition."""
    conv_id, entry = F.col("conv_id").cast("long"), F.struct("turn", turn_key(F.col("role"), F.col("text")).alias("key"))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select((conv_id - conv_id % FAMILY).alias("family"), conv_id.alias("conv_id"), entry.alias("entry"))
    return rows.repartition("family").groupBy("family", "conv_id").agg(F.sort_array(F.collect_list("entry")).getField("key").alias("turns"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id and turns: the first h turns of the family's first conversation, then the own turns after the first h, with h
    the CRC-32 of the id's digits modulo HEADS."""
    own = turn_lists(conversations)
    h = (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int")
    none = F.array().cast("array<binary>")
    head = F.max(F.when(F.col("conv_id") == F.col("family"), F.slice("turns", 1, HEADS - 1))).over(Window.partitionBy("family"))
    return (
        own.withColumns({"head": F.coalesce(head, none), "h": h})
        .select("conv_id", F.concat(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))).alias("turns"))
    )


def key_of(conv_id: int, turns: list[bytes]) -> bytes:
    return b"".join(turns) + b"\0" + struct.pack(">Q", conv_id + (1 << 63))


def splitters(lists: DataFrame) -> list[bytes]:
    """Ascending keys that cut the conversations into ranges of about RANGE_ENTRIES turns."""
    rows, entries = lists.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("turns") + 1), F.lit(0))).first()
    n = min(MOST_RANGES, -(-int(entries) // RANGE_ENTRIES))
    if n < 2:
        return []
    share = min(1.0, SAMPLES * n * max(1.0, rows * 20 / entries) / rows)
    picked = lists.filter(F.pmod(F.xxhash64("conv_id"), F.lit(1 << 40)) < int(share * (1 << 40)) + 1).toArrow()
    keys = sorted(map(key_of, picked["conv_id"].to_pylist(), picked["turns"].to_pylist()))
    sizes = np.cumsum([len(k) for k in keys])
    found = []
    for k in np.unique(np.searchsorted(sizes, sizes[-1] * np.arange(1, n) / n)) if keys else []:
        if k:
            found.append(keys[k][: (shared_prefix(keys[k - 1], keys[k]) // TURN + 1) * TURN])
    return found


def cut_runs(lists: DataFrame, cuts: list[bytes]) -> DataFrame:
    """range, task, and a run's part in that range: lengths of shared prefixes, lengths of rests, and rests."""
    tasks = min(MOST_TASKS, len(cuts) + 1)

    def run(keys: list[bytes]) -> pa.RecordBatch:
        keys.sort()
        rows, at = [], 0
        while at < len(keys):
            r = bisect_right(cuts, keys[at])
            to = bisect_left(keys, cuts[r], at) if r < len(cuts) else len(keys)
            shared, rests = front_code(keys[at:to])
            rows.append((r, r * tasks // (len(cuts) + 1), np.array(shared, np.int32).tobytes(), np.array([len(x) for x in rests], np.int32).tobytes(), b"".join(rests)))
            at = to
        types = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["range", "task", "shared", "sizes", "rests"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, entries = [], 0
        for batch in batches:
            for conv_id, turns in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys.append(key_of(conv_id, turns))
                entries += len(turns) + 1
                if entries >= RUN_ENTRIES:
                    yield run(keys)
                    keys, entries = [], 0
        if keys:
            yield run(keys)

    return shipped(lists).mapInArrow(work, "range int, task int, shared binary, sizes binary, rests binary").repartitionById(tasks, F.col("task"))


def run_keys(row: dict) -> tuple[list[int], list[bytes]]:
    ends = np.cumsum(np.frombuffer(row["sizes"], np.int32)).tolist()
    return np.frombuffer(row["shared"], np.int32).tolist(), [row["rests"][a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def first_cuts(cuts: list[bytes]) -> list[list[int]]:
    """For splitter j (from 1) and each depth of its turns: the first splitter with the same turns so far; the root is (0, 0)."""
    found = [[0]]
    for j, cut in enumerate(cuts, 1):
        same = shared_prefix(cuts[j - 2], cut) // TURN if j > 1 else 0
        found.append([*found[j - 1][: same + 1], *[j] * (len(cut) // TURN - same)])
    return found


class Node:
    __slots__ = ("bytes", "children", "ends", "leaves", "least", "n", "rows", "saved")

    def __init__(self, size: int):
        self.bytes, self.n, self.least = size, 0, None
        self.children = self.leaves = self.saved = 0
        self.ends, self.rows = [], []  # ids that end here; finished children, which wait for this node's least id


NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
#: A finished node has `cut` where its parent is shared, and `bytes` is null; a shared one has bytes, and the ids that end there.
FOUND = NODE + ", cut int, range int, bytes long, ids string"
TYPES = [pa.int64()] * 7 + [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.string()]


def ends_text(ids: list[int]) -> str:
    return ",".join(map(str, ids))


def range_nodes(runs: list[tuple[list[int], list[bytes]]], r: int, cuts: list[bytes], firsts: list[list[int]]) -> Iterator[tuple]:
    """Rows of FOUND of one range."""
    low, high = cuts[r - 1] if r else b"", cuts[r] if r < len(cuts) else b""
    stack, done = [Node(0)], []
    at_low = at_high = 0  # turns of the open path that are the splitters' too

    def close() -> None:
        depth, node = len(stack) - 1, stack.pop()
        if depth > max(at_low, at_high):
            node.saved += (node.n - 1) * node.bytes
            node.leaves = node.leaves if node.children else 1
            for row in node.rows:
                done.append((*row[:2], node.least, *row[3:]))
            node.rows = []
            above = stack[-1]
            above.children, above.leaves, above.saved = above.children + 1, above.leaves + node.leaves, above.saved + node.saved
            above.rows.append((node.least, depth, None, node.n, node.children, node.leaves, node.saved, hashlib.sha256(ends_text(node.ends).encode()).hexdigest(), None, None, None, None))
        else:
            cut = firsts[r][depth] if depth <= at_low else firsts[r + 1][depth]
            done.extend((*row[:8], cut, None, None, None) for row in node.rows)
            done.append((node.least, depth, None, node.n, node.children, node.leaves, node.saved, None, cut, r, node.bytes, ends_text(node.ends)))
        if stack:
            stack[-1].n += node.n
            stack[-1].least = node.least if stack[-1].least is None else min(stack[-1].least, node.least)

    for key, _, _, shared in LoserTree(runs):
        same, depth = shared // TURN, (len(key) - 9) // TURN
        while len(stack) - 1 > same:
            close()
        at_low = at_low if same > at_low else shared_prefix(key, low, same * TURN) // TURN
        at_high = at_high if same > at_high else shared_prefix(key, high, same * TURN) // TURN
        for k in range(len(stack) - 1, depth):
            stack.append(Node(int.from_bytes(key[k * TURN + 17 : (k + 1) * TURN], "big")))
        node, conv_id = stack[-1], struct.unpack(">Q", key[-8:])[0] - (1 << 63)
        node.ends.append(conv_id)
        node.n += 1
        node.least = conv_id if node.least is None else min(node.least, conv_id)
        if len(done) >= ROWS_AT_ONCE:
            yield from done
            done.clear()
    while stack:
        close()
    yield from done


def to_batches(rows: Iterator[tuple], types: list[pa.DataType], names: list[str]) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= ROWS_AT_ONCE:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)


def names_of(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def merged(runs: DataFrame, cuts: list[bytes]) -> DataFrame:
    """Rows of FOUND; a task merges one of its ranges after the other."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = first_cuts(cuts)
        rows = (row for batch in batches for row in batch.to_pylist())
        for r, parts in groupby(rows, itemgetter("range")):
            yield from to_batches(range_nodes([run_keys(p) for p in parts], r, cuts, firsts), TYPES, names_of(FOUND))

    return shipped(runs.sortWithinPartitions("range")).mapInArrow(work, FOUND)


def shared_nodes(found: DataFrame) -> DataFrame:
    """NODE and cut of the nodes that reach beyond a range."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            parts = (row for batch in batches for row in batch.to_pylist())
            for (cut, depth), group in groupby(parts, itemgetter("cut", "depth")):
                least, sums, hashed, some, size = None, [0] * 4, hashlib.sha256(), False, 0
                for row in group:
                    least = row["conv_id"] if least is None else min(least, row["conv_id"])
                    size = row["bytes"]
                    for k, name in enumerate(("n_convs", "n_children", "n_leaves", "saved_tokens")):
                        sums[k] += row[name]
                    if row["ids"]:
                        hashed.update(("," * some + row["ids"]).encode())
                        some = True
                yield (least, depth, None, *sums, hashed.hexdigest(), cut, None, size, None)

        yield from to_batches(rows(), TYPES, names_of(FOUND))

    def nest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            stack: list[dict] = []

            def close() -> tuple:
                row = stack.pop()
                if not row["n_children"]:
                    row["n_leaves"] = 1
                row["saved_tokens"] += (row["n_convs"] - 1) * row["bytes"]
                if stack:
                    for name in ("n_leaves", "saved_tokens"):
                        stack[-1][name] += row[name]
                return tuple(row[name] for name in names_of(NODE)) + (row["cut"],)

            for batch in batches:
                for row in batch.to_pylist():
                    while stack and stack[-1]["depth"] >= row["depth"]:
                        yield close()
                    if stack:
                        row["parent_conv_id"] = stack[-1]["conv_id"]
                        stack[-1]["n_children"] += 1
                    stack.append(row)
            while stack:
                yield close()

        yield from to_batches(rows(), TYPES[:9], [*names_of(NODE), "cut"])

    parts = found.filter(F.col("bytes").isNotNull()).repartition("cut", "depth").sortWithinPartitions("cut", "depth", "range")
    whole = parts.mapInArrow(add, FOUND)
    return whole.repartition(1).sortWithinPartitions("cut", "depth").mapInArrow(nest, NODE + ", cut int")


def trie(lists: DataFrame) -> DataFrame:
    """The nodes (see NODE) of conversations given as conv_id and turns, an array of keys of `turn_key`; ids are distinct."""
    lists = written(lists, "conversations")
    cuts = splitters(lists)
    found = written(merged(cut_runs(lists, cuts), cuts), "trie")
    shared = written(shared_nodes(shipped(found)), "trie-shared")
    above = shared.select(F.col("cut"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("above"))
    below = found.filter(F.col("bytes").isNull() & F.col("cut").isNotNull())
    if shared.count() <= MAX_BROADCAST:
        above = F.broadcast(above)
    names = names_of(NODE)
    joined = below.join(above, ["cut", "depth"]).withColumn("parent_conv_id", F.col("above"))
    return found.filter(F.col("cut").isNull()).select(*names).unionAll(joined.select(*names)).unionAll(shared.select(*names))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


QUERIES = {"op12_conversation_trie": op12_conversation_trie}
ORACLES = {
    "op12_conversation_trie": r"""
WITH own AS (
  SELECT conv_id, conv_id - conv_id % 5 AS family, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), heads AS (
  SELECT *, CAST(xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS UBIGINT))),
    lambda acc, b: list_reduce(list_prepend(xor(acc, b), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, i: xor(x // 2, (x % 2) * 3988292384::UBIGINT))), 4294967295::UBIGINT) % 9 AS BIGINT) AS h
  FROM own
), rebuilt AS (
  SELECT a.conv_id, list_concat(coalesce(b.turns, [])[1:a.h], a.turns[a.h + 1:]) AS turns
  FROM heads a LEFT JOIN own b ON b.conv_id = a.family
), steps AS (
  SELECT conv_id, turns, d AS depth, CASE WHEN d = 0 THEN '' ELSE sha256(CAST(turns[1:d] AS VARCHAR)) END AS k, CASE WHEN d = 0 THEN 0 ELSE strlen(turns[d].text) END AS bytes
  FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT depth, k, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
    sha256(coalesce(string_agg(CASE WHEN len(turns) = depth THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM steps GROUP BY depth, k
), links AS (
  SELECT n.*, p.conv_id AS parent_conv_id, p.k AS parent_k
  FROM nodes n LEFT JOIN steps s ON s.conv_id = n.conv_id AND s.depth = n.depth - 1 LEFT JOIN nodes p ON p.depth = s.depth AND p.k = s.k
), kids AS (
  SELECT depth - 1 AS depth, parent_k AS k, count(*) AS n_children FROM links WHERE depth > 0 GROUP BY 1, 2
), full_nodes AS (
  SELECT l.*, coalesce(c.n_children, 0) AS n_children FROM links l LEFT JOIN kids c ON c.depth = l.depth AND c.k = l.k
), sums AS (
  SELECT s.depth, s.k, CAST(count(*) FILTER (WHERE f.n_children = 0) AS BIGINT) AS n_leaves, CAST(sum((f.n_convs - 1) * f.bytes) AS BIGINT) AS saved_tokens
  FROM full_nodes f JOIN steps s ON s.conv_id = f.conv_id AND s.depth <= f.depth GROUP BY s.depth, s.k
)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, f.parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, f.ends_sha256
FROM full_nodes f JOIN sums s ON s.depth = f.depth AND s.k = f.k
""",
}
