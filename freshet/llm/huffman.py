"""Token ids in files of canonical length-limited Huffman codes.

Ids of all documents are counted, code lengths of at most LIMIT bits follow by package-merge, and codes are canonical
(by length, then id). A folder holds three Parquet tables:

- `codebook`: id, length. Lengths alone fix the codes.
- `blocks`: shard, block, first (ids of the shard before the block), size (its ids), doc_ids, n_ids (ids of each document,
  with its end), payload and checkpoints. Shards are ranges of doc_id in ascending order (their bounds are sampled, and
  searched where codes are made, so no plan grows with them), and blocks follow one another in a shard. Each
  document starts at a byte; every CHECKPOINT ids a 16-bit number gives how many bits they take, so all stretches of a
  block are decoded side by side, each by looking LIMIT bits up in one table, and blocks don't depend on one another.
- `shards`: shard, start (ids of all shards before), n_ids.

Ids are encoded once and written before they are counted, so no text is encoded twice. A document's code is made before
documents are dealt to shards, so the shuffle moves compressed bits.

Defined cases: a null text counts as empty, so it has the end id alone; rows that share doc_id follow one another, in the
order of their checksums; a null doc_id comes first; an empty table gives empty files; other columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm.storage import shared_dir, shipped, written
from freshet.llm.textops import CHUNK_BYTES, chunks, text_bytes
from freshet.llm.tokens import default_path, encoder

END_ID = 2
LIMIT = 18
CHECKPOINT = 64
#: Ids of a block, at least one document; ids of a shard, about.
BLOCK_IDS, SHARD_IDS = 1 << 16, 4_000_000
#: Shards at most (beyond, they get larger; blocks don't), and sampled rows for each bound.
MOST_SHARDS, SAMPLES, SALTS = 16_384, 32, 1 << 30
ROWS_AT_ONCE = 256


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths (0 for a count of 0) of an optimal prefix code of at most `limit` bits, by package-merge."""
    order = np.argsort(counts, kind="stable")
    order = order[counts[order] > 0]
    n, lengths = len(order), np.zeros(len(counts), np.int64)
    if n <= 1:
        lengths[order] = 1
        return lengths
    if n > 1 << limit:
        raise ValueError(f"{n} ids don't fit codes of {limit} bits")
    leaves = counts[order].astype(np.float64)
    levels, items = [], leaves
    levels.append(np.ones(n, bool))
    for _ in range(limit - 1):
        packages = items[: len(items) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, packages])
        rank = np.argsort(both, kind="stable")
        items = both[rank]
        levels.append(rank < n)
    take, ranks = 2 * n - 2, np.zeros(n, np.int64)
    for is_leaf in reversed(levels):
        used = int(is_leaf[:take].sum())
        ranks[:used] += 1
        take = 2 * (take - used)
    lengths[order] = ranks
    return lengths


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes by id, and the ids with a code in canonical order."""
    ids = np.flatnonzero(lengths)
    ids = ids[np.lexsort((ids, lengths[ids]))]
    steps = np.left_shift(1, LIMIT - lengths[ids])
    starts = np.cumsum(steps) - steps
    codes = np.zeros(len(lengths), np.uint32)
    codes[ids] = starts >> (LIMIT - lengths[ids])
    return codes, ids


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every value of LIMIT bits: the id of the code that it starts with, and that code's length."""
    _, ids = canonical(lengths)
    fill = np.left_shift(1, LIMIT - lengths[ids])
    symbol, size = np.zeros(1 << LIMIT, np.uint32), np.ones(1 << LIMIT, np.uint8)
    symbol[: fill.sum()] = np.repeat(ids, fill)
    size[: fill.sum()] = np.repeat(lengths[ids], fill)
    return symbol, size


def pack_bits(ids: np.ndarray, offsets: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes of several documents: bytes, the n + 1 offsets of documents into them, bits of each stretch of CHECKPOINT
    ids (which doesn't cross documents), and the n + 1 offsets of documents into those."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    before = np.r_[0, ends]
    doc_bits = before[offsets[1:]] - before[offsets[:-1]]
    doc_bytes = np.r_[0, np.cumsum((doc_bits + 7) // 8)]
    at = ends - size + np.repeat(8 * doc_bytes[:-1] - before[offsets[:-1]], np.diff(offsets))
    word, room = at >> 5, 64 - (at & 31) - size
    value = codes[ids].astype(np.uint64) << room.astype(np.uint64)
    n_words = int(doc_bytes[-1] + 7) // 4 + 2
    words = np.bincount(word, (value >> np.uint64(32)).astype(np.float64), n_words)
    low = value & np.uint64(0xFFFFFFFF)
    spill = np.flatnonzero(low)
    words += np.bincount(word[spill] + 1, low[spill].astype(np.float64), n_words)
    packed = words.astype(np.uint64).astype(">u4").view(np.uint8)[: doc_bytes[-1]]
    stretches = (np.diff(offsets) + CHECKPOINT - 1) // CHECKPOINT
    stretch_offsets = np.r_[0, np.cumsum(stretches)]
    nth = np.arange(stretch_offsets[-1]) - np.repeat(stretch_offsets[:-1], stretches)
    starts = np.repeat(offsets[:-1], stretches) + nth * CHECKPOINT
    stops = np.minimum(starts + CHECKPOINT, np.repeat(offsets[1:], stretches))
    return packed, doc_bytes, (before[stops] - before[starts]).astype(np.uint16), stretch_offsets


def unpack_bits(payload: np.ndarray, n_ids: np.ndarray, checkpoints: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The ids of a block: all stretches advance together, one id a step."""
    symbol, size = table
    stretches = (n_ids + CHECKPOINT - 1) // CHECKPOINT
    firsts = np.r_[0, np.cumsum(stretches)]
    bits = np.r_[0, np.cumsum(checkpoints.astype(np.int64))]
    doc_bits = bits[firsts[1:]] - bits[firsts[:-1]]
    doc_bytes = np.cumsum((doc_bits + 7) // 8) - (doc_bits + 7) // 8
    position = bits[:-1] + np.repeat(8 * doc_bytes - bits[firsts[:-1]], stretches)
    nth = np.arange(firsts[-1]) - np.repeat(firsts[:-1], stretches)
    starts = np.repeat(np.cumsum(n_ids) - n_ids, stretches) + nth * CHECKPOINT
    left = np.minimum(np.repeat(n_ids, stretches) - nth * CHECKPOINT, CHECKPOINT)
    order = np.argsort(-left, kind="stable")
    position, starts = position[order], starts[order]
    active = np.searchsorted(-left[order], -np.arange(1, CHECKPOINT + 1), "right")
    padded = np.r_[payload, np.zeros(8, np.uint8)]
    windows = np.lib.stride_tricks.as_strided(padded.view(np.uint8), (len(payload) + 4, 4), (1, 1))
    words = np.ascontiguousarray(windows).view(">u4").ravel().astype(np.uint32)
    out = np.empty(int(n_ids.sum()), np.uint32)
    mask = np.uint32((1 << LIMIT) - 1)
    for k in range(CHECKPOINT):
        n = active[k]
        if not n:
            break
        p = position[:n]
        key = (words[p >> 3] >> (32 - LIMIT - (p & 7)).astype(np.uint32)) & mask
        out[starts[:n] + k] = symbol[key]
        p += size[key]
    return out


def binaries(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A column of binary values that are stretches of one buffer."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def encode_texts(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """A row per row of docs: doc_id, n_ids, ids (packed, with the end) and a tie-breaker, their checksum."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for rows, data, offsets in chunks(batch, most=2 * CHUNK_BYTES):
                ids, counts = own.encode(data, offsets)
                out = np.full(len(ids) + len(counts), end_id, own.dtype)
                out[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
                ends = np.r_[0, np.cumsum(counts + 1)] * out.itemsize
                data = memoryview(out.view(np.uint8))
                ties = [zlib.crc32(data[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array((counts + 1).astype(np.int32)), binaries(out.view(np.uint8), ends), pa.array(ties, pa.int64())], names=["doc_id", "n_ids", "ids", "tie"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return shipped(slim).mapInArrow(work, "doc_id long, n_ids int, ids binary, tie long")


def count_ids(encoded: DataFrame, dtype: str, size: int) -> np.ndarray:
    """How often each id occurs: one partial table a task, summed; at most `size` (the vocabulary's) rows reach the driver."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(text_bytes(batch.column(0))[0].view(dtype), minlength=size)
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], names=["id", "n"])

    got = shipped(encoded.select("ids")).mapInArrow(work, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(size, np.int64)
    counts[got["id"].to_numpy()] = got["n"].to_numpy()
    return counts


def shard_bounds(encoded: DataFrame) -> list[tuple[bool, int, int, int]]:
    """The least `shard_key` of each shard but the first, from a sample of about SAMPLES rows a shard; at most MOST_SHARDS."""
    rows, ids = encoded.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_ids"), F.lit(0))).first()
    n = min(MOST_SHARDS, -(-int(ids) // SHARD_IDS))
    if n < 2:
        return []
    salt = (F.rand(2) * SALTS).cast("long").alias("salt")
    picked = encoded.select("doc_id", "tie").sample(min(1.0, SAMPLES * n / rows), seed=1).select("doc_id", "tie", salt).toArrow()
    keys = sorted(shard_key(*row) for row in zip(*[picked[c].to_pylist() for c in ("doc_id", "tie", "salt")], strict=True))
    return sorted({keys[len(keys) * k // n] for k in range(1, n)}) if keys else []


def shard_key(doc_id: int | None, tie: int, salt: int) -> tuple[bool, int, int, int]:
    """What shards are cut by: doc_id (null first), the checksum of the ids, and for rows that share both a random number,
    as their order doesn't matter."""
    return doc_id is not None, doc_id or 0, tie, salt


def write_files(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID) -> str:
    """Writes the three tables for docs into the folder, which is returned."""
    path = path or default_path()
    own = encoder(path)
    dtype, size = own.dtype().dtype.str, max(own.tokenizer.get_vocab_size(), end_id + 1)
    encoded = written(encode_texts(docs, path, end_id), "ids")
    lengths = code_lengths(count_ids(encoded, dtype, size))
    codes, _ = canonical(lengths)
    small = lengths.astype(np.uint8)
    spark = docs.sparkSession
    used = np.flatnonzero(lengths)
    spark.createDataFrame(pa.table({"id": pa.array(used, pa.int64()), "length": pa.array(lengths[used], pa.int32())})).coalesce(1).write.parquet(f"{folder}/codebook")

    bounds = shard_bounds(encoded)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(TaskContext.get().partitionId())
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                rows = batch.slice(at, ROWS_AT_ONCE)
                ids = text_bytes(rows.column(3))[0].view(dtype)
                offsets = np.r_[0, np.cumsum(rows.column(2).to_numpy())]
                packed, ends, marks, mark_ends = pack_bits(ids, offsets, codes, small)
                keys = zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), rng.integers(0, SALTS, rows.num_rows).tolist(), strict=True)
                shards = pa.array([bisect_right(bounds, shard_key(*key)) for key in keys], pa.int32())
                yield pa.RecordBatch.from_arrays([shards, rows.column(0), rows.column(1), rows.column(2), binaries(packed, ends), binaries(marks.view(np.uint8), 2 * mark_ends)], names=["shard", "doc_id", "tie", "n_ids", "payload", "checkpoints"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, first, held, ids = None, 0, 0, [], 0

        def out() -> pa.RecordBatch:
            doc_ids = pa.array([[r[0] for r in held]], pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([first], pa.int64()), pa.array([ids], pa.int64()), doc_ids, pa.array([np.array([r[1] for r in held], np.uint32).tobytes()]), pa.array([b"".join(r[2] for r in held)]), pa.array([b"".join(r[3] for r in held)])],
                names=["shard", "block", "first", "size", "doc_ids", "n_ids", "payload", "checkpoints"],
            )

        for batch in batches:
            for at, doc_id, n, payload, checkpoints in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and (at != shard or ids + n > BLOCK_IDS):
                    yield out()
                    block, first, held, ids = block + 1, first + ids, [], 0
                if at != shard:
                    shard, block, first = at, 0, 0
                held.append((doc_id, n, payload, checkpoints))
                ids += n
        if held:
            yield out()

    dealt = shipped(encoded.select("doc_id", "tie", "n_ids", "ids")).mapInArrow(pack, "shard int, doc_id long, tie long, n_ids int, payload binary, checkpoints binary")
    ordered = dealt.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", "doc_id", "tie", "payload").drop("tie")
    blocks = ordered.mapInArrow(gather, "shard int, block int, first long, size long, doc_ids array<long>, n_ids binary, payload binary, checkpoints binary")
    blocks.write.option("compression", "none").parquet(f"{folder}/blocks")

    sums = {r["shard"]: r["n"] for r in spark.read.parquet(f"{folder}/blocks").groupBy("shard").agg(F.sum("size").alias("n")).collect()}  # MOST_SHARDS rows at most
    rows, start = [], 0
    for k in range(len(bounds) + 1):
        rows.append((k, start, sums.get(k, 0)))
        start += sums.get(k, 0)
    spark.createDataFrame(rows, "shard int, start long, n_ids long").coalesce(1).write.parquet(f"{folder}/shards")
    return folder


def read_files(spark: SparkSession, folder: str, keep_ids: bool = False) -> DataFrame:
    """A row per document of the folder: doc_id, start, n_tokens, ids_crc32, and with keep_ids the ids."""
    book = spark.read.parquet(f"{folder}/codebook").toArrow()
    lengths = np.zeros(int(max(book["id"].to_pylist(), default=0)) + 1, np.int64)
    lengths[book["id"].to_numpy()] = book["length"].to_numpy()
    tables: list[tuple[np.ndarray, np.ndarray]] = []

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not tables:
                tables.append(decode_table(lengths))
            for k in range(batch.num_rows):
                first, doc_ids, n_ids, payload, checkpoints = (batch.column(c)[k] for c in range(5))
                n_ids = np.frombuffer(n_ids.as_py(), np.uint32).astype(np.int64)
                ids = unpack_bits(np.frombuffer(payload.as_py(), np.uint8), n_ids, np.frombuffer(checkpoints.as_py(), np.uint16), tables[0])
                ends = np.r_[0, np.cumsum(n_ids)]
                data = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                columns = [doc_ids.values, pa.array(first.as_py() + ends[:-1]), pa.array(n_ids), pa.array(crc, pa.int64())]
                if keep_ids:
                    columns.append(pa.array([ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.list_(pa.uint32())).cast(pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    shards = spark.read.parquet(f"{folder}/shards").withColumnsRenamed({"start": "shard_start", "n_ids": "shard_ids"})
    blocks = spark.read.parquet(f"{folder}/blocks").join(shards, "shard")
    blocks = blocks.select((F.col("first") + F.col("shard_start")).alias("first"), "doc_ids", "n_ids", "payload", "checkpoints")
    return shipped(blocks).mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * keep_ids)


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """What reading gives back after writing docs to a new folder of the shared place."""
    spark = docs.sparkSession
    return read_files(spark, write_files(docs, f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}", **options))


def op5_huffman_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op5_huffman_token_files": op5_huffman_token_files}
ORACLES: dict[str, str] = {}
