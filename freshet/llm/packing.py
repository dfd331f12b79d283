"""Packing of examples into training sequences under three limits at once: tokens, segments and loss-bearing tokens.

An example is the ids of its prompt, which bear no loss, then those of its text and the end id, which do. Each task deals
its rows, as they come, into groups of bounded size and packs a group by the dot-product heuristic: of all examples that
still fit an open sequence in every dimension, it takes the one whose demand vector (each dimension as a part of its limit)
has the largest dot product with the room that is left. Where nothing fits any more, an example is cut so that the sequence
is filled exactly; what is cut off goes back to the group. A sequence that can't be filled (no examples left, or no segments
or loss-bearing tokens left) is cut back to a power of two, as sequences need no padding there. So there is no padding at
all, whatever the examples are, and a group leaves at most one short sequence for each power of two below the limit.

No row is shuffled: a hot source, copies and equal ids make no difference, and a task holds one group at a time. Sequence
ids are partition * 2^32 + number, so they repeat for the same files and session settings.

Defined cases: null prompts and texts are empty, and an example without both is its end id alone; an example longer than a
sequence is cut into full ones first; repeated rows and rows that share doc_id are packed each for themselves; doc_id may be
null; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm.storage import shipped
from freshet.llm.textops import CHUNK_BYTES, chunks, text_bytes
from freshet.llm.tokens import LEARN_BYTES, UnitEncoder

END_ID = 2
VOCABULARY = "word_bpe_49k.json"
#: Separates units that are encoded in one call: a special token, which texts encoded by units never hold.
SEPARATOR = "<|endoftext|>"
#: Examples and ids of a group, about: what a task holds and chooses from.
GROUP_ITEMS, GROUP_IDS = 2048, 4_000_000
#: A cut that fills a sequence makes no piece shorter than this if another choice is left.
LEAST_PIECE = 32


class Limits(NamedTuple):
    tokens: int = 4096
    segments: int = 256
    loss: int = 4096


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


class WordEncoder(UnitEncoder):
    """For tokenizers that drop white space and mark the ends of words: units are told apart by a special token."""

    def __init__(self, path: str):
        super().__init__(path)
        self.mark = self.tokenizer.token_to_id(SEPARATOR)

    def learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        places, counts = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        raw, stops = data.tobytes(), np.cumsum(ends - starts)
        edges = np.r_[0, np.searchsorted(stops, np.arange(LEARN_BYTES, stops[-1], LEARN_BYTES)), len(starts)]
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if a == b:
                continue
            text = SEPARATOR.join(raw[s:e].decode() for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True))
            ids = self.whole(text)
            marks = np.r_[np.flatnonzero(ids == self.mark), len(ids)]
            begins = np.r_[0, marks[:-1] + 1]
            places[a:b], counts[a:b] = self.keep(ids) + begins, marks - begins
        return places, counts


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


class Group:
    """Examples still to be packed: tokens and loss-bearing tokens (the last ones) of what is left of each."""

    def __init__(self, tokens: np.ndarray, loss: np.ndarray, limits: Limits):
        if min(limits) < 1:
            raise ValueError(f"limits must be positive: {limits}")
        self.limits = limits
        self.tokens, self.loss = tokens.astype(np.int64), loss.astype(np.int64)
        self.starts = np.zeros(len(tokens), np.int64)  # ids of the example that are packed already
        self.open = self.tokens > 0
        self.pieces: list[tuple[int, int, int, int, int, int]] = []  # example, start, length, loss, sequence, offset
        self.sequences = 0

    def first_loss(self, i: int, length: int) -> int:
        """Loss-bearing tokens among the first `length` that are left of example i."""
        return max(0, length - int(self.tokens[i] - self.loss[i]))

    def close(self, placed: list[tuple[int, int, int, int]]) -> None:
        offset = 0
        for i, start, length, loss in placed:
            self.pieces.append((i, start, length, loss, self.sequences, offset))
            offset += length
        self.sequences += 1

    def take(self, i: int, length: int) -> tuple[int, int, int, int]:
        piece = (i, int(self.starts[i]), length, self.first_loss(i, length))
        self.starts[i] += length
        self.tokens[i] -= length
        self.loss[i] -= piece[3]
        self.open[i] = self.tokens[i] > 0
        return piece

    def give_back(self, piece: tuple[int, int, int, int], keep: int = 0) -> tuple[int, int, int, int]:
        """Undoes the end of the latest piece of its example, but for its first `keep` tokens."""
        i, start, length, loss = piece
        kept = max(0, keep - (length - loss))
        self.starts[i] -= length - keep
        self.tokens[i] += length - keep
        self.loss[i] += loss - kept
        self.open[i] = self.tokens[i] > 0
        return i, start, keep, kept

    def cut_long(self) -> None:
        """Sequences that one long example fills by itself."""
        for i in np.flatnonzero(self.tokens >= self.limits.tokens):
            while self.tokens[i] >= self.limits.tokens and self.first_loss(i, self.limits.tokens) <= self.limits.loss:
                self.close([self.take(int(i), self.limits.tokens)])

    def fill(self) -> None:
        """One sequence."""
        most = self.limits
        room, placed = [most.tokens, most.segments, most.loss], []

        def put(i: int, length: int) -> None:
            piece = self.take(i, length)
            placed.append(piece)
            for k, used in enumerate((length, 1, piece[3])):
                room[k] -= used

        while room[0] and room[1]:
            fits = np.flatnonzero(self.open & (self.tokens <= room[0]) & (self.loss <= room[2]))
            if not len(fits):
                break
            # the segment's part is the same for all
            score = self.tokens[fits] * (room[0] / most.tokens**2) + self.loss[fits] * (room[2] / most.loss**2)
            i = int(fits[np.argmax(score)])
            put(i, int(self.tokens[i]))
        if placed and 0 < room[0] < LEAST_PIECE:
            last = placed[-1]
            if (self.open & (self.tokens >= room[0] + last[2] + LEAST_PIECE)).any():
                placed.pop()
                self.give_back(last)
                for k, used in enumerate((last[2], 1, last[3])):
                    room[k] += used
        while room[0] and room[1]:
            free = self.open.copy()
            free[[p[0] for p in placed]] = False
            left = np.flatnonzero(free)
            if not len(left):
                break
            lengths = np.minimum(np.minimum(self.tokens[left], room[0]), self.tokens[left] - self.loss[left] + room[2])
            best = int(np.lexsort((-left, self.tokens[left], lengths))[-1])
            if lengths[best] < 1:
                break
            put(int(left[best]), int(lengths[best]))
        total = most.tokens - room[0]
        if room[0]:
            over = total - (1 << (total.bit_length() - 1))
            while over:
                last = placed.pop()
                back = min(over, last[2])
                shorter = self.give_back(last, last[2] - back)
                if shorter[2]:
                    placed.append(shorter)
                over -= back
        self.close(placed)

    def pack(self) -> list[tuple[int, int, int, int, int, int]]:
        self.cut_long()
        while self.open.any():
            self.fill()
        return self.pieces


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


def pack_examples(examples: DataFrame, prompt: str | Column | None = None, text: str | Column = "text", path: str | None = None, end_id: int = END_ID, limits: Limits = Limits(), keep_ids: bool = False) -> DataFrame:
    """A row per piece of an example (doc_id): its start in the example's ids, length, checksum of its ids, the example's
    number of ids, its place (sequence_id, offset) and its loss-bearing ids; with keep_ids the ids themselves."""
    path = path or default_path()
    names = [f.split()[0] for f in SCHEMA.split(", ")] + ["ids"] * keep_ids

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, base, held, n_ids = encoder(path), TaskContext.get().partitionId() << 32, [], 0

        def out() -> pa.RecordBatch:
            nonlocal base
            group = Group(np.array([len(ids) for _, ids, _ in held]), np.array([len(ids) - p for _, ids, p in held]), limits)
            rows = []
            for i, start, length, loss, sequence, offset in group.pack():
                doc_id, ids, _ = held[i]
                part = ids[start : start + length].astype("<u4")
                rows.append((doc_id, start, length, zlib.crc32(part.tobytes()), len(ids), base + sequence, offset, loss, part.astype(np.int64)))
            base += group.sequences
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns[:8]] + [pa.array(columns[8], pa.list_(pa.int64()))] * keep_ids, names=names)

        for batch in batches:
            for rows, data, offsets in chunks(batch, most=2 * CHUNK_BYTES):
                ids, counts = own.encode(data, offsets)
                front, before = own.encode(*text_bytes(rows.column("prompt")))
                at, ahead = np.r_[0, np.cumsum(counts)], np.r_[0, np.cumsum(before)]
                for k, doc_id in enumerate(rows.column("doc_id").to_pylist()):
                    whole = np.concatenate([front[ahead[k] : ahead[k + 1]], ids[at[k] : at[k + 1]], np.array([end_id], own.dtype)])
                    held.append((doc_id, whole, int(before[k])))
                    n_ids += len(whole)
                    if len(held) >= GROUP_ITEMS or n_ids >= GROUP_IDS:
                        yield out()
                        held, n_ids = [], 0
        if held:
            yield out()

    front = F.lit(None).cast("string") if prompt is None else F.col(prompt) if isinstance(prompt, str) else prompt
    slim = examples.select(F.col("doc_id").cast("long").alias("doc_id"), front.alias("prompt"), F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).alias("text"))
    return shipped(slim).mapInArrow(work, SCHEMA + ", ids array<long>" * keep_ids)


def op13_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_examples(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op13_vector_packing": op13_vector_packing}
ORACLES: dict[str, str] = {}
