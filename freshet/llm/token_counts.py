"""Exact token counts at every prefix of a text, by dynamic programming.

Within a piece of a byte-level pre-tokenizer, let last[i] be the last token of the encoding of the first i bytes. It is
the one token t that ends at i and goes with last[i - len(t)], two tokens going together if encoding their joined
strings gives those two; then count[i] = count[i - len(t)] + 1. Pieces and units (see `tokens`) add up, with two repairs
where a cut changes the pieces: white space before a cut is one piece, and a cut contraction is a mark and a letter.

A text's counts are kept as one signed byte per character, the change from one prefix to the next, deflated. Any question
about a truncation or a budget is then answered from that column without encoding again: `count_at`, `chars_within`.

Defined cases: a null text counts as empty, with no tokens and no prefixes; special strings inside a text count as one
token once complete, as the library has it; rows that repeat are counted one by one; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm.storage import shipped
from freshet.llm.tokens import SPACE_RUN, UNIT, Kept, default_path, load, specials

CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
KEPT_PAIRS = 500_000
LIMIT = 1024


def byte_letters() -> dict[int, str]:
    """The letters that byte-level pre-tokenizers write for bytes: printable ones for themselves, others from U+0100 on."""
    own = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in own else chr(next(rest)) for b in range(256)}


LETTERS = byte_letters()
CONTINUES = {LETTERS[b] for b in range(0x80, 0xC0)}
#: Units whose pieces are plain to see: a space or line feed, letters of Latin-1, marks.
SIMPLE = re.compile(r"([ \n]?)([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]*)([.,;:!?|#$%&*()\-]*)")


class PrefixCounter:
    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.model = self.tokenizer.model
        self.specials = specials(self.tokenizer)
        self.split = re.compile("|".join(map(re.escape, self.specials))) if self.specials else None
        self.vocabulary = set(self.tokenizer.get_vocab(with_added_tokens=False))
        self.longest = max(map(len, self.vocabulary))
        self.pairs: dict[tuple[str, str], bool] = {}
        self.kept = Kept()

    def goes(self, left: str, token: str) -> bool:
        """Do the two tokens (the first may be empty) stand side by side in the encoding of their joined strings?"""
        if len(self.pairs) > KEPT_PAIRS:
            self.pairs.clear()
        found = [t.value for t in self.model.tokenize(left + token)] == ([left, token] if left else [token])
        self.pairs[left, token] = found
        return found

    def pieces(self, texts: list[str]) -> dict[str, bytes]:
        """For pieces in letters for bytes: the changes of the count along their characters, one signed byte each. Pieces
        are taken in sorted order, so the table of a common prefix is filled in once."""
        vocabulary, longest, known = self.vocabulary, self.longest, self.pairs.get
        last, count, before, out = [""], [0], "", {}
        for text in sorted(texts):
            n, same = len(text), 0
            for x, y in zip(before, text, strict=False):
                if x != y:
                    break
                same += 1
            del last[same + 1 :], count[same + 1 :]
            for i in range(same + 1, n + 1):
                for start in range(max(0, i - longest), i):
                    token = text[start:i]
                    if token in vocabulary:
                        goes = known((last[start], token))
                        if goes or goes is None and self.goes(last[start], token):
                            last.append(token)
                            count.append(count[start] + 1)
                            break
                else:
                    raise ValueError(f"no token ends at byte {i} of {text!r}")
            before = text
            steps = [count[i + 1] - count[i] for i in range(n)]
            if not text.isascii():
                steps = self.by_character(text, steps)
            out[text] = bytes([s & 255 for s in steps])
        return out

    @staticmethod
    def by_character(letters: str, steps: list[int]) -> list[int]:
        out: list[int] = []
        for letter, step in zip(letters, steps, strict=True):
            if letter in CONTINUES and out:
                out[-1] += step
            else:
                out.append(step)
        return out

    def parts(self, unit: str) -> list[tuple[str, str]]:
        """(text, letters) of the pieces of a unit."""
        m = SIMPLE.fullmatch(unit)
        if m:
            space, word, marks = m.groups()
            found = [space + word, marks] if space == " " and word else [word, space + marks] if space == " " else [space, word, marks]
            return [(x, "".join([LETTERS[b] for b in x.encode()])) for x in found if x]
        return [(unit[a:b], letters) for letters, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(unit)]

    def learn(self, units: list[str]) -> None:
        """Finds the changes of units that aren't kept yet."""
        split = {u: self.parts(u) for u in units}
        wanted = {letters for parts in split.values() for _, letters in parts}
        cuts: dict[str, str] = {}
        for u, parts in split.items():
            space = SPACE_RUN.match(u).end()
            if space > 1:
                cuts[u] = "".join([LETTERS[b] for b in u[:space].encode()])
            if any(x in CONTRACTIONS for x, _ in parts):
                wanted.update(letters for x, _ in parts if x in CONTRACTIONS for letters in (x[0], x[1]))
        tables = self.pieces(list(wanted | set(cuts.values())))
        for u, parts in split.items():
            steps = []
            for text, letters in parts:
                table = tables[letters]
                if text in CONTRACTIONS and len(text) > 2:
                    own = np.cumsum(np.frombuffer(table, np.int8), dtype=np.int64)
                    own[1] = np.frombuffer(tables[text[0]] + tables[text[1]], np.int8).sum()
                    table = np.diff(own, prepend=0).astype(np.int8).tobytes()
                steps.append(table)
            found = b"".join(steps)
            if u in cuts:  # white space before a cut is one piece
                counts = np.cumsum(np.frombuffer(found, np.int8), dtype=np.int64)
                space = SPACE_RUN.match(u).end()
                counts[:space] = np.cumsum(np.frombuffer(tables[cuts[u]], np.int8), dtype=np.int64)
                found = np.diff(counts, prepend=0).astype(np.int8).tobytes()
            self.kept.new[u] = found

    def plain(self, texts: list[str]) -> list[bytes]:
        """The changes of texts whose special strings, if any, are taken as ordinary characters."""
        return [b"".join(found) for found in self.kept.look_up([UNIT.findall(t) for t in texts], self.learn)]

    def special(self, text: str) -> bytes:
        """The changes of a text with special strings: each is ordinary until its last character makes it one token."""
        out, at = [], 0
        for m in self.split.finditer(text):
            ordinary, before = self.plain([text[at : m.end() - 1], text[at : m.start()]])
            change = sum(memoryview(before).cast("b")) + 1 - sum(memoryview(ordinary).cast("b"))
            out += [ordinary, np.int8(change).tobytes()]
            at = m.end()
        return b"".join([*out, *self.plain([text[at:]])])

    def texts(self, texts: list[str]) -> list[bytes]:
        """The changes of the count along the characters of each text."""
        odd = {i for i, t in enumerate(texts) if self.split is not None and self.split.search(t)}
        plain = iter(self.plain([t for i, t in enumerate(texts) if i not in odd]))
        return [self.special(t) if i in odd else next(plain) for i, t in enumerate(texts)]


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """One for each path and worker."""
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def changes(stored: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(stored), np.int8)


def count_at(stored: bytes, chars: int) -> int:
    """Tokens of the text's first `chars` characters."""
    return int(changes(stored)[:chars].sum(dtype=np.int64))


def chars_within(stored: bytes, budget: int) -> int:
    """The most characters from the start that take at most `budget` tokens."""
    fits = np.flatnonzero(np.cumsum(changes(stored), dtype=np.int64) <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def prefix_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """A row per row of docs: doc_id, n_bytes, n_tokens and prefix_changes."""
    path = path or default_path()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                found = count.texts(rows.column(2).to_pylist())
                totals = [int(np.frombuffer(x, np.int8).sum(dtype=np.int64)) for x in found]
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(totals, pa.int64()), pa.array([zlib.compress(x, 1) for x in found], pa.binary())], names=["doc_id", "n_bytes", "n_tokens", "prefix_changes"])

    text = F.coalesce("text", F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return shipped(slim).mapInArrow(work, "doc_id long, n_bytes long, n_tokens long, prefix_changes binary")


def answered(counted: DataFrame, at: Sequence[int] = (), within: Sequence[int] = ()) -> DataFrame:
    """The rows of `prefix_counts` with, for each number, tokens_at_<characters> (tokens of the text cut there) and
    chars_within_<tokens> (the most characters whose tokens fit). No text is encoded, or read, again."""
    names = [f"tokens_at_{n}" for n in at] + [f"chars_within_{n}" for n in within]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list[int]] = [[] for _ in names]
            for stored in batch.column("prefix_changes").to_pylist():
                upto = np.cumsum(changes(stored), dtype=np.int64)
                for k, n in enumerate(at):
                    columns[k].append(int(upto[min(n, len(upto)) - 1]) if n and len(upto) else 0)
                for k, n in enumerate(within, len(at)):
                    fits = np.flatnonzero(upto <= n)
                    columns[k].append(int(fits[-1]) + 1 if len(fits) else 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, pa.int64()) for c in columns]], names=[*batch.schema.names, *names])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in counted.schema.fields] + [f"{n} long" for n in names])
    return shipped(counted).mapInArrow(work, schema)


def op2_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = prefix_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))


QUERIES = {"op2_prefix_token_counts": op2_prefix_token_counts}
ORACLES: dict[str, str] = {}
