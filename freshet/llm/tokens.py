"""Tokenizers of the `tokenizers` library, applied to units of text whose encodings can be put together.

A unit is a run of white space and the run of other characters behind it. Byte-level pre-tokenizers never let a piece
run from a character that isn't white space into one that is, nor look back, so the encoding of a text is that of its
units one after another; encodings of units are kept by each Python worker. White space is that of Unicode's White_Space
property, as the library has it. `UnitEncoder` takes ASCII white space only, and encodes texts whole that have other white
space or a special token's string.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable

import numpy as np
import pandas as pd

from freshet.llm.textops import BYTE_VALUE, BYTES, SPACE

SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
UNIT = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")
SPACE_RUN = re.compile(f"[{SPACES}]*")
#: Units that a worker keeps, and the longest that it keeps.
KEPT_UNITS, KEPT_LENGTH = 600_000, 64
#: Ids in a worker's pool beyond which it starts anew.
KEPT_IDS = 4_000_000
#: Bytes of new units in one call of the library, about: its own tables of a text are large.
LEARN_BYTES = 1 << 15
#: White space beyond ASCII, in UTF-8.
ODD_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
DEFAULT = "byte_bpe_50k.json"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT)


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def specials(tokenizer) -> list[str]:
    """Strings that the library takes as single tokens inside texts."""
    return sorted((t.content for t in tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)


class Kept:
    """A dict of bounded size in two generations: what was used lately survives, the rest is dropped at once."""

    def __init__(self, most: int = KEPT_UNITS):
        self.most, self.new, self.old = most, {}, {}

    def look_up(self, lists: list[list[str]], learn: Callable[[list[str]], None]) -> list[list[bytes]]:
        """The entry of every key; `learn` gets the keys without one, once each, and puts their entries into `new`."""
        if len(self.new) > self.most:
            self.new, self.old = {}, self.new
        new, old = self.new, self.old
        found = [list(map(new.get, keys)) for keys in lists]
        holes, todo = [], {}
        for keys, values in zip(lists, found, strict=True):
            if None in values:
                for i, v in enumerate(values):
                    if v is None:
                        k = keys[i]
                        v = old.get(k)
                        if v is None:
                            holes.append((values, i, k))
                            todo[k] = None
                        else:
                            values[i] = new[k] = v
        if todo:
            learn(list(todo))
            for values, i, k in holes:
                values[i] = new[k]
            for k in todo:
                if len(k) > KEPT_LENGTH:
                    del new[k]
        return found


class UnitEncoder:
    """Texts to ids. Units are found and hashed in numpy over whole batches; each distinct unit is looked up once a batch in
    a table of hashes, and the ids of all units are gathered from one pool. Units that aren't in the table yet are encoded
    by the library in one text, which is cut again by the tokens' lengths. Equality of units is that of 64-bit hashes."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.specials = [s.encode() for s in specials(self.tokenizer)]
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.uint16 if size <= 1 << 16 else np.uint32
        self.lengths = np.zeros(size, np.int64)  # in bytes
        for letters, k in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.lengths[k] = len(letters)
        self.forget()

    def forget(self) -> None:
        self.pool, self.used = np.zeros(1 << 20, self.dtype), 0
        self.tables = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in range(2)]  # all but the latest, the latest: hashes in order, places in the pool, counts

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)

    def keep(self, ids: np.ndarray) -> int:
        """Adds ids to the pool and gives their place there."""
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool) // 2, len(ids)), self.dtype)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        return self.used - len(ids)

    def learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and counts of the ids of units."""
        places, counts = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        joins = SPACE[data[starts]] & ~SPACE[data[ends - 1]]  # start with white space, but aren't all of it
        joined = np.flatnonzero(joins)
        if len(joined):
            sizes = ends[joined] - starts[joined]
            stops = np.cumsum(sizes)
            text = data[np.arange(stops[-1]) + np.repeat(starts[joined] - (stops - sizes), sizes)]
            edges = np.unique(np.append(stops[np.searchsorted(stops, np.arange(LEARN_BYTES, stops[-1], LEARN_BYTES))], stops[-1])).tolist()
            ids = np.concatenate([self.whole(text[a:b].tobytes().decode()) for a, b in zip([0, *edges[:-1]], edges, strict=True)])
            cuts = np.searchsorted(np.cumsum(self.lengths[ids]), stops) + 1
            counts[joined] = np.diff(cuts, prepend=0)
            places[joined] = self.keep(ids) + cuts - counts[joined]
        others = np.flatnonzero(~joins)
        texts = [data[starts[k] : ends[k]].tobytes().decode() for k in others]
        for k, e in zip(others, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, self.dtype)
            places[k], counts[k] = self.keep(ids), len(ids)
        return places, counts

    def find(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and counts of distinct units, learning the new ones."""
        if self.used > KEPT_IDS:
            self.forget()
        places, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        for known, at, n in self.tables:
            if len(known):
                k = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                hit = known[k] == hashes
                places[hit], counts[hit] = at[k[hit]], n[k[hit]]
        new = np.flatnonzero(places < 0)
        if len(new):
            places[new], counts[new] = self.learn(data, starts[new], ends[new])
            late = [np.concatenate(x) for x in zip(self.tables[1], (hashes[new], places[new], counts[new]), strict=True)]
            big = len(late[0]) > 20_000 + len(self.tables[0][0]) // 4
            if big:
                late = [np.concatenate(x) for x in zip(self.tables[0], late, strict=True)]
            order = np.argsort(late[0])
            self.tables[0 if big else 1] = tuple(x[order] for x in late)
            if big:
                self.tables[1] = tuple(x[:0] for x in late)
        return places, counts

    def plain(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without special strings or white space beyond ASCII: ids, and how many each text has."""
        space = SPACE[data]
        begins = np.zeros(len(data), bool)
        begins[1:] = space[1:] & ~space[:-1]
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(begins)
        if not len(starts):
            return np.zeros(0, self.dtype), np.zeros(len(offsets) - 1, np.int64)
        ends = np.append(starts[1:], len(data))
        hashes = BYTES.ranges(BYTES.prefix(BYTE_VALUE[data]), starts, ends)
        codes, distinct = pd.factorize(hashes)
        firsts = np.empty(len(distinct), np.int64)
        firsts[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        places, counts = self.find(distinct, data, starts[firsts], ends[firsts])
        sizes = counts[codes]
        stops = np.cumsum(sizes)
        ids = self.pool[np.arange(stops[-1]) + np.repeat(places[codes] - (stops - sizes), sizes)]
        return ids, np.diff(np.append(0, stops)[np.searchsorted(starts, offsets)])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a chunk of texts, one after another, and how many each text has."""
        odd = np.zeros(len(offsets) - 1, bool)
        raw = data.tobytes()
        for m in ODD_SPACE.finditer(raw):
            odd[np.searchsorted(offsets, m.start(), "right") - 1] = True
        for s in self.specials:
            at = raw.find(s)
            while at >= 0:
                odd[np.searchsorted(offsets, at, "right") - 1] = True
                at = raw.find(s, at + 1)
        if not odd.any():
            return self.plain(data, offsets)
        parts: list[np.ndarray] = []
        for k in range(len(odd)):
            text = data[offsets[k] : offsets[k + 1]]
            parts.append(self.whole(text.tobytes().decode()) if odd[k] else self.plain(text, np.array([0, len(text)]))[0])
        return np.concatenate(parts), np.array([len(p) for p in parts])


_encoders: dict[str, UnitEncoder] = {}


def encoder(path: str) -> UnitEncoder:
    """One for each path and worker."""
    if path not in _encoders:
        _encoders[path] = UnitEncoder(path)
    return _encoders[path]
