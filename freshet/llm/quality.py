"""Quality classifier: a linear hinge-loss model over n-gram indicators scaled by naive Bayes log-count ratios.

Features are indicators (present or not) of word unigrams and bigrams and of unigrams to trigrams of word shapes (which
kinds of letters, digits and marks a word has, its length class, whether it repeats the word before), hashed into BUCKETS
places. Each place j is scaled by r_j = log((1 + pos_j) / (total pos)) - log((1 + neg_j) / (total neg)). The model is
fitted by dual coordinate descent on the L2-regularised, L1-loss hinge problem, class-weighted, and its margins are
turned into probabilities by a logistic curve fitted on rows that were left out of that fit, at the labelled rows' own
class balance.

The fit uses at most MAX_ROWS_PER_CLASS labelled rows of each class, those with the smallest MD5 of doc_id: a bounded
sample whose features fit the driver. Every text is scored whole.

Defined cases: a null text is scored as an empty one; a doc_id that is null isn't held out; labels that repeat or are
null are dropped (the smaller of two labels counts); with labels of one class or none every score is that class's share
(0.5 without labels); an empty table gives an empty result; columns other than doc_id, text and quality are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm.storage import shipped
from freshet.llm.textops import BYTE_VALUE, BYTES, LOWER, RUNS, SPACE, chunks, mix, owners, pieces, run_starts

BITS = 18
BUCKETS = 1 << BITS
MAX_ROWS_PER_CLASS = 4000
C, EPOCHS = 1.0, 12
THRESHOLD = 0.3

KINDS = {"lower": bytes(range(97, 123)), "upper": bytes(range(65, 91)), "digit": b"0123456789", "stop": b".,;:?'\"()-", "shout": b"!", "bar": b"|", "sign": b"#*$%&<>@_=+~^\\/{}[]`"}


def shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """A code for the look of each word."""
    code = np.zeros(len(starts), np.uint64)
    table = np.zeros(256, bool)
    for k, marks in enumerate(KINDS.values()):
        table[:] = False
        table[list(marks)] = True
        at = np.zeros(len(data) + 1, np.int32)
        np.cumsum(table[data], out=at[1:])
        n = np.minimum(at[ends] - at[starts], 2)
        code = code * np.uint64(3) + n.astype(np.uint64)
        if k == 0:
            code += np.uint64(3**8) * np.searchsorted([2, 4, 7, 11, 16], ends - starts, "right").astype(np.uint64)
    same = np.zeros(len(starts), bool)
    same[1:] = hashes[1:] == hashes[:-1]
    same[firsts[firsts < len(starts)]] = False
    return mix(code * np.uint64(2) + same.astype(np.uint64) + np.uint64(1))


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct feature places of each text of a chunk, ascending: places, and n + 1 offsets of texts into them."""
    starts, ends, words = pieces(SPACE[data], offsets)
    hashes = BYTES.ranges(BYTES.prefix(BYTE_VALUE[LOWER[data]]), starts, ends)
    looks = shapes(data, starts, ends, hashes, words[:-1])
    docs = owners(words)
    found = []
    for values, most in ((hashes, 2), (looks, 3)):
        prefix = RUNS.prefix(values)
        for n in range(1, most + 1):
            at = run_starts(words, n)
            place = (RUNS.ranges(prefix, at, at + n) ^ mix(np.uint64([n + 4 * most]))[0]) >> np.uint64(64 - BITS)
            found.append((docs[at].astype(np.int64) << BITS) | place.astype(np.int64))
    keys = np.unique(np.concatenate(found))
    return (keys & (BUCKETS - 1)).astype(np.int32), np.searchsorted(keys >> BITS, np.arange(len(offsets)))


def descend(places: list[np.ndarray], scale: np.ndarray, y: np.ndarray, c: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> np.ndarray:
    """Weights (over places, and a bias last) of the hinge-loss model by dual coordinate descent: for each row in random
    order, the dual variable moves to its best value within [0, c_i] and the weights follow."""
    w, bias = np.zeros(len(scale)), 0.0
    alpha = np.zeros(len(y))
    values = [scale[p] for p in places]
    norms = np.array([v @ v + 1.0 for v in values])
    rng = np.random.Generator(np.random.PCG64(seed))
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            gradient = y[i] * (values[i] @ w[places[i]] + bias) - 1.0
            new = min(max(alpha[i] - gradient / norms[i], 0.0), c[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[places[i]] += step * values[i]
                bias += step
                alpha[i] = new
    return np.append(w, bias)


def logistic(margins: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a m + b))) by Newton steps on the weighted log loss, slightly regularised."""
    a, b = 1.0, 0.0
    x = np.stack([margins, np.ones_like(margins)], 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = x.T @ (weight * (p - (y > 0))) + 1e-3 * np.array([a - 1.0, b])
        h = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-3 * np.eye(2)
        da, db = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = max(a - da, 1e-3), b - db
    return float(a), float(b)


@dataclass
class Model:
    weights: np.ndarray  #: over places, already scaled
    bias: float
    a: float = 1.0
    b: float = 0.0

    def margins(self, places: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Each row's own sum: the same whichever rows share its batch."""
        out = np.full(len(offsets) - 1, self.bias)
        some = np.flatnonzero(np.diff(offsets))
        if len(some):
            out[some] += np.add.reduceat(self.weights[places], offsets[some])
        return out

    def scores(self, places: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * self.margins(places, offsets) + self.b, -30, 30)))


def train(places: list[np.ndarray], labels: np.ndarray, share: float) -> Model:
    """A model from feature places and 0/1 labels; `share` is the share of label 1 among all labelled rows."""
    if len(set(labels.tolist())) < 2:
        odds = min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.zeros(BUCKETS), float(np.log(odds / (1 - odds))))
    y = np.where(labels == 1, 1.0, -1.0)

    def ratios(rows: np.ndarray) -> np.ndarray:
        counts = {k: np.bincount(np.concatenate([places[i] for i in rows if y[i] == k] or [np.zeros(0, np.int64)]), minlength=BUCKETS) + 1.0 for k in (1, -1)}
        r = np.log(counts[1] / counts[1].sum()) - np.log(counts[-1] / counts[-1].sum())
        r[counts[1] + counts[-1] <= 3] = 0.0  # seen once: says nothing beyond its row
        return r

    def fit(rows: np.ndarray) -> Model:
        r = ratios(rows)
        most = max((y[rows] > 0).sum(), (y[rows] < 0).sum())
        each = {k: C * most / max((y[rows] == k).sum(), 1) for k in (1, -1)}
        units = 1.0 / np.sqrt(np.mean([(r[places[i]] ** 2).sum() for i in rows]) + 1e-9)  # rows of about length 1
        w = descend([places[i] for i in rows], r * units, y[rows], np.array([each[k] for k in y[rows]]))
        return Model(w[:-1] * r * units, float(w[-1]))

    fold = np.arange(len(y)) % 4 == 0
    if len(set(y[fold])) == 2 and len(set(y[~fold])) == 2:
        part = fit(np.flatnonzero(~fold))
        margins = np.array([part.weights[places[i]].sum() + part.bias for i in np.flatnonzero(fold)])
        weight = np.where(y[fold] > 0, share / (y[fold] > 0).mean(), (1 - share) / (y[fold] < 0).mean())
        a, b = logistic(margins, y[fold], weight)
    else:
        a, b = 1.0, 0.0
    model = fit(np.arange(len(y)))
    model.a, model.b = a, b
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_ROWS_PER_CLASS) -> Model:
    """A model from the rows that aren't held out, at most `most` of each class."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("label"))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = [known.filter(F.col("label") == k).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(most) for k in sorted(counts)]
    if not picked:
        return train([], np.zeros(0), 0.5)
    sample = picked[0] if len(picked) == 1 else picked[0].unionByName(picked[1])
    joined = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label"), "text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in chunks(batch):
                places, ends = features(data, offsets)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array([places[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], names=["doc_id", "label", "places"])

    got = shipped(joined).mapInArrow(extract, "doc_id long, label int, places binary").toArrow()
    rows = sorted(zip(got["doc_id"].to_pylist(), got["label"].to_pylist(), got["places"].to_pylist(), strict=True), key=lambda r: (hash_order(r[0]), r[2]))
    return train([np.frombuffer(r[2], np.int32) for r in rows], np.array([r[1] for r in rows]), counts.get(1, 0) / sum(counts.values()))


def hash_order(doc_id: int) -> int:
    return int(mix(np.uint64([doc_id & (2**64 - 1)]))[0])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """A row per row of docs: doc_id and score."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in chunks(batch):
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(model.scores(*features(data, offsets)))], names=["doc_id", "score"])

    return shipped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(work, "doc_id long, score double")


def op1_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op1_quality_nbsvm": op1_quality_nbsvm}
ORACLES: dict[str, str] = {}
