"""Language identification by a bidirectional gated recurrent network over bytes.

Texts are cut into segments of SEGMENT bytes. Two gated recurrent units read each segment, one from either end, and a
softmax over both states labels every position; a document's probabilities are the means over all its positions. The
network is trained in numpy by backpropagation through time with Adam on a bounded sample of labelled documents:
about SAMPLE_PER_LANGUAGE a language, picked by hash, with PIECES segments from hashed places of each.

Defined cases: null texts and texts without a letter are `und` with score 0; with no labelled document at all every text
is `und`; a null doc_id isn't held out; rows that repeat are judged one by one; an empty table gives an empty result;
columns other than doc_id, text and (for the fit) lang are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet.llm.storage import shipped
from freshet.llm.textops import chunks

UNKNOWN = "und"
SEGMENT = 96
HIDDEN = 8
SAMPLE_PER_LANGUAGE = 400
PIECES = 4
STEPS, BATCH, RATE = 140, 192, 0.03
#: Bytes of text in work at once: the states of its segments stay in a processor's cache.
CHUNK = 1 << 19
GATES = ("z", "r", "n")


def sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


@dataclass
class Network:
    """For each direction d (f, b) and gate g: input rows by byte `d_in_g`, recurrent `d_re_g`, and output `d_out`."""

    languages: list[str]
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def fresh(languages: list[str], hidden: int = HIDDEN, seed: int = 5) -> Network:
        rng = np.random.Generator(np.random.PCG64(seed))
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        w = {f"{d}_{part}_{g}": draw(256 if part == "in" else hidden, hidden, scale=0.3) for d in "fb" for part in ("in", "re") for g in GATES}
        w |= {f"{d}_out": draw(hidden, len(languages), scale=0.3) for d in "fb"} | {"bias": np.zeros(len(languages), np.float32)}
        return Network(languages, w)

    def step(self, d: str, byte: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """The next state, with what backpropagation needs."""
        w = self.weights
        z = sigmoid(w[f"{d}_in_z"].take(byte, 0) + h @ w[f"{d}_re_z"])
        r = sigmoid(w[f"{d}_in_r"].take(byte, 0) + h @ w[f"{d}_re_r"])
        u = h @ w[f"{d}_re_n"]
        n = np.tanh(w[f"{d}_in_n"].take(byte, 0) + r * u)
        return n + z * (h - n), z, r, u, n

    def positions(self, segments: np.ndarray, active: np.ndarray) -> np.ndarray:
        """Probabilities [position, segment, language]. segments: bytes [position, segment], longest segments first;
        active: how many segments have each position. Places beyond a segment's end are zero."""
        length, total = segments.shape
        out = np.zeros((length, total, len(self.languages)), np.float32)
        for d, order in (("f", range(length)), ("b", range(length - 1, -1, -1))):
            h = np.zeros((total, self.weights["f_re_z"].shape[0]), np.float32)
            for t in order:
                n = active[t]
                h[:n] = self.step(d, segments[t, :n], h[:n])[0]
                out[t, :n] += h[:n] @ self.weights[f"{d}_out"]
        out += self.weights["bias"]
        np.exp(out, out=out)
        out /= out.sum(axis=2, keepdims=True)
        for t in range(length):
            out[t, active[t] :] = 0
        return out

    def documents(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean probabilities [document, language] over all positions; zeros for an empty document."""
        sizes = np.diff(offsets)
        per_doc = -(-sizes // SEGMENT)
        doc = np.repeat(np.arange(len(sizes)), per_doc)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
        starts = offsets[:-1][doc] + nth * SEGMENT
        lengths = np.minimum(offsets[1:][doc] - starts, SEGMENT)
        order = np.argsort(-lengths, kind="stable")
        starts, lengths, doc = starts[order], lengths[order], doc[order]
        out = np.zeros((len(sizes), len(self.languages)))
        if len(starts):
            padded = np.r_[data, np.zeros(SEGMENT, np.uint8)]
            segments = padded[starts[None, :] + np.arange(lengths[0])[:, None]]
            active = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), "right")
            sums = self.positions(segments, active).sum(axis=0)
            for k in range(len(self.languages)):
                out[:, k] = np.bincount(doc, sums[:, k], len(sizes)) / np.maximum(sizes, 1)
        return out

    def gradients(self, segments: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy of all positions of full segments [position, segment], and its gradients through time."""
        length, total = segments.shape
        hidden = self.weights["f_re_z"].shape[0]
        logits = np.tile(self.weights["bias"], (length, total, 1))
        tape: dict[str, list[tuple]] = {"f": [], "b": []}
        for d in "fb":
            h = np.zeros((total, hidden), np.float32)
            for t in range(length) if d == "f" else range(length - 1, -1, -1):
                before = h
                h, *parts = self.step(d, segments[t], before)
                tape[d].append((t, before, h, *parts))
                logits[t] += h @ self.weights[f"{d}_out"]
        p = np.exp(logits - logits.max(axis=2, keepdims=True))
        p /= p.sum(axis=2, keepdims=True)
        loss = float(-np.log(p[:, np.arange(total), target] + 1e-9).mean())
        p[:, np.arange(total), target] -= 1
        p /= length * total
        g = {k: np.zeros_like(v) for k, v in self.weights.items()}
        g["bias"] = p.sum(axis=(0, 1))
        for d in "fb":
            back = np.zeros((total, hidden), np.float32)
            w = self.weights
            for t, before, h, z, r, u, n in reversed(tape[d]):
                g[f"{d}_out"] += h.T @ p[t]
                dh = p[t] @ w[f"{d}_out"].T + back
                dz = dh * (before - n) * z * (1 - z)
                dn = dh * (1 - z) * (1 - n * n)
                dr = dn * u * r * (1 - r)
                du = dn * r
                back = dh * z + dz @ w[f"{d}_re_z"].T + dr @ w[f"{d}_re_r"].T + du @ w[f"{d}_re_n"].T
                for gate, inner, own in (("z", dz, dz), ("r", dr, dr), ("n", dn, du)):
                    g[f"{d}_re_{gate}"] += before.T @ own
                    one_hot = np.zeros((total, 256), np.float32)
                    one_hot[np.arange(total), segments[t]] = 1
                    g[f"{d}_in_{gate}"] += one_hot.T @ inner
        return loss, g


def train(segments: np.ndarray, target: np.ndarray, languages: list[str], steps: int = STEPS, seed: int = 3) -> Network:
    """segments: bytes [segment, SEGMENT]; target: index of each one's language. Batches hold languages in equal parts."""
    net, rng = Network.fresh(languages), np.random.Generator(np.random.PCG64(seed))
    first, second = ({k: np.zeros_like(v) for k, v in net.weights.items()} for _ in range(2))
    of = [np.flatnonzero(target == k) for k in range(len(languages))]
    for i in range(1, steps + 1):
        rows = np.concatenate([rng.choice(x, max(1, BATCH // len(languages))) for x in of])
        _, g = net.gradients(segments[rows].T, target[rows])
        rate = RATE * min(1.0, 2 * (1 - i / (steps + 1)))
        for k, v in net.weights.items():
            first[k] = 0.9 * first[k] + 0.1 * g[k]
            second[k] = 0.99 * second[k] + 0.01 * g[k] ** 2
            v -= (rate * (first[k] / (1 - 0.9**i)) / (np.sqrt(second[k] / (1 - 0.99**i)) + 1e-6)).astype(np.float32)
    return net


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, most: int = SAMPLE_PER_LANGUAGE) -> Network | None:
    """A network from documents that aren't held out: all of a language with at most `most`, else those whose hash falls
    into the share that leaves about `most`."""
    known = docs.select("doc_id", "lang", "text").filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    place = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) / (1 << 30)
    picked = False
    for lang, n in sorted(counts.items()):
        picked = F.when(F.col("lang") == lang, place < most / n).otherwise(picked) if n > most else F.when(F.col("lang") == lang, True).otherwise(picked)
    at = [(F.pmod(F.xxhash64("doc_id", F.lit(k)), F.greatest(F.length("text") - SEGMENT, F.lit(1))) + 1).cast("int") for k in range(PIECES)]
    cut = [F.encode(F.substring("text", p, F.lit(SEGMENT)), "UTF-8") for p in at]
    rows = known.filter(picked).filter(F.col("text").rlike(r"\p{L}")).select("doc_id", "lang", F.array(*cut).alias("cut")).collect()
    languages = sorted({r["lang"] for r in rows})
    if not languages:
        return None
    segments, target = [], []
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        for piece in {bytes(x) for x in r["cut"] if x}:
            segments.append(np.resize(np.frombuffer(piece, np.uint8), SEGMENT))
            target.append(languages.index(r["lang"]))
    order = np.lexsort((target, [s.tobytes() for s in segments]))
    return train(np.stack(segments)[order], np.array(target)[order], languages)


def predict(docs: DataFrame, net: Network | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row per row of docs: the columns `keep` (doc_id by default), lang_pred and score."""
    letters = docs.select(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_letters"), F.col("text").alias("_text"), *[c for c in keep if c != "text"])
    kept = [F.col("_text").alias("text") if c == "text" else F.col(c) for c in keep]
    if net is None:
        return letters.select(*kept, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    schema = T.StructType([f for f in letters.schema if f.name not in ("_letters", "_text") or f.name == "_text" and "text" in keep] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*net.languages, UNKNOWN], object)
        for batch in batches:
            for rows, data, offsets in chunks(batch, "_text", most=CHUNK):
                found = net.documents(data, offsets)
                has = rows.column(0).to_numpy(zero_copy_only=False)
                best = np.where(has, found.argmax(axis=1), len(net.languages))
                scores = np.where(has, np.clip(found.max(axis=1), 0, 1), 0.0)
                columns = [rows.column(rows.schema.get_field_index(f.name)) for f in schema.fields[:-2]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(names[best], pa.string()), pa.array(scores)], names=schema.names)

    return shipped(letters).mapInArrow(work, schema).select(*kept, "lang_pred", "score")


def op3_bigru_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, fit(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES = {"op3_bigru_language": op3_bigru_language}
ORACLES: dict[str, str] = {}
