"""Whitening of embeddings along their leading principal components, by block Lanczos without a covariance matrix.

Vectors become whole numbers x = floor(256 c), and each distinct one counts once: they are the fit list, a written table. One
pass counts it and sums each dimension; the next sums squared deviations, exactly, so the trace of the covariance V is known
before any component is. Each Lanczos step is one pass that multiplies V with a block of BLOCK columns Q: tasks add up
X'(X Q) over centred rows and a sum by entry joins their parts, so d * BLOCK numbers reach the driver, and V is never made.
The driver orthogonalises the product against all blocks so far, twice, and factors it; directions that vanish (V maps the
block into what is already spanned) are replaced by new random ones, until the wanted pairs have small residuals or all
dimensions are spanned. The driver's share is d x (columns so far) numbers: as large as a model, not as the data.

The rows are then projected where they lie, and no vector but the distinct ones is ever shuffled.

Defined cases: rows whose vector is null or holds a null, NaN or infinite entry are left out; a vector that is shorter than
the longest counts as 0 in its missing dimensions; |x| stops at 2^31 - 1; equal vectors (and repeated rows) get rows of their
own, from one entry of the fit list; components without variance (an eigenvalue of at most 1e-12 of the largest) can't be
scaled and are left out, so one distinct vector, or none, gives no rows; a deviation that no long holds is null; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm.storage import shipped, written

COMPONENTS = 4
#: Columns of a block: at least the components, so eigenvalues that repeat are found as often as they are wanted.
BLOCK = 8
#: Residual, as a part of the largest eigenvalue, at which a pair has converged.
TOLERANCE = 1e-13
#: Eigenvalues up to this part of the largest count as no variance; directions up to this part of a block's size as vanished.
NO_VARIANCE, VANISHED = 1e-12, 1e-10
SCALE, MOST = 256, 2**31 - 1


def quantised(batch: pa.RecordBatch, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the rows that stay, and their vectors x; the batch's last column holds the vectors."""
    column = batch.column(batch.num_columns - 1)
    values, parents = pc.list_flatten(column), pc.list_parent_indices(column).to_numpy(zero_copy_only=False)
    numbers = values.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    good = column.is_valid().to_numpy(zero_copy_only=False).copy()
    good[parents[~np.isfinite(numbers)]] = False
    sizes = np.bincount(parents, minlength=len(column)) if len(parents) else np.zeros(len(column), np.int64)
    inside = np.arange(len(numbers)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    x = np.zeros((len(column), dimensions), np.int64)
    use = good[parents] if len(parents) else np.zeros(0, bool)
    x[parents[use], inside[use]] = np.clip(np.floor(numbers[use] * SCALE), -MOST, MOST).astype(np.int64)
    rows = np.flatnonzero(good)
    return rows, x[rows]


def unpacked(batch: pa.RecordBatch, dimensions: int) -> np.ndarray:
    """Rows of the fit list."""
    return np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32).reshape(-1, dimensions).astype(np.int64)


def fit_list(embeddings: DataFrame, dimensions: int, column: str) -> DataFrame:
    """x: each distinct vector once, as 32-bit numbers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, x = quantised(batch, dimensions)
            packed = x.astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([row.tobytes() for row in packed], pa.binary())], names=["x"])

    return shipped(embeddings.select(column)).mapInArrow(work, "x binary").distinct()


def summed(rows: DataFrame, part, size: int, exact: bool = False) -> list:
    """The sum of part(x) over all batches x of the fit list, by entry: a row for each task and entry, then `size` rows.
    Exact sums are of whole numbers."""
    kind = "decimal(38,0)" if exact else "double"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                got = part(batch)
                total = got if total is None else [a + b for a, b in zip(total, got, strict=True)] if exact else total + got
        if total is not None:
            values = pa.array([str(int(v)) for v in total]) if exact else pa.array(np.asarray(total, np.float64))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), values], names=["k", "v"])

    parts = shipped(rows).mapInArrow(work, "k int, v " + ("string" if exact else "double"))
    found = parts.groupBy("k").agg(F.sum(F.col("v").cast(kind)).alias("v")).toArrow()
    out = [0] * size
    for k, v in zip(found["k"].to_pylist(), found["v"].to_pylist(), strict=True):
        out[k] = int(v) if exact else v
    return out


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int]:
    """For each row the sum of (n x - S)^2 over dimensions, exact."""
    far = n * float(np.abs(x).max(initial=0)) + float(max((abs(int(s)) for s in sums), default=0))
    if x.shape[1] * far * far < 2**62:
        gaps = n * x - sums.astype(np.int64)
        return (gaps * gaps).sum(axis=1).tolist()
    return [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S/n, with the whole part of S/n taken off before numbers are rounded."""
    whole = np.array([int(s) // n for s in sums], np.int64)
    rest = np.array([int(s) % n / n for s in sums])
    return (x - whole) - rest


def orthogonalised(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
    return block


def next_block(product: np.ndarray, basis: np.ndarray, width: int, rng: np.random.Generator) -> np.ndarray:
    """Orthonormal columns beside the basis: what is left of the product, and random directions where it vanishes."""
    room = min(width, basis.shape[0] - basis.shape[1])
    scale = max(np.abs(product).max(initial=0), np.finfo(float).tiny)
    left, sizes, _ = np.linalg.svd(orthogonalised(product / scale, basis), full_matrices=False)
    block = orthogonalised(left[:, sizes > VANISHED][:, :room], basis)
    block = np.linalg.qr(block)[0] if block.shape[1] else block
    while block.shape[1] < room:
        fresh = orthogonalised(rng.standard_normal((basis.shape[0], room - block.shape[1])), np.hstack([basis, block]))
        block = np.hstack([block, np.linalg.qr(fresh)[0]])
    return block


def lanczos(multiply, dimensions: int, wanted: int = COMPONENTS, width: int = BLOCK, tolerance: float = TOLERANCE, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The `wanted` largest eigenvalues, falling, and unit eigenvectors of a symmetric operator, given multiply(Q)."""
    rng = np.random.default_rng(seed)
    basis, images = np.zeros((dimensions, 0)), np.zeros((dimensions, 0))
    block = next_block(np.zeros((dimensions, 0)), basis, max(width, wanted), rng)
    while block.shape[1]:
        product = multiply(block)
        basis, images = np.hstack([basis, block]), np.hstack([images, product])
        inner = basis.T @ images
        values, vectors = np.linalg.eigh((inner + inner.T) / 2)
        top = np.argsort(values)[::-1][:wanted]
        values, vectors = values[top], vectors[:, top]
        residuals = np.linalg.norm(images @ vectors - (basis @ vectors) * values, axis=0)
        if basis.shape[1] >= min(wanted, dimensions) + width and (residuals <= tolerance * max(values[0], 0)).all():
            break
        block = next_block(product, basis, width, rng)
    return values, basis @ vectors


def whiten(embeddings: DataFrame, key: str = "vec_id", column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each row that stays and each component: key, component, n, deviation, whitened, explained, identity_error."""
    slim = embeddings.select(key, column)
    dimensions = int(slim.agg(F.coalesce(F.max(F.size(column)), F.lit(0))).first()[0])
    schema = f"component int, n long, deviation long, whitened double, explained double, identity_error double"
    kind = slim.schema[key].dataType.simpleString()
    nothing = slim.sparkSession.createDataFrame([], f"`{key}` {kind}, {schema}")
    if dimensions <= 0:
        return nothing
    rows = written(fit_list(slim, dimensions, column), "vectors")
    counted = summed(rows, lambda b: [b.num_rows, *unpacked(b, dimensions).sum(axis=0).tolist()], dimensions + 1, exact=True)
    n, sums = counted[0], np.array(counted[1:], object)
    if n == 0:
        return nothing
    total = summed(rows, lambda b: [sum(deviations(unpacked(b, dimensions), n, sums))], 1, exact=True)[0]

    def multiply(block: np.ndarray) -> np.ndarray:
        def part(batch: pa.RecordBatch) -> np.ndarray:
            x = centred(unpacked(batch, dimensions), n, sums)
            return (x.T @ (x @ block)).ravel()

        return np.array(summed(rows, part, block.size)).reshape(block.shape) / n

    values, vectors = lanczos(multiply, dimensions, components)
    some = (values > NO_VARIANCE * max(values[0], 0)) & (values > 0)
    values, vectors = values[some], vectors[:, some]
    if not len(values):
        return nothing
    scaled = vectors / np.sqrt(values)
    trace = total / n**3
    shares = values / trace

    def products(batch: pa.RecordBatch) -> np.ndarray:
        z = centred(unpacked(batch, dimensions), n, sums) @ scaled
        return np.r_[z.sum(axis=0), (z.T @ z).ravel()]

    k = len(values)
    moments = np.array(summed(rows, products, k + k * k)) / n
    error = float(np.abs(moments[k:].reshape(k, k) - np.outer(moments[:k], moments[:k]) - np.eye(k)).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, x = quantised(batch, dimensions)
            z = centred(x, n, sums) @ scaled
            far = [v if v < 2**63 else None for v in deviations(x, n, sums)]
            m = len(kept)
            arrays = [
                batch.column(0).take(pa.array(np.repeat(kept, k))), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, n), pa.int64()),
                pa.array(far, pa.int64()).take(pa.array(np.repeat(np.arange(m), k))), pa.array(z.ravel()), pa.array(np.tile(shares, m)), pa.array(np.full(m * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return shipped(slim).mapInArrow(project, f"`{key}` {kind}, {schema}")


def op11_lanczos_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op11_lanczos_whitening": op11_lanczos_whitening}
ORACLES: dict[str, str] = {}
