"""Whitening against a dense eigendecomposition and exact whole numbers."""

import math

import numpy as np
import pytest

from freshet.llm import whitening


@pytest.mark.parametrize("values", [[9.0, 7, 5, 4, 3, 2, 1] + [0.5] * 20, [5.0] * 4 + [1.0] * 30, [3.0, 2.0] + [0.0] * 20, [0.0] * 12, [4.0], [6.0, 6.0, 6.0, 5.0, 5.0] + list(np.linspace(1, 0, 60))])
def test_lanczos_finds_leading_pairs(values):
    rng = np.random.default_rng(3)
    d = len(values)
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    matrix = (q * values) @ q.T
    passes = []
    found, vectors = whitening.lanczos(lambda b: passes.append(1) or matrix @ b, d, 4)
    want = sorted(values, reverse=True)[:4]
    assert np.allclose(found, want, atol=1e-12) and len(passes) <= math.ceil(d / whitening.BLOCK) + 1
    assert np.allclose(vectors.T @ vectors, np.eye(len(want)), atol=1e-12)
    assert np.allclose(matrix @ vectors, vectors * found, atol=1e-11)


def test_a_wide_operator_stops_early():
    d = 400
    values = np.r_[[100.0, 80, 60, 40], np.linspace(1, 0.1, d - 4)]
    passes = []
    found, _ = whitening.lanczos(lambda b: passes.append(1) or values[:, None] * b, d, 4)
    assert np.allclose(found, values[:4], rtol=1e-13) and len(passes) < 20


def plain(vectors):
    """x of the rows that stay, and n, S, eigenvalues and vectors over the distinct ones."""
    width = max((len(v) for v in vectors if v is not None), default=0)
    kept = [(k, [math.floor(256 * float(np.float32(c))) for c in v] + [0] * (width - len(v))) for k, v in enumerate(vectors) if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    distinct = np.array(sorted({tuple(x) for _, x in kept}), np.int64)
    n, sums = len(distinct), distinct.sum(axis=0)
    c = distinct - sums / n
    values, columns = np.linalg.eigh(c.T @ c / n)
    return kept, n, sums, values[::-1], columns[:, ::-1]


def test_odd_rows(spark):
    rng = np.random.default_rng(8)
    vectors = [[float(c) for c in row] for row in (rng.standard_normal((60, 9)) * np.array([4, 3, 2, 1.5, 1, 0.5, 0.4, 0.3, 0.2])).astype(np.float32)]
    vectors += [None, [], [1.0], vectors[0], vectors[0], [None] * 9, [float("nan")] * 9, [1.0] * 8 + [float("inf")], [0.0] * 9, [-0.0] * 9, [100.0] + [0.0] * 8]
    rows = [(k, v, 1, "x") for k, v in enumerate(vectors)] + [(None, vectors[1], 2, "y")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, component int, whitened string").repartition(3)
    got = whitening.whiten(frame).collect()
    kept, n, sums, values, columns = plain(vectors)
    by_row: dict[int, dict] = {}
    for r in got:
        by_row.setdefault(r["vec_id"], {})[r["component"]] = r
        assert r["n"] == n and abs(r["explained"] / (values[r["component"] - 1] / values.sum()) - 1) < 1e-12 and r["identity_error"] < 1e-12
    assert set(by_row) == {k for k, _ in kept} | {None}
    signs = None
    for k, x in kept:
        mine = np.array([by_row[k][c]["whitened"] for c in range(1, 5)])
        want = (np.array(x) - sums / n) @ columns[:, :4] / np.sqrt(values[:4])
        signs = np.sign(mine * want) if signs is None else signs
        assert np.allclose(mine * signs, want, atol=1e-10)
        assert by_row[k][1]["deviation"] == sum((n * a - int(s)) ** 2 for a, s in zip(x, sums, strict=True))
    assert by_row[None][1]["whitened"] == by_row[1][1]["whitened"]


def test_large_entries_stay_exact(spark):
    rows = [(1, [3.0e6, 1.0]), (2, [-3.0e6, 2.0]), (3, [0.0, 5.0]), (4, [1e30, 0.0])]
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(spark.createDataFrame(rows, "vec_id int, embedding array<double>")).collect()}
    x = [[768_000_000, 256], [-768_000_000, 512], [0, 1280], [2**31 - 1, 0]]
    sums = [sum(c) for c in zip(*x, strict=True)]
    want = {k + 1: sum((4 * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for k, v in enumerate(x)}
    assert got == {k: v if v < 2**63 else None for k, v in want.items()}


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [2.0, 3.0]), (2, [2.0, 3.0])], [(1, [float("nan")])]])
def test_nothing_to_whiten(spark, rows):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = whitening.whiten(frame)
    assert found.count() == 0 and found.columns[:2] == ["vec_id", "component"]


def test_less_variance_than_components(spark):
    got = whitening.whiten(spark.createDataFrame([(k, [float(k), 2.0 * k, 1.0, 0.0, 0.0, 0.0]) for k in range(7)], "vec_id long, embedding array<double>")).collect()
    assert {r["component"] for r in got} == {1} and all(abs(r["explained"] - 1) < 1e-12 for r in got) and len(got) == 7


def test_query(spark, data):
    rows = spark.read.parquet(f"{data}/embeddings.parquet").orderBy("vec_id").collect()
    kept, n, sums, values, columns = plain([r["embedding"] for r in rows])
    got = {(r["vec_id"], r["component"]): r["whitened"] for r in whitening.op11_lanczos_whitening(spark, data).collect()}
    mine = np.array([[got[rows[k]["vec_id"], c] for c in range(1, 5)] for k, _ in kept])
    want = (np.array([x for _, x in kept]) - sums / n) @ columns[:, :4] / np.sqrt(values[:4])
    assert len(got) == 4 * len(kept) and np.allclose(mine * np.sign((mine * want).sum(axis=0)), want, atol=1e-10)
