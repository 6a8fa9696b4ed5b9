"""Whitening against a whole eigendecomposition, exact sums, and its edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import queries as Q
from tessera.llm import whiten as W

SCHEMA = "vec_id bigint, embedding array<double>"


def brute(rows, k=4):
    """(x by row, n, sums, eigenvalues, axes) of the usable rows by one singular value decomposition."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    dims = max((len(v) for _, v in kept), default=0)
    x = [[int(np.floor(256 * c)) for c in v] + [0] * (dims - len(v)) for _, v in kept]
    distinct = [list(t) for t in {tuple(v) for v in x}]
    n, sums = len(distinct), [sum(c) for c in zip(*distinct, strict=True)]
    a = np.array([[float(n * c - s) / n for c, s in zip(v, sums, strict=True)] for v in distinct]).reshape(n, dims)
    _, spread, axes = np.linalg.svd(a)
    values = np.concatenate((spread**2 / max(n, 1), np.zeros(dims - len(spread))))
    return [i for i, _ in kept], x, n, sums, values, axes.T


def check(spark, rows, k=4, close=1e-9):
    out = W.whiten(spark.createDataFrame(rows, SCHEMA), components=k).collect()
    ids, x, n, sums, values, axes = brute(rows)
    real = min(k, int((values > values[0] * 1e-24).sum()))
    assert len(out) == real * len(ids) and {r["component"] for r in out} == set(range(1, real + 1))
    got = {(r["vec_id"], r["component"]): r for r in out}
    for c in range(1, real + 1):
        mine = np.array([got[i, c]["whitened"] for i in ids])
        exact = np.array([[(n * e - s) / n for e, s in zip(v, sums, strict=True)] for v in x]) @ axes[:, c - 1] / np.sqrt(values[c - 1])
        assert min(np.abs(mine - exact).max(), np.abs(mine + exact).max()) < close
        assert got[ids[0], c]["explained"] == pytest.approx(values[c - 1] / values.sum(), rel=1e-6)
    for i, v in zip(ids, x, strict=True):
        want = sum((n * e - s) ** 2 for e, s in zip(v, sums, strict=True))
        assert got[i, 1]["deviation"] == (want if want < 2**63 else None) and got[i, 1]["n"] == n
    assert len({r["identity_error"] for r in out}) == 1 and out[0]["identity_error"] < 1e-9
    return got


def test_query_equals_an_eigendecomposition(spark):
    rows = [(r["vec_id"], [float(c) for c in r["embedding"]]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    got = check(spark, rows)
    named = {(r["vec_id"], r["component"]): r for r in Q.op13_embedding_whitening(spark, "/root/testdata/sf0.001").collect()}
    assert named.keys() == got.keys() and all(abs(abs(named[k]["whitened"]) - abs(got[k]["whitened"])) < 1e-9 for k in got)


def test_ill_conditioned_rows(spark):
    """Scales from 1e6 down to a grid step and nearly equal directions need the shift and several passes."""
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 6)) * [1e6, 1e4, 1e2, 1, 0.1, 0.02]
    check(spark, list(enumerate((base @ np.linalg.qr(rng.normal(size=(6, 6)))[0]).tolist())), 6, 1e-4)
    near = rng.normal(size=(200, 1)) * 1e5 + rng.normal(size=(200, 3))
    check(spark, list(enumerate(near.tolist())), 3, 1e-4)


def test_missing_directions(spark):
    rng = np.random.default_rng(3)
    line = np.outer(rng.integers(-50, 50, 40), [1, 2, 0, -1]) / 256
    check(spark, list(enumerate(line.tolist())))
    plane = rng.integers(-50, 50, (40, 2)) @ np.array([[1, 0, 2, 0, 1], [0, 1, 1, 0, 3]]) / 256
    check(spark, list(enumerate(plane.tolist())))
    check(spark, [(1, [0.0, 1.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0])])


def test_factors_make_the_rows_orthonormal(spark):
    x = [(v,) for v in np.random.default_rng(5).integers(-400, 400, (500, 8)).tolist()]
    fitted = W.fit(spark.createDataFrame(x, "x array<bigint>"))
    assert fitted.passes >= 2 and fitted.axes.shape == (8, 8) and np.allclose(fitted.axes @ fitted.axes.T, np.eye(8), atol=1e-13)
    assert (np.diff(fitted.values) < 0).all()


def test_large_entries_and_sums(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=3) * [1e13, 1e12, 1e11]).tolist()) for i in range(30)]
    check(spark, rows, close=1e-6)
    x = {r["id"]: r["x"] for r in W.on_grid(spark.createDataFrame([(1, [1e300, -1e300, -0.0, 0.999 / 256, -0.001, 3.6e16])], SCHEMA), "vec_id", "embedding").collect()}
    assert x == {1: [2**63 - 1, -(2**63), 0, 0, -1, int(256 * 3.6e16)]}
    assert len(W.whiten(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 0.5])], SCHEMA)).collect()) % 3 == 0
    assert W._deviation(np.array([[2**31, 0], [2**32, 2**31]])) == [2**62, None]


def test_edges(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 2.0, 0.5]), (1, [1.0, 2.0, 0.5]), (2, None), (3, [None, 1.0, 2.0]), (4, [inf, 0.0, 0.0]), (5, [nan, 0.0, 0.0]), (6, []), (None, [0.1, 0.2, 0.3]), (7, [3.0]), (8, [3.0, 0.0, 0.0]), (9, [-1.0, 5.0, 2.0])]
    d = spark.createDataFrame(rows, SCHEMA)
    out = W.whiten(d.withColumns({c: F.lit(1) for c in ("x", "n", "component", "whitened")})).collect()
    ids = sorted(((r["vec_id"] if r["vec_id"] is not None else -1) for r in out if r["component"] == 1))
    assert ids == [-1, 1, 1, 6, 7, 8, 9] and {r["n"] for r in out} == {5}
    same = [sorted((r["component"], r["whitened"]) for r in out if r["vec_id"] == i) for i in (7, 8)]
    assert same[0] == same[1]
    for none in (d.limit(0), d.where("vec_id = 1"), d.where("vec_id in (2, 3, 4, 5)"), d.where("vec_id = 6")):
        assert W.whiten(none).collect() == []
    assert W.whiten(d.limit(0)).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
