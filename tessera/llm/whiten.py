"""Whitening of embeddings by shifted Cholesky QR.

Vectors become integers on a fixed grid and each distinct one counts once. Its centred rows A are orthogonalised by
repeated passes: a pass sends only the sum of products of its rows, dims x dims, the driver takes its Cholesky factor
and the next pass solves the triangular systems on its way over the rows. The first product is shifted by what rounding
can make of it, so that its factor exists however ill the rows are conditioned; the factors of the passes, multiplied,
are R of A = QR, and the singular values and right singular vectors of R are those of A: the components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import Scratch, bounded_batches

#: Steps of the grid in one unit; passes at most.
GRID, PASSES = 256, 12
EPS = float(np.finfo(np.float64).eps) / 2
ROWS = 2000


@dataclass
class Whitening:
    """n distinct vectors, their sums S by dimension, and the components: axes (k, dims), eigenvalues, their sum."""

    n: int
    sums: list[int]
    axes: np.ndarray
    values: np.ndarray
    trace: float
    passes: int = 0
    identity_error: float = 0.0
    largest: int = field(default=0)


def on_grid(vectors: DataFrame, id: str, embedding: str, grid: int = GRID) -> DataFrame:
    """(id, x): floor(grid * c) of every entry of the vectors that are neither null nor hold null or non-finite entries.

    Values beyond 64 bits become the nearest that fits. Shorter vectors than the longest get zeros at their end.
    """
    v = F.col(embedding)
    finite = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))
    kept = vectors.where(v.isNotNull() & F.coalesce(F.forall(v, finite), F.lit(False)))
    most, least = 2.0**63 - 1024, -(2.0**63)
    whole = lambda c: F.when(c > most, F.lit(2**63 - 1)).when(c < least, F.lit(-(2**63))).otherwise(F.floor(F.greatest(F.least(c, F.lit(most)), F.lit(least))))
    return kept.select(F.col(id).alias("id"), F.transform(v, lambda c: whole(c.cast("double") * grid)).alias("x"))


def _rows(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _times(x: np.ndarray, n: int, sums: list[int], largest: int) -> np.ndarray:
    """n * x - S, exactly: as 64-bit integers where they fit, else as Python's."""
    if n * largest < 2**62:  # no sum exceeds n times the largest entry
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _solved(a: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """q with q @ factor = a, for an upper triangular factor: forward substitution, all rows at once."""
    q = np.zeros_like(a)
    for j in range(a.shape[1]):
        q[:, j] = (a[:, j] - q[:, :j] @ factor[:j, j]) / factor[j, j]
    return q


def _summed(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    total, n, largest = np.zeros(dims, object), 0, 0
    for batch in batches:
        x = _rows(batch, dims)
        if len(x):
            top = max(int(x.max()), -int(x.min()))
            total = total + (x.sum(axis=0).astype(object) if top * len(x) < 2**62 else x.astype(object).sum(axis=0))
            n, largest = n + len(x), max(largest, top)
    if n:
        each = [pa.array([Decimal(int(v)) for v in total], pa.decimal128(38, 0)), pa.array([n] * dims), pa.array([Decimal(largest)] * dims, pa.decimal128(38, 0))]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims, dtype=np.int32)), *each], names=["d", "s", "n", "top"])


def _products(centre, factors: list[np.ndarray], dims: int):
    """The sum of products of a partition's rows after the triangular solves, by cells of the upper triangle."""
    cells = np.triu_indices(dims)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_rows = np.zeros((dims, dims)), False
        for batch in batches:
            if batch.num_rows:
                q = reduce(_solved, factors, centre(_rows(batch, dims)))
                total += q.T @ q
                any_rows = True
        if any_rows:
            yield pa.RecordBatch.from_arrays([pa.array((cells[0] * dims + cells[1]).astype(np.int32)), pa.array(total[cells])], names=["cell", "g"])

    return of


def _gram(fitted: DataFrame, centre, factors: list[np.ndarray], dims: int) -> np.ndarray:
    parts = fitted.select("x").mapInArrow(_products(centre, factors, dims), "cell int, g double")
    found = parts.groupBy("cell").agg(F.sum("g").alias("g")).toArrow()  # dims * (dims + 1) / 2 rows
    out = np.zeros((dims, dims))
    cell = found["cell"].to_numpy()
    out[cell // dims, cell % dims] = found["g"].to_numpy()
    return np.triu(out) + np.triu(out, 1).T


def _factor(gram: np.ndarray, shift: float) -> np.ndarray:
    """The upper Cholesky factor of gram, with as little of the shift as it takes: none, it, or more."""
    for s in (0.0, shift, 10 * shift, 100 * shift):
        try:
            return np.linalg.cholesky(gram + s * np.eye(len(gram))).T
        except np.linalg.LinAlgError:
            pass
    raise ArithmeticError("no shift makes the product of the rows positive")


def fit(fitted: DataFrame, components: int | None = None) -> Whitening:
    """Components of the rows of `fitted`, column x: lists of one length, each distinct vector once.

    Passes go on until the rows are orthonormal to rounding, but for directions that no row has; those give no
    component. components: the most to keep; None keeps all. Without rows, dimensions or spread there are none.
    """
    first = fitted.select(F.size("x").alias("n")).first()
    dims = first["n"] if first else 0
    if not dims:
        return Whitening(0 if not first else fitted.count(), [], np.zeros((0, 0)), np.zeros(0), 0.0)
    parts = fitted.select("x").mapInArrow(lambda b: _summed(b, dims), "d int, s decimal(38,0), n bigint, top decimal(38,0)")
    per = parts.groupBy("d").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.max("top").alias("top")).orderBy("d").collect()  # dims rows
    n, sums, largest = per[0]["n"], [int(r["s"]) for r in per], int(per[0]["top"])
    centre = lambda x: (_times(x, n, sums, largest) / n).astype(np.float64)

    gram, factors, whole, error = _gram(fitted, centre, [], dims), [], np.eye(dims), np.inf
    if not np.trace(gram) > 0:
        return Whitening(n, sums, np.zeros((0, dims)), np.zeros(0), 0.0, 1, 0.0, largest)
    for _ in range(PASSES):
        # the first factor is shifted always, later ones where a direction is missing
        size = float(np.linalg.norm(gram, 2))
        shift = min(11 * (n * dims + dims * (dims + 1)) * EPS, 0.01) * size
        factor = _factor(gram + (shift * np.eye(dims) if not factors else 0), shift)
        factors.append(factor)
        whole = factor @ whole
        gram = _gram(fitted, centre, factors, dims)
        level = np.linalg.eigvalsh(gram)
        before, error = error, float(np.minimum(np.abs(level - 1), np.abs(level)).max())
        if error <= 4 * dims * EPS or error <= 1e-10 and error > before / 4:
            break
    u, spread, axes = np.linalg.svd(whole)
    # what rounding of the rows makes of a direction that none has is no component
    real = (np.einsum("ik,ij,jk->k", u, gram, u) > 0.5) & (spread > 16 * EPS * np.sqrt(n * dims) * spread[0])
    values = spread[real] ** 2 / n
    out = Whitening(n, sums, axes[real][:components], values[:components], float(values.sum()), len(factors), 0.0, largest)
    if len(out.values):
        scale = np.sqrt(out.values)
        covariance = _gram_of(fitted, lambda x: centre(x) @ out.axes.T / scale, len(scale), dims) / n
        out.identity_error = float(np.abs(covariance - np.eye(len(scale))).max())
    return out


def _gram_of(fitted: DataFrame, of, width: int, dims: int) -> np.ndarray:
    """The sum of products of `of` of all rows, centred, whose sum is thus taken out again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, width))
        for batch in batches:
            if batch.num_rows:
                z = of(_rows(batch, dims))
                total[:width] += z.T @ z
                total[width] += z.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], names=["cell", "g"])

    found = fitted.select("x").mapInArrow(run, "cell int, g double").groupBy("cell").agg(F.sum("g").alias("g")).orderBy("cell").toArrow()["g"].to_numpy()
    n, total = fitted.count(), found.reshape(width + 1, width)
    return total[:width] - np.outer(total[width], total[width]) / n


def _deviation(t: np.ndarray) -> list[int | None]:
    """Exact sums of squares by row; null where they pass 64 bits."""
    if t.dtype != object and t.size and int(np.abs(t).max()) ** 2 * t.shape[1] >= 2**63:
        t = t.astype(object)
    return [s if s < 2**63 else None for s in map(int, (t * t).sum(axis=1))]


def transform(rows: DataFrame, fitted: Whitening, out: str = "vec_id") -> DataFrame:
    """(`out`, component, n, deviation, whitened, explained, identity_error) of (id, x), a row per row and component."""
    kind, w = rows.schema["id"].dataType.simpleString(), fitted
    k, dims = w.axes.shape
    onto = w.axes.T / np.sqrt(w.values)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if k and batch.num_rows:
                t = _times(_rows(batch, dims), w.n, w.sums, w.largest)
                z, at = (t / w.n).astype(np.float64) @ onto, pa.array(np.repeat(np.arange(batch.num_rows), k))
                m = len(at)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(at),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), batch.num_rows)),
                        pa.array(np.full(m, w.n)),
                        pa.array(_deviation(t), pa.int64()).take(at),
                        pa.array(z.ravel()),
                        pa.array(np.tile(w.values / w.trace, batch.num_rows)),
                        pa.array(np.full(m, w.identity_error)),
                    ],
                    names=[out, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.select("id", "x").mapInArrow(of, f"{out} {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")


def whiten(vectors: DataFrame, id: str = "vec_id", embedding: str = "embedding", components: int = 4, grid: int = GRID) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of every usable row and component.

    Rows whose vector is null or holds null or non-finite entries have no result; repeated rows, null ids and equal
    vectors have theirs each. Vectors of several lengths are filled up with zeros. Fewer components come where the
    distinct vectors span fewer directions; none, so no rows, where there is one distinct vector or none, or the table
    is empty. deviation is null where it passes 64 bits. Other columns are not read.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession)
    bounded_batches(spark, ROWS)
    rows = scratch.stored(on_grid(vectors, id, embedding, grid), "grid")
    shortest, longest = rows.agg(F.coalesce(F.min(F.size("x")), F.lit(0)), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    if shortest < longest:
        rows = rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("bigint"), F.lit(longest) - F.size("x"))))
    distinct = scratch.stored(rows.select("x").distinct(), "distinct")
    return scratch.result(transform(rows, fit(distinct, components), id), "whitened")
