"""Whitening of embeddings by the leading components of their covariance.

Vectors are put on an integer grid, so that sums over any number of rows are exact. The
covariance is added up by the tasks from centred rows; it has one entry per pair of
dimensions, a size that does not depend on the rows. Its leading eigenvalues are isolated
by slicing the spectrum: an LDL' factorisation of ``V - s I`` has as many positive pivots
as ``V`` has eigenvalues above ``s``, so halving an interval by counts leaves one eigenvalue
in each. Rayleigh quotient iteration then converges cubically inside its interval, and the
counts on both sides certify which number the eigenvalue has.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



EPS = float(np.finfo(np.float64).eps)
LONG = 2**63 - 1
#: bits of the lower part in which grid values are added up: both parts' sums stay exact
LOW = 24


def above(matrix: np.ndarray, shift: float) -> int:
    """Eigenvalues of a symmetric matrix above ``shift``: positive pivots of its LDL'
    factorisation with Bunch-Kaufman pivoting (pivots of one or two rows)."""
    a = matrix - shift * np.eye(len(matrix))
    ratio, n, k, positive = (1 + math.sqrt(17)) / 8, len(a), 0, 0
    while k < n:
        pivot, two = k, False
        below = np.abs(a[k + 1 :, k])
        most = below.max(initial=0.0)
        if most == 0:
            positive += a[k, k] > 0
            k += 1
            continue
        if abs(a[k, k]) < ratio * most:
            r = k + 1 + int(below.argmax())
            row = np.abs(a[r, k:])
            row[r - k] = 0
            if abs(a[k, k]) * row.max() < ratio * most * most:
                pivot, two = r, abs(a[r, r]) < ratio * row.max()
        at = k + 1 if two else k
        if pivot != at:
            a[[at, pivot]] = a[[pivot, at]]
            a[:, [at, pivot]] = a[:, [pivot, at]]
        if two:
            positive += 1  # such a pivot is indefinite
            side = a[k + 2 :, k : k + 2]
            a[k + 2 :, k + 2 :] -= side @ np.linalg.solve(a[k : k + 2, k : k + 2], side.T)
            k += 2
        else:
            positive += a[k, k] > 0
            side = a[k + 1 :, k]
            a[k + 1 :, k + 1 :] -= np.outer(side, side / a[k, k])
            k += 1
    return int(positive)


def _solved(matrix: np.ndarray, shift: float, right: np.ndarray) -> np.ndarray:
    try:
        out = np.linalg.solve(matrix - shift * np.eye(len(matrix)), right)
    except np.linalg.LinAlgError:  # the shift is an eigenvalue to the last bit
        out = np.linalg.solve(matrix - (shift + EPS * max(abs(shift), np.abs(matrix).max())) * np.eye(len(matrix)), right)
    return out if np.isfinite(out).all() else right


def _quotient_iteration(matrix: np.ndarray, low: float, high: float, tolerance: float, rng) -> tuple[float, np.ndarray] | None:
    """The eigenpair inside (low, high], or None if the iteration leaves it."""
    shift = (low + high) / 2
    v = rng.normal(size=len(matrix))
    for _ in range(2):
        v = _solved(matrix, shift, v / np.linalg.norm(v))
    for _ in range(12):
        v /= np.linalg.norm(v)
        product = matrix @ v
        value = float(v @ product)
        if not low - tolerance <= value <= high + tolerance:
            return None
        if np.linalg.norm(product - value * v) <= tolerance:
            return value, v
        v = _solved(matrix, value, v)
    return None


def leading(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest eigenvalues of a covariance, falling, and unit eigenvectors as
    columns. Eigenvalues within rounding of 0 are left out.

    Eigenvalues closer to each other than rounding can tell are one cluster, whose vectors
    span the same space as the true ones. A wrong number cannot pass: each eigenvalue's
    interval holds as many eigenvalues as are taken from it, by the counts at its ends.
    """
    d = len(matrix)
    size = float(np.abs(matrix).sum(axis=1).max(initial=0.0))
    values, vectors = [], np.zeros((d, 0))
    if size == 0:
        return np.zeros(0), vectors
    tolerance, rng = 4 * d * EPS * size, np.random.default_rng(12)
    todo = [(-size, size * (1 + 1e-9), above(matrix, -size), 0)]
    while todo:
        # the interval on top holds eigenvalues number over + 1 to upto
        low, high, upto, over = todo.pop()
        if upto == over or over >= most:
            continue
        found = None
        if upto - over == 1:
            found = _quotient_iteration(matrix, low, high, tolerance, rng)
        elif high - low <= tolerance:
            block = rng.normal(size=(d, upto - over))
            for _ in range(4):
                block, _ = np.linalg.qr(_solved(matrix, (low + high) / 2, block - vectors @ (vectors.T @ block)))
            found = float((low + high) / 2), block
        if found is None and high - low > tolerance:
            middle = (low + high) / 2
            held = above(matrix, middle)
            todo += [(low, middle, upto, held), (middle, high, held, over)]
            continue
        if found is None:
            raise ArithmeticError("no eigenvector found in a certified interval")
        value, block = found
        block = block.reshape(d, -1)
        for _ in range(2):  # neighbours that rounding has mixed
            block, _ = np.linalg.qr(block - vectors @ (vectors.T @ block))
        vectors = np.hstack([vectors, block])
        values += [value] if block.shape[1] == 1 else [float(b @ matrix @ b) for b in block.T]
    order = np.argsort(-np.array(values), kind="stable")[:most]
    values, vectors = np.array(values)[order], vectors[:, order]
    real = values > tolerance
    return values[real], vectors[:, real]


def on_grid(vector: Column, scale: int, offset: int) -> Column:
    # null beyond 64 bits: the planner may compute this before the rows are filtered
    return F.transform(vector, lambda c: F.when(on_range(c, scale), F.floor(c.cast("double") * scale) + offset))


def on_range(entry: Column, scale: int) -> Column:
    return F.abs(entry.cast("double")) * scale < F.lit(2.0**62)


def usable(vector: Column, scale: int) -> Column:
    """Neither null nor empty, and all entries finite and on a grid of 64 bits."""
    return F.coalesce(
        F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & on_range(c, scale)) & (F.size(vector) > 0),
        F.lit(False),
    )


def moments(grid: DataFrame) -> DataFrame:
    """Per vector length and dimension: rows, exact sums in two parts, extremes."""
    low = F.col("x").bitwiseAND(F.lit((1 << LOW) - 1).cast("long"))
    return (
        grid.select(F.size("x").alias("d"), F.posexplode("x").alias("j", "x"))
        .groupBy("d", "j")
        .agg(
            F.count("*").alias("n"), F.sum(low).alias("low"), F.sum(F.shiftright("x", LOW)).alias("high"),
            F.min("x").alias("least"), F.max("x").alias("most"),
        )
    )


class Centre:
    """Rows against their mean: ``n * x - S`` in integers, ``x - S / n`` in doubles."""

    def __init__(self, n: int, sums: list[int], least: list[int], most: list[int]):
        self.n, self.sums = n, sums
        reach = max(max(n * b - s, s - n * a) for s, a, b in zip(sums, least, most))
        widest = n * max(max(abs(a), abs(b)) for a, b in zip(least, most))
        #: whether 64 bits hold the differences, and the sum of their squares
        self.fits = max(widest, *map(abs, sums)) <= LONG
        self.squares_fit = self.fits and reach * reach * len(sums) <= LONG

    def differences(self, x: np.ndarray) -> np.ndarray:
        kind = np.int64 if self.fits else object
        return x.astype(kind) * self.n - np.array(self.sums, kind)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.differences(x) / self.n).astype(np.float64)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Summed squares of the differences, null where a long cannot hold them."""
        diff = self.differences(x)
        if self.squares_fit:
            return np.einsum("ij,ij->i", diff, diff).tolist()
        exact = [sum(int(v) * int(v) for v in row) for row in diff]
        return [e if e <= LONG else None for e in exact]


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def second_moments(grid: DataFrame, d: int, out: int, rows_of) -> np.ndarray:
    """Sum over all rows of ``y y'`` and, in the last column, of ``y``, where ``rows_of`` maps
    a block of grid vectors to rows y of ``out`` numbers. Tasks add up their rows; one row of
    the matrix at a time is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((out, out + 1))
        for batch in batches:
            y = rows_of(_matrix(batch.column(0), d))
            total[:, :-1] += y.T @ y
            total[:, -1] += y.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(out), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "row"])

    cells = grid.select("x").mapInArrow(run, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
    summed = cells.groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    matrix = np.zeros((out, out + 1))
    for r in summed:
        matrix[r["i"], r["j"]] = r["v"]
    return matrix


OUTPUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(
    df: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = 32, scale: int = 64, offset: int = 1_000_000
) -> DataFrame:
    """One row per usable input row and component: ``id, component`` (from 1), ``n``,
    ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    Rows with a null or empty vector, or one with null, non-finite or over-large entries
    (64 bits hold the grid) are dropped; of several vector lengths the commonest stays, of
    equals the longest. Repeated rows and null ids are rows like others. Components whose
    eigenvalue is 0 within rounding do not exist: equal vectors, one row or none give an
    empty result. A ``deviation`` beyond 64 bits is null. What goes to the driver and back
    to the workers has the size of the dimensions, not of the rows.
    """
    v = F.col(f"`{vector}`")
    grid = df.select(F.col(f"`{id}`").alias("id"), v.alias("v")).where(usable(F.col("v"), scale))
    grid = grid.select("id", on_grid(F.col("v"), scale, offset).alias("x"))
    kind = df.select(F.col(f"`{id}`").alias(id)).schema.simpleString().removeprefix("struct<").removesuffix(">").split(":", 1)[1]
    schema = f"id {kind}, {OUTPUT}"
    found = moments(grid).collect()
    best = max(((r["n"], r["d"]) for r in found), default=(0, 0))
    held = sorted((r for r in found if r["d"] == best[1]), key=lambda r: r["j"])
    n, d = best
    if n < 2:
        return df.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id)
    centre = Centre(n, [(r["high"] << LOW) + r["low"] for r in held], [r["least"] for r in held], [r["most"] for r in held])
    grid = grid.where(F.size("x") == d)
    covariance = second_moments(grid, d, d, centre.centred)[:, :-1] / n
    covariance = (covariance + covariance.T) / 2
    values, vectors = leading(covariance, min(components, d))
    k = len(values)
    if k == 0:
        return df.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id)
    projection = vectors / np.sqrt(values)
    explained = values / np.trace(covariance)
    # what is projected is centred; the mean that rounding leaves goes too
    checked = second_moments(grid, d, k, lambda x: centre.centred(x) @ projection)
    mean = checked[:, -1] / n
    error = float(np.abs(checked[:, :-1] / n - np.outer(mean, mean) - np.eye(k)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, rows = _matrix(batch.column(1), d), batch.num_rows
            white = centre.centred(x) @ projection
            at = pa.array(np.repeat(np.arange(rows), k))
            deviation = pa.array(centre.deviations(x), pa.int64())
            columns = [
                batch.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                pa.array(np.full(rows * k, n)), deviation.take(at), pa.array(white.ravel()),
                pa.array(np.tile(explained, rows)), pa.array(np.full(rows * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return grid.mapInArrow(run, schema).withColumnRenamed("id", id)
