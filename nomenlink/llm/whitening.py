"""Whitening of embeddings with a bidiagonal qd solver.

Centred rows are reduced block by block to one triangular factor R, whose
squares are the covariance; no product of rows is ever formed. Householder
reflections make R bidiagonal, the shifted qd algorithm (dqds) gives its
singular values to high relative accuracy, and a factorisation twisted where
its pivot is least gives each direction. R has as many rows as a vector has
entries, whatever the number of vectors, and alone comes to the driver.

Means are subtracted in whole numbers: n * x - S is exact, and only then is it
divided by n.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nomenlink.llm.scratch import Scratch

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
# A direction this much weaker than the strongest cannot be told from rounding.
LEAST_RATIO = 1e-11
_EPS = np.finfo(float).eps
_LARGE = 1 << 62
# Numbers of a block of rows: some megabytes.
_BLOCK_CELLS = 1 << 18
# Triangular factors that one task reduces to one.
_FACTORS = 32


# --- the solver, on one small matrix ---------------------------------------------------------------------------------


def _reflector(x: np.ndarray) -> np.ndarray | None:
    """Unit vector of the reflection that takes ``x`` to its first axis; None if it is there."""
    if not np.any(x[1:]):
        return None
    v = x / np.abs(x).max()
    v[0] += math.copysign(np.linalg.norm(v), v[0])
    return v / np.linalg.norm(v)


def bidiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal and superdiagonal of U'AV, and V, by reflections from left and right."""
    a = matrix.copy()
    size = len(a)
    right = np.eye(size)
    for k in range(size):
        v = _reflector(a[k:, k])
        if v is not None:
            a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        if k + 2 < size:
            v = _reflector(a[k, k + 1 :])
            if v is not None:
                a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ v, v)
                right[:, k + 1 :] -= 2 * np.outer(right[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def _transform(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float]]:
    """One step of dqds: the new arrays, and the differences d, all positive if the shift is low enough."""
    new_q, new_e, d = [], [], q[0] - shift
    seen = [d]
    for k in range(len(e)):
        if d <= 0.0:
            return new_q, new_e, [*seen, d]
        top = d + e[k]
        ratio = q[k + 1] / top
        new_q.append(top)
        new_e.append(e[k] * ratio)
        d = d * ratio - shift
        seen.append(d)
    new_q.append(d)
    return new_q, new_e, seen


def squared_values(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squares of the singular values of a bidiagonal matrix, falling, by dqds.

    After a step without shift, one over the sum of 1 / d bounds the least
    square from below; shifted by that, it converges quadratically.
    """
    scale = max(np.abs(diagonal).max(initial=0.0), np.abs(above).max(initial=0.0))
    if scale == 0.0:
        return np.zeros(len(diagonal))
    tiny = 1e-60
    blocks = [([max(float(x) ** 2, tiny) for x in diagonal / scale], [float(x) ** 2 for x in above / scale], 0.0, 0.0)]
    found = []
    negligible = _EPS * _EPS
    while blocks:
        q, e, moved, rest = blocks.pop()
        if len(q) > 1 and q[0] < q[-1]:  # small values leave at the lower end soonest
            q, e = q[::-1], e[::-1]
        while True:
            while len(q) > 1 and e[-1] <= negligible * (moved + q[-1]):
                found.append(moved + (q.pop() + rest))
                e.pop()
            if len(q) == 1:
                found.append(moved + (q[0] + rest))
                break
            cut = next((k for k in range(len(e)) if e[k] <= negligible * (moved + min(q[k], q[k + 1]))), None)
            if cut is not None:
                blocks += [(q[: cut + 1], e[:cut], moved, rest), (q[cut + 1 :], e[cut + 1 :], moved, rest)]
                break
            q, e, d = _transform(q, e, 0.0)
            q = [max(x, tiny * tiny) for x in q]
            shift = 1.0 / sum(1.0 / max(x, tiny * tiny) for x in d)
            while shift > 0.0:
                new_q, new_e, d = _transform(q, e, shift)
                if len(new_q) == len(q) and min(d) >= 0.0:
                    q, e = [max(x, tiny * tiny) for x in new_q], new_e
                    total = moved + (shift + rest)  # what rounding loses is carried on
                    rest = (shift + rest) - (total - moved)
                    moved = total
                    break
                shift = shift * 0.75 if shift > negligible * (moved + min(q)) else 0.0
    return np.sort(np.array(found))[::-1] * scale**2


def _guarded(x: np.ndarray, least: float) -> np.ndarray:
    return np.where(np.abs(x) < least, np.copysign(least, x), x)


def twisted_vectors(diagonal: np.ndarray, above: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit right singular vectors, one column per square in ``values``, by twisted factorisations.

    For each, a factorisation from above and one from below meet at the row
    whose pivot is least; the vector follows by products alone. Neighbours too
    close to be told apart are replaced by a basis of the space they span.
    """
    size, number = len(diagonal), len(values)
    least = np.finfo(float).tiny / _EPS
    pivots = np.maximum(diagonal**2, least)
    lower = diagonal[:-1] * above / pivots[:-1]
    from_top, from_below = np.empty((size, number)), np.empty((size, number))
    up, down = np.empty((max(size - 1, 0), number)), np.empty((max(size - 1, 0), number))
    from_top[0] = -values
    from_below[-1] = pivots[-1] - values
    with np.errstate(over="ignore", invalid="ignore"):
        for k in range(size - 1):
            up[k] = pivots[k] * lower[k] / _guarded(from_top[k] + pivots[k], least)
            from_top[k + 1] = up[k] * lower[k] * from_top[k] - values
        for k in range(size - 2, -1, -1):
            ratio = pivots[k] / _guarded(pivots[k] * lower[k] ** 2 + from_below[k + 1], least)
            down[k] = lower[k] * ratio
            from_below[k] = from_below[k + 1] * ratio - values
        twist = np.abs(from_top + from_below + values)
        at = np.argmin(np.where(np.isnan(twist), np.inf, twist), axis=0)
        vectors = np.zeros((size, number))
        for j, r in enumerate(at):
            vectors[r, j] = 1.0
            for k in range(r - 1, -1, -1):
                vectors[k, j] = -up[k, j] * vectors[k + 1, j]
            for k in range(r, size - 1):
                vectors[k + 1, j] = -down[k, j] * vectors[k, j]
        vectors = np.where(np.isfinite(vectors), vectors, 0.0)
        vectors /= np.maximum(np.linalg.norm(vectors, axis=0), least)
    return _told_apart(diagonal, above, values, vectors)


def _told_apart(diagonal: np.ndarray, above: np.ndarray, values: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """``vectors`` with those that are not orthogonal, or no solutions, found anew together."""
    square = np.diag(diagonal**2)
    square[1:, 1:] += np.diag(above**2)
    square += np.diag(diagonal[:-1] * above, 1) + np.diag(diagonal[:-1] * above, -1)
    norm = max(values.max(initial=0.0), np.finfo(float).tiny)
    overlap = np.abs(vectors.T @ vectors - np.eye(len(values))) > 1e-11
    poor = np.linalg.norm(square @ vectors - vectors * values, axis=0) > 1e-11 * norm
    first = 0
    while first < len(values):
        last = first + 1
        while last < len(values) and (overlap[first:last, last:].any()):
            last = first + 1 + int(np.flatnonzero(overlap[first:last, last:].any(axis=0)).max()) + (last - first)
        if last - first > 1 or poor[first]:
            others = np.delete(vectors, slice(first, last), axis=1)
            found = np.random.default_rng(first).standard_normal((len(square), last - first))
            for _ in range(4):
                for j in range(last - first):
                    near = values[first + j] + 4 * _EPS * norm * (1 + j)
                    found[:, j] = np.linalg.solve(square - near * np.eye(len(square)), found[:, j])
                    for _ in range(2):
                        found[:, j] -= found[:, :j] @ (found[:, :j].T @ found[:, j])
                        found[:, j] /= np.linalg.norm(found[:, j])
            found -= others @ (others.T @ found)
            vectors[:, first:last] = np.linalg.qr(found)[0]
        first = last
    return vectors


def directions(factor: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of R: the largest squares of singular values, their right vectors, and all squares.

    Directions weaker than ``LEAST_RATIO`` of the strongest are left out.
    """
    width = factor.shape[1]
    square = np.vstack([factor, np.zeros((max(0, width - len(factor)), width))])  # fewer rows than entries
    diagonal, above, right = bidiagonal(square)
    every = squared_values(diagonal, above)
    strong = every[every > LEAST_RATIO**2 * every.max(initial=0.0)]
    vectors = right @ twisted_vectors(diagonal, above, strong) if len(strong) else np.zeros((width, 0))
    vectors = vectors[:, :most]
    if vectors.shape[1]:
        top = vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]
        vectors = vectors * np.where(top < 0, -1.0, 1.0)
    return strong[:most], vectors, every


# --- blocks of rows, in tasks ----------------------------------------------------------------------------------------


def _numbers(column: pa.Array, width: int) -> np.ndarray:
    """Whole numbers x of a list column without nulls, a row per vector."""
    values = np.asarray(column.flatten()).astype(np.float64).reshape(-1, width)
    return np.floor(SCALE * values).astype(np.int64) + OFFSET


def _cut(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    rows = max(1, _BLOCK_CELLS // width)
    for batch in batches:
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)


def _differences(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exactly: 64-bit numbers while they suffice, Python's beyond."""
    if n * int(np.abs(x).max(initial=0)) < _LARGE and max(map(abs, sums)) < _LARGE:
        return n * x - np.array(sums, dtype=np.int64)
    return n * x.astype(object) - np.array(sums, dtype=object)


def _totals(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    n, sums = 0, [0] * width
    for batch in _cut(batches, width):
        x = _numbers(batch.column(0), width)
        exact = x if len(x) * int(np.abs(x).max(initial=0)) < _LARGE else x.astype(object)
        sums = [a + int(b) for a, b in zip(sums, exact.sum(axis=0))]
        n += len(x)
    if n:
        names = ["entry", "n", "total"]
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([n] * width), pa.array(map(str, sums))], names=names)


def _triangle(blocks: Iterator[np.ndarray], width: int) -> Iterator[pa.RecordBatch]:
    """Rows of the triangular factor of all blocks, one QR after the other."""
    factor = np.zeros((0, width))
    for block in blocks:
        factor = np.linalg.qr(np.vstack([factor, block]), mode="r")
    if len(factor):
        yield pa.RecordBatch.from_arrays([pa.array(list(factor), pa.list_(pa.float64()))], names=["row"])


def _centred(batches: Iterator[pa.RecordBatch], width: int, n: int, sums: list[int]) -> Iterator[np.ndarray]:
    for batch in _cut(batches, width):
        yield (_differences(_numbers(batch.column("vector"), width), n, sums) / n).astype(np.float64)


def _moments(batches: Iterator[pa.RecordBatch], width: int, n: int, sums: list[int], turn: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Number, sums and centred products of a task's whitened rows."""
    seen, mean, products = 0, np.zeros(turn.shape[1]), np.zeros((turn.shape[1],) * 2)
    for rows in _centred(batches, width, n, sums):
        white = rows @ turn
        here = white.mean(axis=0)
        off, step = white - here, here - mean
        products += off.T @ off + np.outer(step, step) * (seen * len(white) / (seen + len(white)))
        mean += step * len(white) / (seen + len(white))
        seen += len(white)
    if seen:
        cells = [pa.array(range(products.size), pa.int32()), pa.array([seen] * products.size)]
        means = [pa.array(np.repeat(mean, len(mean))), pa.array(np.tile(mean, len(mean)))]
        yield pa.RecordBatch.from_arrays([*cells, *means, pa.array(products.ravel())], names=["cell", "n", "a", "b", "product"])


def _whitened(
    batches: Iterator[pa.RecordBatch], width: int, n: int, sums: list[int], turn: np.ndarray, explained: np.ndarray, error: float
) -> Iterator[pa.RecordBatch]:
    number = turn.shape[1]
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for batch in _cut(batches, max(width, number)):
        apart = _differences(_numbers(batch.column("vector"), width), n, sums)
        if apart.dtype != object and int(np.abs(apart).max()) ** 2 * width >= _LARGE:
            apart = apart.astype(object)
        deviation = [int(v) if v < 2 * _LARGE else None for v in (apart * apart).sum(axis=1)]
        white = (apart / n).astype(np.float64) @ turn
        rows = len(white)
        again = pa.array(np.repeat(np.arange(rows), number))
        columns = [
            batch.column("vec_id").take(again),
            pa.array(np.tile(np.arange(1, number + 1, dtype=np.int32), rows)),
            pa.array(np.full(rows * number, n)),
            pa.array(deviation, pa.int64()).take(again),
            pa.array(white.ravel()),
            pa.array(np.tile(explained, rows)),
            pa.array(np.full(rows * number, error)),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=names)


# --- the operator ----------------------------------------------------------------------------------------------------


def _usable(vector: Column) -> Column:
    """No null, and every entry a number whose x is a 64-bit one."""
    fits = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < F.lit(2.0**56), F.lit(False)))
    return vector.isNotNull() & (F.size(vector) > 0) & fits


def _reduced(rows: DataFrame, width: int, scratch: Scratch) -> np.ndarray:
    """The triangular factor of rows of factors, a few dozen to a task each time."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = (np.asarray(b.column(0).flatten()).reshape(-1, width) for b in _cut(batches, width))
        return _triangle(blocks, width)

    turn = 0
    while True:
        tasks = -(-rows.count() // (_FACTORS * width))
        rows = rows.repartition(max(1, tasks)).mapInArrow(reduce, "row array<double>")
        if tasks <= 1:
            return np.array([row["row"] for row in rows.collect()]).reshape(-1, width)  # at most ``width`` rows
        turn += 1
        rows = scratch.keep(rows, f"factors-{turn}")


def whiten(vectors: DataFrame, column: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """Whitened entries of every vector, a row for each of the ``most`` strongest components.

    Reads ``vec_id`` and ``column``, a list of numbers; other columns are
    ignored, whatever their names. An entry c counts as floor(64 * c) +
    1000000. Components are the unit eigenvectors of the covariance (divisor
    n), numbered from 1 by falling eigenvalue e; their sign makes the largest
    entry positive. Returns ``vec_id``, ``component``, ``n``, ``deviation``
    (sum of squares of n * x - S, exact; null if it is no 64-bit number),
    ``whitened`` (x - S / n along the component, over the root of e),
    ``explained`` (e over the trace) and ``identity_error`` (largest deviation
    of the whitened covariance from the identity, measured on the rows).

    Vectors that are null, empty, or hold a null, a number that is not finite
    or one from 2**56 on are dropped, as are those that have not the commonest
    length (the greater of equals). Repeated rows count each, a null id is an
    id. Components without variance (singular values below 1e-11 of the
    largest) are left out, so equal vectors, a single one or none give no row.
    Among equal eigenvalues any orthonormal directions are taken.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "whitening")
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = vectors.select("vec_id", F.col(f"`{column}`").alias("vector")).where(_usable(F.col("vector")))
    lengths = rows.groupBy(F.size("vector").alias("width")).count()
    common = lengths.orderBy(F.desc("count"), F.desc("width")).first()
    if common is None:
        return spark.createDataFrame([], schema)
    width = common["width"]
    rows = rows.where(F.size("vector") == width)

    sums = rows.select("vector").mapInArrow(lambda b: _totals(b, width), "entry int, n long, total string")
    sums = sums.groupBy("entry").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    facts = sorted(sums.collect())  # one row per entry
    n, totals = facts[0]["n"], [int(row["total"]) for row in facts]

    factors = rows.mapInArrow(lambda b: _triangle(_centred(b, width, n, totals), width), "row array<double>")
    squares, turn, every = directions(_reduced(scratch.keep(factors, "factors"), width, scratch), most)
    if not len(squares):
        return spark.createDataFrame([], schema)
    turn = turn / np.sqrt(squares / n)
    explained = squares / every.sum()

    parts = rows.mapInArrow(
        lambda b: _moments(b, width, n, totals, turn), "cell int, n long, a double, b double, product double"
    )
    weight = F.col("n")
    cells = parts.groupBy("cell").agg(
        F.sum("product").alias("inside"),
        F.sum(weight * F.col("a") * F.col("b")).alias("between"),
        F.sum(weight * F.col("a")).alias("a"),
        F.sum(weight * F.col("b")).alias("b"),
    )
    covariance = (F.col("inside") + F.col("between") - F.col("a") * F.col("b") / n) / n
    number = len(squares)
    unit = (F.col("cell") % (number + 1) == 0).cast("double")
    error = float(cells.agg(F.max(F.abs(covariance - unit))).first()[0])
    return rows.mapInArrow(lambda b: _whitened(b, width, n, totals, turn, explained, error), schema)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened entries of all embeddings along the 32 strongest components."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
