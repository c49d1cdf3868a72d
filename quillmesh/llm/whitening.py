"""Embedding whitening: blockwise QR, bidiagonal form, dqds and twisted factorisations.

Two passes fit the model.  The first sums the integer vectors exactly.  The
second reduces centred rows to a triangle R: every task folds its batches into
one R by QR, and the triangles are folded again in groups that shrink by a
fixed factor, so no task or driver ever holds more than a bounded number of
them.  R has the singular values and right vectors of all centred rows.

The rest works on R alone, whose size is the dimension.  Householder
reflections make it bidiagonal.  dqds (the shifted quotient-difference
algorithm) finds all singular values to high relative accuracy, small ones
included.  For each wanted one a twisted factorisation of the bidiagonal's
square gives the vector: the forward and the backward factorisation are joined
where the twist element is least.  Vectors of nearly equal values are made
orthogonal among themselves.  The reflections carry the vectors back.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import fresh_name, map_batches

EPS = float(np.finfo(float).eps)
FAN_IN = (4096, 64, 1)  # groups of triangles, level by level
LIMIT = float(1 << 40)  # entries of the integer grid stay within this
CLOSE = 1e-3  # values closer than this, relatively, are made orthogonal


@dataclass(frozen=True)
class Whitening:
    """``n`` rows with per-dimension sums ``total``; row k of ``directions`` is component k+1, of eigenvalue ``values[k]``."""

    n: int
    total: list[int]
    values: list[float]
    directions: list[list[float]]
    trace: float

    @property
    def dimension(self) -> int:
        return len(self.total)


# ---------------------------------------------------------------- tables


def grid(df: DataFrame, column: str, scale: int, offset: int, out: str = "x") -> DataFrame:
    """Rows with a whole finite vector; ``out`` holds floor(scale * entry) + offset as long.

    Left out: null and empty vectors and such with null or non-finite entries.
    Entries whose grid value exceeds 2^40 are set to it, so that sums stay exact.
    """
    entry = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    whole = F.col(column).isNotNull() & (F.size(column) > 0) & F.forall(column, entry)
    cell = lambda c: F.greatest(F.least(F.floor(c.cast("double") * scale), F.lit(LIMIT)), F.lit(-LIMIT))
    bounded = lambda c: cell(F.greatest(F.least(c.cast("double"), F.lit(LIMIT)), F.lit(-LIMIT))).cast("long") + offset
    return df.filter(F.coalesce(whole, F.lit(False))).withColumn(out, F.transform(column, bounded))


def _matrix(lists: pa.ListArray, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of ``dimension`` entries as a matrix, and which rows they are."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    fits = np.diff(offsets) == dimension
    values = lists.values.to_numpy(zero_copy_only=False)
    return values[offsets[:-1][fits][:, None] + np.arange(dimension)], fits


def _sums(vectors: DataFrame, x: str) -> tuple[int, list[int]]:
    """Number and per-dimension sums of the vectors of the most frequent dimension (the larger of equals)."""

    def rows(batch: pa.RecordBatch):
        lists = batch.column(0)
        sizes = np.diff(lists.offsets.to_numpy())
        parts = [(int(d), *_matrix(lists, int(d))) for d in np.unique(sizes)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([d for d, _, _ in parts], pa.int64()),
                pa.array([len(m) for _, m, _ in parts], pa.int64()),
                pa.array([m.sum(axis=0).tolist() for _, m, _ in parts], pa.list_(pa.int64())),
            ],
            names=["size", "n", "sums"],
        )

    partial = map_batches(vectors.select(x), "size bigint, n bigint, sums array<bigint>", rows)
    cells = partial.select("size", "n", F.posexplode("sums").alias("place", "s"))
    by_cell = cells.groupBy("size", "place").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    by_size = by_cell.groupBy("size").agg(
        F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("place", "s"))).alias("cells")
    )
    first = by_size.orderBy(F.col("n").desc(), F.col("size").desc()).first()
    return (0, []) if first is None else (first["n"], [c["s"] for c in first["cells"]])


def _fold(blocks, dimension: int) -> np.ndarray:
    """The triangle of all rows in ``blocks``; one block and one triangle are held at a time."""
    held = np.zeros((dimension, dimension))
    for block in blocks:
        r = np.linalg.qr(np.vstack([held, block]), mode="r")
        held = np.zeros((dimension, dimension))
        held[: len(r)] = r
    return held


def _triangle(vectors: DataFrame, x: str, n: int, total: list[int]) -> np.ndarray:
    d = len(total)
    sums = np.array(total, np.int64)

    def shrink(batches):
        seen = False

        def blocks():
            nonlocal seen
            for batch in batches:
                matrix, _ = _matrix(batch.column(0), d)
                seen = seen or len(matrix) > 0
                for k in range(0, len(matrix), 4096):
                    yield (n * matrix[k : k + 4096] - sums) / n
        r = _fold(blocks(), d)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], names=["r"])

    def join(key, frame):
        import pandas as pd

        blocks = (np.frombuffer(r).reshape(d, d) for r in frame["r"])
        return pd.DataFrame({"part": [key[0]], "r": [_fold(blocks, d).tobytes()]})

    level = vectors.select(x).mapInArrow(shrink, "r binary").select(F.spark_partition_id().alias("part"), "r")
    for groups in FAN_IN:
        level = level.select((F.col("part") % groups).alias("part"), "r").groupBy("part").applyInPandas(join, "part int, r binary")
    last = level.first()
    return np.zeros((d, d)) if last is None else np.frombuffer(last["r"]).reshape(d, d).copy()


# ---------------------------------------------------------------- the small problem


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal a, superdiagonal b and right reflections V with r = U B V' (Householder)."""
    m = r.copy()
    d = len(m)
    right = np.eye(d)

    def reflector(x: np.ndarray) -> np.ndarray | None:
        largest = np.abs(x).max()
        if largest < 1e-290 or not np.any(x[1:]):
            return None
        v = x / largest
        v[0] += math.copysign(np.linalg.norm(v), v[0])
        return v / np.linalg.norm(v)

    for k in range(d):
        if (v := reflector(m[k:, k])) is not None:
            m[k:, k:] -= 2 * np.outer(v, v @ m[k:, k:])
        if k + 2 < d and (v := reflector(m[k, k + 1 :])) is not None:
            m[k:, k + 1 :] -= 2 * np.outer(m[k:, k + 1 :] @ v, v)
            right[:, k + 1 :] -= 2 * np.outer(right[:, k + 1 :] @ v, v)
    return np.diag(m).copy(), np.diag(m, 1).copy(), right


def _dqds(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float, float]:
    """One transform; also the least d (negative if the shift was too large) and the sum of 1/d."""
    n = len(q)
    new_q, new_e = [0.0] * n, [0.0] * (n - 1)
    d = q[0] - shift
    least, inverse = d, (1 / d if d > 0 else math.inf)
    for i in range(n - 1):
        new_q[i] = d + e[i]
        t = q[i + 1] / new_q[i] if new_q[i] else 0.0
        new_e[i] = e[i] * t
        d = d * t - shift
        least = min(least, d)
        inverse += 1 / d if d > 0 else math.inf
    new_q[-1] = d
    return new_q, new_e, least, inverse


def squared_singular_values(a: np.ndarray, b: np.ndarray) -> list[float]:
    """Squares of the singular values of a bidiagonal matrix, falling, by dqds.

    A transform without shift tells the sum of 1/d, the trace of the inverse;
    its reciprocal never exceeds the least value and is a safe shift.
    """
    found: list[float] = []
    waiting = [((a * a).tolist(), (b * b).tolist(), 0.0)]
    tiny = (100 * EPS) ** 2
    while waiting:
        q, e, moved = waiting.pop()
        shift = 0.0
        while q:
            n = len(q)
            cut = next((k for k in range(n - 2, -1, -1) if e[k] <= tiny * (moved + min(q[k], q[k + 1])) or e[k] == 0), None)
            if n == 1 or cut == n - 2:
                found.append(q.pop() + moved)
                if e:
                    e.pop()
                shift = 0.0
                continue
            if cut is not None:
                waiting.append((q[: cut + 1], e[:cut], moved))
                q, e, shift = q[cut + 1 :], e[cut + 1 :], 0.0
                continue
            new_q, new_e, least, inverse = _dqds(q, e, shift)
            if least < 0 and shift:
                shift = 0.0  # rounding made the bound too large
                continue
            moved += shift
            q, e = new_q, new_e
            # the bound holds for the matrix before the transform; after it the value is what is left
            bound = 1 / inverse if inverse and math.isfinite(inverse) else 0.0
            shift = bound * (1 - 4 * n * EPS) if bound > EPS * moved else 0.0
    return sorted(found, reverse=True)


def _twisted(q: np.ndarray, l: np.ndarray, value: float) -> tuple[list[float], list[float], np.ndarray]:  # noqa: E741
    """Forward and backward multipliers of LDL' - value and the twist elements."""
    n = len(q)
    tiny = EPS * EPS * max(float(np.max(np.abs(q))), 1e-300)
    forward, backward = [0.0] * (n - 1), [0.0] * (n - 1)
    s, p = [0.0] * n, [0.0] * n
    s[0] = -value
    for i in range(n - 1):
        d = s[i] + q[i] or tiny
        forward[i] = q[i] * l[i] / d
        s[i + 1] = forward[i] * l[i] * s[i] - value
    p[-1] = q[-1] - value
    for i in range(n - 2, -1, -1):
        p[i + 1] = p[i + 1] or tiny
        d = q[i] * l[i] * l[i] + p[i + 1] or tiny
        backward[i] = l[i] * q[i] / d
        p[i] = p[i + 1] * (q[i] / d) - value
    return forward, backward, np.array(s) + np.array(p) + value


def right_vectors(a: np.ndarray, b: np.ndarray, values: list[float]) -> np.ndarray:
    """Unit right singular vectors of the bidiagonal for squared values, one per row."""
    n = len(a)
    scale = max(float(np.max(np.abs(a), initial=0)), float(np.max(np.abs(b), initial=0)), 1e-300)
    diagonal = np.where(np.abs(a) < EPS * EPS * scale, EPS * EPS * scale, a)
    q, l = diagonal**2, b / diagonal[:-1]  # noqa: E741
    rows: list[np.ndarray] = []
    for k, value in enumerate(values):
        near = [rows[j] for j in range(k) if values[j] - value <= CLOSE * values[j]]
        forward, backward, twist = _twisted(q, l, value)
        best = None
        for at in np.argsort(np.abs(twist), kind="stable").tolist():
            z = np.zeros(n)
            z[at] = 1
            for i in range(at - 1, -1, -1):
                z[i] = -forward[i] * z[i + 1]
            for i in range(at, n - 1):
                z[i + 1] = -backward[i] * z[i]
            if not np.isfinite(z).all():
                continue
            z /= np.linalg.norm(z)
            left = z
            for _ in range(2):
                for other in near:
                    left = left - (other @ left) * other
            size = np.linalg.norm(left)
            if best is None or size > best[0]:
                best = (size, left)
            if size > 0.1:
                break
        rows.append(best[1] / best[0])
    return np.array(rows).reshape(len(values), n)


def solve(r: np.ndarray, n: int, components: int) -> tuple[list[float], list[list[float]], float]:
    """Eigenvalues and directions of r'r/n for the first components, and the trace."""
    d = len(r)
    scale = float(np.max(np.abs(r), initial=0))
    if not scale:
        return [0.0] * min(components, d), np.eye(d)[:components].tolist(), 0.0
    a, b, right = bidiagonal(r / scale)
    squares = squared_singular_values(a, b)[: min(components, d)]
    vectors = right_vectors(a, b, squares) @ right.T
    for v in vectors:  # the entry of the largest size is positive
        v *= math.copysign(1, v[np.argmax(np.abs(v))])
    floor = (EPS * d) ** 2 * squares[0]
    values = [s * scale * scale / n if s > floor else 0.0 for s in squares]
    return values, vectors.tolist(), float((r * r).sum() / n)


def fit(vectors: DataFrame, x: str = "x", components: int = 8) -> Whitening:
    """Fit on all vectors of the most frequent dimension; an empty table gives a model of dimension 0."""
    n, total = _sums(vectors, x)
    if not n:
        return Whitening(0, [], [], [], 0.0)
    return Whitening(n, total, *solve(_triangle(vectors, x, n, total), n, components))


# ---------------------------------------------------------------- application


def _projected(matrix: np.ndarray, model: Whitening) -> np.ndarray:
    """Whitened coordinates; null (nan) for a component without variance."""
    centred = (model.n * matrix - np.array(model.total, np.int64)) / model.n
    deviation = np.sqrt(np.array(model.values))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(deviation > 0, centred @ np.array(model.directions).T / deviation, np.nan)


def _deviations(matrix: np.ndarray, model: Whitening) -> list[int | None]:
    """Exact sums of (n x - S)^2; null beyond a long."""
    moved = model.n * matrix - np.array(model.total, np.int64)
    largest = int(np.abs(moved).max(initial=0))
    if largest * largest * max(1, model.dimension) < 1 << 63:
        return (moved * moved).sum(axis=1).tolist()
    exact = [sum(v * v for v in row) for row in moved.tolist()]
    return [v if v < 1 << 63 else None for v in exact]


def identity_error(vectors: DataFrame, model: Whitening, x: str = "x") -> float | None:
    """Largest entry of the whitened rows' covariance minus the identity, over components that vary."""
    some = [k for k, v in enumerate(model.values) if v > 0]
    if not some:
        return None

    def rows(batch: pa.RecordBatch):
        matrix, _ = _matrix(batch.column(0), model.dimension)
        w = _projected(matrix, model)[:, some]
        cells = np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([cells.tolist()], pa.list_(pa.float64()))], names=["cells"])

    partial = map_batches(vectors.select(x), "cells array<double>", rows)
    sums = partial.select(F.posexplode("cells").alias("place", "s")).groupBy("place").agg(F.sum("s").alias("s"))
    cells = {r["place"]: r["s"] for r in sums.collect()}  # k + k^2 numbers for k components
    k = len(some)
    mean = np.array([cells[i] for i in range(k)]) / model.n
    second = np.array([cells[k + i] for i in range(k * k)]).reshape(k, k) / model.n
    return float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, model: Whitening, keep: tuple[str, ...], x: str = "x") -> DataFrame:
    """Per row and component: the columns ``keep``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    Components are numbered from 1 by falling eigenvalue.  One without variance
    has a null ``whitened``.  Rows of another dimension than the model's have
    no result; rows that repeat stay.
    """
    row = fresh_name(vectors, "__keep")
    source = vectors.filter(F.size(x) == model.dimension).select(F.struct(*keep).alias(row), x)
    error = identity_error(vectors, model, x)

    def rows(batch: pa.RecordBatch):
        matrix, _ = _matrix(batch.column(1), model.dimension)
        whitened = _projected(matrix, model)
        lists = pa.array(whitened.tolist(), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(_deviations(matrix, model), pa.int64()), lists], names=[row, "deviation", "w"]
        )

    fields = source.schema[row].dataType.simpleString()
    wide = map_batches(source, f"{row} {fields}, deviation bigint, w array<double>", rows)
    long = wide.select(f"{row}.*", "deviation", F.posexplode("w").alias("component", "whitened"))
    shares = [v / model.trace if model.trace else 0.0 for v in model.values]
    explained = F.element_at(F.array(*map(F.lit, shares)).cast("array<double>"), F.col("component")) if shares else F.lit(None)
    return (
        long.withColumn("component", F.col("component") + 1)
        .withColumn("whitened", F.when(~F.isnan("whitened"), F.col("whitened")))
        .select(
            *keep,
            "component",
            F.lit(model.n).cast("long").alias("n"),
            "deviation",
            "whitened",
            explained.cast("double").alias("explained"),
            F.lit(error).cast("double").alias("identity_error"),
        )
    )
