"""Kernel SVM by stochastic sub-gradient steps (Shalev-Shwartz et al., 2007) on seeded row draws.

Training touches one drawn row per iteration and only rows drawn before it can
have weight, so the whole table is read once, to draw ``iterations`` rows,
which are written as a table.  The recursion runs over that table in blocks of
steps.  For a block one aggregate sums, per step, the pull of all rows kept
before the block, and returns the kernel values between the steps of the block
themselves; which of those are kept then follows from these scalars in order.
A model never has more support vectors than iterations, which bounds what
scoring sends to the executors.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions import vectors as V
from quillmesh.operators.sampling import seeded_draws
from quillmesh.session import materialise

# Steps decided from one aggregate; the driver holds the square of this as numbers.
BLOCK = 64


@dataclass(frozen=True)
class KernelModel:
    """Support vectors (key, y in {-1, 1}, x, alpha) and what scoring needs beside them."""

    keys: tuple
    y: np.ndarray
    x: np.ndarray
    alpha: np.ndarray
    kernel: str
    biased: bool
    scale: float  # regularisation * iterations
    intercept: float = 0.0

    def support_table(self, spark: SparkSession) -> DataFrame:
        rows = [(int(k), float(y), float(a)) for k, y, a in zip(self.keys, self.y, self.alpha)]
        return spark.createDataFrame(rows, "key bigint, y double, alpha double")


def _pulls(drawn: DataFrame, kept: list[int], first: int, last: int, kernel: str) -> DataFrame:
    """(step, other, pull) for the steps first..last of a block.

    ``other`` 0 sums over the rows kept before the block; otherwise it is an
    earlier step of the block.  A row has no pull on itself.
    """
    spark = drawn.sparkSession
    earlier = drawn.join(spark.createDataFrame([(k,) for k in kept], "draw bigint"), "draw", "left_semi")
    others = earlier.filter(F.col("draw") < first).select(
        F.lit(0).cast("bigint").alias("other"), F.lit(first - 1).alias("at"), "key", "y", "x"
    )
    inside = drawn.filter(F.col("draw").between(first, last))
    others = others.unionByName(inside.select(F.col("draw").alias("other"), F.col("draw").alias("at"), "key", "y", "x"))
    steps = inside.select(F.col("draw").alias("step"), F.col("key").alias("own"), F.col("x").alias("point"))
    # at most BLOCK rows on the broadcast side
    pairs = others.join(F.broadcast(steps), (F.col("at") < F.col("step")) & (F.col("key") != F.col("own")))
    value = F.col("y") * V.kernel(kernel)(F.col("x"), F.col("point"))
    return pairs.groupBy("step", "other").agg(F.sum(value).alias("pull"))


def kept_steps(drawn: DataFrame, iterations: int, regularisation: float, kernel: str, block: int = BLOCK) -> list[int]:
    """The steps whose row gains weight, out of a written table (draw, key, y, x)."""
    kept: list[int] = []
    for first in range(1, iterations + 1, block):
        last = min(first + block - 1, iterations)
        signs = {r["draw"]: r["y"] for r in drawn.filter(F.col("draw").between(first, last)).select("draw", "y").collect()}
        pulls: dict[int, dict[int, float]] = {}
        for r in _pulls(drawn, kept, first, last, kernel).collect():
            pulls.setdefault(r["step"], {})[r["other"]] = r["pull"]
        now = {0}
        for step in sorted(signs):
            pull = sum(v for other, v in sorted(pulls.get(step, {}).items()) if other in now)
            if pull * signs[step] / (step * regularisation) < 1:
                now.add(step)
                kept.append(step)
    return kept


def train_kernel_svm(
    df: DataFrame,
    key: str,
    label: str,
    features: str,
    iterations: int,
    regularisation: float,
    kernel: str = "gaussian",
    biased: bool = False,
    seed: int = 42,
    draw: Callable[..., DataFrame] = seeded_draws,
) -> KernelModel:
    """Labels are {0, 1}; ``key`` identifies a row; ``draw`` is one of the seeded draws of ``sampling``."""
    x = V.as_doubles(F.col(features))
    rows = df.select(
        F.col(key).alias("key"),
        (F.col(label) * 2.0 - 1.0).alias("y"),
        (V.append_bias(x) if biased else x).alias("x"),
    )
    chosen = draw(rows, "key", ["y", "x"], iterations, seed).select(F.col("draw").cast("bigint").alias("draw"), "key", "y", "x")
    drawn = materialise(chosen, "drawn")
    kept = kept_steps(drawn, iterations, regularisation, kernel)
    weighted = drawn.join(drawn.sparkSession.createDataFrame([(k,) for k in kept], "draw bigint"), "draw", "left_semi")
    supports = weighted.groupBy("key").agg(
        F.first("y").alias("y"), F.first("x").alias("x"), F.count(F.lit(1)).cast("double").alias("alpha")
    )
    found = supports.orderBy("key").collect()  # at most one per iteration
    return KernelModel(
        keys=tuple(r["key"] for r in found),
        y=np.array([r["y"] for r in found]),
        x=np.array([r["x"] for r in found]),
        alpha=np.array([r["alpha"] for r in found]),
        kernel=kernel,
        biased=biased,
        scale=regularisation * iterations,
    )


def _gram(kernel: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    inner = a @ b.T
    if kernel == "gaussian":
        squares = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * inner
        return np.exp(-0.5 * np.maximum(squares, 0))
    if kernel == "polynomial":
        return (inner + 1) ** 2
    return inner


def kernel_margin(model: KernelModel, features: Column) -> Column:
    """Raw margin of every row against all support vectors, one matrix product per Arrow batch."""
    shared = _broadcast(model)

    @F.pandas_udf("double")
    def margin(batch: pd.Series) -> pd.Series:
        weights, supports, kernel, biased, scale, intercept = shared.value
        if len(batch) == 0 or len(weights) == 0:
            return pd.Series(np.full(len(batch), intercept))
        points = np.stack(batch.to_numpy())
        if biased:
            points = np.hstack([points, np.ones((len(points), 1))])
        return pd.Series(_gram(kernel, points, supports) @ weights / scale + intercept)

    return margin(V.as_doubles(features))


def _broadcast(model: KernelModel):
    spark = SparkSession.getActiveSession()
    content = (model.alpha * model.y, model.x, model.kernel, model.biased, model.scale, model.intercept)
    return spark.sparkContext.broadcast(content)


def score_kernel_svm(df: DataFrame, model: KernelModel, features: str, threshold: float | None = 0.0) -> DataFrame:
    """Add ``margin`` and, unless the threshold is cleared, the 0/1 ``prediction``."""
    scored = df.withColumn("margin", kernel_margin(model, F.col(features)))
    if threshold is None:
        return scored
    return scored.withColumn("prediction", (F.col("margin") > threshold).cast("double"))
