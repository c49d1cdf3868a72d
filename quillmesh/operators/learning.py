"""Learning operators: full-batch linear SVM, Lloyd's k-means and helpers around pyspark.ml.

The loops keep one small vector on the driver (as many numbers as there are
features, times the clusters) and run one distributed aggregate per round.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions import vectors as V
from quillmesh.session import materialise, scratch_path

BLOCK_BYTES = 1 << 18


def _literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def mean_vectors(df: DataFrame, key: str | Column, features: str) -> DataFrame:
    """(key, mean) with the mean vector of every group, in order of the key."""
    grouped = df.groupBy(key).agg(Summarizer.mean(array_to_vector(features)).alias("__mean"))
    name = grouped.columns[0]
    return grouped.select(name, vector_to_array("__mean").alias("mean")).orderBy(name)


def nearest_centre(features: str | Column, centres: Sequence[Sequence[float]]) -> Column:
    """struct(distance: squared, cluster) of the nearest centre, ties to the lower number."""
    x = F.col(features) if isinstance(features, str) else features
    options = [
        F.struct(V.squared_distance(x, _literal(c)).alias("distance"), F.lit(i).alias("cluster"))
        for i, c in enumerate(centres)
    ]
    return options[0] if len(options) == 1 else F.least(*options)


def clustering_cost(df: DataFrame, features: str, centres: Sequence[Sequence[float]]) -> DataFrame:
    return df.agg(F.sum(nearest_centre(features, centres)["distance"]).alias("cost"))


def lloyd(
    df: DataFrame, features: str, centres: Sequence[Sequence[float]], rounds: int
) -> list[list[float]]:
    """Centres after ``rounds`` of assign-and-average; a centre nobody chose stays."""
    current = [list(map(float, c)) for c in centres]
    for _ in range(rounds):
        assigned = df.select(nearest_centre(features, current)["cluster"].alias("cluster"), features)
        moved = {r["cluster"]: r["mean"] for r in mean_vectors(assigned, "cluster", features).collect()}
        current = [moved.get(i, c) for i, c in enumerate(current)]
    return current


def linear_margin(features: Sequence[str], weights: Sequence[float]) -> Column:
    margin = F.lit(0.0)
    for name, w in zip(features, weights):
        margin = margin + F.col(name) * F.lit(float(w))
    return margin


def matrix_blocks(df: DataFrame) -> DataFrame:
    """(cells binary): the rows of ``df``, doubles all, written once as matrices of at most ``BLOCK_BYTES``, nulls as NaN.

    A loop that reads the rows in every step then copies bytes instead of
    turning each cell from Parquet to a row and from a row to Arrow.
    """
    most = max(1, BLOCK_BYTES // (8 * len(df.columns)))

    def packed(batches):
        for part in batches:
            cells = np.column_stack([c.to_numpy(zero_copy_only=False) for c in part.columns]).astype(float)
            blocks = [cells[at : at + most].tobytes() for at in range(0, len(cells), most)]
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.binary())], names=["cells"])

    spark, path = df.sparkSession, scratch_path(df.sparkSession, "blocks")
    # small row groups: the reader holds the binaries of a whole group
    options = {"parquet.block.size": str(16 << 20), "parquet.enable.dictionary": "false", "compression": "snappy"}
    df.mapInArrow(packed, "cells binary").write.options(**options).parquet(path)
    return spark.read.schema("cells binary").parquet(path)


def svm_weights(
    df: DataFrame,
    label: str,
    features: Sequence[str],
    iterations: int,
    step: float = 1.0,
    regularisation: float = 0.0,
    penalty: str = "l2",
) -> list[float]:
    """Weights of a linear SVM by full-batch sub-gradient steps of size step / sqrt(t).

    Labels are {0, 1}; there is no intercept.  ``penalty`` is "l2" (shrink) or
    "l1" (soft threshold after the step).
    """
    weights, k = [0.0] * len(features), len(features)
    columns = [F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(features)]
    blocks = matrix_blocks(df.select(*columns, (F.col(label) * 2.0 - 1.0).alias("y")))

    def pulled(now: np.ndarray):
        """Two matrix products per block, one row out per task."""

        def run(batches):
            total, n = np.zeros(k), 0
            for part in batches:
                for block in part.column(0):
                    cells = np.frombuffer(block.as_buffer(), float).reshape(-1, k + 1)
                    x, y = cells[:, :k], cells[:, k]
                    total += np.where(y * (x @ now) < 1, -y, 0.0) @ x
                    n += len(y)
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64())), pa.array([n])], names=["g", "n"])

        return blocks.mapInArrow(run, "g array<double>, n bigint")

    for t in range(1, iterations + 1):
        sums = pulled(np.array(weights)).agg(vector_to_array(Summarizer.sum(array_to_vector("g"))).alias("g"), F.sum("n").alias("n"))
        row = sums.first()
        mean = [g / row["n"] for g in row["g"]] if row["n"] else weights
        rate = step / math.sqrt(t)
        gradient = list(mean)
        if penalty == "l1":
            moved = [w - rate * g for w, g in zip(weights, gradient)]
            cut = regularisation * rate
            weights = [math.copysign(max(0.0, abs(w) - cut), w) for w in moved]
        else:
            weights = [w * (1 - rate * regularisation) - rate * g for w, g in zip(weights, gradient)]
    return weights


def with_scores(df: DataFrame, features: Sequence[str], weights: Sequence[float], threshold: float | None = 0.0) -> DataFrame:
    """Add ``score`` (raw margin) and, with a threshold, the hard ``prediction``."""
    scored = df.withColumn("score", linear_margin(features, weights))
    if threshold is None:
        return scored
    return scored.withColumn("prediction", (F.col("score") > threshold).cast("double"))


def slot_metadata(features: Sequence[str], arities: Mapping[str, int]) -> dict:
    """Attribute metadata of a vector: slots named in ``arities`` hold category numbers 0..arity-1, the others measures.

    Trees split the former by sets of categories, whatever their order.
    """
    nominal = [{"idx": i, "name": c, "num_vals": int(arities[c])} for i, c in enumerate(features) if c in arities]
    numeric = [{"idx": i, "name": c} for i, c in enumerate(features) if c not in arities]
    kinds = {"nominal": nominal, "numeric": numeric}
    return {"ml_attr": {"attrs": {k: v for k, v in kinds.items() if v}, "num_attrs": len(features)}}


def as_vectors(
    df: DataFrame, features: Sequence[str], name: str = "features", arities: Mapping[str, int] | None = None
) -> DataFrame:
    """Add a pyspark.ml vector of the named columns; ``arities`` names the categorical ones and their number of values."""
    vectors = df.withColumn(name, array_to_vector(F.array(*[F.col(c).cast("double") for c in features])))
    return vectors.withMetadata(name, slot_metadata(features, arities)) if arities else vectors


def training_table(
    df: DataFrame, features: Sequence[str], name: str = "features", arities: Mapping[str, int] | None = None
) -> DataFrame:
    """The same, written once: solvers pass over their input many times."""
    return materialise(as_vectors(df, features, name, arities), "training")


def spread_table(
    df: DataFrame, features: Sequence[str], name: str = "features", arities: Mapping[str, int] | None = None
) -> DataFrame:
    """The same in twice as many files as tasks run at once.

    A few megabytes of rows keep a forest busy for minutes: read in as few
    parts as their size asks for, they would leave most cores idle.
    """
    parts = 2 * df.sparkSession.sparkContext.defaultParallelism
    return materialise(as_vectors(df, features, name, arities).repartition(parts), "training")
