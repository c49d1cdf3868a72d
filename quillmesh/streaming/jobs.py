"""Structured Streaming jobs: file sources, counts, record maps, scoring and online regression.

A job has one folder for its progress and its results, one parquet table per
micro-batch.  A batch that is run again after a failure overwrites its own
table, and a job restarted on its folder goes on where it stopped and returns
the results of all batches.  Counts are written per batch and added up when
they are read: no state to keep, no row too late to count.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.operators.learning import as_vectors, linear_margin
from quillmesh.session import scratch_path


BATCH_BYTES = str(4 << 30)


def file_stream(
    spark: SparkSession, path: str, schema: str | object = "value string", fmt: str = "text", files_per_batch: int | None = None
) -> DataFrame:
    """New files of a folder or glob, in the given format; a batch takes ``files_per_batch`` files or ``BATCH_BYTES``."""
    reader = spark.readStream.schema(schema).format(fmt)
    if not files_per_batch:
        reader = reader.option("maxBytesPerTrigger", BATCH_BYTES)
    if fmt == "text":
        reader = reader.option("lineSep", "\n")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", str(files_per_batch))
    return reader.load(path)


def run_batches(
    stream: DataFrame,
    each: Callable[[DataFrame, int], None],
    mode: str = "append",
    interval: str | None = None,
    timeout: int | None = None,
    folder: str | None = None,
) -> bool:
    """Run ``each(batch, id)`` over everything available, or every ``interval`` for ``timeout`` seconds.

    Returns whether the stream came to its end; a timeout leaves it unfinished.
    """
    spark = stream.sparkSession
    folder = folder or scratch_path(spark, "stream")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/progress")
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    running = writer.foreachBatch(each).start()
    try:
        return bool(running.awaitTermination(timeout)) if timeout else running.awaitTermination() is None
    finally:
        running.stop()


def to_table(
    stream: DataFrame,
    mode: str = "append",
    each: Callable[[DataFrame], DataFrame] | None = None,
    folder: str | None = None,
    **options,
) -> DataFrame:
    """Run a stream into one parquet table per batch, through ``each`` if given; returns rows with their ``batch``.

    ``folder`` holds progress and results: on a folder used before, the new
    batches are added and all results returned.  A run on available data that a
    timeout cuts short raises ``TimeoutError``, and the next run on the folder
    goes on from there.
    """
    spark = stream.sparkSession
    folder = folder or scratch_path(spark, "stream")
    path = f"{folder}/result"
    each = each or (lambda batch: batch)

    def store(batch: DataFrame, number: int) -> None:
        each(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    finished = run_batches(stream, store, mode, folder=folder, **options)
    if not finished and not options.get("interval"):
        raise TimeoutError(f"the stream did not end in time; its results so far are in {folder}")
    fields = each(spark.createDataFrame([], stream.schema)).schema.fields
    described = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return _batches(spark, f"{described}, batch int", path)


def _batches(spark: SparkSession, schema: str, path: str) -> DataFrame:
    """The tables of all batches, or an empty one where a stream has had none."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def count_rows(stream: DataFrame, keys: Sequence[str], **options) -> DataFrame:
    """Rows per key over the whole stream: partial counts per batch, added up here."""
    partial = to_table(stream, each=lambda b: b.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), **options)
    return partial.groupBy(*keys).agg(F.sum("n").alias("n"))


def latest(table: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Last value written per key by an update-mode stream."""
    return table.groupBy(*keys).agg(F.max_by(value, "batch").alias(value))


def tokens(lines: DataFrame, pattern: str = r"\s+") -> DataFrame:
    """One ``token`` per row of any streaming table with a ``value`` column."""
    return lines.select(F.explode(F.split("value", pattern)).alias("token")).filter("token <> ''")


def word_counts(lines: DataFrame, pattern: str = r"\s+") -> DataFrame:
    """Running count per token, kept as streaming state; :func:`count_rows` of tokens keeps none."""
    return tokens(lines, pattern).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def interval_counts(events: DataFrame, time: str, interval: str, keys: Sequence[str] = (), **options) -> DataFrame:
    """Rows per tumbling interval of event time (``start``), however late a row arrives."""
    start = F.window(F.col(time).cast("timestamp"), interval)["start"].alias("start")
    return count_rows(events.select(start, *keys), ["start", *keys], **options)


def map_records(lines: DataFrame, dropped: Sequence[int], sep: str = ",") -> DataFrame:
    """Fields of each line without the ``dropped`` positions, empty ones as 0."""
    fields = F.split(F.trim("value"), sep, -1)
    kept = F.filter(fields, lambda _, i: ~i.isin(*dropped)) if dropped else fields
    return lines.select(F.transform(kept, lambda x: F.when(x == "", "0").otherwise(x)).alias("fields"))


def decorate(lines: DataFrame, before: str = "ok", after: str = "yes") -> DataFrame:
    return lines.select(F.concat(F.lit(before), "value", F.lit(after)).alias("value"))


def score_stream(stream: DataFrame, model: Model, features: Sequence[str]) -> DataFrame:
    """Predictions beside the streaming rows; scoring stays on the executors."""
    return model.transform(as_vectors(stream, features)).drop("features", "rawPrediction", "probability")


class OnlineRegression:
    """Least squares without intercept, trained on one stream and applied to another.

    Each batch adds its sums of products to a table keyed by the batch number,
    so a repeated batch counts once and the result does not depend on how rows
    fall into batches.
    """

    def __init__(self, spark: SparkSession, label: str, features: Sequence[str], path: str | None = None):
        self.spark, self.label, self.features = spark, label, list(features)
        self.path = path or scratch_path(spark, "regression")

    def update(self, batch: DataFrame, number: int) -> None:
        """Sums of x xT and x y: one matrix product per Arrow batch, one row per task to add up."""
        n = len(self.features)
        columns = [F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate([*self.features, self.label])]
        rows = batch.select(*columns).dropna()

        def products(batches):
            left, right = np.zeros((n, n)), np.zeros(n)
            for part in batches:
                cells = np.column_stack([c.to_numpy() for c in part.columns])
                x, y = cells[:, :n], cells[:, n]
                left += x.T @ x
                right += x.T @ y
            yield pa.RecordBatch.from_arrays(
                [pa.array([v.ravel().tolist()], pa.list_(pa.float64())) for v in (left, right)], names=["xx", "xy"]
            )

        partial = rows.mapInArrow(products, "xx array<double>, xy array<double>")
        sums = partial.agg(*[Summarizer.sum(array_to_vector(c)).alias(c) for c in ("xx", "xy")])
        kept = sums.select(*[vector_to_array(c).alias(c) for c in ("xx", "xy")])
        kept.write.mode("overwrite").parquet(f"{self.path}/batch={number}")

    def train_on(self, stream: DataFrame, **options) -> OnlineRegression:
        if not run_batches(stream, self.update, **options):
            raise TimeoutError("the training stream did not end in time")
        return self

    def weights(self) -> list[float]:
        """Least-squares weights; of collinear or constant features the solution of least norm."""
        return self.known()[1]

    def known(self) -> tuple[int, list[float]]:
        """How many training batches have been seen, and the weights they give (0 before the first)."""
        n = len(self.features)
        table = _batches(self.spark, "xx array<double>, xy array<double>, batch int", self.path)
        table = table.filter(F.size("xx") == n * n)  # a batch without rows sums to nothing
        sums = table.agg(
            F.count(F.lit(1)).alias("batches"),
            *[vector_to_array(Summarizer.sum(array_to_vector(c))).alias(c) for c in ("xx", "xy")],
        ).first()
        if not sums["batches"]:
            return 0, [0.0] * n
        left = np.array(sums["xx"], dtype=float).reshape(n, n)
        right = np.array(sums["xy"], dtype=float)
        scale = np.sqrt(np.where(np.diag(left) > 0, np.diag(left), 1.0))
        full = np.linalg.matrix_rank(left / np.outer(scale, scale), hermitian=True) == n
        found = np.linalg.solve(left, right) if full else np.linalg.lstsq(left, right, rcond=None)[0]
        return sums["batches"], [float(w) for w in found]

    def predict_arriving(self, stream: DataFrame, **options) -> DataFrame:
        """Predict a second stream while the first one trains: each of its batches takes the weights known when it arrives.

        Returns its rows with ``prediction`` and ``version``, the number of training batches behind the weights.
        """

        def each(batch: DataFrame) -> DataFrame:
            version, weights = self.known()
            scored = batch.withColumn("prediction", linear_margin(self.features, weights))
            return scored.withColumn("version", F.lit(version).cast("bigint"))

        return to_table(stream, each=each, **options)

    def predict(self, table: DataFrame) -> DataFrame:
        """Add ``prediction`` under the weights known now; works on streams and tables."""
        return table.withColumn("prediction", linear_margin(self.features, self.weights()))
