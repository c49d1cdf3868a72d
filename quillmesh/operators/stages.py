"""Pipeline stages that learn from the training part only and are saved with the pipeline.

Each estimator makes one pass over its training rows and keeps a small state:
moments, the most frequent values of a category, rows per class.  The fitted
stages work on any population, with or without a label, and are read back with
``PipelineModel.load`` like the library's own.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, Transformer
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasLabelCol, HasOutputCols, HasWeightCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class _Saved(DefaultParamsReadable, DefaultParamsWritable):
    """Saved by its parameters."""


class _State(Params):
    """What a fitted stage has learned, as text."""

    state = Param(Params._dummy(), "state", "learned values as JSON", TypeConverters.toString)

    def learned(self):
        return json.loads(self.getOrDefault(self.state))

    def keep(self, value):
        return self._set(state=json.dumps(value))


def _lookup(values: Mapping[str, float], key: Column, default: float) -> Column:
    if not values:
        return F.lit(float(default))
    cells = [F.lit(x) for k, v in values.items() for x in (k, float(v))]
    return F.coalesce(F.try_element_at(F.create_map(*cells), key), F.lit(float(default)))


class CleanNumbers(Transformer, HasInputCols, _Saved):
    """Columns as doubles in place; what is no finite number becomes 0."""

    @keyword_only
    def __init__(self, *, inputCols: Sequence[str] = ()):
        super().__init__()
        self._set(inputCols=list(inputCols))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        def clean(name: str) -> Column:
            number = F.col(name).try_cast("double")
            return F.when(F.abs(number) < float("inf"), number).otherwise(0.0)

        return dataset.withColumns({c: clean(c) for c in self.getInputCols()})


class CategoryEncoder(Estimator, HasInputCols, HasOutputCols, _Saved):
    """Texts to slots 0..k-1, the most frequent first (ties by name), and slot k for all other values and null.

    ``arity`` bounds the slots of a column, as trees bound theirs by bins; a
    column of fewer values has one slot each.
    """

    arity = Param(Params._dummy(), "arity", "most slots of a column, the one for others included", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCols: Sequence[str] = (), outputCols: Sequence[str] = (), arity: int = 32):
        super().__init__()
        self._set(inputCols=list(inputCols), outputCols=list(outputCols), arity=arity)

    def _fit(self, dataset: DataFrame) -> Model:
        names = self.getInputCols()
        pairs = [F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in names]
        cells = dataset.select(F.inline(F.array(*pairs))).filter("value is not null")
        counts = cells.groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))
        place = F.row_number().over(Window.partitionBy("name").orderBy(F.col("n").desc(), "value"))
        ranked = counts.withColumn("place", place).filter(F.col("place") < self.getOrDefault(self.arity))
        found = ranked.orderBy("name", "place").collect()  # fewer than arity rows a column
        slots = {c: [r["value"] for r in found if r["name"] == c] for c in names}
        model = CategoryEncoderModel()
        model._set(inputCols=names, outputCols=self.getOutputCols())
        return model.keep(slots)


class CategoryEncoderModel(Model, HasInputCols, HasOutputCols, _State, _Saved):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        slots = self.learned()
        for name, out in zip(self.getInputCols(), self.getOutputCols()):
            numbers = {v: k for k, v in enumerate(slots[name])}
            dataset = dataset.withColumn(out, _lookup(numbers, F.col(name).cast("string"), len(numbers)))
            attribute = {"type": "nominal", "name": out, "num_vals": len(numbers) + 1}
            dataset = dataset.withMetadata(out, {"ml_attr": attribute})
        return dataset


class ZScale(Estimator, HasInputCols, _Saved):
    """Columns in place to mean 0 and population deviation 1; a constant column becomes 0."""

    @keyword_only
    def __init__(self, *, inputCols: Sequence[str] = ()):
        super().__init__()
        self._set(inputCols=list(inputCols))

    def _fit(self, dataset: DataFrame) -> Model:
        names = self.getInputCols()
        moments = [f(c).alias(f"{k}{i}") for i, c in enumerate(names) for k, f in (("m", F.avg), ("s", F.stddev_pop))]
        row = dataset.agg(*moments).first()
        model = ZScaleModel()
        model._set(inputCols=names)
        return model.keep({c: [row[f"m{i}"] or 0.0, row[f"s{i}"] or 0.0] for i, c in enumerate(names)})


class ZScaleModel(Model, HasInputCols, _State, _Saved):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        def scaled(name: str, mean: float, deviation: float) -> Column:
            return (F.col(name) - F.lit(mean)) / F.lit(deviation) if deviation else F.lit(0.0)

        return dataset.withColumns({c: scaled(c, *v) for c, v in self.learned().items()})


class ClassBalance(Estimator, HasLabelCol, HasWeightCol, _Saved):
    """A weight per row that gives every class the weight of the largest one.

    The balance of copying rows without the copies; a population without the
    label has weight 1.
    """

    @keyword_only
    def __init__(self, *, labelCol: str = "label", weightCol: str = "weight"):
        super().__init__()
        self._set(labelCol=labelCol, weightCol=weightCol)

    def _fit(self, dataset: DataFrame) -> Model:
        counts = {str(r["label"]): r["n"] for r in dataset.groupBy(F.col(self.getLabelCol()).cast("double").alias("label")).agg(F.count(F.lit(1)).alias("n")).collect()}
        model = ClassBalanceModel()
        model._set(labelCol=self.getLabelCol(), weightCol=self.getWeightCol())
        return model.keep({k: max(counts.values()) / n for k, n in counts.items()})


class ClassBalanceModel(Model, HasLabelCol, HasWeightCol, _State, _Saved):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        if self.getLabelCol() not in dataset.columns:
            return dataset.withColumn(self.getWeightCol(), F.lit(1.0))
        weights = self.learned()
        return dataset.withColumn(self.getWeightCol(), _lookup(weights, F.col(self.getLabelCol()).cast("double").cast("string"), 1.0))


def response_pipeline(
    numbers: Sequence[str], categories: Sequence[str], label: str = "label", trees: int = 100, depth: int = 15, bins: int = 32, seed: int = 7
) -> Pipeline:
    """Clean, encode, scale, balance and a forest that splits categories by sets."""
    slots = [f"{c}_slot" for c in categories]
    forest = RandomForestClassifier(
        labelCol=label, weightCol="weight", numTrees=trees, maxDepth=depth, maxBins=bins, impurity="gini", seed=seed
    )
    return Pipeline(
        stages=[
            CleanNumbers(inputCols=numbers),
            CategoryEncoder(inputCols=categories, outputCols=slots, arity=bins),
            ZScale(inputCols=numbers),
            ClassBalance(labelCol=label),
            VectorAssembler(inputCols=[*numbers, *slots], outputCol="features"),
            forest,
        ]
    )
