"""Model jobs around pyspark.ml: train, score another population, export, keep and describe models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.operators.learning import as_vectors, training_table
from quillmesh.sources.writers import write_kept


def train_forest(
    df: DataFrame,
    features: Sequence[str],
    label: str = "label",
    trees: int = 20,
    depth: int = 5,
    bins: int = 32,
    seed: int = 7,
    arities: Mapping[str, int] | None = None,
) -> Model:
    """A forest by gini impurity; ``arities`` names categorical features and their number of values (at most ``bins``)."""
    forest = RandomForestClassifier(
        labelCol=label, featuresCol="features", numTrees=trees, maxDepth=depth, maxBins=bins, impurity="gini", seed=seed
    )
    return forest.fit(training_table(df.select(label, *features), features, arities=arities))


def score(df: DataFrame, model: Model, features: Sequence[str]) -> DataFrame:
    """Rows with ``prediction``, beside everything they had."""
    return model.transform(as_vectors(df, features)).drop("features", "rawPrediction", "probability")


def score_and_export(
    train: DataFrame, population: DataFrame, key: str, features: Sequence[str], path: str, model_path: str | None = None, **forest
) -> DataFrame:
    """Train on labelled rows, score a population, and write the keys predicted positive.

    ``model_path`` also keeps the model.
    """
    model = train_forest(train, features, **forest)
    if model_path is not None:
        save_model(model, model_path)
    chosen = score(population, model, features).filter("prediction = 1").select(key, "prediction")
    write_kept(chosen, path)
    return population.sparkSession.read.schema(chosen.schema).parquet(path)


def describe_trees(model: Model, features: Sequence[str], spark: SparkSession) -> DataFrame:
    """(line, text): feature importances, then the text form of the trees."""
    importances = [f"{name} {weight:.6f}" for name, weight in zip(features, model.featureImportances.toArray())]
    lines = importances + model.toDebugString.splitlines()
    return spark.createDataFrame(list(enumerate(lines)), "line bigint, text string")


def text_grid_search(
    data: DataFrame, widths: Sequence[int], penalties: Sequence[float], iterations: int = 10
) -> tuple[Model, DataFrame]:
    """(best model, one row per cell) of a logistic regression on hashed words, cross-validated over the column ``fold``.

    ``data`` has ``words``, ``label`` and ``fold`` (0, 1, ...).  A cell is a
    number of hash slots and a penalty, its ``area`` the mean area under ROC over
    the folds left out; the chosen cell is fitted on all rows.  Of equal cells the
    first one, by order of the arguments, is chosen.  The cells are as many as the
    arguments name, whatever the data.
    """
    frequencies = HashingTF(inputCol="words", outputCol="features")
    regression = LogisticRegression(maxIter=iterations)
    grid = (
        ParamGridBuilder().addGrid(frequencies.numFeatures, list(widths)).addGrid(regression.regParam, list(penalties)).build()
    )
    folds = data.agg(F.max("fold")).first()[0] + 1
    search = CrossValidator(
        estimator=Pipeline(stages=[frequencies, regression]),
        estimatorParamMaps=grid,
        evaluator=BinaryClassificationEvaluator(),
        numFolds=folds,
        foldCol="fold",
        parallelism=2,  # a fit waits for its driver between steps; another one fills the executors
    ).fit(data)
    best = search.avgMetrics.index(max(search.avgMetrics))
    rows = [
        (cell[frequencies.numFeatures], cell[regression.regParam], float(area), k == best)
        for k, (cell, area) in enumerate(zip(grid, search.avgMetrics))
    ]
    cells = data.sparkSession.createDataFrame(rows, "slots int, penalty double, area double, chosen boolean")
    return search.bestModel, cells


def save_model(model: Model, path: str) -> None:
    PipelineModel([model]).write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def probability_of(df: DataFrame, position: int = 1) -> DataFrame:
    """Add the probability of one class as a plain column."""
    return df.withColumn("score", F.round(vector_to_array("probability")[position], 6))
