"""Metrics, solvers, kernels and streaming jobs against hand or brute-force answers."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from quillmesh.operators import evaluation as Q
from quillmesh.operators import kernels as K
from quillmesh.operators import learning as L
from quillmesh.operators.sampling import seeded_draws
from quillmesh.session import scratch_path
from quillmesh.streaming import jobs as ST


@pytest.fixture(scope="module")
def outcomes(spark):
    pairs = [(1.0, 1.0)] * 2 + [(0.0, 1.0)] + [(1.0, 0.0)] + [(0.0, 0.0)] * 4
    return spark.createDataFrame(pairs, "label double, prediction double")


def test_confusion_metrics(outcomes):
    row = Q.confusion_metrics(outcomes).first()
    assert (row["error"], row["precision"], row["recall"]) == pytest.approx((0.25, 2 / 3, 2 / 3))
    negative = Q.confusion_metrics(outcomes, positive=0).first()
    assert (negative["precision"], negative["recall"]) == pytest.approx((0.8, 0.8))
    assert Q.area_under_roc(outcomes, score="prediction").first()[0] == pytest.approx(11 / 15)


def test_ranking_areas_match_the_library(spark):
    chance = random.Random(1)
    data = [(float(chance.random() < 0.3), float(chance.randrange(40))) for _ in range(800)]
    df = spark.createDataFrame(data, "label double, score double")
    for name, area in (("areaUnderROC", Q.area_under_roc), ("areaUnderPR", Q.area_under_pr)):
        library = BinaryClassificationEvaluator(rawPredictionCol="score", metricName=name, numBins=0).evaluate(df)
        assert area(df).first()[0] == pytest.approx(library, abs=1e-9)


def test_area_of_a_constant_score_and_of_one_class(spark):
    df = spark.createDataFrame([(1.0, 5.0), (0.0, 5.0), (0.0, 5.0)], "label double, score double")
    assert Q.area_under_roc(df).first()[0] == 0.5
    assert Q.area_under_roc(df.filter("label = 0")).first()[0] is None


def svm_by_hand(x, y, iterations, reg, penalty):
    w = np.zeros(x.shape[1])
    for t in range(1, iterations + 1):
        active = (y * (x @ w)) < 1
        gradient = -(y[:, None] * x * active[:, None]).mean(0)
        rate = 1 / math.sqrt(t)
        if penalty == "l1":
            moved = w - rate * gradient
            w = np.sign(moved) * np.maximum(0, np.abs(moved) - reg * rate)
        else:
            w = w * (1 - rate * reg) - rate * gradient
    return w


@pytest.mark.parametrize("penalty", ["l2", "l1"])
def test_linear_svm_steps(spark, penalty):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 3))
    label = (x @ [1.0, -2.0, 0.1] > 0).astype(int)
    df = spark.createDataFrame([(int(t), *map(float, r)) for t, r in zip(label, x)], "label int, a double, b double, c double")
    found = L.svm_weights(df, "label", ["a", "b", "c"], 6, regularisation=0.1, penalty=penalty)
    assert found == pytest.approx(svm_by_hand(x, 2 * label - 1, 6, 0.1, penalty), abs=1e-9)


def test_linear_svm_of_many_features(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(20, 150))
    label = (x[:, 0] > 0).astype(int)
    names = [f"f{i}" for i in range(150)]
    df = spark.createDataFrame([(int(t), *map(float, r)) for t, r in zip(label, x)], ", ".join(["label int", *[f"{n} double" for n in names]]))
    found = L.svm_weights(df, "label", names, 3)
    assert found == pytest.approx(svm_by_hand(x, 2 * label - 1, 3, 0.0, "l2"), abs=1e-9)


@pytest.mark.parametrize("name", ["gaussian", "linear", "polynomial"])
@pytest.mark.parametrize("biased", [True, False])
def test_kernel_svm_equals_plain_recursion(spark, name, biased):
    rng = np.random.default_rng(4)
    points = rng.normal(size=(12, 3))
    label = (points[:, 0] > 0).astype(int)
    df = spark.createDataFrame([(i, int(t), [float(v) for v in r]) for i, (t, r) in enumerate(zip(label, points))], "id bigint, label int, x array<double>")
    steps, reg = 30, 0.1
    model = K.train_kernel_svm(df, "id", "label", "x", steps, reg, name, biased)

    order = [r["id"] for r in seeded_draws(df, "id", [], steps).orderBy("draw").collect()]
    x = np.hstack([points, np.ones((12, 1))]) if biased else points
    y = 2.0 * label - 1

    def k(a, b):
        if name == "linear":
            return a @ b
        return (a @ b + 1) ** 2 if name == "polynomial" else math.exp(-0.5 * ((a - b) ** 2).sum())

    alpha = np.zeros(12)
    for t, i in enumerate(order, 1):
        pull = sum(y[j] * alpha[j] * k(x[j], x[i]) for j in range(12) if j != i)
        if pull * y[i] / (reg * t) < 1:
            alpha[i] += 1
    assert dict(zip(model.keys, model.alpha)) == {j: a for j, a in enumerate(alpha) if a > 0}

    margins = {r["id"]: r["margin"] for r in K.score_kernel_svm(df, model, "x", threshold=None).collect()}
    for i in range(12):
        expected = sum(alpha[j] * y[j] * k(x[j], x[i]) for j in range(12)) / (reg * steps)
        assert margins[i] == pytest.approx(expected, abs=1e-8)


def test_lloyd_keeps_an_unchosen_centre(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([2.0, 0.0],)], "features array<double>")
    assert L.lloyd(df, "features", [[0.0, 0.0], [100.0, 0.0]], rounds=2) == [[1.0, 0.0], [100.0, 0.0]]


def text_folder(spark, texts, files):
    path = scratch_path(spark, "stream-in")
    spark.createDataFrame([(x,) for x in texts], "value string").repartition(files).write.text(path)
    return path


def test_streaming_counts_over_batches_equal_batch_counts(spark):
    chance = random.Random(5)
    texts = [" ".join(chance.choice("abcde") for _ in range(chance.randrange(0, 9))) for _ in range(200)]
    stream = ST.file_stream(spark, text_folder(spark, texts, 5), files_per_batch=1)
    table = ST.to_table(ST.word_counts(stream), "update")
    assert table.select("batch").distinct().count() > 1
    found = {r["token"]: r["n"] for r in ST.latest(table, ["token"], "n").collect()}
    words = " ".join(texts).split()
    assert found == {w: words.count(w) for w in set(words)}


def test_counts_without_state_and_a_restart_that_keeps_earlier_batches(spark):
    folder, incoming = scratch_path(spark, "job"), text_folder(spark, ["a b"] * 40, 4)
    count = lambda: ST.count_rows(ST.tokens(ST.file_stream(spark, incoming, files_per_batch=1)), ["token"], folder=folder)
    assert {tuple(r) for r in count().collect()} == {("a", 40), ("b", 40)}
    spark.createDataFrame([("b c",)] * 3, "value string").write.mode("append").text(incoming)
    assert {tuple(r) for r in count().collect()} == {("a", 40), ("b", 43), ("c", 3)}


def test_a_run_cut_short_is_an_error_and_can_go_on(spark):
    folder, incoming = scratch_path(spark, "job"), text_folder(spark, [str(i) for i in range(120)], 60)
    stream = lambda: ST.file_stream(spark, incoming, files_per_batch=1)
    with pytest.raises(TimeoutError):
        ST.to_table(stream(), folder=folder, timeout=1)
    assert ST.to_table(stream(), folder=folder).count() == 120


def test_streaming_record_map(spark):
    stream = ST.file_stream(spark, text_folder(spark, ["1,,x,", "2,b,,z"], 2))
    found = ST.to_table(ST.map_records(stream, dropped=[0])).select("fields").collect()
    assert sorted(r[0] for r in found) == [["0", "x", "0"], ["b", "0", "z"]]
    decorated = ST.to_table(ST.decorate(ST.file_stream(spark, text_folder(spark, ["m"], 1)))).select("value").first()[0]
    assert decorated == "okmyes"


def test_online_regression_counts_a_repeated_batch_once(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(100, 2))
    y = x @ [2.0, -3.0] + 0.1 * rng.normal(size=100)
    df = spark.createDataFrame([(float(t), *map(float, r)) for t, r in zip(y, x)], "y double, a double, b double")
    path = scratch_path(spark, "points")
    df.repartition(4).write.parquet(path)
    model = ST.OnlineRegression(spark, "y", ["a", "b"])
    model.train_on(ST.file_stream(spark, path, df.schema, "parquet", files_per_batch=1))
    expected = np.linalg.lstsq(x, y, rcond=None)[0]
    assert model.weights() == pytest.approx(list(expected))
    batch = spark.read.parquet(spark.read.parquet(path).inputFiles()[0])
    numbers = [r[0] for r in spark.read.parquet(model.path).select("batch").collect()]
    assert len(numbers) == 4
    model.update(batch, 99)
    once = model.weights()
    model.update(batch, 99)
    assert model.weights() == once


def test_event_time_intervals_count_rows_however_late(spark):
    df = spark.range(100).select(F.timestamp_seconds(F.col("id") * 60 * ((-1) ** F.col("id")).cast("int")).alias("ts"))
    path = scratch_path(spark, "events")
    df.repartition(5).write.parquet(path)
    stream = ST.file_stream(spark, path, df.schema, "parquet", files_per_batch=1)
    table = ST.interval_counts(stream, "ts", "10 minutes")
    assert table.agg(F.sum("n")).first()[0] == 100 and table.select("start").distinct().count() == table.count()


def test_online_regression_of_collinear_features(spark):
    df = spark.createDataFrame([(2.0 * a, float(a), float(a)) for a in range(9)], "y double, a double, b double")
    model = ST.OnlineRegression(spark, "y", ["a", "b"])
    model.update(df, 0)
    assert model.weights() == pytest.approx([1.0, 1.0])


def test_tree_training_is_spread_over_all_cores(spark):
    from quillmesh.operators.learning import spread_table, training_table

    rows = spark.range(500).select(F.col("id").cast("double").alias("a"), (F.col("id") % 2).cast("double").alias("label")).coalesce(1)
    cores = spark.sparkContext.defaultParallelism
    spread = spread_table(rows, ["a"])
    assert spread.rdd.getNumPartitions() >= cores > training_table(rows, ["a"]).rdd.getNumPartitions()
    assert sorted(r["a"] for r in spread.collect()) == [float(i) for i in range(500)]


def test_matrix_blocks_hold_every_row_in_bounded_blocks(spark, monkeypatch):
    from pyspark.sql.types import BinaryType

    monkeypatch.setattr(L, "BLOCK_BYTES", 64)
    rows = [(float(i), None if i == 3 else -float(i)) for i in range(21)]
    blocks = L.matrix_blocks(spark.createDataFrame(rows, "a double, b double").repartition(2))
    assert blocks.schema[0].dataType == BinaryType()
    cells = [np.frombuffer(r["cells"]).reshape(-1, 2) for r in blocks.collect()]
    assert max(len(c) for c in cells) <= 4
    found = sorted(map(tuple, np.vstack(cells).tolist()))
    assert [a for a, _ in found] == [float(i) for i in range(21)]
    assert [b for _, b in found if b == b] == [-float(i) for i in range(21) if i != 3]


def test_grid_search_fits_on_vectors_not_texts(spark, tmp_path, monkeypatch):
    from pyspark.ml.tuning import CrossValidator

    from quillmesh.plans import learning_queries as Q_
    from quillmesh.plans.registry import Tables

    spark.createDataFrame([(i, "good words" if i % 3 else "bad words here") for i in range(60)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(60)], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    seen, fit = [], CrossValidator.fit
    monkeypatch.setattr(CrossValidator, "fit", lambda self, data: seen.append(data.columns) or fit(self, data))
    found = Q_.m20(Tables(spark, str(tmp_path))).collect()
    assert "text" not in seen[0] and {"terms10", "terms100", "terms1000"} <= set(seen[0])
    assert len(found) == 60 and all(r["label"] == r["prediction"] for r in found)
