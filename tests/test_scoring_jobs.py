"""Trees from their nodes, pipeline stages, kernel steps in blocks, readers with rejects, streams over a line folder."""

import math

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from quillmesh.operators import kernels as K
from quillmesh.operators import learning as L
from quillmesh.operators import scoring as SC
from quillmesh.operators import stages as ST
from quillmesh.operators import trees as TR
from quillmesh.operators.sampling import positioned_draws
from quillmesh.session import materialise, scratch_path
from quillmesh.sources import readers as RD
from quillmesh.streaming import jobs as SJ
from quillmesh.streaming import line_source as LS

NAMES = ["a", "b", "kind"]


@pytest.fixture(scope="module")
def labelled(spark):
    """The label depends on a set of categories that no single threshold separates."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(600):
        a, b, kind = float(rng.normal()), float(rng.integers(0, 9)), int(rng.integers(0, 6))
        rows.append((i, a, b, float(kind), float((kind in (0, 3, 5)) != (a > 1.2))))
    df = spark.createDataFrame(rows, "id bigint, a double, b double, kind double, label double")
    return L.training_table(df, NAMES, arities={"kind": 6})


def reread(spark, model):
    path = scratch_path(spark, "model")
    model.write().save(path)
    return TR.read_ensemble(spark, path)


@pytest.mark.parametrize("most", [0, 10**6])
@pytest.mark.parametrize(
    "estimator",
    [
        (DecisionTreeClassifier, {"maxDepth": 4}),
        (RandomForestClassifier, {"maxDepth": 4, "numTrees": 5}),
        (GBTClassifier, {"maxDepth": 3, "maxIter": 3}),
        (RandomForestRegressor, {"maxDepth": 4, "numTrees": 4}),
        (GBTRegressor, {"maxDepth": 3, "maxIter": 3}),
    ],
    ids=lambda e: e[0].__name__,
)
def test_scores_from_nodes_are_the_models(spark, labelled, monkeypatch, estimator, most):
    monkeypatch.setattr(TR, "MOST_LEAVES", most)  # the walk, then the expression
    kind, options = estimator
    model = kind(seed=1, **options).fit(labelled)
    ensemble = reread(spark, model)
    wanted = {r["id"]: r["prediction"] for r in model.transform(labelled).collect()}
    found = {r["id"]: r["prediction"] for r in TR.score(labelled, ensemble, NAMES).collect()}
    assert found == pytest.approx(wanted)
    splits = [n for tree in ensemble.trees for n in tree if n.left_values]
    assert splits and all(n.feature == 2 for n in splits) and " in {" in model.toDebugString


def test_sql_of_a_tree_runs_elsewhere(spark, labelled):
    duckdb = pytest.importorskip("duckdb")
    model = DecisionTreeClassifier(maxDepth=4, seed=1).fit(labelled)
    ensemble = reread(spark, model)
    text = TR.score_sql(ensemble, NAMES)[1].replace("`", '"')
    frame = labelled.select("id", *NAMES).toPandas()  # noqa: F841  (DuckDB finds it by name)
    found = dict(duckdb.sql(f"select id, {text} from frame").fetchall())
    shares = model.transform(labelled).select("id", vector_to_array("probability")[1].alias("p")).collect()
    assert found == pytest.approx({r["id"]: r["p"] for r in shares})


def test_numbers_are_exact_in_sql(spark):
    values = [0.1, -3.5e-300, 1e22, 123456789.123456789, 0.0, -1.0, 5e-324, 1.7976931348623157e308]
    cells = ", ".join(TR._number(v) for v in values)
    assert list(spark.sql(f"select array({cells}) as v").first()["v"]) == values


def test_pipeline_learns_from_its_training_rows_only(spark):
    train = spark.createDataFrame(
        [(1, "1.5", "x", 1.0), (2, "NA", "x", 0.0), (3, "2.5", "y", 0.0), (4, None, None, 0.0), (5, "inf", "z", 0.0)] * 6,
        "id bigint, n string, c string, label double",
    )
    fitted = ST.response_pipeline(["n"], ["c"], trees=3, depth=3, bins=3).fit(train)
    path = scratch_path(spark, "pipeline")
    fitted.write().save(path)
    again = PipelineModel.load(path)
    assert again.stages[1].learned() == {"c": ["x", "y"]}  # two of three values by frequency, then name
    mean = (1.5 + 2.5) / 5
    deviation = math.sqrt((1.5**2 + 2.5**2) / 5 - mean**2)
    assert again.stages[2].learned()["n"] == pytest.approx([mean, deviation])
    assert again.stages[3].learned() == {"1.0": 4.0, "0.0": 1.0}
    other = spark.createDataFrame([(9, "100", "new", "k"), (10, "", None, "k")], "id bigint, n string, c string, weight string")
    rows = {r["id"]: r for r in again.transform(other).collect()}
    assert rows[9]["n"] == pytest.approx((100 - mean) / deviation) and rows[10]["n"] == pytest.approx(-mean / deviation)
    assert rows[9]["c_slot"] == rows[10]["c_slot"] == 2.0 and rows[9]["weight"] == 1.0
    assert again.transform(train).schema["c_slot"].metadata["ml_attr"]["num_vals"] == 3
    kinds = again.transform(train).schema["features"].metadata["ml_attr"]["attrs"]
    assert [a["idx"] for a in kinds["nominal"]] == [1]
    wanted = [r["prediction"] for r in fitted.transform(train).orderBy("id").collect()]
    assert [r["prediction"] for r in again.transform(train).orderBy("id").collect()] == wanted


@pytest.mark.parametrize("block", [1, 7, 64])
def test_kernel_steps_do_not_depend_on_the_block(spark, block):
    rng = np.random.default_rng(9)
    rows = [(i, float(2 * (i % 2) - 1), [float(v) for v in rng.normal(size=3)]) for i in range(15)]
    df = spark.createDataFrame(rows, "key bigint, y double, x array<double>")
    drawn = materialise(positioned_draws(df, "key", ["y", "x"], 40), "drawn")
    order = {r["draw"]: r["key"] for r in drawn.collect()}
    assert sorted(order) == list(range(1, 41)) and len(set(order.values())) < 15
    y, x = {k: v for k, v, _ in rows}, {k: np.array(v) for k, _, v in rows}
    kept, wanted = [], []
    for t in range(1, 41):
        i = order[t]
        pull = sum(y[j] * math.exp(-0.5 * ((x[j] - x[i]) ** 2).sum()) for j in kept if j != i)
        if pull * y[i] / (0.05 * t) < 1:
            kept.append(i)
            wanted.append(t)
    assert K.kept_steps(drawn, 40, 0.05, "gaussian", block) == wanted and 0 < len(wanted) < 40


def test_readers_keep_what_they_reject(spark):
    lines = spark.createDataFrame([("1 2",), ("x 2",), ("3",), ("",), (None,), ("4 5 6",)], "value string").repartition(2)
    loaded = RD.load_checked(lines, *RD.edge_fields())
    assert sorted(map(tuple, loaded.good.collect())) == [(1, 2), (4, 5)] and (loaded.n_good, loaded.n_rejected) == (2, 4)
    assert sorted(str(r["value"]) for r in loaded.rejects.collect()) == ["", "3", "None", "x 2"]
    none = RD.load_checked(lines.limit(0), *RD.dictionary_fields())
    assert (none.n_good, none.n_rejected, none.good.count(), none.rejects.count()) == (0, 0, 0, 0)
    assert none.good.columns == ["name", "code"]


def test_line_folder_goes_on_from_its_offset(spark):
    folder, job = scratch_path(spark, "lines"), scratch_path(spark, "job")
    run = lambda: SJ.to_table(LS.line_stream(spark, folder), folder=job)
    sizes = []
    for k, texts in enumerate([["a b", "", "c"], ["d"] * 5, ["é x", "last"]]):
        spark.createDataFrame([(t,) for t in texts], "value string").coalesce(2).write.text(f"{folder}/{k:06d}")
        sizes.append(run().count())
    table = run()
    assert sizes == [3, 8, 10] and table.count() == 10 and table.select("batch").distinct().count() == 3
    assert {r["value"] for r in table.collect()} == {"a b", "", "c", "d", "é x", "last"}


def test_lines_across_blocks(tmp_path, monkeypatch):
    monkeypatch.setattr(LS, "BLOCK", 5)
    (tmp_path / "_hidden").write_text("no")
    (tmp_path / "1.txt").write_text("ab\ncdefghijk\n\nlast")
    assert LS.listed(str(tmp_path)) == ["1.txt"]
    found = [v for b in LS.lines_of(f"{tmp_path}/1.txt") for v in b.column(0).to_pylist()]
    assert found == ["ab", "cdefghijk", "", "last"]


def test_a_stream_over_an_empty_folder_is_an_empty_table(spark, tmp_path):
    stream = SJ.file_stream(spark, str(tmp_path))
    assert SJ.to_table(stream).count() == 0 and SJ.to_table(stream).columns == ["value", "batch"]
    assert SJ.count_rows(SJ.tokens(SJ.file_stream(spark, str(tmp_path))), ["token"]).count() == 0


def test_predictions_use_the_weights_known_when_a_batch_arrives(spark):
    def points(slope, first, n=30):
        return [(float(first + i), slope * (first + i)) for i in range(n)]

    incoming, asked, job = (scratch_path(spark, n) for n in ("points", "asked", "predicted"))
    schema, progress = "a double, y double", scratch_path(spark, "training")
    model = SJ.OnlineRegression(spark, "y", ["a"])
    seen = []
    for k, rows in enumerate([points(2.0, 1), points(5.0, 40), points(5.0, 80)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(incoming)
        model.train_on(SJ.file_stream(spark, incoming, schema, "parquet"), folder=progress)
        spark.createDataFrame([(1.0, float(k))], schema).write.mode("append").parquet(asked)
        table = model.predict_arriving(SJ.file_stream(spark, asked, schema, "parquet"), folder=job)
        seen.append(model.weights()[0])
    found = {r["y"]: (r["prediction"], r["version"]) for r in table.collect()}
    assert found == {float(k): (pytest.approx(w), k + 1) for k, w in enumerate(seen)}
    assert seen[0] == pytest.approx(2.0) and seen[0] < seen[1] < seen[2]


def test_grid_search_equals_its_cells_fitted_apart(spark):
    rng = np.random.default_rng(11)
    rows = []
    for k in range(300):
        label = float(k % 3 == 0)
        names = [f"w{rng.integers(40)}" for _ in range(6)] + [f"{'g' if label == (rng.random() < 0.8) else 'b'}{rng.integers(5)}"]
        rows.append((names, label, k % 2))
    data = materialise(spark.createDataFrame(rows, "words array<string>, label double, fold int"), "grid")
    widths, penalties = [4, 64], [0.1, 0.01]
    model, cells = SC.text_grid_search(data, widths, penalties, iterations=10)

    def area(scored):
        """Share of (good, bad) pairs in the right order, by ranks and half for ties."""
        good = np.array([s for s, y in scored if y == 1.0])
        bad = np.array([s for s, y in scored if y == 0.0])
        return ((good[:, None] > bad).sum() + 0.5 * (good[:, None] == bad).sum()) / (len(good) * len(bad))

    wanted = {}
    for width in widths:
        vectors = HashingTF(inputCol="words", outputCol="features", numFeatures=width).transform(data)
        for penalty in penalties:
            parts = []
            for fold in (0, 1):
                fitted = LogisticRegression(maxIter=10, regParam=penalty).fit(vectors.filter(F.col("fold") != fold))
                scored = fitted.transform(vectors.filter(F.col("fold") == fold)).select(vector_to_array("rawPrediction")[1], "label")
                parts.append(area([tuple(r) for r in scored.collect()]))
            wanted[(width, penalty)] = np.mean(parts)
    found = cells.collect()
    assert {(r["slots"], r["penalty"]) for r in found} == set(wanted)
    for r in found:
        assert r["area"] == pytest.approx(wanted[(r["slots"], r["penalty"])], abs=1e-6)
    chosen = [r for r in found if r["chosen"]]
    assert len(chosen) == 1 and chosen[0]["area"] == max(r["area"] for r in found)
    assert model.stages[0].getNumFeatures() == chosen[0]["slots"] and model.stages[1].getRegParam() == chosen[0]["penalty"]
