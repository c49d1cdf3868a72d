"""Machine learning queries."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import HashingTF, IndexToString, StringIndexer, Tokenizer, VectorIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.recommendation import ALS
from pyspark.ml.stat import Summarizer
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

from quillmesh.functions import vectors as V
from quillmesh.operators import kernels as K
from quillmesh.operators import learning as L
from quillmesh.operators import scaling as Z
from quillmesh.operators import scoring as SC
from quillmesh.operators.lookup import lookup_join
from quillmesh.operators.sampling import hash_part, positioned_draws, seeded_draws
from quillmesh.plans.bindings import FEATURES, order_features, with_features
from quillmesh.plans.registry import query
from quillmesh.plans.relational_queries import RATINGS_SQL, ratings
from quillmesh.session import materialise, scratch_path

SCALED = ("quantity", "discount", "tax", "total")


def scaled_features(t):
    df = order_features(t).select("id", "label", *SCALED)
    return Z.scale(df, SCALED, "z_score")


def svm_sql(iterations: int, regularisation: float, penalty: str) -> str:
    """Unrolled weights w0..w<iterations> of the full-batch sub-gradient steps."""
    stats = ", ".join(f"avg({c}) as m_{c}, stddev_pop({c}) as s_{c}" for c in SCALED)
    steps = [
        f"st as (select {stats} from features)",
        "z as materialized (select id, label, "
        + ", ".join(f"({c} - m_{c}) / s_{c} as {c}" for c in SCALED)
        + " from features, st)",
        "w0 as (select " + ", ".join(f"0.0::double as w_{c}" for c in SCALED) + ")",
    ]
    margin = " + ".join(f"w_{c} * {c}" for c in SCALED)
    for t in range(1, iterations + 1):
        rate = f"(1.0::double / sqrt({t}))"
        sums = ", ".join(
            f"sum(case when (2 * label - 1) * ({margin}) < 1 then -(2 * label - 1) * {c} else 0 end) / count(*) as g_{c}"
            for c in SCALED
        )
        steps.append(f"g{t} as materialized (select {sums} from z, w{t - 1})")
        if penalty == "l1":
            cells = ", ".join(
                f"sign(w_{c} - {rate} * g_{c}) * greatest(0, abs(w_{c} - {rate} * g_{c}) - {regularisation}::double * {rate}) as w_{c}"
                for c in SCALED
            )
        else:
            cells = ", ".join(f"w_{c} * (1 - {rate} * {regularisation}::double) - {rate} * g_{c} as w_{c}" for c in SCALED)
        steps.append(f"w{t} as materialized (select {cells} from w{t - 1}, g{t})")
    return ", " + ", ".join(steps)


def weights_select(iterations: int) -> str:
    return " union all ".join(f"select '{c}' as feature, round(w_{c}, 5) as weight from w{iterations}" for c in SCALED)


def weight_rows(t, weights):
    rows = [(c, float(w)) for c, w in zip(SCALED, weights)]
    return t.spark.createDataFrame(rows, "feature string, weight double").select(
        "feature", F.round("weight", 5).alias("weight")
    )


@query("m1_linear_svm_weights", with_features(svm_sql(5, 0.1, "l2") + weights_select(5)))
def m1(t):
    data = materialise(scaled_features(t), "scaled")
    weights = L.svm_weights(data, "label", SCALED, iterations=5, regularisation=0.1)
    return weight_rows(t, weights)


# The headline job: 200 steps of size 1.0, without penalty or with the L1 one.
SVM_STEPS = 200


def svm_recursion_sql(iterations: int, regularisation: float, penalty: str) -> str:
    """The same steps as a recursion over (t, weights)."""
    stats = ", ".join(f"avg({c}) as m_{c}, stddev_pop({c}) as s_{c}" for c in SCALED)
    scaled = ", ".join(f"({c} - m_{c}) / s_{c} as {c}" for c in SCALED)
    names, rate = ", ".join(f"w_{c}" for c in SCALED), "(1.0::double / sqrt(t + 1))"
    margin = " + ".join(f"w_{c} * {c}" for c in SCALED)
    sums = ", ".join(
        f"sum(case when (2 * label - 1) * ({margin}) < 1 then -(2 * label - 1) * {c} else 0 end) / count(*) as g_{c}" for c in SCALED
    )
    if penalty == "l1":
        moved = {c: f"(w_{c} - {rate} * g_{c})" for c in SCALED}
        cells = ", ".join(f"sign({m}) * greatest(0, abs({m}) - {regularisation}::double * {rate}) as w_{c}" for c, m in moved.items())
    else:
        cells = ", ".join(f"w_{c} * (1 - {rate} * {regularisation}::double) - {rate} * g_{c} as w_{c}" for c in SCALED)
    body = f""", st as (select {stats} from features), z as materialized (select id, label, {scaled} from features, st),
      w(t, {names}) as (select 0, {', '.join('0.0::double' for _ in SCALED)}
        union all
        select t + 1, {cells} from (select t, {names}, {sums} from w, z where t < {iterations} group by t, {names}))
      """
    last = " union all ".join(f"select '{c}' as feature, round(w_{c}, 5) as weight from w where t = {iterations}" for c in SCALED)
    return with_features(body + last).replace("with", "with recursive", 1)


@query("m1_linear_svm_200_steps", svm_recursion_sql(SVM_STEPS, 0.0, "l2"))
def m1_steps(t):
    data = materialise(scaled_features(t), "scaled")
    return weight_rows(t, L.svm_weights(data, "label", SCALED, iterations=SVM_STEPS))


@query("m2_l1_svm_200_steps", svm_recursion_sql(SVM_STEPS, 0.02, "l1"))
def m2_steps(t):
    data = materialise(scaled_features(t), "scaled")
    return weight_rows(t, L.svm_weights(data, "label", SCALED, iterations=SVM_STEPS, regularisation=0.02, penalty="l1"))


@query("m1_linear_svm_solver")
def m1_solver(t):
    data = L.training_table(scaled_features(t), SCALED)
    model = LinearSVC(maxIter=20, regParam=0.1, fitIntercept=False).fit(data)
    return model.transform(data).select("id", "label", "prediction")


@query("m2_l1_svm_weights", with_features(svm_sql(5, 0.02, "l1") + weights_select(5)))
def m2(t):
    data = materialise(scaled_features(t), "scaled")
    weights = L.svm_weights(data, "label", SCALED, iterations=5, regularisation=0.02, penalty="l1")
    return weight_rows(t, weights)


MARGIN_SQL = " + ".join(f"w_{c} * {c}" for c in SCALED)


@query(
    "m3_threshold_and_raw_scores",
    with_features(svm_sql(3, 0.0, "l2") + f"""select id, round({MARGIN_SQL}, 5) as score,
        case when {MARGIN_SQL} > 0 then 1.0::double else 0.0::double end as prediction from z, w3"""),
)
def m3(t):
    data = materialise(scaled_features(t), "scaled")
    weights = L.svm_weights(data, "label", SCALED, iterations=3)
    scored = L.with_scores(data, SCALED, weights, threshold=0.0)
    return scored.select("id", F.round("score", 5).alias("score"), "prediction")


@query("m4_logistic_regression")
def m4(t):
    data = L.training_table(scaled_features(t), SCALED)
    model = LogisticRegression(maxIter=50).fit(data)
    return SC.probability_of(model.transform(data)).select("id", "label", "score", "prediction")


@query(
    "m4_logistic_optimality",
    " union all ".join(f"select '{c}' as feature, 0.0::double as gradient" for c in SCALED),
)
def m4_optimality(t):
    """At the solution the mean gradient of every weight vanishes."""
    data = L.training_table(scaled_features(t), SCALED)
    model = LogisticRegression(maxIter=100, tol=1e-9).fit(data)
    scored = model.transform(data).withColumn("gap", vector_to_array("probability")[1] - F.col("label"))
    means = scored.agg(*[F.abs(F.round(F.avg(F.col("gap") * F.col(c)), 4)).alias(c) for c in SCALED])
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("gradient")) for c in SCALED])
    return means.select(F.inline(cells))


@query(
    "m5_linear_regression",
    """select round(regr_slope(l_extendedprice, l_quantity), 3) as slope,
         round(regr_intercept(l_extendedprice, l_quantity), 3) as intercept from lineitem""",
)
def m5(t):
    data = L.training_table(t.lineitem.select(F.col("l_extendedprice").alias("label"), "l_quantity"), ["l_quantity"])
    model = LinearRegression(solver="normal").fit(data)
    row = [(float(model.coefficients[0]), float(model.intercept))]
    line = t.spark.createDataFrame(row, "slope double, intercept double")
    return line.select(F.round("slope", 3).alias("slope"), F.round("intercept", 3).alias("intercept"))


@query("m6_random_forest")
def m6(t):
    data = materialise(order_features(t), "features")
    model = SC.train_forest(data, FEATURES, trees=20, depth=5)
    return SC.score(data, model, FEATURES).select("id", "label", "prediction")


@query("m7_gradient_boosted_trees")
def m7(t):
    data = L.training_table(order_features(t), FEATURES)
    model = GBTClassifier(maxIter=5, maxDepth=5, seed=7).fit(data)
    return model.transform(data).select("id", "label", "prediction")


@query("m8_decision_tree_classifier")
def m8(t):
    data = L.training_table(order_features(t), FEATURES)
    model = DecisionTreeClassifier(maxDepth=5, impurity="gini", seed=7).fit(data)
    return model.transform(data).select("id", "label", "prediction")


@query("m9_decision_tree_regressor")
def m9(t):
    data = L.training_table(order_features(t), FEATURES[:-1]).withColumn("label", F.col("total"))
    model = DecisionTreeRegressor(maxDepth=5, impurity="variance", seed=7).fit(data)
    return model.transform(data).select("id", F.round("prediction", 2).alias("prediction"))


@query(
    "m10_naive_bayes",
    with_features(
        """, s as (select label, count(*) as n, """
        + ", ".join(f"sum({c}) as {c}" for c in FEATURES)
        + f""" from features group by label), f as (select *, {' + '.join(FEATURES)} as whole from s)
        select label, feature, round(ln(n + 1) - ln((select sum(n) from s) + 2), 5) as prior,
          round(ln(v + 1) - ln(whole + 6), 5) as theta from ("""
        + " union all ".join(f"select label, n, whole, '{c}' as feature, {c} as v from f" for c in FEATURES)
        + ")"
    ),
)
def m10(t):
    data = L.training_table(order_features(t), FEATURES)
    model = NaiveBayes(smoothing=1.0, modelType="multinomial").fit(data)
    theta, prior = model.theta.toArray(), model.pi.toArray()
    rows = [
        (float(i), name, float(prior[i]), float(theta[i][j]))
        for i in range(len(prior))
        for j, name in enumerate(FEATURES)
    ]
    table = t.spark.createDataFrame(rows, "label double, feature string, prior double, theta double")
    return table.select("label", "feature", F.round("prior", 5).alias("prior"), F.round("theta", 5).alias("theta"))


def lloyd_sql(rounds: int) -> str:
    steps = [
        "p as materialized (select vec_id, embedding::double[] as x from embeddings)",
        """c0 as (select 0 as cluster, x from p where vec_id = (select min(vec_id) from p)
             union all select 1, x from p where vec_id = (select max(vec_id) from p))""",
    ]
    for i in range(1, rounds + 1):
        steps.append(
            f"""a{i} as materialized (select vec_id, min_by(cluster, (d, cluster)) as cluster from (
              select p.vec_id, c.cluster, list_distance(p.x, c.x) as d from p, c{i - 1} c) group by vec_id)"""
        )
        steps.append(
            f"""c{i} as materialized (select cluster, list(mean order by i) as x from (
              select cluster, i, avg(v) as mean from (select a.cluster, unnest(generate_series(1, 64)) as i, unnest(p.x) as v
              from p join a{i} a on a.vec_id = p.vec_id) group by cluster, i) group by cluster)"""
        )
    return "with " + ", ".join(steps)


@query(
    "m11_lloyd_rounds",
    lloyd_sql(4) + """, final as (select p.vec_id, min_by(cluster, (list_distance(p.x, c.x), cluster)) as cluster
        from p, c4 c group by p.vec_id) select vec_id, cluster from final""",
)
def m11(t):
    points = t.embeddings.select("vec_id", V.as_doubles(F.col("embedding")).alias("features"))
    ends = points.agg(F.min_by("features", "vec_id").alias("a"), F.max_by("features", "vec_id").alias("b")).first()
    centres = L.lloyd(points, "features", [ends["a"], ends["b"]], rounds=4)
    return points.select("vec_id", L.nearest_centre("features", centres)["cluster"].alias("cluster"))


@query("m11_kmeans_solver")
def m11_solver(t):
    points = materialise(t.embeddings.select("vec_id", array_to_vector(V.as_doubles(F.col("embedding"))).alias("features")))
    model = KMeans(k=2, maxIter=20, seed=7).fit(points)
    return model.transform(points).select("vec_id", F.col("prediction").alias("cluster"))


@query("m11_kmeans_assignment", "select count(*) as n, 0::bigint as misplaced from embeddings")
def m11_assignment(t):
    """Every vector sits with the nearest centre the solver found."""
    points = t.embeddings.select(V.as_doubles(F.col("embedding")).alias("x"))
    points = materialise(points.withColumn("features", array_to_vector("x")))
    model = KMeans(k=2, maxIter=20, seed=7).fit(points)
    nearest = L.nearest_centre("x", [c.tolist() for c in model.clusterCenters()])["cluster"]
    placed = model.transform(points)
    return placed.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("prediction") != nearest).alias("misplaced"))


@query("m12_als")
def m12(t):
    observed = ratings(t).select(F.col("user").cast("int").alias("user"), F.col("item").cast("int").alias("item"), "rate")
    observed = materialise(observed, "ratings")
    als = ALS(rank=10, maxIter=20, regParam=0.01, userCol="user", itemCol="item", ratingCol="rate", seed=7)
    return als.fit(observed).transform(observed).select("user", "item", "rate", F.round("prediction", 3).alias("prediction"))


@query(
    "m12_als_normal_equations",
    f"""with {RATINGS_SQL} select count(distinct "user") as users, count(*) as n, 0::bigint as users_off from ratings""",
)
def m12_optimal(t):
    """Given the item factors, every user's factor solves its regularised normal equations.

    The last half step of the solver fits the users.  Per user one aggregate
    sums (u v - r) v over its ratings; with rank numbers per user this is the
    gradient but for the penalty, which weighs a user by its ratings.
    """
    rank, penalty = 10, 0.01
    observed = materialise(ratings(t).select(F.col("user").cast("int").alias("user"), F.col("item").cast("int").alias("item"), "rate"), "ratings")
    model = ALS(rank=rank, maxIter=20, regParam=penalty, userCol="user", itemCol="item", ratingCol="rate", seed=7).fit(observed)
    user, item = (f.select(F.col("id").cast("int").alias(k), F.col("features").alias(n)) for f, k, n in ((model.userFactors, "user", "u"), (model.itemFactors, "item", "v")))
    # items first, as floats: the rows then go to their user once, where they meet its factor and are summed
    pairs = observed.join(item, "item").join(user, "user")
    pairs = pairs.withColumns({"u": V.as_doubles(F.col("u")), "v": V.as_doubles(F.col("v"))})
    gap = V.dot(F.col("u"), F.col("v")) - F.col("rate")
    pull = pairs.withColumn("gap", gap).select("user", "u", F.abs("rate").alias("size"), "v", F.transform("v", lambda x: x * F.col("gap")).alias("pull"))
    sums = pull.groupBy("user").agg(
        vector_to_array(Summarizer.sum(array_to_vector("pull"))).alias("pull"),
        F.first("u").alias("u"), F.count(F.lit(1)).alias("n"), F.sum(F.col("size") * V.norm(F.col("v"))).alias("size"),
    )
    gradient = F.zip_with("pull", "u", lambda p, u: p + u * penalty * F.col("n"))
    # factors are stored as floats: seven digits of the terms' size
    off = V.norm(gradient) > 1e-4 * (F.col("size") + 1)
    judged = sums.select("n", off.alias("off"))
    return judged.agg(F.count(F.lit(1)).alias("users"), F.sum("n").alias("n"), F.count_if("off").alias("users_off"))


@query(
    "m13_kernels",
    """with c as (select label, unnest(generate_series(1, 64)) as i, embedding from embeddings),
         m as (select label, i, avg(embedding[i]::double) as mean from c group by label, i),
         centre as (select label, list(mean order by i) as y from m group by label),
         v as (select vec_id, embedding::double[] as x, y from embeddings join centre on centre.label = embeddings.label)
       select vec_id, round(list_inner_product(x, y), 5) as linear, round(exp(-0.5 * pow(list_distance(x, y), 2)), 5) as gaussian,
         round(pow(list_inner_product(x, y) + 1, 2), 5) as polynomial, round(list_inner_product(x, y), 5) as unknown from v""",
)
def m13(t):
    """Every kernel between a vector and the mean of its label."""
    points = t.embeddings.select("vec_id", "label", V.as_doubles(F.col("embedding")).alias("x"))
    means = L.mean_vectors(points, "label", "x")
    pairs = lookup_join(points, means, "label")
    x, y = F.col("x"), F.col("mean")
    names = ("linear", "gaussian", "polynomial", "unknown")
    return pairs.select("vec_id", *[F.round(V.kernel(n)(x, y), 5).alias(n) for n in names])


# Kernel SVM on the embeddings: labels below five are the positive class.
STEPS, REGULARISATION = 12, 0.05


def embedding_points(t):
    return t.embeddings.select("vec_id", (F.col("label") < 5).cast("int").alias("target"), "embedding")


def kernel_model(t):
    return K.train_kernel_svm(
        embedding_points(t), "vec_id", "target", "embedding", STEPS, REGULARISATION, kernel="gaussian", biased=True
    )


def kernel_svm_sql(steps: int, regularisation: float) -> str:
    """CTEs ending in ``sv`` (key, y, x, alpha); x carries the bias slot."""
    parts = [
        """pts as materialized (select vec_id, case when label < 5 then 1.0::double else -1.0::double end as y,
             list_append(embedding::double[], 1.0::double) as x from embeddings)""",
        "drawn as materialized ("
        + " union all ".join(
            f"select * from (select {i} as t, vec_id, y, x from pts order by md5(vec_id::varchar || ':{42 + i}'), vec_id limit 1)"
            for i in range(1, steps + 1)
        )
        + ")",
        """pull as materialized (select a.t, b.t as j, b.y * exp(-0.5 * pow(list_distance(a.x, b.x), 2)) as v
             from drawn a join drawn b on b.t < a.t and b.vec_id <> a.vec_id)""",
        "kept0 as (select 0 as t where false)",
    ]
    for i in range(1, steps + 1):
        parts.append(
            f"""kept{i} as materialized (select t from kept{i - 1} union all select t from drawn where t = {i}
              and coalesce((select sum(v) from pull where pull.t = {i} and j in (select t from kept{i - 1})), 0)
                * y / ({regularisation}::double * {i}) < 1)"""
        )
    parts.append(
        f"""sv as (select vec_id as key, any_value(y) as y, any_value(x) as x, count(*)::double as alpha
          from drawn where t in (select t from kept{steps}) group by vec_id)"""
    )
    return "with " + ", ".join(parts)


@query("m14_kernel_svm_training", kernel_svm_sql(STEPS, REGULARISATION) + " select key, y, alpha from sv")
def m14(t):
    return kernel_model(t).support_table(t.spark)


@query(
    "m15_kernel_svm_scoring",
    kernel_svm_sql(STEPS, REGULARISATION) + f""", scored as (select p.vec_id,
          sum(s.alpha * s.y * exp(-0.5 * pow(list_distance(p.x, s.x), 2))) / ({REGULARISATION}::double * {STEPS}) as margin
          from pts p, sv s group by p.vec_id)
        select vec_id, round(margin, 5) as margin, case when margin > 0 then 1.0::double else 0.0::double end as prediction
        from scored""",
)
def m15(t):
    scored = K.score_kernel_svm(embedding_points(t), kernel_model(t), "embedding")
    return scored.select("vec_id", F.round("margin", 5).alias("margin"), "prediction")


# The headline job: 200 draws, by position.
DRAWS = 200


def kernel_model_200(t):
    return K.train_kernel_svm(
        embedding_points(t), "vec_id", "target", "embedding", DRAWS, REGULARISATION, "gaussian", True, draw=positioned_draws
    )


def positions_sql(draws: int, rows: str) -> str:
    """(t, pos) of each draw over a table of ``rows`` rows."""
    return f"""select t, ('0x' || substr(md5((t + 42)::varchar), 1, 15))::bigint % (select count(*) from {rows}) as pos
        from range(1, {draws + 1}) as r(t)"""


KERNEL_200_SQL = f"""with recursive
  pts as materialized (select vec_id, row_number() over (order by vec_id) - 1 as pos,
    case when label < 5 then 1.0::double else -1.0::double end as y, list_append(embedding::double[], 1.0::double) as x from embeddings),
  drawn as materialized (select t, vec_id, y, x from ({positions_sql(DRAWS, 'embeddings')}) join pts using (pos)),
  pulls as materialized (select a.t, list(case when a.vec_id = b.vec_id then 0.0::double
      else b.y * exp(-0.5 * pow(list_distance(a.x, b.x), 2)) end order by b.t) as v
    from drawn a join drawn b on b.t < a.t group by a.t),
  steps(t, alpha) as (
    select 1::bigint, [1.0::double]
    union all
    select s.t + 1, list_append(alpha, case when list_inner_product(alpha, v) * y / ({REGULARISATION}::double * (s.t + 1)) < 1
      then 1.0::double else 0.0::double end)
    from steps s join pulls on pulls.t = s.t + 1 join drawn d on d.t = s.t + 1),
  sv as (select vec_id as key, any_value(y) as y, any_value(x) as x, sum(alpha) as alpha from (
      select d.*, (select alpha from steps where steps.t = {DRAWS})[d.t] as alpha from drawn d) group by vec_id having sum(alpha) > 0)
"""


@query("m14_kernel_svm_200_draws", KERNEL_200_SQL + " select key, y, alpha from sv")
def m14_200(t):
    return kernel_model_200(t).support_table(t.spark)


@query(
    "m15_kernel_svm_200_scoring",
    KERNEL_200_SQL + f""", scored as (select p.vec_id,
          sum(s.alpha * s.y * exp(-0.5 * pow(list_distance(p.x, s.x), 2))) / ({REGULARISATION}::double * {DRAWS}) as margin
          from pts p, sv s group by p.vec_id)
        select vec_id, round(margin, 5) as margin, case when margin > 0 then 1.0::double else 0.0::double end as prediction
        from scored""",
)
def m15_200(t):
    scored = K.score_kernel_svm(embedding_points(t), kernel_model_200(t), "embedding")
    return scored.select("vec_id", F.round("margin", 5).alias("margin"), "prediction")


@query("b7_positioned_draws", f"select t as draw, vec_id, label from ({positions_sql(DRAWS, 'embeddings')}) join (select *, row_number() over (order by vec_id) - 1 as pos from embeddings) using (pos)")
def b7_positioned(t):
    """200 draws from one numbering of the keys."""
    return positioned_draws(t.embeddings, "vec_id", ["label"], draws=DRAWS)


@query(
    "j10_pairs_with_small_set",
    "with drawn as ("
    + " union all ".join(
        f"select * from (select {i} as draw, embedding::double[] as y from embeddings order by md5(vec_id::varchar || ':{42 + i}'), vec_id limit 1)"
        for i in range(1, 9)
    )
    + """) select vec_id, round(sum(pow(list_inner_product(embedding::double[], y) + 1, 2)), 5) as similarity
       from embeddings, drawn group by vec_id""",
)
def j10(t):
    """Summed polynomial kernel of every vector with eight drawn ones."""
    drawn = seeded_draws(t.embeddings, "vec_id", ["embedding"], draws=8).orderBy("draw").collect()
    small = K.KernelModel(
        keys=tuple(r["draw"] for r in drawn),
        y=np.ones(len(drawn)),
        x=np.array([r["embedding"] for r in drawn], dtype=float),
        alpha=np.ones(len(drawn)),
        kernel="polynomial",
        biased=False,
        scale=1.0,
    )
    margin = K.kernel_margin(small, F.col("embedding"))
    return t.embeddings.select("vec_id", F.round(margin, 5).alias("similarity"))


@query("m16_batch_predict")
def m16(t):
    """Fit on one hash part, predict the other."""
    data = materialise(order_features(t), "features").withColumn("part", hash_part(F.col("id"), [7, 3]))
    model = SC.train_forest(data.filter("part = 0"), FEATURES, trees=5, depth=4)
    return SC.score(data.filter("part = 1"), model, FEATURES).select("id", "label", "prediction")


def scoring_populations(t):
    """(finished and open orders with their label, pending orders)."""
    rows = materialise(order_features(t).join(t.orders.select(F.col("o_orderkey").alias("id"), "o_orderstatus"), "id"))
    train = rows.filter("o_orderstatus <> 'P'").select("id", "label", *FEATURES)
    return train, rows.filter("o_orderstatus = 'P'").select("id", *FEATURES)


@query("m17_score_and_export")
def m17(t):
    """Train on finished and open orders, score the pending ones, keep the predicted positives."""
    train, population = scoring_populations(t)
    path = scratch_path(t.spark, "chosen")
    return SC.score_and_export(train, population, "id", FEATURES, path, trees=10, depth=8)


@query(
    "m17_export_is_whole",
    with_features("""select count(*) as scored, 0::bigint as missing, 0::bigint as extra
        from features join orders on o_orderkey = id where o_orderstatus = 'P'"""),
)
def m17_whole(t):
    """Exported keys are those that the saved model predicts positive: none missing, none extra."""
    train, population = scoring_populations(t)
    model = scratch_path(t.spark, "model")
    chosen = SC.score_and_export(
        train, population, "id", FEATURES, scratch_path(t.spark, "chosen"), model_path=model, trees=10, depth=8
    )
    scored = SC.score(population, SC.load_model(model), FEATURES).select("id", F.col("prediction").alias("again"))
    both = scored.join(chosen, "id", "full").select(
        F.col("again").isNotNull().alias("known"), (F.col("again") == 1).alias("wanted"), F.col("prediction").isNotNull().alias("given")
    )
    return both.agg(
        F.count_if("known").alias("scored"),
        F.count_if(F.col("wanted") & ~F.col("given")).alias("missing"),
        F.count_if(F.col("given") & ~F.coalesce("wanted", F.lit(False))).alias("extra"),
    )


@query("m18_model_dump")
def m18(t):
    data = L.training_table(order_features(t), FEATURES)
    model = DecisionTreeClassifier(maxDepth=4, seed=7).fit(data)
    return SC.describe_trees(model, FEATURES, t.spark)


@query("m19_indexed_forest")
def m19(t):
    """Index the label text, index features, train, and give the label text back."""
    rows = order_features(t).join(t.orders.select(F.col("o_orderkey").alias("id"), "o_orderstatus"), "id").drop("label")
    data = L.training_table(rows, FEATURES, "raw")
    labels = StringIndexer(inputCol="o_orderstatus", outputCol="label").fit(data)
    stages = [
        labels,
        VectorIndexer(inputCol="raw", outputCol="features", maxCategories=4),
        RandomForestClassifier(numTrees=10, maxDepth=5, seed=7),
        IndexToString(inputCol="prediction", outputCol="guess", labels=labels.labels),
    ]
    return Pipeline(stages=stages).fit(data).transform(data).select("id", "o_orderstatus", "guess")


@query("m20_grid_search")
def m20(t):
    """Term-hash and regularisation grid over two hash folds of the labelled documents.

    Texts are split and hashed once, one column per width: a fit reads the
    vectors of its own width, never the texts.
    """
    texts = t.documents.select("doc_id", "text").join(t.labels.select("doc_id", F.col("quality").cast("double").alias("label")), "doc_id")
    terms = Tokenizer(inputCol="text", outputCol="words").transform(texts.withColumn("fold", hash_part(F.col("doc_id"), [1, 1])))
    widths = [10, 100, 1000]
    for width in widths:
        terms = HashingTF(inputCol="words", outputCol=f"terms{width}", numFeatures=width).transform(terms)
    data = materialise(terms.drop("text", "words"), "folds")
    regression = LogisticRegression(maxIter=5)
    grid = (
        ParamGridBuilder()
        .addGrid(regression.featuresCol, [f"terms{width}" for width in widths])
        .addGrid(regression.regParam, [0.1, 0.01])
        .build()
    )
    search = CrossValidator(
        estimator=regression,
        estimatorParamMaps=grid,
        evaluator=BinaryClassificationEvaluator(),
        numFolds=2,
        foldCol="fold",
    )
    best = search.fit(data).bestModel
    return best.transform(data).select("doc_id", "label", "prediction")


@query("m20_grid_search_10_steps")
def m20_headline(t):
    """The grid at ten steps a fit: every cell with its mean area over the folds, and which one was chosen.  Words are split once."""
    words = Tokenizer(inputCol="text", outputCol="words").transform(t.documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    texts = words.join(t.labels.select("doc_id", F.col("quality").cast("double").alias("label")), "doc_id")
    data = materialise(texts.select("words", "label", hash_part(F.col("doc_id"), [1, 1]).cast("int").alias("fold")), "folds")
    _, cells = SC.text_grid_search(data, [10, 100, 1000], [0.1, 0.01], iterations=10)
    return cells.withColumn("area", F.round("area", 4))


@query("m21_single_prediction")
def m21(t):
    """One hand-built sparse vector under a model of the whole table."""
    data = L.training_table(order_features(t), FEATURES)
    model = GBTClassifier(maxIter=3, maxDepth=4, seed=7).fit(data)
    probe = t.spark.createDataFrame([(Vectors.sparse(len(FEATURES), [0, 5], [3.0, 250000.0]),)], ["features"])
    return model.transform(probe).select("prediction", F.round(vector_to_array("probability")[1], 6).alias("score"))


@query("k5_model_persistence", with_features("select count(*) as n, 0::bigint as differing from features"))
def k5(t):
    data = materialise(order_features(t), "features")
    model = SC.train_forest(data, FEATURES, trees=5, depth=4)
    path = scratch_path(t.spark, "model")
    SC.save_model(model, path)
    before = SC.score(data, model, FEATURES).select("id", F.col("prediction").alias("before"))
    after = SC.score(data, SC.load_model(path), FEATURES).select("id", F.col("prediction").alias("after"))
    return before.join(after, "id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("before") != F.col("after")).alias("differing")
    )
