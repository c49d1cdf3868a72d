"""Evaluation queries (E1-E10) on a transparent score of the order features and of the labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.functions import vectors as V
from quillmesh.operators import evaluation as Q
from quillmesh.operators.learning import clustering_cost, mean_vectors
from quillmesh.plans.bindings import order_features, with_features
from quillmesh.plans.registry import query

SCORED_SQL = """, scored as (select id, label, round(total / 1000) as score,
      case when total > 250000 then 1.0::double else 0.0::double end as prediction from features)
    , cm as (select count(*)::double as n, count(*) filter (label <> prediction) as wrong,
      count(*) filter (label = 1 and prediction = 1) as tp, count(*) filter (label = 0 and prediction = 1) as fp,
      count(*) filter (label = 1 and prediction = 0) as fn, count(*) filter (label = 0 and prediction = 0) as tn
      from scored)"""


def scored(t):
    """Label, a score with many ties (order total in thousands) and a hard prediction."""
    total = F.col("total")
    return order_features(t).select(
        "id", "label", F.round(total / 1000).alias("score"), F.when(total > 250000, 1.0).otherwise(0.0).alias("prediction")
    )


def metric(t, name, positive=1):
    return Q.confusion_metrics(scored(t), positive=positive).select(F.round(name, 6).alias(name))


@query("e1_error_accuracy", with_features(SCORED_SQL + "select round(wrong / n, 6) as error, round((n - wrong) / n, 6) as accuracy from cm"))
def e1(t):
    row = Q.confusion_metrics(scored(t))
    return row.select(F.round("error", 6).alias("error"), F.round("accuracy", 6).alias("accuracy"))


@query("e2_precision", with_features(SCORED_SQL + "select round(tp::double / (tp + fp), 6) as precision from cm"))
def e2(t):
    return metric(t, "precision")


@query("e3_recall", with_features(SCORED_SQL + "select round(tp::double / (tp + fn), 6) as recall from cm"))
def e3(t):
    return metric(t, "recall")


AUC_SQL = """, ranked as (select label, avg(k) over (partition by score) as r from
      (select label, score, row_number() over (order by score) as k from scored))
    , sums as (select sum(r) filter (label = 1) as rs, count(*) filter (label = 1)::double as p,
      count(*) filter (label = 0)::double as q from ranked)
    select round((rs - p * (p + 1) / 2) / (p * q), 6) as area_under_roc from sums"""


@query("e4_area_under_roc", with_features(SCORED_SQL + AUC_SQL))
def e4(t):
    return Q.area_under_roc(scored(t)).select(F.round("area_under_roc", 6).alias("area_under_roc"))


@query("e4_area_under_roc_hard_labels", with_features(SCORED_SQL.replace("round(total / 1000) as score", "case when total > 250000 then 1.0::double else 0.0::double end as score") + AUC_SQL))
def e4_hard(t):
    return Q.area_under_roc(scored(t), score="prediction").select(F.round("area_under_roc", 6).alias("area_under_roc"))


@query(
    "e5_area_under_pr",
    with_features(SCORED_SQL + """, g as (select score, count(*) filter (label = 1)::double as pos,
          count(*)::double as n from scored group by score)
        , c as (select score, pos, sum(pos) over (order by score desc) as tp, sum(n) over (order by score desc) as seen from g)
        , p as (select score, pos, tp / seen as here, lag(tp / seen) over (order by score desc) as before from c)
        select round(sum(pos * (here + coalesce(before, here)) / 2) / sum(pos), 6) as area_under_pr from p"""),
)
def e5(t):
    return Q.area_under_pr(scored(t)).select(F.round("area_under_pr", 6).alias("area_under_pr"))


@query("e6_positive_rate", with_features(SCORED_SQL + "select round((tp + fp) / n, 6) as positive_rate from cm"))
def e6(t):
    return metric(t, "positive_rate")


@query(
    "e7_multiclass_accuracy",
    """select round(avg(case when (case when o_totalprice < 150000 then 'F' when o_totalprice < 300000 then 'O' else 'P' end)
         = o_orderstatus then 1.0::double else 0.0::double end), 6) as accuracy from orders""",
)
def e7(t):
    price = F.col("o_totalprice")
    guess = F.when(price < 150000, "F").when(price < 300000, "O").otherwise("P")
    rows = t.orders.select(F.col("o_orderstatus").alias("label"), guess.alias("prediction"))
    return Q.confusion_metrics(rows, positive="F").select(F.round("accuracy", 6).alias("accuracy"))


@query(
    "e8_within_set_squared_error",
    """with c as (select label, unnest(generate_series(1, 64)) as i, embedding from embeddings),
         m as (select label, i, avg(embedding[i]::double) as mean from c group by label, i),
         centre as (select label, list(mean order by i) as mean from m group by label)
       select round(sum(best), 4) as cost from (
         select vec_id, min(pow(list_distance(embedding::double[], mean), 2)) as best from embeddings, centre group by vec_id)""",
)
def e8(t):
    """Squared distance of every vector to the nearest of the ten label means."""
    points = t.embeddings.select("label", V.as_doubles(F.col("embedding")).alias("features"))
    centres = [row["mean"] for row in mean_vectors(points, "label", "features").collect()]
    return clustering_cost(points, "features", centres).select(F.round("cost", 4).alias("cost"))


@query(
    "e9_regression_mse",
    """with m as (select regr_slope(l_extendedprice, l_quantity) as a, regr_intercept(l_extendedprice, l_quantity) as b from lineitem)
       select round(avg(pow((a * l_quantity + b - l_extendedprice) / 1000, 2)), 4) as mean_squared_error from lineitem, m""",
)
def e9(t):
    line = t.lineitem.agg(
        F.regr_slope("l_extendedprice", "l_quantity").alias("a"), F.regr_intercept("l_extendedprice", "l_quantity").alias("b")
    ).first()
    rows = t.lineitem.select(
        (F.col("l_extendedprice") / 1000).alias("label"),
        ((F.lit(line["a"]) * F.col("l_quantity") + F.lit(line["b"])) / 1000).alias("prediction"),
    )
    return Q.mean_squared_error(rows).select(F.round("mean_squared_error", 4).alias("mean_squared_error"))


@query(
    "e10_negative_class_metrics",
    with_features(SCORED_SQL + """select round(tn::double / (tn + fn), 6) as precision, round(tn::double / (tn + fp), 6) as recall,
        round((tn + fn) / n, 6) as positive_rate from cm"""),
)
def e10(t):
    row = Q.confusion_metrics(scored(t), positive=0)
    return row.select(*[F.round(c, 6).alias(c) for c in ("precision", "recall", "positive_rate")])
