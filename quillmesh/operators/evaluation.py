"""Classification, ranking and regression metrics, one pass each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.operators.ordering import prefix_sums


def confusion_metrics(
    df: DataFrame, label: str = "label", prediction: str = "prediction", positive: float = 1
) -> DataFrame:
    """One row of error, accuracy, precision, recall and predicted-positive rate for one class."""
    truth, guess = F.col(label) == positive, F.col(prediction) == positive
    counts = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(label) != F.col(prediction)).alias("wrong"),
        F.count_if(truth & guess).alias("tp"),
        F.count_if(~truth & guess).alias("fp"),
        F.count_if(truth & ~guess).alias("fn"),
    )

    def ratio(a: Column, b: Column) -> Column:
        return F.try_divide(a.cast("double"), b)

    n, tp, fp, fn = F.col("n"), F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        "n",
        ratio(F.col("wrong"), n).alias("error"),
        ratio(n - F.col("wrong"), n).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(tp + fp, n).alias("positive_rate"),
    )


def _score_groups(df: DataFrame, label: str, score: str) -> DataFrame:
    # Equal scores meet here, so a score many rows share is one row afterwards.
    return df.groupBy((-F.col(score)).alias("falling")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg")
    )


def area_under_roc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Exact area: share of (positive, negative) pairs in order, ties one half."""
    running = prefix_sums(_score_groups(df, label, score), "falling", ["pos", "neg"])
    # positives above a group beat its negatives; positives inside it tie with them
    wins = F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2.0)
    totals = running.agg(
        F.sum(wins).alias("wins"), F.sum("pos").cast("double").alias("p"), F.sum("neg").cast("double").alias("q")
    )
    return totals.select(F.try_divide(F.col("wins"), F.col("p") * F.col("q")).alias("area_under_roc"))


def area_under_pr(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Trapezoid area under precision over recall, starting at recall 0 with the top group's precision."""
    groups = _score_groups(df, label, score)
    running = prefix_sums(groups, "falling", ["pos", "neg"])
    here = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    before_p, before_n = F.col("cum_pos") - F.col("pos"), F.col("cum_neg") - F.col("neg")
    # the point before the first group takes that group's own precision
    before = F.coalesce(F.try_divide(before_p.cast("double"), before_p + before_n), here)
    piece = F.col("pos") * (here + before) / 2
    return running.agg(F.try_divide(F.sum(piece), F.sum("pos").cast("double")).alias("area_under_pr"))


def mean_squared_error(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    gap = F.col(label) - F.col(prediction)
    return df.agg(F.avg(gap * gap).alias("mean_squared_error"))
