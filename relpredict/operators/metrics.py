"""Exact, distributed quality metrics over scored rows ``(score, label)`` and ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relpredict.functions.quantiles import slicer

RANK_SLICES = 1024


def attach_labels(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """Predictions with their label where one is known."""
    keys = ["entity_id"] + (["cutoff"] if "cutoff" in predictions.columns else [])
    return predictions.join(labels.select(*keys, "label"), keys, "left")


def score_counts(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Positives and negatives per distinct score; ties collapse before any shuffle."""
    return _known(scored, score, label).groupBy(F.col(score).cast("double").alias("score")).agg(
        F.sum((F.col(label) == 1).cast("bigint")).alias("pos"),
        F.sum((F.col(label) == 0).cast("bigint")).alias("neg"),
    )


def roc_auc(scored: DataFrame, score: str = "score", label: str = "label", slices: int = RANK_SLICES) -> DataFrame:
    """One row ``(roc_auc, n_pos, n_neg)``; ``roc_auc`` is null when only one class is present.

    Mann-Whitney: each positive beats the negatives below it and half of those with its score.
    Distinct scores are cut into quantile slices, negatives are counted within a slice and carried
    over from the slices below, so no task ever orders all scores. The slice edges come from a
    mergeable sketch; they only decide who does the work, not the result.
    """
    counts = score_counts(scored, score, label)
    # the edges are estimated on raw scores, so that frequent scores are weighed
    raw = _known(scored, score, label).select(F.col(score).cast("double").alias("score"))
    sliced = slicer(raw, "score", slices, "_slice").transform(counts)
    inside = Window.partitionBy("_slice").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    within = sliced.withColumn("_below", F.coalesce(F.sum("neg").over(inside), F.lit(0)))
    per_slice = within.groupBy("_slice").agg(
        F.sum("pos").alias("pos"),
        F.sum("neg").alias("neg"),
        F.sum(F.col("pos") * (F.col("_below") + F.col("neg") / 2)).alias("_won"),
    )
    under = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # at most `slices` rows
    carried = per_slice.withColumn("_under", F.coalesce(F.sum("neg").over(under), F.lit(0)))
    total = carried.agg(
        F.coalesce(F.sum("pos"), F.lit(0)).alias("n_pos"),
        F.coalesce(F.sum("neg"), F.lit(0)).alias("n_neg"),
        F.sum(F.col("_won") + F.col("pos") * F.col("_under")).alias("_won"),
    )
    pairs = F.col("n_pos").cast("double") * F.col("n_neg")
    return total.select(F.when(pairs > 0, F.col("_won") / pairs).alias("roc_auc"), "n_pos", "n_neg")


def accuracy(scored: DataFrame, score: str = "score", label: str = "label", threshold: float = 0.5) -> DataFrame:
    hit = (F.col(score) >= threshold).cast("int") == F.col(label)
    return _known(scored, score, label).agg(F.avg(hit.cast("double")).alias("accuracy"))


def regression_errors(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """One row ``(mae, rmse)``."""
    gap = F.col(label) - F.col(score)
    return _known(scored, score, label).agg(
        F.avg(F.abs(gap)).alias("mae"), F.sqrt(F.avg(gap * gap)).alias("rmse")
    )


def brier(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    gap = F.col(score) - F.col(label)
    return _known(scored, score, label).agg(F.avg(gap * gap).alias("brier"))


def _known(scored: DataFrame, score: str, label: str) -> DataFrame:
    return scored.where(F.col(label).isNotNull() & F.col(score).isNotNull())


def bin_index(score: Column, n_bins: int = 10) -> Column:
    """Equal bins of [0, 1], closed on the left, the last one on both sides.

    Scores are compared with the edges; ``floor(score * n)`` is off by one at some of them.
    """
    edges = [i * (1.0 / n_bins) for i in range(1, n_bins)]
    return sum(((score >= edge).cast("int") for edge in edges), F.lit(0))


def reliability_bins(scored: DataFrame, n_bins: int = 10, score: str = "score", label: str = "label") -> DataFrame:
    """``(bin, n, mean_score, mean_label)`` per non-empty bin."""
    return (
        _known(scored, score, label)
        .groupBy(bin_index(F.col(score), n_bins).alias("bin"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(F.col(score)).alias("mean_score"),
            F.avg(F.col(label).cast("double")).alias("mean_label"),
        )
    )


def expected_calibration_error(
    scored: DataFrame, n_bins: int = 10, score: str = "score", label: str = "label"
) -> DataFrame:
    """One row ``(ece)``: the gap of each bin weighted by its share of rows."""
    gap = F.abs(F.col("mean_score") - F.col("mean_label"))
    bins = reliability_bins(scored, n_bins, score, label)
    return bins.agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"))


def evaluate(scored: DataFrame, classification: bool) -> dict[str, float]:
    """The report of a prediction run; a one-class label has no ``roc_auc``."""
    if not classification:
        return {k: v for k, v in regression_errors(scored).first().asDict().items() if v is not None}
    found = {"roc_auc": roc_auc(scored).first().roc_auc, "accuracy": accuracy(scored).first().accuracy}
    return {k: v for k, v in found.items() if v is not None}


def top(predictions: DataFrame, n: int = 10, ascending: bool = False) -> DataFrame:
    """The n best or worst rows by score; entities break ties. Runs as a top-k, not a full sort."""
    by_score = F.col("score").asc() if ascending else F.col("score").desc()
    return predictions.orderBy(by_score, "entity_id").limit(n)


def head(predictions: DataFrame, n: int = 5) -> DataFrame:
    return predictions.limit(n)
