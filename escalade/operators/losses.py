"""Training losses and metrics as aggregations.

Each loss is one ``agg`` over a (prediction, label) or (score_preferred, score_non_preferred) table: partial
aggregation per partition, a one-row result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from escalade.functions.joins import attach_row
from escalade.functions.scores import binary_prediction

LOG_CLAMP = -100.0  # log terms are clamped like the reference's binary cross-entropy


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bce_terms(pred: Column | str, label: Column | str, pos_weight: float = 1.0) -> Column:
    """Per-row weighted binary cross-entropy; weight = pos_weight when label = 1."""
    p, y = _c(pred).cast("double"), _c(label).cast("double")
    w = F.when(y == 1.0, F.lit(float(pos_weight))).otherwise(F.lit(1.0))
    lp = F.greatest(F.ln(p), F.lit(LOG_CLAMP))          # Spark ln(0) is NULL; greatest skips it -> clamp
    lq = F.greatest(F.ln(F.lit(1.0) - p), F.lit(LOG_CLAMP))
    return w * -(y * lp + (F.lit(1.0) - y) * lq)


def weighted_bce(df: DataFrame, pred: str = "pred", label: str = "label", pos_weight: float = 1.0) -> DataFrame:
    """Mean weighted BCE over rows with a prediction (NULL predictions are excluded)."""
    v = df.where(F.col(pred).isNotNull() & ~F.isnan(pred))
    return v.agg(F.avg(bce_terms(pred, label, pos_weight)).alias("loss"), F.count(F.lit(1)).alias("n"))


def bt_terms(s_pref: Column | str, s_non: Column | str, margin: float = 0.0) -> Column:
    """-log sigmoid(sp - sn - margin) in the stable form log1p(exp(-|d|)) + max(-d, 0)."""
    d = _c(s_pref).cast("double") - _c(s_non).cast("double") - F.lit(float(margin))
    return F.log1p(F.exp(-F.abs(d))) + F.greatest(-d, F.lit(0.0))


def bradley_terry_loss(df: DataFrame, s_pref: str = "score_preferred", s_non: str = "score_non_preferred",
                       margin: float = 0.0) -> DataFrame:
    """Mean Bradley-Terry loss."""
    return df.agg(F.avg(bt_terms(s_pref, s_non, margin)).alias("loss"), F.count(F.lit(1)).alias("n"))


def margin_ranking_loss(df: DataFrame, s_pref: str = "score_preferred", s_non: str = "score_non_preferred",
                        margin: float = 0.1) -> DataFrame:
    """Mean max(0, margin - (sp - sn))."""
    d = F.col(s_pref) - F.col(s_non)
    return df.agg(F.avg(F.greatest(F.lit(float(margin)) - d, F.lit(0.0))).alias("loss"), F.count(F.lit(1)).alias("n"))


def combined_loss(adequacy: DataFrame, pairwise: DataFrame, wa: float = 1.0, wp: float = 1.0,
                  pred: str = "pred", label: str = "label", pos_weight: float = 1.0,
                  s_pref: str = "score_preferred", s_non: str = "score_non_preferred", margin: float = 0.0) -> DataFrame:
    """total = wa * A17 + wp * A18, with both components."""
    a = weighted_bce(adequacy, pred, label, pos_weight).select(F.col("loss").alias("adequacy_loss"))
    p = bradley_terry_loss(pairwise, s_pref, s_non, margin).select(F.col("loss").alias("pairwise_loss"))
    j = attach_row(a, p)
    return j.select((F.lit(float(wa)) * F.col("adequacy_loss") + F.lit(float(wp)) * F.col("pairwise_loss"))
                    .alias("total_loss"), "adequacy_loss", "pairwise_loss")


def binary_metrics(df: DataFrame, pred: str = "pred", label: str = "label", batch: str | None = None,
                   pos_weight: float = 1.0) -> DataFrame:
    """Loss and accuracy (prediction > 0.5 equals the label).

    ``batch=None``: row means. With a batch column: mean of per-batch means (the reference's epoch metric,
    biased by a short last batch), as two aggregation levels.
    """
    v = df.where(F.col(pred).isNotNull() & ~F.isnan(pred))
    correct = (binary_prediction(pred) == F.col(label).cast("double")).cast("double")
    rows = v.select(*([batch] if batch else []), bce_terms(pred, label, pos_weight).alias("l"), correct.alias("c"))
    if batch is None:
        return rows.agg(F.avg("l").alias("loss"), F.avg("c").alias("accuracy"), F.count(F.lit(1)).alias("n"))
    per = rows.groupBy(batch).agg(F.avg("l").alias("l"), F.avg("c").alias("c"))
    return per.agg(F.avg("l").alias("loss"), F.avg("c").alias("accuracy"), F.count(F.lit(1)).alias("n"))
