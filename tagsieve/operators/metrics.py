"""F1 over tags, for one or several models at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagsieve import config


def tag_outcomes(scored: DataFrame, threshold: float = config.CLASSIFICATION_THRESHOLD) -> DataFrame:
    """(model, idx, tp, fp, fn) from (model, idx, truth BOOLEAN, prob)."""
    said = F.col("prob") >= threshold
    true = F.col("truth")

    def count(condition):
        return F.sum(condition.cast("bigint"))

    return scored.groupBy("model", "idx").agg(
        count(true & said).alias("tp"), count(~true & said).alias("fp"), count(true & ~said).alias("fn")
    )


def _f1(tp, fp, fn):
    total = 2 * tp + fp + fn
    return F.when(total > 0, 2 * tp / total).otherwise(0.0)


def f1_metrics(scored: DataFrame, threshold: float = config.CLASSIFICATION_THRESHOLD) -> DataFrame:
    """(model, f1_macro, f1_micro, f1_weighted); an undefined F1 counts as 0."""
    per_tag = tag_outcomes(scored, threshold).select(
        "model", "tp", "fp", "fn", _f1(F.col("tp"), F.col("fp"), F.col("fn")).alias("f1")
    )
    support = F.col("tp") + F.col("fn")
    return per_tag.groupBy("model").agg(
        F.avg("f1").alias("f1_macro"),
        _f1(F.sum("tp"), F.sum("fp"), F.sum("fn")).alias("f1_micro"),
        F.coalesce(
            F.when(F.sum(support) > 0, F.sum(support * F.col("f1")) / F.sum(support)), F.lit(0.0)
        ).alias("f1_weighted"),
    )
