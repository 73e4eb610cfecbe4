"""Views over the result tables of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules

# Metrics of the final model shown on the overview.
OVERVIEW = ("accuracy", "precision", "recall", "f1_score", "roc_auc", "specificity", "mcc")


def results_summary(profile: DataFrame, final: DataFrame, comparison: DataFrame | None = None) -> DataFrame:
    """One flat overview row from the one-row profile and final-metrics tables."""
    overview = profile.select("total_rows", "fraud_count", "legitimate_count", "fraud_ratio").join(
        F.broadcast(final.select(F.col("model").alias("best_model"), *OVERVIEW, "tn", "fp", "fn", "tp"))
    )  # one row on each side
    if comparison is not None:
        overview = overview.join(F.broadcast(comparison.agg(F.count("*").alias("models_compared"))))
    return overview


def top_features(importance: DataFrame, n: int = 10) -> DataFrame:
    return importance.orderBy(F.col("importance").desc(), "feature").limit(n)


def paired_cases(df: DataFrame, pair: Column, side: Column) -> DataFrame:
    """Side-by-side view of paired transactions with their factor counts.

    ``pair`` names the pair and ``side`` is 1 or 2; a pair has two rows.
    """
    factors = F.size(rules.risk_factors())
    cells = {"type": F.col("type"), "amount": F.col("amount"), "newbalanceOrig": F.col("newbalanceOrig"),
             "newbalanceDest": F.col("newbalanceDest"), "factors": factors}
    at = lambda value, s: F.max(F.when(side == s, value))
    return df.groupBy(pair.alias("pair")).agg(
        *[at(value, s).alias(f"{name}_{s}") for name, value in cells.items() for s in (1, 2)]
    ).withColumn("factor_gap", F.col("factors_1") - F.col("factors_2"))
