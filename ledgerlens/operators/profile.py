"""Dataset profile, group profiles and column statistics: one aggregate each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.guards import ratio
from ..functions.rules import step_band
from ..schema import FLAG, LABEL, numeric_columns
from ..session import small_table


def profile_dataset(df: DataFrame) -> DataFrame:
    """One row: rows, columns, class counts and fraud ratio (0 for an empty table)."""
    fraud = F.coalesce(F.sum(F.col(LABEL).cast("bigint")), F.lit(0))
    return df.agg(F.count("*").alias("total_rows"), fraud.alias("fraud_count")).select(
        "total_rows",
        F.lit(len(df.columns)).alias("total_columns"),
        "fraud_count",
        (F.col("total_rows") - F.col("fraud_count")).alias("legitimate_count"),
        ratio(F.col("fraud_count"), F.col("total_rows")).alias("fraud_ratio"),
    )


def column_types(df: DataFrame) -> dict[str, str]:
    return dict(df.dtypes)


def _unpivot_row(row: DataFrame, columns: list[str], statistics: list[str]) -> DataFrame:
    """One wide aggregate row (``column__statistic``) as one row per column."""
    cells = [
        F.struct(F.lit(c).alias("column"), *[F.col(f"{c}__{s}").cast("double").alias(s) for s in statistics])
        for c in columns
    ]
    return row.select(F.inline(F.array(*cells)))


def profile_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Count, mean, sample std, min and max of every numeric column in one pass."""
    columns = columns or numeric_columns(df)
    measures = {
        "n": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max,
    }
    row = df.agg(*[f(c).alias(f"{c}__{s}") for c in columns for s, f in measures.items()])
    return _unpivot_row(row, columns, list(measures)).withColumn("n", F.col("n").cast("bigint"))


def null_share(df: DataFrame) -> DataFrame:
    """Share of nulls per column."""
    row = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(f"{c}__share") for c in df.columns])
    return _unpivot_row(row, df.columns, ["share"]).withColumn("share", F.coalesce("share", F.lit(0.0)))


def type_stats(df: DataFrame) -> DataFrame:
    """Rows, mean and sample standard deviation of the amount per type."""
    return df.groupBy("type").agg(
        F.count("*").alias("n"),
        F.avg("amount").alias("mean"),
        F.stddev_samp("amount").alias("std"),
    )


def share_by(df: DataFrame, column: str) -> DataFrame:
    """``value_counts(normalize=True)``: rows and share per value."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy()))


def type_risk_profile(df: DataFrame) -> DataFrame:
    """Rows and average amount per type and class."""
    return df.groupBy("type", LABEL).agg(
        F.count("*").alias("n"), F.avg("amount").alias("avg_amount"), F.max("amount").alias("max_amount")
    )


def step_bands(df: DataFrame) -> DataFrame:
    """Rows, fraud rows and fraud rate for the five documented hour ranges."""
    return (
        df.groupBy(step_band(F.col("step")).alias("band"))
        .agg(F.count("*").alias("n"), F.sum(F.col(LABEL).cast("bigint")).alias("fraud"))
        .withColumn("fraud_rate", ratio(F.col("fraud"), F.col("n")))
    )


def class_distribution(df: DataFrame) -> DataFrame:
    """Count and percentage per class."""
    counts = df.groupBy(LABEL).agg(F.count("*").alias("n"))
    return counts.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(W.partitionBy()))


def flag_vs_label(df: DataFrame) -> DataFrame:
    """The legacy rule flag against the label."""
    return df.groupBy(FLAG, LABEL).agg(F.count("*").alias("n"))


def diversity(df: DataFrame, columns: list[str] | None = None) -> Column:
    """Aggregate: mean over the numeric columns of their sample standard deviation."""
    columns = columns or numeric_columns(df)
    total = F.lit(0.0)
    for c in columns:
        total = total + F.coalesce(F.stddev_samp(c), F.lit(0.0))
    return total / len(columns)


def target_ratio_table(df: DataFrame, ratios: tuple[float, ...], max_rows: int) -> DataFrame:
    """Fraud, legitimate and total rows that each target fraud ratio implies."""
    counts = df.agg(
        F.sum(F.col(LABEL).cast("bigint")).alias("fraud"),
        F.count(F.when(F.col(LABEL) == 0, 1)).alias("available"),
    )
    wanted = small_table(df.sparkSession, [(float(r),) for r in ratios], {"target_ratio": "double"})
    room = F.greatest(F.lit(max_rows) - F.col("fraud"), F.lit(0))
    balanced = F.floor(F.try_divide(F.col("fraud") * (1 - F.col("target_ratio")), F.col("target_ratio")))
    budget = F.when((F.col("target_ratio") > 0) & (F.col("fraud") > 0), F.least(balanced, room)).otherwise(room)
    # Both sides are a handful of rows by construction.
    return counts.join(F.broadcast(wanted)).select(
        "target_ratio",
        "fraud",
        F.least(budget, F.col("available")).cast("bigint").alias("legit"),
        (F.col("fraud") + F.least(budget, F.col("available"))).cast("bigint").alias("total"),
    )
