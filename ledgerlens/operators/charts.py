"""Chart-ready tables: histograms, boxes, bars and labelled curves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.guards import label_title, ratio, short_label
from ..schema import LABEL
from ..session import small_table
from .evaluate import confusion, pr_curve, roc_curve
from .ordering import group_counts
from .quantiles import exact_quantiles

# Display names of the compared metrics.
METRIC_LABELS = (("precision", "Precision"), ("recall", "Recall"), ("f1_score", "F1 Score"), ("roc_auc", "ROC AUC"))
# A badge is good strictly above its limit.
BADGE_LIMITS = (("precision", 0.9), ("specificity", 0.9), ("mcc", 0.7))


def confusion_cells(scored: DataFrame) -> DataFrame:
    """Four cells with count and share of all rows."""
    names = (("True Negative", "tn"), ("True Positive", "tp"), ("False Positive", "fp"), ("False Negative", "fn"))
    total = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    cells = [
        F.struct(F.lit(n).alias("cell"), F.col(c).alias("n"), ratio(F.col(c), total).alias("share")) for n, c in names
    ]
    return confusion(scored).select(F.inline(F.array(*cells)))


def amount_histogram(df: DataFrame, bins: int = 50) -> DataFrame:
    """Equal-width bins per class over the class's own range, with density.

    Also returns the chart's upper limit, the 99th percentile of fraud amounts.
    """
    ranges = {
        r[LABEL]: (r["lo"], r["hi"], r["n"])
        for r in df.groupBy(LABEL).agg(
            F.min("amount").alias("lo"), F.max("amount").alias("hi"), F.count("amount").alias("n")
        ).collect()  # one row per class
        if r["lo"] is not None
    }
    limit = exact_quantiles(df.where(F.col(LABEL) == 1), {"amount": F.col("amount")}, [0.99])["amount"][0]
    spark = df.sparkSession
    edges = small_table(
        spark,
        [(c, lo, (hi - lo) / bins if hi > lo else 1.0, n) for c, (lo, hi, n) in ranges.items()],
        {LABEL: "int", "lo": "double", "width": "double", "total": "bigint"},
    )
    # One row per class.
    same = df[LABEL].eqNullSafe(edges[LABEL])
    placed = df.where(F.col("amount").isNotNull()).join(F.broadcast(edges), same).select(
        edges[LABEL],
        F.least(F.floor((F.col("amount") - F.col("lo")) / F.col("width")), F.lit(bins - 1)).cast("int").alias("bin"),
    )
    counted = placed.groupBy(F.col(LABEL).alias("_label"), F.col("bin").alias("_bin")).agg(F.count("*").alias("n"))
    grid = edges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    every = grid.join(counted, F.col(LABEL).eqNullSafe(F.col("_label")) & (F.col("bin") == F.col("_bin")), "left").withColumn(
        "n", F.coalesce("n", F.lit(0)))
    return every.select(
        LABEL, "bin", "n",
        (F.col("lo") + F.col("bin") * F.col("width")).alias("bin_start"),
        (F.col("n") / (F.col("total") * F.col("width"))).alias("density"),
        F.lit(limit).cast("double").alias("x_limit"),
    )


def amount_box(df: DataFrame) -> DataFrame:
    """Quartiles, 1.5-IQR whiskers and outlier count of log1p(amount) per class."""
    value = F.log1p("amount")
    classes = sorted(c for c in group_counts(df, F.col(LABEL)) if c is not None)
    quartiles = {
        c: exact_quantiles(df.where(F.col(LABEL) == c), {"v": value}, (0.25, 0.5, 0.75))["v"] for c in classes
    }
    rows = [(c, *q, q[0] - 1.5 * (q[2] - q[0]), q[2] + 1.5 * (q[2] - q[0])) for c, q in quartiles.items() if q[0] is not None]
    boxes = small_table(
        df.sparkSession, rows,
        {LABEL: "int", "q1": "double", "median": "double", "q3": "double", "low_fence": "double", "high_fence": "double"},
    )
    inside = (F.col("v") >= F.col("low_fence")) & (F.col("v") <= F.col("high_fence"))
    return (
        df.select(LABEL, value.alias("v"))
        .join(F.broadcast(boxes), LABEL)
        .groupBy(LABEL, "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, F.col("v"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("v"))).alias("whisker_high"),
            F.count(F.when(~inside, 1)).alias("outliers"),
        )
    )


def importance_top(importance: DataFrame, n: int = 15) -> DataFrame:
    """The n largest importances with a chart label; one input row per feature."""
    w = W.orderBy(F.col("importance").desc(), "feature")
    return (
        importance.withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= n)
        .select("rank", "feature", short_label(F.col("feature")).alias("label"), "importance")
    )


def comparison_long(table: DataFrame) -> DataFrame:
    """(model, label, metric, percent) for the comparison bars."""
    cells = [
        F.struct(F.lit(title).alias("metric"), F.round(F.col(m) * 100, 2).alias("percent")) for m, title in METRIC_LABELS
    ]
    return table.select("model", label_title(F.col("model")).alias("label"), F.inline(F.array(*cells)))


def metric_badges(metrics_row: DataFrame) -> DataFrame:
    cells = [
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), (F.col(m) > limit).cast("int").alias("good"))
        for m, limit in BADGE_LIMITS
    ]
    return metrics_row.select("model", F.inline(F.array(*cells)))


def roc_lines(scored_by_model: dict[str, DataFrame], digits: int | None = None) -> DataFrame:
    """ROC points of several models in one long table."""
    return _lines({m: roc_curve(s, digits, reduced=True) for m, s in scored_by_model.items()})


def pr_lines(scored_by_model: dict[str, DataFrame], digits: int | None = None) -> DataFrame:
    """Precision-recall points of several models in one long table."""
    return _lines({m: pr_curve(s, digits, closed=True) for m, s in scored_by_model.items()})


def _lines(curves: dict[str, DataFrame]) -> DataFrame:
    result = None
    for model, points in curves.items():
        part = points.select(F.lit(model).alias("model"), "*")
        result = part if result is None else result.unionByName(part)
    return result
