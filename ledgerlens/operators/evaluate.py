"""Exact evaluation from one aggregate per distinct score.

Input: one row per transaction with ``isFraud``, ``p`` (score) and
``prediction``.  Rows collapse to one count row per score first; the curves are
running sums over those, split by score range so that no task holds them all.
"""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.guards import ratio
from ..schema import LABEL
from ..session import stage


def score_counts(scored: DataFrame, digits: int | None = None) -> DataFrame:
    """Positives, negatives and predicted positives per distinct score."""
    p = F.col("p") if digits is None else F.round("p", digits)
    y, hit = F.col(LABEL).cast("bigint"), F.col("prediction").cast("bigint")
    return scored.groupBy(p.alias("p")).agg(
        F.sum(y).alias("pos"),
        F.sum(1 - y).alias("neg"),
        F.sum(y * hit).alias("tp"),
        F.sum((1 - y) * hit).alias("fp"),
    )


def cumulative(counts: DataFrame, ranges: int = 1024) -> DataFrame:
    """Adds ``cum_pos``/``cum_neg``: totals at or above each score, and ``_range``.

    Scores are cut into ranges holding equally many distinct scores, summed per
    range, and each range starts from its offset.  ``counts`` is read several times.
    """
    marks = counts.agg(
        F.percentile_approx("p", [i / ranges for i in range(1, ranges)], 10 * ranges)
    ).first()[0]
    edges = F.array(*[F.lit(e) for e in sorted(set(marks or []))]).cast("array<double>")
    part = counts.withColumn("_range", F.size(F.filter(edges, lambda e: e > F.col("p"))))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    # At most ``ranges`` rows.
    offsets = part.groupBy("_range").agg(F.sum("pos").alias("a"), F.sum("neg").alias("b")).select(
        "_range",
        F.coalesce(F.sum("a").over(before), F.lit(0)).alias("off_pos"),
        F.coalesce(F.sum("b").over(before), F.lit(0)).alias("off_neg"),
    )
    w = W.partitionBy("_range").orderBy(F.col("p").desc()).rowsBetween(W.unboundedPreceding, 0)
    return (
        part.withColumn("cum_pos", F.sum("pos").over(w))
        .withColumn("cum_neg", F.sum("neg").over(w))
        .join(F.broadcast(offsets), "_range")
        .withColumn("cum_pos", F.col("cum_pos") + F.col("off_pos"))
        .withColumn("cum_neg", F.col("cum_neg") + F.col("off_neg"))
        .drop("off_pos", "off_neg")
    )


def _counted(scored: DataFrame, digits: int | None) -> DataFrame:
    """Score counts, written once: scoring may be a model."""
    return stage(score_counts(scored, digits), "score-counts")


def _bends(curve: DataFrame) -> DataFrame:
    """The first and last point, and points whose next point has other counts."""
    inside = W.partitionBy("_range").orderBy(F.col("p").desc())
    # The next range's first point stands in for the next point of a range's last; at most one row per range.
    first = curve.groupBy("_range").agg(F.max(F.struct("p", "pos", "neg")).alias("t"))
    over = W.orderBy("_range")
    first = first.select("_range", F.lead("t").over(over).alias("_after"), F.lag("t").over(over).isNull().alias("_top"))
    following = F.coalesce(F.lead(F.struct("p", "pos", "neg")).over(inside), F.col("_after"))
    joined = curve.join(F.broadcast(first), "_range").withColumn("_next", following).withColumn(
        "_first", F.col("_top") & (F.row_number().over(inside) == 1))
    bend = F.col("_next").isNull() | (F.col("_next.pos") != F.col("pos")) | (F.col("_next.neg") != F.col("neg"))
    return joined.where(F.col("_first") | bend).drop("_after", "_top", "_next", "_first")


# ---- scalar metrics -----------------------------------------------------------

def confusion(scored: DataFrame) -> DataFrame:
    y, hit = F.col(LABEL), F.col("prediction").cast("int")
    cell = lambda a, b: F.count(F.when((y == a) & (hit == b), 1))
    return scored.agg(
        cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp")
    )


def _threshold_metrics() -> dict[str, Column]:
    """Metrics of one row with tn, fp, fn, tp; 0 where the denominator is 0."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    spread = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return {
        "accuracy": ratio(tp + tn, tn + fp + fn + tp),
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "f1_score": ratio(2 * tp, 2 * tp + fp + fn),
        "mcc": ratio(tp * tn - fp * fn, spread),
        "specificity": ratio(tn, tn + fp),
        "false_positive_rate": ratio(fp, fp + tn),
    }


def metrics(scored: DataFrame, model_name: str = "model", digits: int | None = None) -> DataFrame:
    """The full metrics row: one scan, one shuffle of score counts.

    ROC-AUC counts ties as half and is null when a class is absent; average
    precision is the step sum.
    """
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    above = F.col("cum_pos") - pos
    summed = cumulative(_counted(scored, digits)).agg(
        F.sum("tp").alias("tp"),
        F.sum("fp").alias("fp"),
        F.sum(F.col("pos") - F.col("tp")).alias("fn"),
        F.sum(F.col("neg") - F.col("fp")).alias("tn"),
        F.sum("pos").alias("pos"),
        F.sum("neg").alias("neg"),
        F.sum(neg * (above + pos / 2)).alias("wins"),
        F.sum(pos * ratio(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg"))).alias("steps"),
    )
    scalars = _threshold_metrics()
    return summed.select(
        F.lit(model_name).alias("model"),
        *[scalars[m].alias(m) for m in ("accuracy", "precision", "recall", "f1_score")],
        F.try_divide("wins", F.col("pos").cast("double") * F.col("neg")).alias("roc_auc"),
        ratio(F.col("steps"), F.col("pos")).alias("avg_precision"),
        *[scalars[m].alias(m) for m in ("mcc", "specificity", "false_positive_rate")],
        "tn", "fp", "fn", "tp",
    )


def classification_report(scored: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, plus accuracy, macro and weighted rows."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp

    def line(name, p, r, f, support):
        return F.struct(
            F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"), f.alias("f1_score"),
            support.cast("bigint").alias("support"),
        )

    p0, r0, f0 = ratio(tn, tn + fn), ratio(tn, tn + fp), ratio(2 * tn, 2 * tn + fp + fn)
    p1, r1, f1 = ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(2 * tp, 2 * tp + fp + fn)
    accuracy = ratio(tp + tn, n)
    weighted = lambda a, b: ratio(a * (tn + fp) + b * (tp + fn), n)
    return confusion(scored).select(
        F.inline(
            F.array(
                line("Legitimate", p0, r0, f0, tn + fp),
                line("Fraud", p1, r1, f1, tp + fn),
                line("accuracy", accuracy, accuracy, accuracy, n),
                line("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n),
                line("weighted avg", weighted(p0, p1), weighted(r0, r1), weighted(f0, f1), n),
            )
        )
    )


# ---- curves ----------------------------------------------------------------------

def roc_curve(scored: DataFrame, digits: int | None = None, reduced: bool = False) -> DataFrame:
    """(threshold, fpr, tpr) per distinct score; ``reduced`` drops collinear inner points."""
    counts = _counted(scored, digits)
    curve = cumulative(counts)
    if reduced:
        curve = _bends(curve)
    totals = counts.agg(F.sum("pos").cast("double").alias("positives"), F.sum("neg").cast("double").alias("negatives"))
    # One row.
    return curve.join(F.broadcast(totals)).select(
        F.col("p").alias("threshold"),
        F.try_divide("cum_neg", "negatives").alias("fpr"),
        F.try_divide("cum_pos", "positives").alias("tpr"),
    )


def pr_curve(scored: DataFrame, digits: int | None = None, closed: bool = False) -> DataFrame:
    """(threshold, precision, recall) per distinct score; ``closed`` appends the (1, 0) point."""
    counts = _counted(scored, digits)
    totals = counts.agg(F.sum("pos").cast("double").alias("positives"))
    points = cumulative(counts).join(F.broadcast(totals)).select(
        F.col("p").alias("threshold"),
        ratio(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg")).alias("precision"),
        ratio(F.col("cum_pos"), F.col("positives")).alias("recall"),
    )
    if closed:
        end = totals.select(F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
        points = points.unionByName(end)
    return points


def threshold_sweep(scored: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    """Confusion counts and metrics at each cut (prediction = score above the cut), one pass."""
    y = F.col(LABEL)
    row = scored.agg(
        F.sum(y.cast("bigint")).alias("pos"),
        F.sum((1 - y).cast("bigint")).alias("neg"),
        *[F.count(F.when((F.col("p") > t) & (y == 1), 1)).alias(f"tp{i}") for i, t in enumerate(thresholds)],
        *[F.count(F.when((F.col("p") > t) & (y == 0), 1)).alias(f"fp{i}") for i, t in enumerate(thresholds)],
    )
    cells = [
        F.struct(
            F.lit(float(t)).alias("threshold"),
            (F.col("neg") - F.col(f"fp{i}")).alias("tn"),
            F.col(f"fp{i}").alias("fp"),
            (F.col("pos") - F.col(f"tp{i}")).alias("fn"),
            F.col(f"tp{i}").alias("tp"),
        )
        for i, t in enumerate(thresholds)
    ]
    scalars = _threshold_metrics()
    return row.select(F.inline(F.array(*cells))).select(
        "threshold", "tn", "fp", "fn", "tp",
        *[scalars[m].alias(m) for m in ("accuracy", "precision", "recall", "f1_score", "specificity")],
    )


# ---- report ------------------------------------------------------------------------

# The report layout; {name} is a cell of the metrics row.
_RULE, _LINE = "=" * 60, "-" * 40
REPORT = f"""{_RULE}
FRAUD DETECTION MODEL EVALUATION REPORT
{_RULE}

Model: {{model}}

PERFORMANCE METRICS
{_LINE}
  Accuracy:           {{accuracy:4}} ({{accuracy:2%}}%)
  Precision:          {{precision:4}}
  Recall (Fraud):     {{recall:4}}
  F1-Score:           {{f1_score:4}}
  ROC-AUC:            {{roc_auc:4}}
  Avg Precision:      {{avg_precision:4}}
  MCC:                {{mcc:4}}
  Specificity:        {{specificity:4}}
  False Positive Rate:{{false_positive_rate:4}}

CONFUSION MATRIX
{_LINE}
  True Negatives:  {{tn:,}}
  False Positives: {{fp:,}}
  False Negatives: {{fn:,}}
  True Positives:  {{tp:,}}

INTERPRETATION
{_LINE}
  Fraud Detection Rate: {{recall:1%}}% of fraudulent transactions detected
  False Alarm Rate:     {{false_positive_rate:2%}}% of legitimate transactions flagged
  When flagging fraud:  {{precision:1%}}% are actually fraudulent

{_RULE}
"""


def report_parts(template: str = REPORT) -> list[tuple[str, str | None, str]]:
    """The template as (text, cell, format) pieces."""
    return [(text, cell, spec or "") for text, cell, spec, _ in Formatter().parse(template)]


def evaluation_report(metrics_row: DataFrame) -> DataFrame:
    """(model, report): the text report of each metrics row."""
    pieces: list[Column] = []
    for text, cell, spec in report_parts():
        pieces.append(F.lit(text))
        if cell is None:
            continue
        if spec == "":
            pieces.append(F.col(cell))
        elif spec == ",":
            pieces.append(F.lpad(F.format_number(cell, 0), 8, " "))
        elif spec.endswith("%"):
            pieces.append(F.format_string(f"%.{spec[:-1]}f", F.coalesce(F.col(cell), F.lit(0.0)) * 100))
        else:
            pieces.append(F.format_string(f"%.{spec}f", F.coalesce(F.col(cell), F.lit(0.0))))
    return metrics_row.select("model", F.concat(*pieces).alias("report"))


# ---- comparison tables ---------------------------------------------------------------

def comparison_rank(table: DataFrame) -> DataFrame:
    """Models by F1, with rank and ``is_best``; the table has one row per model."""
    w = W.orderBy(F.col("f1_score").desc(), "model")
    ranked = table.withColumn("rank", F.row_number().over(w))
    return ranked.withColumn("is_best", (F.col("rank") == 1).cast("int"))


def compare_models(table: DataFrame) -> DataFrame:
    """The five headline metrics of every model that did not fail."""
    rows = table.where(F.col("error").isNull()) if "error" in table.columns else table
    return rows.select("model", "accuracy", "precision", "recall", "f1_score", "roc_auc")


def vote_soft(scores: DataFrame, members: list[str]) -> DataFrame:
    """Mean probability of the members; positive above one half."""
    mean = sum((F.col(m) for m in members), F.lit(0.0)) / len(members)
    return scores.withColumn("p", mean).withColumn("prediction", (F.col("p") > 0.5).cast("int"))


def vote_hard(scores: DataFrame, members: list[str]) -> DataFrame:
    """Majority of the members' labels; the probability is the label."""
    votes = sum(((F.col(m) > 0.5).cast("int") for m in members), F.lit(0))
    label = (votes > len(members) / 2).cast("int")
    return scores.withColumn("prediction", label).withColumn("p", label.cast("double"))


def select_final(candidates: DataFrame) -> DataFrame:
    """The ensemble only when its F1 is strictly above the tuned model's.

    ``candidates`` holds (kind, name, f1_score) with kind ``tuned`` or ``ensemble``.
    """
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    both = candidates.agg(
        of("tuned", "name").alias("tn"), of("tuned", "f1_score").alias("tf"),
        of("ensemble", "name").alias("en"), of("ensemble", "f1_score").alias("ef"),
    )
    ensemble = F.coalesce(F.col("ef") > F.col("tf"), F.lit(False)) | F.col("tf").isNull()
    return both.select(
        F.when(ensemble, F.concat(F.lit("ensemble_"), F.col("en")))
        .otherwise(F.concat(F.lit("tuned_"), F.col("tn")))
        .alias("selected"),
        F.when(ensemble, F.col("ef")).otherwise(F.col("tf")).alias("f1_score"),
    )
