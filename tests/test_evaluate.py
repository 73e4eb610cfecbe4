import random

import pytest

from ledgerlens.operators import charts, evaluate


def scored(spark, rows):
    return spark.createDataFrame([(y, float(p), int(p > 0.5)) for y, p in rows], "isFraud int, p double, prediction int")


def brute(rows):
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    ap, hit, seen = 0.0, 0, 0
    for t in sorted({p for _, p in rows}, reverse=True):
        at = [y for y, p in rows if p == t]
        seen, hit = seen + len(at), hit + sum(at)
        ap += sum(at) / len(pos) * hit / seen
    return auc, ap


def test_auc_and_average_precision_with_ties(spark):
    rng = random.Random(1)
    rows = [(int(rng.random() < 0.3), round(rng.random(), 1)) for _ in range(300)]
    row = evaluate.metrics(scored(spark, rows)).first()
    assert (row.roc_auc, row.avg_precision) == pytest.approx(brute(rows))


def test_equal_scores_and_absent_class(spark):
    same = evaluate.metrics(scored(spark, [(1, 0.4), (0, 0.4)])).first()
    assert same.roc_auc == 0.5 and same.precision == 0 and same.mcc == 0
    one = evaluate.metrics(scored(spark, [(0, 0.4), (0, 0.6)])).first()
    assert one.roc_auc is None and one.recall == 0 and (one.tn, one.fp, one.fn, one.tp) == (1, 1, 0, 0)


def test_running_sums_by_range_equal_one_window(spark):
    rng = random.Random(2)
    counts = evaluate.score_counts(scored(spark, [(int(rng.random() < 0.4), rng.random() ** 9) for _ in range(3000)]))
    one = evaluate.cumulative(counts, 1).drop("_range")
    many = evaluate.cumulative(counts, 16).drop("_range")
    assert one.count() == many.count() and one.select(*many.columns).exceptAll(many).count() == 0


def test_reduced_curve_keeps_corners(spark):
    rows = [(1, 0.9), (1, 0.8), (1, 0.7), (0, 0.6), (0, 0.5), (1, 0.4)]
    full, reduced = evaluate.roc_curve(scored(spark, rows)), evaluate.roc_curve(scored(spark, rows), reduced=True)
    assert full.count() == 6
    assert [r.threshold for r in reduced.orderBy("threshold").collect()] == [0.4, 0.5, 0.7, 0.9]


def test_pr_curve_ends_at_one_zero(spark):
    last = evaluate.pr_curve(scored(spark, [(1, 0.9), (0, 0.2)]), closed=True).where("threshold is null").first()
    assert (last.precision, last.recall) == (1.0, 0.0)


def test_report_text(spark):
    text = evaluate.evaluation_report(evaluate.metrics(scored(spark, [(1, 0.9), (0, 0.2), (0, 0.7), (1, 0.1)]), "m")).first().report
    assert "Model: m" in text and "Accuracy:           0.5000 (50.00%)" in text and "True Positives:         1" in text


def test_selection_needs_a_strictly_better_ensemble(spark):
    rows = lambda e: spark.createDataFrame([("tuned", "xgboost", 0.8), ("ensemble", "stacking", e)], "kind string, name string, f1_score double")
    assert evaluate.select_final(rows(0.8)).first().selected == "tuned_xgboost"
    assert evaluate.select_final(rows(0.81)).first().selected == "ensemble_stacking"
    only = rows(0.1).where("kind = 'tuned'")
    assert evaluate.select_final(only).first().selected == "tuned_xgboost"


def test_hard_vote_needs_a_majority(spark):
    df = spark.createDataFrame([(0.9, 0.9, 0.1), (0.9, 0.1, 0.1)], "a double, b double, c double")
    assert [r.prediction for r in evaluate.vote_hard(df, ["a", "b", "c"]).collect()] == [1, 0]
    assert [r.prediction for r in evaluate.vote_hard(df, ["a", "b"]).collect()] == [1, 0]


def test_histogram_of_a_constant_class(spark):
    df = spark.createDataFrame([(1, 5.0), (1, 5.0), (0, 1.0), (0, 2.0)], "isFraud int, amount double")
    rows = {(r.isFraud, r.bin): r.n for r in charts.amount_histogram(df).collect()}
    assert len(rows) == 100 and {k: n for k, n in rows.items() if n} == {(1, 0): 2, (0, 0): 1, (0, 49): 1}
