import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import augment, isolation, sampling

from .conftest import SF


@pytest.mark.parametrize("strategy", sorted(sampling.STRATEGIES))
def test_strategies_keep_fraud_and_respect_the_budget(tx, strategy):
    counts = sampling.class_counts(tx)
    chosen = sampling.sample(tx, strategy, 2000)
    got = sampling.class_counts(chosen)
    assert got.fraud == counts.fraud and 1900 <= got.total <= 2000
    assert chosen.columns == tx.columns and chosen.select("txn_id").distinct().count() == got.total


def test_small_tables_are_returned_and_unknown_strategies_refused(tx):
    assert sampling.sample(tx, "nope", 10**6) is tx
    with pytest.raises(ValueError):
        sampling.sample(tx, "nope", 10)


def test_load_budgets(tx):
    f = sampling.class_counts(tx).fraud
    with pytest.warns(UserWarning):
        assert sampling.load_fraud_preserving(tx, f - 1).count() == f
    for ratio in (0.15, 0.5):
        got = sampling.class_counts(sampling.load_fraud_preserving(tx, 10**6, target_ratio=ratio))
        assert got.legit == int(f * (1 - ratio) / ratio)
    past = sampling.load_fraud_preserving(tx, 10**6, start_row=10**7, order="step")
    assert sampling.class_counts(past).legit == 0
    with pytest.raises(ValueError):
        sampling.load_fraud_preserving(tx, 100, start_row=5)


def test_comparison_reports_failures_as_rows(tx):
    rows = {r.strategy: r for r in sampling.compare_strategies(tx, 1000, ["stratified", "nope"]).collect()}
    assert rows["stratified"].error is None and rows["nope"].error.startswith("Unknown strategy")


def test_failures_are_no_results(spark, tx, monkeypatch):
    from ledgerlens.plans.jobs import QUERIES

    def broken(df, counts, budget, seed):
        raise RuntimeError("executor lost")

    monkeypatch.setitem(sampling.STRATEGIES, "informative", broken)
    with pytest.raises(RuntimeError, match="executor lost"):
        sampling.compare_strategies(tx, 1000, ["stratified", "informative"])

    def rejects(df, counts, budget, seed):
        raise ValueError("no such rows")

    monkeypatch.setitem(sampling.STRATEGIES, "informative", rejects)
    with pytest.raises(RuntimeError, match="informative.*no such rows"):
        QUERIES["sample_compare"](spark, SF)


def test_isolation_forest_ranks_planted_outliers_first(spark):
    inliers = spark.range(3000).select(
        F.concat(F.lit("a"), F.col("id").cast("string")).alias("txn_id"),
        F.sin(F.col("id").cast("double")).alias("x"), F.cos(F.col("id") * 3.0).alias("y"))
    far = spark.range(5).select(F.concat(F.lit("z"), F.col("id").cast("string")).alias("txn_id"), (F.lit(40.0) + F.col("id")).alias("x"), F.lit(-50.0).alias("y"))
    df = inliers.unionByName(far)
    forest = isolation.fit_isolation_forest(df, ["x", "y"], trees=50)
    top = df.withColumn("s", forest.score()).orderBy(F.desc("s")).limit(5).collect()
    assert {r.txn_id[0] for r in top} == {"z"} and all(0 < r.s < 1 for r in top)


def test_hard_negatives_have_the_documented_shape(tx):
    rows = augment.hard_negatives(tx.where("isFraud = 1"), 1000).toPandas()
    sizes = rows.groupby("generator").size().to_dict()
    assert sizes == {"clone": 100, "full_drain": 220, "delayed_dest": 180, "near_drain": 150, "large": 150, "noisy": 120, "zero_origin": 80}
    assert (rows.isFraud == 0).all() and (rows.step >= 1).all() and rows.txn_id.is_unique
    assert set(rows.type) <= {"TRANSFER", "CASH_OUT"}
    drain = rows[rows.generator == "full_drain"]
    assert (drain.oldbalanceOrg == drain.amount).all() and (drain.newbalanceOrig == 0).all()
    late = rows[rows.generator == "delayed_dest"]
    assert (late.oldbalanceDest == late.newbalanceDest).all()
    near = rows[rows.generator == "near_drain"]
    assert (near.amount <= near.oldbalanceOrg).all() and (near.amount >= 0.89 * near.oldbalanceOrg).all()
    assert augment.augment(tx, 500).count() == tx.count() + 500


def test_isolation_trees_are_walked_to_their_leaves(spark):
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(300, 3))
    grown = isolation._grow(rows, 8, np.random.default_rng(1))
    nodes = pd.DataFrame(grown, columns=["node", "feature", "cut", "left", "right", "length"])
    feature, cut, child, length, depth = isolation._walkable(nodes.sort_values("node"))
    assert depth <= 8
    by_node = nodes.set_index("node")
    for x in rows[:100]:
        at, node = 0, 0
        for _ in range(depth):
            at = child[2 * at + int(x[feature[at]] > cut[at])]
        while by_node.feature[node] >= 0:
            node = by_node.left[node] if x[int(by_node.feature[node])] <= by_node.cut[node] else by_node.right[node]
        assert length[at] == by_node.length[node]
