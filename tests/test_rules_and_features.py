import math

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import rules
from ledgerlens.operators import clean, features, results, scoring
from ledgerlens.plans.catalog import test_score as score_of
from tests.conftest import CASES, table


def test_factor_list_of_the_documented_request(spark):
    df = table(spark, [(1, "TRANSFER", 181000, 181000, 0, 0, 0, 1)])
    assert df.select(rules.risk_factors().alias("f")).first().f == [
        "High-risk transaction type: TRANSFER",
        "Large transaction amount: 181,000.00",
        "Complete account drain: entire balance transferred out",
        "Destination balance unchanged after receiving transfer",
    ]


def test_factors_at_the_limits(spark):
    df = table(spark, [
        (1, "PAYMENT", 200000, 300000, 100000, 0, 0, 0),
        (1, "PAYMENT", 50000, 100, 100, 5, 5, 0),
        (1, "DEBIT", 0, 0, 0, 0, 0, 0),
    ])
    found = [r.f for r in df.orderBy("txn_id").select(rules.risk_factors().alias("f")).collect()]
    assert found[0] == ["Large transaction amount: 200,000.00"]
    assert found[1] == ["Balance change does not match transaction amount", "Transaction amount exceeds available balance"]
    assert found[2] == []


@pytest.mark.parametrize("p,level", [(0.3, "LOW"), (0.300001, "MEDIUM"), (0.7, "MEDIUM"), (0.700001, "HIGH"), (0.5, "MEDIUM")])
def test_bands_are_strict(spark, p, level):
    assert spark.range(1).select(rules.risk_level(F.lit(p)).alias("x")).first().x == level


def test_recommendations(spark):
    rows = spark.createDataFrame([(1, 0.9), (1, 0.6), (0, 0.4), (0, 0.3)], "y int, p double")
    texts = [r.t for r in rows.select(rules.recommendation(F.col("y") == 1, F.col("p")).alias("t")).collect()]
    assert [t.split(" ")[0] for t in texts] == ["BLOCK", "HOLD", "MONITOR", "APPROVE"]


def test_documented_cases_run_through_decisions_and_pairs(spark):
    df = table(spark, CASES)
    rule = {r.txn_id: r.rule for r in df.select("txn_id", rules.decision_rule().alias("rule")).collect()}
    assert rule["t001"] == 2 and rule["t002"] == 1 and rule["t003"] == 4 and rule["t012"] == 5
    pairs = [(2, 1), (2, 3), (4, 5), (12, 13), (11, 2)]
    members = spark.createDataFrame(
        [(p, s + 1, f"t{case - 1:03d}") for p, pair in enumerate(pairs) for s, case in enumerate(pair)],
        "pair int, side int, txn_id string",
    )
    rows = results.paired_cases(df.join(members, "txn_id"), F.col("pair"), F.col("side")).orderBy("pair").collect()
    assert len(rows) == 5 and rows[0].type_1 == "TRANSFER" and rows[0].newbalanceOrig_1 == 0 and rows[1].type_2 == "PAYMENT"


def test_amount_and_ratio_edges(spark):
    df = table(spark, [(1, "DEBIT", a, -1, 0, -1, 0, 0) for a in (-1, -5, 0)])
    rows = df.select(*[v.alias(n) for n, v in features.engineered(df, {}, 0.0).items()]).collect()
    for r in rows:
        assert all(math.isfinite(v) for v in r)
        assert r.amount_to_balance_ratio == 0.0 and r.balance_change_ratio_dest == 0.0
    assert rows[0].amount_log == 0 and rows[1].amount_sqrt == 0


def test_hours(spark):
    df = table(spark, [(s, "DEBIT", 1.5, 1, 1, 1, 1, 0) for s in (0, 5, 6, 22, 23, 24, -5)])
    out = {r.txn_id: r for r in df.select("txn_id", *[v.alias(n) for n, v in features.time_features(df).items()]).collect()}
    assert [out[f"t{i:03d}"].unusual_hour for i in range(7)] == [1, 1, 0, 0, 1, 1, 0]
    assert out["t006"].hour_of_day == 19 and out["t006"].day_of_sim == -1


def test_type_statistics_edges(spark):
    df = table(spark, [
        (1, "DEBIT", 10, 1, 1, 1, 1, 0),
        (1, "PAYMENT", 5, 1, 1, 1, 1, 0), (1, "PAYMENT", 5, 1, 1, 1, 1, 0),
        (1, "TRANSFER", 1, 1, 1, 1, 1, 0), (1, "TRANSFER", 3, 1, 1, 1, 1, 0),
    ])
    stats = features.fit_type_stats(df)
    z = {r.txn_id: r.z for r in df.select("txn_id", features.type_features(df, stats, 0.0)["amount_zscore_by_type"].alias("z")).collect()}
    assert z["t000"] == z["t001"] == z["t002"] == 0 and z["t003"] == pytest.approx(-math.sqrt(0.5))
    new = table(spark, [(1, "CRYPTO", 10, 1, 1, 1, 1, 0)])
    r = new.select(*[v.alias(n) for n, v in features.type_features(new, stats, 4.0).items()],
                   features.encode("type", features.fit_codes(df, "type")).alias("code")).first()
    assert (r.amount_vs_type_mean, r.amount_zscore_by_type, r.code) == (2.0, 6.0, -1)


def test_scalers_keep_flags_and_constants(spark):
    df = spark.createDataFrame([(float(i), float(i == 0), 3.0) for i in range(10)], "v double, flag double, c double")
    for method in features.SCALERS:
        params = features.fit_scaler(df, df.columns, method)
        rows = df.select(*[features.scaled(c, params).alias(c) for c in df.columns]).collect()
        assert all(r.c == 0 for r in rows)
        assert len({r.flag for r in rows}) == 2
    assert features.fit_scaler(df, ["flag"], "robust")["flag"] == (0.0, 1.0)
    with pytest.raises(ValueError):
        features.fit_scaler(df, ["v"], "nope")


def test_training_drops_duplicates_and_scoring_keeps_them(spark):
    df = table(spark, [(1, "DEBIT", 1, 1, 1, 1, 1, 0)] * 3).withColumn("nameOrig", F.lit("C")).withColumn("nameDest", F.lit("M"))
    assert clean.drop_duplicates(df).collect()[0].txn_id == "t000"
    assert clean.drop_duplicates(df).count() == 1
    model = features.FeatureModel(select=False).fit(table(spark, CASES))
    assert model.transform(df).count() == 3


def test_sparse_limit_is_strict(spark):
    df = spark.createDataFrame([(i, i if i < 5 else None, i if i < 4 else None) for i in range(10)], "a int, half int, less int")
    assert clean.sparse_columns(df) == ["less"]


def test_narrow_types(spark):
    df = spark.createDataFrame([(1, 300, 70000, 1.5), (-128, -5, 1, 2.5)], "a long, b long, c long, d double")
    assert [t for _, t in clean.narrow_types(df).dtypes] == ["tinyint", "smallint", "int", "float"]


def test_feature_model_round_trip_and_guard(spark, tx):
    with pytest.raises(RuntimeError):
        features.FeatureModel().transform(tx)
    model, table_ = features.fit_transform(tx)
    again = features.FeatureModel.from_json(model.to_json())
    assert again.selected == model.selected and len(model.selected) > 5
    assert list(model.scores.values()) == sorted(model.scores.values(), reverse=True)
    assert again.transform(tx).exceptAll(table_).count() == 0
    assert "isFlaggedFraud" not in model.selected and "nameOrig" not in model.selected


def test_feature_groups_depend_on_columns(spark, tx):
    assert "amount_log" not in features.engineered(tx.drop("amount"), {}, 0.0)
    assert "hour_of_day" not in features.engineered(tx.drop("step"), {}, 0.0)


def test_batch_summary_of_nothing(spark, tx):
    empty = score_of(tx.where("false"))
    row = scoring.batch_summary(empty).first()
    assert (row.total_transactions, row.fraud_detected, row.legitimate, row.fraud_rate) == (0, 0, 0, 0.0)
