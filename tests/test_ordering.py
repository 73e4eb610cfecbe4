import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.functions.hashing import hash_order
from ledgerlens.operators import ordering, quantiles


@pytest.fixture(scope="module")
def skewed(spark):
    """20,000 rows; a third share one value and one group."""
    rows = spark.range(20_000).select(
        F.md5(F.col("id").cast("string")).alias("txn_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))).alias("g"),
        F.when(F.col("id") % 3 == 0, 5.0).otherwise((F.col("id") * 7919 % 1000) / 10).alias("v"),
    )
    return rows.cache()


def test_first_by_hash_takes_exactly_the_quota_in_hash_order(skewed):
    quotas = {"hot": 1234, "g1": 10, "g2": 0, "g4": 10**6}
    chosen = skewed.where(ordering.first_by_hash(skewed, quotas, 7, F.col("g")))
    frame = skewed.select("txn_id", "g", hash_order(7).alias("h")).toPandas()
    expected = set()
    for g, n in quotas.items():
        expected |= set(frame[frame.g == g].sort_values("h").head(n).txn_id)
    assert {r.txn_id for r in chosen.select("txn_id").collect()} == expected


@pytest.mark.parametrize("bracket_rows", [50, 10**6])
@pytest.mark.parametrize("n", [0, 1, 700, 5000, 9999, 19_999, 20_000, 30_000])
def test_value_cutoff_is_exact_with_hot_values(skewed, n, bracket_rows):
    cut = ordering.value_cutoff(skewed, F.col("v"), F.col("txn_id"), n, 20_000, bracket_rows)
    chosen = {r.txn_id for r in skewed.where(cut.holds(F.col("v"), F.col("txn_id"))).collect()}
    frame = skewed.toPandas().sort_values(["v", "txn_id"])
    assert chosen == set(frame.head(n).txn_id)


@pytest.mark.parametrize("bracket_rows", [50, 10**6])
@pytest.mark.parametrize("n", [9000, 15_000, 18_000])
def test_value_cutoff_puts_nulls_last(skewed, n, bracket_rows):
    value = F.when(F.col("v") < 60, F.col("v"))
    cut = ordering.value_cutoff(skewed, value, F.col("txn_id"), n, 20_000, bracket_rows)
    chosen = {r.txn_id for r in skewed.where(cut.holds(value, F.col("txn_id"))).collect()}
    frame = skewed.toPandas()
    frame["o"] = frame.v.where(frame.v < 60, np.inf)
    assert chosen == set(frame.sort_values(["o", "txn_id"]).head(n).txn_id)


def test_selection_plans_no_shuffle_of_rows(skewed):
    chosen = skewed.where(ordering.first_by_hash(skewed, 100, 1))
    assert "Exchange" not in chosen._jdf.queryExecution().executedPlan().toString()


def test_hash_rank_is_a_permutation_in_hash_order(skewed):
    frame = ordering.hash_ranked(skewed, 3).select("txn_id", "rank", hash_order(3).alias("h")).toPandas()
    frame = frame.sort_values("h")
    assert list(frame["rank"]) == list(range(20_000))


def test_split_and_folds_are_stratified(tx):
    totals = ordering.group_counts(tx, F.col("isFraud"))
    split = tx.withColumn("s", ordering.split_flag(tx, "isFraud", 0.2, 1)).groupBy("isFraud", "s").count().collect()
    for r in split:
        share = 0.2 if r["s"] == "test" else 0.8
        assert abs(r["count"] - share * totals[r["isFraud"]]) <= 1
    folds = tx.withColumn("f", ordering.fold_number(tx, "isFraud", 5, 1)).groupBy("isFraud", "f").count().collect()
    assert len(folds) == 10
    for r in folds:
        assert abs(r["count"] - totals[r["isFraud"]] / 5) < 1


def test_quantiles_by_narrowing_equal_numpy(skewed):
    probabilities = [0.0, 0.01, 0.25, 0.333, 0.5, 0.75, 0.99, 1.0]
    values = {"v": F.col("v"), "w": F.col("v") * F.col("v") + F.length("g")}
    got = quantiles.exact_quantiles(skewed, values, probabilities, buffer_rows=10, bracket_rows=30)
    frame = skewed.toPandas()
    want = {"v": frame.v, "w": frame.v**2 + frame.g.str.len()}
    for c in values:
        assert np.allclose(got[c], np.quantile(want[c], probabilities), rtol=1e-12)


def test_quantiles_of_an_empty_column(spark):
    empty = spark.range(5).select(F.lit(None).cast("double").alias("v"))
    assert quantiles.exact_quantiles(empty, {"v": F.col("v")}, [0.5]) == {"v": [None]}


def test_many_quantiles_cost_a_bounded_number_of_zones(spark, monkeypatch):
    """63 quantiles of columns with outliers, ties, nulls, NaN and infinities: a pass has as many zones as for one."""
    rows = spark.range(30_000).select(
        ((F.col("id") * 7919 % 30_000) / 7).alias("flat"),
        F.pow(F.lit(10.0), (F.col("id") % 600) - 300).alias("steep"),
        F.when(F.col("id") % 3 == 0, 5.0).when(F.col("id") % 5 != 0, F.col("id") * -1e-3).alias("tied"),
        F.when(F.col("id") % 9 == 0, float("nan")).when(F.col("id") % 9 == 1, float("-inf")).otherwise(F.col("id") % 100).alias("odd"))
    widths, inner = [], quantiles._zones

    def watched(narrow, columns, cuts):
        widths.append(max(sum(len(ends or ()) for *_, ends in parts) for parts in cuts.values()))
        return inner(narrow, columns, cuts)

    monkeypatch.setattr(quantiles, "_zones", watched)
    shares = [i / 64 for i in range(1, 64)]
    got = quantiles.exact_quantiles(rows, {c: F.col(c) for c in rows.columns}, shares, buffer_rows=10, bracket_rows=30)
    frame = rows.toPandas()
    for c in rows.columns:
        known = np.sort(np.array([v for v in frame[c].tolist() if v is not None])) if c == "odd" else np.sort(frame[c].dropna().to_numpy())
        ats = [(len(known) - 1) * p for p in shares]
        want = [known[int(a)] if known[int(a)] == known[int(np.ceil(a))] else known[int(a)] + (known[int(np.ceil(a))] - known[int(a)]) * (a - int(a)) for a in ats]
        assert np.array_equal(np.array(got[c], float), np.array(want), equal_nan=True)
    assert len(widths) < 16 and max(widths) <= 2 * quantiles._ZONES


def test_bin_counts_by_edge_and_label(spark):
    rows = spark.createDataFrame([(1.0, 0), (2.0, 1), (2.5, 1), (None, 1), (float("nan"), None)], "a double, y int")
    got = {(r["i"], r["bin"], r["y"]): r["n"] for r in quantiles.bin_counts(rows, ["a"], [[2.0, 3.0]], "y").collect()}
    assert got == {(0, 0, 0): 1, (0, 1, 1): 2, (0, 2, None): 1}
