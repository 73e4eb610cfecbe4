import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import clusters, sampling


def points(spark, n=3000):
    """Five far groups of rows with keys, the first with half of the rows."""
    group = F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 5)
    return spark.range(n).select(
        F.concat(F.lit("k"), F.col("id").cast("string")).alias("txn_id"), group.alias("group"),
        (group * 10 + F.sin(F.col("id").cast("double"))).alias("x"), (group * -7 + F.cos(F.col("id") * 3.0)).alias("y"))


def fit(rows, **options):
    return clusters.fit_centres(rows, {"x": F.col("x"), "y": F.col("y")}, options.pop("k", 5), 42, rows.count(), **options)


def test_centres_of_written_blocks_are_the_means_of_their_rows(spark):
    rows = points(spark)
    got = fit(rows, cached_rows=0)
    want = np.array(rows.groupBy("group").agg(F.avg("x"), F.avg("y")).select("avg(x)", "avg(y)").collect())
    by = lambda a: a[np.argsort(a[:, 0])]
    assert np.allclose(by(got), by(want), atol=1e-5)


def test_centres_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(clusters, "_BLOCK_BYTES", 1600)
    rows = points(spark)
    assert (fit(rows.repartition(3), cached_rows=0, k=40) == fit(rows.repartition(11, "x"), cached_rows=0, k=40)).all()


def test_no_row_is_kept_in_memory_by_a_fit_of_many_rows(spark, monkeypatch):
    monkeypatch.setattr(clusters, "KMeans", None)
    assert len(fit(points(spark), cached_rows=2999)) == 5


@pytest.mark.parametrize("n", [1, 7])
def test_copies_and_few_values_give_fewer_centres(spark, n):
    rows = spark.range(500).select(F.lit(None).cast("string").alias("txn_id"), (F.col("id") % n).cast("double").alias("x"), F.lit(1.0).alias("y"))
    got = fit(rows, cached_rows=0, k=20)
    assert sorted(got[:, 0]) == list(range(n))


def test_nearest_centre_by_row_alone(spark):
    rng = np.random.default_rng(3)
    x, centres = rng.normal(size=(700, 4)), rng.normal(size=(30, 4))
    centres[5], centres[9] = centres[2], 1e5 * centres[9]
    x[::7] = (centres[3] + centres[4]) / 2  # as far from both
    want = ((x[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
    assert (clusters._nearest_exactly(x, centres) == want).all()
    assert all(clusters._nearest_exactly(x[i : i + 1], centres)[0] == want[i] for i in range(0, 700, 7))


def test_clustering_strategy_over_written_blocks(tx, monkeypatch):
    few = clusters.fit_centres
    monkeypatch.setattr(sampling, "fit_centres", lambda *a: few(*a, cached_rows=0))
    counts = sampling.class_counts(tx)
    got = sampling.class_counts(sampling.sample(tx, "clustering", 2000))
    assert got.fraud == counts.fraud and 1900 <= got.total <= 2000
