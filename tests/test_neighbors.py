import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import imbalance, neighbors

COLUMNS = ["a", "b"]


@pytest.fixture(scope="module")
def points(spark):
    """1,500 points on a coarse grid: many ties, and a third of them are copies of one point."""
    i = F.col("id")
    return spark.range(1500).select(
        F.md5(i.cast("string")).alias("txn_id"),
        F.when(i % 3 == 0, 1.0).otherwise((i * 31 % 40).cast("double")).alias("a"),
        F.when(i % 3 == 0, 1.0).otherwise((i * 17 % 23).cast("double")).alias("b"),
        ((i * 13 % 97 < 18) & (i % 3 != 0)).cast("int").alias("isFraud"),
    ).cache()


def brute(queries, stored, k):
    q, s = queries.toPandas(), stored.toPandas()
    there, keys, tags = s[COLUMNS].to_numpy(), s.txn_id.to_numpy(), s.isFraud.to_numpy()
    out = {}
    for row in q.itertuples():
        d = np.sqrt(((there - [row.a, row.b]) ** 2).sum(axis=1))
        out[row.txn_id] = sorted((x, y, int(t)) for x, y, t in zip(d, keys, tags) if y != row.txn_id)[:k]
    return out


@pytest.mark.parametrize("cell_rows", [10_000, 60])
def test_nearest_equals_brute_force(points, cell_rows):
    fraud = points.where("isFraud = 1")
    for queries in (fraud, points):
        got = {
            r.txn_id: [(n.distance, n.key, n.tag) for n in r.neighbours]
            for r in neighbors.nearest(queries, points, COLUMNS, 4, tag="isFraud", cell_rows=cell_rows).collect()
        }
        assert got == brute(queries, points, 4)


def test_hot_vectors_are_joined_apart(points, monkeypatch):
    monkeypatch.setattr(neighbors, "_HOT_ROWS", 100)
    got = {r.txn_id: [n.key for n in r.neighbours] for r in neighbors.nearest(points, points, COLUMNS, 3).collect()}
    assert got == {q: [key for _, key, _ in n] for q, n in brute(points, points, 3).items()}


def test_fewer_points_than_neighbours(points):
    few = points.limit(3)
    assert {len(r.neighbours) for r in neighbors.nearest(few, few, COLUMNS, 5).collect()} == {2}


def test_smote_rows_lie_between_a_point_and_its_neighbour(points):
    counts = {r.isFraud: r["count"] for r in points.groupBy("isFraud").count().collect()}
    rows = imbalance.smote_rows(points, COLUMNS, 0.3, 5).toPandas()
    assert len(rows) == int(0.3 * counts[0]) - counts[1] and rows.txn_id.is_unique
    minority = points.where("isFraud = 1")
    near = brute(minority, minority, 5)
    frame = minority.toPandas().set_index("txn_id")
    segments = [(frame.loc[a, COLUMNS].to_numpy(float), frame.loc[b, COLUMNS].to_numpy(float)) for a, n in near.items() for _, b, _ in n]
    start, end = np.array([s for s, _ in segments]), np.array([e for _, e in segments])
    for p in rows[COLUMNS].to_numpy():
        span, off = end - start, p - start
        cross = np.abs(span[:, 0] * off[:, 1] - span[:, 1] * off[:, 0])
        along = (off * span).sum(axis=1)
        assert ((cross < 1e-6) & (along >= -1e-9) & (along <= (span**2).sum(axis=1) + 1e-9)).any()
    again = imbalance.smote_rows(points, COLUMNS, 0.3, 5).toPandas()
    assert rows.sort_values("txn_id").equals(again.sort_values("txn_id"))


def test_ratio_already_reached(points):
    with pytest.raises(ValueError):
        imbalance.smote_rows(points, COLUMNS, 0.01)


def test_adasyn_follows_the_share_of_majority_neighbours(points):
    minority = points.where("isFraud = 1")
    near = brute(minority, points, 5)
    hard = {q: sum(t == 0 for _, _, t in n) / 5 for q, n in near.items()}
    counts = {r.isFraud: r["count"] for r in points.groupBy("isFraud").count().collect()}
    wanted = int(0.3 * counts[0]) - counts[1]
    total = sum(hard.values())
    rows = imbalance.adasyn_rows(points, COLUMNS, 0.3, 5)
    assert rows.count() == sum(int(np.rint(h / total * wanted)) for h in hard.values())


def test_edited_keeps_rows_whose_neighbours_agree(points):
    near = brute(points, points, 3)
    label = {r.txn_id: r.isFraud for r in points.collect()}
    want = {q for q, n in near.items() if all(t == label[q] for _, _, t in n)}
    assert {r.txn_id for r in imbalance.edited(points, COLUMNS, 3).collect()} == want


def test_unknown_method_means_smote(points):
    with pytest.warns(UserWarning):
        rows, method = imbalance.apply_method("magic", points, COLUMNS)
    assert method == "smote" and rows.count() > points.count()
    same, method = imbalance.apply_method("class_weight", points, COLUMNS)
    assert same is points and method == "class_weight"


@pytest.mark.parametrize("top_rows", [1 << 16, 256])
def test_many_columns_and_few_comparisons(spark, monkeypatch, top_rows):
    monkeypatch.setattr(neighbors, "_TOP_ROWS", top_rows)
    rng = np.random.default_rng(2)
    n = 4000
    base = rng.normal(size=(n, 4)) * [1, 5, 0.2, 50]
    flags = rng.integers(0, 2, (n, 6))
    rows = np.hstack([base, base[:, :1] ** 2, np.exp(base[:, 2:3]), base[:, :3] - base[:, 1:], flags, np.zeros((n, 1)), rng.integers(0, 5, (n, 6))]).round(2)
    rows[rng.random(n) < 0.1] = rows[7]  # copies
    names = [f"c{i}" for i in range(rows.shape[1])]
    assert len(names) == 22
    table = spark.createDataFrame([(f"k{i:05d}", int(i % 9 == 0), *map(float, r)) for i, r in enumerate(rows)], "txn_id string, isFraud int, " + ", ".join(f"{c} double" for c in names))
    got = neighbors.nearest(table, table, names, 4, tag="isFraud", cell_rows=100, counted=True).toPandas().set_index("txn_id")
    for i in range(0, n, 37):
        squared = np.zeros(n)
        for d in range(22):
            squared += (rows[i, d] - rows[:, d]) ** 2
        want = sorted((x, f"k{j:05d}") for j, x in enumerate(np.sqrt(squared)) if j != i)[:4]
        assert [(e["distance"], e["key"]) for e in got.neighbours[f"k{i:05d}"]] == want
    assert got.seen.mean() < 0.2 * n


@pytest.mark.parametrize("crowded_rows", [0, 1 << 20])
def test_copies_are_cut_to_the_smallest_keys(spark, crowded_rows):
    vectors = [([0.0, 1.0], 5), ([-0.0, 1.0], 4), ([None, 2.0], 7), ([2.0, None], 2), ([float("nan"), 0.0], 6), ([3.0, 3.0], 3), ([4.0, 4.0], 1)]
    rows = [(f"k{i:02d}", x, 0) for i, x in enumerate(x for x, n in vectors for _ in range(n))]
    stored = spark.createDataFrame(rows, "key string, x array<double>, tag int").repartition(4)
    got = neighbors.few_copies(stored, 3, crowded_rows)
    assert got.columns == stored.columns
    want = {}
    for key, x, _ in sorted(rows):
        want.setdefault(repr([None if v is None else v + 0.0 for v in x]), []).append(key)
    assert sorted(r["key"] for r in got.collect()) == sorted(k for keys in want.values() for k in keys[:3])
