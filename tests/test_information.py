import hashlib
import math

import numpy as np
import pytest

from ledgerlens.operators import information

COLUMNS = ["a", "y", "flag", "same", "rare"]


def digamma(n):
    return sum(1 / i for i in range(1, n)) - 0.5772156649015329


def brute_force(rows, k=3):
    """By all pairs, in the same whole numbers."""
    out = {}
    for c, name in enumerate(COLUMNS):
        top = max(abs(r[2 + c] or 0.0) for r in rows)
        scale = 2.0 ** (35 - math.ceil(math.log2(top))) if top else 1.0
        v = np.array([int(np.rint((r[2 + c] or 0.0) * scale)) * 2**26 + int(hashlib.md5(f"42|near|{name}|{r[0]}".encode()).hexdigest()[:7], 16) % 2**26 for r in rows])
        y = np.array([r[1] for r in rows])
        sizes = {u: int((y == u).sum()) for u in set(y.tolist())}
        use = np.array([sizes[u] > 1 for u in y.tolist()])
        v, y = v[use], y[use]
        near, own, size = [], [], []
        for i in range(len(v)):
            away = np.abs(v - v[i])
            kk = min(k, sizes[y[i]] - 1)
            d = np.sort(away[y == y[i]])[kk]
            near.append(digamma(int((away < d).sum()) if d else int((away == 0).sum())))
            own.append(digamma(kk))
            size.append(digamma(sizes[y[i]]))
        out[name] = max(0.0, digamma(len(v)) + np.mean(own) - np.mean(size) - np.mean(near))
    return out


@pytest.mark.parametrize("chunk_rows", [10**6, 60, 25])
def test_information_equals_brute_force(spark, chunk_rows):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(700):
        label = 2 if i == 13 else 1 if i in (5, 6) or rng.random() < 0.05 else 0  # a class of one row
        x = rng.normal() + label
        rows.append((f"k{i}", label, round(x, 1), float(rng.exponential() ** 4 * 1e6), float(label if rng.random() < 0.8 else 0), 3.5,
                     None if i % 50 else float(i)))
    rows += [(f"dup{i}", 0, 0.5, 1e6, 0.0, 3.5, None) for i in range(150)]
    table = spark.createDataFrame(rows, "txn_id string, isFraud int, a double, y double, flag double, same double, rare double").repartition(3)
    got = {r["feature"]: r["mi"] for r in information.neighbour_information(table, COLUMNS, chunk_rows=chunk_rows).collect()}
    want = brute_force(rows)
    assert got == pytest.approx(want, abs=1e-9) and want["flag"] > 0.01


def test_no_rows_and_lone_rows(spark):
    schema = "txn_id string, isFraud int, a double"
    for rows in ([], [("x", 1, 1.0), ("y", 0, 2.0)], [("x", None, 1.0)]):
        got = information.neighbour_information(spark.createDataFrame(rows, schema), ["a"]).collect()
        assert [(r["feature"], r["mi"]) for r in got] == [("a", 0.0)]


def test_distances_and_psi():
    rng = np.random.default_rng(0)
    x = np.sort(rng.integers(0, 50, 40))
    for k in (1, 3, 5):
        want = [sorted(abs(x - x[i]))[k] for i in range(40)]
        assert information.kth_distance(x, np.arange(40), k).tolist() == want
    assert information.digamma(np.arange(1, 40)) == pytest.approx([digamma(n) for n in range(1, 40)], abs=1e-10)


def test_feature_selection_by_neighbours(spark, tx):
    from ledgerlens.operators.features import fit_transform

    model, _ = fit_transform(tx, information="neighbours")
    assert len(model.selected) >= 5 and list(model.scores.values()) == sorted(model.scores.values(), reverse=True)
    assert set(model.selected) <= set(model.scores)
