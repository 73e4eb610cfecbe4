import hashlib
import math

import numpy as np
import pandas as pd
import pytest

from ledgerlens.operators import ensemble, trees

COLUMNS = ["a", "b", "c", "d", "e"]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(11)
    n = 900
    table = pd.DataFrame({"txn_id": [f"k{i:04d}" for i in range(n)], "a": rng.normal(size=n).round(2), "b": rng.integers(0, 2, n).astype(float),
                          "c": rng.exponential(size=n).round(1), "d": 1.0, "e": rng.integers(0, 30, n).astype(float)})
    score = table.a + 2 * table.b * (table.c > 1) - 0.1 * table.e + rng.normal(size=n)
    table["isFraud"] = (score > 0.5).astype(int)
    table["fold"] = np.arange(n) % 3
    return table


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows).repartition(5)


def brute_force(rows, rules, edges, leave_out=None):
    """Trees of (column, edge, value, covered rows) by node, grown on rows instead of histograms."""
    rows = rows if leave_out is None else rows[rows.fold != leave_out]
    x, y = rows[COLUMNS].to_numpy(), rows.isFraud.to_numpy()
    draw = np.array([int(hashlib.md5(f"{rules.seed}|rows|{k}".encode()).hexdigest()[:12], 16) % trees.PRIME for k in rows.txn_id])
    ones, zeros = y.sum(), len(y) - y.sum()
    heavy = {"balanced": max(ones, zeros) / ones, "subsample": 1.0}.get(rules.positive, rules.positive)
    light = max(ones, zeros) / zeros if rules.positive == "balanced" else 1.0
    margin = np.full(len(y), math.log(ones * heavy / (zeros * light)) if rules.start == "prior" else 0.0)
    shrink = lambda g: math.copysign(max(abs(g) - rules.l1, 0), g)
    worth = lambda g, h: shrink(g) ** 2 / (h + rules.l2) if h + rules.l2 > 0 else 0.0
    out = []
    for t in range(rules.rounds):
        digest = hashlib.md5(f"{rules.seed}|{t}".encode()).hexdigest()
        u = (draw * (1 + int(digest[:12], 16) % (trees.PRIME - 1)) + int(digest[12:24], 16) % trees.PRIME) % trees.PRIME / trees.PRIME
        times = np.ones(len(y), int)
        if rules.bootstrap:
            times = np.array([sum(v >= p for p in trees.POISSON) for v in u])
        elif rules.rows < 1:
            times = (u < rules.rows).astype(int)
        weight = np.where(y == 1, heavy, light) * times
        if rules.positive == "subsample":
            weight = times * np.where(y == 1, times.sum() / (2 * times[y == 1].sum()), times.sum() / (2 * times[y == 0].sum()))
        p = 1 / (1 + np.exp(-margin))
        g, h = (weight * y, weight) if rules.forest else (weight * (p - y), weight * p * (1 - p))
        g, h = np.rint(g * 2**20) / 2**20, np.rint(h * 2**20) / 2**20
        of_tree = range(len(COLUMNS)) if rules.columns == 1 else trees.drawn_columns(rules.seed, t, COLUMNS, max(1, int(rules.columns * 5)))

        def split_of(at, node):
            allowed = of_tree
            if rules.node_columns:
                allowed = [c for c in trees.drawn_columns(rules.seed, t, COLUMNS, int(math.sqrt(5)), node) if c in of_tree]
            best = None
            for c in allowed:
                for edge in edges[c]:
                    left, right = at[x[at, c] <= edge], at[x[at, c] > edge]
                    (gl, hl, nl), (gr, hr, nr) = ((g[s].sum(), h[s].sum(), len(s)) for s in (left, right))
                    if min(nl, nr) < max(rules.min_rows, 1) or len(at) < rules.min_split:
                        continue
                    if rules.criterion == "newton":
                        if min(hl, hr) < rules.min_hessian:
                            continue
                        gain = worth(gl, hl) + worth(gr, hr) - worth(gl + gr, hl + hr)
                    elif rules.criterion == "friedman":
                        gain = nl * nr / (nl + nr) * (gl / nl - gr / nr) ** 2
                    else:
                        gini = lambda a, b: b * (1 - (a / b) ** 2 - (1 - a / b) ** 2) if b else 0.0
                        gain = gini(gl + gr, hl + hr) - gini(gl, hl) - gini(gr, hr)
                    if gain > 1e-6 and (best is None or gain > best[0] + 1e-9):
                        best = (gain, c, edge)
            return best

        members, split = {1: np.flatnonzero(times > 0)}, {}

        def divide(node, c, edge):
            at = members[node]
            members[2 * node], members[2 * node + 1] = at[x[at, c] <= edge], at[x[at, c] > edge]

        if rules.growth == "leaf":
            while len(split) + 1 < rules.leaves:  # the best of all leaves, one at a time
                leaves = [(s[0], n, s) for n in members if n not in split and n < 2**rules.depth and (s := split_of(members[n], n))]
                if not leaves:
                    break
                _, node, s = max(leaves, key=lambda one: (one[0], -one[1]))
                split[node] = s
                divide(node, *s[1:])
        else:
            for level in range(rules.depth):
                nodes = [n for n in members if n.bit_length() - 1 == level]
                if rules.growth == "symmetric":
                    scores = [(sum(worth(g[s].sum(), h[s].sum()) for n in nodes for s in (members[n][x[members[n], c] <= e], members[n][x[members[n], c] > e])), c, e)
                              for c in of_tree for e in edges[c]]
                    top = max(s[0] for s in scores)
                    best = next(s for s in scores if s[0] > top - 1e-9)
                    if top - sum(worth(g[members[n]].sum(), h[members[n]].sum()) for n in nodes) <= 1e-6:
                        break
                    for n in nodes:
                        split[n] = best
                        divide(n, *best[1:])
                else:
                    for n in nodes:
                        if s := split_of(members[n], n):
                            split[n] = s
                            divide(n, *s[1:])
            if rules.gamma:
                for n in sorted(split, reverse=True):
                    if split[n][0] < rules.gamma and 2 * n not in split and 2 * n + 1 not in split:
                        del split[n]
        tree, todo = {}, [1]
        while todo:
            n = todo.pop()
            at = members[n]
            value = (g[at].sum() / h[at].sum() if len(at) else 0.0) if rules.forest else (
                -shrink(g[at].sum()) / (h[at].sum() + rules.l2) * rules.rate if h[at].sum() + rules.l2 > 0 else 0.0)
            tree[n] = (split[n][1:] if n in split else None, value, len(at))
            if n in split:
                todo += [2 * n, 2 * n + 1]
        out.append(tree)
        for i in range(len(y)):
            n = 1
            while tree[n][0]:
                n = 2 * n + int(x[i, tree[n][0][0]] > tree[n][0][1])
            margin[i] += 0 if rules.forest else tree[n][1]
    return out, margin


def same(model, want):
    assert len(model.trees) == len(want)
    for tree, other in zip(model.trees, want):
        assert set(trees._reached(tree)) == set(other)
        for n, (split, value, cover) in other.items():
            got = None if tree.column[n] < 0 else (tree.column[n], model.edges[tree.column[n]][tree.bin[n]])
            assert got == split and tree.cover[n] == cover and tree.value[n] == pytest.approx(value, abs=1e-9)


CASES = {
    "xgboost": dict(rounds=10, depth=5), "lightgbm": dict(rounds=4, leaves=6), "catboost": dict(rounds=10), "gradient_boosting": dict(rounds=3, depth=4),
    "random_forest": dict(rounds=6, depth=4),
}


@pytest.mark.parametrize("name", list(CASES))
def test_trees_equal_a_grower_on_rows(spark, table, rows, name, monkeypatch, tmp_path):
    if name == "xgboost":  # many small blocks, histograms added up by Spark, several groups of members
        monkeypatch.setattr(trees, "BLOCK_ROWS", 50)
        monkeypatch.setattr(trees, "DIRECT_BYTES", 0)
    if name == "random_forest":
        monkeypatch.setattr(trees, "PASS_BYTES", 1)
    rules = trees.rules_of(name, bins=12, min_rows=10 if name == "lightgbm" else trees.PRESETS[name].min_rows, **CASES[name])
    model = trees.grow(table, COLUMNS, [trees.Fit(rules)], [name])[0]
    want, margin = brute_force(rows, rules, model.edges)
    same(model, want)
    assert len(set().union(*want)) > 6
    scored = model.score(table).toPandas().set_index("txn_id").p
    if name != "random_forest":
        assert scored[rows.txn_id].to_numpy() == pytest.approx(1 / (1 + np.exp(-margin)), abs=1e-9)
    model.save(path := str(tmp_path / name))
    again = ensemble.load_model(spark, path)
    assert again.score(table).toPandas().set_index("txn_id").p[rows.txn_id].tolist() == scored[rows.txn_id].tolist()
    nodes = model.tree_table(spark)
    assert nodes.count() == sum(map(len, want)) and sum(r["importance"] for r in model.native_importance(spark).collect()) == pytest.approx(1)


def test_folds_in_one_pass_equal_separate_fits(spark, table, rows):
    rules = [trees.rules_of("xgboost", bins=12, rounds=9, depth=3), trees.rules_of("catboost", bins=12, rounds=3), trees.rules_of("random_forest", bins=12, rounds=3)]
    fits = [trees.Fit(r, f) for r in rules for f in (-1, 0, 2)]
    models = trees.grow(table, COLUMNS, fits, fold="fold")
    for fit, model in zip(fits, models):
        same(model, brute_force(rows, fit.rules, model.edges, None if fit.leave_out < 0 else fit.leave_out)[0])


def test_missing_values_and_refusals(spark, table, rows):
    rules = trees.rules_of("catboost", bins=12, rounds=1)
    model = trees.grow(table, COLUMNS, [trees.Fit(rules)])[0]
    odd = spark.createDataFrame([("x", None, 1.0, float("nan"), 1.0, 1.0), ("y", 99.0, 1.0, 99.0, 1.0, 1.0)], "txn_id string, a double, b double, c double, d double, e double")
    a, b = (r["p"] for r in model.score(odd).orderBy("txn_id").collect())
    assert a == b
    with pytest.raises(ValueError, match="both classes"):
        trees.grow(table.where("isFraud = 1"), COLUMNS, [trees.Fit(rules)])
    with pytest.raises(ValueError, match="both classes"):
        trees.grow(table.limit(0), COLUMNS, [trees.Fit(rules)], edges=[[]] * 5)
    with pytest.raises(ValueError, match="Unknown parameter"):
        trees.rules_of("xgboost", {"booster": "dart"})
    assert trees.rules_of("lightgbm", {"subsample": 0.7}).rows == 1.0


def test_presets_compare_and_search_in_shared_passes(spark, table, rows, monkeypatch):
    from ledgerlens.operators import models, tuning
    from ledgerlens.operators.ordering import fold_number

    small = {n: trees.rules_of(n, rounds=3, depth=3, bins=12, min_rows=5) for n in trees.PRESETS}
    monkeypatch.setattr(trees, "PRESETS", small)
    names = ["random_forest", "xgboost", "catboost"]
    compared = models.train_all(table, table, COLUMNS, names, folds=3)
    assert not compared.errors(spark).count() and {r["model"] for r in compared.table(spark).collect()} == set(names)
    by_name = {r[0]: r for r in compared.rows}
    folds = table.select("*", fold_number(table, "isFraud", 3, "42|folds").alias("f")).toPandas().set_index("txn_id").f
    own = rows.assign(fold=folds[rows.txn_id].to_numpy())
    scores = []
    for f in range(3):
        _, margin = brute_force(own, trees.rules_of("xgboost", rounds=3), compared.models["xgboost"].edges, f)
        trained = brute_force(own, trees.rules_of("xgboost", rounds=3), compared.models["xgboost"].edges, f)[0]
        held = own[own.fold == f]
        told = []
        for x in held[COLUMNS].to_numpy():
            total = 0.0
            for tree in trained:
                n = 1
                while tree[n][0]:
                    n = 2 * n + int(x[tree[n][0][0]] > tree[n][0][1])
                total += tree[n][1]
            told.append(int(total > 0))
        y = held.isFraud.to_numpy()
        told = np.array(told)
        scores.append(2 * (told * y).sum() / max(2 * (told * y).sum() + (told != y).sum(), 1))
    assert by_name["xgboost"][6] == pytest.approx(np.mean(scores)) and by_name["xgboost"][7] == pytest.approx(np.std(scores))
    assert models.train_all(table, table, ["nope"], ["xgboost"], folds=0).errors(spark).count() == 1

    monkeypatch.setattr(tuning, "FITS_PER_PASS", 4)
    spec = models.trainer("catboost", COLUMNS)
    space = {"depth": [1, 3], "learning_rate": [0.05, 0.5], "border_count": [4, 12]}
    search = tuning.tune(spec, table, space, "grid", folds=2)
    assert len(search.trials) == 8 and search.best_score == max(s for _, s in search.trials)
    one = tuning.tune(spec, table, {k: [v] for k, v in search.best_params.items()}, "grid", folds=2)
    assert one.best_score == search.best_score and one.model.trees == search.model.trees
    assert tuning.space_size(tuning.SPACES["xgboost"]) == 3**9


def test_ordered_statistics(spark):
    from ledgerlens.operators.features import ordered_statistics

    data = [(f"k{i}", None if i % 7 == 0 else "hot" if i % 3 else f"c{i % 4}", i % 2 if i % 11 else None) for i in range(500)]
    got = {r["txn_id"]: r["statistic"] for r in ordered_statistics(spark.createDataFrame(data, "txn_id string, kind string, isFraud int"), "kind").collect()}
    seen, want = {}, {}
    for key, kind, y in sorted(data, key=lambda r: hashlib.md5(f"42|{r[0]}".encode()).hexdigest()):
        n, ones = seen.get(kind, (0, 0))
        want[key] = (ones + 0.5) / (n + 1.0)
        seen[kind] = (n + 1, ones + (y or 0))
    assert got == want
    assert ordered_statistics(spark.createDataFrame([], "txn_id string, kind string, isFraud int"), "kind").count() == 0


def expected(tree, bins, known, node=1):
    """What the tree says when only the columns in ``known`` are known: other splits by the rows' shares."""
    c = tree.column[node]
    if c < 0:
        return tree.value[node]
    left, right = 2 * node, 2 * node + 1
    if c in known:
        return expected(tree, bins, known, left if bins[c] <= tree.bin[node] else right)
    return sum(expected(tree, bins, known, n) * tree.cover[n] / tree.cover[node] for n in (left, right))


@pytest.mark.parametrize("name", ["xgboost", "catboost", "random_forest"])
def test_shap_equals_all_coalitions(spark, table, rows, name):
    from itertools import combinations

    from ledgerlens.operators import explain

    model = trees.grow(table, COLUMNS, [trees.Fit(trees.rules_of(name, bins=12, rounds=4, depth=5))])[0]
    got = explain.tree_shap(model, table).toPandas().set_index("txn_id")
    scored = model.score(table).toPandas().set_index("txn_id").p
    for i in range(0, 900, 90):
        key, x = rows.txn_id[i], rows.loc[i, COLUMNS].to_numpy(float)
        bins = [int(np.searchsorted(e, v)) for e, v in zip(model.edges, x)]
        scale = 1 / 4 if name == "random_forest" else 1.0
        worth = {s: model.start + scale * sum(expected(t, bins, s) for t in model.trees) for k in range(6) for s in combinations(range(5), k)}
        for c in range(5):
            others = [d for d in range(5) if d != c]
            want = sum(math.factorial(k) * math.factorial(4 - k) / 120 * (worth[tuple(sorted((*s, c)))] - worth[s]) for k in range(5) for s in combinations(others, k))
            assert got.loc[key, COLUMNS[c]] == pytest.approx(want, abs=1e-9)
        assert got.base[key] == pytest.approx(worth[()])
        assert got.margin[key] == pytest.approx(scored[key] if name == "random_forest" else math.log(scored[key] / (1 - scored[key])), abs=1e-6)
    assert explain.explain_model(model, table, COLUMNS, 50)[1] == "tree_shap"


def test_rows_walk_and_histograms_are_exact():
    rng = np.random.default_rng(3)
    n, width = 20_000, 8
    bins = rng.integers(0, width, (5, n)).astype(np.uint8)
    column, cut = np.full(16, -1, np.int16), np.zeros(16, np.int16)
    for node in (1, 2, 3, 5, 6):
        column[node], cut[node] = rng.integers(0, 5), rng.integers(1, 6)
    rows = np.sort(rng.choice(n, 12_000, replace=False))
    at = trees._walked(bins, column, cut, 3, rows)
    for r, found in zip(rows[:300], at):
        node = 1
        while column[node] >= 0:
            node = 2 * node + int(bins[column[node], r] > cut[node])
        assert found == node
    assert (trees._walked(bins, column, cut, 3)[rows] == at).all()
    first, second = np.rint(rng.normal(size=len(rows)) * 2**20) * (rng.random(len(rows)) < 0.3), np.rint(rng.random(len(rows)) * 2**20)
    for nodes in (3, 700):  # pairs of columns, and single ones
        place = rng.integers(0, nodes, len(rows))
        got = trees._histograms(bins, rows, place, first, second, nodes, width)
        want = np.zeros((3, 5, nodes, width))
        for c in range(5):
            for i, values in enumerate((first, second, np.ones(len(rows)))):
                np.add.at(want[i, c], (place, bins[c, rows]), values)
        assert (got == want).all()


def test_one_task_an_ensemble_gives_the_trees_of_the_passes(spark, table, monkeypatch):
    from ledgerlens.operators.ordering import fold_number

    parts = table.withColumn("_fold", fold_number(table, "isFraud", 2, "f")).repartition(3)
    monkeypatch.setattr(trees, "BLOCK_ROWS", 100)
    fits = [trees.Fit(trees.rules_of(n, bins=12, rounds=3, depth=4), f) for n in trees.PRESETS for f in (-1, 0, 1)]
    local = trees.grow(parts, COLUMNS, fits, fold="_fold")
    monkeypatch.setattr(trees, "LOCAL_ROWS", 0)
    passes = trees.grow(parts, COLUMNS, fits, fold="_fold")
    for a, b in zip(local, passes):
        assert a.trees == b.trees and a.held == b.held and a.start == b.start
