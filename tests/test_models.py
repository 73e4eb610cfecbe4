import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import ensemble, explain, models, trees, tuning
from ledgerlens.plans.training import load_run, prepare, training_run
from ledgerlens.sources.config import RunConfig, configured

from .conftest import SF

NAMES = ["logistic_regression", "random_forest", "lightgbm"]


@pytest.fixture(scope="module")
def ready(tx):
    return prepare(tx, RunConfig())


@pytest.fixture(scope="module")
def compared(ready):
    return models.train_all(ready.train, ready.test, ready.features.selected, NAMES + ["nope"], folds=0, small=True)


def test_candidates_are_ranked_and_good(spark, compared):
    rows = compared.table(spark).orderBy("rank").collect()
    assert len(rows) == 3 and rows[0].is_best == 1 and rows[0].f1_score >= rows[1].f1_score >= rows[2].f1_score
    assert all(r.roc_auc > 0.9 for r in rows) and compared.best == rows[0].model


def test_a_failing_model_is_an_error_row(spark, ready):
    broken = models.train_all(ready.train, ready.test, ["missing"], ["random_forest"], folds=0, small=True)
    assert broken.best is None and broken.errors(spark).count() == 1


def test_logistic_penalty_restores_c(ready):
    spec = models.trainer("logistic_regression", ready.features.selected)
    n = ready.train.count()
    _, total = spec.weighted(ready.train)
    assert total == pytest.approx(n)
    estimator = spec.estimator(total)
    assert estimator.getRegParam() == pytest.approx(1 / n) and not estimator.getStandardization()


def test_search_draws_distinct_points():
    space = {"a": [1, 2, 3], "b": [4, 5]}
    assert tuning.space_size(space) == 6
    grid = tuning.candidates(space, "grid", 1, 0)
    assert len(grid) == 6 and len({str(p) for p in grid}) == 6
    drawn = tuning.candidates(space, "random", 4, 1)
    assert len({str(p) for p in drawn}) == 4 and drawn == tuning.candidates(space, "random", 4, 1)
    assert len(tuning.candidates(space, "random", 50, 1)) == 6
    with pytest.raises(ValueError):
        tuning.candidates(space, "bayesian", 1, 0)


def test_tuning_refits_the_best(spark, ready):
    spec = models.trainer("random_forest", ready.features.selected, small=True)
    search = tuning.tune(spec, ready.train, {"maxDepth": [1, 5]}, "grid", folds=2)
    assert search.best_score == max(s for _, s in search.trials)
    assert models.f1_of(search.model.score(ready.test)) > 0.3
    assert search.summary(spark).where("is_best = 1").count() == 1
    plain = tuning.tune(spec, ready.train, {}, folds=2)
    assert plain.best_params == {} and plain.best_score == 0.0


def test_ensembles_and_persistence(spark, ready, compared, tmp_path):
    specs = {n: models.trainer(n, ready.features.selected, small=True) for n in compared.models}
    soft = ensemble.vote(compared.models, "soft")
    row = soft.score(ready.test).limit(5).collect()
    member = ensemble.member_scores(ready.test, compared.models)
    mean = member.select("txn_id", (sum(F.col(f"_p_{n}") for n in compared.models) / 3).alias("m"))
    by_key = {r.txn_id: r.m for r in mean.collect()}
    assert all(r.p == pytest.approx(by_key[r.txn_id]) and r.prediction == int(r.p > 0.5) for r in row)
    stacked = ensemble.stack(specs, compared.models, ready.train, max_iter=20)
    for model in (soft, ensemble.vote(compared.models, "hard"), stacked):
        model.save(str(tmp_path / model.name))
        loaded = ensemble.load_model(spark, str(tmp_path / model.name))
        a = model.score(ready.test).select("txn_id", "p").toPandas().sort_values("txn_id")
        b = loaded.score(ready.test).select("txn_id", "p").toPandas().sort_values("txn_id")
        assert a.p.to_numpy() == pytest.approx(b.p.to_numpy())
    with pytest.raises(ValueError):
        ensemble.vote(compared.models, "loud")


@pytest.mark.parametrize("name", ["random_forest", "lightgbm"])
def test_tree_shap_adds_up_to_the_model(ready, compared, name):
    model = compared.models[name]
    shap = explain.tree_shap(model, ready.test).select("txn_id", "margin")
    p = F.col("margin") if name == "random_forest" else 1 / (1 + F.exp(-2 * F.col("margin")))
    gap = shap.join(model.score(ready.test).select("txn_id", "p"), "txn_id").agg(F.max(F.abs(F.col("p") - p)))
    assert gap.first()[0] < 1e-9


def test_tree_shap_equals_the_shapley_definition(ready, compared):
    """Brute force over all coalitions for one row and a few trees."""
    import itertools
    import math

    import numpy as np

    model = compared.models["lightgbm"]
    nodes = explain.tree_nodes(model, ready.test.sparkSession)
    nodes = nodes[nodes.tree < 2]
    row = ready.test.select(*model.columns).orderBy(*model.columns[:2]).limit(1).toPandas().to_numpy(float)
    phi, base = explain.shap_of_paths(row, explain.leaf_paths(nodes))

    def value(known):
        total = 0.0
        for _, tree in nodes.groupby("tree"):
            at = tree.set_index("node")

            def walk(n):
                r = at.loc[n]
                if r.left < 0:
                    return r.value * r.scale
                if int(r.feature) in known:
                    return walk(int(r.left) if row[0, int(r.feature)] <= r.threshold else int(r.right))
                parts = [(at.loc[int(c)].cover / r.cover, int(c)) for c in (r.left, r.right)]
                return sum(w * walk(c) for w, c in parts)

            total += walk(0)
        return total

    used = sorted({int(f) for f in nodes[nodes.left >= 0].feature})
    assert value(()) == pytest.approx(base)
    for f in used[:4]:
        others = [g for g in used if g != f]
        want = 0.0
        for size in range(len(others) + 1):
            weight = math.factorial(size) * math.factorial(len(used) - size - 1) / math.factorial(len(used))
            for s in itertools.combinations(others, size):
                want += weight * (value((*s, f)) - value(s))
        assert phi[0, f] == pytest.approx(want, abs=1e-9)


def test_kernel_shap_adds_up(ready, compared):
    model = compared.models["logistic_regression"]
    rows = ready.test.orderBy("txn_id").limit(3)
    shap = explain.kernel_shap(model, rows, model.columns, explain.background(ready.train, model.columns, k=3)).toPandas()
    assert len(shap) == 3
    assert (shap[model.columns].sum(axis=1) + shap.base).to_numpy() == pytest.approx(shap.p.to_numpy())


def test_linear_shap_adds_up(ready):
    weights = {c: float(i + 1) for i, c in enumerate(ready.features.selected[:3])}
    shap = explain.linear_shap(ready.test, weights)
    for r in shap.agg(*[F.avg(c).alias(c) for c in weights]).collect():
        assert all(abs(v) < 1e-6 for v in r)


def test_training_run_saves_and_scores(spark, tx, tmp_path):
    config = configured({
        "data": {"max_training_rows": 3000, "target_fraud_ratio": 0.15}, "sampling": {"strategy": "stratified"},
        "imbalance": {"method": "class_weight"}, "models": {"candidates": ["random_forest", "lightgbm"], "small": True},
        "tuning": {"n_iter": 1, "cv_folds": 2}, "evaluation": {"shap_sample_size": 50},
    })
    run = training_run(tx, config)
    summary = run.tables["summary"].first()
    assert summary.roc_auc > 0.9 and summary.best_model == run.model_name and summary.models_compared == 2
    run.save(str(tmp_path / "run"))
    loaded = load_run(spark, str(tmp_path / "run"))
    batch = tx.limit(20).withColumn("type", F.when(F.col("type") == "DEBIT", "CRYPTO").otherwise(F.col("type")))
    scored = loaded.score(batch)
    assert scored.count() == 20
    assert {"p", "prediction", "risk_level", "risk_factors", "recommendation", "confidence"} <= set(scored.columns)


def test_prepared_features_are_not_stored(spark, tx, tmp_path):
    import os

    from ledgerlens.plans.training import prepare
    from ledgerlens.session import shared_folder
    from ledgerlens.sources.config import RunConfig

    def held():
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(shared_folder(spark)) for f in files)

    before = held()
    ready = prepare(tx, RunConfig())
    added = held() - before
    ready.train.unionByName(ready.test).write.parquet(str(tmp_path / "features"))
    features = sum(f.stat().st_size for f in (tmp_path / "features").iterdir())
    # Only the columns that features are made of stay.
    assert 0 < added < features / 2
    assert ready.train.count() + ready.test.count() == tx.dropDuplicates([c for c in tx.columns if c != "txn_id"]).count()


def test_train_compare_trains_all_presets_in_full(spark, monkeypatch):
    from ledgerlens.plans.jobs import QUERIES

    given = []

    def fit(spec, parts):
        given.append((spec.name, spec.params.get("maxIter")))
        raise RuntimeError("lost")

    def grow(parts, columns, fits, names=None, **options):
        assert all(f.rules == trees.rules_of(n) for f, n in zip(fits, names)) and [f.leave_out for f in fits[:4]] == [-1, 0, 1, 2]
        given.extend(dict.fromkeys(names))
        raise RuntimeError("lost")

    monkeypatch.setattr(models.Trainer, "fit", fit)
    monkeypatch.setattr(trees, "grow", grow)
    with pytest.raises(RuntimeError, match="lost"):
        QUERIES["train_compare"](spark, SF)
    assert set(given) == {("logistic_regression", 5000), *trees.PRESETS}
