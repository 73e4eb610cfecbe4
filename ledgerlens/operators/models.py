"""Classifier presets on ``pyspark.ml``, training, comparison and cross-validated scores.

Tree presets are grown by :mod:`.trees` with all their parameters; the logistic regression and the
small variants for interactive use are estimators of ``pyspark.ml``.
"""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field, replace

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import LABEL
from ..session import small_table, stage
from . import evaluate, trees
from .imbalance import weight_column
from .ordering import fold_number

# The logistic preset (C is the inverse regularisation strength), and the class weights of the small variants.
PRESETS = {
    "logistic_regression": {"kind": "logistic", "weights": "balanced", "C": 1.0, "maxIter": 5000},
    "random_forest": {"kind": "forest", "weights": "balanced", "minInstancesPerNode": 12, "featureSubsetStrategy": "sqrt"},
    "gradient_boosting": {"kind": "boosting", "weights": None, "subsamplingRate": 0.85, "minInstancesPerNode": 3, "featureSubsetStrategy": "sqrt"},
    "xgboost": {"kind": "boosting", "weights": 5.0, "subsamplingRate": 0.85, "featureSubsetStrategy": "0.85", "minInstancesPerNode": 2},
    "lightgbm": {"kind": "boosting", "weights": 3.0, "subsamplingRate": 0.7, "featureSubsetStrategy": "0.7", "minInstancesPerNode": 25},
    "catboost": {"kind": "boosting", "weights": "balanced"},
}
# Small variants for interactive use: fewer rounds, shallower trees.
SMALL = {
    "logistic": {"maxIter": 20},
    "forest": {"numTrees": 10, "maxDepth": 5},
    "boosting": {"maxIter": 8, "maxDepth": 4, "stepSize": 0.3, "minInfoGain": 0.0},
}
_ESTIMATORS = {"logistic": LogisticRegression, "forest": RandomForestClassifier, "boosting": GBTClassifier}


@dataclass
class FittedModel:
    """A fitted classifier with its input columns."""

    name: str
    columns: list[str]
    stages: PipelineModel

    @property
    def classifier(self):
        return self.stages.stages[-1]

    def score(self, df: DataFrame) -> DataFrame:
        """Adds ``p`` (fraud probability) and ``prediction`` to the rows."""
        scored = self.stages.transform(df)
        return scored.select(
            *df.columns,
            vector_to_array("_probability")[1].alias("p"),
            F.col("_prediction").cast("int").alias("prediction"),
        )

    def native_importance(self, spark: SparkSession) -> DataFrame:
        """(feature, importance): tree importances, or absolute coefficients."""
        model = self.classifier
        values = model.featureImportances if hasattr(model, "featureImportances") else model.coefficients
        rows = [(c, abs(float(v))) for c, v in zip(self.columns, values.toArray())]
        return small_table(spark, rows, {"feature": "string", "importance": "double"})

    def save(self, path: str) -> None:
        self.stages.write().overwrite().save(f"{path}/stages")
        write_about(path, {"kind": "single", "name": self.name, "columns": self.columns})


def write_about(path: str, content: dict) -> None:
    spark = SparkSession.active()
    small_table(spark, [(json.dumps(content),)], {"value": "string"}).write.mode("overwrite").text(f"{path}/about")


def read_about(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/about").first()[0])


@dataclass
class Trainer:
    """An unfitted classifier: kind, class weighting and parameters."""

    name: str
    columns: list[str]
    kind: str
    weights: str | float | None = None
    params: dict = field(default_factory=dict)
    seed: int = 42

    def estimator(self, total_weight: float):
        options = {
            "featuresCol": "_features", "labelCol": LABEL, "predictionCol": "_prediction",
            "probabilityCol": "_probability", "rawPredictionCol": "_raw",
        }
        params = dict(self.params)
        if self.kind == "logistic":
            # Spark averages the weighted loss; dividing by the weight sum restores C.
            params["regParam"] = 1.0 / (params.pop("C", 1.0) * max(total_weight, 1.0))
            params.update(elasticNetParam=0.0, standardization=False)
        else:
            params["seed"] = self.seed
        if self.weights is not None:
            options["weightCol"] = "_weight"
        estimator = _ESTIMATORS[self.kind]()
        for name, value in {**options, **params}.items():
            estimator.set(estimator.getParam(name), value)
        return estimator

    def assembler(self) -> VectorAssembler:
        return VectorAssembler(inputCols=self.columns, outputCol="_features", handleInvalid="keep")

    def weighted(self, df: DataFrame) -> tuple[DataFrame, float]:
        """Training rows with ``_weight`` and the weight sum."""
        counts = {r[LABEL]: r["count"] for r in df.groupBy(LABEL).count().collect()}  # one row per class
        if self.weights is None:
            weights = {c: 1.0 for c in counts}
        elif self.weights == "balanced":
            total = sum(counts.values())
            weights = {c: total / (len(counts) * n) for c, n in counts.items()}
        else:
            weights = {0: 1.0, 1: float(self.weights)}
        return df.withColumn("_weight", weight_column(weights)), sum(weights[c] * n for c, n in counts.items())

    def fit(self, df: DataFrame) -> FittedModel:
        rows, total = self.weighted(df)
        assembler = self.assembler()
        model = self.estimator(total).fit(assembler.transform(rows.select(LABEL, "_weight", *self.columns)))
        return FittedModel(self.name, self.columns, PipelineModel([assembler, model]))

    def with_params(self, params: dict) -> "Trainer":
        return replace(self, params={**self.params, **params})


def trainer(name: str, columns: list[str], small: bool = False, seed: int = 42) -> Trainer | trees.TreeTrainer:
    if not small and name in trees.PRESETS:
        return trees.trainer(name, columns, seed)
    params = dict(PRESETS[name])
    kind, weights = params.pop("kind"), params.pop("weights")
    if small:
        params.update(SMALL[kind])
    return Trainer(name, columns, kind, weights, params, seed)


def logistic(columns: list[str], weights: str | float | None = "balanced", max_iter: int = 5000) -> Trainer:
    return Trainer("logistic_regression", columns, "logistic", weights, {"C": 1.0, "maxIter": max_iter})


def f1_of(scored: DataFrame) -> float:
    row = evaluate.confusion(scored).first()
    return 2.0 * row["tp"] / max(2 * row["tp"] + row["fp"] + row["fn"], 1)


def cv_scores(spec: Trainer, df: DataFrame, folds: int = 3, seed: int | str = 42) -> list[float]:
    """F1 per stratified fold."""
    parts = df
    if "_fold" not in df.columns:
        parts = stage(df.withColumn("_fold", fold_number(df, LABEL, folds, f"{seed}|folds")), "folds", ("_fold",))
    scores = []
    for fold in range(folds):
        model = spec.fit(parts.where(F.col("_fold") != fold))
        scores.append(f1_of(model.score(parts.where(F.col("_fold") == fold))))
    return scores


def cv_table(spark: SparkSession, scores: dict[str, list[float]]) -> DataFrame:
    """Mean and population standard deviation of the fold scores per model."""
    rows = [(m, i, s) for m, values in scores.items() for i, s in enumerate(values)]
    table = small_table(spark, rows, {"model": "string", "fold": "int", "f1_score": "double"})
    return table.groupBy("model").agg(
        F.avg("f1_score").alias("cv_mean"), F.stddev_pop("f1_score").alias("cv_std"), F.count("*").alias("folds")
    )


@dataclass
class Comparison:
    """Fitted candidates, their scored validation rows and their result rows."""

    models: dict[str, FittedModel]
    scored: dict[str, DataFrame]
    rows: list[tuple]

    COLUMNS = {
        "model": "string", "accuracy": "double", "precision": "double", "recall": "double", "f1_score": "double",
        "roc_auc": "double", "cv_mean": "double", "cv_std": "double", "training_time": "double", "error": "string",
    }

    def table(self, spark: SparkSession) -> DataFrame:
        """Models that did not fail, by F1, with rank and ``is_best``."""
        return evaluate.comparison_rank(small_table(spark, self.rows, self.COLUMNS).where("error is null"))

    def errors(self, spark: SparkSession) -> DataFrame:
        return small_table(spark, self.rows, self.COLUMNS).where("error is not null").select("model", "error")

    def ranked(self) -> list[str]:
        done = [r for r in self.rows if r[-1] is None]
        return [r[0] for r in sorted(done, key=lambda r: (-r[4], r[0]))]

    @property
    def best(self) -> str | None:
        ranked = self.ranked()
        return ranked[0] if ranked else None


def _grown(parts: DataFrame, columns: list[str], names: list[str], folds: int, seed: int) -> dict[str, tuple | Exception]:
    """(model, F1 of the folds, seconds) of each tree preset, grown together with its fits without each fold."""
    if not names:
        return {}
    left_out = [-1, *(range(folds) if folds > 1 else ())]
    start = time.time()
    try:
        fits = [trees.Fit(trees.rules_of(n, seed=seed), f) for n in names for f in left_out]
        models = trees.grow(parts, columns, fits, [n for n in names for _ in left_out], fold="_fold" if folds > 1 else None)
    except Exception as problem:  # noqa: BLE001 - reported as an error row of each preset
        return dict.fromkeys(names, problem)
    took = time.time() - start
    each = len(left_out)
    return {n: (models[i * each], [m.held_f1 for m in models[i * each + 1 : (i + 1) * each]], took) for i, n in enumerate(names)}


def train_all(
    train: DataFrame, valid: DataFrame, columns: list[str], names: list[str] | None = None,
    folds: int = 3, small: bool = False, seed: int = 42,
) -> Comparison:
    """Trains the known candidates; one that fails becomes an error row.

    The tree presets and their fits of all folds grow together, one pass over the rows for a level of all of them; their
    training time is that of the whole group.
    """
    result = Comparison({}, {}, [])
    parts = train
    if folds > 1:
        parts = stage(train.withColumn("_fold", fold_number(train, LABEL, folds, f"{seed}|folds")), "cv", ("_fold",))
    names = [n for n in names or list(PRESETS) if n in PRESETS]
    grown = {} if small else _grown(parts, columns, [n for n in names if n in trees.PRESETS], folds, seed)
    for name in names:
        try:
            if name in grown:
                if isinstance(grown[name], Exception):
                    raise grown[name]
                model, scores, took = grown[name]
            else:
                spec = trainer(name, columns, small, seed)
                start = time.time()
                model = spec.fit(train)
                took = time.time() - start
                scores = cv_scores(spec, parts, folds, seed) if folds > 1 else []
            scored = model.score(valid)
            row = evaluate.metrics(scored, name).first()
            mean = sum(scores) / len(scores) if scores else None
            spread = (sum((s - mean) ** 2 for s in scores) / len(scores)) ** 0.5 if scores else None
            result.rows.append(
                (name, row["accuracy"], row["precision"], row["recall"], row["f1_score"], row["roc_auc"], mean, spread, took, None)
            )
            result.models[name], result.scored[name] = model, scored
        except Exception as problem:  # noqa: BLE001 - reported as an error row
            result.rows.append((name, *[None] * 8, str(problem)[:300]))
    return result
