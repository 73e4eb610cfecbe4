"""The full training run: load, sample, split, features, imbalance, models, tuning,
ensemble, evaluation, explanation and result tables."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import charts, clean, ensemble, evaluate, explain, imbalance, models, ordering, profile, results, sampling, tuning
from ..operators.features import FeatureModel
from ..operators.scoring import score as score_rows
from ..schema import KEY, LABEL
from ..session import delete_folder, new_folder, read_staged, small_table, stage, write_staged
from ..sources.config import RunConfig
from ..sources.readers import FILE_ROW
from ..sources.writers import write_report, write_results


@dataclass
class Run:
    """A finished run: the chosen model, the fitted features and the result tables."""

    model_name: str
    model: object
    features: FeatureModel
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def score(self, df: DataFrame) -> DataFrame:
        """Batch scoring; a type never seen in training takes the batch's mean amount."""
        known = F.col("type").isin(*self.features.type_stats)
        unseen = None
        if df.where(~known).limit(1).count():
            unseen = df.agg(F.avg("amount")).first()[0]
        return score_rows(df, self.features, self.model, unseen)

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        self.model.save(f"{path}/model")
        rows = [(self.model_name, self.features.to_json())]
        small_table(spark, rows, {"model_name": "string", "features": "string"}).write.mode("overwrite").parquet(f"{path}/features")
        write_results(self.tables, f"{path}/results")
        write_report(self.tables["report"], f"{path}/report")


def load_run(spark: SparkSession, path: str) -> Run:
    """The scoring half of a saved run."""
    row = spark.read.parquet(f"{path}/features").first()
    return Run(row["model_name"], ensemble.load_model(spark, f"{path}/model"), FeatureModel.from_json(row["features"]))


@dataclass
class Prepared:
    features: FeatureModel
    train: DataFrame
    test: DataFrame


def prepare(df: DataFrame, config: RunConfig) -> Prepared:
    """Clean, split, stage both parts and fit features (on the training rows unless told otherwise).

    Staged are the columns that features are made of, and both parts are projections of them: features hold
    several times their bytes.
    """
    options, seed, spark = config.preprocessing, config.data.random_state, df.sparkSession
    unique = clean.drop_flag(clean.drop_identifiers(clean.drop_duplicates(df)))
    path = new_folder(spark, "distinct")
    write_staged(unique, path)
    distinct = read_staged(spark, path, unique.schema)
    cleaned = distinct.drop(*[c for c in clean.sparse_columns(distinct) if c != KEY])
    split = ordering.split_flag(cleaned, LABEL, config.data.test_size, seed)
    parts = stage(cleaned.withColumn("_split", split), "split", ("_split",))
    delete_folder(spark, path)
    train, test = (parts.where(F.col("_split") == part).drop("_split") for part in ("train", "test"))
    features = FeatureModel(options.scaling_method, options.feature_selection, options.variance_threshold, options.information)
    features.fit(parts.drop("_split") if options.fit_on == "all" else train)
    return Prepared(features, features.transform(train), features.transform(test))


def training_run(df: DataFrame, config: RunConfig | None = None) -> Run:
    """Runs all stages on a keyed transactions table."""
    config = config or RunConfig()
    spark, started = df.sparkSession, time.time()
    data, seed = config.data, config.data.random_state
    tables: dict[str, DataFrame] = {"dataset": profile.profile_dataset(df)}

    order = (FILE_ROW if FILE_ROW in df.columns else "step") if data.start_row else None
    loaded = sampling.load_fraud_preserving(
        df, data.max_training_rows, data.start_row, data.target_fraud_ratio, order, seed
    ).drop(FILE_ROW)
    sampled = stage(sampling.sample(loaded, config.sampling.strategy, data.max_training_rows, seed), "sampled")
    tables["sampling"] = sampled.agg(
        F.lit(config.sampling.strategy).alias("strategy"), F.count("*").alias("sampled_rows"),
        F.sum(F.col(LABEL).cast("bigint")).alias("fraud_count"), F.avg(LABEL).alias("fraud_ratio"),
    )

    prepared = prepare(sampled, config)
    features, train, test = prepared.features, prepared.train, prepared.test
    columns = features.selected
    tables["feature_scores"] = features.feature_scores(spark)

    method, ratio = config.imbalance.method, config.imbalance.sampling_strategy
    if method == "auto":
        method, _ = imbalance.auto_select(train, columns, ratio, seed)
    balanced, method = imbalance.apply_method(method, train, columns, ratio, seed)
    if balanced is not train:
        balanced = stage(balanced, "balanced")
    size = lambda t, p: t.agg(F.count("*").alias(f"{p}_train_size"), F.avg(LABEL).alias(f"{p}_fraud_ratio"))
    tables["imbalance"] = size(train, "original").join(F.broadcast(size(balanced, "balanced"))).withColumn(
        "method", F.lit(method)
    )

    chosen = config.models
    compared = models.train_all(balanced, test, columns, chosen.candidates, min(config.tuning.cv_folds, 3), chosen.small, seed)
    tables["model_comparison"] = compared.table(spark)
    tables["model_errors"] = compared.errors(spark)
    if compared.best is None:
        raise RuntimeError("no candidate model could be trained")

    specs = {n: models.trainer(n, columns, chosen.small, seed) for n in compared.models}
    space = tuning.SPACES.get(compared.best)
    if chosen.small and compared.best == "random_forest":
        space = {"maxDepth": [4, 5], "minInstancesPerNode": [5, 10]}
    elif chosen.small and compared.best != "logistic_regression":
        space = {"maxDepth": [3, 4], "stepSize": [0.2, 0.3]}
    search = tuning.tune(
        specs[compared.best], balanced, space, config.tuning.method, config.tuning.n_iter, config.tuning.cv_folds, seed
    )
    tables["tuning"] = search.summary(spark)

    top = compared.ranked()[:3]
    combined, combined_f1 = None, None
    if chosen.build_ensemble and len(top) >= 2:
        combined, scores = ensemble.best_ensemble(
            {n: specs[n] for n in top}, {n: compared.models[n] for n in top}, balanced, test, seed,
            max_iter=50 if chosen.small else 5000,
        )
        combined_f1 = scores.get(combined.name) if combined else None
    tuned_f1 = models.f1_of(search.model.score(test))
    candidates = [("tuned", compared.best, float(tuned_f1))]
    if combined is not None:
        candidates.append(("ensemble", combined.name, float(combined_f1)))
    final = evaluate.select_final(small_table(spark, candidates, {"kind": "string", "name": "string", "f1_score": "double"}))
    name = final.first()["selected"]
    model = combined if name.startswith("ensemble_") else search.model

    scored = stage(model.score(test).select(KEY, LABEL, "p", "prediction"), "scored")
    tables["final_evaluation"] = stage(evaluate.metrics(scored, name), "final")
    tables["classification_report"] = evaluate.classification_report(scored)
    by_model = {n: stage(s.select(LABEL, "p", "prediction"), f"scored-{n}") for n, s in compared.scored.items()}
    every = None
    for n, s in by_model.items():
        row = evaluate.metrics(s, n)
        every = row if every is None else every.unionByName(row)
    tables["all_evaluations"] = every
    tables["report"] = evaluate.evaluation_report(tables["final_evaluation"])

    importance, how = explain.explain_model(model, test, columns, config.evaluation.shap_sample_size, seed)
    importance = stage(importance, "importance")
    if not importance.limit(1).count():
        importance, how = features.feature_scores(spark).withColumnRenamed("mi", "importance"), "mutual_information"
    tables["feature_importance"] = importance.withColumn("method", F.lit(how))
    tables["top_features"] = results.top_features(importance)

    tables["class_distribution"] = profile.class_distribution(test)
    tables["confusion_cells"] = charts.confusion_cells(scored)
    tables["roc_lines"] = charts.roc_lines(by_model)
    tables["pr_lines"] = charts.pr_lines(by_model)
    tables["importance_top"] = charts.importance_top(importance, 15)
    tables["comparison_long"] = charts.comparison_long(tables["model_comparison"])
    tables["amount_histogram"] = charts.amount_histogram(sampled)
    tables["amount_box"] = charts.amount_box(sampled)
    tables["metric_badges"] = charts.metric_badges(tables["final_evaluation"])
    summary = results.results_summary(tables["dataset"], tables["final_evaluation"], tables["model_comparison"])
    tables["summary"] = summary.withColumn("seconds", F.lit(time.time() - started))
    return Run(name, model, features, tables)
