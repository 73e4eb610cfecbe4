import os

from pyspark.sql import functions as F

import submit
from ledgerlens.session import shared_folder
from ledgerlens.sources.writers import write_augmented


def test_augment_then_train_then_score(spark, tx, tmp_path):
    folder = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}"
    before = set(os.listdir(folder))
    log, more, run, scored = (str(tmp_path / p) for p in ("log", "more", "run", "scored"))
    write_augmented(tx, log)
    submit.main(["augment", log, more, "--rows", "500"], spark)
    assert spark.read.option("header", True).csv(more).count() == tx.count() + 500
    config = tmp_path / "run.yaml"
    config.write_text(
        "data: {max_training_rows: 2000}\nsampling: {strategy: stratified}\nimbalance: {method: class_weight}\n"
        "models: {candidates: [logistic_regression], small: true, build_ensemble: false}\ntuning: {n_iter: 1, cv_folds: 2}\n"
        "evaluation: {shap_sample_size: 20}\n")
    submit.main(["train", log, run, "--config", str(config)], spark)
    submit.main(["score", log, run, scored], spark)
    assert set(os.listdir(folder)) == before, "staged tables go when a job ends"
    assert spark.read.parquet(scored).where(F.col("p").between(0, 1)).count() == tx.count()
