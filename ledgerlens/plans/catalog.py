"""Registered queries: every operator run over the whole transactions table.

Budgets are shares of the table, so the work of each query grows with it.
Doubles are rounded on output only, for comparison across engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.guards import finite_or_zero
from ..operators import augment as augmenting
from ..operators import charts, clean, evaluate, explain, imbalance, ordering, profile, sampling, scoring
from ..operators import features as feats
from ..schema import KEY, LABEL, REQUEST, TYPES
from ..session import new_folder, small_table
from ..sources import readers, writers
from ..sources.adapter import transactions, transactions_path

Query = Callable[[SparkSession, str], DataFrame]
SEED = 42
RAW = ["step", "amount", "oldbalanceOrg", "newbalanceOrig", "oldbalanceDest", "newbalanceDest"]
# Coefficients of the deterministic test score's linear part, used by linear_shap.
LINEAR = {"amount_log": 0.8, "zero_balance_orig": 2.0, "balance_change_ratio_dest": -0.3, "hour_sin": 0.1}

#: Rows of a file of the log that ``file_row_offset`` writes.
FILE_ROWS = 250_000

QUERIES: dict[str, Query] = {}


def query(fn: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(transactions(spark, sf_dir))
    return fn


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Rounds every double column; ``special`` overrides the digits per column."""
    kinds = dict(df.dtypes)

    def cut(c: str) -> Column:
        # Scale, round, scale back in doubles: decimal rounding would dominate wide outputs.
        scale = F.lit(float(10 ** special.get(c, digits)))
        return (F.rint(F.col(c) * scale) / scale).alias(c)

    return df.select(*[cut(c) if kinds[c] == "double" else F.col(c) for c in df.columns])


def test_score(df: DataFrame) -> DataFrame:
    """A deterministic score with few distinct values, so that ties are exercised."""
    one = lambda condition: F.when(condition, 1.0).otherwise(0.0)
    z = (
        F.lit(-5.0)
        + 2.5 * one(rules.is_risky_type())
        + 2.0 * one((F.col("newbalanceOrig") == 0) & (F.col("oldbalanceOrg") > 0))
        + 2.0 * one(F.col("newbalanceDest") == F.col("oldbalanceDest"))
        - 1.0 * one(F.col("amount") < 100000)
    )
    return _with_score(df, z)


def _with_score(df: DataFrame, z: Column) -> DataFrame:
    scored = df.withColumn("p", F.round(1 / (1 + F.exp(-z)), 6))
    return scored.withColumn("prediction", (F.col("p") > 0.5).cast("int"))


def member_scores(df: DataFrame) -> DataFrame:
    """Three deterministic scores side by side, for the ensemble and comparison operators."""
    one = lambda condition: F.when(condition, 1.0).otherwise(0.0)
    by_amount = -3.0 + F.col("amount") / 250000 - 2.0 * one(~rules.is_risky_type())
    by_rules = (
        -4.0
        + 1.5 * one(rules.is_risky_type())
        + 1.5 * one(rules.is_drained())
        + 3.0 * one(F.col("newbalanceDest") == F.col("oldbalanceDest"))
    )
    sigmoid = lambda z: F.round(1 / (1 + F.exp(-z)), 6)
    return test_score(df).select(
        KEY, LABEL, F.col("p").alias("base"), sigmoid(by_amount).alias("by_amount"), sigmoid(by_rules).alias("by_rules")
    )


MEMBERS = ["base", "by_amount", "by_rules"]


def comparison(df: DataFrame) -> DataFrame:
    scores = member_scores(df)
    rows = None
    for m in MEMBERS:
        one = scores.select(LABEL, F.col(m).alias("p"), (F.col(m) > 0.5).cast("int").alias("prediction"))
        row = evaluate.metrics(one, m, digits=6)
        rows = row if rows is None else rows.unionByName(row)
    return rows


def half(df: DataFrame) -> int:
    return sampling.class_counts(df).total // 2


# ---- profile ---------------------------------------------------------------------

@query
def profile_dataset(tx):
    return rounded(profile.profile_dataset(tx))


@query
def profile_columns(tx):
    return rounded(profile.profile_columns(tx, RAW), 4)


@query
def type_stats(tx):
    return rounded(profile.type_stats(tx), 4)


@query
def type_share(tx):
    return rounded(profile.share_by(tx, "type"))


@query
def type_risk_profile(tx):
    return rounded(profile.type_risk_profile(tx), 4)


@query
def step_bands(tx):
    return rounded(profile.step_bands(tx))


@query
def class_distribution(tx):
    return rounded(profile.class_distribution(tx))


@query
def flag_vs_label(tx):
    return profile.flag_vs_label(tx)


@query
def null_share(tx):
    gaps = tx.select(
        KEY, "step",
        F.nullif("oldbalanceDest", F.lit(0.0)).alias("oldbalanceDest"),
        F.nullif("newbalanceOrig", F.lit(0.0)).alias("newbalanceOrig"),
        F.when(F.col("type") != "DEBIT", F.col("nameDest")).alias("nameDest"),
    )
    return rounded(profile.null_share(gaps))


@query
def diversity_score(tx):
    return rounded(tx.groupBy("type").agg(profile.diversity(tx, RAW).alias("diversity")), 4)


@query
def target_ratio_table(tx):
    return profile.target_ratio_table(tx, (0.0, 0.1, 0.15, 0.3, 0.5), 1_000_000_000)


# ---- cleaning ----------------------------------------------------------------------

QUERIES["read_columns"] = lambda spark, sf_dir: readers.read_columns(spark, transactions_path(spark, sf_dir), [KEY, "type", "amount"])


@query
def csv_round_trip(tx):
    """The log written as CSV without its key and identifiers, and read back as a raw log."""
    path = new_folder(tx.sparkSession, "csv")
    writers.write_augmented(tx, path)
    return readers.read_transactions(tx.sparkSession, path).drop(KEY)


@query
def read_split(tx):
    """Fraud rows and all others of a CSV log."""
    path = new_folder(tx.sparkSession, "csv-split")
    writers.write_augmented(tx, path)
    parts = readers.read_split(tx.sparkSession, path)
    one = lambda rows, side: rows.agg(F.lit(side).alias("side"), F.count("*").alias("n"), F.sum("step").alias("steps"))
    return one(parts[0], "fraud").unionByName(one(parts[1], "other"))


@query
def results_round_trip(tx):
    path = new_folder(tx.sparkSession, "results")
    writers.write_results({"dataset": rounded(profile.profile_dataset(tx))}, path)
    return writers.read_results(tx.sparkSession, path, ["dataset"])["dataset"]


@query
def balance_errors(tx):
    errors = rounded(feats.balance_errors(tx), 2)
    # Adding zero turns a negative zero into zero.
    return errors.select(KEY, LABEL, *[(F.col(c) + F.lit(0.0)).alias(c) for c in ("orig_balance_error", "dest_balance_error")])


@query
def augmented_table(tx):
    """The whole augmented table: all rows and the synthetic ones."""
    return augmenting.augment(tx, _negatives(tx), SEED)


@query
def filter_fraud(tx):
    return clean.filter_class(tx, 1).select(KEY, "type", "amount")


@query
def narrow_types(tx):
    names = {c: t.simpleString() for c, t in clean.narrowed_types(tx).items()}
    return small_table(tx.sparkSession, sorted(names.items()), {"column": "string", "type": "string"})


@query
def dedupe(tx):
    copies = tx.withColumn(KEY, F.md5(F.concat(F.lit("copy|"), F.col(KEY))))
    return clean.drop_duplicates(tx.unionByName(copies)).select(KEY, "type", "amount", "step")


@query
def drop_sparse(tx):
    risky = rules.is_risky_type()
    gaps = tx.select(
        KEY, "step",
        F.when(F.col("isFlaggedFraud") == 1, F.col("amount")).alias("flagged_amount"),
        F.when(risky, F.col("amount")).alias("risky_amount"),
        F.when(~risky, F.col("amount")).alias("calm_amount"),
    )
    return clean.drop_sparse_columns(gaps)


@query
def missing_to_zero(tx):
    gaps = tx.select(
        KEY,
        F.when(F.col("type") != "DEBIT", F.col("amount")).alias("amount"),
        F.when(F.col("oldbalanceDest") == 0, F.lit(float("inf"))).otherwise(F.col("oldbalanceDest")).alias("oldbalanceDest"),
        F.when(F.col("newbalanceOrig") == 0, F.lit(float("nan"))).otherwise(F.col("newbalanceOrig")).alias("newbalanceOrig"),
    )
    return clean.fill_missing(clean.replace_infinite(gaps))


@query
def row_offset(tx):
    total = tx.count()
    return sampling.skip_rows(tx, total // 3, "step").select(KEY, "step")


@query
def file_row_offset(tx):
    """All rows of a CSV log of several files but its first third, in the order of the files."""
    path, total = new_folder(tx.sparkSession, "csv-order"), tx.count()
    # The number of files follows the rows, so a task sorts a bounded share.
    files = max(6, -(-total // FILE_ROWS))
    tx.repartitionByRange(files, KEY).sortWithinPartitions(KEY).write.option("header", True).csv(path)
    rows = readers.read_in_file_order(tx.sparkSession, path)
    return sampling.skip_rows(rows, total // 3, readers.FILE_ROW).select(KEY, readers.FILE_ROW)


@query
def row_offset_nulls(tx):
    """Rows without an order value come last and are not lost."""
    total = tx.count()
    gaps = tx.withColumn("step", F.when(F.col("step") % 7 != 0, F.col("step")))
    return sampling.skip_rows(gaps, total * 9 // 10, "step").select(KEY)


@query
def request_defaults(tx):
    # Requests as JSON lines; a zero amount or destination balance is left out.
    body = F.to_json(F.struct(
        KEY, "step", "type", F.when(F.col("amount") > 100000, F.col("amount")).alias("amount"),
        F.nullif("oldbalanceDest", F.lit(0.0)).alias("oldbalanceDest"),
    ))
    parsed = tx.select(F.from_json(body, REQUEST).alias("r")).select("r.*")
    return scoring.with_request_defaults(parsed)


@query
def parse_form(tx):
    form = tx.select(
        KEY,
        F.when(F.col("step") % 24 == 0, "").otherwise(F.concat(F.col("step").cast("string"), F.lit("h"))).alias("step"),
        F.when(F.col("type") == "DEBIT", "n/a").otherwise(F.col("step").cast("string")).alias("amount"),
        F.when(F.col("newbalanceOrig") == 0, "").otherwise(F.col("step").cast("string")).alias("oldbalanceOrg"),
    )
    return scoring.parse_form(form)


# ---- features ---------------------------------------------------------------------

def _feature_query(tx, columns: dict[str, Column], guarded: bool = False) -> DataFrame:
    cells = columns if guarded else {n: finite_or_zero(v) for n, v in columns.items()}
    return rounded(tx.select(KEY, *[v.alias(n) for n, v in cells.items()]))


@query
def features_amount(tx):
    return _feature_query(tx, {**feats.amount_features(tx), **feats.shape_features(tx)})


@query
def features_balance(tx):
    return _feature_query(tx, feats.balance_features(tx))


@query
def features_time(tx):
    return _feature_query(tx, feats.time_features(tx))


@query
def features_type(tx):
    return _feature_query(tx, feats.type_features(tx, feats.fit_type_stats(tx), None))


@query
def features_unseen_type(tx):
    """DEBIT is unknown to the fitted state: batch mean, std 1, code -1."""
    known = tx.where(F.col("type") != "DEBIT")
    stats = feats.fit_type_stats(known)
    batch_mean = tx.agg(F.avg("amount")).first()[0]
    codes = feats.fit_codes(known, "type")
    return _feature_query(
        tx, {**feats.type_features(tx, stats, batch_mean), "type_code": feats.encode("type", codes)}
    )


@query
def features_all(tx):
    return _feature_query(tx, feats.engineered(tx, feats.fit_type_stats(tx), None), guarded=True)


@query
def encode_type(tx):
    codes = feats.fit_codes(tx, "type")
    return tx.groupBy("type").agg(F.count("*").alias("n")).select(
        "type", feats.encode("type", codes).cast("int").alias("code"), "n"
    )


def _scaling_input(tx) -> DataFrame:
    return tx.select(
        KEY, *RAW, (F.col("newbalanceOrig") == 0).cast("int").alias("zero_balance_orig"),
        F.lit(7.0).alias("constant"),
    )


def _scale_query(tx, method: str) -> DataFrame:
    inputs = _scaling_input(tx)
    columns = [c for c in inputs.columns if c != KEY]
    params = feats.fit_scaler(inputs, columns, method)
    return rounded(inputs.select(KEY, *[feats.scaled(c, params).alias(c) for c in columns]))


@query
def scale_standard(tx):
    return _scale_query(tx, "standard")


@query
def scale_minmax(tx):
    return _scale_query(tx, "minmax")


@query
def scale_robust(tx):
    return _scale_query(tx, "robust")


@query
def variance_select(tx):
    inputs = _scaling_input(tx)
    columns = [c for c in inputs.columns if c != KEY]
    params = feats.fit_scaler(inputs, columns, "minmax")
    kept = feats.select_by_variance(inputs.select(*[feats.scaled(c, params).alias(c) for c in columns]), columns)
    return rounded(small_table(tx.sparkSession, list(kept.items()), {"feature": "string", "variance": "double"}))


def _mi_input(tx) -> tuple[DataFrame, list[str]]:
    columns = RAW + ["zero_balance_orig", "balance_change_dest", "type_code"]
    codes = {t: i for i, t in enumerate(TYPES)}
    return tx.select(
        KEY, LABEL, *RAW,
        (F.col("newbalanceOrig") == 0).cast("int").alias("zero_balance_orig"),
        F.round(F.col("newbalanceDest") - F.col("oldbalanceDest"), 2).alias("balance_change_dest"),
        feats.encode("type", codes).alias("type_code"),
    ), columns


@query
def mi_binned(tx):
    inputs, columns = _mi_input(tx)
    return rounded(feats.mutual_information(inputs, columns))


@query
def leakage_audit(tx):
    return rounded(feats.leakage_audit(tx))


# ---- sampling, splitting ---------------------------------------------------------------

@query
def load_preserving(tx):
    return sampling.load_fraud_preserving(tx, half(tx), seed=SEED).select(KEY, LABEL)


@query
def load_target_ratio(tx):
    total = tx.count()
    return sampling.load_fraud_preserving(
        tx, total, start_row=total // 10, target_ratio=0.15, order="step"
    ).select(KEY, LABEL, "step")


@query
def sample_stratified(tx):
    return sampling.sample(tx, "stratified", half(tx), SEED).select(KEY, "type", LABEL)


@query
def sample_fraud_focused(tx):
    return sampling.sample(tx, "fraud_focused", half(tx), SEED).select(KEY, "type", LABEL)


@query
def sample_informative(tx):
    return sampling.sample(tx, "informative", half(tx), SEED).select(KEY, "type", LABEL)


@query
def sample_compare(tx):
    rows = sampling.compare_strategies(tx, half(tx), ["stratified", "fraud_focused", "informative"], SEED)
    failed = rows.where("error is not null").select("strategy", "error").collect()  # at most one row a strategy
    if failed:
        raise RuntimeError(str(failed))
    return rounded(rows.drop("error"), fraud_ratio=6, diversity=3)


@query
def split_stratified(tx):
    return tx.select(KEY, LABEL, ordering.split_flag(tx, LABEL, 0.2, SEED).alias("split"))


@query
def folds_stratified(tx):
    return tx.select(KEY, LABEL, ordering.fold_number(tx, LABEL, 3, SEED).alias("fold"))


@query
def hash_rank(tx):
    return ordering.hash_ranked(tx.where(F.col(LABEL) == 1).select(KEY), SEED)


# ---- imbalance, augmentation -----------------------------------------------------------

@query
def class_weights(tx):
    weight = imbalance.weight_column(imbalance.class_weights(tx))
    return rounded(tx.groupBy(LABEL).agg(F.count("*").alias("n"), F.max(weight).alias("weight")))


@query
def imbalance_report(tx):
    counts = sampling.class_counts(tx)
    added = imbalance.synthetic_count(counts.fraud, counts.legit, 0.3)
    return rounded(imbalance.imbalance_report(tx, "smote", added))


def _negatives(tx) -> int:
    return 2 * sampling.class_counts(tx).fraud


@query
def augment_points(tx):
    return augmenting.hard_negatives(tx.where(F.col(LABEL) == 1), _negatives(tx), SEED)


@query
def augment_report(tx):
    return rounded(augmenting.augmentation_report(tx, _negatives(tx)))


# ---- rules and scoring ------------------------------------------------------------------

@query
def risk_factors(tx):
    factors = rules.risk_factors()
    return tx.select(KEY, F.size(factors).alias("n_factors"), F.concat_ws("; ", factors).alias("factors"))


@query
def risk_levels(tx):
    scored = test_score(tx)
    return scored.groupBy("type", rules.risk_level(F.col("p")).alias("risk_level"), LABEL).agg(F.count("*").alias("n"))


@query
def recommendations(tx):
    scored = scoring.with_rules(test_score(tx))
    return scored.groupBy("recommendation", "risk_level").agg(
        F.count("*").alias("n"), F.sum(F.col(LABEL).cast("bigint")).alias("fraud")
    )


@query
def score_batch(tx):
    scored = scoring.with_rules(test_score(tx))
    return rounded(scored.select(
        KEY, F.col("is_fraud").cast("int").alias("is_fraud"), F.col("p").alias("fraud_probability"), "risk_level", "confidence"
    ))


@query
def batch_summary(tx):
    return rounded(scoring.batch_summary(test_score(tx)))


@query
def decision_table(tx):
    rule = rules.decision_rule()
    return rounded(
        tx.groupBy(rule.alias("rule"))
        .agg(F.count("*").alias("n"), F.sum(F.col(LABEL).cast("bigint")).alias("fraud"))
        .select(
            "rule", rules.decision_text(F.col("rule"), 1).alias("prediction"),
            rules.decision_text(F.col("rule"), 2).alias("confidence"), "n", "fraud",
        )
    )


@query
def pattern_table(tx):
    return rounded(
        tx.groupBy(rules.pattern().alias("pattern"))
        .agg(F.count("*").alias("n"), F.sum(F.col(LABEL).cast("bigint")).alias("fraud"))
        .select(
            "pattern", rules.pattern_signal(F.col("pattern")).alias("signal"), "n", "fraud",
            (F.col("fraud") / F.col("n")).alias("fraud_rate"),
        )
    )


# ---- evaluation ---------------------------------------------------------------------------

@query
def confusion(tx):
    return evaluate.confusion(test_score(tx))


@query
def metrics(tx):
    return rounded(evaluate.metrics(test_score(tx), "test_score", digits=6))


@query
def classification_report(tx):
    return rounded(evaluate.classification_report(test_score(tx)))


@query
def roc_curve(tx):
    return rounded(evaluate.roc_curve(test_score(tx), digits=6))


@query
def roc_auc(tx):
    return rounded(evaluate.metrics(test_score(tx), digits=6).select("roc_auc"))


@query
def pr_curve(tx):
    return rounded(evaluate.pr_curve(test_score(tx), digits=6))


@query
def avg_precision(tx):
    return rounded(evaluate.metrics(test_score(tx), digits=6).select("avg_precision"))


@query
def mcc(tx):
    return rounded(evaluate.metrics(test_score(tx), digits=6).select("mcc"))


@query
def threshold_sweep(tx):
    return rounded(evaluate.threshold_sweep(test_score(tx), (0.1, 0.3, 0.5, 0.7, 0.9)))


@query
def eval_report(tx):
    return evaluate.evaluation_report(evaluate.metrics(test_score(tx), "test_score", digits=6))


@query
def comparison_rank(tx):
    ranked = evaluate.comparison_rank(evaluate.compare_models(comparison(tx)))
    return rounded(ranked)


@query
def comparison_long(tx):
    return rounded(charts.comparison_long(comparison(tx)), 2)


@query
def vote_soft(tx):
    votes = evaluate.vote_soft(member_scores(tx), MEMBERS)
    return votes.groupBy(LABEL, "prediction").agg(F.count("*").alias("n"), F.round(F.sum("p"), 3).alias("sum_p"))


@query
def vote_hard(tx):
    votes = evaluate.vote_hard(member_scores(tx), MEMBERS)
    return votes.select(KEY, "prediction", "p")


@query
def final_selection(tx):
    rows = comparison(tx).select(
        F.when(F.col("model") == "by_rules", "ensemble").otherwise("tuned").alias("kind"),
        F.col("model").alias("name"), "f1_score",
    ).where(F.col("name") != "by_amount")
    return rounded(evaluate.select_final(rows))


# ---- explanation and charts ----------------------------------------------------------------

@query
def importance_top(tx):
    inputs, columns = _mi_input(tx)
    mi = rounded(feats.mutual_information(inputs, columns)).withColumnRenamed("mi", "importance")
    return charts.importance_top(mi, 5)


@query
def linear_shap(tx):
    table = tx.select(KEY, *[v.alias(n) for n, v in feats.engineered(tx, feats.fit_type_stats(tx), None).items() if n in LINEAR])
    shap = explain.linear_shap(table, LINEAR)
    return rounded(explain.mean_abs_importance(shap, list(LINEAR)))


@query
def amount_histogram(tx):
    return rounded(charts.amount_histogram(tx), 4, density=12)


@query
def amount_box(tx):
    return rounded(charts.amount_box(tx))


@query
def confusion_cells(tx):
    return rounded(charts.confusion_cells(test_score(tx)))


@query
def metric_badges(tx):
    return rounded(charts.metric_badges(evaluate.metrics(test_score(tx), "test_score", digits=6)))


@query
def roc_lines(tx):
    scores = member_scores(tx)
    parts = {
        m: scores.select(LABEL, F.col(m).alias("p"), (F.col(m) > 0.5).cast("int").alias("prediction"))
        for m in ("base", "by_rules")
    }
    return rounded(charts.roc_lines(parts))


@query
def pr_lines(tx):
    scores = member_scores(tx)
    parts = {
        m: scores.select(LABEL, F.col(m).alias("p"), (F.col(m) > 0.5).cast("int").alias("prediction"))
        for m in ("base", "by_rules")
    }
    return rounded(charts.pr_lines(parts))
