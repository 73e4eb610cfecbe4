"""Class imbalance: weights, SMOTE, ADASYN, SMOTE with edited neighbours, and the choice between them."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_uniform
from ..schema import KEY, LABEL
from ..session import stage
from .neighbors import nearest
from .ordering import group_counts, hash_ranked, split_flag


def class_weights(df: DataFrame) -> dict[int, float]:
    """Balanced weights n / (classes x n_class)."""
    counts = group_counts(df, F.col(LABEL))
    total = sum(counts.values())
    return {c: total / (len(counts) * n) for c, n in counts.items()}


def weight_column(weights: dict[int, float]) -> Column:
    weight = F.lit(1.0)
    for c, w in weights.items():
        weight = F.when(F.col(LABEL) == c, F.lit(float(w))).otherwise(weight)
    return weight


def synthetic_count(n_minority: int, n_majority: int, ratio: float = 0.3) -> int:
    """Rows to generate so that minority / majority reaches ``ratio``."""
    wanted = int(ratio * n_majority) - n_minority
    if wanted <= 0:
        raise ValueError(f"a ratio of {ratio} is already reached by {n_minority} against {n_majority} rows: nothing to generate")
    return wanted


def imbalance_report(df: DataFrame, method: str, added: int) -> DataFrame:
    """Training size and fraud ratio before and after adding ``added`` minority rows."""
    counts = df.agg(F.count("*").alias("n"), F.sum(F.col(LABEL).cast("bigint")).alias("pos"))
    return counts.select(
        F.lit(method).alias("method"),
        F.col("n").alias("original_train_size"),
        (F.col("n") + added).alias("balanced_train_size"),
        (F.col("pos") / F.col("n")).alias("original_fraud_ratio"),
        ((F.col("pos") + added) / (F.col("n") + added)).alias("balanced_fraud_ratio"),
    )


# ---- resampling -----------------------------------------------------------------

_COPIES_PER_TASK = 100_000
METHODS = ("smote", "smoteenn", "adasyn", "class_weight")


def _interpolated(picks: DataFrame, columns: list[str], seed: int | str, name: str) -> DataFrame:
    """Rows on the segment between a minority row and one of its neighbours.

    ``picks``: (id, x, neighbours); the neighbour and the position on the
    segment are hash-uniform draws of the synthetic id.
    """
    slot = F.floor(hash_uniform(f"{seed}|slot", "id") * F.size("neighbours")).cast("int") + 1
    there = F.try_element_at("neighbours", slot)["x"]
    gap = hash_uniform(f"{seed}|gap", "id")
    point = F.zip_with("x", there, lambda a, b: a + gap * (b - a))
    return picks.where(F.size("neighbours") > 0).select("id", point.alias("_point")).select(
        F.md5(F.concat(F.lit(f"{seed}|{name}|"), F.col("id").cast("string"))).alias(KEY),
        F.lit(1).alias(LABEL),
        *[F.element_at("_point", i + 1).alias(c) for i, c in enumerate(columns)],
    )


def smote_rows(df: DataFrame, columns: list[str], ratio: float = 0.3, k: int = 5, seed: int | str = 42) -> DataFrame:
    """Synthetic minority rows; raises when the ratio is already reached."""
    counts = group_counts(df, F.col(LABEL))
    n_min, n_new = counts.get(1, 0), synthetic_count(counts.get(1, 0), counts.get(0, 0), ratio)
    if n_min <= k:
        raise ValueError(f"{n_min} fraud rows are too few: {k} neighbours each take at least {k + 1}")
    minority = df.where(F.col(LABEL) == 1)
    ranked = hash_ranked(nearest(minority, minority, columns, k), f"{seed}|base", "rank")
    draws = df.sparkSession.range(n_new).withColumn(
        "rank", F.floor(hash_uniform(f"{seed}|row", "id") * F.lit(n_min)).cast("bigint")
    )
    return _interpolated(draws.join(ranked, "rank"), columns, seed, "smote")


def smote(df: DataFrame, columns: list[str], ratio: float = 0.3, k: int = 5, seed: int | str = 42) -> DataFrame:
    base = df.select(KEY, F.col(LABEL).cast("int").alias(LABEL), *[F.col(c).cast("double").alias(c) for c in columns])
    return base.unionByName(smote_rows(df, columns, ratio, k, seed))


def adasyn_rows(df: DataFrame, columns: list[str], ratio: float = 0.3, k: int = 5, seed: int | str = 42) -> DataFrame:
    """Synthetic minority rows; more of them where majority rows are near."""
    counts = group_counts(df, F.col(LABEL))
    n_min, n_new = counts.get(1, 0), synthetic_count(counts.get(1, 0), counts.get(0, 0), ratio)
    if n_min <= k:
        raise ValueError(f"{n_min} fraud rows are too few: {k} neighbours each take at least {k + 1}")
    minority = df.where(F.col(LABEL) == 1)
    around = nearest(minority, df, columns, k, tag=LABEL)
    hard = F.size(F.filter("neighbours", lambda e: e["tag"] == 0)) / k
    weights = stage(around.select(KEY, hard.alias("hard")), "adasyn")
    total = weights.agg(F.sum("hard")).first()[0]
    if not total:
        raise ValueError("no minority row has a majority row among its neighbours, so there is nothing to weigh by")
    quota = F.rint(F.col("hard") / F.lit(float(total)) * F.lit(n_new)).cast("bigint")
    copies = weights.withColumn("quota", quota).where(F.col("quota") > 0)
    own = nearest(minority, minority, columns, k)
    # The copies of one row are unrolled in blocks, which may go to different tasks.
    block = F.lit(_COPIES_PER_TASK)
    blocks = copies.join(own, KEY).withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("quota") - 1) / block))))
    picks = (
        blocks.repartition(KEY, "block")
        .withColumn("copy", F.explode(F.sequence(F.col("block") * block + 1, F.least(F.col("quota"), (F.col("block") + 1) * block))))
        .select(F.concat_ws("|", KEY, F.col("copy").cast("string")).alias("id"), "x", "neighbours")
    )
    return _interpolated(picks, columns, seed, "adasyn")


def adasyn(df: DataFrame, columns: list[str], ratio: float = 0.3, k: int = 5, seed: int | str = 42) -> DataFrame:
    base = df.select(KEY, F.col(LABEL).cast("int").alias(LABEL), *[F.col(c).cast("double").alias(c) for c in columns])
    return base.unionByName(adasyn_rows(df, columns, ratio, k, seed))


def edited(df: DataFrame, columns: list[str], k: int = 3) -> DataFrame:
    """Rows of either class whose k nearest neighbours all share their class."""
    near = nearest(df, df, columns, k, tag=LABEL)
    ones = F.size(F.filter("neighbours", lambda e: e["tag"] == 1))
    votes = near.select(KEY, ones.alias("ones"), F.size("neighbours").alias("found"))
    agree = F.when(F.col(LABEL) == 1, F.col("ones") == F.col("found")).otherwise(F.col("ones") == 0)
    return df.join(votes, KEY).where(agree).select(*df.columns)


def smoteenn(df: DataFrame, columns: list[str], ratio: float = 0.3, k: int = 5, seed: int | str = 42) -> DataFrame:
    return edited(stage(smote(df, columns, ratio, k, seed), "smote"), columns, 3)


def apply_method(
    method: str, df: DataFrame, columns: list[str], ratio: float = 0.3, seed: int | str = 42
) -> tuple[DataFrame, str]:
    """Resampled training table and the method really used; an unknown name means SMOTE."""
    if method == "class_weight":
        return df, "class_weight"
    jobs = {"smote": smote, "smoteenn": smoteenn, "adasyn": adasyn}
    if method not in jobs:
        warnings.warn(f"no resampling method is called {method!r}; taking smote", UserWarning, stacklevel=2)
        method = "smote"
    return jobs[method](df, columns, ratio, seed=seed), method


def auto_select(
    df: DataFrame, columns: list[str], ratio: float = 0.3, seed: int | str = 42, max_iter: int = 100
) -> tuple[str, dict[str, float | None]]:
    """Method with the best F1 of an unweighted logistic regression on an inner 80/20 split.

    A method that fails scores ``None``; when nothing scores above 0, SMOTE.
    """
    from .models import f1_of, logistic

    split = split_flag(df, LABEL, 0.2, f"{seed}|inner")
    parts = stage(df.withColumn("_split", split), "auto", ("_split",))
    inner = parts.where("_split = 'train'").drop("_split")
    held = parts.where("_split = 'test'").drop("_split")
    scores: dict[str, float | None] = {}
    best, best_score = "smote", 0.0
    for method in METHODS:
        try:
            balanced, _ = apply_method(method, inner, columns, ratio, seed)
            model = logistic(columns, weights=None, max_iter=max_iter).fit(balanced)
            scores[method] = f1_of(model.score(held))
        except Exception as problem:  # noqa: BLE001 - a failing candidate is skipped
            warnings.warn(f"{method}: {str(problem)[:200]}", UserWarning, stacklevel=2)
            scores[method] = None
            continue
        if scores[method] > best_score:
            best, best_score = method, scores[method]
    return best, scores
