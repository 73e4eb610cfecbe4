"""Class-preserving load and the six sampling strategies.

Every strategy keeps all fraud rows and spends the rest of ``max_rows`` on
legitimate rows.  A strategy is a predicate built from cut-offs, so a sample is
two filtered scans, one per class: no row is sorted, shuffled or joined.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_order
from ..schema import KEY, LABEL, numeric_columns
from ..session import small_table, stage
from .clusters import fit_centres, nearest_centre
from .isolation import fit_isolation_forest
from .ordering import NOTHING, at_or_before, first_by_hash, group_counts, hash_cutoffs, value_cutoff
from .profile import diversity
from .quantiles import exact_quantiles

LOW_FRAUD = 2000


@dataclass(frozen=True)
class ClassCounts:
    fraud: int
    legit: int

    @property
    def total(self) -> int:
        return self.fraud + self.legit


def class_counts(df: DataFrame) -> ClassCounts:
    counts = group_counts(df, F.col(LABEL))
    return ClassCounts(counts.get(1, 0), counts.get(0, 0))


def is_fraud() -> Column:
    return F.col(LABEL) == 1


def is_legit() -> Column:
    return F.col(LABEL) == 0


# ---- class-preserving load -----------------------------------------------------

def legit_budget(fraud: int, max_rows: int, target_ratio: float = 0.0) -> int:
    """Legitimate rows to load next to ``fraud`` fraud rows."""
    room = max(0, max_rows - fraud)
    if target_ratio > 0 and fraud > 0:
        return min(int(fraud * (1.0 - target_ratio) / target_ratio), room)
    return room


def skip_rows(df: DataFrame, n: int, order: str) -> DataFrame:
    """All rows but the first ``n`` by (order, key)."""
    if n <= 0:
        return df
    value, key = F.col(order).cast("double"), F.col(KEY)
    cut = value_cutoff(df, value, key, n, df.count())
    return df.where(~cut.holds(value, key))


def load_fraud_preserving(
    df: DataFrame,
    max_rows: int = 1_000_000,
    start_row: int = 0,
    target_ratio: float = 0.0,
    order: str | None = None,
    seed: int = 42,
) -> DataFrame:
    """All fraud rows, and legitimate rows up to the budget.

    With an ``order`` column legitimate rows are taken in that order after the
    first ``start_row`` rows of the table; without one, in hash order.
    """
    counts = class_counts(df)
    if counts.fraud < LOW_FRAUD:
        warnings.warn(
            f"Only {counts.fraud} fraud samples found (< {LOW_FRAUD}); model performance may be degraded.",
            UserWarning,
            stacklevel=2,
        )
    budget = legit_budget(counts.fraud, max_rows, target_ratio)
    legit = df.where(is_legit())
    after_start = F.lit(True)
    if start_row > 0:
        if order is None:
            raise ValueError("start_row needs an order column: a table has no file order")
        value, key = F.col(order).cast("double"), F.col(KEY)
        # Rows without a label have a place too.
        start = value_cutoff(df.select(order, KEY), value, key, start_row, df.count())
        after_start = ~start.holds(value, key)
        legit = legit.where(after_start)
    available = legit.count() if start_row > 0 else counts.legit
    if order is None:
        chosen = first_by_hash(legit, budget, seed, totals={1: available})
    else:
        value, key = F.col(order).cast("double"), F.col(KEY)
        chosen = value_cutoff(legit, value, key, budget, available).holds(value, key)
    return df.where(is_fraud() | (is_legit() & after_start & chosen))


# ---- strategies ------------------------------------------------------------------

def fraud_centroid(df: DataFrame, columns: list[str]) -> dict[str, tuple[float | None, float]]:
    """Mean and sample std (0 or missing becomes 1) of the fraud rows."""
    row = df.where(is_fraud()).agg(
        *[f(c).alias(f"{c}__{s}") for c in columns for s, f in (("m", F.avg), ("s", F.stddev_samp))]
    ).first()
    return {c: (row[f"{c}__m"], row[f"{c}__s"] or 1.0) for c in columns}


def _or_zero(column: str) -> Column:
    """Missing values (null, NaN) count as 0."""
    return F.coalesce(F.nanvl(F.col(column).cast("double"), F.lit(0.0)), F.lit(0.0))


def centroid_distance(centroid: dict[str, tuple[float | None, float]]) -> Column:
    """Squared z-distance to the fraud centroid."""
    total = F.lit(0.0)
    for c, (mean, std) in centroid.items():
        if mean is not None:
            z = (_or_zero(c) - F.lit(mean)) / F.lit(std)
            total = total + z * z
    return total


def _rest(pool: DataFrame, taken: Column, n: int, seed: int, total: int) -> Column:
    """Holds for the first ``n`` rows in hash order among those not taken (for taken rows it means nothing)."""
    return first_by_hash(pool.where(~taken), n, seed, totals={1: total})


def _stratified(df: DataFrame, counts: ClassCounts, budget: int, seed: int) -> DataFrame:
    legit = df.where(is_legit())
    if "type" not in df.columns:
        return legit.where(first_by_hash(legit, budget, seed, totals={1: counts.legit}))
    per_type = group_counts(legit, F.col("type"))
    quotas = {t: min(int(budget * (n / counts.legit)), n) for t, n in per_type.items()}
    return legit.where(first_by_hash(legit, quotas, seed, F.col("type"), per_type))


def _fraud_focused(df: DataFrame, counts: ClassCounts, budget: int, seed: int) -> DataFrame:
    legit, columns = df.where(is_legit()), numeric_columns(df)
    if not columns:
        return legit.where(first_by_hash(legit, budget, seed, totals={1: counts.legit}))
    distance = centroid_distance(fraud_centroid(df, columns))
    close = int(budget * 0.7)
    taken = value_cutoff(legit, distance, F.col(KEY), close, counts.legit).holds(distance, F.col(KEY))
    return legit.where(taken | _rest(legit, taken, budget - close, seed, counts.legit - min(close, counts.legit)))


def _clustering(df: DataFrame, counts: ClassCounts, budget: int, seed: int) -> DataFrame:
    legit, columns = df.where(is_legit()), numeric_columns(df)
    k = min(100, budget // 100)
    if not columns or k < 2:
        return legit.where(first_by_hash(legit, budget, seed, totals={1: counts.legit}))
    row = legit.agg(
        *[f(c).alias(f"{c}__{s}") for c in columns for s, f in (("m", F.avg), ("s", F.stddev_pop))]
    ).first()
    scaled = {f"_z_{c}": (_or_zero(c) - F.lit(row[f"{c}__m"] or 0.0)) / F.lit(row[f"{c}__s"] or 1.0) for c in columns}
    nearest = nearest_centre(list(scaled.values()), fit_centres(legit, scaled, k, seed, counts.legit))
    order, cluster = hash_order(seed), F.col("_cluster")
    placed = stage(legit.select(order.alias("_order"), nearest.alias("_cluster")), "clusters")
    sizes = group_counts(placed, cluster)
    quotas = {c: min(max(1, int(budget * n / counts.legit)), n) for c, n in sizes.items()}
    over = sum(quotas.values()) - budget
    for c in sorted(quotas, key=lambda c: (-quotas[c], c)):
        # Only the one-row minimum of tiny clusters can exceed the budget.
        cut = min(max(over, 0), quotas[c])
        quotas[c] -= cut
        over -= cut
    cuts = hash_cutoffs(placed, F.col("_order"), cluster, {c: [q] for c, q in quotas.items()}, sizes)
    ends = {c: keys[0] for c, keys in cuts.items()}
    # Rows beyond the end of every cluster need no cluster.
    return legit.where(order <= F.lit(max(ends.values(), default=NOTHING))).where(at_or_before(order, nearest, ends))


def _scored(legit: DataFrame, columns: list[str], total: int, **forest) -> DataFrame:
    """Rows with their isolation-forest score, written once because several passes read it."""
    fitted = fit_isolation_forest(legit, columns, total=total, **forest)
    return stage(legit.withColumn("_score", fitted.score()), "anomaly")


def _anomaly(df: DataFrame, counts: ClassCounts, budget: int, seed: int) -> DataFrame:
    legit, columns = df.where(is_legit()), numeric_columns(df)
    if not columns:
        return legit.where(first_by_hash(legit, budget, seed, totals={1: counts.legit}))
    scored = _scored(legit, columns, counts.legit, trees=100, seed=seed)
    most_first, wanted = -F.col("_score"), int(budget * 0.6)
    taken = value_cutoff(scored, most_first, F.col(KEY), wanted, counts.legit).holds(most_first, F.col(KEY))
    return scored.where(taken | _rest(scored, taken, budget - wanted, seed, counts.legit - min(wanted, counts.legit)))


def _hybrid(df: DataFrame, counts: ClassCounts, budget: int, seed: int) -> DataFrame:
    legit, columns = df.where(is_legit()), numeric_columns(df)
    if not columns:
        return _stratified(df, counts, budget, seed)
    close, odd = int(budget * 0.4), int(budget * 0.3)
    distance = centroid_distance(fraud_centroid(df, columns))
    near = value_cutoff(legit, distance, F.col(KEY), close, counts.legit).holds(distance, F.col(KEY))
    left = counts.legit - min(close, counts.legit)
    others = _scored(legit.where(~near), columns, left, trees=50, seed=seed)
    most_first = -F.col("_score")
    strange = value_cutoff(others, most_first, F.col(KEY), odd, left).holds(most_first, F.col(KEY))
    left -= min(odd, left)
    rest, share = others.where(~strange), budget - close - odd
    if "type" in df.columns:
        per_type = group_counts(rest, F.col("type"))
        quotas = {t: min(int(share * (n / max(left, 1))), n) for t, n in per_type.items()}
        drawn = first_by_hash(rest, quotas, seed, F.col("type"), per_type)
    else:
        drawn = first_by_hash(rest, share, seed, totals={1: left})
    return legit.where(near).unionByName(others.where(strange | drawn).select(*df.columns))


def informativeness(df: DataFrame, anomaly: Column | None = None) -> Column:
    """Weighted score of a legitimate row; without ``anomaly`` the forest term is left out."""
    columns = numeric_columns(df)
    legit = df.where(is_legit())
    distance = centroid_distance(fraud_centroid(df, columns))
    stats = legit.agg(
        *[f(c).alias(f"{c}__{s}") for c in columns for s, f in (("m", F.avg), ("s", F.stddev_samp))]
    ).first()
    spreads = [c for c in columns if stats[f"{c}__s"]]
    spread = F.lit(0.0)
    for c in spreads:
        spread = spread + F.abs((_or_zero(c) - F.lit(stats[f"{c}__m"])) / F.lit(stats[f"{c}__s"]))
    spread = spread / max(len(spreads), 1)
    changes = [c for c in df.columns if "balance_change" in c]
    tops = legit.agg(
        F.max(spread).alias("spread"),
        *([F.max(F.greatest(*[F.abs(F.col(c)) for c in changes], F.lit(0.0))).alias("change")] if changes else []),
    ).first()
    score = F.lit(0.4) / (1 + distance)
    if anomaly is not None:
        score = score + 0.3 * anomaly
    if tops["spread"]:
        score = score + 0.2 * (spread / F.lit(tops["spread"]))
    if "amount" in df.columns:
        edge = exact_quantiles(legit, {"amount": F.col("amount")}, [0.95])["amount"][0]
        if edge is not None:
            score = score + 0.05 * (F.col("amount") > F.lit(edge)).cast("int")
    if changes and tops["change"]:
        score = score + 0.05 * F.greatest(*[F.abs(F.col(c)) for c in changes], F.lit(0.0)) / F.lit(tops["change"])
    return score


def _by_informativeness(legit: DataFrame, counts: ClassCounts, budget: int, seed: int, score: Column) -> DataFrame:
    wanted = int(budget * 0.8)
    taken = value_cutoff(legit, -score, F.col(KEY), wanted, counts.legit).holds(-score, F.col(KEY))
    return legit.where(taken | _rest(legit, taken, budget - wanted, seed, counts.legit - min(wanted, counts.legit)))


def _informative(df: DataFrame, counts: ClassCounts, budget: int, seed: int) -> DataFrame:
    """The intelligent strategy without its isolation-forest term."""
    return _by_informativeness(df.where(is_legit()), counts, budget, seed, informativeness(df))


def _intelligent(df: DataFrame, counts: ClassCounts, budget: int, seed: int) -> DataFrame:
    columns = numeric_columns(df)
    if not columns:
        return _stratified(df, counts, budget, seed)
    scored = _scored(df.where(is_legit()), columns, counts.legit, trees=100, seed=seed)
    # A contamination of 0.1 flags the scores above their 90th percentile.
    edge = exact_quantiles(scored, {"score": F.col("_score")}, [0.9])["score"][0]
    flagged = (F.col("_score") > F.lit(edge)).cast("int")
    return _by_informativeness(scored, counts, budget, seed, informativeness(df, flagged))


STRATEGIES = {
    "stratified": _stratified,
    "fraud_focused": _fraud_focused,
    "clustering": _clustering,
    "anomaly_focused": _anomaly,
    "hybrid": _hybrid,
    "intelligent": _intelligent,
    "informative": _informative,
}


def sample(
    df: DataFrame, strategy: str = "hybrid", max_rows: int = 1_000_000, seed: int = 42,
    counts: ClassCounts | None = None,
) -> DataFrame:
    """At most ``max_rows`` rows with every fraud row; the input itself when it fits."""
    counts = counts or class_counts(df)
    if counts.total <= max_rows:
        return df
    if strategy not in STRATEGIES:
        raise ValueError(f"Unknown strategy: {strategy}. Choose from {list(STRATEGIES)}")
    budget = max(0, max_rows - counts.fraud)
    chosen = STRATEGIES[strategy](df, counts, budget, seed)
    return df.where(is_fraud()).unionByName(chosen.select(*df.columns))


def compare_strategies(
    df: DataFrame, max_rows: int, strategies: list[str] | None = None, seed: int = 42
) -> DataFrame:
    """Rows, fraud rows, ratio and diversity per strategy; one that rejects its input (``ValueError``) gets an error row.

    Any other failure is raised: a job that broke is no result of its strategy.
    """
    strategies = strategies or [s for s in STRATEGIES if s != "informative"]
    counts = class_counts(df)
    columns = "strategy string, n_rows bigint, fraud_count bigint, fraud_ratio double, diversity double, error string"
    kinds = dict(part.strip().split(" ") for part in columns.split(","))
    parts = []
    for name in strategies:
        try:
            sampled = sample(df, name, max_rows, seed, counts)
            parts.append(
                sampled.agg(
                    F.count("*").alias("n_rows"),
                    F.sum(F.col(LABEL).cast("bigint")).alias("fraud_count"),
                    F.avg(LABEL).alias("fraud_ratio"),
                    diversity(df).alias("diversity"),
                ).select(F.lit(name).alias("strategy"), "*", F.lit(None).cast("string").alias("error"))
            )
        except ValueError as problem:
            parts.append(
                small_table(df.sparkSession, [(name, None, None, None, None, str(problem)[:200])], kinds)
            )
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
