"""Feature engineering, encoding, scaling and selection with a fitted state.

Fitting costs a few aggregates and leaves scalars behind; applying is a single
projection, so a transformed table is one scan and one codegen stage.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.guards import finite_or_zero, ratio
from ..functions.hashing import hash_order
from ..schema import FLAG, IDENTIFIERS, KEY, LABEL, has, numeric_columns
from ..session import small_table, stage, staging
from .clean import clean
from .information import neighbour_information
from .ordering import prefix_length
from .profile import type_stats
from .quantiles import bin_counts, exact_quantiles

SCALERS = ("standard", "minmax", "robust")
BALANCES = ("oldbalanceOrg", "newbalanceOrig", "oldbalanceDest", "newbalanceDest")
BASE = ("step", "type", "amount") + BALANCES
_MAX_TYPES = 1000


# ---- type statistics -------------------------------------------------------

def fit_type_stats(df: DataFrame) -> dict[str, tuple[float, float | None]]:
    """{type: (mean, sample std)}; the number of types is checked."""
    rows = type_stats(df.where(F.col("type").isNotNull())).limit(_MAX_TYPES + 1).collect()
    if len(rows) > _MAX_TYPES:
        raise ValueError(f"column 'type' has more than {_MAX_TYPES} values; it is not a category")
    return {r["type"]: (r["mean"], r["std"]) for r in rows}


def _lookup(values: dict, key: Column, default: Column) -> Column:
    known = {k: v for k, v in values.items() if v is not None}
    if not known:
        return default
    table = F.create_map(*[F.lit(x) for kv in sorted(known.items()) for x in kv])
    return F.coalesce(F.try_element_at(table, key), default)


# ---- feature groups ----------------------------------------------------------

def amount_features(df: DataFrame) -> dict[str, Column]:
    if not has(df, "amount"):
        return {}
    amount = F.col("amount")
    return {"amount_log": F.log1p(amount), "amount_sqrt": F.sqrt(amount)}


def balance_features(df: DataFrame) -> dict[str, Column]:
    features: dict[str, Column] = {}
    if has(df, "oldbalanceOrg", "newbalanceOrig"):
        old, new = F.col("oldbalanceOrg"), F.col("newbalanceOrig")
        features["balance_change_orig"] = new - old
        features["balance_change_ratio_orig"] = ratio(new - old, old + 1)
        features["amount_to_balance_ratio"] = ratio(F.col("amount"), old + 1)
        features["zero_balance_orig"] = (new == 0).cast("int")
    if has(df, "oldbalanceDest", "newbalanceDest"):
        old, new = F.col("oldbalanceDest"), F.col("newbalanceDest")
        features["balance_change_dest"] = new - old
        features["balance_change_ratio_dest"] = ratio(new - old, old + 1)
    return features


def type_features(df: DataFrame, stats: dict, unseen_mean: float | None) -> dict[str, Column]:
    """Amount against the statistics of its type; an unseen type uses the batch mean and std 1."""
    if not has(df, "type", "amount"):
        return {}
    amount, kind = F.col("amount"), F.col("type")
    fallback = F.lit(float(unseen_mean if unseen_mean is not None else 0.0))
    mean = _lookup({t: m for t, (m, _) in stats.items()}, kind, fallback)
    # A type with one row has no standard deviation: it counts as 0, not as unseen.
    std = _lookup({t: (s if s is not None else 0.0) for t, (_, s) in stats.items()}, kind, F.lit(1.0))
    return {
        "amount_vs_type_mean": ratio(amount, mean + 1),
        "amount_zscore_by_type": F.when(std > 0, ratio(amount - mean, std)).otherwise(F.lit(0.0)),
    }


def time_features(df: DataFrame) -> dict[str, Column]:
    if not has(df, "step"):
        return {}
    hour = F.pmod(F.col("step"), F.lit(24))
    turn = 2 * math.pi * hour / 24
    return {
        "hour_of_day": hour,
        "day_of_sim": F.floor(F.col("step") / 24),
        "unusual_hour": ((hour < 6) | (hour > 22)).cast("int"),
        "hour_sin": F.sin(turn),
        "hour_cos": F.cos(turn),
    }


def shape_features(df: DataFrame) -> dict[str, Column]:
    if not has(df, "amount"):
        return {}
    return {"round_amount": (F.col("amount") == F.rint("amount")).cast("int")}


def engineered(df: DataFrame, stats: dict, unseen_mean: float | None) -> dict[str, Column]:
    """All engineered features that the columns of ``df`` allow, in a fixed order."""
    groups = {
        **amount_features(df),
        **balance_features(df),
        **type_features(df, stats, unseen_mean),
        **time_features(df),
        **shape_features(df),
    }
    return {name: finite_or_zero(value) for name, value in groups.items()}


def leakage_features() -> dict[str, Column]:
    """Features known to give the label away; for the leakage audit only."""
    orig = F.col("oldbalanceOrg") - F.col("amount") - F.col("newbalanceOrig")
    dest = F.col("oldbalanceDest") + F.col("amount") - F.col("newbalanceDest")
    orig_error, dest_error = F.abs(orig) > 0.01, F.abs(dest) > 0.01
    return {
        "orig_error_flag": orig_error.cast("int"),
        "dest_error_flag": dest_error.cast("int"),
        "balance_mismatch": (orig_error | dest_error).cast("int"),
        "emptied_account": ((F.col("oldbalanceOrg") > 0) & (F.col("newbalanceOrig") == 0)).cast("int"),
        "zero_balance_after": (F.col("newbalanceOrig") == 0).cast("int"),
    }


def balance_errors(df: DataFrame) -> DataFrame:
    """Key, label and by how much each side's balance misses the amount: values that leak the label."""
    orig = F.col("oldbalanceOrg") - F.col("amount") - F.col("newbalanceOrig")
    dest = F.col("oldbalanceDest") + F.col("amount") - F.col("newbalanceDest")
    return df.select(KEY, LABEL, orig.alias("orig_balance_error"), dest.alias("dest_balance_error"))


def leakage_audit(df: DataFrame) -> DataFrame:
    """Per suspicious feature: share of rows where it equals the label, precision and recall."""
    flags = leakage_features()
    label = F.col(LABEL)
    row = df.select(label, *[c.alias(n) for n, c in flags.items()]).agg(
        F.count("*").alias("n"),
        F.sum(label.cast("bigint")).alias("pos"),
        *[F.sum((F.col(n) == label).cast("bigint")).alias(f"{n}__agree") for n in flags],
        *[F.sum(F.col(n).cast("bigint")).alias(f"{n}__set") for n in flags],
        *[F.sum((F.col(n) * label).cast("bigint")).alias(f"{n}__hit") for n in flags],
    )
    cells = [
        F.struct(
            F.lit(n).alias("feature"),
            ratio(F.col(f"{n}__agree"), F.col("n")).alias("agreement"),
            ratio(F.col(f"{n}__hit"), F.col(f"{n}__set")).alias("precision"),
            ratio(F.col(f"{n}__hit"), F.col("pos")).alias("recall"),
        )
        for n in flags
    ]
    return row.select(F.inline(F.array(*cells)))


# ---- encoding ------------------------------------------------------------------

def fit_codes(df: DataFrame, column: str) -> dict[str, int]:
    """Codes in sorted value order; the number of values is checked."""
    rows = df.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("v")).distinct()
    values = [r["v"] for r in rows.limit(_MAX_TYPES + 1).collect()]
    if len(values) > _MAX_TYPES:
        raise ValueError(f"column {column!r} has more than {_MAX_TYPES} values; it is not a category")
    return {v: i for i, v in enumerate(sorted(values))}


def encode(column: str, codes: dict[str, int] | None) -> Column:
    """Code of the value, -1 for an unseen one; 0 for a column never fitted."""
    if codes is None:
        return F.lit(0)
    return _lookup(codes, F.col(column).cast("string"), F.lit(-1))


# ---- scaling -------------------------------------------------------------------

def fit_scaler(df: DataFrame, columns: list[str], method: str) -> dict[str, tuple[float, float]]:
    """{column: (offset, divisor)}; a zero divisor becomes 1."""
    if method not in SCALERS:
        raise ValueError(f"Unknown scaling method: {method}")
    if method == "robust":
        quartiles = exact_quantiles(df, {c: F.col(c) for c in columns}, (0.25, 0.5, 0.75))
        pairs = {c: (q[1], q[2] - q[0]) if q[0] is not None else (0.0, 1.0) for c, q in quartiles.items()}
    else:
        low, span = (F.avg, F.stddev_pop) if method == "standard" else (F.min, lambda c: F.max(c) - F.min(c))
        row = df.agg(*[f(c).alias(f"{c}__{s}") for c in columns for s, f in (("a", low), ("b", span))]).first()
        pairs = {c: (row[f"{c}__a"] or 0.0, row[f"{c}__b"] or 0.0) for c in columns}
    return {c: (float(a), float(b) if b else 1.0) for c, (a, b) in pairs.items()}


def scaled(column: str, params: dict[str, tuple[float, float]]) -> Column:
    offset, divisor = params[column]
    return (F.col(column).cast("double") - F.lit(offset)) / F.lit(divisor)


# ---- selection -----------------------------------------------------------------

def select_by_variance(df: DataFrame, columns: list[str], threshold: float = 0.01) -> dict[str, float]:
    """Population variance of the columns above the threshold, in column order."""
    row = df.agg(*[F.var_pop(c).alias(c) for c in columns]).first()
    return {c: row[c] for c in columns if row[c] is not None and row[c] > threshold}


def bin_edges(df: DataFrame, columns: list[str], bins: int = 10) -> list[list[float]]:
    """Distinct inner quantile edges of each column over all rows; a flag has at most two bins."""
    cuts = exact_quantiles(df, {c: F.col(c) for c in columns}, [i / bins for i in range(1, bins)])
    return [sorted({e for e in cuts[c] if e is not None}) for c in columns]


def mutual_information(df: DataFrame, columns: list[str], label: str = LABEL, bins: int = 10) -> DataFrame:
    """(feature, mi) in nats from quantile-binned joint counts.

    Each task counts its rows by (feature, bin, label); at most features x bins x classes partial counts of a batch leave it.
    """
    joint = bin_counts(df, columns, bin_edges(df, columns, bins), label)
    total = F.sum("n").over(W.partitionBy("i"))
    by_bin = F.sum("n").over(W.partitionBy("i", "bin"))
    by_label = F.sum("n").over(W.partitionBy("i", "y"))
    terms = joint.select("i", "n", total.alias("t"), by_bin.alias("b"), by_label.alias("l"))
    share = F.col("n") / F.col("t")
    term = share * F.log((F.col("n").cast("double") * F.col("t")) / (F.col("b").cast("double") * F.col("l")))
    names = F.array(*map(F.lit, columns))
    return terms.groupBy("i").agg(F.greatest(F.sum(term), F.lit(0.0)).alias("mi")).select(
        F.get(names, F.col("i")).alias("feature"), "mi"
    )


def ordered_statistics(df: DataFrame, column: str, label: str = LABEL, seed: int | str = 42, prior: float = 0.5) -> DataFrame:
    """Adds ``statistic``: (fraud rows + prior) / (rows + 1) among the rows of the same category that come before in hash order.

    A row never sees its own label. Running sums are made per category and key prefix and shifted by
    the sums of the smaller prefixes, so a category with a third of the rows is spread over many tasks. A null category
    is a category; null labels count as 0.
    """
    length = prefix_length(df.count())
    keyed = df.withColumns({
        "_c": F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("")), "_k": hash_order(seed),
        "_y": F.coalesce(F.col(label).cast("bigint"), F.lit(0))}).withColumn("_p", F.substring("_k", 1, length))
    earlier = W.partitionBy("_c").orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    offsets = keyed.groupBy("_c", "_p").agg(F.count("*").alias("n"), F.sum("_y").alias("y")).select(
        "_c", "_p", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_n0"), F.coalesce(F.sum("y").over(earlier), F.lit(0)).alias("_y0"))
    before = W.partitionBy("_c", "_p").orderBy("_k").rowsBetween(W.unboundedPreceding, -1)
    local = keyed.withColumns({"_n1": F.count("*").over(before), "_y1": F.coalesce(F.sum("_y").over(before), F.lit(0))})
    statistic = (F.col("_y0") + F.col("_y1") + F.lit(prior)) / (F.col("_n0") + F.col("_n1") + F.lit(1.0))
    return local.join(offsets, ["_c", "_p"]).select(*df.columns, statistic.alias("statistic"))


# ---- the fitted preprocessor -----------------------------------------------------

@dataclass
class FeatureModel:
    """What fitting learned; ``transform`` replays it on any transactions table."""

    scaling: str = "robust"
    select: bool = True
    variance_threshold: float = 0.01
    information: str = "bins"  # or "neighbours"
    type_stats: dict = field(default_factory=dict)
    mean_amount: float = 0.0
    codes: dict = field(default_factory=dict)
    inputs: list = field(default_factory=list)
    scaler: dict = field(default_factory=dict)
    scores: dict = field(default_factory=dict)
    selected: list = field(default_factory=list)

    def fit(self, df: DataFrame, label: str = LABEL) -> "FeatureModel":
        """``df`` is a cleaned table (see ``clean``). What is staged meanwhile goes when the fit ends."""
        with staging(df.sparkSession):
            return self._fit(df, label)

    def _fit(self, df: DataFrame, label: str) -> "FeatureModel":
        if self.scaling not in SCALERS:
            raise ValueError(f"Unknown scaling method: {self.scaling}")
        source = df.drop(*IDENTIFIERS)
        self.type_stats = fit_type_stats(source) if has(source, "type", "amount") else {}
        if self.type_stats:
            self.mean_amount = float(source.agg(F.avg("amount")).first()[0] or 0.0)
        text = [f.name for f in source.schema.fields if f.dataType.simpleString() == "string" and f.name != KEY]
        self.codes = {c: fit_codes(source, c) for c in text}
        numeric = numeric_columns(source, (label, LABEL, FLAG))
        # Every pass of the scaler and the selection reads the same columns, so they are computed once.
        raw = stage(self._raw(source, numeric + text, unseen_mean=None), "raw-features")
        self.inputs = [c for c in raw.columns if c not in (KEY, label)]
        self.scaler = fit_scaler(raw, self.inputs, self.scaling)
        values = self._scale(raw)
        self.selected = list(self.inputs)
        if self.select:
            kept = list(select_by_variance(values, self.inputs, self.variance_threshold))
            self.selected = kept
            if len(kept) > 5:
                estimate = {"bins": mutual_information, "neighbours": neighbour_information}[self.information]
                rows = estimate(values, kept, label).collect()  # one row per feature
                ranked = sorted(((r["feature"], r["mi"]) for r in rows), key=lambda r: (-r[1], r[0]))
                self.scores = dict(ranked)
                informative = [f for f, mi in ranked if mi > 0]
                if len(informative) >= 5:
                    self.selected = informative
        return self

    def _raw(
        self, df: DataFrame, columns: list[str], unseen_mean: float | None, carry: tuple[str, ...] = ()
    ) -> DataFrame:
        base = {c: encode(c, self.codes.get(c)) if c in self.codes else F.col(c) for c in columns if c in df.columns}
        derived = engineered(df, self.type_stats, unseen_mean)
        keep = [c for c in (KEY, LABEL, *carry) if c in df.columns]
        return df.select(
            *keep,
            *[finite_or_zero(v).alias(c) for c, v in base.items()],
            *[v.alias(c) for c, v in derived.items()],
        )

    def _scale(self, raw: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
        keep = [c for c in (KEY, LABEL, *carry) if c in raw.columns]
        return raw.select(*keep, *[scaled(c, self.scaler).alias(c) for c in self.inputs if c in raw.columns])

    def transform(
        self, df: DataFrame, unseen_mean: float | None = None, carry: tuple[str, ...] = ()
    ) -> DataFrame:
        """Key, label (when present), ``carry`` columns and the selected features; keeps every row.

        ``unseen_mean`` stands in for the mean of a type never fitted; batch scoring passes the
        mean amount of the batch, a stream takes the mean amount of the training rows.
        """
        if not self.inputs:
            raise RuntimeError("the feature model must be fitted before transform")
        if unseen_mean is None:
            unseen_mean = self.mean_amount
        base = [c for c in self.inputs if c in df.columns]
        raw = self._raw(df, base, unseen_mean, carry)
        keep = [c for c in (KEY, LABEL, *carry) if c in raw.columns]
        return self._scale(raw, carry).select(*keep, *[c for c in self.selected if c in raw.columns])

    def feature_scores(self, spark) -> DataFrame:
        return small_table(spark, list(self.scores.items()), {"feature": "string", "mi": "double"})

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> "FeatureModel":
        return cls(**json.loads(text))


def fit_transform(df: DataFrame, **options) -> tuple[FeatureModel, DataFrame]:
    """Clean, fit and transform the training table."""
    cleaned = clean(df)
    model = FeatureModel(**options).fit(cleaned)
    return model, model.transform(cleaned)
