"""Hard negatives: legitimate rows that look like fraud.

Every draw is a hash-uniform column of the synthetic row id, so the table is a
projection over ``range(n)`` joined once with the numbered fraud rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_uniform
from ..schema import FLAG, IDENTIFIERS, KEY, LABEL
from .ordering import hash_ranked

# Share of each of the first six generators; the seventh takes the rest.
SHARES = (("clone", 0.10), ("full_drain", 0.22), ("delayed_dest", 0.18), ("near_drain", 0.15),
          ("large", 0.15), ("noisy", 0.12))
LAST = "zero_origin"
# Half-width of the step shift per generator.
STEP_SHIFT = {"clone": 30, "full_drain": 10, "delayed_dest": 3, "near_drain": 10, "large": 20,
              "noisy": 30, "zero_origin": 10}
# Range of the factor on the old destination balance per generator.
DEST_FACTOR = {"clone": (0.3, 2.0), "full_drain": (0.5, 2.0), "delayed_dest": (0.5, 1.5),
               "near_drain": (0.3, 2.0), "large": (0.5, 2.0), "noisy": (0.3, 2.5), "zero_origin": (0.3, 2.0)}
# Range of the factor on the amount (near_drain derives the amount from the balance).
AMOUNT_FACTOR = {"clone": (0.4, 1.6), "full_drain": (0.3, 1.5), "delayed_dest": (0.5, 1.5),
                 "large": (0.8, 1.5), "noisy": (0.5, 1.5), "zero_origin": (0.5, 1.5)}
# One template row per slot; clone and noisy use slot 0 throughout.
SLOTS = ("amount", "oldbalanceOrg", "oldbalanceDest", "step")


def generator_bounds(n_total: int) -> list[tuple[str, int, int]]:
    """(generator, first id, end id) for ids 0 .. n_total-1."""
    bounds, start = [], 0
    for name, share in SHARES:
        size = int(n_total * share)
        bounds.append((name, start, start + size))
        start += size
    return bounds + [(LAST, start, n_total)]


def _per_generator(values: dict[str, Column], default: Column | None = None) -> Column:
    chosen = default if default is not None else F.lit(None)
    for name, value in values.items():
        chosen = F.when(F.col("gen") == name, value).otherwise(chosen)
    return chosen


def _between(draw: str, low: float, high: float, seed: int) -> Column:
    return F.lit(low) + F.lit(high - low) * hash_uniform(f"{seed}|{draw}", "id")


def hard_negatives(fraud: DataFrame, n_total: int = 10_000, seed: int = 42) -> DataFrame:
    """``n_total`` synthetic legitimate rows with the transactions schema minus identifiers."""
    spark = fraud.sparkSession
    templates = hash_ranked(fraud.select(KEY, "type", *SLOTS), f"{seed}|template", "rank")
    n_fraud = fraud.count()
    if n_fraud == 0:
        raise ValueError("hard negatives need fraud rows as templates")

    gen = F.lit(LAST)
    for name, start, end in reversed(generator_bounds(n_total)[:-1]):
        gen = F.when((F.col("id") >= start) & (F.col("id") < end), name).otherwise(gen)
    ids = spark.range(n_total).select("id", gen.alias("gen"))

    own_row = F.col("gen").isin("clone", "noisy")
    slot_of = lambda s: F.when(own_row, F.lit("row")).otherwise(F.lit(s))
    picks = ids.select(
        "id",
        "gen",
        F.explode(F.array(*[
            F.struct(
                F.lit(s).alias("slot"),
                F.floor(
                    hash_uniform(F.concat(F.lit(f"{seed}|pick|"), slot_of(s)), "id") * F.lit(n_fraud)
                ).cast("bigint").alias("rank"),
            )
            for s in SLOTS
        ])).alias("p"),
    ).select("id", "gen", "p.slot", "p.rank")
    drawn = (
        picks.join(templates.select("rank", "type", *SLOTS), "rank")
        .groupBy("id", "gen")
        .agg(
            *[F.max(F.when(F.col("slot") == s, F.col(s))).alias(f"t_{s}") for s in SLOTS],
            F.max(F.when(F.col("slot") == "amount", F.col("type"))).alias("t_type"),
        )
    )

    u = lambda draw, low, high: _between(draw, low, high, seed)
    coin = lambda draw: hash_uniform(f"{seed}|{draw}", "id")
    near_old = F.round(F.greatest(F.col("t_oldbalanceOrg") * u("org", 0.5, 2.0), F.lit(100.0)), 2)
    amounts = drawn.withColumn("_near", near_old).withColumn(
        "amount",
        F.round(
            _per_generator(
                {g: F.col("t_amount") * u("amount", lo, hi) for g, (lo, hi) in AMOUNT_FACTOR.items()},
                F.col("_near") * u("drain", 0.9, 1.0),
            ),
            2,
        ),
    )
    amount = F.col("amount")
    old_org = amounts.withColumn(
        "oldbalanceOrg",
        F.round(
            _per_generator(
                {
                    "clone": F.when(F.col("t_oldbalanceOrg") > 0, F.col("t_oldbalanceOrg") * u("org", 0.5, 1.5))
                    .otherwise(F.col("t_oldbalanceOrg")),
                    "near_drain": F.col("_near"),
                    "large": amount * u("org", 1.0, 1.5),
                    "noisy": amount * u("org", 0.8, 1.3),
                    "zero_origin": F.lit(0.0),
                },
                amount,
            ),
            2,
        ),
    ).withColumn(
        "oldbalanceDest",
        F.round(
            F.greatest(
                _per_generator({g: F.col("t_oldbalanceDest") * u("dest", lo, hi) for g, (lo, hi) in DEST_FACTOR.items()}),
                F.lit(0.0),
            ),
            2,
        ),
    )
    old_dest = F.col("oldbalanceDest")
    cut = coin("settle")
    settled = old_org.withColumn(
        "newbalanceOrig",
        _per_generator(
            {"full_drain": F.lit(0.0), "delayed_dest": F.lit(0.0), "zero_origin": F.lit(0.0)},
            F.round(F.greatest(F.col("oldbalanceOrg") - amount, F.lit(0.0)), 2),
        ),
    ).withColumn(
        "newbalanceDest",
        F.round(
            _per_generator(
                {
                    "clone": F.when(cut < 0.8, old_dest + amount).otherwise(old_dest + amount * u("part", 0.5, 1.0)),
                    "delayed_dest": old_dest,
                    "near_drain": F.when(cut < 0.33, old_dest + amount)
                    .when(cut < 0.66, old_dest + amount * u("part", 0.0, 0.3))
                    .otherwise(old_dest),
                    "noisy": old_dest + amount * u("part", 0.3, 1.0),
                    "zero_origin": old_dest + amount * u("part", 0.5, 1.0),
                },
                old_dest + amount,
            ),
            2,
        ),
    )
    shift = _per_generator(
        {g: F.floor(coin("step") * F.lit(2 * w + 1)) - F.lit(w) for g, w in STEP_SHIFT.items()}
    )
    return settled.select(
        F.md5(F.concat(F.lit(f"{seed}|synthetic|"), F.col("id").cast("string"))).alias(KEY),
        F.greatest(F.col("t_step") + shift, F.lit(1)).cast("int").alias("step"),
        F.when(own_row, F.col("t_type"))
        .otherwise(F.when(coin("type") < 0.5, "TRANSFER").otherwise("CASH_OUT"))
        .alias("type"),
        "amount", "oldbalanceOrg", "newbalanceOrig", "oldbalanceDest", "newbalanceDest",
        F.lit(0).alias(LABEL),
        F.lit(0).alias(FLAG),
        F.col("gen").alias("generator"),
    )


def augment(df: DataFrame, n_total: int = 43_000, seed: int = 42) -> DataFrame:
    """Fraud, legitimate and synthetic rows without the identifier columns."""
    synthetic = hard_negatives(df.where(F.col(LABEL) == 1), n_total, seed).drop("generator")
    return df.drop(*IDENTIFIERS).unionByName(synthetic)


def augmentation_report(df: DataFrame, n_total: int) -> DataFrame:
    """Class counts and fraud ratio before and after adding ``n_total`` hard negatives."""
    counts = df.agg(
        F.sum(F.col(LABEL).cast("bigint")).alias("fraud"),
        F.count(F.when(F.col(LABEL) != 1, 1)).alias("legit"),
    )
    stage = lambda name, extra: F.struct(
        F.lit(name).alias("stage"),
        F.col("fraud").alias("fraud"),
        (F.col("legit") + extra).alias("legit"),
        (F.col("fraud") + F.col("legit") + extra).alias("total"),
        (F.col("fraud") / (F.col("fraud") + F.col("legit") + extra)).alias("fraud_ratio"),
    )
    return counts.select(F.inline(F.array(stage("before", 0), stage("after", n_total))))
