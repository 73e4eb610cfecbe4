"""Exact "first n in order" selections without sorting the table.

Sampling, splitting and folding all ask for the first n rows in some order.  A
sort, a global ``row_number`` or ``orderBy().limit(n)`` would push the table, a
hot group or n rows through one task or the driver.  Here the n-th row is found
first, with a few aggregates over narrow columns; the selection is then a plain
filter "at or before the n-th row", and what is left over is its negation.  Both
are narrow, so no row is shuffled and a group holding a third of the table costs
no more than any other.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import hash_order
from ..schema import KEY
from ..session import small_table
from .quantiles import order_statistics

# Keys are lower-case hex, so "" precedes and "~" follows every key.
NOTHING, EVERYTHING = "", "~"

_ROWS_PER_BUCKET = 4096
_MAX_PREFIX = 5
# Rows that one final ranking may hold; larger brackets are narrowed further.
_BRACKET_ROWS = 10_000
_MAX_GROUPS = 10_000


def prefix_length(rows: int) -> int:
    """Hex digits of a hash key under whose values few enough rows lie to be ranked together."""
    return min(_MAX_PREFIX, max(1, math.ceil(math.log(max(rows / _ROWS_PER_BUCKET, 1), 16))))


def group_counts(df: DataFrame, group: Column) -> dict:
    """Rows per group, for groups of a checked number (types, classes, clusters)."""
    rows = df.groupBy(group.alias("g")).count().limit(_MAX_GROUPS + 1).collect()
    if len(rows) > _MAX_GROUPS:
        raise ValueError(f"more than {_MAX_GROUPS} groups; stratify on a coarser column")
    return {r["g"]: r["count"] for r in rows}


def hash_cutoffs(
    df: DataFrame,
    order: Column,
    group: Column,
    ranks: Mapping[object, Sequence[int]],
    totals: Mapping[object, int],
) -> dict[object, list[str]]:
    """Key of the row at each wanted rank (1-based) per group, in hex-key order.

    Pass 1 counts rows per key prefix and finds the prefix that holds each rank;
    pass 2 ranks only the rows under those prefixes.  Keys are uniform, so a
    prefix holds about ``_ROWS_PER_BUCKET`` rows however large the group is.
    """
    found = {g: [EVERYTHING] * len(wanted) for g, wanted in ranks.items()}
    search = []
    for g, wanted in ranks.items():
        for i, rank in enumerate(wanted):
            if rank <= 0:
                found[g][i] = NOTHING
            elif rank < totals.get(g, 0):
                search.append((g, i, rank))
    if not search:
        return found

    length = prefix_length(max(totals[g] for g, _, _ in search))
    groups = {g: n for n, g in enumerate(dict.fromkeys(g for g, _, _ in search))}
    keyed = df.select(_by_group(group, groups).alias("g"), order.alias("k")).where("g is not null")

    spark = df.sparkSession
    targets = small_table(
        spark,
        [(groups[g], i, rank) for g, i, rank in search],
        {"tg": "int", "slot": "int", "rank": "bigint"},
    )
    running = W.partitionBy("g").orderBy("p").rowsBetween(W.unboundedPreceding, -1)
    buckets = (
        keyed.groupBy("g", F.substring("k", 1, length).alias("p"))
        .agg(F.count("*").alias("n"))
        .withColumn("below", F.coalesce(F.sum("n").over(running), F.lit(0)))
    )
    hits = buckets.join(
        F.broadcast(targets),
        (F.col("g") == F.col("tg")) & (F.col("rank") > F.col("below")) & (F.col("rank") <= F.col("below") + F.col("n")),
    ).select("g", "p", "below", "slot", "rank").collect()

    edges = small_table(
        spark,
        [(r["g"], r["p"], r["rank"] - r["below"], r["slot"]) for r in hits],
        {"eg": "int", "ep": "string", "nth": "bigint", "slot": "int"},
    )
    under = (
        keyed.withColumn("p", F.substring("k", 1, length))
        .join(
            F.broadcast(edges.select("eg", "ep").distinct()),
            (F.col("g") == F.col("eg")) & (F.col("p") == F.col("ep")),
            "left_semi",
        )
        .withColumn("nth", F.row_number().over(W.partitionBy("g", "p").orderBy("k")))
    )
    exact = under.join(
        F.broadcast(edges.withColumnRenamed("nth", "want")),
        (F.col("g") == F.col("eg")) & (F.col("p") == F.col("ep")) & (F.col("nth") == F.col("want")),
    ).select("g", "slot", "k").collect()
    names = {n: g for g, n in groups.items()}
    for r in exact:
        found[names[r["g"]]][r["slot"]] = r["k"]
    return found


_NULL = "\x00"


def _text(group) -> str:
    """A group value the way a cast to string shows it."""
    if group is None:
        return _NULL
    return str(group).lower() if isinstance(group, bool) else str(group)


def _by_group(group: Column, values: Mapping[object, object]) -> Column:
    """Value of the row's group, null for other groups; the group is evaluated once."""
    table = F.create_map(*[F.lit(x) for g, v in values.items() for x in (_text(g), v)])
    return F.try_element_at(table, F.coalesce(group.cast("string"), F.lit(_NULL)))


def at_or_before(order: Column, group: Column, cutoffs: Mapping[object, str]) -> Column:
    """True for rows whose key does not pass the cut-off of their group."""
    if not cutoffs:
        return F.lit(False)
    return F.coalesce(order <= _by_group(group, cutoffs), F.lit(False))


def first_by_hash(
    df: DataFrame,
    quotas: Mapping[object, int] | int,
    seed: int | str,
    group: Column | None = None,
    totals: Mapping[object, int] | None = None,
    key: str = KEY,
) -> Column:
    """Predicate that holds for exactly the first quota rows of each group in hash order."""
    order = hash_order(seed, key)
    if group is None:
        group, quotas = F.lit(1), {1: quotas}
        totals = totals or {1: df.count()}
    totals = totals or group_counts(df, group)
    cuts = hash_cutoffs(df, order, group, {g: [q] for g, q in quotas.items()}, totals)
    return at_or_before(order, group, {g: c[0] for g, c in cuts.items()})


@dataclass(frozen=True)
class Cutoff:
    """The n-th row in (value, key) order."""

    value: float
    key: str = EVERYTHING

    def holds(self, value: Column, key: Column) -> Column:
        """True at or before the n-th row; the value is evaluated once."""
        row = F.struct(_nulls_last(value).alias("v"), key.alias("k"))
        return row <= F.struct(F.lit(self.value).alias("v"), F.lit(self.key).alias("k"))


ALL_ROWS = Cutoff(float("inf"), EVERYTHING)
NO_ROWS = Cutoff(float("-inf"), NOTHING)


def value_cutoff(
    df: DataFrame, value: Column, key: Column, n: int, total: int, bracket_rows: int = _BRACKET_ROWS
) -> Cutoff:
    """The n-th row by (value, key), ascending; null and NaN come last, with infinity.

    The n-th value comes from exact counts (``order_statistics``), which evaluate ``value`` once a row and pass; among the
    rows that share it the n-th row is found by key.
    """
    if n <= 0:
        return NO_ROWS
    if n >= total:
        return ALL_ROWS
    narrow = df.select(_nulls_last(value).alias("v"), key.alias("k"))
    at, below, same = order_statistics(narrow.select("v"), {"v": [n - 1]}, bracket_rows)["v"][n - 1]
    part = narrow.where(F.col("v") == F.lit(at))
    if same > bracket_rows:
        one = F.lit(1)
        return Cutoff(at, hash_cutoffs(part, F.col("k"), one, {1: [n - below]}, {1: same})[1][0])
    ranked = part.withColumn("r", F.row_number().over(W.orderBy("k")))
    return Cutoff(at, ranked.where(F.col("r") == n - below).first()["k"])


def _nulls_last(value: Column) -> Column:
    # Evaluated once: filters don't share common expressions.
    most = F.lit(float("inf"))
    return F.coalesce(F.nanvl(value.cast("double"), most), most)


def hash_ranked(df: DataFrame, seed: int | str, column: str = "rank", key: str = KEY) -> DataFrame:
    """Adds the 0-based global rank in hash order.

    Ranks inside a key prefix are counted separately and shifted by the number
    of rows under smaller prefixes, so no task sees more than one prefix.
    """
    length = prefix_length(df.count())
    keyed = df.withColumn("_k", hash_order(seed, key)).withColumn("_p", F.substring("_k", 1, length))
    running = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    # At most 16**length prefix rows reach this window.
    offsets = (
        keyed.groupBy("_p")
        .agg(F.count("*").alias("_n"))
        .select("_p", F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_below"))
    )
    local = F.row_number().over(W.partitionBy("_p").orderBy("_k"))
    return (
        keyed.withColumn("_r", local)
        .join(offsets, "_p")
        .withColumn(column, F.col("_below") + F.col("_r") - 1)
        .drop("_k", "_p", "_r", "_below")
    )


def split_flag(df: DataFrame, label: str, test_size: float, seed: int | str) -> Column:
    """'test' for the first ``round(test_size * n)`` rows of each class in hash order, else 'train'."""
    totals = group_counts(df, F.col(label))
    quotas = {c: int(math.floor(test_size * n + 0.5)) for c, n in totals.items()}
    chosen = first_by_hash(df, quotas, seed, F.col(label), totals)
    return F.when(chosen, "test").otherwise("train")


def fold_number(df: DataFrame, label: str, folds: int, seed: int | str) -> Column:
    """Stratified fold id: each class is cut into ``folds`` runs of hash order, sizes within one row."""
    totals = group_counts(df, F.col(label))
    ranks = {}
    for c, n in totals.items():
        sizes = [n // folds + (1 if f < n % folds else 0) for f in range(folds)]
        ranks[c] = [sum(sizes[: f + 1]) for f in range(folds - 1)]
    order = hash_order(seed)
    cuts = hash_cutoffs(df, order, F.col(label), ranks, totals)
    fold = F.lit(None).cast("int")
    for c, keys in cuts.items():
        number = F.lit(folds - 1)
        for f in reversed(range(folds - 1)):
            number = F.when(order <= F.lit(keys[f]), f).otherwise(number)
        fold = F.when(F.col(label).eqNullSafe(F.lit(c)), number).otherwise(fold)
    return fold.cast("int")
