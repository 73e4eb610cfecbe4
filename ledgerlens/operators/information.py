"""Mutual information of a class and numeric columns by nearest neighbours, over all rows.

For a row, d is the distance to its k-th nearest row of the same class in one column, and m the number of rows of any
class nearer than d, itself included (equally valued, where d is 0). The estimate is psi(N) + mean psi(k) - mean psi(N of the class) - mean psi(m),
not below zero; k is one less than the class's rows where these are too few, and classes of one row are left out.

Values become whole numbers of one scale per column with hashed low bits, which part equal values as a tiny noise would. So
distances are exact, and the estimate is the same on any cluster. Rows are dealt to chunks of the sorted
column; a chunk sees the k rows of each class on either side of it, which settles every d. What
lies nearer than d is counted inside the chunk. Where d reaches past its ends, the chunks in between count
by their sizes and the chunk where it ends is asked for its share.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import hash_order
from ..schema import KEY, LABEL
from ..session import small_table, stage
from .quantiles import unpivoted

NEIGHBOURS = 3
CHUNK_ROWS = 1 << 16
#: Values take 35 bits, the hash that parts equal ones 26.
_VALUE_BITS, _NOISE = 35, 1 << 26


def digamma(n: np.ndarray) -> np.ndarray:
    """psi of whole numbers from 1: shifted by six, then the asymptotic series."""
    n = np.asarray(n, float)
    x = n + 6
    inverse = 1 / (x * x)
    series = np.log(x) - 0.5 / x - inverse * (1 / 12 - inverse * (1 / 120 - inverse * (1 / 252 - inverse * (1 / 240 - inverse / 132))))
    return series - sum(1 / (n + i) for i in range(6))


def whole_values(df: DataFrame, columns: list[str], label: str, seed: int | str) -> DataFrame:
    """(i, y, v): column number, class and whole-number value of every row with a class; null values count as 0."""
    tops = df.agg(*[F.max(F.abs(F.col(c).cast("double"))).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    scales = [float(2.0 ** (_VALUE_BITS - math.ceil(math.log2(t)))) if t else 1.0 for t in tops]
    noise = [F.conv(F.substring(hash_order(f"{seed}|near|{c}"), 1, 7), 16, 10).cast("long") % F.lit(_NOISE) for c in columns]
    values = [F.rint(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * F.lit(s)).cast("long") * F.lit(_NOISE) + n for c, s, n in zip(columns, scales, noise)]
    classes = F.struct(F.col(label).cast("int").alias("y"))
    return unpivoted(df, [F.struct(v.alias("v"), classes.alias("c")) for v in values]).select("i", "v.c.y", "v.v")


def kth_distance(sorted_values: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Distance of the values at the given places to their k-th nearest other value."""
    best = np.full(len(at), np.iinfo(np.int64).max)
    n, x = len(sorted_values), sorted_values[at]
    for below in range(k + 1):
        low, high = at - below, at - below + k
        inside = (low >= 0) & (high < n)
        reach = np.maximum(x[inside] - sorted_values[low[inside]], sorted_values[high[inside]] - x[inside])
        best[inside] = np.minimum(best[inside], reach)
    return best


def neighbour_information(df: DataFrame, columns: list[str], label: str = LABEL, k: int = NEIGHBOURS, seed: int | str = 42,
                          chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(feature, mi) in nats; a table without rows or with one row per class gives no information: 0."""
    spark = df.sparkSession
    kinds = {"feature": "string", "mi": "double"}
    classes = {r["y"]: r["count"] for r in df.where(F.col(label).isNotNull()).groupBy(F.col(label).cast("int").alias("y")).count().collect()}
    classes = {y: n for y, n in classes.items() if n > 1}
    total = sum(classes.values())
    if not total or not columns:
        return small_table(spark, [(c, 0.0) for c in columns], kinds)
    used = df.where(F.col(label).cast("int").isin(list(classes)))
    values = whole_values(used, columns, label, seed)

    # Chunk edges only have to deal rows evenly; every count below is exact.
    chunks = max(1, math.ceil(total / chunk_rows))
    shares = [j / chunks for j in range(1, chunks)]
    edges = {i: [] for i in range(len(columns))}
    if shares:
        for r in values.groupBy("i").agg(F.percentile_approx("v", shares, 10 * chunks).alias("e")).collect():  # one row a column
            edges[r["i"]] = sorted(set(r["e"]))
    shared = spark.sparkContext.broadcast({i: np.array(e, np.int64) for i, e in edges.items()})

    @F.pandas_udf("int")
    def chunk_of(i: pd.Series, v: pd.Series) -> pd.Series:
        out, numbers, x = np.zeros(len(v), np.int32), i.to_numpy(), v.to_numpy()
        for column in np.unique(numbers):
            at = numbers == column
            out[at] = np.searchsorted(shared.value[column], x[at], side="left")
        return pd.Series(out)

    dealt = stage(values.withColumn("chunk", chunk_of("i", "v")), "near-values")

    # The k outermost values of each class in a chunk, and those that its neighbours lend it.
    by = W.partitionBy("i", "y", "chunk")
    ends = dealt.select(
        "i", "y", "chunk", "v", F.row_number().over(by.orderBy("v")).alias("up"), F.row_number().over(by.orderBy(F.desc("v"))).alias("down"))
    outer = stage(ends.where((F.col("up") <= k) | (F.col("down") <= k)).groupBy("i", "y", "chunk").agg(
        F.sort_array(F.collect_list(F.when(F.col("up") <= k, F.col("v")))).alias("first"),
        F.sort_array(F.collect_list(F.when(F.col("down") <= k, F.col("v")))).alias("last")), "near-ends")
    spots = spark.range(1).select(F.explode(F.array(*[F.lit(int(y)) for y in sorted(classes)])).alias("y"))
    every = dealt.select("i", "chunk").distinct().join(F.broadcast(spots)).join(outer, ["i", "y", "chunk"], "left")
    lists = _lent(every, outer, k)
    lent = stage(lists.select("i", "y", "chunk", F.slice(F.reverse("before"), 1, k).alias("before"), F.slice("after", 1, k).alias("after")), "near-lent")

    sizes = dealt.groupBy("i", "chunk").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()  # one row a chunk
    bounds: dict[int, tuple] = {}
    for i in range(len(columns)):
        mine = sorted((r["chunk"], r["n"], r["low"], r["high"]) for r in sizes if r["i"] == i)
        bounds[i] = tuple(np.array(x, np.int64) for x in zip(*mine))
    layout = spark.sparkContext.broadcast(bounds)

    def count(key, rows: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
        names = ["i", "ask", "home", "y", "at", "m", "side", "limit", "psi", "n"]
        if not len(rows):
            return pd.DataFrame({c: [] for c in names})
        column, chunk = int(key[0]), int(key[1])
        numbers, counts, lows, highs = layout.value[column]
        here = int(np.searchsorted(numbers, chunk))
        before = np.concatenate([[0], np.cumsum(counts)])
        everything = np.sort(rows["v"].to_numpy(np.int64))
        out, psi, done = [], 0.0, 0
        for r in ends.itertuples():
            mine = np.sort(rows["v"].to_numpy(np.int64)[rows["y"].to_numpy() == r.y])
            if not len(mine):
                continue
            below, above = np.sort(np.array(list(r.before), np.int64)), np.sort(np.array(list(r.after), np.int64))
            line = np.concatenate([below, mine, above])
            d = kth_distance(line, len(below) + np.arange(len(mine)), min(k, classes[r.y] - 1))
            low, high = mine - d, mine + d  # both ends open
            near = np.searchsorted(everything, high, "left") - np.searchsorted(everything, low, "right")
            # Equal values are in one chunk; where they reach to the k-th neighbour, all of them count.
            near = np.where(d == 0, np.searchsorted(everything, mine, "right") - np.searchsorted(everything, mine, "left"), near)
            down = (here > 0) & (d > 0) & (low < (highs[here - 1] if here else 0))
            up = (here + 1 < len(numbers)) & (d > 0) & (high > (lows[here + 1] if here + 1 < len(numbers) else 0))
            inside = ~down & ~up
            psi, done = psi + float(digamma(near[inside]).sum()), done + int(inside.sum())
            for side, crossing, limit in ((0, down, low), (1, up, high)):
                for at in np.flatnonzero(crossing):
                    if side == 0:  # rows above the limit in earlier chunks
                        goal = int(np.searchsorted(highs, limit[at], "right"))
                        full = before[here] - before[goal + 1]
                    else:
                        goal = int(np.searchsorted(lows, limit[at], "left")) - 1
                        full = before[goal] - before[here + 1]
                    own = int(near[at]) if side == 0 or not down[at] else 0
                    out.append((column, int(numbers[goal]), chunk, r.y, int(at), own + int(full), side, int(limit[at]), 0.0, 0))
        out.append((column, -1, chunk, -1, 0, 0, 0, 0, psi, done))
        return pd.DataFrame(out, columns=names)

    got = stage(dealt.groupBy("i", "chunk").cogroup(lent.groupBy("i", "chunk")).applyInPandas(
        count, "i int, ask int, home int, y int, at long, m long, side int, limit long, psi double, n long"), "near-counts")
    asked = got.where("ask >= 0").select("i", F.col("ask").alias("chunk"), "home", "y", "at", "m", "side", "limit")

    def answer(rows: pd.DataFrame, chunk: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({c: [] for c in ("i", "home", "y", "at", "m")})
        v, limit = np.sort(chunk["v"].to_numpy(np.int64)), rows["limit"].to_numpy(np.int64)
        share = np.where(rows["side"] == 0, len(v) - np.searchsorted(v, limit, "right"), np.searchsorted(v, limit, "left"))
        return rows.assign(m=rows["m"] + share)[["i", "home", "y", "at", "m"]]

    parts = asked.groupBy("i", "chunk").cogroup(dealt.groupBy("i", "chunk")).applyInPandas(answer, "i int, home int, y int, at long, m long")
    whole = parts.groupBy("i", "home", "y", "at").agg(F.sum("m").alias("m")).groupBy("i", "m").count()

    @F.pandas_udf("double")
    def psi_of(m: pd.Series) -> pd.Series:
        return pd.Series(digamma(m.to_numpy()))

    crossed = whole.select("i", (psi_of("m") * F.col("count")).alias("psi"), F.col("count").alias("n"))
    sums = got.where("ask < 0").select("i", "psi", "n").unionByName(crossed).groupBy("i").agg(F.sum("psi").alias("psi"), F.sum("n").alias("n")).collect()
    base = float(digamma(np.array([total]))[0])
    for y, n in classes.items():
        base += n / total * float(digamma(np.array([min(k, n - 1)]))[0] - digamma(np.array([n]))[0])
    found = {r["i"]: (max(0.0, base - r["psi"] / total), r["n"]) for r in sums}
    if any(n != total for _, n in found.values()):
        raise RuntimeError("rows were lost on the way")
    return small_table(spark, [(c, found[i][0]) for i, c in enumerate(columns)], kinds)


def _lent(every: DataFrame, outer: DataFrame, k: int) -> DataFrame:
    """The k rows of each class before and after a chunk, from as many chunks with the class as needed."""
    line = W.partitionBy("i", "y").orderBy("chunk")
    held = outer.select("i", "y", "chunk", F.row_number().over(line).alias("r"), "first", "last")
    # Place of each chunk among those that hold the class.
    placed = every.select("i", "y", "chunk", F.count("last").over(line.rowsBetween(W.unboundedPreceding, -1)).alias("below"), F.col("last").isNotNull().alias("own"))
    steps = placed.withColumn("step", F.explode(F.array(*[F.lit(s) for s in [*range(-k, 0), *range(1, k + 1)]]))).withColumn(
        "r", F.when(F.col("step") < 0, F.col("below") + F.col("step") + 1).otherwise(F.col("below") + F.col("own").cast("int") + F.col("step")))
    met = steps.join(held.select("i", "y", "r", "first", "last"), ["i", "y", "r"], "left").groupBy("i", "y", "chunk").agg(
        F.sort_array(F.flatten(F.collect_list(F.when(F.col("step") < 0, F.col("last"))))).alias("before"),
        F.sort_array(F.flatten(F.collect_list(F.when(F.col("step") > 0, F.col("first"))))).alias("after"))
    return met
