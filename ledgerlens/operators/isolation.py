"""Isolation forest as Spark jobs: trees are grown in parallel, one bounded group each.

Every tree sees at most ``sample_size`` rows, so the node table is bounded by
trees x 2 x sample_size rows whatever the size of the input.  It travels to the
executors inside the scoring function, and scoring is a map over Arrow batches.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.guards import finite_or_zero
from ..schema import KEY

EULER = 0.5772156649015329


def average_path(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search among n rows: the normaliser c(n)."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3.0)
    c = 2.0 * (np.log(safe - 1.0) + EULER) - 2.0 * (safe - 1.0) / safe
    return np.where(n > 2, c, np.where(n == 2, 1.0, 0.0))


def _grow(rows: np.ndarray, limit: int, rng: np.random.Generator) -> list[tuple]:
    """Nodes (id, feature, threshold, left, right, depth_value) of one tree; feature -1 is a leaf."""
    nodes: list[tuple] = []
    open_ = [(0, np.arange(len(rows)), 0)]
    next_id = 1
    while open_:
        node, members, depth = open_.pop()
        part = rows[members]
        low, high = part.min(axis=0), part.max(axis=0)
        varying = np.flatnonzero(high > low)
        if depth >= limit or len(members) <= 1 or len(varying) == 0:
            nodes.append((node, -1, 0.0, -1, -1, depth + float(average_path(len(members)))))
            continue
        feature = int(rng.choice(varying))
        cut = rng.uniform(low[feature], high[feature])
        goes_left = part[:, feature] <= cut
        left, right = next_id, next_id + 1
        next_id += 2
        nodes.append((node, feature, float(cut), left, right, 0.0))
        open_.append((left, members[goes_left], depth + 1))
        open_.append((right, members[~goes_left], depth + 1))
    return nodes


#: Rows that walk down a tree together: their arrays stay in the processor's cache.
_WALK_ROWS = 1 << 12


def _walkable(tree: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(feature, cut, child, length, depth) of a tree's nodes in order; a leaf is its own child, so all rows take ``depth`` steps."""
    feature, cut, left, right, length = (tree[c].to_numpy() for c in ("feature", "cut", "left", "right", "length"))
    inner, nodes = feature >= 0, np.arange(len(feature))
    child = np.where(inner[:, None], np.stack([left, right], axis=1), nodes[:, None]).astype(np.int64)
    depth, level = 0, np.zeros(1, np.int64)
    while len(level := level[inner[level]]):
        depth, level = depth + 1, child[level].ravel()
    return np.where(inner, feature, 0).astype(np.int64), cut, child.ravel(), length, depth


class IsolationForest:
    """Fitted forest: ``score`` is in (0, 1), higher means more anomalous."""

    def __init__(self, columns: list[str], nodes: pd.DataFrame, sample_size: int):
        self.columns = columns
        self.nodes = nodes
        self.sample_size = sample_size

    def score(self) -> Column:
        trees = [_walkable(t.sort_values("node")) for _, t in self.nodes.groupby("tree")]
        norm = float(average_path(self.sample_size)) or 1.0

        @F.pandas_udf("double")
        def anomaly(batch: pd.DataFrame) -> pd.Series:
            x = batch.to_numpy(dtype=float)
            total = np.zeros(len(x))
            for start in range(0, len(x), _WALK_ROWS):
                part = np.ascontiguousarray(x[start : start + _WALK_ROWS])
                flat, rows, sums = part.reshape(-1), np.arange(len(part)) * part.shape[1], total[start : start + _WALK_ROWS]
                for feature, cut, child, length, depth in trees:
                    at = np.zeros(len(part), np.int64)
                    for _ in range(depth):
                        at = child.take(2 * at + (flat.take(feature.take(at) + rows) > cut.take(at)))
                    sums += length.take(at)
            return pd.Series(np.power(2.0, -total / len(trees) / norm))

        return anomaly(F.struct(*[finite_or_zero(F.col(c)).alias(c) for c in self.columns]))


def fit_isolation_forest(
    df: DataFrame,
    columns: list[str],
    trees: int = 100,
    seed: int = 42,
    sample_size: int = 256,
    total: int | None = None,
) -> IsolationForest:
    """Each tree grows from ``sample_size`` rows, drawn from all rows by hash."""
    total = df.count() if total is None else total
    psi = min(sample_size, total)
    limit = max(1, math.ceil(math.log2(max(psi, 2))))
    features = [finite_or_zero(F.col(c)).alias(c) for c in columns]
    # A row is a candidate for a tree with twice the needed probability; the first psi stay.
    share = min(1.0, (2.0 * psi + 64.0) / max(total, 1))
    draw = F.pmod(F.xxhash64(F.lit(seed), "tree", KEY), F.lit(1 << 31)) / F.lit(float(1 << 31))
    draws = (
        df.select(KEY, *features)
        .withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
        .withColumn("u", draw)
        .where(F.col("u") < F.lit(share))
        .withColumn("r", F.row_number().over(W.partitionBy("tree").orderBy("u", KEY)))
        .where(F.col("r") <= psi)
    )

    def build(group: pd.DataFrame) -> pd.DataFrame:
        tree = int(group["tree"].iloc[0])
        rows = group.sort_values(["u", KEY])[columns].to_numpy(dtype=float)
        grown = _grow(rows, limit, np.random.default_rng([seed, tree]))
        out = pd.DataFrame(grown, columns=["node", "feature", "cut", "left", "right", "length"])
        out.insert(0, "tree", tree)
        return out

    # One group per tree is little data and much work, so it is not left to be merged by size.
    tasks = min(trees, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    nodes = draws.repartition(tasks, "tree").groupBy("tree").applyInPandas(
        build, "tree int, node int, feature int, cut double, left int, right int, length double"
    ).toPandas()  # at most trees x 2 x sample_size rows
    return IsolationForest(columns, nodes, psi)
