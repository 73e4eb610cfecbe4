"""K-means whose rows stay in a written table.

``pyspark.ml``'s KMeans keeps each row in memory as an object of some 120 bytes, which tasks read back from the
cache or, beyond it, from disk. It fits tables of a checked size. For larger ones the rows are written once as blocks
of numbers, and each pass reads the blocks: candidates for centres are drawn from all rows (k-means||), then all rows
move the centres. A task returns sums per centre. Coordinates are rounded to multiples of 2**-20, so sums are exact
and the same rows give the same centres on any cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import KEY
from ..session import setting, stage

#: Rows that ``pyspark.ml`` may keep in memory.
_CACHED_ROWS = 1_000_000
_BLOCK_BYTES = 1 << 18
#: Blocks that a Python worker holds.
_BLOCKS = 64
#: Rows whose distances to all centres stay in a processor's cache.
_CHUNK_ROWS = 512
_GRID = 2.0**20
#: Far above the relative rounding of a distance.
_ROUNDING = 1e-12
_STEPS, _ITERATIONS, _TOLERANCE = 2, 10, 1e-4


def fit_centres(
    rows: DataFrame, values: dict[str, Column], k: int, seed: int, total: int, cached_rows: int = _CACHED_ROWS
) -> np.ndarray:
    """At most ``k`` centres (centre x value) of the rows' values; nulls are not allowed."""
    if total <= cached_rows:
        # Every iteration reads the values again, so they are written once.
        pool = stage(rows.select(*[v.alias(c) for c, v in values.items()]), "cluster-pool")
        ready = VectorAssembler(inputCols=list(values), outputCol="_z").transform(pool)
        return np.array(KMeans(k=k, seed=seed, featuresCol="_z", maxIter=_ITERATIONS).fit(ready).clusterCenters())
    with setting(rows.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch", str(_BLOCK_BYTES // 8)):
        blocks = stage(_blocks(rows, values, seed), "cluster-blocks")
    with setting(rows.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch", str(_BLOCKS)):
        return _moved(blocks, _first_centres(blocks, len(values), k, seed))


def nearest_centre(values: list[Column], centres: np.ndarray) -> Column:
    """Number of the nearest centre, the smaller of equal ones; it depends on the row alone, not on the rows beside it."""

    @F.pandas_udf("int")
    def nearest(*columns: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(dtype=float) for c in columns])
        return pd.Series(_nearest_exactly(x, centres).astype(np.int32))

    return nearest(*values)


def _chunks(x: np.ndarray, centres: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(start, rows, products) of some rows at a time; a product is the squared distance less the row's own square, up to rounding."""
    turned, squares = -2 * centres.T, (centres**2).sum(axis=1)
    for start in range(0, len(x), _CHUNK_ROWS):
        part = x[start : start + _CHUNK_ROWS]
        yield start, part, part @ turned + squares


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Number of each row's nearest centre; which of almost equal ones may depend on the rows beside it."""
    return np.concatenate([np.zeros(0, np.int64), *(products.argmin(axis=1) for _, _, products in _chunks(x, centres))])


def _nearest_exactly(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Number of each row's nearest centre by differences, the smaller of equal ones."""
    at, squares = np.empty(len(x), np.int64), (centres**2).sum(axis=1)
    for start, part, products in _chunks(x, centres):
        near = products.argmin(axis=1)
        most = products[np.arange(len(part)), near] + _ROUNDING * (squares[near] + 2 * (part**2).sum(axis=1))
        # Products only settle rows with one centre within their rounding.
        unsure = np.flatnonzero(((products - _ROUNDING * squares) <= most[:, None]).sum(axis=1) != 1)
        if len(unsure):
            distance = np.zeros((len(unsure), len(centres)))
            for j in range(x.shape[1]):
                distance += (part[unsure, j : j + 1] - centres[:, j]) ** 2
            near[unsure] = distance.argmin(axis=1)
        at[start : start + len(part)] = near
    return at


def _blocks(rows: DataFrame, values: dict[str, Column], seed: int) -> DataFrame:
    """Blocks (u, x): a number for draws in [0, 1) for each row, and its coordinates."""
    # Copies have one hash; their place in the block tells them apart.
    source = rows.select(F.xxhash64(F.lit(seed), KEY, *values.values()).alias("h"), *[v.alias(c) for c, v in values.items()])
    size = max(1, _BLOCK_BYTES // 8 // len(values))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), size):
                part = batch.slice(start, size)
                u = _draws(part.column(0).to_numpy())
                x = np.column_stack([c.to_numpy() for c in part.columns[1:]])
                cells = [u.tobytes(), (np.rint(x * _GRID) / _GRID).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in cells], ["u", "x"])

    return source.mapInArrow(run, "u binary, x binary")


def _draws(h: np.ndarray) -> np.ndarray:
    copy = np.zeros(len(h), np.uint64)
    ordered = np.sort(h)
    if (ordered[1:] == ordered[:-1]).any():
        order = np.argsort(h, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        copy[order] = np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))
    return ((h.view(np.uint64) + copy * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)) / 2.0**53


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of each block as numbers."""
    for batch in batches:
        for row in zip(*batch.columns):
            yield [np.frombuffer(cell.as_buffer(), float) for cell in row]


def _drawn(blocks: DataFrame, width: int, n: int, step: int, centres: np.ndarray | None) -> np.ndarray:
    """``n`` rows drawn from all by their squared distance to the centres; all are alike without centres."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, points = np.zeros(0), np.zeros((0, width))
        for u, x in _each(batches):
            x = x.reshape(-1, width)
            weight = np.ones(len(x)) if centres is None else ((x - centres[_nearest(x, centres)]) ** 2).sum(axis=1)
            # The least exponential numbers at these rates are a draw without repeats; steps turn the same numbers.
            turned = (u + step * 0.6180339887498949) % 1.0
            with np.errstate(divide="ignore"):
                late = -np.log1p(-turned) / weight
            there = np.flatnonzero(weight > 0)
            late, found = np.concatenate([best, late[there]]), np.concatenate([points, x[there]])
            keep = np.argsort(late, kind="stable")[:n]
            best, points = late[keep], found[keep]
        yield pa.RecordBatch.from_arrays([pa.array(best), pa.array([p.tobytes() for p in points], pa.binary())], ["late", "point"])

    drawn = blocks.select("u", "x").mapInArrow(run, "late double, point binary").orderBy("late", "point").limit(n).collect()
    return np.array([np.frombuffer(r["point"], float) for r in drawn]).reshape(-1, width)


def _sums(blocks: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows nearest to each centre, and the sums of their coordinates."""
    k, width = centres.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((width + 1, k))
        for (x,) in _each(batches):
            x = x.reshape(-1, width)
            at = _nearest(x, centres)
            sums[0] += np.bincount(at, minlength=k)
            for j in range(width):
                sums[j + 1] += np.bincount(at, x[:, j], k)
        full = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), *[pa.array(s[full]) for s in sums]], ["c", "n", *[f"s{j}" for j in range(width)]])

    names = ["n", *[f"s{j}" for j in range(width)]]
    parts = blocks.select("x").mapInArrow(run, ", ".join(["c int", *[f"{s} double" for s in names]]))
    out = np.zeros((width + 1, k))
    for row in parts.groupBy("c").agg(*[F.sum(s) for s in names]).collect():  # one row a centre
        out[:, row[0]] = row[1:]
    return out[0], out[1:].T


def _first_centres(blocks: DataFrame, width: int, k: int, seed: int) -> np.ndarray:
    """k-means||: one row, then in each step 2k rows by their distance to those before; ``k`` of them by their rows (k-means++)."""
    found = _drawn(blocks, width, 1, 0, None)
    for step in range(1, _STEPS + 1):
        found = np.unique(np.concatenate([found, _drawn(blocks, width, 2 * k, step, found)]), axis=0)
    if len(found) <= k:
        return found
    weight, rng = _sums(blocks, found)[0], np.random.default_rng(seed)
    chosen = [int(rng.choice(len(found), p=weight / weight.sum()))]
    gap = ((found - found[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < k and (weight * gap).any():
        chosen.append(int(rng.choice(len(found), p=weight * gap / (weight * gap).sum())))
        gap = np.minimum(gap, ((found - found[chosen[-1]]) ** 2).sum(axis=1))
    centres = found[chosen]
    for _ in range(30):
        at = _nearest(found, centres)
        rows = np.bincount(at, weight, len(centres))
        sums = np.stack([np.bincount(at, weight * found[:, j], len(centres)) for j in range(width)], axis=1)
        moved = np.where(rows[:, None] > 0, sums / np.maximum(rows, 1)[:, None], centres)
        if (moved == centres).all():
            break
        centres = moved
    return centres


def _moved(blocks: DataFrame, centres: np.ndarray) -> np.ndarray:
    """Centres moved to the means of their rows until all stay within the tolerance; a centre without rows stays."""
    for _ in range(_ITERATIONS):
        rows, sums = _sums(blocks, centres)
        moved = np.where(rows[:, None] > 0, sums / np.maximum(rows, 1)[:, None], centres)
        still = (((moved - centres) ** 2).sum(axis=1) <= _TOLERANCE**2).all()
        centres = moved
        if still:
            break
    return centres
