"""Exact quantiles (linear interpolation) of several columns at once.

The built-in exact ``percentile`` keeps every distinct value of a column in one
aggregation buffer, which is fine for a table of checked size and impossible
beyond it.  For larger tables the wanted order statistics are enclosed in
intervals.  A pass cuts all open intervals of all columns into a fixed number of
zones and counts rows, least and greatest value of each, so its cost doesn't
depend on how many quantiles are wanted; an interval becomes the zone that holds
its rank, until one value is left or so few rows that they are listed.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BUFFER_ROWS = 200_000
_BRACKET_ROWS = 20_000
#: Zones of a column in one pass, and rows of all columns that one pass lists.
_ZONES, _LISTED_ROWS = 4096, 200_000
#: Rows that a task sorts together.
_BLOCK_ROWS = 1 << 17


def exact_quantiles(
    df: DataFrame,
    values: dict[str, Column],
    probabilities: Sequence[float],
    buffer_rows: int = _BUFFER_ROWS,
    bracket_rows: int = _BRACKET_ROWS,
) -> dict[str, list[float | None]]:
    """Quantiles per named value; nulls are ignored, an empty column gives ``None``."""
    probabilities = list(probabilities)
    narrow = df.select(*[v.cast("double").alias(name) for name, v in values.items()])
    spans = _spans(narrow)
    counts = {name: spans[name][0] + spans[name][1] for name in values}
    if max(counts.values(), default=0) <= buffer_rows:
        row = narrow.agg(*[F.percentile(n, F.array(*map(F.lit, probabilities))).alias(n) for n in values]).first()
        return {n: list(row[n]) if row[n] is not None else [None] * len(probabilities) for n in values}

    places = {name: [(counts[name] - 1) * p for p in probabilities] if counts[name] else [] for name in values}
    wanted = {name: sorted({r for at in ats for r in (math.floor(at), math.ceil(at))}) for name, ats in places.items()}
    found = order_statistics(narrow, wanted, bracket_rows, spans)
    result = {}
    for name in values:
        result[name] = [None] * len(probabilities)
        for j, at in enumerate(places[name]):
            lo, hi = found[name][math.floor(at)][0], found[name][math.ceil(at)][0]
            result[name][j] = lo if lo == hi else lo + (hi - lo) * (at - math.floor(at))
    return result


def order_statistics(
    narrow: DataFrame, ranks: dict[str, Sequence[int]], bracket_rows: int = _BRACKET_ROWS, spans: dict[str, tuple] | None = None,
) -> dict[str, dict[int, tuple[float, int, int]]]:
    """Per column of doubles and 0-based rank: its value, the rows below that value and the rows with it; NaN comes last."""
    spans = spans or _spans(narrow)
    columns = list(ranks)
    found: dict[str, dict[int, tuple[float, int, int]]] = {c: {} for c in columns}
    # Open intervals per column in order: (low, high, rows below, rows inside, ranks).
    open_: dict[int, list[tuple]] = {}
    for i, c in enumerate(columns):
        n, nans, low, high = spans[c]
        found[c].update({r: (math.nan, n, nans) for r in ranks[c] if r >= n})
        inside = [r for r in ranks[c] if r < n]
        if inside:
            _settle(found[c], open_.setdefault(i, []), (low, high, 0, n, inside))
    while any(open_.values()):
        groups = sum(map(len, open_.values()))
        listed = min(bracket_rows, max(1, _LISTED_ROWS // groups))
        cuts = {i: _cuts(parts, listed) for i, parts in open_.items() if parts}
        zones = _zones(narrow, columns, cuts)
        for i, parts in list(open_.items()):
            open_[i] = []
            met = iter(sorted(zones.get(i, []), key=lambda z: z[1]))
            zone = next(met, None)
            for low, high, below, _, wanted in parts:
                while zone is not None and zone[1] < low:
                    zone = next(met, None)
                while zone is not None and zone[1] <= high:
                    n, least, most = zone
                    inside = [r for r in wanted if below <= r < below + n]
                    if inside:
                        _settle(found[columns[i]], open_[i], (least, most, below, n, inside))
                    below += n
                    zone = next(met, None)
    return found


def _settle(found: dict, open_: list[tuple], part: tuple) -> None:
    low, high, below, n, wanted = part
    if low == high:
        found.update({r: (low, below, n) for r in wanted})
    else:
        open_.append(part)


def _number(x: float) -> int:
    """Whole number in the order of the doubles."""
    bits = struct.unpack("<q", struct.pack("<d", x))[0]
    return bits if bits >= 0 else -(1 << 63) - bits


def _double(number: int) -> float:
    return struct.unpack("<d", struct.pack("<q", number if number >= 0 else -(1 << 63) - number))[0]


def _cuts(parts: list[tuple], listed: int) -> list[tuple[float, float, list[float] | None]]:
    """(low, high, upper ends of the zones) of each interval; ``None`` where its values are listed.

    Half of the ends are even in value and half in the doubles between, so outliers don't slow it down.
    """
    each = max(4, _ZONES // len(parts) // 2)
    out = []
    for low, high, _, n, _ in parts:
        if n <= listed:
            out.append((low, high, None))
            continue
        a, z = _number(low), _number(high)
        ends = {low, high, *(_double(a + (z - a) * j // each) for j in range(1, each))}
        if math.isfinite(high - low):
            ends.update(x for x in np.linspace(low, high, each + 1).tolist() if low < x < high)
        out.append((low, high, sorted(ends)))
    return out


def _sorted_blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[list[np.ndarray]]:
    """Sorted values of each column, a bounded number of rows at a time; nulls are left out, a negative zero is zero."""
    held: list[pa.RecordBatch] = []

    def block() -> list[np.ndarray]:
        table = pa.Table.from_batches(held)
        return [np.sort(table.column(i).drop_null().to_numpy() + 0.0) for i in range(width)]

    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= _BLOCK_ROWS:
            yield block()
            held = []
    if held:
        yield block()


#: Columns of one aggregate, which so stays compiled.
_SPAN_COLUMNS = 16


def _spans(narrow: DataFrame) -> dict[str, tuple[int, int, float, float]]:
    """(rows, rows that are NaN, least, greatest) per column of doubles; NaN counts among the second only."""
    out = {}
    for start in range(0, len(narrow.columns), _SPAN_COLUMNS):
        names = narrow.columns[start : start + _SPAN_COLUMNS]
        cells = []
        for name in names:
            value, missing = F.col(f"`{name}`"), F.isnan(f"`{name}`")
            number = F.when(~missing, value)
            cells += [F.count(number), F.count(F.when(missing, 1)), F.min(number), F.max(number)]
        row = narrow.agg(*[c.alias(f"c{i}") for i, c in enumerate(cells)]).first()
        for i, name in enumerate(names):
            n, nans, low, high = row[4 * i : 4 * i + 4]
            # A negative zero is zero.
            out[name] = (n, nans, low + 0.0, high + 0.0) if n else (0, nans, math.inf, -math.inf)
    return out


def _zones(narrow: DataFrame, columns: list[str], cuts: dict[int, list[tuple]]) -> dict[int, list[tuple[int, float, float]]]:
    """(rows, least, greatest) of the zones that hold rows, per column; a listed interval has one zone a value."""
    used = sorted(cuts)
    plans = []
    for i in used:
        fixed = [(low, ends) for low, _, ends in cuts[i] if ends]
        ends = np.array([e for _, own in fixed for e in own])
        first = np.cumsum([0, *(len(own) for _, own in fixed)])[:-1].astype(np.int64)
        plans.append((i, ends, first, np.array([low for low, _ in fixed]), [(low, high) for low, high, own in cuts[i] if own is None]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = [np.zeros(len(ends), np.int64) for _, ends, *_ in plans]
        low, high = [np.full(len(x), np.inf) for x in n], [np.full(len(x), -np.inf) for x in n]
        lists: list[list[np.ndarray]] = [[] for _ in plans]
        for block in _sorted_blocks(batches, len(plans)):
            for c, (v, (_, ends, first, lows, spans)) in enumerate(zip(block, plans)):
                if len(ends):
                    stop = np.searchsorted(v, ends, "right")
                    start = np.concatenate([[0], stop[:-1]])
                    start[first] = np.searchsorted(v, lows, "left")
                    full = np.flatnonzero(stop > start)
                    n[c][full] += (stop - start)[full]
                    low[c][full] = np.minimum(low[c][full], v[start[full]])
                    high[c][full] = np.maximum(high[c][full], v[stop[full] - 1])
                for a, z in spans:
                    lists[c].append(v[np.searchsorted(v, a, "left"):np.searchsorted(v, z, "right")])
        for c, (i, *_) in enumerate(plans):
            full = np.flatnonzero(n[c])
            values, counts = np.unique(np.concatenate([*lists[c], np.zeros(0)]), return_counts=True)
            rows = [np.full(len(full) + len(values), i, np.int32), np.concatenate([full, np.full(len(values), -1)]),
                    np.concatenate([np.full(len(full), 0.0), values]), np.concatenate([n[c][full], counts]),
                    np.concatenate([low[c][full], values]), np.concatenate([high[c][full], values])]
            yield pa.RecordBatch.from_arrays([*map(pa.array, rows)], ["i", "zone", "at", "n", "low", "high"])

    parts = narrow.select(*[F.col(columns[i]) for i in used]).mapInArrow(run, "i int, zone long, at double, n long, low double, high double")
    out: dict[int, list[tuple[int, float, float]]] = {}
    # At most _ZONES rows a column, and the listed rows.
    for i, n, low, high in parts.groupBy("i", "zone", "at").agg(F.sum("n"), F.min("low"), F.max("high")).drop("zone", "at").collect():
        out.setdefault(i, []).append((n, low, high))
    return out


def bin_counts(df: DataFrame, columns: list[str], edges: list[list[float]], label: str) -> DataFrame:
    """(i, bin, y, n): rows per column number, number of edges not above the value, and label; nulls are left out."""
    kind = df.schema[label].dataType
    marks = [np.sort(np.array(e, float)) for e in edges]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes = batch.column(0).dictionary_encode()
            y = classes.indices.fill_null(len(classes.dictionary)).to_numpy(zero_copy_only=False)
            names = pa.concat_arrays([classes.dictionary, pa.nulls(1, classes.dictionary.type)])
            wide = len(names)
            for i, mark in enumerate(marks):
                column = batch.column(i + 1)
                there = column.is_valid().to_numpy(zero_copy_only=False)
                bins = np.searchsorted(mark, column.drop_null().to_numpy(zero_copy_only=False), "right")
                n = np.bincount(bins * wide + y[there], minlength=(len(mark) + 1) * wide)
                full = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(full), i, np.int32)), pa.array((full // wide).astype(np.int32)), names.take(pa.array(full % wide)), pa.array(n[full])],
                    ["i", "bin", "y", "n"])

    rows = df.select(F.col(label).alias("y"), *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    parts = rows.mapInArrow(run, f"i int, bin int, y {kind.simpleString()}, n long")
    return parts.groupBy("i", "bin", "y").agg(F.sum("n").alias("n"))


def unpivoted(df: DataFrame, values: list[Column], *keep: str) -> DataFrame:
    """Rows (i, v) per value and row, nulls left out.

    What follows works on ``v`` with the literals of position ``i``, so its code
    stays small however many columns there are.
    """
    cells = F.array(*[F.struct(F.lit(i).alias("i"), v.alias("v")) for i, v in enumerate(values)])
    return df.select(*keep, F.explode(cells).alias("c")).select(*keep, "c.i", "c.v").where("v is not null")
