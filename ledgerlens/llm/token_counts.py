"""Token counts by a two-tier lookup on the map side.

A text's tokens are those of its pre-tokens (:mod:`.units`), so a count is a sum of lengths.  Lengths come from two
tiers: a broadcast hash table of the corpus's frequent pre-tokens, then a cache in each Python worker
that is filled by encoding what the table lacks.  No pre-token is shuffled.

The table is chosen over all documents.  Each task keeps a Misra-Gries summary of its pre-tokens (whatever
takes more than 1 in ``SUMMARY`` of them is in it) and writes it as one row; summaries are merged where they are read,
level by level without an exchange, until few enough are left for the driver.  Which pre-tokens
are in the table decides about time only, never about a count.

Defined cases: null and empty texts have 0 tokens and 0 bytes; the mark U+2581 in a text counts as the space that the
model takes it for; rows of repeated or null ids are counted each; further columns are ignored.  A model whose pieces
cross the cuts, or that changes texts before its merges, encodes whole texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .units import MARK, Pieces, per_worker

LIMIT = 4096
#: Entries of a task's summary, and of the broadcast table.
SUMMARY = 1 << 14
#: Pre-tokens that a task counts before it thins them out, and that a worker keeps the lengths of.
HELD = 1 << 18
#: Summaries that the driver merges at most.
LAST = 64
#: Longer pre-tokens are rare and are not kept.
_LONGEST = 64

_SUMMARIES = "units array<string>, counts array<long>"


def _thin(counts: Counter, size: int) -> Counter:
    """Misra-Gries: the count of the first entry beyond ``size`` is taken from all."""
    if len(counts) <= size:
        return counts
    top = counts.most_common(size + 1)
    less = top[-1][1]
    return Counter({u: n - less for u, n in top[:-1] if n > less})


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[str]:
    for text in batch.column(column):
        text = text.as_py()
        yield text.replace(MARK, " ") if text and MARK in text else text


def _row(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([list(counts)], pa.list_(pa.string())), pa.array([list(counts.values())], pa.list_(pa.int64()))], ["units", "counts"])


def _summarise(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = per_worker("pieces:" + model, lambda: Pieces(model))
        counts: Counter = Counter()
        for batch in batches:
            for text in _texts(batch, 0):
                if text:
                    counts.update(u for u in pieces.units(text) if len(u) <= _LONGEST)
                    if len(counts) > HELD:
                        counts = _thin(counts, HELD // 2)
        yield _row(_thin(counts, SUMMARY))
    return run


def _merged(rows) -> Counter:
    counts: Counter = Counter()
    for units, numbers in rows:
        counts.update(dict(zip(units, numbers)))
        counts = _thin(counts, SUMMARY)
    return counts


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield _row(_merged((u.as_py(), n.as_py()) for b in batches for u, n in zip(b.column(0), b.column(1))))


def frequent(docs: DataFrame, model: str) -> list[str]:
    """The most frequent pre-tokens of all texts, at most ``SUMMARY``."""
    summaries = stage(docs.select("text").mapInArrow(_summarise(model), _SUMMARIES), "unit-summaries")
    left = summaries.count()
    while left > LAST:
        # A read task takes many small files, so each level leaves a fraction of the rows.
        summaries = stage(summaries.mapInArrow(_merge, _SUMMARIES), "unit-summaries")
        before, left = left, summaries.count()
        if left >= before:
            summaries, left = stage(summaries.coalesce(LAST).mapInArrow(_merge, _SUMMARIES), "unit-summaries"), LAST
    return list(_merged((r.units, r.counts) for r in summaries.toLocalIterator()))


class _Lengths(dict):
    """Lengths by pre-token: the frequent ones as given, others from the worker's cache or the model."""

    def __init__(self, table: dict[str, int], cache: dict[str, int], pieces: Pieces):
        super().__init__(table)
        self.cache, self.pieces = cache, pieces

    def __missing__(self, name: str) -> int:
        length = self.cache.get(name)
        if length is None:
            length = len(self.pieces.encode(name))
            if len(name) <= _LONGEST:
                if len(self.cache) >= HELD:
                    self.cache.clear()
                self.cache[name] = length
        return length


def _count(model: str, table, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = per_worker("pieces:" + model, lambda: Pieces(model))
        lengths = _Lengths(table.value, per_worker("lengths:" + model, dict), pieces)
        for batch in batches:
            tokens = pa.array([sum(map(lengths.__getitem__, pieces.units(t))) if t else 0 for t in _texts(batch, 1)], pa.int64())
            size = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), size, tokens, pc.greater(tokens, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])
    return run


def token_counts(docs: DataFrame, model: str, *, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row; ``model`` is a piece model's path on every node."""
    pieces = Pieces(model)
    table = {u: len(pieces.encode(u)) for u in frequent(docs, model)}
    shared = docs.sparkSession.sparkContext.broadcast(table)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _count(model, shared, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
