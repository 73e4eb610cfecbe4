"""Exact removal of repeated substrings: every byte covered by a ``span``-byte string that also starts earlier.

Texts are UTF-8 bytes; earlier means in a document with a smaller id, or before in the same document.

1. A document whose whole text occurs under a smaller id is repeated as a whole.
2. Each window of ``span`` bytes is named by its minimiser: the k-byte string in it with the smallest
   hash, leftmost on ties.  Equal windows have equal minimisers, so windows are compared only within
   a minimiser's bucket.  Consecutive windows with the same minimiser are one stretch.
3. Stretches that are equal as a whole are settled by hash: all but the first occurrence are repeated.
   This happens within a task before anything is shuffled, and again in the bucket.
4. What is left are minimisers with several different stretches.  Their bytes are fetched, cut down to
   the windows whose hash occurs again, and equal strings are put together.  A suffix array over
   these strings, built by linear grouping (``suffix_order``), brings equal windows together; neighbours
   in the order are compared byte by byte, and the first start of each run of equal windows stays.
5. Repeated windows meet their documents, covered bytes are marked, and what remains is joined.

Buckets are byte strings of fixed-size entries, not rows, and their number follows the size of the
input.  Defined cases: a null text is empty; texts shorter than ``span`` stay whole; a null id is later than
all others; different texts with the same id (or without one) are documents of their own, in the order of their
bytes, with a row each; rows repeated with the same id and text are returned once; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .suffix_order import suffix_array
from .text import _BYTE, _powers, mix, slices

SPAN, MINIMISER = 100, 24
#: Bytes of text per bucket.
BUCKET_BYTES = 8 << 20
_PLACE = np.uint64((1 << 28) - 1)
_ENTRY = np.dtype([("mini", "<u8"), ("whole", "<u8"), ("doc", "<i8"), ("at", "<i4"), ("n", "<i4")])
#: A null id sorts after all others.
LAST = np.iinfo(np.int64).max


def _prefix(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums from which the hash of any byte string follows, and the factors that make it free of its place."""
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], dtype=np.uint64, out=total[1:])
    return total, down


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` consecutive values, by running minima of blocks from both sides."""
    n = len(values) - width + 1
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    grid = padded.reshape(blocks, width)
    left = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    right = np.minimum.accumulate(grid, axis=1).ravel()
    return np.minimum(left[:n], right[width - 1 : width - 1 + n])


def stretches(data: np.ndarray, bounds: np.ndarray, span: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start in text, windows, minimiser, hash of the whole) of each stretch."""
    none = np.zeros(0, np.int64)
    if len(data) < span:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    total, down = _prefix(data)
    grams = mix((total[k:] - total[:-k]) * down[: len(data) - k + 1])
    keyed = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    best = (_sliding_min(keyed, span - k + 1) & _PLACE).astype(np.int64)
    last = np.repeat(bounds[1:] - span, np.diff(bounds))[: len(best)]
    valid = np.arange(len(best)) <= last
    first = valid.copy()
    first[1:] &= ~(valid[:-1] & (best[1:] == best[:-1]))
    edges = bounds[(bounds > 0) & (bounds < len(best))]
    first[edges] = valid[edges]
    start = np.flatnonzero(first)
    ends = valid.copy()
    ends[:-1] &= ~(valid[1:] & ~first[1:])
    n = np.flatnonzero(ends) - start + 1
    mini = best[start]
    whole = mix((total[start + n + span - 1] - total[start]) * down[start] + ((mini - start) * 1024 + n).astype(np.uint64))
    text = np.searchsorted(bounds, start, "right") - 1
    return text, start - bounds[text], n, grams[mini], whole


def _settle(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first of each equal stretch, the repeated others, whether a first's minimiser has other stretches), in order."""
    entries = entries[np.lexsort((entries["at"], entries["doc"], entries["whole"], entries["mini"]))]
    same_mini = np.zeros(len(entries), bool)
    same_mini[1:] = entries["mini"][1:] == entries["mini"][:-1]
    again = same_mini.copy()
    again[1:] &= entries["whole"][1:] == entries["whole"][:-1]
    firsts = entries[~again]
    mixed = np.zeros(len(firsts), bool)
    equal = firsts["mini"][1:] == firsts["mini"][:-1]
    mixed[1:] |= equal
    mixed[:-1] |= equal
    return firsts, entries[again], mixed


def _stretch_batches(span: int, k: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def deal() -> pa.RecordBatch:
            firsts, again, _ = _settle(np.concatenate(held))
            firsts = firsts[np.argsort(firsts["mini"] % np.uint64(buckets), kind="stable")]
            bucket = (firsts["mini"] % np.uint64(buckets)).astype(np.int64)
            at = np.searchsorted(bucket, np.arange(buckets + 1))
            used = np.flatnonzero(np.diff(at))
            blobs = [firsts[at[b] : at[b + 1]].tobytes() for b in used]
            # Repeats that are settled here go along with any bucket.
            number = used.tolist() + ([int(again["doc"][0] % buckets)] if len(again) else [])
            blobs += [again.tobytes()] if len(again) else []
            return pa.RecordBatch.from_arrays(
                [pa.array(number, pa.int32()), pa.array([i < len(used) for i in range(len(blobs))], pa.bool_()), pa.array(blobs, pa.binary())],
                ["bucket", "open", "entries"])

        for batch in batches:
            ids = batch.column(0).fill_null(LAST).to_numpy(zero_copy_only=False)
            for row, _, data, bounds in slices(batch.column(1)):
                text, at, n, mini, whole = stretches(data, bounds, span, k)
                made = np.zeros(len(text), _ENTRY)
                made["mini"], made["whole"], made["doc"], made["at"], made["n"] = mini, whole, ids[text + row], at, n
                held.append(made)
                size += len(made)
                if size > 1_000_000:
                    yield deal()
                    held, size = [], 0
        if size:
            yield deal()
    return run


def _settle_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition holds whole buckets: (doc_id, needed, mini, at, n) of repeats, and of firsts that must be compared."""
    held, repeats = [], []
    for batch in batches:
        for is_open, blob in zip(batch.column("open").to_pylist(), batch.column("entries")):
            (held if is_open else repeats).append(np.frombuffer(blob.as_buffer(), _ENTRY))
    found = [(False, r) for r in repeats]
    if held:
        firsts, again, mixed = _settle(np.concatenate(held))
        held.clear()
        found += [(False, again), (True, firsts[mixed])]
    for needed, rows in found:
        for a in range(0, len(rows), 200_000):
            part = rows[a : a + 200_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part["doc"]), pa.array(np.full(len(part), needed)), pa.array(part["mini"].view(np.int64)),
                 pa.array(part["at"]), pa.array(part["n"])], ["doc_id", "needed", "mini", "at", "n"])


def _fetch_batches(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            minis, ids, starts, strings = [], [], [], []
            for doc_id, body, wanted in zip(batch.column("doc_id").to_pylist(), batch.column("body"), batch.column("wanted")):
                data = body.as_buffer()
                for w in wanted.as_py():
                    minis.append(w["mini"])
                    ids.append(doc_id)
                    starts.append(w["at"])
                    strings.append(data[w["at"] : w["at"] + w["n"] + span - 1].to_pybytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(minis, pa.int64()), pa.array(ids, pa.int64()), pa.array(starts, pa.int32()), pa.array(strings, pa.binary())],
                ["mini", "doc_id", "at", "bytes"])
    return run


def repeated_windows(strings: list[bytes], docs: list[int], starts: list[int], span: int) -> list[tuple[int, int, int]]:
    """(doc, start, windows) of the windows of the given stretches that also start earlier in one of them.

    The stretches of one minimiser must all be here.
    """
    if not strings:
        return []
    lengths = np.array([len(s) for s in strings])
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    total, down = _prefix(np.frombuffer(b"".join(strings), np.uint8))
    n = lengths - span + 1
    owner = np.repeat(np.arange(len(strings)), n)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    at = bounds[owner] + offset
    names = mix((total[at + span] - total[at]) * down[at])
    _, where, many = np.unique(names, return_inverse=True, return_counts=True)
    twice = many[where] > 1
    if not twice.any():
        return []
    owner, offset = owner[twice], offset[twice]
    used, first = np.unique(owner, return_index=True)
    low, high = offset[first], offset[np.append(first[1:], len(offset)) - 1]
    # The part of each stretch from its first to its last such window; equal parts are one string.
    parts: dict[bytes, list[tuple[int, int]]] = {}
    for i, a, b in zip(used.tolist(), low.tolist(), high.tolist()):
        parts.setdefault(strings[i][a : b + span], []).append((docs[i], starts[i] + a))
    found, distinct = [], sorted(parts)
    earliest = []
    for part in distinct:
        places = sorted(parts[part])
        earliest.append(places[0])
        found += [(d, s, len(part) - span + 1) for d, s in places[1:]]
    # Bytes are symbols from 1; 0 ends each string.
    symbols: list[int] = []
    begin = []
    for part in distinct:
        begin.append(len(symbols))
        symbols += [b + 1 for b in part]
        symbols.append(0)
    order = np.array(suffix_array(symbols), np.int64)
    begin = np.array(begin)
    whole = np.searchsorted(begin, order, "right") - 1
    shift = order - begin[whole]
    size = np.array([len(p) for p in distinct])
    full = shift + span <= size[whole]
    order, whole, shift = order[full], whole[full], shift[full]
    flat = np.array(symbols, np.int16)
    group = np.zeros(len(order), np.int64)
    for a in range(1, len(order), 20_000):
        b = min(a + 20_000, len(order))
        reach = np.arange(span)[None, :]
        group[a:b] = (flat[order[a:b, None] + reach] != flat[order[a - 1 : b - 1, None] + reach]).any(axis=1)
    group = np.cumsum(group)
    doc = np.array([e[0] for e in earliest], np.int64)[whole]
    start = np.array([e[1] for e in earliest], np.int64)[whole] + shift
    ranked = np.lexsort((start, doc, group))
    lead = np.ones(len(ranked), bool)
    lead[1:] = group[ranked][1:] != group[ranked][:-1]
    for i in ranked[~lead].tolist():
        found.append((int(doc[i]), int(start[i]), 1))
    return found


def _compare_batches(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [batch for batch in batches if batch.num_rows]
        if not rows:
            return
        table = pa.Table.from_batches(rows)
        mini = table.column("mini").to_numpy()
        order = np.argsort(mini, kind="stable")
        docs, starts = table.column("doc_id").to_pylist(), table.column("at").to_pylist()
        strings = table.column("bytes").to_pylist()
        del table, rows
        found: list[tuple[int, int, int]] = []
        cuts = np.append(np.flatnonzero(np.diff(mini[order])) + 1, len(order))
        a = 0
        pending: list[int] = []
        # Several minimisers share a suffix array, up to about a megabyte of bytes.
        size = 0
        for b in cuts.tolist():
            pending += order[a:b].tolist()
            size += sum(len(strings[i]) for i in order[a:b].tolist())
            a = b
            if size > 1 << 20 or b == len(order):
                found += repeated_windows([strings[i] for i in pending], [docs[i] for i in pending], [starts[i] for i in pending], span)
                pending, size = [], 0
        for a in range(0, len(found), 200_000):
            part = found[a : a + 200_000]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), (pa.int64(), pa.int32(), pa.int32()))], ["doc_id", "at", "n"])
    return run


def _remove_batches(span: int, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(6)]
            for doc_id, body, windows, copied in zip(batch.column("doc_id").to_pylist(), batch.column("body"), batch.column("windows"), batch.column("copied").to_pylist()):
                data = np.frombuffer(body.as_buffer(), np.uint8) if body.is_valid and len(body.as_buffer()) else np.zeros(0, np.uint8)
                change = np.zeros(len(data) + 1, np.int32)
                if copied and len(data) >= span:
                    change[0], change[-1] = 1, -1
                elif windows.is_valid and len(windows.values):
                    at = windows.values.field("at").to_numpy()
                    np.add.at(change, at, 1)
                    np.add.at(change, at + windows.values.field("n").to_numpy() + span - 1, -1)
                gone = np.cumsum(change[:-1]) > 0
                runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
                kept = data[~gone].tobytes()
                for c, v in zip(columns, (None if doc_id == LAST else doc_id, len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), kept if keep_text else None)):
                    c.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
    return run


def _numbered(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``texts`` (doc_id, body) with numbers in the order of id and text as doc_id, and (number, id).

    Rows are sorted by range and written once; a number is the place in the written partition, so none is ranked in one task.
    """
    ordered = texts.repartitionByRange("doc_id", "body").sortWithinPartitions("doc_id", "body")
    ordered = stage(ordered.withColumn("number", F.monotonically_increasing_id()).withColumnRenamed("doc_id", "id"), "numbered")
    return ordered.select(F.col("number").alias("doc_id"), "body"), ordered.select("number", "id")


def dedup(docs: DataFrame, *, span: int = SPAN, k: int = MINIMISER, bucket_bytes: int = BUCKET_BYTES, keep_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) for each document."""
    body = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(int(LAST))).alias("doc_id"), body.alias("body"))
    # Whole copies: sizes and digests only.
    named = stage(texts.select("doc_id", F.length("body").alias("size"), F.sha2("body", 256).alias("digest")), "digests")
    ids = named.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id")
    numbers = None
    if not ids.isEmpty():
        # Each distinct (id, text) gets a number of its own that keeps their order.
        texts, numbers = _numbered(texts.distinct())
        named = stage(texts.select("doc_id", F.length("body").alias("size"), F.sha2("body", 256).alias("digest")), "digests")
    many = named.where(F.col("size") >= span).groupBy("digest").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    many = stage(many.select("digest", "low"), "many")
    copies = stage(named.join(many, "digest").where("doc_id > low").select("doc_id", F.lit(True).alias("copied")), "copies")
    buckets = int(max(1, -(-(named.agg(F.sum("size")).first()[0] or 0) // bucket_bytes)))

    firsts = texts.join(copies, "doc_id", "left_anti")
    dealt = firsts.mapInArrow(_stretch_batches(span, k, buckets), "bucket int, open boolean, entries binary")
    settled = stage(dealt.repartition(buckets, "bucket").mapInArrow(
        _settle_batches, "doc_id long, needed boolean, mini long, at int, n int"), "settled")
    # Both reads of the texts by id use one shuffle.
    by_id = texts.repartition("doc_id")
    wanted = settled.where("needed").groupBy("doc_id").agg(F.collect_list(F.struct("mini", "at", "n")).alias("wanted"))
    fetched = by_id.join(wanted, "doc_id").select("doc_id", "body", "wanted").mapInArrow(
        _fetch_batches(span), "mini long, doc_id long, at int, bytes binary")
    compared = fetched.repartition(max(buckets, 12), "mini").mapInArrow(_compare_batches(span), "doc_id long, at int, n int")
    windows = stage(settled.where("not needed").select("doc_id", "at", "n").unionByName(compared), "windows")
    windows = windows.groupBy("doc_id").agg(F.collect_list(F.struct("at", "n")).alias("windows"))
    done = by_id.join(windows, "doc_id", "left").join(copies, "doc_id", "left").select("doc_id", "body", "windows", F.coalesce("copied", F.lit(False)).alias("copied"))
    result = done.mapInArrow(_remove_batches(span, keep_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    if numbers is not None:
        known = numbers.select(F.col("number").alias("doc_id"), F.when(F.col("id") != int(LAST), F.col("id")).alias("id"))
        result = result.join(known, "doc_id").select(F.col("id").alias("doc_id"), *[c for c in result.columns if c != "doc_id"])
    return result if keep_text else result.drop("kept")
