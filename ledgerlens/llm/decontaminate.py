"""Benchmark decontamination with spaced seeds.

A seed is a fixed mask over word positions; words under its gaps may differ.  The masks used here
are lossless: whatever three words of thirteen are replaced, at least one mask still fits somewhere
in the thirteen.  Hashes under the masks are made for benchmark items and for documents, joined,
and each hit is verified by counting equal words in every 13-word window around it.

Words are runs of ASCII letters, digits and non-ASCII bytes, lower-cased (ASCII and Latin-1 letters), so case and
punctuation don't hide a passage.  A document is contaminated if some window of ``window`` words equals
an item's window but for at most ``substitutions`` words.  An item shorter than a window must occur whole.

Only documents' hashes that may occur in the benchmark are shuffled: a bit map of fixed size, built
from the benchmark's hashes, is read by every task.  It only saves work; the join decides.

Defined cases: null and empty texts are clean; null items hold nothing; items of fewer words than a
seed spans are matched through a hash of all their words; repeated ids are one document or item;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .rows import row_key, without
from .text import LOWER, PUNCT, combine, hash_spans, slices, word_spans

WINDOW, SUBSTITUTIONS = 13, 3
#: Each of the 286 ways to replace 3 of 13 words leaves one of these masks intact somewhere (tested).
SEEDS = ((0, 1, 2, 5, 7), (0, 2, 6, 7, 8), (0, 1, 5, 6, 8))
SPAN = 9
#: Size of the bit map in bits; documents' hashes outside it can't occur in the benchmark.
MAP_BITS = 1 << 23
SALTS = 16


def _lowered(data: np.ndarray) -> np.ndarray:
    """A-Z and the capital letters of Latin-1 in UTF-8 (C3 80 to C3 9E, but for C3 97) in lower case."""
    out = LOWER[data]
    if len(out) > 1:
        tail = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][tail] += 32
    return out


def _words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = _lowered(data)
    starts, ends, at = word_spans(data, bounds, PUNCT)
    return hash_spans(data, starts, ends), at


def _seed_hashes(words: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(seed, places, hashes) of the seeds that fit within a text; seed -1 - n hashes a whole text of n words."""
    count = len(words)
    room = np.repeat(at[1:], np.diff(at)) - np.arange(count)
    for number, seed in enumerate(SEEDS):
        n = max(count - SPAN + 1, 0)
        place = np.flatnonzero(room[:n] >= SPAN)
        yield number, place, combine(words, seed, n)[place] ^ np.uint64(number)


def _windows(words: np.ndarray, at: np.ndarray, place: np.ndarray, text: np.ndarray, reach: int) -> np.ndarray:
    """(hit, 2 * reach + SPAN) words around each place; 0 outside the text."""
    index = place[:, None] + np.arange(-reach, SPAN + reach)[None, :]
    good = (index >= at[text][:, None]) & (index < at[text + 1][:, None])
    return np.where(good, words[np.clip(index, 0, max(len(words) - 1, 0))], np.uint64(0))


def _hash_batches(reach: int, bits: np.ndarray | None, short: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, _, data, bounds in slices(batch.column(1)):
                words, at = _words(data, bounds)
                ids = batch.column(0)
                found = []
                for number, place, value in _seed_hashes(words, at):
                    if bits is not None and len(value):
                        slot = value & np.uint64(MAP_BITS - 1)
                        keep = (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1
                        place, value = place[keep], value[keep]
                    found.append((np.full(len(place), number), place, value))
                for n in short:
                    # Items shorter than a seed: every run of n words, or of the item itself.
                    room = np.repeat(at[1:], np.diff(at)) - np.arange(len(words))
                    m = max(len(words) - n + 1, 0)
                    fits = room[:m] >= n if bits is not None else (room[:m] == n) & np.isin(np.arange(m), at[:-1])
                    place = np.flatnonzero(fits)
                    value = combine(words, tuple(range(n)), m)[place] ^ np.uint64(100 + n)
                    if bits is not None and len(value):
                        slot = value & np.uint64(MAP_BITS - 1)
                        keep = (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1
                        place, value = place[keep], value[keep]
                    found.append((np.full(len(place), -n), place, value))
                seed, place, value = (np.concatenate(x) for x in zip(*found))
                text = np.searchsorted(at, place, "right") - 1
                for a in range(0, len(place), 50_000):
                    part = slice(a, a + 50_000)
                    around = _windows(words, at, place[part], text[part], reach)
                    flat = pa.array(np.ascontiguousarray(around).reshape(-1).view(np.int64))
                    lists = pa.ListArray.from_arrays(
                        pa.array(np.arange(len(around) + 1, dtype=np.int32) * around.shape[1]), flat)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(value[part].view(np.int64)), ids.take(pa.array(text[part] + row)),
                         pa.array(seed[part].astype(np.int32)), pa.array((place - at[text])[part].astype(np.int64)), lists],
                        ["hash", "id", "seed", "place", "around"])
    return run


_HASHES = "hash long, id long, seed int, place long, around array<long>"


def _verify(window: int, substitutions: int, reach: int):
    """Best count of equal words over the windows that hold a hit's seed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            width = 2 * reach + SPAN
            column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            def grid(name: str) -> np.ndarray:
                return column[name].flatten().to_numpy(zero_copy_only=False).reshape(n, width)
            doc, item = grid("around"), grid("item_around")
            size = column["n_words"].to_numpy(zero_copy_only=False)
            need = np.minimum(window, size)
            total = np.concatenate([np.zeros((n, 1), np.int64), np.cumsum((doc == item) & (item != 0), axis=1)], axis=1)
            inside = np.concatenate([np.zeros((n, 1), np.int64), np.cumsum(item != 0, axis=1)], axis=1)
            best = np.zeros(n, np.int64)
            for w in np.unique(need):
                rows = np.flatnonzero(need == w)
                first, last = max(0, reach + SPAN - int(w)) if w >= SPAN else reach, reach
                for a in range(first, min(last, width - int(w)) + 1):
                    # The item covers the window: no window reaches over the item's ends.
                    full = inside[rows, a + w] - inside[rows, a] == w
                    hit = np.where(full, total[rows, a + w] - total[rows, a], 0)
                    best[rows] = np.maximum(best[rows], hit)
            allowed = np.where(size < window, 0, substitutions)
            good = (best >= need - allowed) & (best > 0)
            pick = pa.array(np.flatnonzero(good))
            yield pa.RecordBatch.from_arrays(
                [column["id"].take(pick), column["item_id"].take(pick), column["place"].take(pick),
                 column["item_place"].take(pick), pa.array(best[good]), pa.array(need[good].astype(np.int64))],
                ["id", "item_id", "place", "item_place", "equal", "of"])
    return run


def overlaps(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, substitutions: int = SUBSTITUTIONS) -> DataFrame:
    """(doc_id, item_id, n_hits, equal, of, place): verified overlaps of documents and benchmark items.

    ``equal`` of ``of`` words are the same in the best window; ``place`` is the first verified
    seed's word position in the document.
    """
    spark = docs.sparkSession
    reach = window - SPAN
    items = benchmark.select(F.col("item_id").cast("long"), "text").where("item_id is not null")
    sized = stage(items.mapInArrow(_count_batches, "item_id long, n_words long").where("n_words > 0").dropDuplicates(["item_id"]), "items")
    short = tuple(r[0] for r in sized.where(F.col("n_words") < SPAN).select("n_words").distinct().collect())
    test = stage(items.mapInArrow(_hash_batches(reach, None, short), _HASHES), "seeds")
    # At most MAP_BITS / 64 rows of one word each come to the driver, whatever the benchmark's size.
    slot = F.col("hash").bitwiseAND(MAP_BITS - 1)
    words = test.select(F.shiftright(slot, 3).alias("byte"), slot.bitwiseAND(7).cast("int").alias("bit")).groupBy("byte").agg(
        F.bit_or(F.expr("shiftleft(1, bit)")).alias("bits")).collect()
    bits = np.zeros(MAP_BITS // 8, np.uint8)
    for r in words:
        bits[r[0]] = r[1]
    hits = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null").mapInArrow(
        _hash_batches(reach, bits, short), _HASHES)
    # A passage in very many documents makes hot hashes: documents are salted, the benchmark's rows repeated per salt.
    hits = hits.withColumn("salt", F.pmod(F.col("id"), F.lit(SALTS)).cast("int"))
    test = test.join(sized, test["id"] == sized["item_id"]).select(
        "hash", F.col("seed").alias("item_seed"), "item_id", F.col("place").alias("item_place"),
        F.col("around").alias("item_around"), "n_words", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    met = hits.join(test, ["hash", "salt"]).where("seed = item_seed").select(
        "id", "item_id", "seed", "place", "item_place", "around", "item_around", "n_words")
    verified = met.mapInArrow(_verify(window, substitutions, reach),
                              "id long, item_id long, place long, item_place long, equal long, of long")
    return verified.groupBy(F.col("id").alias("doc_id"), "item_id").agg(
        F.count("*").alias("n_hits"), F.max(F.struct(F.col("equal") / F.col("of"), "equal", "of")).alias("best"),
        F.min("place").alias("place")).select("doc_id", "item_id", "n_hits", "best.equal", "best.of", "place")


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, end, data, bounds in slices(batch.column(1)):
            _, at = _words(data, bounds)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), pa.array(np.diff(at))], ["item_id", "n_words"])


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without a verified overlap, all columns.

    A row's own text decides: rows without an id are judged too, and rows that share an id are judged one by one.
    """
    keyed = docs.select(row_key().alias("doc_id"), "text")
    bad = overlaps(keyed, benchmark, **options).select(F.col("doc_id").alias("key")).distinct()
    return without(docs, stage(bad, "contaminated"))
