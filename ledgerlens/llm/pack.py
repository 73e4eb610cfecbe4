"""Best-fit packing of documents into sequences under conflict constraints.

Documents longer than a sequence are cut into full pieces; each full piece fills a bin of its own
and the remainder is packed like a short document.  Pieces are dealt to shards by a hash of the
document; the number of shards follows the number of pieces, so a shard's work is bounded, and a
source or cluster that holds a third of all rows is spread over all shards.  Within a shard pieces are
taken by falling length; open bins stand in the order of their residual room.  A successor search
begins at the tightest bin with enough room and goes on to the next until one is compatible:

- a bin's cluster bitmap holds the duplicate clusters in it; no cluster comes twice into a bin;
- a bin's source bitmap holds the sources whose share of the bin (``per_source`` pieces) is used up.

If none fits, a bin is opened.  Defined cases: null or blank texts have length 0 and are not
packed (bin_id null); null sources count as one source; null clusters never conflict; repeated rows of
a document are numbered and packed each; different texts under one id, or under none, are told apart by ``row``;
further columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .text import LOWER, SPACE, hash_spans, mix, slices, word_spans

CAPACITY = 2048
PER_SOURCE = 8
SHARD_PIECES = 4096
#: Copies of a row that are unrolled at once.
COPIES = 256


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of each text, and a fingerprint of its lower-cased words as duplicate cluster."""
    for batch in batches:
        for row, end, data, bounds in slices(batch.column(2)):
            lowered = LOWER[data]
            starts, ends, at = word_spans(lowered, bounds, SPACE)
            words = mix(hash_spans(lowered, starts, ends) + (np.arange(len(starts)) - np.repeat(at[:-1], np.diff(at))).astype(np.uint64))
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words, dtype=np.uint64)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(row, end - row), batch.column(1).slice(row, end - row), pa.array(np.diff(at)),
                 pa.array(mix(total[at[1:]] - total[at[:-1]]).view(np.int64))],
                ["doc_id", "source", "n_words", "cluster"])


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, source, n_words, cluster); the cluster is a fingerprint of the lower-cased words."""
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long"), source.alias("source"), "text").mapInArrow(
        _measure, "doc_id long, source string, n_words long, cluster long")


def best_fit(pieces: list[tuple[int, int, int]], capacity: int, per_source: int) -> list[tuple[int, int]]:
    """(bin, offset) of each (length, source number, cluster number or -1), taken in the given order."""
    rooms: list[tuple[int, int]] = []  # (residual, bin) in order
    clusters: list[int] = []
    full: list[int] = []  # bitmap of the sources whose share is used up
    used: list[dict[int, int]] = []
    placed = []
    for length, source, cluster in pieces:
        source_bit, cluster_bit = 1 << source, (1 << cluster if cluster >= 0 else 0)
        at = bisect_left(rooms, (length, -1))
        while at < len(rooms) and (clusters[rooms[at][1]] & cluster_bit or full[rooms[at][1]] & source_bit):
            at += 1
        if at < len(rooms):
            room, number = rooms.pop(at)
        else:
            room, number = capacity, len(clusters)
            clusters.append(0)
            full.append(0)
            used.append({})
        placed.append((number, capacity - room))
        clusters[number] |= cluster_bit
        count = used[number][source] = used[number].get(source, 0) + 1
        if count >= per_source:
            full[number] |= source_bit
        if room > length:
            insort(rooms, (room - length, number))
    return placed


def _pack_shards(capacity: int, per_source: int):
    def run(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["n", "doc_id", "row", "copy", "piece"], ascending=[False, True, True, True, True], kind="stable")
        sources = pd.factorize(shard["source"].fillna("\0"))[0]
        clusters = pd.factorize(shard["cluster"])[0]  # nulls are -1
        placed = best_fit(list(zip(shard["n"].tolist(), sources.tolist(), clusters.tolist())), capacity, per_source)
        out = shard[["doc_id", "row", "copy", "piece", "n", "shard"]].copy()
        out["number"] = [p[0] for p in placed]
        out["start"] = [p[1] for p in placed]
        return out
    return run


def pack(docs: DataFrame, *, capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard_pieces: int = SHARD_PIECES,
         lengths: DataFrame | None = None) -> DataFrame:
    """(doc_id, copy, piece, first_word, n_words, bin_id, bin_start, row) for every piece of every row; ``row`` is a
    fingerprint of id, source and words.

    ``lengths`` (doc_id, source, n_words, cluster) may be given; by default words and fingerprints are
    taken from the texts.
    """
    rows = stage(lengths if lengths is not None else measured(docs), "lengths")
    # Copies are numbered without a window over the whole table, and unrolled by parts in many tasks.
    known = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in ("doc_id", "source", "n_words", "cluster")]
    counted = rows.groupBy("doc_id", "source", "n_words", "cluster").agg(F.count("*").alias("copies")).select(
        "doc_id", "source", F.greatest(F.coalesce("n_words", F.lit(0)), F.lit(0)).alias("n_words"), "cluster",
        F.xxhash64(*known).alias("row"), "copies",
        F.explode(F.expr(f"sequence(0L, (copies - 1) div {COPIES})")).alias("turn"))
    pieces = counted.repartition("row", "turn").select(
        "doc_id", "source", "n_words", "cluster", "row",
        F.explode(F.expr(f"sequence(cast(turn * {COPIES} + 1 as int), cast(least(copies, (turn + 1) * {COPIES}) as int))")).alias("copy"))
    full = F.floor(F.col("n_words") / capacity).cast("long")
    rest = F.col("n_words") % capacity
    count = full + F.when(rest > 0, 1).otherwise(0)
    cut = pieces.where("n_words > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("piece"))
    cut = cut.select("doc_id", "source", "cluster", "row", "copy", "piece",
                     F.least(F.lit(capacity).cast("long"), F.col("n_words") - F.col("piece") * capacity).alias("n"))
    n_short = rows.where(F.col("n_words") % capacity > 0).count()
    shards = max(1, -(-n_short // shard_pieces))
    shard = F.pmod(F.xxhash64("row", "copy"), F.lit(shards)).cast("int")
    whole = cut.where(F.col("n") == capacity).select(
        "doc_id", "row", "copy", "piece", "n", F.concat_ws("-", F.lit("full"), F.hex("row"), "copy", "piece").alias("bin_id"),
        F.lit(0).cast("long").alias("start"))
    part = cut.where(F.col("n") < capacity).withColumn("shard", shard).groupBy("shard").applyInPandas(
        _pack_shards(capacity, per_source),
        "doc_id long, row long, copy int, piece long, n long, shard int, number long, start long").select(
        "doc_id", "row", "copy", "piece", "n", F.concat_ws("-", F.lit("fit"), "shard", "number").alias("bin_id"), "start")
    none = pieces.where("n_words = 0").select(
        "doc_id", "row", "copy", F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("n"),
        F.lit(None).cast("string").alias("bin_id"), F.lit(None).cast("long").alias("start"))
    return whole.unionByName(part).unionByName(none).select(
        "doc_id", "copy", "piece", (F.col("piece") * capacity).alias("first_word"), F.col("n").alias("n_words"), "bin_id",
        F.col("start").alias("bin_start"), "row")
