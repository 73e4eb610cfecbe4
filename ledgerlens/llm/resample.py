"""Resampling documents towards a target distribution.

Features are hashed into buckets; a bucket's gain is the log of its share in the target over its share in
the corpus.  Gains are an array of fixed size, so a document's weight is one gather and one sum per slice of texts.
A Gumbel draw from the document's id turns weights into scores whose highest are the sample.

Scores are written once, with a number for each row.  The cut-off is found by bisection on (score, doc_id, row): each
job counts exactly how many rows lie at or before fifteen thresholds, four halvings at once, first of the score,
then of the ids tied at the cut-off score, then of rows of one id.  The selected rows are
range-partitioned on the same order, and a rank is a place in a range plus the rows of the ranges before.

Defined cases: null and empty texts have no features, weight 0 and are never drawn (they have fewer than
``least_words`` words); null ids draw as the empty id and come last among ties; every row of a repeated id takes part with the
same draw; further columns are ignored.  An empty target or corpus has zero counts in all buckets.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stage
from .text import LOWER, PUNCT, slices, word_spans

BUCKETS = 10_000
SEED = "2024"
#: Rows of a rank range.
RANGE_ROWS = 500_000
_THRESHOLDS = 15
_SHORT = 32
_LAST_ID = (1 << 63) - 1


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


_CRC = _crc_table()


def crc_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each byte span: short spans a byte at a time for all of them, long ones singly."""
    crc = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    length = ends - starts
    at = np.flatnonzero(length <= _SHORT)
    for k in range(_SHORT):
        at = at[length[at] > k]
        if not len(at):
            break
        old = crc[at]
        crc[at] = _CRC[(old ^ data[starts[at] + k]) & 0xFF] ^ (old >> np.uint32(8))
    crc = ~crc
    for i in np.flatnonzero(length > _SHORT):
        crc[i] = zlib.crc32(data[starts[i] : ends[i]])
    return crc


def _features(data: np.ndarray, bounds: np.ndarray, runs: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket) of each feature, and the number of words of each text."""
    data = LOWER[data]
    starts, ends, at = word_spans(data, bounds, PUNCT)
    texts = np.repeat(np.arange(len(bounds) - 1), np.diff(at))
    if runs > 1:
        # Words side by side with one space after each, so that a run is one span.
        length = ends - starts
        place = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(length + 1, out=place[1:])
        joined = np.full(int(place[-1]), 0x20, np.uint8)
        within = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        joined[np.repeat(place[:-1], length) + within] = data[np.repeat(starts, length) + within]
        data, starts, ends = joined, place[:-1], place[:-1] + length
    owners, codes = [], []
    for run in range(1, runs + 1):
        n = max(len(starts) - run + 1, 0)
        same = texts[:n] == texts[run - 1 :] if n else np.zeros(0, bool)
        owners.append(texts[:n][same])
        codes.append(crc_spans(data, starts[:n][same], ends[run - 1 :][same]) % np.uint32(buckets))
    return np.concatenate(owners), np.concatenate(codes).astype(np.int64), np.diff(at)


def _histogram(runs: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, bounds in slices(batch.column(0)):
                total += np.bincount(_features(data, bounds, runs, buckets)[1], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])
    return run


def bucket_counts(texts: DataFrame, *, runs: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket over all rows of a table with a ``text`` column."""
    parts = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(_histogram(runs, buckets), "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most one row a bucket
        out[row["bucket"]] = row["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Whole-number gain of each bucket, in thousandths."""
    n, s, t = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([
        math.floor(1000 * math.log((float(b) + 1) * (s + n) / ((float(a) + 1) * (t + n))))
        for a, b in zip(corpus.tolist(), target.tolist())], np.int64)


def gumbel(doc_id: int | None, seed: str) -> int:
    """Whole-number Gumbel draw of an id, in thousandths."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _score(gain: np.ndarray, runs: int, seed: str):
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, bounds in slices(batch.column(2)):
                owner, code, words = _features(data, bounds, runs, buckets)
                n = np.bincount(owner, minlength=end - row)
                order = np.argsort(owner, kind="stable") if runs > 1 else slice(None)
                total = np.concatenate([np.zeros(1, np.int64), np.cumsum(gain[code[order]])])
                edge = np.concatenate([np.zeros(1, np.int64), np.cumsum(n)])
                weight = (total[edge[1:]] - total[edge[:-1]]) // np.maximum(n, 1)
                ids = batch.column(1).slice(row, end - row)
                draw = np.array([gumbel(i, seed) for i in ids.to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, end - row), ids, pa.array(words), pa.array(n), pa.array(weight), pa.array(weight + draw)],
                    ["row", "doc_id", "n_words", "n_features", "weight", "score"])
    return run


def scored(docs: DataFrame, gain: np.ndarray, *, runs: int = 1, seed: str = SEED) -> DataFrame:
    """(row, doc_id, n_words, n_features, weight, score) of every row."""
    return docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
    ).mapInArrow(_score(gain, runs, seed), "row long, doc_id long, n_words long, n_features long, weight long, score long")


def first_rows(rows: DataFrame, keys: list[Column], need: int) -> Column:
    """Predicate of exactly the first ``need`` rows by whole-number keys, ascending; the last key is unique."""
    chosen, tied = F.lit(False), F.lit(True)
    if need <= 0:
        return chosen
    for key in keys:
        part = rows.where(tied).select(key.alias("k"))
        low, high, n = part.agg(F.min("k"), F.max("k"), F.count("k")).first()
        if n <= need:
            return chosen | tied
        while low < high:
            steps = sorted({low + (high - low) * i // (_THRESHOLDS + 1) for i in range(1, _THRESHOLDS + 1)} - {high})
            counts = part.agg(*[F.count(F.when(F.col("k") <= F.lit(s), 1)) for s in steps]).first()
            for step, count in zip(steps, counts):
                if count >= need:
                    high = step
                    break
                low = step + 1
        before, at = part.agg(F.count(F.when(F.col("k") < F.lit(low), 1)), F.count(F.when(F.col("k") == F.lit(low), 1))).first()
        chosen, tied, need = chosen | (tied & (key < F.lit(low))), tied & (key == F.lit(low)), need - before
        if at == need:
            break
    return chosen | tied


def ranked(rows: DataFrame, keys: list[Column], n: int, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Adds ``rank`` (from 1) in the order of the keys."""
    ranges = max(1, -(-n // range_rows))
    dealt = rows.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
    # In a sorted range the identifier is the range's number and the row's place.
    placed = stage(dealt.withColumn("place", F.monotonically_increasing_id()), "rank-ranges")
    number, place = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(number.alias("range")).agg(F.count("*").alias("size"))
    # One row a range: small.
    offsets = sizes.select("range", (F.sum("size").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, 0)) - F.col("size")).alias("before"))
    joined = placed.withColumn("range", number).join(F.broadcast(offsets), "range")
    return joined.select(*rows.columns, (F.col("before") + place + 1).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, *, runs: int = 1, buckets: int = BUCKETS, percent: int = 10,
             least_words: int = 20, seed: str = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row; rank is null for rows that aren't drawn."""
    gain = gains(bucket_counts(docs, runs=runs, buckets=buckets), bucket_counts(target, runs=runs, buckets=buckets))
    table = stage(scored(docs, gain, runs=runs, seed=seed), "scores")
    able = table.where(F.col("n_words") >= least_words)
    need = percent * able.count() // 100
    keys = [-F.col("score"), F.coalesce("doc_id", F.lit(_LAST_ID)), F.col("row")]
    drawn = first_rows(able, keys, need) & (F.col("n_words") >= least_words)
    out = ["doc_id", "n_features", "weight", "score"]
    first = ranked(table.where(drawn), keys, need).select(*out, "rank")
    rest = table.where(~drawn).select(*out, F.lit(None).cast("long").alias("rank"))
    return first.unionByName(rest)


#: The same in SQL; CRC-32 goes over the bytes of each distinct word with the usual table of 256 entries.
ORACLE = r"""
with recursive steps as (
  select i, 0 as k, i as c from (select unnest(range(256)) as i)
  union all
  select i, k + 1, case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end from steps where k < 8),
crc as (select list(c order by i) as t from steps where k = 8),
d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
dw as (select doc_id, unnest(ws) as w from d),
bw as (select unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as w from benchmark),
hexed as (select w, hex(encode(w)) as x from (select w from dw union select w from bw)),
coded as (
  select w, cast(xor(list_reduce(list_concat([4294967295], list_transform(range(len(x) // 2), lambda i: cast(concat('0x', substr(x, 2 * i + 1, 2)) as bigint))),
         lambda a, b: xor(a // 256, t[xor(a, b) % 256 + 1])), 4294967295) % 10000 as bigint) as bucket
  from hexed, crc),
s as (select bucket, count(*) as n from dw join coded using (w) group by bucket),
t as (select bucket, count(*) as n from bw join coded using (w) group by bucket),
gain as (
  select b.bucket, cast(floor(1000 * ln((coalesce(t.n, 0) + 1.0::double) * ((select count(*) from dw) + 10000.0::double)
         / ((coalesce(s.n, 0) + 1.0::double) * ((select count(*) from bw) + 10000.0::double)))) as bigint) as g
  from (select distinct bucket from coded) b left join s using (bucket) left join t using (bucket)),
sums as (select doc_id, count(*) as n, sum(g) as total from dw join coded using (w) join gain using (bucket) group by doc_id),
w as (
  select d.doc_id, coalesce(n, 0) as n_features, cast(coalesce(floor(cast(total as double) / n), 0) as bigint) as weight,
         cast(concat('0x', substr(sha256(concat('2024:', d.doc_id)), 1, 8)) as bigint) as h
  from d left join sums using (doc_id)),
sc as (select doc_id, n_features, weight, weight + cast(floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296.0::double))) as bigint) as score from w),
r as (select doc_id, row_number() over (order by score desc, doc_id) as rank from sc where n_features >= 20)
select sc.doc_id, cast(n_features as bigint) as n_features, weight, score,
       case when rank <= (select 10 * count(*) // 100 from r) then rank end as rank
from sc left join r using (doc_id)
"""
