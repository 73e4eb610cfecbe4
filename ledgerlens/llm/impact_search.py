"""Exact top-k inner products with an impact-ordered, score-at-a-time index.

A component's impact is the integer floor(scale * x).  Vectors are dealt to shards by a hash of their
id, queries to blocks; every block meets every shard once, and a shard's k best per query are merged by
a window that keeps k rows.  Shards and blocks have bounded size whatever the number of rows.

In a shard, copies of a vector are one entry with its k + 1 smallest ids (more can't be among the best:
ties go to smaller ids).  For each dimension the entries are posted in the order of their impact, so
the postings with the largest products are at one end of the list.  A query takes segments from all
dimensions by falling product, adding to one accumulator per entry.  At a threshold t every product
above t has been added, so an entry with m products added has at most its sum + (d - m) t; at least it
has its sum + the smallest possible rest.  Entries whose upper bound is below the k-th best lower bound are proved
out.  The search stops only when few entries remain possible (or all is added), and those are
scored exactly.

Defined cases: vectors that are null, empty or hold a null or non-finite component take no part, nor
do null ids; vectors of different length never meet; rows repeated with the same id are one vector
(the smallest by value, if they differ); components and scores beyond the long range count as its end; a query with fewer than k others returns all; no queries: no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage

SHARD_ROWS, BLOCK_ROWS = 16384, 4096
#: Shares of the postings after which possible members are counted, and the count that is scored at once.
CHECKS = (0.5, 0.75, 1.0)
FEW = 1024


class Shard:
    """Postings of the distinct vectors of a shard, by dimension and impact."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        order = np.lexsort((ids, *vectors.T[::-1]))
        ids, vectors = ids[order], vectors[order]
        new = np.ones(len(ids), bool)
        new[1:] = (vectors[1:] != vectors[:-1]).any(axis=1)
        first = np.flatnonzero(new)
        self.copies = [ids[a : min(b, a + k + 1)] for a, b in zip(first, np.append(first[1:], len(ids)))]
        self.vectors = vectors[first]
        n, d = self.vectors.shape
        self.order = np.argsort(self.vectors, axis=0, kind="stable").T.copy()
        self.values = np.take_along_axis(self.vectors.T, self.order, axis=1).copy()
        self.n, self.d, self.k = n, d, k
        self.bits = d.bit_length()
        # In doubles: it only has to tell whether sums fit.
        sizes = np.abs(self.vectors.astype(float))
        self.reach = float(sizes.sum(axis=1).max(initial=0)) + float(sizes.max(initial=0)) * d
        self.small = self.values.astype(np.int32) if np.abs(self.values).max(initial=0) < 1 << 15 else self.values

    def search(self, query: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows that aren't the query's own."""
        used = [(i, int(q)) for i, q in enumerate(query) if q and self.n]
        # The smallest product of a dimension; what a product exceeds it by is what counts.
        base = {i: q * int(self.values[i, 0] if q > 0 else self.values[i, -1]) for i, q in used}
        done = dict.fromkeys(base, 0)
        bits = self.bits
        worst = float(np.abs(query.astype(float)).max(initial=0)) * self.reach + 1
        slim, wide = worst * 2**bits < 2**31, worst * 2**bits >= 2**62
        sums, values = np.zeros(self.n, np.int32 if slim else np.int64), self.small if slim else self.values
        possible = np.arange(self.n)
        want = min(self.k + 1, self.n)
        # Sums that may not fit an accumulator: all entries are scored exactly.
        for share in CHECKS if used and not wide else ():
            t = self._threshold(query, share)
            for i, q in used:
                if share == 1:
                    upto = self.n
                elif q > 0:
                    upto = self.n - int(np.searchsorted(self.values[i], (t + base[i]) // q, "right"))
                else:
                    upto = int(np.searchsorted(self.values[i], -((t + base[i]) // -q), "left"))
                if upto > done[i]:
                    part = slice(self.n - upto, self.n - done[i]) if q > 0 else slice(done[i], upto)
                    # Sum in the high bits, number of products in the low ones: one update per posting.
                    sums[self.order[i, part]] += values[i, part] * (q << bits) + (1 - (base[i] << bits))
                    done[i] = upto
            low, count = sums >> bits, sums & ((1 << bits) - 1)
            floor = np.partition(low, self.n - want)[self.n - want]
            possible = np.flatnonzero(low + (len(used) - count) * t >= floor)
            if len(possible) <= FEW:
                break
        if worst < 2**62:
            exact = self.vectors[possible] @ query
        else:
            exact = np.clip(self.vectors[possible].astype(object) @ query.astype(object), -(1 << 63), (1 << 63) - 1).astype(np.int64)
        ids, scores = [], []
        cut = np.partition(exact, len(exact) - want)[len(exact) - want] if len(exact) else 0
        for j in np.flatnonzero(exact >= cut):
            some = self.copies[possible[j]]
            ids.append(some)
            scores.append(np.full(len(some), exact[j]))
        ids, scores = np.concatenate(ids), np.concatenate(scores)
        keep = ids != own
        ids, scores = ids[keep], scores[keep]
        top = np.lexsort((ids, -scores))[: self.k]
        return ids[top], scores[top]

    def _threshold(self, query: np.ndarray, share: float) -> int:
        """The product (above its dimension's smallest) that about ``share`` of the postings exceed; never below 0."""
        if share == 1:
            return 0
        some = self.values[:, :: max(1, self.n // 64)] * query[:, None]
        some = (some - some.min(axis=1, keepdims=True)).ravel()
        at = int(len(some) * (1 - share))
        return max(0, int(np.partition(some, at)[at]))


def _meet(k: int):
    def run(key, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(queries) and len(rows):
            shard = Shard(rows["vec_id"].to_numpy(np.int64), np.stack(rows["v"].to_numpy()).astype(np.int64), k)
            for own, q in zip(queries["vec_id"].tolist(), queries["v"]):
                ids, scores = shard.search(np.asarray(q, np.int64), own)
                found.append(pd.DataFrame({"query_id": own, "vec_id": ids, "score": scores}))
        if not found:
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("query_id", "vec_id", "score")})
        return pd.concat(found, ignore_index=True)
    return run


def top_k(vectors: DataFrame, is_query, *, k: int = 5, scale: int = 256, column: str = "embedding",
          shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows for which the condition ``is_query`` holds, against all rows."""
    v = F.expr(f"transform({column}, x -> cast(floor({scale} * cast(x as double)) as long))")
    whole = F.expr(f"forall({column}, x -> x is not null and not isnan(x) and abs(x) < cast('infinity' as double))")
    kept = vectors.where(F.col("vec_id").isNotNull() & F.col(column).isNotNull() & (F.size(column) > 0) & whole)
    rows = stage(kept.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), F.size(column).alias("d")).groupBy("vec_id", "d").agg(
        F.min("v").alias("v")), "vectors")
    queries = rows.where(is_query)
    shards = max(1, -(-rows.count() // shard_rows))
    blocks = max(1, -(-queries.count() // block_rows))
    place = F.xxhash64("vec_id")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("vec_id", "v", "d", F.pmod(place, F.lit(blocks)).cast("int").alias("block"), each(shards).alias("shard"))
    right = rows.select("vec_id", "v", "d", F.pmod(place, F.lit(shards)).cast("int").alias("shard"), each(blocks).alias("block"))
    key = ["d", "shard", "block"]
    met = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_meet(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
