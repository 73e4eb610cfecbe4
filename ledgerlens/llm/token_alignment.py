"""Alignment of two tokenizers' tokens over the bytes of each text.

``space + text`` is encoded by a byte-level vocabulary (A) and by a piece model (B, which adds the space itself).
Both give a list of byte ends.  The shorter list of a document drives a galloping search into the longer: each end
starts at the place that its rank suggests, steps away in doubling strides until it is bracketed, then
halves.  Ends found in both lists cut the tokens into groups; the difference of two neighbouring ranks is the
range of tokens that a token overlaps, so links come as ranges and nothing is compared pair by pair.  The searches of
all documents of a slice run side by side on arrays.

Tokens of pre-tokens (:mod:`.units`) are kept per Python worker, so a repeated word is encoded once.  A row keeps
its distinct (A id, B id) pairs with their numbers of links; the pairs' document counts over the corpus are one
aggregation.  They come back to the documents in two tiers: the most frequent pairs, of which there are at most
``COMMON``, as a broadcast; the links of all rarer pairs by a join on the pair, whose keys each have
few rows.  A table with fewer distinct pairs needs no second tier.

Defined cases: texts that are null, empty or not reproduced byte by byte by both tokenizers (the mark U+2581, which B
reads as a space) have no tokens: zeros and an empty digest; rows of repeated or null ids count as a document each;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .units import MARK, ByteLevel, Pieces, per_worker, spelled, units, whole

#: Pairs of the broadcast tier.
COMMON = 1 << 18
#: Pre-tokens and tokens that a worker keeps.
HELD, HELD_TOKENS = 1 << 19, 1 << 22
#: Characters that are aligned at once; the arrays of a slice stay in the processor's cache.
SLICE = 1 << 18


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers starts[i], starts[i] + 1, ... of each range, one range after the other."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)


def gallop(ends: np.ndarray, low: np.ndarray, high: np.ndarray, start: np.ndarray, values: np.ndarray) -> np.ndarray:
    """First place in [low, high) of ``ends`` that isn't below each value; the last place of a range never is."""
    left, right = low.copy(), high - 1
    ahead = ends[start] < values
    left[ahead], right[~ahead] = start[ahead] + 1, start[~ahead]
    stride = 1
    open_ = np.arange(len(values))
    while len(open_):
        up = ahead[open_]
        place = np.where(up, start[open_] + stride, start[open_] - stride)
        inside = np.where(up, place < right[open_], place >= left[open_])
        open_, up, place = open_[inside], up[inside], place[inside]
        below = ends[place] < values[open_]
        left[open_[below]] = place[below] + 1
        right[open_[~below]] = place[~below]
        open_ = open_[up == below]
        stride *= 2
    open_ = np.flatnonzero(left < right)
    while len(open_):
        middle = (left[open_] + right[open_]) // 2
        below = ends[middle] < values[open_]
        left[open_[below]] = middle[below] + 1
        right[open_[~below]] = middle[~below]
        open_ = open_[left[open_] < right[open_]]
    return left


class _Names(dict):
    """Numbers of pre-tokens; new ones are listed until they are encoded."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, name: str) -> int:
        number = self[name] = len(self)
        self.new.append(name)
        return number


class _Side:
    """Tokens of all numbered pre-tokens in one array."""

    def __init__(self):
        self.ids, self.starts, self.used = np.zeros(1 << 16, np.int32), np.zeros(1, np.int64), 0

    def add(self, ids: np.ndarray, counts: np.ndarray) -> None:
        end = self.used + len(ids)
        if end > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(end, np.int32)])
        self.ids[self.used : end] = ids
        self.starts = np.concatenate([self.starts, self.used + np.cumsum(counts)])
        self.used = end

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pre-tokens in turn, and how many each has."""
        counts = self.starts[numbers + 1] - self.starts[numbers]
        return self.ids[ragged(self.starts[numbers], counts)], counts


class Encoders:
    """Both tokenizers with the tokens of the pre-tokens seen so far."""

    def __init__(self, a: str, b: str):
        self.a, self.b = ByteLevel(a), Pieces(b)
        self.bytes_a, self.bytes_b = self.a.token_bytes(), self.b.token_bytes()
        self.width_a = np.array([len(x) for x in self.bytes_a])
        self.width_b = np.array([len(x) for x in self.bytes_b])
        # A token's number with what follows it: ',' inside a group, '|' or ';' at its end.
        self.written = np.array(
            [f"{i}{c}" for i in range(self.a.size) for c in ",|"] + [f"{i}{c}" for i in range(self.b.size) for c in ",;"], object)
        self.forget()

    def forget(self) -> None:
        self.names, self.side_a, self.side_b, self.whole = _Names(), _Side(), _Side(), np.zeros(0, bool)

    def units(self, text: str) -> list[str]:
        return units(text) if self.b.divisible else whole(text)

    def numbered(self, names: list[str]) -> np.ndarray:
        if len(self.names) > HELD or self.side_a.used + self.side_b.used > HELD_TOKENS:
            self.forget()
        numbers = np.fromiter(map(self.names.__getitem__, names), np.int64, len(names))
        new, self.names.new = self.names.new, []
        if new and not self._add_joined(new):
            self._add_each(new)
        return numbers

    def _add_joined(self, new: list[str]) -> bool:
        """New pre-tokens side by side as one text, whose tokens are cut at their ends; False if that isn't exact."""
        if not self.b.divisible or any(map(str.isspace, map(itemgetter(-1), new))):
            return False
        text = "".join(map(spelled, ["-", *new]))  # begins with the space that B adds
        if MARK in text:
            return False
        size = np.fromiter(map(len, map(str.encode, new)), np.int64, len(new))
        size += np.fromiter((not n[0].isspace() for n in new), bool, len(new))
        ends = 2 + np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
        parts = []
        for ids, table, width in ((self.a.encode_text(text), self.bytes_a, self.width_a),
                                  (self.b.processor.encode(text[1:]), self.bytes_b, self.width_b)):
            if b"".join(map(table.__getitem__, ids)) != text.encode():
                return False
            ids = np.array(ids, np.int32)
            at = np.cumsum(width[ids])
            cut = np.searchsorted(at, ends) + 1
            if (at[cut - 1] != ends).any():
                return False
            parts.append((ids[cut[0] :], np.diff(cut)))
        self.side_a.add(*parts[0])
        self.side_b.add(*parts[1])
        self.whole = np.concatenate([self.whole, np.ones(len(new), bool)])
        return True

    def _add_each(self, new: list[str]) -> None:
        a, b = self.a.encode(new), [self.b.encode(n) for n in new]
        for side, lists in ((self.side_a, a), (self.side_b, b)):
            side.add(np.fromiter(chain.from_iterable(lists), np.int32), np.fromiter(map(len, lists), np.int64, len(lists)))
        said = [spelled(n).encode() for n in new]
        good = [s == b"".join(map(self.bytes_a.__getitem__, x)) and s == b"".join(map(self.bytes_b.__getitem__, y))
                for s, x, y in zip(said, a, b)]
        self.whole = np.concatenate([self.whole, np.array(good, bool)])

    def align(self, texts: list[str | None]) -> dict[str, np.ndarray | list]:
        """Counts, digests and linked pairs of each text."""
        n = len(texts)
        names = [self.units(t) if t else [] for t in texts]
        sizes = np.fromiter(map(len, names), np.int64, n)
        numbers = self.numbered([u for one in names for u in one])
        owner = np.repeat(np.arange(n), sizes)
        # A text with a pre-token that does not come back has no tokens.
        bad = np.bincount(owner[~self.whole[numbers]], minlength=n) > 0
        numbers, owner = numbers[~bad[owner]], owner[~bad[owner]]
        ids_a, per_a = self.side_a.of(numbers)
        ids_b, per_b = self.side_b.of(numbers)
        n_a = np.bincount(owner, weights=per_a, minlength=n).astype(np.int64)
        n_b = np.bincount(owner, weights=per_b, minlength=n).astype(np.int64)
        edge_a, edge_b = np.concatenate([[0], np.cumsum(n_a)]), np.concatenate([[0], np.cumsum(n_b)])
        total_a = int(edge_a[-1])
        ids = np.concatenate([ids_a, ids_b]).astype(np.int64)
        ends = np.concatenate([np.cumsum(self.width_a[ids_a]), np.cumsum(self.width_b[ids_b])])

        # The shorter list of each text drives.
        by_a = n_a <= n_b
        count = np.where(by_a, n_a, n_b)
        first = np.where(by_a, edge_a[:-1], edge_b[:-1] + total_a)
        other = np.where(by_a, n_b, n_a)
        into = np.where(by_a, edge_b[:-1] + total_a, edge_a[:-1])
        driver, text = ragged(first, count), np.repeat(np.arange(n), count)
        rank_in = driver - first[text]
        low, high = into[text], (into + other)[text]
        found = gallop(ends, low, high, low + rank_in * other[text] // np.maximum(count, 1)[text], ends[driver])
        common = ends[found] == ends[driver]
        begin = np.where(rank_in == 0, low, np.roll(found + common, 1))
        spans = found - begin + 1
        n_links = np.bincount(text, weights=spans, minlength=n).astype(np.int64)
        n_groups = np.bincount(text[common], minlength=n)

        # Links as (text, pair), equal ones counted.
        side, target = np.repeat(driver, spans), ragged(begin, spans)
        a = np.where(side < total_a, side, target)
        b = np.where(side < total_a, target, side)
        space = self.a.size * self.b.size
        links = np.repeat(text, spans) * space + ids[a] * self.b.size + ids[b]
        links, times = np.unique(links, return_counts=True)
        cut = np.searchsorted(links, np.arange(n + 1) * space)

        # Tokens of both sides in the order of their groups.
        last = np.zeros(len(ids), np.int64)
        last[driver[common]] = 1
        last[found[common]] = 1
        group_a = np.cumsum(last[:total_a]) - last[:total_a]
        group_b = np.cumsum(last[total_a:]) - last[total_a:]
        groups = int(last[:total_a].sum())
        ahead_a = np.concatenate([[0], np.cumsum(np.bincount(group_a, minlength=groups))])
        ahead_b = np.concatenate([[0], np.cumsum(np.bincount(group_b, minlength=groups))])
        order = np.concatenate([np.arange(total_a) + ahead_b[group_a], np.arange(len(ids) - total_a) + ahead_a[group_b + 1]])
        index = ids * 2 + last
        index[total_a:] += 2 * self.a.size
        line = np.empty(len(ids), object)
        line[order] = self.written[index]
        line, edge = line.tolist(), (edge_a + edge_b).tolist()
        digests = [hashlib.sha256("".join(line[s:e])[:-1].encode()).hexdigest() if e > s else "" for s, e in zip(edge, edge[1:])]
        return {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "groups_sha256": digests,
                "pairs": links % space, "times": times, "cut": cut}


def _slices(column: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of about SLICE characters; a single text is never cut."""
    first, texts, size = 0, [], 0
    for i, value in enumerate(column):
        text = value.as_py()
        texts.append(text)
        size += len(text or "")
        if size >= SLICE:
            yield first, texts
            first, texts, size = i + 1, [], 0
    if texts:
        yield first, texts


def _align(a: str, b: str, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = per_worker(f"encoders:{a}:{b}", lambda: Encoders(a, b))
        for batch in batches:
            for first, texts in _slices(batch.column(2)):
                got = encoders.align(texts)
                cut = pa.array(got["cut"].astype(np.int32))
                columns = [batch.column(0).slice(first, len(texts)), batch.column(1).slice(first, len(texts)),
                           *[pa.array(got[c].astype(np.int64)) for c in ("n_a", "n_b", "n_groups", "n_links")], pa.array(got["groups_sha256"], pa.string()),
                           pa.ListArray.from_arrays(cut, pa.array(got["pairs"]).cast(kind)),
                           pa.ListArray.from_arrays(cut, pa.array(got["times"].astype(np.int32)))]
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])
    return run


def linked(docs: DataFrame, a: str, b: str) -> DataFrame:
    """One row a document: counts, digest of its groups, distinct linked pairs (A id * size of B + B id) and their links."""
    small = ByteLevel(a).size * Pieces(b).size < 1 << 31
    pair, kind = ("int", pa.int32()) if small else ("long", pa.int64())
    return docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
    ).mapInArrow(
        _align(a, b, kind), "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
        f"pairs array<{pair}>, times array<int>")


def pair_counts(rows: DataFrame, size_b: int) -> DataFrame:
    """(pair, n, best): documents that hold each pair, and whether it is the highest of its A id."""
    counts = stage(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pair-counts")
    a = F.expr(f"pair div {size_b}")
    # One row an A id: at most the size of the vocabulary.
    highest = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
    return counts.withColumn("a", a).join(F.broadcast(highest), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _frequent(counts: DataFrame, most: int) -> int:
    """The smallest power of two that at most ``most`` pairs reach."""
    level = F.floor(F.log2("n")).cast("int").alias("level")
    total, least = 0, 0
    for row in counts.groupBy(level).count().orderBy(F.col("level").desc()).collect():  # at most 64 rows
        total += row["count"]
        if total > most:
            return 1 << (row["level"] + 1)
        least = 1 << row["level"]
    return least


def _sums(table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = table.value
        names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
        for batch in batches:
            lists, times = batch.column(7), batch.column(8)
            cut = lists.offsets.to_numpy().astype(np.int64)
            inside = slice(int(cut[0]), int(cut[-1]))
            cut = cut - cut[0]
            each = times.values.to_numpy()[int(times.offsets[0].as_py()) : int(times.offsets[-1].as_py())].astype(np.int64)
            code = lists.values.to_numpy()[inside]
            at = np.minimum(np.searchsorted(pairs, code), max(len(pairs) - 1, 0))
            hit = pairs[at] == code if len(pairs) else np.zeros(len(code), bool)
            sums = []
            for value in (best, n):
                total = np.zeros(len(code) + 1, np.int64)
                np.cumsum(np.where(hit, each * value[at], 0) if len(pairs) else np.zeros(len(code), np.int64), out=total[1:])
                sums.append(pa.array(total[cut[1:]] - total[cut[:-1]]))
            missed = np.concatenate([np.zeros(1, np.int64), np.cumsum(~hit)])[cut].astype(np.int32)
            rest = [pa.ListArray.from_arrays(pa.array(missed), pa.array(x[~hit])) for x in (code, each.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(7)], *sums, *rest], [*names, "best_near", "sum_near", "pairs", "times"])
    return run


def align(docs: DataFrame, a: str, b: str, *, common: int = COMMON) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    ``a`` and ``b`` are paths of a byte-level vocabulary and a piece model on every node.
    """
    rows = stage(linked(docs, a, b), "token-links")
    counts = stage(pair_counts(rows, Pieces(b).size), "pair-counts")
    least = _frequent(counts, common)
    near = counts.where(F.col("n") >= least).orderBy("pair").toPandas()  # at most ``common`` rows
    table = rows.sparkSession.sparkContext.broadcast(
        (near["pair"].to_numpy(np.int64), near["n"].to_numpy(np.int64), near["best"].to_numpy(bool)))
    pair = rows.schema["pairs"].dataType.elementType.simpleString()
    first = rows.mapInArrow(
        _sums(table), "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
        f"best_near long, sum_near long, pairs array<{pair}>, times array<int>")
    out = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if least <= 1:
        return first.withColumns({"n_best": F.col("best_near"), "count_sum": F.col("sum_near")}).select(*out)
    first = stage(first, "token-links-near")
    links = first.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("z")).select("row", "z.pairs", "z.times")
    rare = counts.where(F.col("n") < least)
    far = links.join(rare, links["pairs"] == rare["pair"]).groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).cast("long").alias("best_far"),
        F.sum(F.col("times") * F.col("n")).cast("long").alias("sum_far"))
    return first.join(far, "row", "left").withColumns({
        "n_best": F.col("best_near") + F.coalesce("best_far", F.lit(0)),
        "count_sum": F.col("sum_near") + F.coalesce("sum_far", F.lit(0))}).select(*out)
