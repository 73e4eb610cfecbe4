"""Near-duplicate detection with bottom-k sketches from one hash function.

1. Each text's shingles are hashed once; the k smallest hashes are its sketch.  Texts with equal
   shingle sets form a class and are represented by their smallest id.
2. Inverted lists: retained value -> classes.  A list of up to ``short`` classes gives its pairs and
   counts overlaps.  Longer lists (groups of many near copies, passages that many texts share) give
   pairs with a few hubs instead of all pairs, so their output is linear in their length.
3. The sketch of a union, made from both sketches, estimates the similarity; pairs clearly below
   the threshold go.  The rest is verified on the full shingle sets.
4. Every long list that still holds several components is compared as a whole, in blocks of bounded size.  A pair
   that passes the estimate shares at least half of the longer sketch, so it shares a value among the rarest
   ``len // 2 + 1`` of both sketches; only these values' lists are needed, and a pair belongs to the longest list
   that it shares.  A block first names the classes with a partner of allowed size and union sketch in another
   component.  Their full sets then come to the block, pairs are verified there from the highest estimate down,
   and only links that join two components of the block leave it: fewer than it has rows.  A pair whose ends
   are joined by such links needs no check.

Defined cases: a null or blank text has an empty set, is linked with nothing and kept; a null id is
kept and linked with nothing; repeated rows stay repeated and share their text's class; different texts of one
id are one document: they share a component, and are kept or go together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .components import components
from .rows import packed
from .text import arrow_lists, mix, shingle_sets, slices

SKETCH = 32
SHORT = 8
#: Estimated similarity below which a pair isn't verified: 3.3 standard deviations under 0.75 at k = 32.
FLOOR = 0.50
HOT_KEYS, HUBS = 4, 2
#: Rows of a long list, and shingles of full sets, that are compared with as many others in one task.
BLOCK, SET_BLOCK = 2048, 1 << 20
#: Pairs of a block that are estimated, ordered and verified at once.
_ESTIMATED, _ORDERED, _CHECKED = 1 << 14, 1 << 17, 512
_PAD = np.iinfo(np.int64).max

_SKETCHES = "doc_id long, n_shingles long, sig1 long, sig2 long, sketch array<long>"


def _sketch_batches(size: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for row, end, data, bounds in slices(batch.column(1)):
                sets = shingle_sets(data, bounds, size)
                sums = [(np.add.reduce(mix(s)), np.add.reduce(mix(s ^ np.uint64(0x5DEECE66D)))) for s in sets]
                sig = np.array(sums, np.uint64).reshape(-1, 2).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(row, end - row), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array(sig[:, 0]), pa.array(sig[:, 1]), arrow_lists([s[:k] for s in sets])],
                    ["doc_id", "n_shingles", "sig1", "sig2", "sketch"])
    return run


def _set_batches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, bounds in slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, end - row), arrow_lists(shingle_sets(data, bounds, size))],
                    ["doc_id", "shingles"])
    return run


def sketches(docs: DataFrame, size: int = 5, k: int = SKETCH) -> DataFrame:
    """(doc_id, n_shingles, two signatures of the set, the k smallest hashes) of each row."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_sketch_batches(size, k), _SKETCHES)


def estimate(a: str, b: str, k: int) -> Column:
    """Similarity from the sketch of the union: the share of its values that both sketches hold."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, k)
    return F.size(F.array_intersect(F.array_intersect(union, F.col(a)), F.col(b))) / F.size(union)


def _pair(left: Column, right: Column) -> list[Column]:
    return [F.least(left, right).alias("a"), F.greatest(left, right).alias("b")]


def _place(*parts: Column) -> Column:
    return F.xxhash64(*parts)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, linked) with the exact similarity of the full sets."""
    one = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return (
        pairs.select("a", "b").join(one, "a").join(two, "b")
        .select("a", "b", both.alias("both"), (F.size("sa") + F.size("sb") - both).alias("all"))
        .select("a", "b", (100 * F.col("both") >= percent * F.col("all")).alias("linked"))
    )


def _matrix(lists: pa.ChunkedArray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sketches as rows of k values, filled up with _PAD, and their lengths."""
    lists = lists.combine_chunks()
    length = lists.value_lengths().to_numpy().astype(np.int64)
    rows = np.full((len(length), k), _PAD, np.int64)
    rows[np.arange(k) < length[:, None]] = lists.flatten().to_numpy()
    return rows, length


def _estimates(one: np.ndarray, two: np.ndarray, k: int) -> np.ndarray:
    """``estimate`` of each row of ``one`` with the same row of ``two``."""
    both = np.sort(np.concatenate([one, two], 1), 1)
    real = both != _PAD
    again = np.zeros_like(real)
    again[:, 1:] = (both[:, 1:] == both[:, :-1]) & real[:, 1:]
    rank = np.cumsum(real & ~again, 1)
    return (again & (rank <= k)).sum(1) / np.maximum(1, np.minimum(rank[:, -1], k))


def _no_share(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Whether a row of ``one`` holds no value of the same row of ``two``."""
    both = np.sort(np.concatenate([one, two], 1), 1)
    return ~((both[:, 1:] == both[:, :-1]) & (both[:, 1:] != _PAD)).any(1)


def _walk(left: pa.Table, right: pa.Table, percent: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of ``left``, rows of ``right``, estimates), by pieces, of the pairs of different components that belong to the
    list they meet in and whose sizes and union sketch allow the threshold.  Both tables are ordered by value."""
    (vx, x, nx, ox), (vy, y, ny, oy) = ([t.column(c).to_numpy() for c in ("value", "doc_id", "n_shingles", "own")] for t in (left, right))
    minor = right.column("minor").to_numpy()
    (px, lx), (py, ly) = _matrix(left.column("sketch"), k), _matrix(right.column("sketch"), k)
    (bx, _), (by, _) = _matrix(left.column("before"), k), _matrix(right.column("before"), k)

    def fits(i, j):
        # Two classes outside the list's largest component meet twice.
        return (ox[i] != oy[j]) & (100 * np.minimum(nx[i], ny[j]) >= percent * np.maximum(nx[i], ny[j])) & (~minor[j] | (x[i] < y[j]))

    def candidates():
        for value in np.unique(vx):
            a0, a1 = np.searchsorted(vx, value, "left"), np.searchsorted(vx, value, "right")
            b0, b1 = np.searchsorted(vy, value, "left"), np.searchsorted(vy, value, "right")
            if (a1 - a0) * (b1 - b0) <= 4096:
                i, j = (g.ravel() for g in np.meshgrid(np.arange(a0, a1), np.arange(b0, b1), indexing="ij"))
                good = fits(i, j)
                yield i[good], j[good]
                continue
            flat, owner = py[b0:b1].ravel(), np.repeat(np.arange(b1 - b0), k)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            js = np.arange(b0, b1)
            for i in range(a0, a1):
                sketch = px[i, : lx[i]]
                low, high = np.searchsorted(flat, sketch, "left"), np.searchsorted(flat, sketch, "right")
                overlap = np.bincount(np.concatenate([owner[p:q] for p, q in zip(low, high)]), minlength=b1 - b0)
                j = js[(overlap >= FLOOR * np.maximum(lx[i], ly[b0:b1])) & fits(i, js)]
                yield np.full(len(j), i), j

    def pieces():
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for pair in candidates():
            held.append(pair)
            if len(pair[0]) >= _ESTIMATED or len(held) >= 256:
                yield [np.concatenate(c) for c in zip(*held)]
                held = []
        if held:
            yield [np.concatenate(c) for c in zip(*held)]

    for i, j in pieces():
        for at in range(0, len(i), _ESTIMATED):
            a, b = i[at : at + _ESTIMATED], j[at : at + _ESTIMATED]
            here = _no_share(bx[a], by[b])
            a, b = a[here], b[here]
            e = _estimates(px[a], py[b], k)
            good = e >= FLOOR
            if good.any():
                yield a[good], b[good], e[good]


_MEMBER = "part long, i int, j int, value long, doc_id long, n_shingles long, own long, minor boolean, sketch array<long>, before array<long>"


def _partnered(percent: int, k: int):
    """The rows of a block with a partner, each with the side on which it has one."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.sort_by("value"), right.sort_by("value")
        met = np.zeros(left.num_rows, bool), np.zeros(right.num_rows, bool)
        if left.num_rows and right.num_rows:
            for a, b, _ in _walk(left, right, percent, k):
                met[0][a], met[1][b] = True, True
        names = [n.strip().split(" ")[0] for n in _MEMBER.split(",")]
        sides = [t.select(names).filter(pa.array(m)) for t, m in zip((left, right), met)]
        return pa.concat_tables([t.append_column("side", pa.array(np.full(t.num_rows, n, np.int32))) for n, t in enumerate(sides)])
    return run


class _Sets:
    """Full sets of a block's rows as ranks of their shingles, for exact intersections of many pairs at once."""

    def __init__(self, *sides: pa.Table):
        lists = [t.column("shingles").combine_chunks() for t in sides]
        values = np.concatenate([c.flatten().to_numpy() for c in lists])
        self.ranks = np.unique(values, return_inverse=True)[1].reshape(-1).astype(np.int64)
        self.size = np.concatenate([c.value_lengths().to_numpy() for c in lists]).astype(np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.top = int(self.ranks.max(initial=0)) + 1

    def _keys(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.size[rows]
        pair = np.repeat(np.arange(len(rows)), size)
        place = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.start[rows], size)
        return pair * self.top + self.ranks[place], pair

    def similar(self, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        (one, _), (two, pair) = self._keys(a), self._keys(b)
        hit = one[np.minimum(np.searchsorted(one, two), len(one) - 1)] == two
        both = np.bincount(pair[hit], minlength=len(a))
        return 100 * both >= percent * (self.size[a] + self.size[b] - both)


def _joined(percent: int, k: int):
    """Links of a block that join its components: pairs from the highest estimate down, unless already joined."""
    def run(block: pa.Table) -> pa.Table:
        side = block.column("side").to_numpy()
        left, right = (block.filter(pa.array(side == n)).sort_by("value") for n in (0, 1))
        out: list[tuple[int, int]] = []
        if left.num_rows and right.num_rows:
            sets, shift = _Sets(left, right), left.num_rows
            owns = np.concatenate([t.column("own").to_numpy() for t in (left, right)])
            root = np.unique(owns, return_inverse=True)[1].reshape(-1)
            ids = np.concatenate([t.column("doc_id").to_numpy() for t in (left, right)])

            def settle(pairs: list) -> None:
                a, b, e = (np.concatenate(c) for c in zip(*pairs))
                order = np.argsort(-e, kind="stable")
                a, b = a[order], b[order] + shift
                at = 0
                while at < len(a):
                    apart = np.flatnonzero(root[a[at:]] != root[b[at:]]) + at
                    now = apart[:_CHECKED]
                    now = now[: max(1, int(np.searchsorted(np.cumsum(sets.size[a[now]] + sets.size[b[now]]), SET_BLOCK)))]
                    if not len(now):
                        break
                    for n in now[sets.similar(a[now], b[now], percent)]:
                        one, two = root[a[n]], root[b[n]]
                        if one != two:
                            root[root == two] = one
                            out.append((int(ids[a[n]]), int(ids[b[n]])))
                    at = int(now[-1]) + 1

            held: list = []
            for piece in _walk(left, right, percent, k):
                held.append(piece)
                if sum(len(h[0]) for h in held) >= _ORDERED:
                    settle(held)
                    held = []
            if held:
                settle(held)
        return pa.table([pa.array([min(p) for p in out], pa.int64()), pa.array([max(p) for p in out], pa.int64())], names=["a", "b"])
    return run


def _sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(doc_id, shingles) of the documents in ``ids``, made from their texts."""
    ids = stage(ids.select("doc_id").distinct(), "ids")
    needed = docs.select(F.col("doc_id").cast("long"), "text").join(ids, "doc_id", "left_semi")
    return stage(needed.mapInArrow(_set_batches(size), "doc_id long, shingles array<long>"), "sets")


def _hub_pairs(hot: DataFrame, hubs: int) -> DataFrame:
    """Each (value, doc_id) of the long lists with the list's hubs."""
    order = [_place(F.col("doc_id"), F.col("value"), F.lit(j)) for j in range(hubs)]
    named = hot.groupBy("value").agg(
        *[F.min(F.struct(o.alias("o"), "doc_id"))["doc_id"].alias(f"h{j}") for j, o in enumerate(order)])
    named = stage(named.select("value", F.array(*[f"h{j}" for j in range(hubs)]).alias("hubs")), "hubs")
    return hot.join(named, "value").select("doc_id", F.explode("hubs").alias("hub")).where("doc_id <> hub").select(
        *_pair(F.col("doc_id"), F.col("hub")))


def near_duplicates(docs: DataFrame, *, size: int = 5, percent: int = 75, k: int = SKETCH, short: int = SHORT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id, text, ...)."""
    every = stage(sketches(docs, size, k), "sketches")
    sig = ["sig1", "sig2", "n_shingles"]
    real = every.where("n_shingles > 0 and doc_id is not null")
    # Classes of equal sets; only those with more than one member need a table.
    classes = stage(real.groupBy(*sig).agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"))
                    .where("rep < last").drop("last"), "classes")
    placed = stage(every.join(classes, sig, "left").select(
        "doc_id", "n_shingles", "sketch", F.when(F.col("n_shingles") > 0, F.coalesce("rep", "doc_id")).alias("rep")), "placed")
    reps = placed.where("doc_id = rep").select("doc_id", "n_shingles", "sketch").dropDuplicates(["doc_id"])
    reps = stage(reps, "reps")

    # Inverted lists, by length.
    posting = reps.select("doc_id", "n_shingles", F.size("sketch").alias("held"), F.explode("sketch").alias("value"))
    lengths = stage(posting.groupBy("value").agg(F.count("*").alias("n")).where("n > 1")
                    .select("value", "n", (F.col("n") > short).alias("long")), "lengths")
    listed = stage(posting.join(lengths, "value").select("doc_id", "n_shingles", "held", "value", "n", "long"), "postings")
    brief = listed.where("not long").groupBy("value").agg(F.collect_list(F.struct("doc_id", "n_shingles")).alias("ids"))
    # Sets whose sizes differ too much can't be similar enough.
    mates = F.expr(f"""filter(ids, y -> x.doc_id < y.doc_id
        and 100 * least(x.n_shingles, y.n_shingles) >= {percent} * greatest(x.n_shingles, y.n_shingles))""")
    met = brief.select(F.explode("ids").alias("x"), "ids").select(F.col("x.doc_id").alias("a"), F.explode(mates).alias("y")).select(
        "a", F.col("y.doc_id").alias("b"))
    keys = listed.where("long").groupBy("doc_id").agg(F.slice(F.sort_array(F.collect_set(F.struct("value", "n"))), 1, HOT_KEYS).alias("keys"))
    hot = stage(keys.select("doc_id", F.explode("keys").alias("key")).select("doc_id", "key.value", "key.n"), "hot-keys")
    sketch_a = reps.select(F.col("doc_id").alias("a"), F.col("sketch").alias("ka"), F.col("n_shingles").alias("na"))
    sketch_b = reps.select(F.col("doc_id").alias("b"), F.col("sketch").alias("kb"), F.col("n_shingles").alias("nb"))

    def similar(pairs: DataFrame) -> DataFrame:
        """Pairs whose sizes and union sketch allow the threshold."""
        return (
            pairs.join(sketch_a, "a")
            .join(sketch_b, "b")
            .where((100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (estimate("ka", "kb", k) >= FLOOR))
            .select("a", "b")
        )

    pairs = met.unionByName(_hub_pairs(hot, HUBS)).distinct()
    found = stage(similar(pairs), "pairs")
    links = stage(_verified(found, _sets(docs, found.select(F.explode(F.array("a", "b")).alias("doc_id")), size), percent), "links")
    links = links.where("linked").select("a", "b")

    # Classes of long lists that are still in different components.  A value in no list comes before all others.
    label = stage(components(links), "labels")
    rare = listed.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("n", "value"))).alias("keys"), F.first("held").alias("held"))
    rare = rare.select("doc_id", F.explode(F.expr("slice(keys, 1, greatest(0, size(keys) - held + held div 2 + 1))")).alias("key"))
    rare = rare.where(F.col("key.n") > short).select("doc_id", "key.value")
    rare = stage(rare.join(label.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").select(
        "value", "doc_id", F.coalesce("component", "doc_id").alias("own")), "rare-keys")
    mixed = rare.groupBy("value", "own").agg(F.count("*").alias("c")).groupBy("value").agg(
        F.max(F.struct("c", "own")).alias("top"), F.sum("c").alias("n"), F.count("*").alias("parts")).where("parts > 1")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    mixed = stage(mixed.select("value", F.col("top.own").alias("most"), blocks(F.col("n")).alias("rows"), blocks(F.col("n") - F.col("top.c")).alias("minors"), "n"), "mixed")
    # Lists of one block share parts of some blocks' size.
    parts = F.lit(int(max(12, -(-(mixed.agg(F.sum("n")).first()[0] or 0) // (4 * BLOCK)))))
    # A class has at most k // 2 + 1 such lists, the longest first.
    key = F.struct("n", "value", "rows", "minors", "most")
    lists = rare.join(mixed, "value").groupBy("doc_id", "own").agg(F.sort_array(F.collect_set(key), False).alias("keys"))
    full = lists.join(reps, "doc_id").select("doc_id", "n_shingles", "sketch", "own", "keys", F.posexplode("keys").alias("at", "key"))
    full = stage(full.select(
        F.when(F.col("key.rows") > 1, F.col("key.value")).otherwise(F.pmod(_place("key.value"), parts)).alias("part"),
        "key.value", "doc_id", "n_shingles", "own", (F.col("own") != F.col("key.most")).alias("minor"), "sketch",
        F.expr("transform(slice(keys, 1, at), x -> x.value)").alias("before"), "key.rows", "key.minors"), "members")
    # Each class outside a list's largest component meets every block of the list.
    columns = [n.strip().split(" ")[0] for n in _MEMBER.split(",")]
    mine = lambda n: F.pmod(_place(F.col("doc_id"), F.lit(n)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = full.where("minor").withColumn("i", mine("minors")).withColumn("j", each("rows")).select(*columns)
    two = full.withColumn("i", each("minors")).withColumn("j", mine("rows")).select(*[F.col(c).alias(c) for c in columns])
    block = ["part", "i", "j"]
    met = stage(one.groupBy(*block).cogroup(two.groupBy(*block)).applyInArrow(_partnered(percent, k), _MEMBER + ", side int"), "partnered")
    # Blocks of bounded size in shingles: each part of one side meets each part of the other.
    cut = lambda n: F.greatest(F.lit(1), F.ceil(F.sum(F.when(F.col("side") == n, F.col("n_shingles"))) / SET_BLOCK)).cast("int")
    cuts = stage(met.groupBy(*block).agg(F.coalesce(cut(0), F.lit(1)).alias("lefts"), F.coalesce(cut(1), F.lit(1)).alias("rights")), "cuts")
    dealt = met.join(cuts, block).join(_sets(docs, met, size).dropDuplicates(["doc_id"]), "doc_id")
    own = lambda n: F.array(F.pmod(_place("doc_id"), F.col(n)).cast("int"))
    all_of = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    dealt = dealt.withColumn("l", F.explode(F.when(F.col("side") == 0, own("lefts")).otherwise(all_of("lefts"))))
    dealt = dealt.withColumn("r", F.explode(F.when(F.col("side") == 1, own("rights")).otherwise(all_of("rights")))).drop("lefts", "rights")
    more = stage(dealt.groupBy(*block, "l", "r").applyInArrow(_joined(percent, k), "a long, b long"), "links")
    # The stars found so far stand for their links.
    label = stage(components(label.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)), "labels")
    label = label.select(F.col("node").alias("rep"), "component")
    component = F.coalesce("component", "rep", "doc_id")
    return placed.join(label, "rep", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are kept: one document of each group, all its columns.

    Rows repeated with the same id are one document and stay together.
    """
    gone = near_duplicates(docs, **options).where("not kept and doc_id is not null").select(F.col("doc_id").alias("id")).distinct()
    return packed(docs).join(gone, "id", "left_anti").select("row.*")
