"""Tree ensembles grown on histograms that Spark sums: second-order boosting and bootstrap forests.

A fit's columns are cut into bins once, and rows are written as blocks of bin numbers. For every tree
level one pass goes over the blocks: each task walks its rows down the trees so far and adds their gradients up per
(node, column, bin); the sums are added in Spark and the driver sees histograms only, whose size follows the
parameters, never the rows. Of two sister nodes only the one with fewer rows is summed, the other is its
parent less it. All fits of a call, such as the folds and candidates of a search, share the blocks
and the passes. Up to ``LOCAL_ROWS`` rows a pass costs more than its work: there every fit is one task that holds all blocks and
grows its trees without the driver. Both ways give the same trees.

Gradients are rounded to a multiple of 2**-20, so sums are exact in any order: the same rows give the same trees on
any cluster and after any retry. Rows and columns are drawn by hashes of seed, tree and key. The scores of the
trees so far are rewritten with the blocks every ``KEEP`` trees; in between a task adds the few trees since.

How trees grow:

- ``level``: every node with a worthwhile split is split; splits whose gain is below ``gamma`` are then pruned from the
  leaves up.
- ``leaf``: of all leaves the one with the best gain is split next, until there are ``leaves``. Gains of a level are
  found together, and the queue then takes from them, which gives the same tree.
- ``symmetric``: one split a level for all its nodes, the one with the largest sum of scores.

Defined cases: null and NaN count as larger than every edge; a column with one value is never split; an empty
table or one without both classes raises ``ValueError``.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, fields

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import hash_order
from ..schema import LABEL
from ..session import SHUFFLE_CLEANUP, delete_folder, new_folder, read_staged, setting, small_table, write_staged
from .features import bin_edges

BLOCK_ROWS = 1 << 16
#: Trees between two rewrites of the rows' scores.
KEEP = 8
#: Partial histograms of all tasks that the driver adds up itself; beyond this Spark adds them first.
DIRECT_BYTES = 64 << 20
#: Rows up to which one task grows an ensemble by itself; its rows take some 60 bytes each there.
LOCAL_ROWS = 1 << 22
#: Histograms that one pass makes.
PASS_BYTES = 256 << 20
_UNIT = float(1 << 20)
#: Row draws: numbers modulo this prime, mixed per tree by a multiplier and a shift.
PRIME = 2147483647
#: Poisson(1) by inversion: a row is drawn as often as its uniform number passes these.
POISSON = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(10)]


@dataclass(frozen=True)
class Rules:
    """How an ensemble grows."""

    rounds: int = 100
    depth: int = 6
    rate: float = 0.1
    growth: str = "level"
    criterion: str = "newton"  # newton, friedman or gini
    rows: float = 1.0  # share of rows drawn for a tree
    columns: float = 1.0  # share of columns drawn for a tree
    node_columns: str | None = None  # sqrt or log2: columns drawn for a node
    positive: float | str = 1.0  # weight of fraud rows; "balanced", or "subsample" for balance within a tree's bootstrap
    l1: float = 0.0
    l2: float = 0.0
    gamma: float = 0.0
    min_hessian: float = 0.0
    min_rows: int = 1
    min_split: int = 2
    leaves: int | None = None
    start: str = "zero"  # or "prior": the log odds of the training rows
    bootstrap: bool = False
    bins: int = 64
    seed: int | str = 42

    @property
    def forest(self) -> bool:
        return self.criterion == "gini"


@dataclass
class Fit:
    """One ensemble to grow: its rules and the fold that it leaves out."""

    rules: Rules
    leave_out: int = -1


@dataclass
class Tree:
    """A tree in heap order: the children of node i are 2 i and 2 i + 1, the root is 1; column -1 marks a leaf."""

    column: list[int]
    bin: list[int]
    value: list[float]
    gain: list[float]
    cover: list[int]


@dataclass
class TreeModel:
    """A fitted ensemble with its input columns and bin edges."""

    name: str
    columns: list[str]
    edges: list[list[float]]
    rules: Rules
    start: float
    trees: list[Tree] = field(default_factory=list)
    #: Rows of the fold that the fit left out: (true positives, false positives, false negatives, true negatives).
    held: tuple[int, int, int, int] | None = None

    @property
    def held_f1(self) -> float:
        tp, fp, fn, _ = self.held
        return 2.0 * tp / max(2 * tp + fp + fn, 1)

    def margin(self, df: DataFrame):
        """Column of the summed (boosting) or averaged (forest) leaf values."""
        packed = _pack(self.trees)
        # The model's size follows its parameters.
        shared = df.sparkSession.sparkContext.broadcast((self.edges, packed, self.start, self.rules.forest))

        @F.pandas_udf("double")
        def total(values: pd.DataFrame) -> pd.Series:
            edges, trees, start, forest = shared.value
            bins = np.vstack([_binned(values.iloc[:, i].to_numpy(float), e) for i, e in enumerate(edges)])
            out = np.full(len(values), start)
            for tree in trees:
                out += tree[2][_leaves(bins, tree)]
            return pd.Series((out - start) / max(len(trees), 1) if forest else out)

        return total(F.struct(*[F.col(c).cast("double") for c in self.columns]))

    def score(self, df: DataFrame) -> DataFrame:
        """Adds ``p`` (fraud probability) and ``prediction`` to the rows."""
        margin = self.margin(df)
        p = F.col("_margin") if self.rules.forest else 1 / (1 + F.exp(-F.col("_margin")))
        return df.select("*", margin.alias("_margin")).select(
            *df.columns, p.alias("p"), F.col("_margin")).select(
            *df.columns, "p", (F.col("p") > 0.5).cast("int").alias("prediction"))

    def native_importance(self, spark: SparkSession) -> DataFrame:
        """(feature, importance): share of the summed gains."""
        total = dict.fromkeys(self.columns, 0.0)
        for tree in self.trees:
            for c, g in zip(tree.column, tree.gain):
                if c >= 0:
                    total[self.columns[c]] += g
        everything = sum(total.values()) or 1.0
        return small_table(spark, [(c, g / everything) for c, g in total.items()], {"feature": "string", "importance": "double"})

    def tree_table(self, spark: SparkSession) -> DataFrame:
        """One row per node: (tree, node, feature, edge, value, gain, cover); feature and edge are null in a leaf."""
        rows = []
        for t, tree in enumerate(self.trees):
            for node in _reached(tree):
                c = tree.column[node]
                name, edge = (None, None) if c < 0 else (self.columns[c], self.edges[c][tree.bin[node]])
                rows.append((t, node, name, edge, tree.value[node], tree.gain[node], tree.cover[node]))
        names = ["tree", "node", "feature", "edge", "value", "gain", "cover"]
        kinds = {"tree": "int", "node": "int", "feature": "string", "edge": "double", "value": "double", "gain": "double", "cover": "bigint"}
        if not rows:
            return small_table(spark, [], kinds)
        return spark.createDataFrame(pd.DataFrame(rows, columns=names).astype({"feature": object}), ", ".join(f"{c} {t}" for c, t in kinds.items()))

    def save(self, path: str) -> None:
        from .models import write_about

        spark = SparkSession.active()
        parts = [(i, json.dumps(asdict(t))) for i, t in enumerate(self.trees)]
        spark.createDataFrame(parts, "tree int, body string").write.mode("overwrite").parquet(f"{path}/trees")
        write_about(path, {"kind": "trees", "name": self.name, "columns": self.columns, "edges": self.edges,
                           "rules": asdict(self.rules), "start": self.start})


def load_trees(spark: SparkSession, path: str, about: dict) -> TreeModel:
    rows = spark.read.parquet(f"{path}/trees").orderBy("tree").collect()  # one row a tree
    return TreeModel(about["name"], about["columns"], about["edges"], Rules(**about["rules"]), about["start"],
                     [Tree(**json.loads(r["body"])) for r in rows])


def _reached(tree: Tree) -> Iterator[int]:
    todo = [1]
    while todo:
        node = todo.pop(0)
        yield node
        if tree.column[node] >= 0:
            todo += [2 * node, 2 * node + 1]


# ---- bins and blocks -------------------------------------------------------------------

def _binned(values: np.ndarray, edges: list[float]) -> np.ndarray:
    """How many edges are below each value; missing values lie above all."""
    bins = np.searchsorted(np.asarray(edges, float), values, side="left")
    return np.where(np.isnan(values), len(edges), bins).astype(np.uint8)


def _pack(trees: list[Tree]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    out = []
    for tree in trees:
        inner = [i for i, c in enumerate(tree.column) if c >= 0]
        depth = max((i.bit_length() for i in inner), default=0)
        out.append((np.array(tree.column, np.int16), np.array(tree.bin, np.int16), np.array(tree.value), depth))
    return out


#: Rows that walk down a tree together: their arrays stay in the processor's cache.
_WALK_ROWS = 1 << 13


def _walked(bins: np.ndarray, column: np.ndarray, cut: np.ndarray, depth: int, rows: np.ndarray | None = None) -> np.ndarray:
    """Heap number of the node where each row (all, or the given ones) is after ``depth`` steps; a leaf is its own child."""
    n = bins.shape[1]
    count = n if rows is None else len(rows)
    out = np.ones(count, np.int64)
    if not depth or not n:
        return out
    flat, inner, nodes = bins.reshape(-1), column >= 0, np.arange(len(column))
    first, limit = np.where(inner, column, 0).astype(np.int64) * n, np.where(inner, cut, 255)
    child = np.repeat(nodes, 2)
    child[np.repeat(inner, 2)] = (2 * nodes[inner][:, None] + np.arange(2)).ravel()
    for start in range(0, count, _WALK_ROWS):
        stop = min(start + _WALK_ROWS, count)
        at, here = out[start:stop], np.arange(start, stop) if rows is None else rows[start:stop]
        for _ in range(depth):
            at = child.take(2 * at + (flat.take(first.take(at) + here) > limit.take(at)))
        out[start:stop] = at
    return out


def _leaves(bins: np.ndarray, tree) -> np.ndarray:
    """Heap number of the node where each row ends."""
    column, cut, _, depth = tree
    return _walked(bins, column, cut, depth)


_BLOCK = "n int, bins binary, y binary, draw binary, fold binary, margin binary"


def _blocks(edges: list[list[float]], starts: list[float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def block():
            table = pa.Table.from_batches(held)
            columns = [table.column(i).to_numpy() for i in range(3, table.num_columns)]
            n = len(table)
            bins = np.vstack([_binned(c.astype(float), e) for c, e in zip(columns, edges)]) if edges else np.zeros((0, n), np.uint8)
            margin = np.repeat(np.array(starts), n)
            values = [n, bins.tobytes(), table.column(0).to_numpy().astype(np.uint8).tobytes(), table.column(1).to_numpy().astype(np.int64).tobytes(),
                      table.column(2).to_numpy().astype(np.int16).tobytes(), margin.tobytes()]
            kinds = [pa.int32(), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], ["n", "bins", "y", "draw", "fold", "margin"])

        for batch in batches:
            for start in range(0, len(batch), BLOCK_ROWS):
                part = batch.slice(start, BLOCK_ROWS)
                held.append(part)
                size += len(part)
                if size >= BLOCK_ROWS:
                    yield block()
                    held, size = [], 0
        if size:
            yield block()
    return run


def draw_number(seed: int | str):
    """Column of the row's number for draws, in [0, PRIME): from the md5 of ``seed|key``."""
    return F.pmod(F.conv(F.substring(hash_order(f"{seed}|rows"), 1, 12), 16, 10).cast("bigint"), F.lit(PRIME))


def mixer(seed: int | str, tree: int) -> tuple[int, int]:
    """Multiplier and shift of a tree's row draws."""
    digest = hashlib.md5(f"{seed}|{tree}".encode()).hexdigest()
    return 1 + int(digest[:12], 16) % (PRIME - 1), int(digest[12:24], 16) % PRIME


def _uniform(draw: np.ndarray, seed: int | str, tree: int) -> np.ndarray:
    a, b = mixer(seed, tree)
    return ((draw * a + b) % PRIME) / PRIME


def _counts(draw: np.ndarray, rules: Rules, tree: int) -> np.ndarray | None:
    """How often each row is in the tree's sample; None for once each."""
    if rules.bootstrap:
        return np.searchsorted(np.array(POISSON), _uniform(draw, rules.seed, tree), side="right")
    return (_uniform(draw, rules.seed, tree) < rules.rows).astype(np.int64) if rules.rows < 1 else None


def drawn_columns(seed: int | str, tree: int, columns: list[str], n: int, node: int | None = None) -> list[int]:
    """The first ``n`` columns in the order of a hash of seed, tree, node and name."""
    order = sorted(range(len(columns)), key=lambda i: hashlib.md5(f"{seed}|{tree}|{node}|{columns[i]}".encode()).hexdigest())
    return sorted(order[:n])


# ---- one pass -----------------------------------------------------------------------------

@dataclass
class _Member:
    """A tree that is growing."""

    fit: int
    tree: int
    weights: tuple[float, float]
    column: np.ndarray
    cut: np.ndarray
    wanted: list[int] = field(default_factory=list)
    # Driver only: histograms and totals by node.
    sums: dict[int, np.ndarray] = field(default_factory=dict)
    best: dict[int, tuple[float, int, int]] = field(default_factory=dict)


def _margins(block: dict, fit: int, n: int, recent: list) -> np.ndarray:
    margin = np.frombuffer(block["margin"], float)[fit * n : (fit + 1) * n].copy()
    bins = np.frombuffer(block["bins"], np.uint8).reshape(-1, n)
    for tree in recent:
        margin += tree[2][_leaves(bins, tree)]
    return margin


def _rounded(x: np.ndarray) -> np.ndarray:
    return np.rint(x * _UNIT)


def _sample(block: dict, rules: Rules, member: _Member, leave_out: int, n: int) -> tuple[np.ndarray, np.ndarray | None]:
    """Rows in the tree's sample, and how often each is."""
    inside = np.frombuffer(block["fold"], np.int16) != leave_out
    counts = _counts(np.frombuffer(block["draw"], np.int64), rules, member.tree)
    if counts is not None:
        inside = inside & (counts > 0)
    rows = np.flatnonzero(inside)
    return rows, None if counts is None or not rules.bootstrap else counts[rows]


#: Cells up to which two columns are counted together.
_PAIR_CELLS = 1 << 15


def _histograms(bins: np.ndarray, rows: np.ndarray, at: np.ndarray, first: np.ndarray, second: np.ndarray, nodes: int, width: int) -> np.ndarray:
    """Sums of both gradients and rows, (3, columns, nodes, bins), of rows at the given nodes.

    While the nodes are few, a pass counts the pairs of two columns' bins, whose margins are both columns' sums; sums are exact in any order.
    """
    n_columns = len(bins)
    got = np.empty((3, n_columns, nodes, width))
    # Rows without a first gradient, most of a forest's, add nothing to it.
    some = np.flatnonzero(first)
    picks = [(some, first[some]) if 2 * len(some) < len(first) else (None, first), (None, second), (None, None)]
    base = at * width
    paired = n_columns - n_columns % 2 if nodes * width * width <= _PAIR_CELLS else 0
    for c in range(0, paired, 2):
        index = (base + bins[c].take(rows)) * width + bins[c + 1].take(rows)
        for i, (part, values) in enumerate(picks):
            both = np.bincount(index if part is None else index[part], values, nodes * width * width).reshape(nodes, width, width)
            got[i, c], got[i, c + 1] = both.sum(axis=2), both.sum(axis=1)
    for c in range(paired, n_columns):
        index = base + bins[c].take(rows)
        for i, (part, values) in enumerate(picks):
            got[i, c] = np.bincount(index if part is None else index[part], values, nodes * width).reshape(nodes, width)
    return got


def _sums(fits: list[Fit], members: list[tuple], recent: dict[int, list], bins_per_column: int, n_columns: int):
    """Histograms (3, columns, bins) of each member's wanted nodes over a task's blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for block in batch.to_pylist():
                n = block["n"]
                bins = np.frombuffer(block["bins"], np.uint8).reshape(-1, n)
                y = np.frombuffer(block["y"], np.uint8)
                margins: dict[int, np.ndarray] = {}
                for m, member in enumerate(members):
                    rules = fits[member.fit].rules
                    rows, counts = _sample(block, rules, member, fits[member.fit].leave_out, n)
                    at = _walked(bins, member.column, member.cut, max(member.wanted).bit_length() - 1, rows)
                    slot = np.full(len(member.column), -1, np.int64)
                    slot[member.wanted] = np.arange(len(member.wanted))
                    at = slot[at]
                    used = at >= 0
                    rows, at = rows[used], at[used]
                    weight = np.where(y[rows] == 1, member.weights[1], member.weights[0])
                    if counts is not None:
                        weight = weight * counts[used]
                    if rules.forest:
                        first, second = weight * y[rows], weight
                    else:
                        if member.fit not in margins:
                            margins[member.fit] = _margins(block, member.fit, n, recent.get(member.fit, []))
                        p = 1 / (1 + np.exp(-margins[member.fit][rows]))
                        first, second = weight * (p - y[rows]), weight * p * (1 - p)
                    first, second = _rounded(first), _rounded(second)
                    got = _histograms(bins, rows, at, first, second, len(member.wanted), bins_per_column)
                    for s, node in enumerate(member.wanted):
                        key, part = (m, node), got[:, :, s]
                        totals[key] = totals[key] + part if key in totals else part.copy()
        keys = list(totals)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([totals[k].tobytes() for k in keys], pa.binary())],
            ["member", "node", "sums"])
    return run


def _added(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(v.as_py()) for v in table.column("sums"))
    return pa.table({"member": table.column("member").slice(0, 1), "node": table.column("node").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})


class _Growth:
    """The state of a call of :func:`grow` on the driver."""

    def __init__(self, blocks: DataFrame, path: str, fits: list[Fit], columns: list[str], edges: list[list[float]], totals: dict):
        self.spark, self.path, self.fits, self.columns, self.edges = blocks.sparkSession, path, fits, columns, edges
        self.blocks = blocks
        self.width = max((len(e) for e in edges), default=0) + 1
        self.tasks = 1
        self.totals = totals
        self.recent: dict[int, list] = {}

    def counts(self, leave_out: int) -> tuple[int, int]:
        return tuple(sum(n for (fold, y), n in self.totals.items() if fold != leave_out and y == k) for k in (0, 1))

    def start(self, fit: Fit) -> float:
        if fit.rules.start != "prior":
            return 0.0
        zeros, ones = self.counts(fit.leave_out)
        return math.log(ones * self.weights(fit)[1] / (zeros * self.weights(fit)[0]))

    def weights(self, fit: Fit) -> tuple[float, float]:
        zeros, ones = self.counts(fit.leave_out)
        if not zeros or not ones:
            raise ValueError("both classes are needed to fit")
        if fit.rules.positive == "balanced":
            # The larger class keeps weight 1.
            most = max(zeros, ones)
            return most / zeros, most / ones
        return 1.0, 1.0 if fit.rules.positive == "subsample" else float(fit.rules.positive)

    def passed(self, members: list[_Member]) -> None:
        """Fills the sums of every member's wanted nodes, a bounded number of histograms a pass."""
        each = 3 * len(self.columns) * self.width * 8
        part, size = [], 0
        for member in members:
            if part and size + each * len(member.wanted) > PASS_BYTES:
                self._pass(part, size)
                part, size = [], 0
            part.append(member)
            size += each * len(member.wanted)
        if part:
            self._pass(part, size)

    def _pass(self, members: list[_Member], size: int) -> None:
        sent = [_Member(m.fit, m.tree, m.weights, m.column, m.cut, m.wanted) for m in members]
        job = _sums(self.fits, sent, {f: self.recent.get(f, []) for f in {m.fit for m in members}}, self.width, len(self.columns))
        sums = self.blocks.mapInArrow(job, "member int, node int, sums binary")
        if size * self.tasks > DIRECT_BYTES:
            sums = sums.groupBy("member", "node").applyInArrow(_added, "member int, node int, sums binary")
        shape = (3, len(self.columns), self.width)
        for row in sums.toArrow().to_pylist():
            member, got = members[row["member"]], np.frombuffer(row["sums"]).reshape(shape)
            member.sums[row["node"]] = member.sums[row["node"]] + got if row["node"] in member.sums else got
        for member in members:
            for node in member.wanted:
                member.sums.setdefault(node, np.zeros(shape))

    def keep_margins(self) -> None:
        """Writes the blocks with the scores of all trees so far."""
        recent, fits = self.recent, len(self.fits)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block in batch.to_pylist():
                    margin = np.concatenate([_margins(block, f, block["n"], recent.get(f, [])) for f in range(fits)])
                    row = {**block, "margin": margin.tobytes()}
                    yield pa.RecordBatch.from_pylist([row], schema=batch.schema)

        path, schema = new_folder(self.spark, "tree-blocks"), self.blocks.schema
        write_staged(self.blocks.mapInArrow(add, _BLOCK), path)
        self.blocks = read_staged(self.spark, path, schema)
        delete_folder(self.spark, self.path)
        self.path, self.recent = path, {}


    def held_out(self, models: list[TreeModel]) -> None:
        """Confusion counts of every fit on its own left-out fold, all in one pass."""
        fits, recent = self.fits, {**self.recent, **{i: _pack(m.trees) for i, m in enumerate(models) if m.rules.forest}}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(fits), 4), np.int64)
            for batch in batches:
                for block in batch.to_pylist():
                    y, fold = np.frombuffer(block["y"], np.uint8), np.frombuffer(block["fold"], np.int16)
                    for i, fit in enumerate(fits):
                        inside = fold == fit.leave_out
                        if not inside.any():
                            continue
                        margin = _margins(block, i, block["n"], recent.get(i, []))
                        yes = margin > len(recent[i]) / 2 if fit.rules.forest else margin > 0
                        total[i] += np.bincount((~yes * 2 + (yes != y))[inside], minlength=4)
            # Told yes and right, yes and wrong, no and right, no and wrong.
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(fits)), pa.int32()), *[pa.array(total[:, c]) for c in range(4)]], ["fit", "tp", "fp", "tn", "fn"])

        counts = self.blocks.mapInArrow(run, "fit int, tp long, fp long, tn long, fn long").groupBy("fit").agg(
            *[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")])
        for fit, *held in counts.collect():  # one row a fit
            if fits[fit].leave_out >= 0:
                models[fit].held = tuple(held)


# ---- splits -----------------------------------------------------------------------------

def _shrunk(g: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0) if l1 else g


def _worth(g: np.ndarray, h: np.ndarray, rules: Rules) -> np.ndarray:
    bottom = h + rules.l2
    return np.divide(_shrunk(g, rules.l1) ** 2, bottom, out=np.zeros_like(g), where=bottom > 0)


def split_gains(sums: np.ndarray, rules: Rules) -> np.ndarray:
    """Gain of a split after each bin (columns, bins); -inf where a side breaks a rule."""
    left = np.cumsum(sums, axis=-1)
    total = left[:, :1, -1:]
    right = total - left
    (gl, hl, nl), (gr, hr, nr) = (left[0] / _UNIT, left[1] / _UNIT, left[2]), (right[0] / _UNIT, right[1] / _UNIT, right[2])
    g, h, n = total[0] / _UNIT, total[1] / _UNIT, total[2]
    if rules.criterion == "newton":
        gain = _worth(gl, hl, rules) + _worth(gr, hr, rules) - _worth(g, h, rules)
    elif rules.criterion == "friedman":
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where((nl > 0) & (nr > 0), nl * nr / (nl + nr) * (gl / nl - gr / nr) ** 2, 0.0)
    else:
        with np.errstate(divide="ignore", invalid="ignore"):
            # Weighted decrease of p (1 - p) times two, by sums of squares.
            side = lambda a, b: np.where(b > 0, (a * a + (b - a) ** 2) / b, 0.0)
            gain = side(gl, hl) + side(gr, hr) - side(g, h)
    allowed = (nl >= max(rules.min_rows, 1)) & (nr >= max(rules.min_rows, 1)) & (n >= rules.min_split)
    if rules.criterion == "newton":
        allowed &= (hl >= rules.min_hessian) & (hr >= rules.min_hessian)
    return np.where(allowed, gain, -np.inf)


#: Smaller gains are rounding.
LEAST_GAIN = 1e-6


def _best(sums: np.ndarray, rules: Rules, allowed: list[int]) -> tuple[float, int, int] | None:
    """(gain, column, bin) of the best split; the first column and bin among equals."""
    gains = split_gains(sums, rules)[allowed]
    at = int(np.argmax(gains))
    c, b = divmod(at, gains.shape[1])
    return (float(gains[c, b]), allowed[c], b) if gains[c, b] > LEAST_GAIN else None


def _value(sums: np.ndarray, rules: Rules) -> float:
    g, h = sums[0, 0].sum() / _UNIT, sums[1, 0].sum() / _UNIT
    if rules.forest:
        return float(g / h) if h else 0.0
    bottom = h + rules.l2
    return float(-_shrunk(np.array(g), rules.l1) / bottom * rules.rate) if bottom > 0 else 0.0


def _symmetric_worth(sums: np.ndarray, rules: Rules) -> np.ndarray:
    """Score of each split for one node of a level: both sides' G^2 / (H + l2), empty sides count nothing."""
    left = np.cumsum(sums, axis=-1)
    right = left[:, :1, -1:] - left
    return _worth(left[0] / _UNIT, left[1] / _UNIT, rules) + _worth(right[0] / _UNIT, right[1] / _UNIT, rules)


def _node_columns(rules: Rules, tree: int, columns: list[str], tree_columns: list[int], node: int) -> list[int]:
    if rules.node_columns is None:
        return tree_columns
    share = {"sqrt": math.sqrt, "log2": math.log2}[rules.node_columns](len(columns))
    chosen = drawn_columns(rules.seed, tree, columns, max(1, int(share)), node)
    return [c for c in chosen if c in set(tree_columns)] or tree_columns[:1]


def _grow_level(members: list[_Member], growth: _Growth) -> list[_Member]:
    """Splits what the wanted nodes' sums allow; members with new nodes to sum."""
    going = []
    for member in members:
        rules = growth.fits[member.fit].rules
        columns = growth.columns
        share = max(1, int(rules.columns * len(columns)))
        tree_columns = drawn_columns(rules.seed, member.tree, columns, share) if rules.columns < 1 else list(range(len(columns)))
        level = member.wanted[0].bit_length() - 1
        nodes = sorted(n for n in member.sums if n.bit_length() - 1 == level)
        found = {}
        if level < rules.depth:
            if rules.growth == "symmetric":
                worth = sum(_symmetric_worth(member.sums[n], rules) for n in nodes)[tree_columns]
                worth[:, -1] = -np.inf
                for i, c in enumerate(tree_columns):
                    worth[i, len(growth.edges[c]):] = -np.inf
                before = sum(float(_worth(s[0, 0].sum() / _UNIT, s[1, 0].sum() / _UNIT, rules)) for s in (member.sums[n] for n in nodes))
                c, b = divmod(int(np.argmax(worth)), worth.shape[1])
                if worth[c, b] - before > LEAST_GAIN:
                    found = {n: (float(worth[c, b] - before) / len(nodes), tree_columns[c], b) for n in nodes}
            else:
                for n in nodes:
                    best = _best(member.sums[n], rules, _node_columns(rules, member.tree, columns, tree_columns, n))
                    if best:
                        found[n] = best
        wanted = []
        for n, (gain, c, b) in found.items():
            member.best[n] = (gain, c, b)
            member.column[n], member.cut[n] = c, b
            left = member.sums[n][2, c, : b + 1].sum()
            wanted.append(2 * n + int(left > member.sums[n][2, c].sum() - left))
        if wanted:
            member.wanted = sorted(wanted)
            going.append(member)
    return going


def _sisters(member: _Member) -> None:
    """The sums of the larger child: its parent's less its sister's."""
    for node in member.wanted:
        member.sums[node ^ 1] = member.sums[node >> 1] - member.sums[node]


def _finished(member: _Member, rules: Rules) -> Tree:
    """The grown nodes as a tree, pruned or taken from the queue."""
    split = dict(member.best)
    if rules.growth == "leaf" and rules.leaves:
        queue, kept = [(-split[1][0], 1)] if 1 in split else [], {}
        while queue and len(kept) + 1 < rules.leaves:
            _, node = heapq.heappop(queue)
            kept[node] = split[node]
            for child in (2 * node, 2 * node + 1):
                if child in split:
                    heapq.heappush(queue, (-split[child][0], child))
        split = kept
    if rules.gamma and rules.growth == "level":
        for node in sorted(split, reverse=True):
            if split[node][0] < rules.gamma and 2 * node not in split and 2 * node + 1 not in split:
                del split[node]
    size = 2 * max(split, default=0) + 2 if split else 2
    tree = Tree([-1] * size, [0] * size, [0.0] * size, [0.0] * size, [0] * size)
    todo = [1]
    while todo:
        node = todo.pop()
        tree.cover[node] = int(member.sums[node][2, 0].sum())
        tree.value[node] = _value(member.sums[node], rules)
        if node in split:
            tree.gain[node], tree.column[node], tree.bin[node] = split[node]
            todo += [2 * node, 2 * node + 1]
    return tree


# ---- one task an ensemble -------------------------------------------------------------------

def _stepped(bins: np.ndarray, column: np.ndarray, cut: np.ndarray, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The nodes of rows a step further down; a leaf is its own child."""
    inner, nodes = column >= 0, np.arange(len(column))
    first, limit = np.where(inner, column, 0).astype(np.int64) * bins.shape[1], np.where(inner, cut, 255)
    child = np.repeat(nodes, 2)
    child[np.repeat(inner, 2)] = (2 * nodes[inner][:, None] + np.arange(2)).ravel()
    return child.take(2 * at + (bins.reshape(-1).take(first.take(at) + rows) > limit.take(at)))


@dataclass
class _Apart:
    """What the splits of a level need to know of a growth."""

    fits: list[Fit]
    columns: list[str]
    edges: list[list[float]]


def _grown_apart(blocks: list[dict], growth: _Apart, weights: tuple[float, float], start: float) -> tuple[list[Tree], tuple[int, int, int, int]]:
    """All trees of the growth's only fit, and its confusion counts on the fold it leaves out.

    Between levels the drawn rows keep their node and gradients, between trees all rows keep their score.
    """
    fit, columns = growth.fits[0], growth.columns
    rules, width, size = fit.rules, max((len(e) for e in growth.edges), default=0) + 1, 2 << fit.rules.depth
    bins = [np.frombuffer(b["bins"], np.uint8).reshape(-1, b["n"]) for b in blocks]
    labels = [np.frombuffer(b["y"], np.uint8) for b in blocks]
    held = [np.flatnonzero(np.frombuffer(b["fold"], np.int16) == fit.leave_out) for b in blocks]
    # A forest's rows have no scores while it grows, so only those of its fold are added up.
    scored = held if rules.forest else [None] * len(blocks)
    margins = [np.full(b["n"] if s is None else len(s), start) for b, s in zip(blocks, scored)]
    done: list[Tree] = []
    for number in range(rules.rounds):
        member = _Member(0, number, weights, np.full(size, -1, np.int16), np.zeros(size, np.int16), [1])
        drawn = [_sample(b, rules, member, fit.leave_out, b["n"]) for b in blocks]
        if rules.positive == "subsample":
            both = sum(np.bincount(y[rows], counts, 2).astype(np.int64)[:2] for y, (rows, counts) in zip(labels, drawn))
            member.weights = tuple(int(both.sum()) / (2 * max(int(n), 1)) for n in both)
        parts = []
        for i, (rows, counts) in enumerate(drawn):
            y = labels[i][rows]
            weight = np.where(y == 1, member.weights[1], member.weights[0])
            if counts is not None:
                weight = weight * counts
            if rules.forest:
                first, second = weight * y, weight
            else:
                p = 1 / (1 + np.exp(-margins[i][rows]))
                first, second = weight * (p - y), weight * p * (1 - p)
            parts.append((rows, np.ones(len(rows), np.int64), _rounded(first), _rounded(second)))
        going = [member]
        while going:
            slot = np.full(size, -1, np.int64)
            slot[member.wanted] = np.arange(len(member.wanted))
            total = np.zeros((3, len(columns), len(member.wanted), width))
            for i, (rows, at, first, second) in enumerate(parts):
                if member.wanted != [1]:
                    # Rows of nodes that weren't split are no longer needed.
                    open_ = member.column[at] >= 0
                    rows, first, second = rows[open_], first[open_], second[open_]
                    at = _stepped(bins[i], member.column, member.cut, rows, at[open_])
                    parts[i] = (rows, at, first, second)
                place = slot[at]
                used = np.flatnonzero(place >= 0)
                total += _histograms(bins[i], rows[used], place[used], first[used], second[used], len(member.wanted), width)
            for s, node in enumerate(member.wanted):
                member.sums[node] = total[:, :, s].copy()
            if member.wanted != [1]:
                _sisters(member)
            going = _grow_level(going, growth)
        tree = _finished(member, rules)
        done.append(tree)
        column, cut, value, depth = _pack([tree])[0]
        for i, some in enumerate(scored):
            margins[i] += value[_walked(bins[i], column, cut, depth, some)]
    told = np.zeros(4, np.int64)
    for i, rows in enumerate(held):
        margin = margins[i] if rules.forest else margins[i][rows]
        yes = margin > len(done) / 2 if rules.forest else margin > 0
        told += np.bincount(~yes * 2 + (yes != labels[i][rows]), minlength=4)
    tp, fp, tn, fn = map(int, told)
    return done, (tp, fp, fn, tn)


def _grow_apart(growth: _Growth, models: list[TreeModel], weights: list[tuple[float, float]]) -> None:
    """Grows every fit in a task of its own, those with the most work first."""
    fits, starts = growth.fits, [m.start for m in models]
    order = sorted(range(len(fits)), key=lambda i: (-fits[i].rules.rounds * fits[i].rules.depth, i))
    columns, edges = growth.columns, growth.edges

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [b for batch in batches for b in batch.to_pylist()]
        if not blocks:
            return
        i = order[blocks[0]["task"]]
        done, held = _grown_apart(blocks, _Apart([fits[i]], columns, edges), weights[i], starts[i])
        bodies = [json.dumps(asdict(t)) for t in done]
        yield pa.RecordBatch.from_arrays(
            [pa.array([i] * (len(bodies) + 1), pa.int32()), pa.array(range(-1, len(bodies)), pa.int32()), pa.array([json.dumps(held), *bodies])], ["fit", "tree", "body"])

    # A task's number is the place of its fit, so no two fits share a task.
    each = F.explode(F.sequence(F.lit(0), F.lit(len(fits) - 1)))
    tasks = growth.blocks.select("n", "bins", "y", "draw", "fold", each.alias("task")).repartitionById(len(fits), F.col("task"))
    found = tasks.mapInArrow(run, "fit int, tree int, body string")
    with setting(growth.spark, SHUFFLE_CLEANUP, "true"):
        rows = found.toArrow().sort_by([("fit", "ascending"), ("tree", "ascending")])  # one row a tree
    for row in rows.to_pylist():
        model = models[row["fit"]]
        if row["tree"] >= 0:
            model.trees.append(Tree(**json.loads(row["body"])))
        elif fits[row["fit"]].leave_out >= 0:
            model.held = tuple(json.loads(row["body"]))


# ---- fitting -------------------------------------------------------------------------------

def _subsample_weights(growth: _Growth, members: list[_Member]) -> dict[int, tuple[int, int]]:
    """Balanced class weights of each tree's own bootstrap: n / (2 n of the class), n counting repeats; the counts."""
    fits, sent = growth.fits, [_Member(m.fit, m.tree, m.weights, m.column, m.cut) for m in members]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(sent), 2), np.int64)
        for batch in batches:
            for block in batch.to_pylist():
                y = np.frombuffer(block["y"], np.uint8)
                for i, m in enumerate(sent):
                    rows, counts = _sample(block, fits[m.fit].rules, m, fits[m.fit].leave_out, block["n"])
                    total[i] += np.bincount(y[rows], counts, 2).astype(np.int64)[:2]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(sent)), pa.int32()), pa.array(total[:, 0]), pa.array(total[:, 1])], ["member", "zeros", "ones"])

    counts = growth.blocks.mapInArrow(run, "member int, zeros long, ones long").groupBy("member").agg(F.sum("zeros"), F.sum("ones"))
    sizes = {i: (zeros, ones) for i, zeros, ones in counts.collect()}  # one row a tree
    for i, both in sizes.items():
        members[i].weights = tuple(sum(both) / (2 * max(n, 1)) for n in both)
    return sizes


def _prepared(df: DataFrame, columns: list[str], fits: list[Fit], label: str, fold: str | None,
              edges: list[list[float]] | None) -> tuple[_Growth, list[float]]:
    """Writes the blocks; the state of a growth and the fits' starting scores."""
    spark = df.sparkSession
    bins = fits[0].rules.bins
    if any(f.rules.bins != bins or f.rules.seed != fits[0].rules.seed for f in fits):
        raise ValueError("fits that share a pass need the same bins and seed")
    if edges is None:
        edges = bin_edges(df, columns, bins)
    folds = F.col(fold).cast("int") if fold else F.lit(0)
    rows = df.select(F.col(label).cast("int").alias("y"), draw_number(fits[0].rules.seed).alias("draw"), folds.alias("fold"),
                     *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    totals = {(r["fold"], r["y"]): r["count"] for r in rows.groupBy("fold", "y").count().collect()}  # one row a fold and class
    path = new_folder(spark, "tree-blocks")
    growth = _Growth(df, path, fits, columns, edges, totals)
    starts = [growth.start(f) if growth.weights(f) else 0.0 for f in fits]
    blocks = rows.mapInArrow(_blocks(edges, starts), _BLOCK)
    write_staged(blocks, path)
    growth.blocks = read_staged(spark, path, blocks.schema)
    growth.tasks = max(1, growth.blocks.rdd.getNumPartitions())
    return growth, starts


def grow(df: DataFrame, columns: list[str], fits: list[Fit], names: list[str] | None = None, label: str = LABEL,
         fold: str | None = None, edges: list[list[float]] | None = None) -> list[TreeModel]:
    """Grows all fits over the same rows; ``fold`` names the column that ``Fit.leave_out`` refers to."""
    growth, starts = _prepared(df, columns, fits, label, fold, edges)
    spark, edges = df.sparkSession, growth.edges
    weights = [growth.weights(f) for f in fits]
    models = [TreeModel((names or ["trees"] * len(fits))[i], columns, edges, f.rules, starts[i]) for i, f in enumerate(fits)]

    if fits and sum(growth.totals.values()) <= LOCAL_ROWS:
        _grow_apart(growth, models, weights)
        delete_folder(spark, growth.path)
        return models

    def member(i: int, tree: int) -> _Member:
        size = 2 << fits[i].rules.depth
        return _Member(i, tree, weights[i], np.full(size, -1, np.int16), np.zeros(size, np.int16), [1])

    done = 0
    while True:
        if done == 0:
            members = [member(i, t) for i, f in enumerate(fits) for t in range(f.rules.rounds if f.rules.forest else min(1, f.rules.rounds))]
            balanced = [m for m in members if fits[m.fit].rules.positive == "subsample"]
            if balanced:
                _subsample_weights(growth, balanced)
        else:
            members = [member(i, done) for i, f in enumerate(fits) if not f.rules.forest and done < f.rules.rounds]
        if not members:
            break
        going = members
        while going:
            growth.passed(going)
            for m in going:
                if m.wanted != [1]:
                    _sisters(m)
            going = _grow_level(going, growth)
        for m in members:
            rules = fits[m.fit].rules
            tree = _finished(m, rules)
            models[m.fit].trees.append(tree)
            m.sums = {}
            if not rules.forest:
                growth.recent.setdefault(m.fit, []).extend(_pack([tree]))
        done += 1
        if done % KEEP == 0 and any(not f.rules.forest and done < f.rules.rounds for f in fits):
            growth.keep_margins()
    if any(f.leave_out >= 0 for f in fits):
        growth.held_out(models)
    delete_folder(spark, growth.path)
    return models


def bootstrap_table(df: DataFrame, rules: Rules, label: str = LABEL) -> DataFrame:
    """(tree, zeros, ones, weight_0, weight_1): size of each tree's bootstrap by class, and the balanced class weights."""
    growth, _ = _prepared(df, [], [Fit(rules)], label, None, [])
    members = [_Member(0, t, (1.0, 1.0), np.zeros(0, np.int16), np.zeros(0, np.int16)) for t in range(rules.rounds)]
    counts = _subsample_weights(growth, members)
    delete_folder(df.sparkSession, growth.path)
    rows = [(t, *counts[t], *m.weights) for t, m in enumerate(members)]
    return small_table(df.sparkSession, rows, {"tree": "int", "zeros": "bigint", "ones": "bigint", "weight_0": "double", "weight_1": "double"})


def root_gains(df: DataFrame, columns: list[str], rules: Rules, label: str = LABEL) -> DataFrame:
    """(feature, edge, gain) of every split that the first tree's root allows."""
    growth, _ = _prepared(df, columns, [Fit(rules)], label, None, None)
    member = _Member(0, 0, growth.weights(growth.fits[0]), np.full(2, -1, np.int16), np.zeros(2, np.int16), [1])
    growth.passed([member])
    delete_folder(df.sparkSession, growth.path)
    gains = split_gains(member.sums[1], rules)
    rows = [(name, float(edge), float(gains[i, b])) for i, name in enumerate(columns) for b, edge in enumerate(growth.edges[i]) if gains[i, b] > -np.inf]
    return small_table(df.sparkSession, rows, {"feature": "string", "edge": "double", "gain": "double"})


#: The parameters of the published presets.
PRESETS = {
    "random_forest": Rules(rounds=80, depth=5, criterion="gini", min_split=25, min_rows=12, node_columns="sqrt", positive="subsample", bootstrap=True),
    "gradient_boosting": Rules(rounds=500, depth=8, rate=0.08, rows=0.85, min_split=5, min_rows=3, node_columns="sqrt", criterion="friedman", start="prior"),
    "xgboost": Rules(rounds=600, depth=9, rate=0.08, rows=0.85, columns=0.85, positive=5.0, min_hessian=2.0, gamma=0.05, l1=0.05, l2=2.0),
    "lightgbm": Rules(rounds=120, depth=4, rate=0.04, columns=0.7, positive=3.0, min_rows=25, min_hessian=1e-3, leaves=20, l1=1.0, l2=3.0,
                      growth="leaf", start="prior"),
    "catboost": Rules(rounds=100, depth=4, rate=0.04, l2=7.0, positive="balanced", growth="symmetric"),
}
#: Published names of the searched parameters.
PARAMETERS = {
    "n_estimators": "rounds", "iterations": "rounds", "max_depth": "depth", "depth": "depth", "learning_rate": "rate",
    "subsample": "rows", "colsample_bytree": "columns", "max_features": "node_columns", "min_child_weight": "min_hessian", "gamma": "gamma",
    "reg_alpha": "l1", "reg_lambda": "l2", "l2_leaf_reg": "l2", "min_child_samples": "min_rows", "min_samples_leaf": "min_rows",
    "min_samples_split": "min_split", "num_leaves": "leaves", "border_count": "bins",
}


def rules_of(name: str, params: dict | None = None, **changes) -> Rules:
    """A preset's rules with published or own parameter names replaced."""
    known = {f.name for f in fields(Rules)}
    values = asdict(PRESETS[name])
    for key, value in {**(params or {}), **changes}.items():
        key = PARAMETERS.get(key, key)
        if key not in known:
            raise ValueError(f"Unknown parameter: {key}")
        if name == "lightgbm" and key == "rows":
            continue  # without a bagging frequency, which the presets don't set, the share has no effect
        values[key] = value
    return Rules(**values)


@dataclass
class TreeTrainer:
    """An unfitted preset, with the interface of the other trainers."""

    name: str
    columns: list[str]
    rules: Rules

    def fit(self, df: DataFrame) -> TreeModel:
        return grow(df, self.columns, [Fit(self.rules)], [self.name])[0]

    def with_params(self, params: dict) -> "TreeTrainer":
        merged = {**asdict(self.rules), **{PARAMETERS.get(k, k): v for k, v in params.items()}}
        return TreeTrainer(self.name, self.columns, rules_of(self.name, merged))


def trainer(name: str, columns: list[str], seed: int | str = 42, **changes) -> TreeTrainer:
    return TreeTrainer(name, columns, rules_of(name, seed=seed, **changes))
