"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

Fit.  A bounded sample of labelled documents (``examples`` of them, in hash order of doc_id, so the same on any
cluster) becomes the example index.  Terms are lower-cased words and their first 4 and 5 letters, which
catch inflected forms.  The index keeps the ``terms`` most telling ones (highest chi-square against
the label over the sample; ties by hash) with weight (1 + ln tf) * ln((1 + N) / (1 + df)) where the
document frequency df is counted over *all* documents and the inverse is floored at a small positive value.

Index.  Examples are cut into blocks of ``block`` rows; for each term and block the largest normalised
weight is kept.  The sum of query weight times block maximum bounds every cosine in a block, so blocks
are visited by falling bound until the bound is below the k-th best cosine: the neighbours are exact.

Score.  Votes of the k neighbours are weighted by their cosine (distance-weighted); a small fixed weight goes to
the share of toxic examples without any index term.  The vote is calibrated by a
monotone table fitted on a second part of the labelled sample.  A document without index terms gets
the share of toxic examples without index terms.

Defined cases: null or empty texts have no terms and get that share; no labelled rows at all give
score 0 everywhere; labels other than 0 and 1 are ignored; a document with two labels counts as toxic if any
label is 1; repeated rows are scored each; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .decontaminate import _lowered
from .text import PUNCT, hash_spans, slices, word_spans

EXAMPLES, CALIBRATION = 6000, 3000
TERMS, NEIGHBOURS, BLOCK = 512, 15, 64
PRIOR = 0.2
PREFIXES = (4, 5)
REJECT = 0.7


def _terms(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, term hash) of all words and word beginnings."""
    data = _lowered(data)
    starts, ends, at = word_spans(data, bounds, PUNCT)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(at))
    hashes, owners = [hash_spans(data, starts, ends)], [text]
    for n in PREFIXES:
        long = np.flatnonzero(ends - starts > n)
        hashes.append(hash_spans(data, starts[long], starts[long] + n) ^ np.uint64(n))
        owners.append(text[long])
    return np.concatenate(owners), np.concatenate(hashes)


def _counted(text: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, count), ordered by text and term."""
    order = np.lexsort((term, text))
    text, term = text[order], term[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (term[1:] != term[:-1])
    first = np.flatnonzero(new)
    return text[first], term[first], np.diff(np.append(first, len(text)))


def _term_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, _, data, bounds in slices(batch.column(1)):
            text, term, count = _counted(*_terms(data, bounds))
            each = np.arange(len(bounds) - 1)
            text, term = np.append(text, each), np.append(term, np.zeros(len(each), np.uint64))
            count = np.append(count, np.zeros(len(each), np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(text + row)), pa.array(term.view(np.int64)), pa.array(count.astype(np.int64))],
                ["doc_id", "term", "tf"])


def _frequency_batches(vocabulary: np.ndarray):
    """Per task: in how many rows each index term occurs, and the number of rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(len(vocabulary), np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for _, _, data, bounds in slices(batch.column(0)):
                text, term = _terms(data, bounds)
                slot = np.searchsorted(vocabulary, term)
                slot[slot == len(vocabulary)] = 0
                hit = vocabulary[slot] == term
                pairs = np.unique(text[hit].astype(np.int64) * len(vocabulary) + slot[hit])
                total += np.bincount(pairs % len(vocabulary), minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(np.arange(len(vocabulary)), -1)), pa.array(np.append(total, rows))], ["slot", "n"])
    return run


class Index:
    """Normalised example vectors in blocks, with the largest weight of each term in each block."""

    def __init__(self, ids, labels, weights, vocabulary, idf, k, block):
        # Similar examples share blocks, so that bounds are tight: order by the heaviest terms.
        order = np.lexsort(tuple(np.argsort(-weights, axis=1)[:, :2].T[::-1])) if len(weights) else np.zeros(0, np.int64)
        self.ids, self.labels, self.weights = ids[order], labels[order], np.ascontiguousarray(weights[order])
        self.vocabulary, self.idf, self.k, self.block = vocabulary, idf, k, block
        n = -(-len(ids) // block)
        padded = np.zeros((n * block, len(vocabulary)), np.float64)
        padded[: len(ids)] = self.weights
        self.most = padded.reshape(n, block, -1).max(axis=1) if n else padded.reshape(0, len(vocabulary))
        self.by_term = np.ascontiguousarray(self.most.T)

    def nearest(self, slots: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, cosines) of the k best examples with positive cosine; ties to smaller doc_id."""
        bounds = weight @ self.by_term[slots]
        rows, cosines, least = np.zeros(0, np.int64), np.zeros(0), 0.0
        for b in np.argsort(-bounds, kind="stable"):
            if bounds[b] <= 0 or bounds[b] < least - 1e-12:
                break
            a = b * self.block
            cosine = self.weights[a : a + self.block][:, slots] @ weight
            hit = np.flatnonzero((cosine > 0) & (cosine >= least - 1e-12))
            rows, cosines = np.append(rows, hit + a), np.append(cosines, cosine[hit])
            if len(rows) > self.k:
                best = np.lexsort((self.ids[rows], -np.round(cosines, 12)))[: self.k]
                rows, cosines = rows[best], cosines[best]
                least = cosines.min()
        best = np.lexsort((self.ids[rows], -np.round(cosines, 12)))
        return rows[best], cosines[best]

    def vectors(self, data: np.ndarray, bounds: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(slots, normalised weights) of each text."""
        text, term = _terms(data, bounds)
        slot = np.searchsorted(self.vocabulary, term)
        slot[slot == len(self.vocabulary)] = 0
        hit = self.vocabulary[slot] == term if len(self.vocabulary) else np.zeros(len(term), bool)
        text, slot, tf = _counted(text[hit], slot[hit])
        weight = (1 + np.log(tf)) * self.idf[slot] if len(slot) else np.zeros(0)
        at = np.searchsorted(text, np.arange(len(bounds)))
        out = []
        for i in range(len(bounds) - 1):
            w = weight[at[i] : at[i + 1]]
            out.append((slot[at[i] : at[i + 1]], w / np.sqrt(w @ w) if len(w) else w))
        return out

    def vote(self, slots: np.ndarray, weight: np.ndarray, base: float) -> tuple[float, np.ndarray, np.ndarray]:
        rows, cosines = self.nearest(slots, weight)
        if not len(rows):
            return base, rows, cosines
        return float((cosines @ self.labels[rows] + PRIOR * base) / (cosines.sum() + PRIOR)), rows, cosines


def _score_batches(index: Index, base: float, knots: tuple[np.ndarray, np.ndarray]):
    known: dict[bytes, tuple] = {}  # equal vectors get equal answers; emptied when large

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, bounds in slices(batch.column(1)):
                votes, evidence, cosines = [], [], []
                for slots, weight in index.vectors(data, bounds):
                    key = slots.tobytes() + weight.tobytes()
                    if key not in known:
                        if len(known) > 50_000:
                            known.clear()
                        vote, rows, near = index.vote(slots, weight, base) if len(slots) else (base, np.zeros(0, np.int64), np.zeros(0))
                        known[key] = (vote, index.ids[rows].tolist(), near.tolist())
                    vote, ids, near = known[key]
                    votes.append(vote)
                    evidence.append(ids)
                    cosines.append(near)
                score = np.interp(votes, *knots) if len(knots[0]) else np.array(votes, float)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, end - row), pa.array(np.clip(score, 0, 1), pa.float64()),
                     pa.array(evidence, pa.list_(pa.int64())), pa.array(cosines, pa.list_(pa.float64()))],
                    ["doc_id", "score", "neighbours", "cosines"])
    return run


def _monotone(votes: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of a rising calibration from vote to share of label 1 (pooled adjacent violators, one count of prior)."""
    if not len(votes):
        return np.zeros(0), np.zeros(0)
    pools: list[list[float]] = []
    for v in np.unique(np.round(votes, 2)):
        inside = labels[np.round(votes, 2) == v]
        pools.append([v * len(inside), float(inside.sum()), float(len(inside))])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    p = np.array(pools)
    return p[:, 0] / p[:, 2], p[:, 1] / p[:, 2]


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", examples: int = EXAMPLES, calibration: int = CALIBRATION,
        terms: int = TERMS, k: int = NEIGHBOURS, block: int = BLOCK) -> tuple[Index, float, tuple[np.ndarray, np.ndarray]]:
    """(index, score without terms, calibration knots); at most examples + calibration labelled texts are read to fit."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(
        "doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    order = F.xxhash64("doc_id")
    chosen = stage(known.select("doc_id", "label", order.alias("h")).orderBy("h", "doc_id").limit(examples + calibration), "examples")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
    counted = stage(texts.mapInArrow(_term_batches, "doc_id long, term long, tf long").groupBy("doc_id", "term").agg(
        F.max("tf").alias("tf")), "terms")
    # Each text has a row with term 0: labelled ids without a text don't count.
    part = chosen.join(counted.where("term = 0").select("doc_id"), "doc_id", "left_semi").toPandas().sort_values(["h", "doc_id"])
    # Where there are few labelled rows, a third of them still calibrates.
    fitted = set(part["doc_id"][: min(examples, len(part) - len(part) // 3)].tolist())
    truth = dict(zip(part["doc_id"].tolist(), part["label"].tolist()))
    n, positive = len(fitted), sum(truth[i] for i in fitted)
    split = chosen.select("doc_id", "label").where(F.col("h") <= (int(part["h"].iloc[n - 1]) if n else 0))
    # Chi-square of each term against the label, from a 2 x 2 table of documents.
    seen = counted.join(F.broadcast(split), "doc_id").groupBy("term").agg(
        F.count("*").cast("double").alias("n"), F.sum("label").cast("double").alias("p"))
    expected = F.col("n") * F.lit(positive / max(n, 1))
    spread = expected * F.lit(1 - positive / max(n, 1)) * (1 - F.col("n") / F.lit(max(n, 1) + 1.0))
    best = seen.where("n >= 3").select("term", (F.pow(F.col("p") - expected, 2) / spread).alias("chi")).where("chi > 10").orderBy(
        F.desc("chi"), "term").limit(terms).select("term")
    vocabulary = np.sort(np.array([r[0] for r in best.collect()], np.int64).view(np.uint64))
    if len(vocabulary):
        frequency = docs.select("text").mapInArrow(_frequency_batches(vocabulary), "slot long, n long").groupBy("slot").agg(
            F.sum("n").alias("n")).collect()
    else:
        frequency = []
    df, rows = np.zeros(len(vocabulary)), 0
    for slot, count in frequency:
        if slot < 0:
            rows = count
        else:
            df[slot] = count
    idf = np.maximum(np.log((1 + rows) / (1 + df)), 0.01)
    inside = counted.where(F.col("term").isin([int(t) for t in vocabulary.view(np.int64)])).toPandas() if len(vocabulary) else counted.limit(0).toPandas()
    ids = np.array(sorted(truth), np.int64)
    weights = np.zeros((len(ids), len(vocabulary)))
    if len(inside):
        slot = np.searchsorted(vocabulary, inside["term"].to_numpy().view(np.uint64))
        weights[np.searchsorted(ids, inside["doc_id"].to_numpy()), slot] = (1 + np.log(inside["tf"].to_numpy())) * idf[slot]
    norm = np.sqrt((weights ** 2).sum(axis=1))
    weights[norm > 0] /= norm[norm > 0, None]
    label_of = np.array([truth[i] for i in ids.tolist()], np.float64)
    train = np.array([i in fitted for i in ids.tolist()], bool)
    empty = train & (norm == 0)
    base = float((label_of[empty].sum() + (positive / n if n else 0.0)) / (empty.sum() + 1)) if len(ids) else 0.0
    index = Index(ids[train & (norm > 0)], label_of[train & (norm > 0)], weights[train & (norm > 0)], vocabulary, idf, k, block)
    held_rows = np.flatnonzero(~train)
    votes = np.array([index.vote(np.flatnonzero(weights[i]), weights[i][weights[i] > 0], base)[0] if norm[i] > 0 else base
                      for i in held_rows])
    return index, base, _monotone(votes, label_of[held_rows])


def toxicity(docs: DataFrame, labels: DataFrame, *, threshold: float = REJECT, **options) -> DataFrame:
    """(doc_id, score, predicted, neighbours, cosines) for each row of ``docs``; ``labels`` are the rows to learn from."""
    index, base, knots = fit(docs, labels, **options)
    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        _score_batches(index, base, knots), "doc_id long, score double, neighbours array<long>, cosines array<double>")
    return scored.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "neighbours", "cosines")


def learnable(labels: DataFrame) -> DataFrame:
    """Labelled rows outside the held-out fold: crc32 of the id as text, modulo 3, is not 1."""
    return labels.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)


def _keep_batches(score, threshold: float):
    """The rows of each batch whose ``text`` scores below the threshold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                text = batch.column(batch.schema.get_field_index("text"))
                asked = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), text], ["doc_id", "text"])
                scores = np.concatenate([b.column(1).to_numpy() for b in score(iter([asked]))])
                yield batch.filter(pa.array(scores < threshold))
    return run


def acceptable(docs: DataFrame, labels: DataFrame, *, threshold: float = REJECT, **options) -> DataFrame:
    """The rows of ``docs`` that are not rejected, all columns.

    A row's own text decides, so rows without an id or with a repeated one are judged one by one, without a join.
    """
    index, base, knots = fit(docs, labels, **options)
    return docs.mapInArrow(_keep_batches(_score_batches(index, base, knots), threshold), docs.schema)
