import collections
import hashlib
import itertools
import math
import re

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlens.llm import decontaminate, neighbours, pack, privacy, sketch_dedup

from .helpers import WORDS, changed, docs, prose


# ---- decontamination ------------------------------------------------------------------

def test_seeds_survive_any_three_substitutions():
    for gone in itertools.combinations(range(decontaminate.WINDOW), decontaminate.SUBSTITUTIONS):
        assert any(all(o + m not in gone for m in seed) for seed in decontaminate.SEEDS for o in range(decontaminate.WINDOW - seed[-1]))


def brute_leaks(texts, items, window=13, allowed=3):
    words = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
    found = set()
    for i, t in texts:
        a = words(t)
        for j, u in items:
            b = words(u)
            if not b:
                continue
            w, s = (window, allowed) if len(b) >= window else (len(b), 0)
            if any(sum(x == y for x, y in zip(a[p : p + w], b[q : q + w])) >= w - s for p in range(len(a) - w + 1) for q in range(len(b) - w + 1)):
                found.add((i, j))
    return found


def test_leaks_equal_brute_force(spark):
    items = [(i, prose(1000 + i, 20 + i)) for i in range(8)] + [(20, "five words of an item"), (21, prose(77, 11)), (22, None), (23, ""), (None, prose(5))]
    rows = [(i, prose(i, 50)) for i in range(20)]
    rows += [(100 + i, prose(i, 15) + " " + changed(prose(1000 + i % 8, 20 + i % 8), i, i % 9) + " " + prose(i + 40, 10)) for i in range(30)]
    rows += [(200, prose(1001, 21).upper()), (201, prose(1002, 22).replace(" ", "*** ")), (202, "x five Words of an item."), (203, None), (204, ""), (205, prose(77, 11)),
             (206, prose(1003, 23)[:40]), (207, prose(8, 20000) + " " + prose(1004, 24)), (200, prose(1001, 21))]
    table = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, hash int")
    got = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(docs(spark, rows), table).collect()}
    want = brute_leaks(rows, [x for x in items if x[0] is not None])
    assert got == want and len(want) > 15
    kept = decontaminate.clean(docs(spark, rows), table)
    assert kept.columns == docs(spark, []).columns and {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - {i for i, _ in want}
    assert decontaminate.overlaps(docs(spark, []), table).count() == 0 and decontaminate.overlaps(docs(spark, rows), table.limit(0)).count() == 0


# ---- packing ----------------------------------------------------------------------------

def test_packing_respects_its_constraints(spark):
    rows = [(i, prose(i, 5 + i * 7 % 90), "hot" if i % 3 == 0 else f"s{i % 5}") for i in range(300)]
    rows += [(1000 + i, prose(1, 30), "copies") for i in range(20)] + [(2000, prose(4, 700), None), (2001, None, None), (2002, " ", "x"), (2003, "one", None), (2003, "one", None)]
    got = pack.pack(docs(spark, rows), capacity=100, per_source=3, shard_pieces=80).toPandas()
    lengths = {i: len((t or "").split()) for i, t, *_ in rows}
    assert got.groupby("doc_id").n_words.sum().to_dict() == {**lengths, 2003: 2}
    assert got[got.n_words == 0].bin_id.isna().all() and got[got.n_words > 0].bin_id.notna().all()
    bins = got[got.bin_id.notna()].merge(docs(spark, rows).select("doc_id", "source", F.lower("text").alias("t")).distinct().toPandas(), on="doc_id")
    for _, one in bins.groupby("bin_id"):
        one = one.sort_values("bin_start")
        assert one.n_words.sum() <= 100 and (one.bin_start.to_numpy()[1:] == np.cumsum(one.n_words.to_numpy())[:-1]).all()
        assert one.source.fillna("").value_counts().max() <= 3 and not one.t.duplicated().any()
    assert pack.pack(docs(spark, [])).count() == 0


def test_packing_tells_texts_of_one_id_or_none_apart(spark):
    rows = [(7, prose(1, 410)), (7, prose(2, 410)), (None, prose(3, 410)), (None, prose(4, 410)), (9, prose(5, 205)), (9, prose(6, 205))]
    rows += [(8, prose(7, 30))] * 600
    got = pack.pack(docs(spark, rows), capacity=100, per_source=9).toPandas()
    assert got.groupby("bin_id").n_words.sum().max() <= 100 and got.n_words.sum() == 4 * 410 + 2 * 205 + 600 * 30
    assert not got.duplicated(["doc_id", "row", "copy", "piece"]).any()
    assert sorted(got[got.doc_id == 8]["copy"]) == list(range(1, 601)) and got[got.doc_id == 8].bin_id.nunique() == 600


def test_best_fit_takes_the_tightest_compatible_bin():
    # Residuals 30, 20 and 10 in bins 0-2; the piece of 10 conflicts with the cluster of bin 2 and goes to bin 1.
    placed = pack.best_fit([(70, 0, -1), (80, 1, -1), (90, 2, 5), (10, 3, 5), (30, 4, -1)], 100, 9)
    assert placed == [(0, 0), (1, 0), (2, 0), (1, 80), (0, 70)]


# ---- toxicity -----------------------------------------------------------------------------

def test_neighbours_are_exact():
    rng = np.random.default_rng(1)
    weights = rng.random((500, 40)) * (rng.random((500, 40)) < 0.1)
    weights[weights.sum(axis=1) == 0, 0] = 1
    weights /= np.sqrt((weights**2).sum(axis=1))[:, None]
    weights[100:150] = weights[7]
    ids = rng.permutation(500)
    index = neighbours.Index(ids, (ids % 2).astype(float), weights, np.arange(40, dtype=np.uint64), np.ones(40), 9, 16)
    for q in weights[::23]:
        slots = np.flatnonzero(q)
        rows, cosines = index.nearest(slots, q[slots])
        want = sorted(((-round(float(c), 12), int(i)) for c, i in zip(weights @ q, ids) if c > 0))[:9]
        assert [(-round(float(c), 12), int(i)) for c, i in zip(cosines, index.ids[rows])] == want


def test_toxicity_by_neighbours(spark):
    bad = ["idiot", "schlimmwort", "malapalabra"]
    rows = [(i, prose(i, 30) + (" " + bad[i % 3] + ["", "en", "s"][i % 2] + " " + bad[(i + 1) % 3] if i % 4 == 0 else "")) for i in range(400)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0), "x") for i in range(300)] + [(9999, 1, 1, "x"), (None, 1, 1, "x"), (5, None, None, "x")],
                                   "doc_id long, quality int, toxic int, term string")
    odd = [(1000, None), (1001, ""), (1002, "idiot " * 5000), (3, prose(3, 30))]
    got = neighbours.toxicity(docs(spark, rows + odd), labels).collect()
    held = {r.doc_id: r for r in got if r.doc_id >= 300}
    assert sum((r.predicted == 1) == (i % 4 == 0) for i, r in held.items() if i < 400) >= 97
    assert held[1002].predicted == 1 and held[1000].predicted == held[1001].predicted == 0 and all(0 <= r.score <= 1 for r in got)
    assert len(got) == len(rows) + len(odd) and len(held[1002].neighbours) > 0
    assert {r.score for r in neighbours.toxicity(docs(spark, rows[:5]), labels.limit(0)).collect()} == {0.0}
    assert neighbours.toxicity(docs(spark, []), labels).count() == 0
    kept = neighbours.acceptable(docs(spark, rows), labels)
    assert kept.columns == docs(spark, []).columns and kept.count() < 330


def test_held_out_rows_are_not_learned_from(spark):
    import zlib

    labels = spark.range(100).select(F.col("id").alias("doc_id"), F.lit(1).alias("toxic"))
    assert {r.doc_id for r in neighbours.learnable(labels).collect()} == {i for i in range(100) if zlib.crc32(str(i).encode()) % 3 != 1}


# ---- personal data --------------------------------------------------------------------------

def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


PATTERNS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m, d: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m, d: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m, d: 16 <= len(d) <= 19 and luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m, d: 8 <= len(d) <= 15),
}


def base_spans(text):
    found = []
    for kind, (pattern, stays) in PATTERNS.items():
        found.append([(kind, m.start(), m.end()) for m in re.finditer(pattern, text or "") if stays(m[0], re.sub("[^0-9]", "", m[0]))])
    return found


TRICKY = [
    "a@b.c_x@y.z and first.last+tag@mail.example.co.uk.", "@b.c a@ a@b a@b..c", "é a@b.é ü@x.yz 𝒳 q@w.e", "1.2.3.4.5.6.7.8", "256.1.1.1 1.2.3.4 0001.02.3.255 1.2.3",
    "4111 1111 1111 1111 and 4111-1111-1111-1111 and 41111111111111112", "4111  1111 1111 1111", "+1 (555) 123-4567 +49.30.1234567. +1+2 +12345678 +1234567", "+1 (((((", "x" * 5000 + "@y.z",
    "9" * 20000, "1 " * 20000, "a.b@" * 3000, "+1-" * 3000, "", None, "4111111111111111 4111111111111111", "10.0.0.1" * 3,
]


def test_base_spans_equal_the_patterns(spark):
    rows = list(enumerate(TRICKY)) + [(None, "q@w.e"), (5, TRICKY[5])]
    got = privacy.report(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        spans = base_spans("q@w.e" if r.doc_id is None else TRICKY[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(s) for s in spans]
        listed = ",".join(f"{k}:{a}:{b}" for s in spans for k, a, b in s)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest() and r.spans.startswith(listed)
    assert privacy.report(docs(spark, [])).count() == 0


def test_disclosing_terms_are_found_and_replaced(spark):
    rows = [(i, f"{prose(i, 12)} Reach Zaphodine of unit7 by zed@x.org {prose(i + 50, 12)}") for i in range(6)]
    rows += [(100 + i, prose(200 + i, 40)) for i in range(60)] + [(300 + i, f"{prose(7, 8)} mail solo@y.org {prose(9, 8)}") for i in range(5)] + [(400, None)]
    table = docs(spark, rows)
    found = {r.doc_id: r for r in privacy.find(table).collect()}
    assert {"zaphodine", "unit7"} <= {s.m for s in found[0].term} and not {s.m for s in found[0].term} & set(WORDS)
    assert all(not found[300 + i].term for i in range(5)), "copies of one text are one context"
    clean = {r.doc_id: r for r in privacy.sanitise(table).collect()}
    assert "Reach [TERM] of [NUMBER] by [EMAIL]" in clean[0].text or "[TERM] [TERM] of [NUMBER] by [EMAIL]" in clean[0].text
    assert clean[0].n_chars == len(clean[0].text) and clean[100].text == dict(rows)[100] and clean[400].text is None
    assert privacy.sanitise(table).columns == table.columns and len(clean) == len(rows)


def test_disclosing_terms_go_from_whole_texts_and_other_documents(spark):
    rows = [(i, f"Zaphodine {prose(i, 40)} write to zed@x.org {prose(i + 50, 30)}") for i in range(6)]
    rows += [(100 + i, prose(200 + i, 40)) for i in range(60)] + [(400, "zaphodine alone, zaphodine@other.org too")]
    clean = {r.doc_id: r.text for r in privacy.sanitise(docs(spark, rows)).collect()}
    assert all(clean[i].startswith("[TERM] ") for i in range(6)) and clean[100] == dict(rows)[100]
    assert clean[400] == "[TERM] alone, [EMAIL] too"


def brute_terms(texts, threshold=0.8, support=2, bits=1.0):
    texts = {t or "" for t in texts}
    held, every, n_entity, both = {}, collections.Counter(), collections.Counter(), collections.Counter()
    for t in texts:
        spans = sorted((a, b, k, t[a:b].lower()) for kind in base_spans(t) for k, a, b in kind)
        held = {m[0].lower() for m in regex.finditer(r"[\p{L}\p{N}]++", t) if not any(a <= m.end() and m.start() <= b for a, b, *_ in spans)}
        entities = {(k, m) for _, _, k, m in spans}
        every.update(set(regex.findall(r"[\p{L}\p{N}]++", t.lower())))
        n_entity.update(entities)
        both.update((e, w) for e in entities for w in held if len(w) > 2)
    found = set()
    for (e, w), c in both.items():
        pmi, ic = math.log(len(texts) * c / (every[w] * n_entity[e])), math.log(len(texts) / n_entity[e])
        if c >= support and n_entity[e] >= support and ic > 0 and pmi >= threshold * ic and ic - pmi <= bits * math.log(2) + 1e-9:
            found.add(w)
    return found


def test_disclosing_terms_equal_brute_force(spark):
    rows = [(i, f"Zaphodine {prose(i, 20)} of Unit{i % 3} write to zed@x.org or +1 555 123 456{i % 2} {prose(i + 50, 20)}") for i in range(30)]
    rows += [(100 + i, prose(200 + i, 12) + f" unit{i % 9} rare{i % 40}") for i in range(80)] + [(500 + i, "zaphodine " + prose(9, 20)) for i in range(60)]
    rows += [(600 + i, prose(i, 9) + f" rare{i % 3} 10.0.0.{i % 3}") for i in range(9)] + [(700, None), (None, rows[0][1])]
    want = brute_terms([t for _, t in rows])
    found = privacy.find(docs(spark, rows)).collect()
    assert want and {s.m for r in found for s in r.term} == want
    alone = {s.m for r in privacy.find(docs(spark, [r for r in rows if r[0] not in range(501, 560)])).collect() for s in r.term}
    assert alone == want and "zaphodine" in want, "copies change nothing"


def test_stages_judge_rows_without_id_and_rows_of_one_id(spark):
    leak, dirty, fine = prose(900, 30), prose(901, 30) + " write to me@x.org", prose(902, 30)
    rows = [(None, leak), (None, fine), (1, leak), (1, fine), (2, None), (2, fine)]
    table = docs(spark, rows)
    for name in ("_bad", "_gone", "_id", "_text", "row", "key", "id", "hash", "marks", "clean"):
        table = table.withColumn(name, F.lit("kept"))
    bench = spark.createDataFrame([(1, leak)], "item_id long, text string")
    left = decontaminate.clean(table, bench)
    assert left.columns == table.columns and [r.text for r in left.collect()].count(fine) == 3 and left.count() == 4
    assert all(r["_bad"] == r["row"] == "kept" for r in left.collect())
    toxic = [(i, prose(i, 30)) for i in range(60)] + [(100 + i, prose(100 + i, 30) + " idiot moron" * 3) for i in range(60)]
    labels = spark.createDataFrame([(i, int(i >= 100)) for i, _ in toxic], "doc_id long, toxic int")
    odd = [(None, "idiot moron " * 3), (None, fine), (500, "idiot moron " * 3), (500, fine)]
    table = docs(spark, toxic + odd).withColumn("_bad", F.lit("kept"))
    left = [(r.doc_id, r.text) for r in neighbours.acceptable(table, labels).collect()]
    assert {r for r in odd if r in left} == {(None, fine), (500, fine)} and len(left) == 62
    table = docs(spark, [(None, dirty), (3, dirty), (3, fine)])
    for name in ("_id", "_text", "row", "id", "marks", "clean"):
        table = table.withColumn(name, F.lit("kept"))
    done = privacy.sanitise(table)
    assert done.columns == table.columns and all(r["_text"] == r["clean"] == r["row"] == "kept" for r in done.collect())
    assert sorted(r.text.count("[EMAIL]") for r in done.collect()) == [0, 1, 1] and done.where(F.col("text") == fine).count() == 1
    near = docs(spark, [(1, fine), (2, fine), (3, leak)]).withColumn("_gone", F.lit(1)).withColumn("id", F.lit(1)).withColumn("row", F.lit(1))
    kept = sketch_dedup.keep_one(near)
    assert kept.columns == near.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]


# ---- the pipeline -----------------------------------------------------------------------------

@pytest.fixture(scope="module")
def small_sf(spark, tmp_path_factory):
    """Tables with planted cases: toxic documents, near copies, a leak, personal data, odd rows."""
    folder = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, prose(i, 60), "s") for i in range(60)] + [(100 + i, prose(100 + i, 50) + " idiot moron" * 2, "t") for i in range(40)]
    rows += [(200 + i, changed(prose(5, 60), i, 1), "n") for i in range(4)] + [(300, prose(300, 20) + " " + prose(900, 30), "b"), (301, "write to me@x.org now please friends", "p"), (302, None, None)]
    docs(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, prose(900, 30))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(100 <= i < 140)) for i in [*range(60), *range(100, 130)]], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows


def test_stages_take_their_decisions(spark, small_sf):
    folder, rows = small_sf
    table, kept = spark.read.parquet(f"{folder}/documents.parquet"), {i for i, *_ in rows}
    for name, function in corpus_pipeline.STAGES[:-1]:
        table = function(spark, table, folder)
        assert table.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        left = {r.doc_id for r in table.collect()}
        gone = kept - left
        assert gone == {"toxicity": set(range(100, 140)), "near_dedup": {200, 201, 202, 203}, "decontamination": {300}, "pii": set()}[name]
        kept = left
    assert "[EMAIL]" in table.where("doc_id = 301").first().text
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()} == kept
