import collections
import hashlib
import random
import re

import pytest

from ledgerlens.llm import sketch_dedup, substring_dedup
from ledgerlens.llm.components import components
from ledgerlens.llm.suffix_order import suffix_array

from .helpers import changed, docs, prose


def shingles(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    low = {i: i for i, _ in sets}
    moved = True
    while moved:
        moved = False
        for a, sa in sets:
            for b, sb in sets:
                if sa and sb and low[a] < low[b] and 100 * len(sa & sb) >= 75 * len(sa | sb):
                    low[b] = low[a]
                    moved = True
    return {i: (len(s), low[i]) for i, s in sets}


def corpus():
    rows = [(i, prose(i, 40 + i % 30)) for i in range(40)]
    rows += [(100 + i, changed(prose(1, 120), i, 1 + i % 6)) for i in range(30)]  # a large group of near copies
    rows += [(200 + i, prose(500, 25) + " " + prose(600 + i, 60)) for i in range(20)]  # a passage that many share
    rows += [(300 + i, prose(3, 43)) for i in range(12)]  # copies
    rows += [(400, None), (401, ""), (402, " \n\t "), (403, "Two words"), (404, "two WORDS"), (405, "ÄÖ two"), (406, prose(9, 30000))]
    return rows


def test_near_duplicates_equal_brute_force(spark):
    rows = corpus()
    got = sketch_dedup.near_duplicates(docs(spark, rows)).collect()
    want = brute_components(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(rows)


def test_near_duplicates_of_odd_rows(spark):
    rows = [(1, prose(1)), (1, prose(1)), (None, prose(1)), (None, None), (2, prose(1) + " more")]
    got = sorted(map(tuple, sketch_dedup.near_duplicates(docs(spark, rows)).collect()), key=repr)
    assert [r[2] for r in got if r[0] in (1, 2)] == [1, 1, 1] and all(r[3] for r in got if r[0] is None)
    assert sketch_dedup.near_duplicates(docs(spark, [])).count() == 0
    kept = sketch_dedup.keep_one(docs(spark, rows))
    assert kept.columns == docs(spark, []).columns and sorted(repr(r.doc_id) for r in kept.collect()) == ["1", "1", "None", "None"]


def test_components_of_a_chain_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3), (50, 49)]
    got = dict(map(tuple, components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    assert all(got[i] == 1 for i in range(1, 41)) and all(got[100 + i] == 100 for i in range(30)) and got[50] == 49
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("symbols", [1, 2, 4, 200])
def test_suffix_order(symbols):
    rng = random.Random(symbols)
    for n in [*range(12), 50, 200]:
        text = [rng.randrange(symbols) for _ in range(n)]
        assert suffix_array(text) == sorted(range(n), key=lambda i: text[i:])


def brute_removed(rows, span=100):
    seen, out = set(), {}
    for i, text in sorted(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for a in range(len(data) - span + 1):
            window = data[a : a + span]
            if window in seen:
                gone[a : a + span] = b"\1" * span
            seen.add(window)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out[i] = (len(data), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def test_removed_substrings_equal_brute_force(spark):
    passage, line = prose(7, 70), "All rights reserved; this line is repeated on very many pages of the site, at the same place, word by word."
    rows = [(i, prose(i, 30) + (passage if i % 3 == 0 else "") + prose(50 + i, 20) + line + prose(90 + i, 5)) for i in range(40)]
    rows += [(100 + i, prose(2, 200)) for i in range(5)]
    rows += [(200 + i, changed(prose(3, 150), i, 1 + i)) for i in range(8)]
    rows += [(300, "a" * 1000), (301, "ab" * 300), (302, None), (303, ""), (304, "é" * 120), (305, passage * 3), (306, "x" * 99), (307, "x" * 99), (308, prose(1, 9000) + passage)]
    got = {r.doc_id: tuple(r)[1:] for r in substring_dedup.dedup(docs(spark, rows)).collect()}
    assert got == brute_removed(rows)


def test_removed_substrings_of_odd_rows(spark):
    text = prose(1, 60)
    got = substring_dedup.dedup(docs(spark, [(1, text), (1, text), (None, text), (2, "short")]), keep_text=True).collect()
    found = collections.Counter((r.doc_id, r.n_removed) for r in got)
    assert found == {(1, 0): 1, (None, len(text)): 1, (2, 0): 1}
    assert {r.doc_id: bytes(r.kept) for r in got}[2] == b"short"
    assert substring_dedup.dedup(docs(spark, [])).count() == 0


def test_different_texts_with_one_id_or_none_keep_their_rows(spark):
    a, b, c = sorted(prose(i, 60) for i in (1, 2, 3))
    rows = [(None, a), (None, b), (None, a), (5, b), (5, c), (5, c), (7, a), (None, None), (6, "é" + c)]
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_removed) for r in substring_dedup.dedup(docs(spark, rows)).collect())
    size = {x: len(x.encode()) for x in (a, b, c)}
    assert got == {(5, size[b], 0): 1, (5, size[c], 0): 1, (6, size[c] + 2, size[c]): 1, (7, size[a], 0): 1,
                   (None, size[a], size[a]): 1, (None, size[b], size[b]): 1, (None, 0, 0): 1}


def swapped(words, places):
    return " ".join(f"swap{places[0]}x{i}" if i in places else w for i, w in enumerate(words))


def test_links_within_a_large_group_of_near_copies(spark):
    # Edited documents 0.6 to 0.75 similar to all of the group, and linked only to a bridge each.
    base = prose(1, 200).split(" ")
    rows = [(1000 + i, swapped(base, [i])) for i in range(200)]
    for g in range(6):
        far = list(range(5 + g, 200, 25))
        rows += [(10 + g, swapped(base, far)), (100 + g, swapped(base, far[:4]))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in sketch_dedup.near_duplicates(docs(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_families_that_share_long_passages(spark):
    # Every list is long; unrelated documents share most of the sketch, so that few hubs are of one's own family.
    passage = prose(2, 120)
    rows = [(1000 + i, passage + " " + prose(5000 + i, 40 + i % 40)) for i in range(250)]
    for f in range(12):
        own = prose(7000 + f, 100)
        rows += [(f * 20 + i, passage + " " + changed(own, i, 2)) for i in range(14)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in sketch_dedup.near_duplicates(docs(spark, rows)).collect()}
    assert got == brute_components(rows)
