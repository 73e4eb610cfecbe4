import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerlens.llm import resample, token_alignment, token_counts
from ledgerlens.llm.units import Pieces, spelled, units

from .helpers import docs, prose

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")

ODD = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "a\n", "\na", "a \nb", "a\n b", "a\n\nb", "a  b   c", "tab\tand\x0b more", "a\r\nb; \r\n c", "x();\r\ny",
    "don't WON'T it's 12,345.67", "<s> </s> <unk> <|endoftext|> <0x0A>", "▁mark ▁ in▁side", "x▁ y", "nul\x00in", "zażółć gęślą jaźń", "日本語のテキスト と 漢字",
    "emoji 😀😀 👩‍👩‍👧 flag", "nbsp here   em", "\x1cfile sep\x1d", "base64" * 300, "é" * 500, "ﬁ ① Ａ", "a" + " " * 100 + "b", "\n" * 50, "| a | b |\n| - | - |\n| 1 | 2 |",
]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    alphabet = list("ab  \n\n\t\r.,;()'12é漢▁😀") + ["the ", "word", " {\r", "  "]
    out = [(i, t) for i, t in enumerate(ODD)]
    out += [(100 + i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 120))).replace("▁", "▁" if i % 3 else "_")) for i in range(600)]
    out += [(800 + i, prose(i, 40)) for i in range(30)] + [(900, prose(1, 20000)), (901, prose(2, 40)), (901, prose(2, 40)), (901, "another"), (None, prose(3, 9)), (None, None)]
    return out


def test_cuts_keep_the_tokens():
    assert Pieces(B).divisible
    assert units("a b\nc") == ["a", "b", "\nc"] and units(" a \nb ") == ["  a", " \nb", " "]
    for text in ODD:
        if text:
            assert "".join(map(spelled, units(text))) == " " + text


# ---- token counts ---------------------------------------------------------------------------

def brute_counts(rows):
    model = sentencepiece.SentencePieceProcessor(model_file=B)
    return Counter((i, len((t or "").encode()), n := len(model.encode(t or "")), n > 64) for i, t in rows)


@pytest.mark.parametrize("held", [None, 3])
def test_token_counts_equal_the_library(spark, rows, monkeypatch, held):
    if held:  # tiny summaries, tables and caches
        for name in ("SUMMARY", "HELD", "LAST"):
            monkeypatch.setattr(token_counts, name, held)
    got = token_counts.token_counts(docs(spark, rows).repartition(7), B, limit=64)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert Counter(map(tuple, got.collect())) == brute_counts(rows)
    assert token_counts.token_counts(docs(spark, []), B).count() == 0


def test_frequent_units_are_found_over_all_tasks(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "SUMMARY", 20)
    rows = [(i, "often seen " + prose(i, 30).replace("ba", str(i))) for i in range(200)]
    assert {"often", "seen"} <= set(token_counts.frequent(docs(spark, rows).repartition(9), B))


# ---- resampling -------------------------------------------------------------------------------

def test_crc_of_spans():
    data = np.frombuffer(("short " + "long" * 30 + " é漢 x").encode(), np.uint8)
    starts = np.array([0, 6, 6, 127, 5])
    ends = np.array([5, 126, 38, 132, 5])
    assert resample.crc_spans(data, starts, ends).tolist() == [zlib.crc32(data[s:e].tobytes()) for s, e in zip(starts, ends)]


def brute_resample(rows, target, runs, buckets, percent, least):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return [zlib.crc32(" ".join(w[i : i + r]).encode()) % buckets for r in range(1, runs + 1) for i in range(len(w) - r + 1)], len(w)
    corpus, aim = Counter(), Counter()
    for _, t in rows:
        corpus.update(features(t)[0])
    for _, t in target:
        aim.update(features(t)[0])
    s, t = sum(corpus.values()), sum(aim.values())
    gain = lambda b: math.floor(1000 * math.log((aim[b] + 1.0) * (s + buckets) / ((corpus[b] + 1.0) * (t + buckets))))
    out = []
    for i, text in rows:
        f, words = features(text)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), words])
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], math.inf if r[0] is None else r[0]))
    need = percent * len(able) // 100
    return sorted((r[3], -1 if r[0] is None else r[0]) for r in able[:need]), Counter(tuple(r[:4]) for r in out), need


@pytest.mark.parametrize(("runs", "buckets", "percent"), [(1, 10_000, 10), (2, 64, 35), (1, 1, 100), (3, 50, 0)])
def test_resampling_equals_brute_force(spark, rows, runs, buckets, percent):
    target = [(i, prose(900 + i, 30)) for i in range(5)] + [(9, None), (None, "MINUS kaban, dorfel")]
    many = rows + [(7000, prose(7, 25))] * 40
    got = resample.resample(docs(spark, many).repartition(5), docs(spark, target), runs=runs, buckets=buckets, percent=percent, least_words=5).toPandas()
    drawn, every, need = brute_resample(many, target, runs, buckets, percent, 5)
    assert list(got.columns) == ["doc_id", "n_features", "weight", "score", "rank"]
    plain = [tuple(None if v != v else int(v) for v in r) for r in got.itertuples(index=False, name=None)]
    assert Counter(r[:4] for r in plain) == every
    chosen = sorted((r for r in plain if r[4] is not None), key=lambda r: r[4])
    assert [r[4] for r in chosen] == list(range(1, need + 1))
    assert sorted((r[3], -1 if r[0] is None else r[0]) for r in chosen) == drawn
    order = [(-r[3], math.inf if r[0] is None else r[0]) for r in chosen]
    assert order == sorted(order)


def test_ranks_over_many_ranges_and_empty_tables(spark):
    table = spark.range(1000).select(F.col("id").alias("row"), (F.col("id") % 7).alias("score"))
    got = resample.ranked(table, [-F.col("score"), F.col("row")], 1000, range_rows=90).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 1001))
    assert [(r["score"], r["row"]) for r in got] == sorted(((i % 7, i) for i in range(1000)), key=lambda x: (-x[0], x[1]))
    for need in (0, 1, 142, 143, 144, 999, 1000):
        assert table.where(resample.first_rows(table, [-F.col("score"), F.col("row")], need)).count() == need
    assert resample.resample(docs(spark, []), docs(spark, [])).count() == 0


# ---- alignment --------------------------------------------------------------------------------

def brute_alignment(rows):
    tokenizer = Tokenizer.from_file(A)
    tokenizer.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=B)
    bytes_a, bytes_b = token_alignment.Encoders(A, B).bytes_a, token_alignment.Encoders(A, B).bytes_b
    docs_of, found = defaultdict(int), []
    for i, text in rows:
        a = tokenizer.encode(" " + text, add_special_tokens=False).ids if text else []
        b = model.encode(text) if text else []
        want = (" " + text).encode() if text else b""
        if b"".join(bytes_a[x] for x in a) != want or b"".join(bytes_b[x] for x in b) != want:
            a, b = [], []
        spans = []
        for ids, table in ((a, bytes_a), (b, bytes_b)):
            end, one = 0, []
            for x in ids:
                one.append((end, end + len(table[x]), x))
                end += len(table[x])
            spans.append(one)
        links = [(x, y) for s, e, x in spans[0] for t, f, y in spans[1] if s < f and t < e] if len(a) < 2000 else "long"
        if links == "long":
            links, j = [], 0
            for s, e, x in spans[0]:
                while spans[1][j][1] <= s:
                    j += 1
                k = j
                while k < len(spans[1]) and spans[1][k][0] < e:
                    links.append((x, spans[1][k][2]))
                    k += 1
        ends = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        parts = [",".join(str(x) for _, f, x in spans[0] if s < f <= e) + "|" + ",".join(str(x) for _, f, x in spans[1] if s < f <= e)
                 for s, e in zip([0, *ends], ends)] if len(a) < 2000 else None
        for pair in set(links):
            docs_of[pair] += 1
        found.append((i, a, b, links, ends, parts))
    best = defaultdict(int)
    for (x, _), n in docs_of.items():
        best[x] = max(best[x], n)
    return [(i, len(a), len(b), len(ends), len(links), sum(docs_of[p] == best[p[0]] for p in links), sum(docs_of[p] for p in links),
             None if parts is None else hashlib.sha256(";".join(parts).encode()).hexdigest() if a else "") for i, a, b, links, ends, parts in found]


@pytest.mark.parametrize("common", [1 << 18, 40, 0])
def test_alignment_equals_brute_force(spark, rows, common):
    got = token_alignment.align(docs(spark, rows).repartition(5), A, B, common=common)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = brute_alignment(rows)
    long = {r[0] for r in want if r[-1] is None}
    plain = lambda r: (*r[:7], None if r[0] in long else r[7])
    assert Counter(plain(tuple(r)) for r in got.collect()) == Counter(want)
    assert sum(r[1] > 0 for r in want) > 200 and token_alignment.align(docs(spark, []), A, B).count() == 0


def test_gallop():
    rng = np.random.default_rng(5)
    for _ in range(200):
        ends = np.sort(rng.choice(400, rng.integers(1, 60), replace=False))
        values = np.sort(rng.choice(int(ends[-1]) + 1, rng.integers(1, 30)))
        start = rng.integers(0, len(ends), len(values))
        got = token_alignment.gallop(ends, np.zeros(len(values), int), np.full(len(values), len(ends)), start, values)
        assert (got == np.searchsorted(ends, values)).all()
