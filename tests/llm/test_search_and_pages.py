import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import host_consensus, impact_search, url_lists, warc

VECTORS = "vec_id long, embedding array<float>, label int, v int, shard int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, e, 0, 1, 2) for i, e in rows], VECTORS)


@pytest.mark.parametrize("shard_rows", [40, 10_000])
def test_search_equals_brute_force_with_ties_and_copies(spark, shard_rows):
    rng = np.random.default_rng(4)
    base = rng.normal(0, 0.3, (300, 6)).round(1)
    base[50:120] = base[3]  # a large group of copies
    rows = [(int(i), base[i].tolist()) for i in range(300)]
    odd = [(1000, None), (1050, []), (1100, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1150, [float("nan")] + [0.0] * 5), (1200, [float("inf")] + [0.0] * 5),
           (None, base[0].tolist()), (0, base[0].tolist()), (1250, [0.0] * 6), (1300, [1.0, 2.0]), (1301, [2.0, 1.0])]
    got = impact_search.top_k(vectors(spark, rows + odd), F.col("vec_id") % 50 == 0, shard_rows=shard_rows, block_rows=3).collect()
    full = {i: np.floor(256 * np.array(e, np.float32).astype(float)).astype(int) for i, e in rows + [(1250, [0.0] * 6), (1300, [1.0, 2.0]), (1301, [2.0, 1.0])]}
    want = set()
    for q in full:
        if q % 50 == 0:
            near = sorted((-int(full[q] @ v), i) for i, v in full.items() if i != q and len(v) == len(full[q]))[:5]
            want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(near)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_search_in_an_empty_table(spark):
    assert impact_search.top_k(vectors(spark, []), F.col("vec_id") % 50 == 0).count() == 0


def test_lists_decide_as_of_fetch_time(spark):
    changes = spark.createDataFrame([
        ("l", "example.com", "block", "add", 100), ("l", "example.com", "block", "remove", 200), ("l", "example.com", "block", "add", 300),
        ("l", "www.example.com/free", "allow", "add", 150), ("m", "www.example.com/free", "block", "add", 10),
        ("l", "gone.org", "block", "add", 50), ("l", "gone.org", "block", "remove", 50), (None, None, "block", "add", 1), ("l", "com", "block", "add", 1),
    ], "list_name string, pattern string, action string, change string, changed_at long")
    cases = [
        (1, "http://example.com/", 99, "none"), (2, "http://example.com/", 100, "block"), (3, "http://example.com/", 200, "none"),
        (4, "https://user@WWW.Example.com:80/a/b?x#y", 350, "block"), (5, "http://www.example.com/free/x", 160, "allow"),
        (6, "http://www.example.com/free", 120, "block"), (7, "http://www.example.com/freedom", 250, "none"), (8, "http://notexample.com/", 150, "none"),
        (9, None, 150, "none"), (10, "no url", 150, "none"), (11, "http://gone.org./", 60, "none"), (12, "http://example.com", None, "none"), (13, "http://host/", 5, "none"),
    ]
    captures = spark.createDataFrame([(i, u, t, "extra") for i, u, t, _ in cases], "page_id long, url string, fetched_at long, key string")
    got = {r.page_id: r.decision for r in url_lists.evaluate(captures, changes).collect()}
    assert got == {i: d for i, _, _, d in cases}
    assert url_lists.evaluate(captures.limit(0), changes).count() == 0
    assert {r.decision for r in url_lists.evaluate(captures, changes.limit(0)).collect()} == {"none"}


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, digest int, path string")


def test_archives_round_trip(spark, tmp_path):
    long = "<p>" + "word " * 60
    rows = [(3, "http://a/\r\nx", long), (1, None, long), (2, "http://b", "tiny"), (5, "http://b", "tiny"), (4, "http://c", None), (6, "http://d", "é" * 50),
            (7, "http://d", "é" * 50), (None, "http://e", long), (8, "http://f", "x" * 300_000), (9, "http://g", "a\r\n\r\nWARC/1.1\r\n" * 9)]
    archives = warc.write(pages(spark, rows), archive_bytes=200_000)
    got = {r.page_id: tuple(r)[1:5] for r in warc.read(archives).collect()}
    low = {}
    for i, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        data = (h or "").encode()
        first = low.setdefault(data, i) if len(data) >= 100 else i
        revisit = i is not None and first is not None and first < i
        assert got[i] == (len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None)
    files = warc.export(archives, str(tmp_path)).collect()
    whole = [r for f in files for r in warc.records(open(f.path, "rb").read())]
    assert len(whole) == len(rows) and warc.read(warc.write(pages(spark, []))).count() == 0


ARTICLE = (
    '<!DOCTYPE html><html><head><title>T</title><script>var a="</p><p>no";</script><style>p{}</style></head><body class="page"><header class="site"><h1>Site</h1></header>'
    '<nav><a href="/">Home</a></nav><div id="cookie-notice-3">We use cookies</div><main><article class="post post-%d"><header><h1>Title &amp; more</h1><p class="byline">by x</p>'
    '</header><p>First <b>bold</b>\n text %d.<p>Second<br>line &#233;&nbsp;x</p><div class="ad">buy this now</div><ul><li>one<li>two</ul><!-- no -->'
    '<form><label>mail</label></form></article><section id="comments"><p>a very long reader comment, longer than the article itself, to be left out, again and again</p></section></main>'
    "<aside><p>side</p></aside><footer>&copy; x</footer></body></html>"
)


def test_main_text(spark):
    rows = [(i, f"http://h.example/{i}", ARTICLE % (i, i)) for i in range(4)]
    rows += [(10, None, None), (11, "http://h.example/x", ""), (12, "http://o.example", "plain &lt;text&gt;  here"), (13, "http://o.example", "<p>open <b>bold<p>next <"), (14, "http://o.example", "<div>a < b</div>")]
    got = {r.page_id: r for r in host_consensus.main_text(pages(spark, rows)).collect()}
    for i in range(4):
        assert got[i].text == f"Title & more\n\nFirst bold text {i}.\n\nSecond line é x\n\none\n\ntwo" and got[i].n_chars == len(got[i].text)
    assert got[10].text == got[11].text == "" and got[12].text == "plain <text> here" and got[13].text == "open bold\n\nnext <" and got[14].text == "a < b"
    assert host_consensus.main_text(pages(spark, [])).count() == 0


def test_hosts_outvote_a_page(spark):
    usual = "<body><div class='story'><p>" + "long text " * 40 + "</p></div><div class='box'><p>short</p></div></body>"
    odd = "<body><div class='story'><p>the story</p></div><div class='box'><p>" + "filler words " * 60 + "</p></div></body>"
    got = {r.page_id: r.text for r in host_consensus.main_text(pages(spark, [(i, "http://v.example/", usual) for i in range(5)] + [(9, "http://v.example/", odd)])).collect()}
    assert got[9] == "the story"


@pytest.mark.parametrize("large", [2.0**23, 1e8, 3e12, 1e300])
def test_search_with_large_components(spark, large):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=4) * (large if i % 3 else 1.0)]) for i in range(120)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ends = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
    whole = {i: [ends(math.floor(256 * x)) for x in v] for i, v in rows}
    got = {}
    for r in impact_search.top_k(table, F.col("vec_id") % 50 == 0, shard_rows=50).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], -r["score"], r["vec_id"]))
    for q in (0, 50, 100):
        want = sorted((-ends(sum(a * b for a, b in zip(whole[q], whole[i]))), i) for i in whole if i != q)[:5]
        assert [x[1:] for x in sorted(got[q])] == want


def _layouts(seed):
    """Pages of known main text in several layouts: (host, html, text)."""
    rng = random.Random(seed)
    para = lambda: " ".join(rng.choice(["lorem", "ipsum", "dolor", "amet", "sed"]) for _ in range(rng.randrange(8, 60)))
    made = []
    for page in range(6):
        title, lede, end = f"Title {seed} {page}", para(), para()
        parts = [para() for _ in range(rng.randrange(2, 5))]
        nav = "<nav><a href='/a'>Home</a></nav><div class='sidebar'><p>" + para() + "</p></div>"
        foot = "<div class='related-posts'><a href='/x'>" + para() + "</a></div><div id='comments'><p>" + para() + "</p></div><footer>c</footer>"
        whole = "\n\n".join([title, lede, *parts, end])
        bodies = {
            "sections": f"<main><h1>{title}</h1><p>{lede}</p>" + "".join(f"<section><p>{x}</p></section>" for x in parts) + f"<p>{end}</p></main>",
            "paras": f"<div class='content'><h1>{title}</h1><p>{lede}</p>" + "".join(f"<div class='para'>{x}</div>" for x in parts) + f"<p>{end}</p></div>",
            "halves": f"<div class='content'><div class='intro'><h1>{title}</h1><p>{lede}</p></div><div class='body'>" + "".join(f"<p>{x}</p>" for x in parts) + f"<p>{end}</p></div></div>",
            "plain": f"<div class='wrapper'><h1>{title}</h1><p>{lede}</p>" + "".join(f"<div class='para p{i}'>{x}</div>" for i, x in enumerate(parts)) + f"<p>{end}</p></div>",
            "article": f"<main><article class='post-{page}'><header><h1>{title}</h1></header><p class='social-history'>{lede}</p>" + "".join(f"<div class='related-work'><p>{x}</p></div>" for x in parts)
                       + f"<p>{end}</p><div class='related-links'><p><a href='/y'>more of this</a></p></div></article></main>",
        }
        made += [(f"http://{kind}.example/{page}", f"<html><body>{nav}{body}{foot}</body></html>", whole) for kind, body in bodies.items()]
    return made


@pytest.mark.parametrize("seed", range(4))
def test_whole_articles_of_generated_layouts(spark, seed):
    made = _layouts(seed)
    got = {r.page_id: r.text for r in host_consensus.main_text(pages(spark, [(i, url, html) for i, (url, html, _) in enumerate(made)])).collect()}
    for i, (url, _, text) in enumerate(made):
        assert got[i] == text, url


def test_names_in_doubt_are_settled_by_links():
    words = "word " * 30
    page = (f"<body><article><h1>T</h1><div class='related-work'><h2>Earlier</h2><p>Work by others</p></div><div id='login-howto'>how to</div><p>{words}</p>"
            "<div class='related-reading'><a href='x'>elsewhere</a></div><div class='related-posts'><p>other posts</p></div><div class='comment-body'>I agree</div></article>"
            "<div class='related-work'>outside</div></body>")
    assert host_consensus.extract(page, []).split("\n\n") == ["T", "Earlier", "Work by others", "how to", words.strip()]
    boxes = f"<body><div class='page'><div class='header'><h1>Site</h1></div><div class='story'><p>{words}</p></div><div class='box'><p>aside</p></div></div></body>"
    assert host_consensus.extract(boxes, []) == words.strip()
