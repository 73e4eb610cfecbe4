"""Main text of web pages by consensus of a host's pages.

1. Each page's containers (elements that may hold an article) are scored by the text of the blocks in them, less
   their link text; menus, headers, footers and the like don't count.  A container whose surroundings belong to the
   same article (title and lede beside sections, an introduction beside the body) hands its score to the one around it.
2. A container votes for its generalised path: tags and classes from the root, digits dropped.  Votes are summed per host
   and path in Spark; a host's best paths come first.
3. Pages are extracted again with their host's paths: the first path found on the page gives the blocks.  A page
   that has none of them uses its own best container.

Only (host, path, score) rows are shuffled for the votes, and partial sums keep a host with a third of all pages small.
The winning paths are broadcast if they are at most ``WIDE`` rows; beyond that they are joined, salted.

Text: blocks in page order, character references decoded, white space inside a block one space, ends trimmed,
blocks joined by two line ends.  Defined cases: null or empty html gives empty text; a page without
elements is one block; a null URL is a host of its own; repeated rows are extracted each; further
columns are ignored.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .url_lists import host_of

PATHS = 3
WIDE, SALTS = 50_000, 16

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|([^<]+|<)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe template svg math object xmp noembed noframes".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table "
    "tbody td tfoot th thead tr ul".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_CONTAINER = frozenset("article main section div td body center blockquote".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
           "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"},
          "option": {"select"}, "tbody": {"table"}, "tfoot": {"table"}}
#: Elements, roles and words of class or id that mark what isn't the article.
_NOISE_TAGS = frozenset("nav aside footer form head script style button select dialog menu search fieldset".split())
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
_NOISE_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead ad ads adv advert adverts advertisement advertising "
    "banner promo promotion sponsor sponsored cookie cookies consent notice notices gdpr newsletter subscribe signup popup modal overlay "
    "share sharing social related recommended recommendations comment comments commentlist disqus respond reply replies widget toolbar "
    "pagination pager login search outbrain taboola alert alerts toast skip topnav subnav sidenav mainnav crumbs sidemenu topmenu mainmenu submenu "
    "dropdown foot colophon copyright notification notifications disclaimer announcement infobar snackbar adsense adslot adbox adbanner adunit "
    "discussion responses guestbook".split())
#: A class such as has-sidebar says what an element has, not what it is.
_HAVING = frozenset("has with no without is".split())
_ARTICLE_NOISE = frozenset("ad ads advert advertisement sponsored promo comment comments reply replies related".split())
#: Noise words that articles also use of their own parts, as in related-work; with a word that isn't usual in names of page furniture,
#: and inside an article, the share of links decides.
_DOUBTFUL_WORDS = frozenset(
    "related recommended recommendations social share sharing login search menu alert alerts notice notices copyright discussion responses "
    "notification notifications announcement disclaimer banner foot aside skip promotion".split())
_FURNITURE_WORDS = frozenset(
    "list box wrapper wrap container area section bar block inner outer top bottom left right links link buttons button icons icon items item posts post "
    "articles article stories story content contents form header title slot unit media main site page primary secondary global tools this us more panel "
    "group row col column js u c o m is has no".split())
#: Words of class or id of an element that holds the article as a whole, unless the name also says that it only lays out the page.
_ARTICLE_WORDS = frozenset("content article post entry story text prose main".split())
_LAYOUT_WORDS = frozenset("wrapper wrap container layout outer page row grid site columns".split())
_WORD = re.compile(r"[A-Za-z]+")


class _Node:
    """An open element.  ``whole``: it may hold an article as a whole; ``inside``: it is in an article or main element;
    ``doubt``: the innermost element around, itself included, that is noise if it mostly holds links."""

    __slots__ = ("tag", "path", "parent", "noise", "header", "link", "whole", "inside", "doubt")

    def __init__(self, tag, path, parent, noise, header, link, whole=False, inside=False, doubt=None):
        self.tag, self.path, self.parent, self.noise, self.header, self.link = tag, path, parent, noise, header, link
        self.whole, self.inside, self.doubt = whole, inside, doubt


def _noisy(tag: str, attributes: dict[str, str]) -> bool:
    """Whether an element isn't part of an article, by its tag, role, style or names."""
    if tag in _NOISE_TAGS:
        return True
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", ""):
        return tag not in ("html", "body")
    if tag in ("html", "body", "main"):
        return False
    if attributes.get("role", "").lower() in _NOISE_ROLES:
        return True
    return not _names(attributes).isdisjoint(_ARTICLE_NOISE if tag == "article" else _NOISE_WORDS)


def _doubtful(tag: str, attributes: dict[str, str]) -> bool:
    """Whether an element is noise by nothing but names that parts of an article may have too."""
    if tag in _NOISE_TAGS or tag == "article" or not _noisy(tag, {k: v for k, v in attributes.items() if k in ("class", "id")}):
        return False
    if _noisy(tag, {k: v for k, v in attributes.items() if k not in ("class", "id")}):
        return False
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split():
        words = set(_WORD.findall(name))
        noise = words & _NOISE_WORDS
        if noise and (not noise <= _DOUBTFUL_WORDS or words <= _NOISE_WORDS | _FURNITURE_WORDS):
            return False
    return True


def _names(attributes: dict[str, str]) -> set[str]:
    """Words of an element's classes and id, but for classes that say what it has."""
    found: set[str] = set()
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split():
        words = _WORD.findall(name)
        if words and words[0] not in _HAVING:
            found.update(words)
    return found


def _step(tag: str, attributes: dict[str, str]) -> str:
    """An element's part of a generalised path: the tag and its classes (else its id) without digits."""
    names = re.sub(r"[0-9]+", "", attributes.get("class", "")).lower().split() or re.sub(r"[0-9]+", "", attributes.get("id", "")).lower().split()
    return ".".join([tag, *sorted(n.strip("-_") for n in names if n.strip("-_"))])


_TRAITS: dict[tuple[str, str], tuple[bool, bool, str, bool, bool]] = {}


def _traits(tag: str, text: str) -> tuple[bool, bool, str, bool, bool]:
    """Whether an element is noise or a header, its step in a path, whether it may hold an article as a whole, and whether its being
    noise is in doubt; ``text`` holds its attributes.  Recent answers are kept."""
    if (tag, text) not in _TRAITS:
        if len(_TRAITS) > 4096:
            _TRAITS.clear()
        _TRAITS[tag, text] = _read_traits(tag, text)
    return _TRAITS[tag, text]


def _read_traits(tag: str, text: str) -> tuple[bool, bool, str, bool, bool]:
    attributes: dict[str, str] = {}
    for a in _ATTRIBUTE.finditer(text):
        attributes.setdefault(a[1].lower(), _html.unescape(a[2] or a[3] or a[4] or ""))
    names = _names(attributes)
    header = tag == "header" or tag not in ("html", "body", "main", "article", "h1", "h2", "h3", "h4", "h5", "h6") and "header" in names
    whole = tag in ("main", "article") or tag not in ("html", "body") and not names.isdisjoint(_ARTICLE_WORDS) and names.isdisjoint(_LAYOUT_WORDS)
    return _noisy(tag, attributes), header, _step(tag, attributes), whole, _doubtful(tag, attributes)


def parse(page: str) -> tuple[list[tuple[_Node, str, int]], _Node]:
    """Blocks of a page as (innermost block element, text, link characters), in page order, and the root."""
    root = _Node("#root", "", None, False, False, False)
    stack, blocks, held, linked = [root], [], [], 0
    owner = root

    def flush() -> None:
        nonlocal held, linked
        if held:
            text = " ".join(_html.unescape("".join(held)).split())
            if text:
                blocks.append((owner, text, linked))
        held, linked = [], 0

    def pop(to: int) -> None:
        nonlocal owner
        if any(n.tag in _BLOCK for n in stack[to:]):
            flush()
            del stack[to:]
            owner = next(n for n in reversed(stack) if n.tag in _BLOCK or n is root)
        else:
            del stack[to:]

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.match(page, at)
        if m is None:  # a tag that never ends
            held.append(page[at:])
            break
        at = m.end()
        if m[5] is not None or m[1] is not None:
            piece = m[5] if m[5] is not None else m[1]
            # Where the innermost element is noise within a block (a button in a paragraph), its text isn't the block's.
            if not stack[-1].noise or owner.noise:
                held.append(piece)
                if stack[-1].link:
                    linked += len(piece.strip())
            continue
        if m[3] is None:
            continue
        tag = m[3].lower()
        if m[2]:
            if tag == "br":
                held.append(" ")
                continue
            if tag == "p" and all(n.tag != "p" for n in stack):
                flush()
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    pop(i)
                    break
                if tag not in _BLOCK and stack[i].tag in ("td", "th", "table", "body", "article", "div") and stack[i].tag != tag:
                    break
            continue
        if tag in _BLOCK or tag in _CLOSES:
            # A block ends an open paragraph; list items, cells and the like end their equals within the same list or table.
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    pop(i)
                    break
                if stack[i].tag in _BLOCK and stack[i].tag not in _HEADING:
                    break
            if tag in _CLOSES:
                low = None
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in _SCOPE[tag]:
                        break
                    if stack[i].tag in _CLOSES[tag]:
                        low = i
                if low is not None:
                    pop(low)
            flush()
        if tag in ("br", "hr", "wbr"):
            if tag == "br":
                held.append(" ")
            continue
        if tag in _RAW:
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if tag in _VOID or (m[4].endswith("/") and tag not in _BLOCK and tag not in ("a", "b", "i", "em", "strong", "span")):
            continue
        above = stack[-1]
        block = tag in _BLOCK
        noisy, header, step, whole, unsure = _traits(tag, m[4])
        unsure = unsure and block and above.inside
        node = _Node(tag, f"{owner.path}>{step}" if block else owner.path, owner if block else above,
                     above.noise or noisy and not unsure, above.header or header, above.link or tag == "a",
                     whole, above.inside or tag in ("article", "main"), above.doubt)
        if unsure:
            node.doubt = node
        stack.append(node)
        if block:
            owner = node
    flush()
    _settle(blocks)
    return blocks, root


def _doubts(node: _Node) -> Iterator[_Node]:
    doubt = node.doubt
    while doubt is not None:
        yield doubt
        doubt = doubt.parent.doubt


def _settle(blocks: list[tuple[_Node, str, int]]) -> None:
    """Elements in doubt are noise if at least half of their text is in links."""
    weights: dict[_Node, int] = {}
    for node, text, linked in blocks:
        for doubt in _doubts(node):
            weights[doubt] = weights.get(doubt, 0) + 2 * linked - len(text)
    for node, _, _ in blocks:
        if any(weights[doubt] >= 0 for doubt in _doubts(node)):
            node.noise = True


def _wanted(node: _Node, path: str = "") -> bool:
    """Not noise, and not in a header; headings in a header within the container at ``path`` belong to it, unless that is the body."""
    if node.noise or not node.header:
        return not node.noise
    return node.tag in _HEADING and path.rpartition(">")[2].partition(".")[0] not in ("", "html", "body")


def containers(blocks: list[tuple[_Node, str, int]]) -> dict[str, float]:
    """Score of each container path: text of its own blocks in full, of one level below in half, less link text.

    A path that is only part of an article hands its score to the path of the whole (``_wholes``).
    """
    scores: dict[str, float] = {}
    nodes: dict[str, dict[_Node, int]] = {}
    for node, text, linked in blocks:
        if not _wanted(node):
            continue
        value = max(0.0, len(text) - 2.0 * linked)
        level, share = node, 1.0
        while level is not None and share >= 0.5:
            if level.tag in _CONTAINER:
                target = _whole(level)
                scores[target.path] = scores.get(target.path, 0.0) + value * share
                held = nodes.setdefault(target.path, {})
                held[target] = held.get(target, 0) + len(text)
                share /= 2
                if target is not level:
                    break
            level = level.parent
        if level is None and share == 1.0:
            scores[""] = scores.get("", 0.0) + value
    wholes = _wholes(blocks, nodes)
    lifted: dict[str, float] = {}
    for path, score in scores.items():
        lifted[wholes.get(path, path)] = lifted.get(wholes.get(path, path), 0.0) + score
    return lifted


def _above(node: _Node) -> _Node | None:
    """The innermost container around an element."""
    level = node.parent
    while level is not None and level.tag not in _CONTAINER:
        level = level.parent
    return level


def _wholes(blocks: list[tuple[_Node, str, int]], nodes: dict[str, dict[_Node, int]]) -> dict[str, str]:
    """For each container path the path of the whole article that it is part of.

    The path's element with most text stands for it.  The container around takes its place if the text that comes in with it is
    mostly not links, and if that container

    - is a main element or named as an article, or
    - is another element than the body, and the new text stands in it directly, not in a further container, or
    - is the body, several elements of the path stand in it, and the new text stands in it directly.

    Containers that add no text are passed over.  Nothing is lifted out of an article element.
    """
    under: dict[_Node, list[int]] = {}   # text and link characters in a container, headings of headers included
    direct: dict[_Node, int] = {}        # text whose innermost container it is
    same: dict[tuple[_Node | None, str], set[_Node]] = {}
    for node, text, linked in blocks:
        if node.noise or not _wanted(node, "div"):
            continue
        level = node if node.tag in _CONTAINER else _above(node)
        if level is not None and not node.header:
            direct[level] = direct.get(level, 0) + len(text)
        while level is not None:
            if not node.header or level.tag != "body":
                sums = under.setdefault(level, [0, 0])
                sums[0] += len(text)
                sums[1] += linked
            above = _above(level)
            same.setdefault((above, level.path), set()).add(level)
            level = above

    def covered(node: _Node) -> tuple[list[int], int]:
        """Text and links of the elements with a node's path in the same container, and their number."""
        alike = same.get((_above(node), node.path), {node})
        held = [under.get(n, [0, 0]) for n in alike]
        return [sum(x) for x in zip(*held)], len(alike)

    found: dict[str, str] = {}
    for path, held in nodes.items():
        at = max(held, key=lambda n: held[n])  # the first of several
        best = at
        have, alike = covered(at)
        while at.tag not in ("article", "body") and (above := _above(at)) is not None and above.tag != "article":
            chars, links = (x - y for x, y in zip(under.get(above, [0, 0]), have))
            if chars > 0:
                stands = chars == direct.get(above, 0)
                fits = above.whole or stands and (above.tag != "body" or alike > 1)
                if 2 * links >= chars or not fits:
                    break
                best = above
            at = above
            have, alike = covered(at)
        found[path] = best.path
    return found


def _whole(node: _Node) -> _Node:
    """The article that a container is part of, if any."""
    best, level = node, node.parent
    while level is not None:
        if level.tag == "article":
            best = level
        level = level.parent
    return best


def extract(page: str | None, paths: list[str]) -> str:
    """Text of the blocks under the first of ``paths`` that the page has; else under the page's own best container."""
    if not page:
        return ""
    blocks, _ = parse(page)

    def under(path: str) -> list[str]:
        return [text for node, text, _ in blocks
                if (path == "" or node.path == path or node.path.startswith(path + ">")) and _wanted(node, path)]

    for path in paths:
        if found := under(path):
            return "\n\n".join(found)
    scores = containers(blocks)
    if not scores:
        return ""
    return "\n\n".join(under(min(scores, key=lambda p: (-scores[p], p))))


def _vote_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, paths, votes = [], [], []
        for host, page in zip(batch.column(0), batch.column(1)):
            scores = containers(parse(page.as_py() or "")[0])
            total = sum(scores.values())
            for path in sorted(scores, key=lambda p: (-scores[p], p)):
                if scores[path] > 0:
                    hosts.append(host.as_py())
                    paths.append(path)
                    votes.append(scores[path] / total)
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(votes, pa.float64())], ["host", "path", "vote"])


def _extract_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(page.as_py(), paths.as_py() or []) for page, paths in zip(batch.column("html"), batch.column("paths"))]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def host_paths(pages: DataFrame, paths: int = PATHS) -> DataFrame:
    """(host, paths): each host's paths with the most votes, best first.

    Votes are rounded to millionths before they are added, so that sums don't depend on the order of rows.
    """
    votes = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(_vote_batches, "host string, path string, vote double")
    summed = votes.groupBy("host", "path").agg(F.sum(F.round(F.col("vote") * 1_000_000).cast("long")).alias("votes"))
    order = Window.partitionBy("host").orderBy(F.desc("votes"), "path")
    top = summed.withColumn("r", F.row_number().over(order)).where(F.col("r") <= paths)
    return top.groupBy("host").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "path"))), lambda x: x["path"]).alias("paths"))


def main_text(pages: DataFrame, paths: int = PATHS) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of ``pages`` (page_id, url, html)."""
    best = stage(host_paths(pages, paths), "host-paths")
    named = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    if best.limit(WIDE + 1).count() <= WIDE:
        joined = named.join(F.broadcast(best), "host", "left")
    else:
        salted = best.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        named = named.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
        joined = named.join(salted, ["host", "salt"], "left")
    texts = joined.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), "paths").mapInArrow(
        _extract_batches, "page_id long, url string, text string")
    return texts.withColumn("n_chars", F.length("text").cast("long"))
