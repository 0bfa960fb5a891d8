"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped to lines: one for each block element's run of text, and a blank one for every start or
end of a container (all blocks but paragraphs, headings, items and cells) between them. A line's weight is
the length of its text, where link text counts a twentieth; text in furniture by its element, role or
class (menus, headers, footers, sidebars, notices, adverts, forms, comments) weighs nothing, and so makes
no passage. The weights are summed over sliding windows of `WINDOW` lines. Along the windows, a passage
begins at a surge point, where the sums rise over `LOW` on their way over `SURGE`, and ends at a dive
point, where they fall under `LOW` again. The text between the two is the main text: the lines of a page
that no such passage holds go, the lines in a passage that weigh anything stay, links too. Both levels
follow the page, `SURGE_SHARE` and `LOW_SHARE` of its largest sum at most, so short pages keep theirs.

Where an article or main element has text outside links, it bounds the search: lines outside weigh
nothing, and any weight inside is a surge; list items that are links alone ahead of its other lines, a
menu, weigh nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from convene.llm.common import lean_batches

WINDOW, SURGE, SURGE_SHARE, LOW, LOW_SHARE = 2, 120, 0.25, 4, 0.1
#: What a character of link text weighs.
LINK = 0.05

# Element names of HTML by their role here.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
FURNITURE = frozenset("nav header footer aside form button select textarea menu dialog fieldset input label".split())
DROPPED = frozenset("script style noscript template svg math iframe object canvas head title audio video map".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
#: A start tag of one of these ends an open p.
ENDS_P = BLOCKS - frozenset("br option legend caption summary td th tr tbody thead tfoot body head html li dd dt title select".split())
WORDS = frozenset(
    "ad ads adsense adslot adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices pagination pager popup promo promoted related reply replies respond share sharing sidebar signup skip social sidenav sponsor sponsored subnav subscribe subscription toc toolbar topbar widget".split()
)
#: Parts of a class that say where or what shape, not what; the last other part says what.
SHAPES = frozenset(
    "area articles block body bottom box button buttons col component container content desktop fixed global group heading icons inline inner input item items js left link links list main mobile module outer page panel posts primary region right row secondary section site slot sticky stories text title top unit wrap wrapper zone".split()
)
#: Blocks that hold a line of text; the others hold blocks, and their ends part passages.
LEAVES = frozenset("br caption dd dt figcaption h1 h2 h3 h4 h5 h6 hr legend li option p pre summary td th tr".split())
#: Elements that a class naming furniture doesn't take away.
KEPT = frozenset("html body article main".split())

_TAG = re.compile(r"<(?:!--(?P<comment>.*?)(?:--!?>|\Z)|(?P<other>[!?][^>]*(?:>|\Z))|(?P<close>/)?(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))|[^>=]+|=)*)(?:>|\Z))", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_BESIDE = re.compile(r"(?<![a-z])(?:no|with|has|without|hide|show)[-_]+[a-z]+")
_SPACE = re.compile(r"\s+")


def _is_furniture(name: str, attrs: str) -> bool:
    if name in FURNITURE:
        return True
    if not attrs or name in KEPT:
        return False
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        if key in ("class", "id"):
            # a layout class says what a block goes with, or without: no-sidebar, has-comments
            for token in _BESIDE.sub(" ", _CAMEL.sub("-", value).lower()).split():
                parts = [x for x in re.split(r"[^a-z]+", token) if x and x not in SHAPES]
                if parts and parts[-1] in WORDS:
                    return True
        elif key == "role":
            if value.lower() in ROLES:
                return True
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True
        elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


@dataclass
class Line:
    """A block's run of text. plain, link: its length outside furniture, outside and inside of links;
    gap: containers that begin or end before it."""

    text: str
    plain: int
    link: int
    article: bool
    item: bool
    gap: int


def lines(html: str) -> list[Line]:
    """The lines of a page, in its order. Dropped elements, comments and markup give no text."""
    out: list[Line] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # name, furniture, link, article: each with its ancestors'
    text: list[str] = []
    plain, linked, gap, furniture, link, article = 0, 0, 0, False, False, False

    def flush() -> None:
        nonlocal plain, linked, gap
        if text:
            joined = _SPACE.sub(" ", "".join(text)).strip()
            if joined:
                out.append(Line(joined, plain, linked, article, any(s[0] == "li" for s in stack), gap))
                gap = 0
            text.clear()
        plain = linked = 0

    def edge(name: str) -> None:
        """A block begins or ends."""
        nonlocal gap
        flush()
        gap += name not in LEAVES

    def add(raw: str) -> None:
        nonlocal plain, linked
        if raw:
            got = unescape(raw)
            text.append(got)
            if not furniture:
                length = len(_SPACE.sub(" ", got).strip())
                plain += 0 if link else length
                linked += length if link else 0

    def leave(depth: int) -> None:
        nonlocal furniture, link, article
        if furniture and not (depth and stack[depth - 1][1]):  # inline furniture is a line of its own
            flush()
        del stack[depth:]
        furniture, link, article = stack[-1][1:] if stack else (False, False, False)

    at, n = 0, len(html)
    while at < n:
        start = html.find("<", at)
        if start < 0:
            add(html[at:])
            break
        m = _TAG.match(html, start)
        if not m:
            add(html[at : start + 1])
            at = start + 1
            continue
        add(html[at:start])
        at = m.end()
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if m["close"]:
            if name in BLOCKS:
                edge(name)
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    leave(depth)
                    break
                if name not in BLOCKS and stack[depth][0] in BLOCKS:
                    break  # an inline end tag does not close a block
            continue
        if name in RAW or name in DROPPED:
            end = re.compile(rf"</{re.escape(name)}\s*(?:/|>|\s)", re.I).search(html, at)
            if name == "head":
                body = re.compile(r"</head\s*>|<body\b|<(?:article|main|div|p|h1|nav|header|section)\b", re.I).search(html, at)
                flush()
                at = n if body is None else body.start()
                continue
            if name in ("textarea", "xmp") and name not in DROPPED:
                continue
            if name in VOID or m["attrs"].endswith("/") and name in ("svg", "math"):
                continue
            flush() if name in BLOCKS else None
            close = html.find(">", end.start()) if end else -1
            at = n if close < 0 else close + 1
            continue
        if name in BLOCKS:
            edge(name)
        if name in VOID or m["attrs"].endswith("/") and name not in BLOCKS:
            continue
        if name in ENDS_P:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == "p":
                    leave(depth)
                    break
                if stack[depth][0] in BLOCKS:
                    break
        if name in ("li", "dd", "dt", "tr", "td", "th", "option"):
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name or {stack[depth][0], name} == {"dd", "dt"}:
                    leave(depth)
                    break
                if stack[depth][0] in ("ul", "ol", "dl", "table", "select", "menu"):
                    break
        if name == "a":
            link_now = "href" in m["attrs"].lower()
        else:
            link_now = False
        was = furniture
        furniture = furniture or _is_furniture(name, m["attrs"])
        if furniture and not was and name not in BLOCKS:  # what stood before inline furniture is a line of its own
            flush()
        link = link or link_now
        article = article or name in ("article", "main") or 'role="main"' in m["attrs"]
        stack.append((name, furniture, link, article))
    flush()
    return out


def passages(weights: np.ndarray, surge: float, low: float) -> np.ndarray:
    """Which lines lie between a surge and a dive point of the sums over windows of lines, and weigh
    something. Sums that never fall under `low`, of which one is `surge` at least, are one passage."""
    keep = np.zeros(len(weights), bool)
    if not len(weights):
        return keep
    sums = np.convolve(weights, np.ones(WINDOW))  # sums[i]: lines i - WINDOW + 1 to i
    high = np.concatenate([[False], sums >= low, [False]])
    points = np.flatnonzero(high[1:] != high[:-1])
    for rise, fall in zip(points[::2], points[1::2]):
        if sums[rise:fall].max() >= surge:
            keep[max(0, rise - WINDOW + 1) : fall] = True  # all lines of its first window and of its last
    return keep & (weights > 0)


#: Any text weighs more.
LEAST = 1e-6


def extract(html: str | None) -> str:
    """The main text of a page; blocks are parted by a space."""
    found = lines(html or "")
    if not found:
        return ""
    weights = np.array([x.plain + LINK * x.link for x in found])
    article = np.array([x.article for x in found], bool)
    bounded = any(x.article and x.plain for x in found)
    if bounded:
        weights[~article] = 0
        for i, x in enumerate(found):
            if weights[i] and not (x.item and not x.plain):
                break
            weights[i] = 0
    places = np.cumsum([x.gap + 1 for x in found], dtype=np.int64) - 1
    spread = np.zeros(places[-1] + 1)
    spread[places] = weights
    most = max(LEAST, np.convolve(spread, np.ones(WINDOW)).max())
    levels = (LEAST, LEAST) if bounded else (min(SURGE, SURGE_SHARE * most), min(LOW, LOW_SHARE * most))
    keep = passages(spread, *levels)[places]
    return " ".join(found[i].text for i in np.flatnonzero(keep))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html). A null, empty or
    textless page has an empty text; pages of any length are read whole; of passages alike in all, each
    stays; repeated rows give repeated results, an empty table none; other columns are ignored."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                texts = [extract(h) for h in batch.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("page_id").cast(pa.int64()), batch.column("url").cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=schema)

    return lean_batches(pages).select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
