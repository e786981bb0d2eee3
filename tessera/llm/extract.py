"""Main text of web pages by minimum-cut labelling.

A page is cut into text blocks at its block elements.  A logistic classifier gives every
block the log-odds of content from several kinds of evidence: its own (length, sentence end,
punctuation, share of link text, kind of element), its surroundings' (link text of its
container, whether it lies in the page's core, the smallest container of most prose), and
names.  A container is named as boilerplate by its element or by a class that ends in such a
word (``ad-box`` and ``site-footer`` do; ``has-sidebar``, ``modal-open`` and ``legal-analysis``
do not).  A name is evidence and no verdict: it counts the less, the more of the page's prose
the container holds, as a page's wrapper may have any name; reader comments and menus are
excepted.  Positive log-odds
become capacities from the source, negative ones capacities to the sink.  Neighbouring blocks
and blocks of one parent are joined by smoothness edges that halve with every step of their
distance in the tree.  A maximum flow finds the cheapest cut, and the blocks left on the
source's side are content.  A block of weak evidence (log-odds within about 2), such as a
one-word paragraph, thus takes the label of those around it; it cannot outvote a container.

The weights are fitted by ``fit`` on labelled pages made by hand (tests/llm/labelled_pages.py),
and the smoothness was chosen there too; no page of a corpus is used.  Headers that go are those
of the page; a ``header`` element inside an article holds the article's own heading and stays.

Every page is worked on alone and whole, in a narrow pass, in time linear in its markup:
elements nested deeper than MAX_DEPTH are not nested further, as in browsers, and lose no
text.  Edge cases: a null page is empty; a page without content blocks has the empty text;
broken markup is read leniently and never fails; ``br`` is white space; equal rows give equal
texts; an empty table gives no rows; other columns pass through, but for one with the
output's name, which the output replaces.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import packed as P

# Element classes and words of class, id and role attributes.
RAW = {"script", "style", "noscript", "template", "iframe", "title", "textarea", "xmp", "noembed", "noframes"}
DROPPED = {"svg", "math", "object", "canvas", "select", "button", "audio", "video", "map", "datalist", "head", "option"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu",
    "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
BAD_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog", "search", "fieldset"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
PROSE = {"p", "pre", "blockquote"}
CELLS = {"li", "td", "th", "dd", "dt"}
BAD_WORDS = set(
    "ad ads adbox adsense advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert newsletter subscribe subscription "
    "signup login popup modal overlay sidebar widget widgets related recommended recommendations share sharing social breadcrumb breadcrumbs nav navbar navigation menu footer masthead topbar toolbar "
    "pagination pager rating ratings copyright legal disclaimer tagcloud contentinfo complementary dialog".split()
)
SAID_WORDS = set("comment comments commentlist commentary reply replies respond disqus responses discussion feedback guestbook".split())
HEADER_WORDS = {"header", "head", "banner"}
#: Words of a name that only say that there is a box, and words that say something about a name beside them.
PLAIN_WORDS = set("area block box card cards container content group holder inner item items left links list main module outer panel posts row section slot text top unit wrap wrapper right bottom form count thread".split())
STATE_WORDS = set("has have with no not without is are open opened closed enabled disabled active visible hidden show shown hide on off js".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_ATTR = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|(?<![\w-])(hidden)(?![\w-])""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I) for tag in RAW}

#: Elements that an opening element closes, up to the elements that bound the search.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"}),
}
_SCOPE = {"table", "td", "th", "html", "body", "button", "object", "article", "section", "main", "nav", "aside", "footer", "header", "form", "div"}

MAX_DEPTH = 512

_STOPS = set(".!?…:;\"'”»)")

#: Capacity of the edge between page neighbours of one parent, and between successive blocks of one parent.
SMOOTH, SIBLING = 1.5, 0.3

#: Characters at which a block's length counts in full.
LONG = 120

FEATURES = ("one", "length", "sentence", "punctuation", "links", "heading", "prose", "cell", "bad", "wraps", "said", "core", "around")

#: Log-odds weights of FEATURES, as ``fit`` gives them for the labelled pages.
WEIGHTS = (-3.25, 2.92, 1.27, 1.55, -3.62, 4.0, 0.03, 3.76, -9.41, 9.54, -9.12, 4.23, -11.54)

#: Share of a page's prose beyond which a named container begins to count as its wrapper, and of the prose that the core holds.
WRAPS, CORE = 0.6, 0.75


class _Frame:
    """An open element; ``bad`` is the innermost element from here up that is named as boilerplate."""

    __slots__ = ("article", "bad", "chars", "core", "depth", "dropped", "link", "linked", "parent", "prose", "said", "tag")

    def __init__(self, tag, parent, bad=False, dropped=False, link=False, article=False, said=False):
        self.tag, self.parent, self.dropped, self.link, self.article, self.said = tag, parent, dropped, link, article, said
        self.bad = self if bad else parent.bad if parent else None
        self.depth = parent.depth + 1 if parent else 0
        self.chars = self.linked = self.prose = 0
        self.core = False


class Block:
    __slots__ = ("frame", "link_chars", "text")

    def __init__(self, text: str, link_chars: int, frame: _Frame):
        self.text, self.link_chars, self.frame = text, link_chars, frame


def _attributes(raw: str) -> tuple[list[str], bool]:
    """Names of class, id and role, and whether the element is hidden."""
    names: list[str] = []
    hidden = False
    for name, a, b, c, flag in _ATTR.findall(raw):
        name, value = name.lower(), a or b or c
        if flag:
            hidden = True
        elif name in ("class", "id", "role"):
            names += value.split()
        elif name == "style" and _HIDDEN.search(value) or name == "aria-hidden" and value.lower() == "true":
            hidden = True
    return names, hidden


def _said_by(name: str) -> str:
    """What a name names: its last word that does not only say box; nothing if the name tells a state."""
    words = [w.lower() for w in _WORD.findall(name)]
    if not STATE_WORDS.isdisjoint(words):
        return ""
    while len(words) > 1 and (words[-1] in PLAIN_WORDS or words[-1].isdigit()):
        words.pop()
    return words[-1] if words else ""


def _open(tag: str, raw: str, parent: _Frame) -> _Frame:
    names, hidden = _attributes(raw) if "=" in raw or "hidden" in raw else ([], False)
    article = parent.article or tag == "article"
    bad, said = tag in BAD_TAGS or tag == "header" and not article, parent.said or tag in ("nav", "menu")
    if names and tag not in ("html", "body"):
        words = {_said_by(n) for n in names}
        bad = bad or not BAD_WORDS.isdisjoint(words) or not article and not HEADER_WORDS.isdisjoint(words)
        said = said or not SAID_WORDS.isdisjoint(words)
    return _Frame(tag, parent, bad, parent.dropped or hidden or tag in DROPPED, parent.link or tag == "a", article, said)


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page in order."""
    top = _Frame("", None)
    out: list[Block] = []
    live: Counter = Counter()  # open elements by name
    flat: Counter = Counter()  # those beyond MAX_DEPTH, which are not nested
    held: list[str] = []
    links = 0

    def flush():
        nonlocal links
        if held:
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                frame = top
                while frame.parent and frame.tag not in BLOCKS:
                    frame = frame.parent
                out.append(Block(text, links, frame))
        links = 0

    def close(to: _Frame):
        """Close all elements below ``to``."""
        nonlocal top
        while top is not to:
            live[top.tag] -= 1
            top = top.parent

    def say(raw: str):
        nonlocal links
        if top.dropped:
            return
        text = html.unescape(raw) if "&" in raw else raw
        held.append(text)
        if top.link:
            links += len(text)

    at, end = 0, len(page)
    match = _TAG.search
    while at < end:
        m = match(page, at)
        if not m:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        tag = m.group(2) or m.group(5)
        if not tag:
            if page.startswith("<![CDATA[", m.start()):
                say(page[m.start() + 9 : at - 3 if page.endswith("]]>", 0, at) else at])
            continue
        tag = tag.lower()
        closing, raw = (m.group(1), m.group(3)) if m.group(2) else (m.group(4), m.group(6))
        block = tag in BLOCKS
        if tag == "br":
            say(" ")
            continue
        if closing:
            if flat[tag]:
                flat[tag] -= 1
                if block:
                    flush()
                continue
            if not live[tag]:  # a stray end
                if block:
                    flush()
                continue
            frame = top
            while frame.parent and frame.tag != tag:
                if not block and frame.tag in BLOCKS and frame.tag != "p":
                    break  # an inline end does not close blocks
                frame = frame.parent
            if frame.tag == tag and frame.parent:
                if block:
                    flush()
                close(frame.parent)
            elif block:
                flush()
            continue
        if tag in RAW:
            if tag not in ("textarea", "title"):
                say(" ") if tag != "script" and tag != "style" else None
            stop = _RAW_END[tag].search(page, at)
            at = stop.end() if stop else end
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if block:
            flush()
            if tag not in ("html", "body") and live["p"]:
                frame = top
                while frame.parent and frame.tag not in _SCOPE:  # a block closes an open paragraph
                    if frame.tag == "p":
                        close(frame.parent)
                        break
                    frame = frame.parent
        if tag in _CLOSES and any(live[name] for name in _CLOSES[tag][0]):
            names, bounds = _CLOSES[tag]
            frame, last = top, None
            while frame.parent and frame.tag not in bounds:
                if frame.tag in names:
                    last = frame
                frame = frame.parent
            if last:
                flush()
                close(last.parent)
        if not raw.rstrip().endswith("/") or block or tag == "a":
            if top.depth >= MAX_DEPTH:
                flat[tag] += 1
                continue
            top = _open(tag, raw, top)
            live[tag] += 1
    flush()
    return out


def _measure(blocks: list[Block]) -> _Frame:
    """Fill in what each element holds, mark the elements of the core, and give the page's root."""
    frames: dict[int, _Frame] = {}
    for b in blocks:
        f = b.frame
        while f and id(f) not in frames:
            frames[id(f)] = f
            f.chars = f.linked = f.prose = 0
            f = f.parent
    for b in blocks:
        n = len(b.text)
        b.frame.chars += n
        b.frame.linked += b.link_chars
        if not b.frame.said and 2 * b.link_chars < n and (n >= LONG // 2 or b.text[-1] in _STOPS):
            b.frame.prose += n
    order = sorted(frames.values(), key=lambda f: -f.depth)
    for f in order:
        if f.parent:
            f.parent.chars += f.chars
            f.parent.linked += f.linked
            f.parent.prose += f.prose
    root = order[-1]
    core = root
    for f in reversed(order):  # from the root down; at most one child of an element holds most of the prose
        if f.parent is core and f.prose >= CORE * max(1, root.prose) and f.tag not in PROSE:
            core = f
    for f in reversed(order):
        f.core = f is core or bool(f.parent and f.parent.core)
    return root


def features_of(blocks: list[Block]) -> np.ndarray:
    """A row of FEATURES, each between 0 and 1, for every block."""
    out = np.zeros((len(blocks), len(FEATURES)))
    if not blocks:
        return out
    root = _measure(blocks)
    for row, b in zip(out, blocks, strict=True):
        n, f, tag = len(b.text), b.frame, b.frame.tag
        marks = sum(map(b.text.count, ",.;:!?"))
        around = f.parent or f
        wraps = max(0.0, f.bad.prose / max(1, root.prose) - WRAPS) / (1 - WRAPS) if f.bad else 0.0
        row[:] = (
            1, min(1.0, n / LONG), b.text[-1] in _STOPS, min(1.0, 20 * marks / n), b.link_chars / n,
            tag in HEADINGS, tag in PROSE, tag in CELLS, f.bad is not None and not f.said, wraps if not f.said else 0, f.said, f.core, around.linked / max(1, around.chars),
        )
    return out


def scores_of(blocks: list[Block]) -> list[float]:
    """The classifier's log-odds of each block: above zero for content."""
    return (features_of(blocks) @ np.array(WEIGHTS)).tolist()


def fit(pages: list[tuple[str, set[str]]], ridge: float = 0.3) -> np.ndarray:
    """Weights of FEATURES from (page, texts of its content blocks): a ridge logistic regression by Newton steps."""
    cut = [(blocks_of(page), wanted) for page, wanted in pages]
    x = np.concatenate([features_of(blocks) for blocks, _ in cut])
    y = np.array([b.text in wanted for blocks, wanted in cut for b in blocks], float)
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _distance(a: _Frame, b: _Frame) -> int:
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def edges_of(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges: page neighbours, weaker by half for each step of their distance over two, and successive blocks of one parent."""
    out = []
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            out.append((i - 1, i, SMOOTH * 0.5 ** max(0, _distance(blocks[i - 1].frame, b.frame) - 2)))
        parent = id(b.frame.parent or b.frame)
        if parent in last and last[parent] != i - 1:
            out.append((last[parent], i, SIBLING))
        last[parent] = i
    return out


def min_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source in a minimum cut (the smallest such side)."""
    n = len(scores)
    source, sink = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[int] = []

    def add(a, b, ab, ba):
        head[a].append(len(to))
        to.append(b)
        room.append(ab)
        head[b].append(len(to))
        to.append(a)
        room.append(ba)

    for v, z in enumerate(scores):
        c = round(abs(z) * 1000)
        if c:
            add(source, v, c, 0) if z > 0 else add(v, sink, c, 0)
    for a, b, w in edges:
        add(a, b, round(w * 1000), round(w * 1000))
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            v = queue.popleft()
            for e in head[v]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        turn = [0] * (n + 2)
        path: list[int] = []
        v = source
        while True:
            if v == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                k = next(i for i, e in enumerate(path) if not room[e])
                v = to[path[k] ^ 1]
                del path[k:]
                continue
            while turn[v] < len(head[v]):
                e = head[v][turn[v]]
                if room[e] and level[to[e]] == level[v] + 1:
                    break
                turn[v] += 1
            if turn[v] < len(head[v]):
                path.append(head[v][turn[v]])
                v = to[path[-1]]
            elif path:
                e = path.pop()
                v = to[e ^ 1]
                turn[v] += 1
            else:
                break


def extract(page: str | None) -> list[str]:
    """The content blocks of a page."""
    if not page:
        return []
    blocks = blocks_of(page)
    if not blocks:
        return []
    keep = min_cut(scores_of(blocks), edges_of(blocks))
    return [b.text for b, k in zip(blocks, keep, strict=True) if k]


def with_text(pages: DataFrame, page: str = "html", into: str = "main_text") -> DataFrame:
    """pages with their main text, blocks joined by empty lines."""

    def make(column):
        return [pa.array(["\n\n".join(extract(x)) for x in column.to_pylist()], pa.string())]

    return P.add_columns(pages, page, [(into, T.StringType())], make)


__all__ = ["blocks_of", "edges_of", "extract", "features_of", "fit", "min_cut", "scores_of", "with_text"]
