"""Main text of web pages by sum-product on the DOM tree.

Every element and every run of inline text is a node with a hidden state: structure (holds both), content or
boilerplate. A node emits features (tag, words of class and id, link density, length); parent-child potentials
tie a node to its parent. Both are counted on labelled pages. Messages pass from the leaves to the root and
back, for all pages of a batch at once by depth, and text whose content marginal leads is kept.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import require

S, C, B = 0, 1, 2
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*>", re.S)
ATTR = re.compile(r"(?:class|id|role|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
QUOTED = re.compile(r"=\s*(?:\"[^\"]*\"|'[^']*')")
BARE = re.compile(r"(?:^|\s)hidden(?=\s*=?\s|/|=|$)", re.I)
STYLE = re.compile(r"(?:^|\s)style\s*=\s*(?:\"[^\"]*(?:display\s*:\s*none|visibility\s*:\s*hidden)|'[^']*(?:display\s*:\s*none|visibility\s*:\s*hidden)|display:none)", re.I)
#: HTML's elements by how they behave.
RAW = frozenset("script style noscript template iframe textarea title svg math object select button".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
CLOSED_BY = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
}
SCOPE = frozenset("ul ol dl table body html div section article".split())
#: Words of class, id and role, by what they say of an element.
HINTS = (
    ("comment", r"comment|disqus|respon[sd]|repl(?:y|ies)|discuss|feedback|review"),
    ("ad", r"\bads?\b|\bad[-_]|[-_]ads?\b|advert|sponsor|promo|banner|outbrain|taboola|affiliate|commercial"),
    ("notice", r"cookie|consent|gdpr|notice|alert|warning|popup|modal|overlay|newsletter|subscri|paywall|toast|disclaimer|announce"),
    ("form", r"form|login|signin|sign-in|signup|search|register|contact"),
    ("menu", r"nav|menu|breadcrumb|pagination|pager|tabs|toolbar|\btoc\b|skip"),
    ("side", r"side|aside|widget|related|recommend|popular|trending|share|social|follow|tags?\b|complementary|more-|also|rail"),
    ("foot", r"foot|copyright|legal|contentinfo|colophon"),
    ("head", r"header|masthead|topbar|top-bar|logo|brand|hero"),
    ("main", r"article|content|post|entry|story|main|body|text|prose|page"),
)
HINT = [(k, re.compile(p, re.I)) for k, p in HINTS]
KINDS = ["none", *(k for k, _ in HINTS)]
TAGS = ["#text", "#link", "other", *"html body div section article main header footer nav aside form ul ol li p h1 h2 h3 h4 h5 h6 table tr td th blockquote pre figure figcaption dl dt dd address fieldset details summary center".split()]
TAG_ID = {t: i for i, t in enumerate(TAGS)}
SIZES = (0, 20, 80, 200)


class Page:
    """Nodes of one page: parents come before children; text nodes carry their text."""

    __slots__ = ("parent", "tag", "kind", "chars", "linked", "text", "label")

    def __init__(self):
        self.parent, self.tag, self.kind, self.chars, self.linked, self.text, self.label = [-1], ["html"], [0], [0], [0], [None], [S]

    def add(self, parent: int, tag: str, kind: int = 0, text: str | None = None, linked: int = 0, label: int = S) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.kind.append(kind)
        self.text.append(text)
        self.chars.append(len(text) if text else 0)
        self.linked.append(linked)
        self.label.append(label)
        return len(self.parent) - 1


def kind_of(attrs: str) -> int:
    if not attrs or attrs.isspace():
        return 0
    said = " ".join("".join(m) for m in ATTR.findall(attrs))
    if said:
        for i, (_, pattern) in enumerate(HINT):
            if pattern.search(said):
                return i + 1
    return 0


def hidden(attrs: str | None) -> bool:
    """Whether an element's attributes keep it from being shown; classes and values that only name hiding don't."""
    if not attrs or attrs.isspace():
        return False
    return bool(STYLE.search(attrs) or BARE.search(QUOTED.sub("= ", attrs)))


def parse(source: str) -> Page:
    """The DOM's blocks and text runs, with omitted end tags put in and hidden elements left out. Never fails: what isn't markup is text."""
    page, stack, run, links, in_link, at = Page(), [("html", 0, False)], [], 0, False, 0
    veil, veils = "", 0  # the hidden inline element that is open, and how many of its name
    low = None

    def flush():
        nonlocal links
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            if text and not stack[-1][2]:
                page.add(stack[-1][1], "#text", 0, text, min(links, len(text)))
            run.clear()
        links = 0

    size, search = len(source), TOKEN.search
    # no tag ends after the last '>': looking for one there would cost the square of the length
    last = size if source.rfind("<!--") > source.rfind("-->") else source.rfind(">") + 1
    while at < size:
        m = search(source, at, last) if at < last else None
        piece = source[at : m.start()] if m else source[at:]
        if piece and not veils:
            run.append(piece)
            if in_link:
                links += len(piece)
        if not m:
            break
        at = m.end()
        name = m.group(2)
        if name is None:
            continue
        name = name.lower()
        if name == "br":
            run.append(" ")
        elif name in INLINE:
            if name == "a":
                in_link = not m.group(1)
            if veils and name == veil:
                veils += -1 if m.group(1) else 1
            elif not veils and not m.group(1) and hidden(m.group(3)):
                veil, veils = name, 1
        elif name in RAW:
            if not m.group(1):
                low = source.lower() if low is None else low
                end = low.find(f"</{name}", at) if len(low) == size else source.find(f"</{name}", at)
                close = source.find(">", end) if end >= 0 else -1
                if name in ("textarea", "button", "select", "object", "noscript", "template", "svg", "math") and end < 0:
                    continue
                at = close + 1 if close >= 0 else size
                run.append(" ")
        elif name in VOID:
            if name == "hr":
                flush()
            else:
                run.append(" ")
        elif m.group(1):
            if any(x[0] == name for x in stack):
                flush()
                in_link, veils = False, 0
                while stack[-1][0] != name:
                    stack.pop()
                if len(stack) > 1:
                    stack.pop()
            elif name == "p":
                flush()
        else:
            flush()
            in_link, veils = False, 0
            if name in ("html", "body", "head"):
                if name != "body":
                    continue
                del stack[1:]
            elif stack[-1][0] == "p":  # any block ends a paragraph
                stack.pop()
            shut = CLOSED_BY.get(name)
            if shut:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in shut:
                        del stack[i:]
                        break
                    if stack[i][0] in SCOPE:
                        break
            attrs = m.group(3)
            stack.append((name, page.add(stack[-1][1], name, kind_of(attrs)), stack[-1][2] or hidden(attrs)))
    flush()
    return page


def features(page: Page) -> np.ndarray:
    """Per node: tag, kind, link density class, size class."""
    n = len(page.parent)
    chars, linked = page.chars[:], page.linked[:]
    for i in range(n - 1, 0, -1):
        chars[page.parent[i]] += chars[i]
        linked[page.parent[i]] += linked[i]
    out = np.zeros((n, 4), np.int64)
    for i in range(n):
        c = chars[i]
        tag = page.tag[i]
        share = linked[i] / c if c else 0
        out[i] = (TAG_ID.get(tag, 2) if not (tag == "#text" and share > 0.8) else 1, page.kind[i], 0 if share < 0.2 else 1 if share < 0.6 else 2, sum(c > s for s in SIZES))
    return out


def never_content(page: Page) -> list[bool]:
    """What is no article whatever surrounds it: what stands in a form, unless the form holds half of the page's text or more, and a last short text outside article and main that begins with a copyright sign or word."""
    n = len(page.parent)
    chars = page.chars[:]
    for i in range(n - 1, 0, -1):
        chars[page.parent[i]] += chars[i]
    form, body = [False] * n, [False] * n
    for i in range(1, n):
        q = page.parent[i]
        form[i] = form[q] or (page.tag[i] == "form" and 2 * chars[i] < chars[0])
        body[i] = body[q] or page.tag[i] in ("article", "main")
    last = max((i for i in range(n) if page.text[i]), default=0)
    if last and not body[last] and page.chars[last] < SIZES[-1] and RIGHTS.match(page.text[last]):
        form[last] = True
    return form


LEVELS = (len(TAGS), len(KINDS), 3, len(SIZES) + 1)
#: What evidence that rules a state out takes from its log potential.
RULED_OUT = 50.0
RIGHTS = re.compile(r"(?:©|\(c\)|copyright\b)", re.I)


class Model:
    """Log potentials counted on labelled pages, with Laplace smoothing."""

    def __init__(self, pages: list[Page]):
        self.emit = [np.full((3, k), 0.5) for k in LEVELS]
        self.tie = np.full((3, 3), 0.5)
        self.root = np.array([1.0, 0.2, 0.2])
        for p in pages:
            f, y = features(p), np.array(p.label)
            for j in range(4):
                np.add.at(self.emit[j], (y, f[:, j]), 1)
            np.add.at(self.tie, (y[np.array(p.parent[1:], int)], y[1:]), 1)
        self.emit = [np.log(e / e.sum(1, keepdims=True)) for e in self.emit]
        # size and link density depend on tag and kind: they weigh half
        self.emit[2] *= 0.5
        self.emit[3] *= 0.5
        self.tie = np.log(self.tie / self.tie.sum(1, keepdims=True))
        self.root = np.log(self.root / self.root.sum())

    def marginals(self, pages: list[Page]) -> np.ndarray:
        """Posterior of the three states for every node of every page, in page order."""
        sizes = [len(p.parent) for p in pages]
        base = np.repeat(np.r_[0, np.cumsum(sizes)[:-1]].astype(np.int64), sizes)
        parent = np.concatenate([np.array(p.parent, np.int64) for p in pages])
        parent = np.where(parent < 0, -1, parent + base)
        f = np.concatenate([features(p) for p in pages])
        depth = np.zeros(len(parent), np.int64)
        for i, q in enumerate(parent.tolist()):
            if q >= 0:
                depth[i] = depth[q] + 1
        order = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[order], np.arange(depth.max(initial=0) + 2))
        level = [order[cuts[d] : cuts[d + 1]] for d in range(len(cuts) - 1)]
        up = sum(self.emit[j][:, f[:, j]].T for j in range(4))  # own evidence and that of the subtree
        up[np.concatenate([np.array(never_content(p), bool) for p in pages]), C] -= RULED_OUT
        message = np.zeros_like(up)
        for nodes in reversed(level[1:]):
            message[nodes] = log_sum(self.tie[None] + up[nodes][:, None, :], 2)
            np.add.at(up, parent[nodes], message[nodes])
        belief = up.copy()
        belief[level[0]] += self.root
        for nodes in level[1:]:
            q = parent[nodes]
            outside = belief[q] - message[nodes]
            outside -= outside.max(1, keepdims=True)
            belief[nodes] = up[nodes] + log_sum(self.tie[None] + outside[:, :, None], 1)
        belief -= belief.max(1, keepdims=True)
        p = np.exp(belief)
        return p / p.sum(1, keepdims=True)


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def labelled_pages(n: int = 400, seed: int = 5) -> list[Page]:
    """Labelled training pages, made by rule from the layouts that web pages use: a frame of boilerplate blocks around one body of content."""
    r = np.random.default_rng(seed)
    pick = lambda *xs: xs[int(r.integers(len(xs)))]
    words = lambda a, b: "x" * int(r.integers(a, b))
    kind = KINDS.index

    def boiler(p: Page, at: int) -> None:
        what = pick("nav", "nav", "ad", "foot", "head", "side", "notice", "form", "comment", "copy")
        tag, k = {
            "nav": pick(("nav", "none"), ("ul", "menu"), ("div", "menu"), ("nav", "menu")), "ad": pick(("div", "ad"), ("section", "ad"), ("aside", "ad")), "foot": pick(("footer", "none"), ("div", "foot"), ("footer", "foot")),
            "head": pick(("header", "none"), ("div", "head"), ("header", "head")), "side": pick(("aside", "none"), ("div", "side"), ("aside", "side"), ("section", "side")), "notice": pick(("div", "notice"), ("section", "notice"), ("p", "notice")),
            "form": pick(("form", "none"), ("form", "form"), ("div", "form")), "comment": pick(("div", "comment"), ("section", "comment"), ("ol", "comment"), ("ul", "comment")), "copy": ("footer", "none"),
        }[what]
        top = p.add(at, tag, kind(k), label=B)
        if what in ("nav", "side", "foot", "head") and r.random() < 0.7:
            ul = top if tag == "ul" else p.add(top, "ul", 0, label=B)
            for _ in range(int(r.integers(2, 7))):
                t = words(3, 25)
                p.add(p.add(ul, "li", 0, label=B), "#text", 0, t, len(t), label=B)
        elif what == "comment":
            for _ in range(int(r.integers(1, 5))):
                box = p.add(top, pick("div", "li", "article", "p"), kind(pick("comment", "none", "none")), label=B)
                p.add(box if p.tag[box] == "p" else p.add(box, "p", 0, label=B), "#text", 0, words(15, 300), label=B)
        else:
            for _ in range(int(r.integers(1, 3))):
                box = p.add(top, pick("p", "div", "span"), 0, label=B) if r.random() < 0.5 and tag != "p" else top
                t = words(10, pick(60, 160, 300))
                p.add(box, pick("#text", "#text", "h3"), 0, t, int(len(t) * pick(0, 0, 0.5, 1)), label=B)

    pages = []
    for _ in range(n):
        p = Page()
        at = p.add(0, "body")
        for _ in range(int(r.integers(0, 4))):
            boiler(p, at)
        if r.random() < 0.3:
            at = p.add(at, "div", kind(pick("none", "main", "none")))
        if r.random() < 0.6:
            box = p.add(at, *pick(("article", 0), ("main", 0), ("article", kind("main")), ("div", kind("main")), ("section", kind("main")), ("div", 0)), label=C)
        else:
            box = at  # paragraphs right in the page's structure
        if box != at and r.random() < 0.25:
            box = p.add(box, "div", kind(pick("main", "none")), label=C)
        if r.random() < 0.8:
            p.add(p.add(p.add(box, "header", 0, label=C) if box != at and r.random() < 0.1 else box, pick("h1", "h1", "h2"), 0, label=C), "#text", 0, words(5, 90), label=C)
        for _ in range(int(r.integers(1, 12))):
            tag = pick("p", "p", "p", "p", "p", "p", "h2", "h3", "ul", "blockquote", "div", "pre")
            x = p.add(box, tag, 0, label=C)
            for _ in range(int(r.integers(1, 5)) if tag == "ul" else 1):
                t = words(3, 120) if tag in ("h2", "h3", "ul") else words(pick(4, 60), 900)
                p.add(p.add(x, "li", 0, label=C) if tag == "ul" else x, "#text", 0, t, int(len(t) * pick(0, 0, 0, 0.1, 0.3)), label=C)
            if r.random() < 0.06:
                boiler(p, box)
        for _ in range(int(r.integers(0, 4))):
            boiler(p, at)
        pages.append(p)
    return pages


def main_texts(sources: list[str], model: Model) -> list[str]:
    pages = [parse(s) for s in sources]
    if not pages:
        return []
    p = model.marginals(pages)
    out, at = [], 0
    for page in pages:
        n = len(page.parent)
        keep = p[at : at + n].argmax(1) == C
        out.append("\n\n".join(t for t, k in zip(page.text, keep.tolist()) if t and k))
        at += n
    return out


def extract(pages: DataFrame, *, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), batch_chars: int = 2_000_000) -> DataFrame:
    """``keep``, ``text`` and ``n_chars`` (code points) of every page, from the whole html.

    One map pass, no shuffle. Null and empty html give an empty text; null ids and repeated rows keep their rows;
    an empty table gives none; extra columns are ignored. Broken markup never fails, and html of any length is read whole, in time
    proportional to it.
    """
    require(pages, html_col, *keep)
    model = Model(labelled_pages())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, part, size = [], [], 0
            for s in b.column(b.num_columns - 1).to_pylist():
                part.append(s)
                size += len(s)
                if size > batch_chars:
                    texts += main_texts(part, model)
                    part, size = [], 0
            texts += main_texts(part, model)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*b.schema.names[:-1], "text", "n_chars"])

    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep) + ", text string, n_chars long"
    return pages.select(*keep, F.coalesce(F.col(html_col), F.lit("")).alias("__html")).mapInArrow(run, schema)
