"""Main text of web pages by tree scoring.

Paragraphs pass points for their length and commas to their ancestors, fewer the farther up; a
container's points are discounted by the share of its text inside links. The best container, widened
to the article that holds it, is kept with those of its siblings that score well or read as prose.
Names of classes and ids take boxes beside the article out before that, but never most of a page's
prose: where nothing is left, the page is scored again without them.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import fresh
from .wordvec import split_batches

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    # quotes delimit only at the start of a value; one that is never closed is part of the value
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+|[\"'])*+)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([^\s=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|[\"']?([^\s>]*)))?", re.S)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: elements whose content is not part of the page's text: read up to their end as text, by nesting, or up to the next of their kind
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
NESTED = frozenset("template svg math".split())
SINGLE = frozenset("noscript select".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table "
    "tbody td tfoot th thead tr ul".split()
)
#: what a start tag of the key closes, up to an element that bounds it
CLOSES_P = BLOCK - {"br", "option", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html", "legend"}
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
BOUND = frozenset("html body div section article main aside nav header footer form td th table button".split())
DROP_TAGS = frozenset("head nav header footer aside form menu dialog button input label fieldset object audio video canvas".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
UNLIKELY = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner billboard breadcrumb breadcrumbs byline captcha "
    "comment comments commentlist commenter consent cookie cookies copyright disclaimer discussion disqus footer "
    "footnav gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification outbrain "
    "overlay pager pagination paywall popup promo promoted promotion recommended related replies reply reviews rss "
    "share sharing sidebar signup skip social sponsor sponsored subscribe subscription taboola tags toolbar tooltip topbar "
    "trending widget widgets alert alerts announcement cta donate donation feedback infobar interstitial livechat optin poll rating "
    "ratings respond response responses snackbar survey toast".split()
)
LIKELY = frozenset("article articlebody body column content entry main maincontent page post prose story text".split())
#: first and last words of class names that tell a state or a category, not what the box is
STATE_FIRST = frozenset("no has have with without is not hide show category cat tag hentry post postid page type status format js layout".split())
STATE_LAST = frozenset("closed open opened enabled disabled on off none fixed sticky visible count active".split())
SCORED = frozenset("p pre td blockquote li dd section div article main h2 h3 h4 figcaption".split())
#: names of an article element that is beside the main one
ASIDE = frozenset({"comment", "reply", "related"})
#: A box with more of the page's prose than this is not dropped by its name if it holds the headline.
MOST = 0.5


_BLOCK_START = re.compile(r"<(?:%s)(?=[\s/>])" % "|".join(sorted(BLOCK - {"option", "legend", "caption"})), re.I)


class _Ends:
    """Where the content of an element that is no text ends. The tags of a name are matched once, when it is first met."""

    def __init__(self, html: str):
        self.html, self.known = html, {}

    def _matched(self, tag: str) -> dict[int, int] | list[tuple[int, int]]:
        tags = re.finditer(rf"<(/?){tag}(?=[\s/>])[^>]*>", self.html, re.I)
        if tag in RAW:
            return [m.span() for m in tags if m[1]]
        matched: dict[int, int] = {}
        open_: list[int] = []
        for m in tags:
            if not m[1]:
                if tag in SINGLE:
                    open_.clear()
                if not m[0].endswith("/>"):
                    open_.append(m.start())
            elif open_:
                matched[open_.pop()] = m.end()
        return matched

    def after(self, tag: str, start: int, at: int) -> int:
        """For a start tag from start to at. An element that is never closed ends where the next block begins; a script and a style with the page."""
        if tag not in self.known:
            self.known[tag] = self._matched(tag)
        known = self.known[tag]
        if tag in RAW:
            k = bisect_left(known, (at, 0))
            end = known[k][1] if k < len(known) else None
        else:
            end = known.get(start)
        if end is not None:
            return end
        block = None if tag in ("script", "style") else _BLOCK_START.search(self.html, at)
        return block.start() if block else len(self.html)


class Node:
    __slots__ = ("tag", "attrs", "kids", "up", "size", "linked", "links", "main", "score", "dropped", "named")

    def __init__(self, tag, attrs, up):
        self.tag, self.attrs, self.up = tag, attrs, up
        self.kids: list = []
        self.size = self.linked = self.links = 0
        self.main = False
        self.score, self.dropped, self.named = 0.0, False, None


def parse(html: str) -> Node:
    """A tree with implied end tags; what cannot be parsed is text."""
    root = Node("html", {}, None)
    stack = [root]  # open elements
    opened: dict[str, list[int]] = {"html": [0]}  # of each tag, where in the stack it is open
    bounds = [0]  # where elements of BOUND are open

    def last(tag):
        places = opened.get(tag)
        return places[-1] if places else -1

    def shut(depth):
        """Close the elements from this place of the stack on."""
        while len(stack) > max(1, depth):
            tag = stack.pop().tag
            opened[tag].pop()
            if tag in BOUND:
                bounds.pop()

    at, n, ends = 0, len(html), _Ends(html)
    while at < n:
        m = _MARKUP.search(html, at)
        if not m:
            break
        if m.start() > at:
            stack[-1].kids.append(html[at : m.start()])
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                stack[-1].kids.append(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        tag = m[2].lower()
        if m[1]:
            place = last(tag)
            if place > 0 and (tag in BOUND or tag in ("ul", "ol", "table", "dl") or place >= bounds[-1]):
                shut(place)
            continue
        attrs = {}
        if m[3]:
            for a in _ATTR.finditer(m[3]):
                attrs.setdefault(a[1].lower(), a[2] or a[3] or a[4] or "")
        if tag in RAW or tag in NESTED or tag in SINGLE:
            if not (m[0].endswith("/>") and tag in ("svg", "math")):
                at = ends.after(tag, m.start(), at)
            continue
        if tag == "html":
            continue
        if tag in CLOSES_P and last("p") > bounds[-1]:
            shut(last("p"))
        if tag in IMPLIED:
            closed, stop = IMPLIED[tag]
            least = max(map(last, stop))
            inside = [opened[c][bisect_right(opened[c], least)] for c in closed if last(c) > least]
            if inside:
                shut(min(inside))
        if stack[-1].tag == "head" and (tag in BOUND or tag == "p"):
            shut(len(stack) - 1)
        node = Node(tag, attrs, stack[-1])
        stack[-1].kids.append(node)
        if tag not in VOID:
            opened.setdefault(tag, []).append(len(stack))
            if tag in BOUND:
                bounds.append(len(stack))
            stack.append(node)
    if at < n:
        stack[-1].kids.append(html[at:])
    return root


def _in_order(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [k for k in reversed(node.kids) if k.__class__ is Node]
    return out


def _named(node: Node) -> set:
    """Words of the class names and the id, without those that tell a state."""
    if node.named is None:
        node.named = set()
        for name in f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}".split():
            words = [w.lower() for w in _WORDS.findall(name)]
            if len(words) < 2 or words[0] not in STATE_FIRST and words[-1] not in STATE_LAST:
                node.named.update(words)
    return node.named


def _hidden(a: dict) -> bool:
    style = a.get("style", "").replace(" ", "").lower()
    return "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style


def _blocks(node: Node) -> list[str]:
    """Texts of the blocks of a kept node, in page order."""
    out, line = [], []

    def flush():
        if line:
            words = "".join(line).split()
            line.clear()
            if words:
                out.append(" ".join(words))

    todo: list = [node]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif x.__class__ is str:
            line.append(unescape(x))  # by itself: no reference runs across a tag
        elif not x.dropped:
            block = x.tag in BLOCK
            if block:
                flush()
                todo.append(None)
            todo += reversed(x.kids)
    flush()
    return out


def main_text(html: str | None) -> str:
    """The article's text: white space inside a block is one space, blocks are joined by one space."""
    if not html:
        return ""
    root = parse(html)
    order = _in_order(root)
    for node in reversed(order):  # sizes of text, whole and in links, from below
        size = linked = links = 0
        main = node.tag in ("h1", "main") or node.tag == "article" and not _named(node) & ASIDE
        for k in node.kids:
            if k.__class__ is str:
                size += len(k.strip())
            else:
                size += k.size
                linked += k.linked
                links += k.links
                main = main or k.main
        node.size, node.linked, node.links, node.main = size, size if node.tag == "a" else linked, links + (node.tag == "a"), main
    text = ""
    for names in ("all", "small", "none"):
        text = _scored_text(root, order, names)
        if len(text) >= min(100, 0.05 * root.size):
            break
    return text


def _drop(order: list[Node], total: int, names: str) -> None:
    """Mark what is no article. names: the boxes that their names may drop - all, those without most of the page's text, or none."""
    for node in order:
        a = node.attrs
        node.dropped, node.score = False, 0.0
        if node.tag in ("html", "body"):
            continue
        if node.up is not None and node.up.dropped:
            node.dropped = True
        elif node.tag in DROP_TAGS and not (node.tag in ("form", "label", "fieldset") and node.size > 0.6 * total):
            node.dropped = True
        elif a and _hidden(a):
            node.dropped = True
        elif a and node.tag not in ("article", "main"):
            most = node.size > MOST * total
            if a.get("role", "").lower() in DROP_ROLES:
                node.dropped = True
            elif names != "none" and _named(node) & UNLIKELY and not (most and (names == "small" or node.main or _named(node) & LIKELY)):
                node.dropped = True
        if not node.dropped and node.tag == "article" and node.up is not None and _named(node) & ASIDE:
            node.dropped = True


def _scored_text(root: Node, order: list[Node], names: str) -> str:
    _drop(order, root.size or 1, names)
    # points
    scored: dict[int, Node] = {}
    for node in order:
        if node.dropped or node.tag not in SCORED:
            continue
        own = " ".join("".join(_own_text(node)).split())
        if len(own) < 25:
            continue
        points = 1 + own.count(",") + min(len(own) / 100, 3)
        up, level = node.up, 0
        while up is not None and level < 6:
            if id(up) not in scored:
                scored[id(up)] = up
                names = _named(up)
                up.score = {"article": 8, "main": 8, "div": 5, "section": 3, "td": 3, "blockquote": 3}.get(up.tag, 0)
                up.score += 25 * bool(names & LIKELY)
            up.score += points / (1, 2, 6, 9, 12, 15)[level]
            up, level = up.up, level + 1
    best = None
    for node in scored.values():
        if node.dropped:
            continue
        node.score *= 1 - node.linked / node.size if node.size else 0
        if best is None or node.score > best.score:
            best = node
    if best is None:
        return " ".join(_blocks(root))
    around, node = best, best
    while node is not None:
        if node.tag in ("article", "main"):
            around = node
            break
        node = node.up
    # lists and boxes that are mostly links are no prose
    for node in _in_order(around):
        if node is not around and node.tag in ("ul", "ol", "div", "section", "table", "p") and node.size:
            if node.linked > 0.6 * node.size and node.links >= 2:
                node.dropped = True
    keep = [around]
    if around.up is not None and around.tag not in ("article", "main", "body", "html"):
        least = max(10.0, 0.2 * best.score)
        keep = []
        for k in around.up.kids:
            if k is around:
                keep.append(k)
            elif k.__class__ is Node and not k.dropped and k.size:
                density = k.linked / k.size
                prose = k.tag in ("p", "pre", "blockquote", "ul", "ol") or re.fullmatch("h[1-6]", k.tag)
                if k.score >= least or prose and density < 0.25:
                    keep.append(k)
    elif around.tag == "article" and around.up is not None:
        least = max(10.0, 0.2 * best.score)
        keep = [k for k in around.up.kids if k is around or k.__class__ is Node and not k.dropped and k.tag in ("article", "section") and k.score >= least]
    return " ".join(x for k in keep for x in _blocks(k))


def _own_text(node: Node) -> list[str]:
    """Text of a node outside the blocks below it."""
    out, todo = [], list(reversed(node.kids))
    while todo:
        k = todo.pop()
        if k.__class__ is str:
            out.append(unescape(k))
        elif k.tag not in BLOCK and not k.dropped:
            todo += reversed(k.kids)
    return out


def extract(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """Add the main text of every page, and n_chars, its code points.

    A null or empty html gives an empty text. Columns of the output's names, in whatever case, are replaced; others stay.
    Repeated rows each have their text. A page is parsed whole, in time that follows its length; an empty
    table gives no rows.
    """
    kept = [c for c in pages.columns if c.lower() not in (out_col.lower(), "n_chars", html_col.lower())]
    rows = pages.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{html_col}`").cast("string").alias(fresh("html", kept)))
    out = rows.select(*[F.col(f"`{c}`") for c in kept]).schema.add(out_col, "string").add("n_chars", "long")

    def run(batches):
        for b in split_batches(batches, len(kept)):
            texts = [main_text(h) for h in b.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                names=[*kept, out_col, "n_chars"],
            )

    return rows.mapInArrow(run, out)


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
