"""Main text of web pages by tag-path ratios.

A page is cut into tags and text. Each text goes to its root-to-leaf tag path (block tags with their class, without
its numbers; ids, and the classes of a list's or table's items, only weigh, so that items are one path); paths are nodes of
a trie with links to their parents. Per path the length of the text, its
punctuation, the length within links and the number of texts are summed; the ratio of a path is text and
punctuation outside links against its texts. Names and tags that tell what a part is for only weigh: the
weights of a path's steps multiply. Weighed ratios are fused upwards, so that every node knows what its
paths hold, and the region of the content is the deepest node that holds nearly all of it, or the article
or main element on the way there; a headline next to the region opens it by one level or more. In the region
weights count from the region down, so a wrapper's name has no say. A path is content if its smoothed ratio
(its own, or a share of its neighbours', halved with each step in page order) times its weight reaches a
share of the region's mean: adverts, comments, forms and bars of links fall below it, short headings, bylines,
paragraphs, items and lists of references do not. Elements that share the content's path are told apart by what each holds
in comparison with the largest. Inline elements are part of their block whatever their names.

Null or empty pages give an empty text. Every page gives one row, repeated rows too; an empty table gives an
empty result; nothing is shuffled. Tag soup, unclosed tags and cut-off pages are read as far as they go. Time is
linear in the page, however deep its tags are nested. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lobspark.llm.common import in_batches

#: Quotes count only at the start of a value, as in browsers.
MARK = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>]*+))*+)(?:>|\Z)",
    re.S,
)
NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
#: Items of lists and tables: one path a list, whatever their classes.
ITEMS = frozenset("li dt dd tr td th tbody thead tfoot".split())
NUMBER = re.compile(r"\d+")
#: Tags whose content is text up to their end tag, none of it content.
RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?|\Z", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noframes", "template", "svg")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags that stand for a block of text of their own.
BLOCK = frozenset("html head body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre section summary table caption tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Tags without text for a reader.
NEVER = frozenset("head select button object".split())
#: p ends at these, which cannot stand inside it.
ENDS_P = BLOCK - {"html", "head", "body", "option", "optgroup", "legend", "summary", "caption"}
HOLDS_P = ("table", "td", "th", "button", "object", "div", "section", "article")
#: A start tag that ends an open one of the same group, up to the given holder.
SAME = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
PUNCTUATION = re.compile(r"[.,;:!?…、。，！？]")
BLANK = re.compile(r"\s+")

#: What tags weigh; others 1. The header of an article is part of it.
TAG_WEIGHTS = {"nav": 0.02, "footer": 0.02, "aside": 0.05, "form": 0.05, "header": 0.05, "menu": 0.05, "dialog": 0.02}
#: What words in a class, id or role weigh: as a name of their own, and as a part of a longer name.
WORDS = {
    (0.02, 0.1): "ad ads advert advertisement advertising advertorial sponsor sponsored comments comment disqus replies cookie cookies consent gdpr popup modal newsletter subscribe signup login nav navbar navigation menu menus breadcrumb breadcrumbs sidebar footer masthead copyright pagination pager toolbar contentinfo complementary",
    (0.1, 0.5): "banner promo promos promotion promotions reply respond notice widget related recommended share sharing social header legal skip search",
}
NAME_WEIGHTS = {w: weights for weights, words in WORDS.items() for w in words.split()}
#: Whole names that a longer one may end in and still mean the same.
TAILS = frozenset("area bar bars block box container content footer form header holder inner item items link links list main panel section slot slots text title top unit units wrap wrapper zone 1 2 3".split())
PARTS = re.compile(r"[-_]+")

#: Share of a node's ratio that a deeper region must hold; how much more the article and main elements count for that.
KEEP_REGION = 0.8
MARKED = 3.0
#: Weight of what stands beside the region that a headline opened, and of link lists.
BESIDE = 0.25
LINKS = 0.05
#: Share of the region's mean ratio that a path must reach, and of a neighbour's ratio that smoothing hands on.
LEAST_RATIO = 0.1
HAND_ON = 0.5
#: Share of the largest element's text below which one of the same path, before or after it, is no content.
LEAST_ELEMENT = 0.1
#: The same for one whose texts have no path in common with the largest's.
STRANGER = 0.7


@lru_cache(maxsize=1 << 14)
def weight(tag: str, names: str) -> float:
    """What a step of a path weighs by its tag and names."""
    w = TAG_WEIGHTS.get(tag, 1.0)
    if names and tag not in ("html", "body", "main", "article"):
        for name in names.lower().split():
            parts = PARTS.split(name)
            known = [NAME_WEIGHTS[p] for p in parts if p in NAME_WEIGHTS]
            if known:
                whole = all(p in NAME_WEIGHTS or p in TAILS for p in parts) and parts[0] in NAME_WEIGHTS
                w = min(w, *(k[0 if whole else 1] for k in known))
    return w


class Page:
    """Texts of a page: blocks in order, each with its path; and the trie of paths, parents first."""

    def __init__(self, html: str) -> None:
        self.parent, self.tag, self.weight = [0], [""], [1.0]
        self.child: dict[tuple[int, str, str, float], int] = {}
        self.stack: list[tuple[str, int, bool, int]] = []  # tag, path, whether it hides its text, element
        self.of, self.within = [0], [0]  # of elements: their path, and the element around them; parents first
        self.places: dict[str, list[int]] = {}  # where in the stack a tag is open
        self.holders: list[int] = []  # where in the stack a block is open
        self.blocks: list[tuple[int, str, int, int]] = []  # path, text, characters within links, element
        self.open: list[str] = []
        self.path: int | None = None
        self.element = 0
        self.linked = self.hidden = 0
        self._read(html)

    def _flush(self) -> None:
        if self.open:
            text = BLANK.sub(" ", "".join(self.open)).strip()
            if text and self.path is not None:
                self.blocks.append((self.path, text, self.linked, self.element))
        self.open, self.path, self.linked = [], None, 0

    def _text(self, raw: str) -> None:
        if not raw or self.hidden:
            return
        text = unescape(raw) if "&" in raw else raw
        self.open.append(text)
        if self.path is None and not text.isspace():
            self.path, self.element = (self.stack[-1][1], self.stack[-1][3]) if self.stack else (0, 0)
        if self.places.get("a"):
            self.linked += len(text.strip())

    def _pop(self) -> None:
        tag, _, hides, _ = self.stack.pop()
        self.places[tag].pop()
        self.hidden -= hides
        if tag in BLOCK:
            self.holders.pop()
            self._flush()

    def _last(self, tags: tuple[str, ...]) -> int:
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=-1)

    def _close(self, tags: tuple[str, ...], above: int) -> None:
        """Closes the innermost of the tags, with all in it, if it is open above a place of the stack."""
        at = self._last(tags)
        if at > above:
            while len(self.stack) > at:
                self._pop()

    def _start(self, tag: str, attrs: str) -> None:
        if tag in BLOCK:
            self._flush()
        if tag in ENDS_P and self.places.get("p"):
            self._close(("p",), self._last(HOLDS_P))
        if tag in SAME:
            tags, within = SAME[tag]
            self._close(tags, self._last(within))
        if tag == "br":
            self._text(" ")
        if tag in VOID:
            return
        path, hides, element = self.stack[-1][1] if self.stack else 0, tag in NEVER, self.stack[-1][3] if self.stack else 0
        if tag in BLOCK:
            named = [(m[1].lower(), m[2] or m[3] or m[4] or "") for m in NAMES.finditer(attrs)] if "=" in attrs else []
            names = " ".join(v for _, v in named)
            own = 1.0 if tag == "header" and not names and (self.places.get("article") or self.places.get("main")) else weight(tag, names)
            classes = "" if tag in ITEMS else NUMBER.sub("", " ".join(v for k, v in named if k == "class"))
            step = (path, tag, classes, own)
            if step not in self.child:
                self.child[step] = len(self.parent)
                self.parent.append(path)
                self.tag.append(tag)
                self.weight.append(own)
            path = self.child[step]
            self.of.append(path)
            self.within.append(element)
            element = len(self.of) - 1
            self.holders.append(len(self.stack))
        self.hidden += hides
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, path, hides, element))

    def _read(self, html: str) -> None:
        at, n = 0, len(html)
        while at < n:
            m = MARK.search(html, at)
            if not m:
                self._text(html[at:])
                break
            self._text(html[at : m.start()])
            at = m.end()
            if m["cdata"] is not None:
                self._text(m["cdata"])
            elif m["tag"]:
                tag = m["tag"].lower()
                if m["end"]:
                    if tag in BLOCK:
                        self._flush()
                    self._close((tag,), -1 if tag in BLOCK or not self.holders else self.holders[-1])
                elif tag in RAW:
                    at = RAW[tag].search(html, at).end()
                else:
                    self._start(tag, m["attrs"])
        self._flush()


def content(html: str | None, least: float = LEAST_RATIO) -> list[str]:
    """The blocks of main text, in page order."""
    if not html:
        return []
    page = Page(html)
    if not page.blocks:
        return []
    parent, tag, n = page.parent, page.tag, len(page.parent)
    chars, marks, linked, times = ([0] * n for _ in range(4))
    order: dict[int, None] = {}  # paths with text, as they come
    for path, text, link, _ in page.blocks:
        chars[path] += len(text)
        marks[path] += len(PUNCTUATION.findall(text))
        linked[path] += min(link, len(text))
        times[path] += 1
        order[path] = None
    ratio = [0.0] * n
    for i in order:
        free = (chars[i] - linked[i]) / chars[i]
        ratio[i] = free * (chars[i] + 10 * marks[i]) / times[i]
    # Fused upwards: what every node's paths hold, by weight; children come after their parents.
    total = [1.0] * n
    for i in range(1, n):
        total[i] = max(1e-30, total[parent[i]] * page.weight[i])
    mass = [ratio[i] * times[i] * total[i] for i in range(n)]
    heavy = [0] * n
    for i in range(n - 1, 0, -1):
        if tag[i] in ("article", "main"):
            mass[i] *= MARKED
        p = parent[i]
        mass[p] += mass[i]
        if not heavy[p] or mass[i] >= mass[heavy[p]]:
            heavy[p] = i
    region, article, main = 0, 0, 0
    while heavy[region] and mass[heavy[region]] >= KEEP_REGION * mass[region] and mass[region] > 0 and tag[heavy[region]] not in ("p", *HEADINGS):
        region = heavy[region]
        article = article or (region if tag[region] == "article" else 0)
        main = region if tag[region] == "main" else main
    core = region = article or main or region
    if not (article or main):  # a headline beside the region belongs to it
        for i in order:
            if tag[i] in ("h1", "h2") and total[i] >= BESIDE * total[core]:
                up = i
                above = set()
                while up:
                    above.add(up)
                    up = parent[up]
                top = core
                while top and top not in above:
                    top = parent[top]
                region = top
                break
    leads, up = {region}, core  # on the way from the region to its core names have no say
    while up != region:
        leads.add(up)
        up = parent[up]
    inside, within, scale = [False] * n, [False] * n, [1.0] * n
    for i in range(n):
        p = parent[i]
        inside[i] = i == region or i > 0 and inside[p]
        within[i] = i == core or i > 0 and within[p]
        if inside[i] and i not in leads:
            scale[i] = max(1e-30, scale[p] * page.weight[i])
    places = [i for i in order if inside[i]]
    for i in places:
        if not within[i] and tag[i] not in HEADINGS:
            scale[i] *= BESIDE
        if 2 * linked[i] > chars[i] and not (article or main) and tag[i] not in HEADINGS and not (within[i] and tag[i] in ITEMS):
            scale[i] *= LINKS
    own = [scale[i] * ratio[i] for i in places]
    smooth = list(own)
    for k in range(1, len(places)):
        smooth[k] = max(smooth[k], HAND_ON * smooth[k - 1])
    for k in range(len(places) - 2, -1, -1):
        smooth[k] = max(smooth[k], HAND_ON * smooth[k + 1])
    mean = sum(o * chars[i] for o, i in zip(own, places, strict=True)) / sum(chars[i] for i in places) if places else 0.0
    good = {i for i, o, s in zip(places, own, smooth, strict=True) if max(o, scale[i] * s) >= least * mean}
    out = _elements(page, core) if not (article or main) else None
    return [text for path, text, _, e in page.blocks if path in good and (out is None or e not in out)]


def _elements(page: Page, core: int) -> set[int]:
    """Elements beside the content that share its path: if one element of the core's path holds most of what they all hold, those before
    and after it that hold little in comparison, and have no headline, are bars, adverts and footers."""
    inside: list[int] = [0] * len(page.of)  # the core's element that an element is in
    for e in range(1, len(page.of)):
        inside[e] = inside[page.within[e]] or (e if page.of[e] == core else 0)
    mass: dict[int, float] = {}
    paths: dict[int, set[int]] = {}
    titled = set()
    for path, text, link, e in page.blocks:
        if inside[e]:
            mass[inside[e]] = mass.get(inside[e], 0.0) + (len(text) + 10 * len(PUNCTUATION.findall(text))) * (1 - min(link, len(text)) / len(text))
            paths.setdefault(inside[e], set()).add(path)
            if page.tag[path] in ("h1", "h2"):
                titled.add(inside[e])
    if len(mass) < 2:
        return set()
    most = max(mass.values())
    if 2 * most < sum(mass.values()):
        return set()
    largest = paths[max(mass, key=lambda e: mass[e])]
    kept = [e for e, m in mass.items() if m >= (LEAST_ELEMENT if paths[e] & largest else STRANGER) * most or e in titled]
    gone = {e for e in mass if e < kept[0] or e > kept[-1]}
    return {e for e in range(len(page.of)) if inside[e] in gone} if gone else set()


def extracted(pages: DataFrame, html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = ["\n".join(content(h)) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return in_batches(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col(html).cast("string")), run, "page_id long, url string, text string, n_chars long")
