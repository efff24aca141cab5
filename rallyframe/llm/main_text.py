"""Main text of web pages: the maximum-scoring contiguous run of a page's tokens.

A page is read into tokens: tags and words. Words score positive where their context looks like an article's (in a link or not, kind of
block, length of the block, class names around), tags negative; the weights are log odds counted on labelled pages. A linear
scan finds the run with the largest sum; it is widened to whole blocks, and its words are the text. Words of one text node
have the same score, so the scan takes a node at a time.

Labelled pages are those that mark one main text themselves, with an <article> or <main>; the classifier is fitted on at most
`SAMPLE` page ids (those with the smallest hash), a bound that holds its counts small. Where a page marks its main text, the
mark is one more weight of its words.

Never text, wherever it lies: elements that HTML or ARIA name as menus, headers, footers, sidebars, forms, scripts, styles and the
like, elements whose class or id names such (`NOT_TEXT`; but not one that holds the page's first heading or article), and
hidden elements. A <header> inside an article is the article's own.

White space: character references are decoded, white space of a block becomes one space, blocks are joined by one space in
page order; nothing else is dropped or cut. One pass over the pages in tasks, and one over the labelled ones to count.

Cases: a null or empty page has an empty text; a page cut off inside a tag, comment or script ends there; stray `<` are text;
closing tags without an opening one are ignored; deep nesting and very long pages cost linear time; pages that repeat are read
one by one; without labelled pages the prior weights count alone; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyframe.llm import common

NAME, SQL = "op13_main_text", None

#: Pages that the weights are counted on, at most.
SAMPLE = 2_000

# Names of HTML and ARIA, and class names in use on the web.
RAW = {"script", "style", "title", "textarea", "iframe", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup",
    "time", "tt", "u", "var", "wbr", "img", "ruby", "rb", "rt", "rp", "nobr",
}
CLOSES_ITSELF = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
NOT_TEXT_ELEMENTS = {"head", "nav", "aside", "footer", "form", "noscript", "template", "object", "svg", "button", "select", "dialog", "menu", "canvas", "audio", "video", "datalist", "fieldset"}
NOT_TEXT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
NOT_TEXT = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs",
    "header", "masthead", "topbar", "footer", "cookie", "cookies", "consent", "gdpr", "notice", "notification", "alert", "banner", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription",
    "signup", "login", "share", "sharing", "social", "related", "recommended", "recommendations", "comment", "comments", "commentlist", "disqus", "respond", "replies", "widget", "toolbar", "pagination",
    "pager", "copyright", "disclaimer", "skip", "search", "form", "hidden",
}

#: Prior share of a context's text nodes among (article, other) nodes, and its weight in nodes.
PRIOR_NODES = 100.0
PRIOR = {
    "link": (0.1, 0.5), "plain": (0.9, 0.5), "words<4": (0.2, 0.35), "words<10": (0.25, 0.3), "words<30": (0.25, 0.25), "words>=30": (0.3, 0.1), "block p": (0.6, 0.2), "block li": (0.1, 0.3), "block td": (0.05, 0.1),
    "block h1": (0.1, 0.02), "block h2": (0.1, 0.05), "block blockquote": (0.05, 0.01), "block pre": (0.05, 0.01),
}
UNSEEN = (0.05, 0.05)
#: Log odds that any word starts from; bounds of a context's log odds; what a page's own mark adds or takes; the largest cost of a tag.
BIAS, BOUND, MARK, TAG = 0.5, 4.0, 6.0, 0.5

_TAG = re.compile(r"""</?[a-zA-Z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""(?:^|(?<=[\s"'/]))(class|id|role|hidden|style|aria-hidden|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?(?=[\s/>]|$)""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


@dataclass
class Page:
    """Tokens of a page, in order, and its elements with a class or a meaning."""

    #: (text, block, element, in a link, kind of block) of each text node; (name, element) of each tag
    tokens: list[tuple] = field(default_factory=list)
    #: of each element: the one around it, its class words, whether it is no text (by name, by class), its marks
    around: list[int] = field(default_factory=lambda: [-1])
    names: list[tuple] = field(default_factory=lambda: [()])
    by_name: list[bool] = field(default_factory=lambda: [False])
    by_class: list[bool] = field(default_factory=lambda: [False])
    mark: list[str | None] = field(default_factory=lambda: [None])

    def out(self) -> list[bool]:
        """Whether what lies directly in an element is no text."""
        found = []
        for k, above in enumerate(self.around):
            found.append(self.by_name[k] or self.by_class[k] or (above >= 0 and found[above]))
        return found

    def inside(self, out: list[bool]) -> list[bool] | None:
        """Whether an element lies in the page's marked main text; None without a mark."""
        for kind in ("body", "article", "main"):
            if any(m == kind and not o for m, o in zip(self.mark, out, strict=True)):
                found = []
                for k, above in enumerate(self.around):
                    found.append(self.mark[k] == kind or (above >= 0 and found[above]))
                return found
        return None


class Reader:
    """Reads a page's markup, well formed or not, into a Page."""

    def __init__(self, html: str):
        self.page, self.html = Page(), html
        self.stack: list[tuple[str, int]] = []  # name, element
        self.open: Counter = Counter()
        self.block, self.kind = 0, ["body"]
        self.first = {"h1", "article"}

    def element(self) -> int:
        return self.stack[-1][1] if self.stack else 0

    def read(self) -> Page:
        html, at, sound = self.html, 0, True
        while at < len(html):
            lt = html.find("<", at)
            if lt < 0:
                self.text(html[at:])
                break
            if lt > at:
                self.text(html[at:lt])
            after = html[lt + 1 : lt + 3]
            if after[:1] in ("!", "?"):
                end = html.find("-->", lt + 4) if html.startswith("<!--", lt) else html.find(">", lt)
                at = len(html) if end < 0 else end + (3 if html.startswith("<!--", lt) else 1)
            elif after[:1].isalpha() and after[:1].isascii() or (after[:1] == "/" and after[1:].isalpha() and after[1:].isascii()):
                found = _TAG.match(html, lt) if sound else None
                if not found:  # an odd quote: from here on tags end with the next >
                    sound = False
                    end = html.find(">", lt)
                    if end < 0:
                        break
                at = found.end() if found else end + 1
                at = self.tag(html[lt + 1 : at - 1], at)
            elif after[:1] == "/":  # a closing tag without a name is no text
                end = html.find(">", lt)
                at = len(html) if end < 0 else end + 1
            else:
                self.text("<")
                at = lt + 1
        return self.page

    def text(self, text: str) -> None:
        self.page.tokens.append((text, self.block, self.element(), self.open["a"] > 0, self.kind[-1]))

    def tag(self, inner: str, at: int) -> int:
        closing = inner.startswith("/")
        name = _NAME.match(inner, 1 if closing else 0).group().lower()
        if name in RAW and not closing:
            end = _RAW_END[name].search(self.html, at)
            gt = self.html.find(">", end.end()) if end else -1
            self.apart(name)
            return len(self.html) if gt < 0 else gt + 1
        if closing:
            self.close(name)
        else:
            self.start(name, inner[len(name) :])
        return at

    def apart(self, name: str) -> None:
        self.page.tokens.append((name, self.element()))
        if name not in INLINE:
            self.block += name != "br"
            if name == "br":
                self.text("\n")

    def pop(self) -> None:
        name, _ = self.stack.pop()
        self.open[name] -= 1
        if name not in INLINE:
            self.kind.pop()

    def close(self, name: str) -> None:
        self.apart(name)
        if self.open[name]:
            while self.stack[-1][0] != name:
                self.pop()
            self.pop()

    def start(self, name: str, rest: str) -> None:
        if self.open["p"] and name not in INLINE and name not in VOID:
            self.implied("p", set())
        if name in CLOSES_ITSELF and self.open[name]:
            self.implied(name, CLOSES_ITSELF[name])
        self.apart(name)
        if name in VOID:
            return
        self.stack.append((name, self.entered(name, rest)))
        self.open[name] += 1
        if name not in INLINE:
            self.kind.append(name)

    def implied(self, name: str, within: set[str]) -> None:
        """Closes an open element that its like, or a block, ends; not beyond the list or table around."""
        for k in range(len(self.stack) - 1, max(len(self.stack) - 32, 0) - 1, -1):
            if self.stack[k][0] == name:
                while len(self.stack) > k:
                    self.pop()
                return
            if self.stack[k][0] in within:
                return

    def entered(self, name: str, rest: str) -> int:
        """The element's number: a new one if it has a class or a meaning, else that around it."""
        page, above = self.page, self.element()
        said = {a.lower(): (v or "").strip("\"'") for a, v in _ATTRIBUTE.findall(rest)} if "=" in rest or "hidden" in rest else {}
        names = tuple({w.lower() for a in ("class", "id") for w in _PART.findall(said.get(a, ""))})
        role = said.get("role", "").lower()
        hidden = "hidden" in said or said.get("aria-hidden", "").lower() == "true" or "display:none" in said.get("style", "").replace(" ", "").lower()
        by_class = name not in ("html", "body") and any(w in NOT_TEXT for w in names)
        own = self.open["article"] > 0 or self.open["main"] > 0
        if own and "header" in names and not any(w in NOT_TEXT and w != "header" for w in names):
            by_class = False
        by_name = name in NOT_TEXT_ELEMENTS or role in NOT_TEXT_ROLES or hidden or (name == "header" and not own)
        mark = None if by_class or by_name else "body" if said.get("itemprop", "").lower() == "articlebody" else "article" if name == "article" or role == "article" else "main" if name == "main" or role == "main" else None
        trigger = "article" if mark == "article" else "h1" if name == "h1" else None
        if trigger in self.first:
            self.first.discard(trigger)
            k = above
            while k >= 0 and not page.by_name[k]:
                page.by_class[k] = False
                k = page.around[k]
        if not (names or by_name or mark):
            return above
        for column, value in ((page.around, above), (page.names, names), (page.by_name, by_name), (page.by_class, by_class), (page.mark, mark)):
            column.append(value)
        return len(page.around) - 1


def contexts(page: Page, out: list[bool]) -> Iterator[tuple[int, int, list[str], int]]:
    """Number in the tokens, words, contexts and element of each text node that may be text."""
    counts = [len(unescape(t[0]).split()) if len(t) == 5 and not out[t[2]] else 0 for t in page.tokens]
    size = Counter()
    for t, n in zip(page.tokens, counts, strict=True):
        if n:
            size[t[1]] += n
    for k, (t, n) in enumerate(zip(page.tokens, counts, strict=True)):
        if n:
            length = size[t[1]]
            yield k, n, ["link" if t[3] else "plain", "words<4" if length < 4 else "words<10" if length < 10 else "words<30" if length < 30 else "words>=30", f"block {t[4]}"], t[2]


def counted(page: Page) -> tuple[Counter, Counter] | None:
    """Text nodes of each context, and tags, in the marked text and elsewhere; None without exactly one mark."""
    out = page.out()
    inside = page.inside(out)
    if inside is None or sum(m == "article" and not o for m, o in zip(page.mark, out, strict=True)) > 1:
        return None
    found, own = (Counter(), Counter()), ([0] * len(out), [0] * len(out))
    for _, _, said, element in contexts(page, out):
        side = 0 if inside[element] else 1
        own[side][element] += 1
        for c in [*said, "all"]:
            found[side][c] += 1
    for k in range(len(out) - 1, 0, -1):  # class names count for all that lies inside
        for side in (0, 1):
            n = own[side][k]
            own[side][page.around[k]] += n
            if n and page.mark[k] is None:
                for w in page.names[k]:
                    found[side][f"class {w}"] += n
    for t in page.tokens:
        if len(t) == 2 and not out[t[1]]:
            for c in (f"tag {t[0]}", "all tags"):
                found[0 if inside[t[1]] else 1][c] += 1
    return found


def log_odds(counts: dict[str, tuple[int, int]]) -> dict[str, float]:
    """The weight of every context; what no labelled page has keeps its prior."""
    weights = {}
    for c in {*PRIOR, *counts}:
        if c.startswith("all"):
            continue
        total = counts.get("all tags" if c.startswith("tag ") else "all", (0, 0)) if any(counts.get(c, ())) else (0, 0)
        share = [(n + PRIOR_NODES * p) / (t + PRIOR_NODES) for n, t, p in zip(counts.get(c, (0, 0)), total, PRIOR.get(c, UNSEEN), strict=True)]
        weights[c] = max(-BOUND, min(BOUND, math.log(share[0] / share[1])))
    return weights


def squashed(z: float) -> float:
    return math.tanh(z / 2)


def extract(html: str | None, weights: dict[str, float], marks: bool = True) -> str:
    """The main text. marks: whether a page's own <article> or <main> counts."""
    if not html:
        return ""
    page = Reader(html).read()
    out = page.out()
    inside = page.inside(out) if marks else None
    around = [0.0]  # the least weight of the class names around
    for k in range(1, len(out)):
        around.append(min([around[page.around[k]], *(weights.get(f"class {w}", 0.0) for w in page.names[k])]))
    score = [0.0 if len(t) == 5 or out[t[1]] else -TAG / (1 + math.exp(weights.get(f"tag {t[0]}", 0.0))) for t in page.tokens]
    words = [False] * len(score)
    for k, n, said, element in contexts(page, out):
        z = BIAS + sum(weights.get(c, 0.0) for c in said) + around[element]
        if inside is not None:
            z = (max(z, 0.0) + MARK) if inside[element] else -MARK
        score[k], words[k] = n * squashed(z), True
    best, start, total, run = 0.0, 0, 0.0, (0, 0)
    for k, s in enumerate(score):
        if total <= 0:
            total, start = 0.0, k
        total += s
        if total > best:
            best, run = total, (start, k + 1)
    if best <= 0:
        return ""
    nodes = [k for k in range(*run) if words[k]]
    first, last = page.tokens[nodes[0]][1], page.tokens[nodes[-1]][1]
    text, block = [], None
    for k, t in enumerate(page.tokens):
        if len(t) == 5 and first <= t[1] <= last and not out[t[2]] and (inside is None or inside[t[2]]):
            text.append(unescape(t[0]) if block == t[1] else " " + unescape(t[0]))
            block = t[1]
    return " ".join("".join(text).split())


def fitted(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE) -> dict[str, float]:
    """Weights counted on the labelled pages among at most `sample` page ids."""
    ids = pages.select(F.col(id_col).alias("i")).dropna().distinct().orderBy(F.xxhash64("i"), "i").limit(sample)
    chosen = [r[0] for r in ids.collect()]
    rows = pages.where(F.col(id_col).isin(chosen)).select(F.col(html_col).cast("string").alias("html")) if chosen else pages.limit(0).select(F.lit("").alias("html"))

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = (Counter(), Counter())
        for batch in common.batches(it, "html"):
            for html in batch["html"].to_pylist():
                for side, found in zip(total, counted(Reader(html or "").read()) or (), strict=False):
                    side.update(found)
        names = sorted({*total[0], *total[1]})
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([side[c] for c in names], pa.int64()) for side in total)], ["context", "inside", "outside"])

    sums = rows.mapInArrow(count, "context string, inside long, outside long").groupBy("context").agg(F.sum("inside"), F.sum("outside"))
    return log_odds({c: (a, b) for c, a, b in sums.collect()})  # contexts of a bounded number of pages


def extracted(pages: DataFrame, weights: dict[str, float], id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",), marks: bool = True) -> DataFrame:
    """id_col, the columns to keep, and text of every page."""
    kinds = dict(pages.dtypes)
    rows = pages.select(id_col, *keep, F.col(html_col).cast("string").alias("_html"))
    shared = pages.sparkSession.sparkContext.broadcast(weights)
    names = [id_col, *keep]

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.batches(it, "_html"):
            texts = pa.array([extract(h, shared.value, marks) for h in batch["_html"].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), texts], [*names, "text"])

    return rows.mapInArrow(read, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extracted(pages, fitted(pages)).withColumn("n_chars", F.length("text").cast("long"))
