"""Main text of web pages by tag-path ratios.

A page is read in one pass over its characters (attributes with quotes, raw elements, comments, unclosed tags as browsers take
them) into elements and text nodes. Every text node has a root-to-leaf tag path: the tags with their class words, inline
formatting left out. Then:

1. Aggregate: text length per node and punctuation marks per node of every path.
2. Smooth: both ratios, in page order, with a Gaussian of ``SIGMA`` nodes.
3. Fuse: the geometric mean of a path's own and smoothed length x (1 + marks), averaged over its nodes, times its prior.
4. Threshold: paths of at least ``THRESHOLD`` standard deviations of the nodes' scores are content.

The prior only scales a path's ratio: ``FAINT`` for elements that menus, headers, footers, sidebars, notices, adverts, forms and
comments are made of (by tag or role, or by a class or id of which every word says so), ``DOUBTFUL`` where a single word of a
class says so, ``FAVOURED`` inside article and main. It never applies to html, body, main, article or headings, and a page's
header inside its article is no furniture. So what a page has is judged against the rest of the page: a page whose text is all
in a sidebar gives that text.

Home is the deepest element that holds ``HELD`` of the content's weight, widened to its article, or as long as what is added is
little. In home, blocks below the threshold stay (headings, short items) unless their prior is against them or they are lists of links.
Outside of home only content paths count, and headings right under home's ancestors before it.

Character references are decoded, white space in a block becomes one space, blocks are joined by one line feed. A line break
is white space; what isn't displayed (hidden, display: none) is no text. Null and empty pages, and pages without text, give the
empty text. Unclosed and stray tags are repaired as browsers do for paragraphs and list items. Repeated pages each get their
row; other columns are ignored. Time is linear in the page's length, whatever its nesting.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.llm.arrow_text import as_array, as_list, steps

#: Smoothing width in nodes, threshold in standard deviations, share of the content's weight that home must hold, and how much
#: more text (as a share of home's) each wider element may add.
SIGMA, THRESHOLD, HELD, MORE = 1.0, 0.5, 0.8, 0.25
#: Priors.
FAINT, WORDED, DOUBTFUL, FAVOURED = 0.002, 0.005, 0.7, 3.0
#: Share of a block's or list's characters in links above which it is links, and the least blocks of a list of links.
LINKED, LINKS = 0.6, 3
INLINE = frozenset("abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Not displayed: their text is no text, and nothing in them is a tag.
RAW = frozenset("script style noscript template textarea title iframe svg math object select datalist".split())
IN_HEAD = frozenset("meta link base bgsound basefont".split()) | RAW
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NEUTRAL = frozenset("html body main article".split()) | HEADINGS
#: Furniture by tag, by role, and by words of class and id; qualifiers say nothing by themselves.
FURNITURE_TAGS = frozenset("nav header footer aside form menu dialog button label fieldset legend".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
TOP_WORDS = frozenset("header masthead banner topbar".split())
FURNITURE_WORDS = TOP_WORDS | frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored promo promotion nav navbar navigation navi menu menubar breadcrumb breadcrumbs "
    "footer foot bottombar sidebar side aside rail widget widgets cookie cookies consent gdpr notice notices notification alert popup modal overlay subscribe "
    "subscription newsletter signup login comment comments reply replies respond discussion disqus feedback share sharing social related recommended recommendations trending "
    "popular pagination pager tags toolbar skip copyright legal search form".split()
)
QUALIFIERS = frozenset("site page main global user users reader readers top bottom left right primary secondary box bar list area section wrap wrapper container inner outer block thread item items link links post posts article entry the js ui c".split())
#: Blocks of text rather than containers of it.
TEXT_BLOCKS = frozenset("p a li pre ul ol dl dt dd table tbody thead tr td th blockquote figure figcaption".split()) | HEADINGS
LISTS = ("ul", "ol", "dl", "table")
#: A start tag of one of these closes an open paragraph.
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li".split())
CLOSES_SAME = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}
P_SCOPE = ("table", "button", "td", "th")
_NAME = re.compile(r"[^\s/>]*+")
#: What may end a tag: its bracket, or the beginning of a quoted value.
_EDGE = re.compile(r""">|=\s*+(["'])""")
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|style|hidden|aria-hidden|itemprop)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"']++)))?(?![^\s/>"'])""", re.I)
_HIDDEN = re.compile(r"(?:display\s*+:\s*+none|visibility\s*+:\s*+hidden)", re.I)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_MARKS = re.compile(r"[.,;:!?¡¿…。，、；：！？]")


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), a or b or c)
    return out


def _worded(names: str, inside: bool) -> float:
    """The prior of class and id words; ``inside``: in an article, where headers are the article's own."""
    prior = 1.0
    for token in names.split():
        words = [w.lower() for w in _PARTS.findall(token)]
        said = [w for w in words if w in FURNITURE_WORDS and not (inside and w in TOP_WORDS)]
        if not said:
            continue
        rest = [w for w in words if w not in FURNITURE_WORDS]
        top_only = all(w in TOP_WORDS for w in said)
        own = not (top_only and any(w in ("post", "article", "entry") for w in rest))
        prior = min(prior, WORDED if own and all(w in QUALIFIERS for w in rest) else DOUBTFUL)
    return prior


class Page:
    """Elements (parent, tag, path, prior, hidden) and text nodes (element, block, in a link, text) of one page, in page order."""

    def __init__(self, html: str):
        self.parent, self.tag, self.path = [-1], ["#"], [0]
        self.hidden, self.inside, self.link = [False], [False], [False]
        #: Priors of paths; steps (path above, tag, class words, prior) have numbers, so paths are never written out.
        self.prior = [1.0]
        self._steps: dict[tuple, int] = {}
        self.nodes: list[tuple[int, int, str]] = []
        self.stack, self.open, self.block = [0], defaultdict(list), 0
        self._read(html)

    def _read(self, html: str) -> None:
        size, at, last = len(html), 0, html.rfind(">")
        final = {q: html.rfind(q) for q in "\"'"}
        while at < size:
            start = html.find("<", at)
            if start < 0:
                start = size
            if start > at:
                self.nodes.append((self.stack[-1], self.block, html[at:start]))
            if start == size:
                return
            follows = html[start + 1 : start + 2]
            closing = follows == "/"
            first = html[start + 2 : start + 3] if closing else follows
            if first.isascii() and first.isalpha():
                if start > last:
                    return  # a tag that never ends is dropped
                begin = start + 1 + closing
                name_end = _NAME.match(html, begin).end()
                stop = name_end
                while (edge := _EDGE.search(html, stop)) and edge[1]:
                    stop = edge.end()
                    if final[edge[1]] >= stop:
                        stop = html.find(edge[1], stop) + 1
                if not edge:
                    return
                at = edge.end()
                tag = html[begin:name_end].lower()
                if closing:
                    self._end(tag)
                    continue
                raw = html[name_end : edge.start()]
                self._start(tag, raw)
                if tag in RAW and not raw.rstrip().endswith("/"):
                    end = _RAW_END[tag].search(html, at)
                    at = end.start() if end else size
            elif html.startswith("<!--", start):
                end = html.find("-->", start + 2)
                at = size if end < 0 else end + 3
            elif follows in ("!", "?") or closing:
                end = html.find(">", start)
                at = size if end < 0 else end + 1
            else:
                self.nodes.append((self.stack[-1], self.block, "<"))
                at = start + 1

    def _cut(self, place: int) -> None:
        """Closes the open elements from ``place`` in the stack on."""
        for e in reversed(self.stack[place:]):
            self.open[self.tag[e]].pop()
        del self.stack[place:]

    def _close(self, tag: str, scope: tuple[str, ...] = ()) -> None:
        if places := self.open.get(tag):
            if all(not (edge := self.open.get(s)) or edge[-1] < places[-1] for s in scope):
                self._cut(places[-1])

    def _start(self, tag: str, raw: str) -> None:
        if tag in INLINE:
            if tag == "br":
                self.nodes.append((self.stack[-1], self.block, " "))
            return
        if tag in RAW:
            return
        if self.open.get("head") and tag not in IN_HEAD:
            self._cut(self.open["head"][-1])
        if tag != "a":
            self.block += 1
        if tag in CLOSES_P:
            self._close("p", P_SCOPE)
        if tag in CLOSES_SAME:
            self._close(tag, CLOSES_SAME[tag])
        if tag in VOID:
            return
        up = self.stack[-1]
        said = _attributes(raw) if raw and not raw.isspace() else {}
        hidden = tag == "head" or "hidden" in said or said.get("aria-hidden", "").lower() == "true" or bool(_HIDDEN.search(said.get("style", "")))
        role, names = said.get("role", "").lower(), f"{said.get('class', '')} {said.get('id', '')}".strip()
        inside = self.inside[up]
        prior = 1.0
        favoured = tag in ("article", "main") or role in ("article", "main") or "articlebody" in said.get("itemprop", "").lower()
        if tag not in NEUTRAL:
            if (tag in FURNITURE_TAGS and not (tag == "header" and inside)) or role in FURNITURE_ROLES:
                prior = FAINT
            elif names:
                prior = _worded(names, inside)
        step = (self.path[up], tag, said.get("class", ""), prior, favoured and not inside)
        path = self._steps.setdefault(step, len(self.prior))
        if path == len(self.prior):
            self.prior.append(max(self.prior[step[0]] * prior * (FAVOURED if step[4] else 1.0), 1e-30))
        self.open[tag].append(len(self.stack))
        self.stack.append(len(self.parent))
        self.parent.append(up)
        self.tag.append(tag)
        self.path.append(path)
        self.hidden.append(self.hidden[up] or hidden)
        self.inside.append(inside or favoured)
        self.link.append(self.link[up] or tag == "a")

    def _end(self, tag: str) -> None:
        if tag in INLINE or tag in RAW:
            return
        if tag != "a":
            self.block += 1
        self._close(tag)


def _smooth(x: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    around = lambda v: np.convolve(np.pad(v, reach), kernel, "valid")
    return around(x) / around(np.ones(len(x)))


def path_scores(paths: np.ndarray, lengths: np.ndarray, marks: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Every node's fused, smoothed ratio of its path, times the prior of the path."""
    _, code = np.unique(paths, return_inverse=True)
    n = np.bincount(code)
    long, marked = (np.bincount(code, lengths) / n)[code], 1 + (np.bincount(code, marks) / n)[code]
    fused = np.sqrt(long * _smooth(long) * marked * _smooth(marked))
    return (np.bincount(code, fused) / n)[code] * prior


def content_nodes(scores: np.ndarray) -> np.ndarray:
    """Which nodes' paths pass the threshold; the best always does."""
    return scores >= min(THRESHOLD * scores.std(), scores.max() / 2)


def _up(page: Page, values: np.ndarray) -> np.ndarray:
    """Sums over every element and what is in it (children come after their parents)."""
    total = values.tolist()
    for e in range(len(total) - 1, 0, -1):
        total[page.parent[e]] += total[e]
    return np.array(total)


def main_text(html: str | None) -> str:
    """The main text of one page."""
    if not html:
        return ""
    page = Page(html)
    nodes = [(e, b, raw) for e, b, raw in page.nodes if not page.hidden[e]]
    texts = [unescape(raw) if "&" in raw else raw for *_, raw in nodes]
    shown = [k for k, t in enumerate(texts) if t and not t.isspace()]
    if not shown:
        return ""
    element = np.array([nodes[k][0] for k in shown])
    lengths = np.array([len(texts[k].strip()) for k in shown], float)
    marks = np.array([len(_MARKS.findall(texts[k])) for k in shown], float)
    paths = np.array(page.path)[element]
    prior = np.array(page.prior)[paths]
    scores = path_scores(paths, lengths, marks, prior)
    content = content_nodes(scores)
    size = len(page.parent)
    linked = np.array(page.link)[element]
    # blocks: whether any of their nodes is content, their outermost element, prior and length in and out of links
    block_of = np.array([nodes[k][1] for k in shown])
    names, block = np.unique(block_of, return_inverse=True)
    m = len(names)
    good = np.zeros(m, bool)
    good[block[content]] = True
    outer = np.full(m, size)
    np.minimum.at(outer, block, element)
    against = np.ones(m)
    np.minimum.at(against, block, prior)
    long, in_links = np.bincount(block, lengths, m), np.bincount(block, lengths * linked, m)
    at_element = lambda v: _up(page, np.bincount(outer, v, size))
    weight = at_element(long * good)
    blocks_in, long_in, links_in = at_element(np.ones(m)), at_element(long), at_element(in_links)
    # blocks that only their element's kind speaks for: headings, short items; but no furniture and no lists of links
    group = [_list_of(page, e) for e in outer.tolist()]
    of_links = (in_links > LINKED * long) & (links_in[group] > LINKED * long_in[group]) & (blocks_in[group] >= LINKS)
    plain = (against >= 0.5) & ~of_links
    ok = good | plain
    home = max((e for e in range(size) if weight[e] >= HELD * weight[0] and page.tag[e] not in TEXT_BLOCKS), default=0)
    home = _widened(page, home, at_element(long * ok), at_element(long * good))
    inside, before = [False] * size, set()
    for e in range(size):
        inside[e] = e == home or (e > 0 and inside[page.parent[e]])
    e = home
    while e >= 0:
        before.add(e)
        e = page.parent[e]
    out: dict[int, list[str]] = {}
    chosen = set()
    for k, e in enumerate(outer.tolist()):
        heading = page.tag[e] in HEADINGS and page.parent[e] in before and e < home and plain[k]
        if (ok[k] if inside[e] else good[k] or heading):
            chosen.add(int(names[k]))
    for (_, b, _), t in zip(nodes, texts, strict=True):
        if b in chosen:
            out.setdefault(b, []).append(t)
    return "\n".join(t for parts in out.values() if (t := " ".join("".join(parts).split())))


def _list_of(page: Page, e: int, most: int = 8) -> int:
    """The list or table that a block is part of (looking ``most`` elements up), else its parent."""
    at = e
    for _ in range(most):
        if at < 0:
            break
        if page.tag[at] in LISTS:
            return at
        at = page.parent[at]
    return max(page.parent[e], 0)


def _widened(page: Page, home: int, allowed: np.ndarray, good: np.ndarray) -> int:
    """Home's article, if it has one, or its ancestors below the body while they add little text that could stay."""
    e = home
    while e > 0:
        if page.tag[e] in ("article", "main"):
            return e
        e = page.parent[e]
    while (up := page.parent[home]) > 0 and page.tag[up] not in ("html", "body") and allowed[up] - allowed[home] <= MORE * good[home]:
        home = up
    return home


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """id, the columns of ``keep``, text and n_chars (its code points) of every page."""
    kinds = dict(pages.dtypes)
    columns = [F.col(id_col).alias("id"), *(F.col(c) for c in keep), F.col(html_col).alias("html")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "html"):
                texts = [main_text(h) for h in as_list(as_array(part.column(part.num_columns - 1)))]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", *keep, "text", "n_chars"])

    return pages.select(*columns).mapInArrow(run, f"id {kinds[id_col]}, " + "".join(f"`{c}` {kinds[c]}, " for c in keep) + "text string, n_chars bigint")
