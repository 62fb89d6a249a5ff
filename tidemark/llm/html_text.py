"""Main text of web pages: flat text blocks, classified by a decision tree.

A page becomes a flat list of text blocks in one pass that takes time in proportion to its length, whatever its nesting
and however broken its tags.  A block's features are its own word count and link density, those of its neighbours,
whether it is a heading, what encloses it (an article, named content, or neither, and what the page has at best), and
how plainly elements and their names say that it is a menu, side box, advert, notice or reader comment.  A small
decision tree, trained here on a small labelled table, says which blocks are the article's.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Elements by what they do to the text around them.
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
UNSEEN = frozenset("head template noscript svg canvas audio video select datalist button map".split())
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
FURNITURE = frozenset("nav footer aside dialog menu".split())
BLOCK = frozenset("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base basefont bgsound br col embed frame hr img input link meta param source track wbr".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose end tag may be missing close those of the same set within the nearest list or table.
IMPLIED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "p": ("p",), "thead": ("tr", "td", "th"), "tbody": ("tr", "td", "th"), "tfoot": ("tr", "td", "th")}
SCOPE = frozenset("ul ol dl table tbody thead tfoot select article section div main body html td th li blockquote button".split())
#: Words of class and id names and of roles: those that say plainly what a box is, and those that text boxes may have too.
PLAIN = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs masthead footer sidebar sidenav rail pagination pager contentinfo complementary banner "
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notices popup modal paywall newsletter "
    "comment comments commentlist respond disqus replies".split()
)
VAGUE = frozenset("header widget toolbar share sharing social related recommended recommendations subscribe subscription signup signin login search toc skip alert overlay disclaimer promoted reviews tags".split())
#: Words that only say where a box is or of what kind: a name counts if one part of it does and all others are such.
NEUTRAL = frozenset(
    "a the box bar left right top bottom main primary secondary site page list area wrapper wrap container section block inner outer item items link links post posts entry article story global local mobile desktop user reader form slot unit text policy panel column col row header body content head title sticky fixed floating side "
    "button buttons icon icons count counter label widgets tabs tab media news articles stories topics thread threads google fb inline native large small medium collapse toggle dropdown expanded default fluid new more".split()
)
CONTENT_NAMES = frozenset("article content post entry story main body text".split())

_S = r"[ \t\n\f\r]"
_TAG = re.compile(rf"<(/?)([a-zA-Z][^ \t\n\f\r/>]*+)((?:[ \t\n\f\r/]++|(?:=?[^ \t\n\f\r/>=]++|=)(?:{_S}*+={_S}*+(?:\"[^\"]*+\"|'[^']*+'|[^ \t\n\f\r>\"'][^ \t\n\f\r>]*+)?+)?+)*+)>")
_ATTRIBUTE = re.compile(rf"([^ \t\n\f\r/>=]++)(?:{_S}*+={_S}*+(?:\"([^\"]*+)\"|'([^']*+)'|([^ \t\n\f\r>\"'][^ \t\n\f\r>]*+))?+)?+")
_NAMED = re.compile(r"class|id|role|hidden|style", re.I)
_COMMENT_END = re.compile(r"--!?>")
_NAME_PART = re.compile(r"[a-z]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
_RAW_END = {name: re.compile(rf"</{name}(?=[ \t\n\f\r/>])", re.I) for name in RAW}


@dataclass(slots=True)
class Block:
    text: str
    words: int
    link_words: int
    container: int  # 2 in an article, 1 in main or a box named as content, 0 elsewhere
    hint: int  # 2 where the page says plainly that this is no article text, 1 where it may say so
    heading: bool

    @property
    def link_density(self) -> float:
        return self.link_words / self.words if self.words else 0.0


def _named(token: str) -> int:
    """How plainly a class, id or role name says that a box holds no article text."""
    parts = _NAME_PART.findall(token)
    if len(parts) > 1 and "".join(parts) in PLAIN:
        return 2
    plain = vague = False
    for p in parts:
        if p in PLAIN:
            plain = True
        elif p in VAGUE:
            vague = True
        elif p not in NEUTRAL:
            return 0
    return 2 if plain else int(vague)


@cache
def _place_of_names(value: str) -> tuple[int, bool]:
    """The plainest hint of the names, and whether one of them names content."""
    tokens = value.split()
    content = any(set(p := _NAME_PART.findall(t)) & CONTENT_NAMES and not {"wrapper", "container", "page", "site"} & set(p) and not _named(t) for t in tokens)
    return max(map(_named, tokens), default=0), content


def _place(name: str, attrs: str) -> tuple[bool, int, int]:
    """What an element's tag and names say about what is in it: (unseen, hint, container)."""
    unseen, hint, container = name in UNSEEN, 2 * (name in FURNITURE), 2 * (name == "article") or int(name == "main")
    if attrs and _NAMED.search(attrs):
        for key, *values in _ATTRIBUTE.findall(attrs):
            key, value = key.lower(), "".join(values)
            value = (_HUMP.sub("-", value) if key in ("class", "id") else value).lower()
            if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
                unseen = True
            elif key in ("class", "id", "role") and name not in ("html", "body"):
                if key == "role" and value in ("article", "main"):
                    container = max(container, 2 if value == "article" else 1)
                    continue
                if len(value) > 200:
                    found = _place_of_names.__wrapped__(value)
                else:
                    found = _place_of_names(value)
                if name not in HEADING or found[0] == 2:
                    hint = max(hint, found[0])
                if found[1] and name in ("div", "section", "td") and not container:
                    container = 1
    return unseen, hint, container


class _Page:
    """The stack of open elements, with the positions of each kind, so that no step searches it."""

    def __init__(self):
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.link_words = 0
        self.stack: list[tuple] = []  # (name, unseen, hint, container, state before)
        self.at: dict[str, list[int]] = {}
        self.block_at, self.scope_at = [-1], [-1]
        self.unseen = self.links = self.headings = 0
        self.hint = self.container = 0

    def flush(self) -> None:
        if self.parts:
            words = "".join(self.parts).split()
            if words:
                self.blocks.append(Block(" ".join(words), len(words), min(len(words), self.link_words), self.container, self.hint, bool(self.headings)))
            self.parts, self.link_words = [], 0

    def add(self, text: str, decode: bool = True) -> None:
        if not self.unseen:
            if decode and "&" in text:
                text = unescape(text)
            self.parts.append(text)
            if self.links:
                self.link_words += len(text.split())

    def open(self, name: str, attrs: str) -> None:
        if self.at.get("head") and name not in IN_HEAD and name != "head":
            self.close(self.at["head"][-1])
        if name in BLOCK:
            self.flush()
            if name not in ("br", "hr"):
                self._imply("p")
            for other in IMPLIED.get(name, ()):
                self._imply(other)
        if name in VOID:
            return
        unseen, hint, container = _place(name, attrs)
        before = self.hint, self.container
        if unseen or hint or container or name in ("form", "header"):
            self.flush()
        if name == "form":
            hint = 3  # an article inside a form that spans the page is not the form's text
        elif name == "header":
            hint = max(hint, 2 if not self.container else 0) if hint != 1 else 2 * (not self.container)
        if container == 2 and self.hint == 3:
            self.hint = 0
        self.hint, self.container = max(self.hint, hint), max(self.container, container)
        self.unseen += unseen
        self.links += name == "a"
        self.headings += name in HEADING
        n = len(self.stack)
        self.stack.append((name, unseen, bool(hint or container or unseen), *before))
        self.at.setdefault(name, []).append(n)
        if name in BLOCK:
            self.block_at.append(n)
        if name in SCOPE:
            self.scope_at.append(n)

    def _imply(self, name: str) -> None:
        places = self.at.get(name)
        if places and places[-1] > self.scope_at[-1] or places and name in SCOPE and places[-1] == self.scope_at[-1]:
            self.close(places[-1])

    def end(self, name: str) -> None:
        places = self.at.get(name)
        if not places:
            if name == "p" or name == "br":
                self.flush()
        elif name in BLOCK or places[-1] > self.block_at[-1]:  # a stray end tag of an inline element closes no block
            self.close(places[-1])

    def close(self, upto: int) -> None:
        while len(self.stack) > upto:
            name, unseen, marked, *before = self.stack[-1]
            if name in BLOCK or marked:
                self.flush()
            self.stack.pop()
            self.at[name].pop()
            if name in BLOCK:
                self.block_at.pop()
            if name in SCOPE:
                self.scope_at.pop()
            self.unseen -= unseen
            self.links -= name == "a"
            self.headings -= name in HEADING
            self.hint, self.container = before


def blocks(html: str | None) -> list[Block]:
    """The page's text blocks in order; markup, scripts, styles and unseen parts are gone.

    Tags are read as browsers read them: an unquoted value ends at white space or ``>``, whatever quotes it holds.  A
    quote that is never closed is taken for a plain character, a tag that never ends goes with the rest of the page.
    """
    html, page = html or "", _Page()
    at, end = 0, len(html)
    while at < end:
        i = html.find("<", at)
        if i < 0 or i + 1 == end:
            page.add(html[at:])
            break
        if i > at:
            page.add(html[at:i])
        mark = html[i + 1]
        if mark.isascii() and mark.isalpha() or mark == "/" and i + 2 < end and html[i + 2].isascii() and html[i + 2].isalpha():
            m = _TAG.match(html, i)
            if not m:
                break
            at, name = m.end(), m[2].lower()
            if m[1]:
                page.end(name)
            elif name in RAW:
                page.open(name, "") if name == "iframe" else None
                page.close(page.at["iframe"][-1]) if name == "iframe" else None
                stop = _RAW_END[name].search(html, at)
                if not stop:
                    break
                at = html.find(">", stop.end()) + 1 or end
            else:
                page.open(name, m[3])
                if m[3].endswith("/") and page.at.get("math") and name not in VOID or m[3].endswith("/") and name == "svg":
                    page.close(len(page.stack) - 1)
        elif mark == "!" or mark == "?" or mark == "/":
            if html.startswith("<!--", i):
                if html.startswith(">", i + 4) or html.startswith("->", i + 4):
                    at = html.index(">", i + 4) + 1
                else:
                    stop = _COMMENT_END.search(html, i + 4)
                    at = stop.end() if stop else end
            elif html.startswith("<![CDATA[", i) and page.at.get("math"):
                stop = html.find("]]>", i)
                page.add(html[i + 9 : stop if stop >= 0 else end], decode=False)
                at = stop + 3 if stop >= 0 else end
            elif mark == "/" and html.find(">", i) < 0:
                page.add(html[i:])  # no tag can follow
                break
            else:
                at = html.find(">", i) + 1 or end
        else:
            page.add("<")
            at = i + 1
    page.close(0)
    page.flush()
    return page.blocks


FEATURES = ("words", "link_density", "words_before", "density_before", "words_after", "density_after", "container", "page_container", "hint", "heading")


def features(page: list[Block]) -> np.ndarray:
    """One row of ``FEATURES`` for each block; neighbours beyond the page's ends have no words."""
    if not page:
        return np.zeros((0, len(FEATURES)))
    words, density = np.array([b.words for b in page], float), np.array([b.link_density for b in page])
    hint = np.array([min(2, b.hint) for b in page], float)
    container = np.array([b.container for b in page], float)
    best = container[hint < 2].max(initial=0)
    before = lambda x: np.concatenate([[0.0], x[:-1]])
    after = lambda x: np.concatenate([x[1:], [0.0]])
    return np.column_stack([words, density, before(words), before(density), after(words), after(density), container, np.full(len(page), best), hint, [b.heading for b in page]])


#: The small labelled table: pages as runs of blocks, each ``(how many, words, share of link words, hint, heading, article)``;
#: ranges are drawn from.  ``in`` marks runs within the page's container, if it has one.
_MENU = ((3, 9), (1, 3), (1.0, 1.0), 0, 0, 0)
_TEXT = ((1, 6), (12, 220), (0.0, 0.25), 0, 0, 1)
_SHORT = ((1, 2), (1, 11), (0.0, 0.0), 0, 0, 1)
_LINKED = ((1, 1), (1, 14), (0.5, 1.0), 0, 0, 1)
_HEAD = ((1, 1), (1, 14), (0.0, 1.0), 0, 1, 1)
_LIST = ((3, 7), (4, 30), (0.0, 0.5), 0, 0, 1)
_BOX = ((1, 4), (1, 60), (0.0, 1.0), 2, 0, 0)
_BOX_HEAD = ((1, 1), (1, 6), (0.0, 1.0), 2, 1, 0)
_VAGUE_LINKS = ((1, 5), (1, 9), (0.7, 1.0), 1, 0, 0)
_VAGUE_SHORT = ((1, 2), (1, 5), (0.0, 0.3), 1, 0, 0)
_VAGUE_TEXT = ((1, 3), (9, 120), (0.0, 0.3), 1, 0, 1)
_OUTSIDE = ((1, 3), (1, 90), (0.0, 1.0), 0, 0, 0)
_OUTSIDE_HEAD = ((1, 1), (1, 9), (0.0, 1.0), 0, 1, 0)
_MARKED = ([_OUTSIDE_HEAD, _OUTSIDE, _MENU, _BOX], [_HEAD, _TEXT, _SHORT, _TEXT, _LINKED, _TEXT, _HEAD, _SHORT, _TEXT, _BOX_HEAD, _BOX, _TEXT, _LIST, _VAGUE_TEXT, _TEXT, _VAGUE_LINKS, _VAGUE_SHORT], [_OUTSIDE, _BOX, _OUTSIDE_HEAD, _OUTSIDE])
_MENU_INSIDE = ([_MENU], [_HEAD, _TEXT, _MENU, _TEXT, _SHORT, _MENU, _TEXT], [_BOX])
_SHORT_ONLY = ([_MENU, _BOX], [_HEAD, _SHORT, _SHORT, _LINKED, _SHORT, _BOX, _SHORT], [_BOX, _OUTSIDE])
_BARE = ([_BOX, _MENU], [_HEAD, _TEXT, _SHORT, _TEXT, _LIST, _TEXT, _BOX, _VAGUE_TEXT, _TEXT, _VAGUE_LINKS], [_MENU, _BOX])
_REFERENCES = ([_MENU], [_HEAD, _TEXT, _HEAD, ((3, 8), (5, 25), (0.8, 1.0), 0, 0, 1), _SHORT], [_BOX, _OUTSIDE])
_BARE_TEXT = ([], [_TEXT, _SHORT, _TEXT, _SHORT], [])
_BARE_LINES = ([], [((1, 3), (3, 11), (0.0, 0.0), 0, 0, 1)], [])
#: (layout, the container of its middle part, how often it is drawn)
_LAYOUTS = ((_MARKED, 2, 60), (_MARKED, 1, 40), (_SHORT_ONLY, 2, 30), (_SHORT_ONLY, 1, 20), (_MENU_INSIDE, 2, 20), (_MENU_INSIDE, 1, 10), (_REFERENCES, 2, 30), (_REFERENCES, 1, 15), (_BARE, 0, 60), (_BARE_TEXT, 0, 20), (_BARE_LINES, 0, 20))


def labelled_table(seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of the pages that ``_LAYOUTS`` describes.

    A menu within a container is told by its run: short links next to short links are no article text, while a single
    link between paragraphs, or a list of longer ones, is.
    """
    rng, rows, labels = np.random.default_rng(seed), [], []
    for (head, middle, tail), container, times in _LAYOUTS:
        for _ in range(times):
            page, own = [], []
            alone = rng.random(2) < 0.3  # nothing before or after the text
            for inside, part in ((0, [] if alone[0] else head), (container, middle), (0, [] if alone[1] else tail)):
                for count, words, links, hint, heading, label in part:
                    if hint < 2 and label != 1 and rng.random() < 0.3:
                        continue
                    n = int(rng.integers(count[0], count[1] + 1))
                    for _ in range(n):
                        w = int(np.exp(rng.uniform(np.log(words[0]), np.log(words[1] + 0.99))))
                        page.append(Block("", w, round(w * rng.uniform(*links)) if links[0] < 1 else w, inside, hint, bool(heading)))
                        own.append(label)
            rows.append(features(page))
            labels += own
    return np.concatenate(rows), np.array(labels)


class Tree:
    """A binary decision tree grown by Gini impurity."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, depth: int = 12, least: int = 4):
        self.feature = None
        self.label = bool(labels.mean() >= 0.5) if len(labels) else False
        if depth and 0 < labels.sum() < len(labels):
            best = min((x for f in range(rows.shape[1]) if (x := self._cut(rows[:, f], labels, f, least))), default=None)
            if best:
                _, self.feature, self.at = best
                low = rows[:, self.feature] <= self.at
                self.low, self.high = Tree(rows[low], labels[low], depth - 1, least), Tree(rows[~low], labels[~low], depth - 1, least)
                if self.low.feature is None and self.high.feature is None and self.low.label == self.high.label:
                    self.feature = None

    @staticmethod
    def _cut(values: np.ndarray, labels: np.ndarray, f: int, least: int) -> tuple[float, int, float] | None:
        order = np.argsort(values, kind="stable")
        v, y = values[order], labels[order]
        at = np.flatnonzero(v[1:] > v[:-1]) + 1
        at = at[(at >= least) & (at <= len(v) - least)]
        if not len(at):
            return None
        ones, n = np.cumsum(y)[at - 1], len(y)
        left, right = ones / at, (y.sum() - ones) / (n - at)
        impurity = at * left * (1 - left) + (n - at) * right * (1 - right)
        k = int(impurity.argmin())
        return float(impurity[k]), f, float((v[at[k]] + v[at[k] - 1]) / 2)

    def predict(self, rows: np.ndarray) -> np.ndarray:
        if self.feature is None:
            return np.full(len(rows), self.label)
        low = rows[:, self.feature] <= self.at
        out = np.zeros(len(rows), bool)
        out[low], out[~low] = self.low.predict(rows[low]), self.high.predict(rows[~low])
        return out

    def show(self, indent: str = "") -> str:
        """The tree as indented text."""
        if self.feature is None:
            return f"{indent}{'article' if self.label else 'other'}\n"
        return f"{indent}{FEATURES[self.feature]} <= {self.at:.3g}\n{self.low.show(indent + '  ')}{indent}else\n{self.high.show(indent + '  ')}"


@cache
def trained_tree() -> Tree:
    return Tree(*labelled_table())


def main_text(html: str | None) -> str:
    """The article's blocks, joined by one blank; empty if the page has none."""
    page = blocks(html)
    keep = trained_tree().predict(features(page))
    return " ".join(b.text for b, k in zip(page, keep.tolist(), strict=True) if k)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """The input's columns but ``html_col``, and ``text`` and ``n_chars`` (its code points); nothing is shuffled.

    Null and empty pages give the empty text; very long and very deeply nested ones take time in proportion to their
    length; rows are independent of each other, repeated ones included; input columns named like the results are
    replaced; an empty table gives an empty result.
    """
    kept = [f for f in pages.schema.fields if f.name not in (html_col, "text", "n_chars")]
    rows = pages.select(*[F.col(f"`{f.name}`") for f in kept], F.col(html_col).cast("string").alias("_html"))

    def run(batches):
        for batch in batches:
            for k in range(0, max(1, batch.num_rows), 256):
                part = batch.slice(k, 256)
                texts = [main_text(x.as_py()) for x in part.column(len(kept))]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*[f.name for f in kept], "text", "n_chars"])

    return rows.mapInArrow(run, T.StructType([*kept, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))
