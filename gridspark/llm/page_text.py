"""Main text of web pages: flat text blocks, told apart by a decision tree.

A page is cut at block elements into flat blocks. Each block is described by the number of its words and the share of
them inside links, the same of the block before and the block after, and by the elements it stands in. A decision tree
grown on a small labelled table (``labelled_pages``) says which blocks belong to the article.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridspark.llm.labelled_pages import PAGES

# Names of elements.
_BLOCK = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html iframe label legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_UNREAD = ("script", "style", "noscript", "template", "svg", "textarea", "iframe", "canvas", "annotation", "annotation-xml")
_RAW = ("script", "style", "textarea", "iframe")
"""Of these, the ones whose text goes on to the end of the page if they are not closed."""
_FURNITURE = set("nav footer header aside form button label legend select option menu dialog head title".split())
_ARTICLE = set("article main".split())
# Parts of class, id and role names that speak for or against article text.
_AGAINST = re.compile(
    r"(?:^|[^a-z])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|consent|cookies?|disqus\w*|dialog|footer|form|header|legal|login|masthead|menu|modal|"
    r"nav\w*|newsletter|notices?|popup|promo\w*|related|reply|search|share|sharing|side(?:bar)?|signup|social|sponsor\w*|subscribe|toolbar|topbar|widget)(?:$|[^a-z])"
)
_FOR = re.compile(r"(?:^|[^a-z])(?:article|content|entry|main|post|story|text)(?:$|[^a-z])")
_NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_TAG_END = re.compile(r"""[>"']""")
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"\S+")

_PLAIN, _OUT, _IN, _UNSEEN = 0, 1, 2, 3


@dataclass
class Block:
    """A flat block: its text, words, words in links, whether it stands in page furniture or in an article, and whether it is a heading."""

    text: str
    words: int
    linked: int
    furniture: bool
    article: bool
    heading: bool
    raw_at: int = 0


@dataclass
class _Element:
    """An element with what it says of the text in it, and what it takes over from those around it."""

    tag: str
    kind: int
    around: "_Element | None"
    by_name: bool
    words: int = 0
    holds: bool = False
    out: bool = False

    def __post_init__(self) -> None:
        up = self.around
        self.unseen = self.kind == _UNSEEN or (up is not None and up.unseen)
        self.article = self.kind == _IN or (up is not None and up.article)
        self.heading = re.fullmatch("h[1-6]", self.tag) is not None or (up is not None and up.heading)


@dataclass
class _State:
    parts: list[tuple[str, bool]] = field(default_factory=list)
    open: list[_Element] = field(default_factory=list)
    count: Counter = field(default_factory=Counter)
    links: int = 0

    def end(self, at: int) -> None:
        """Close the open elements from a place on."""
        for e in self.open[at:]:
            self.count[e.tag] -= 1
            self.links -= e.tag == "a"
        del self.open[at:]


def _kind(tag: str, attributes: str) -> int:
    """What an element says of the text in it."""
    kind = _OUT if tag in _FURNITURE else _IN if tag in _ARTICLE else _PLAIN
    for m in _ATTRIBUTE.finditer(attributes) if attributes.strip(" /") else ():
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            return _UNSEEN
        if name in ("class", "id", "role") and kind == _PLAIN:
            kind = _OUT if _AGAINST.search(value) else _IN if _FOR.search(value) else _PLAIN
    return kind


def _tokens(page: str) -> Iterator[tuple[str, str | None, bool, str, int]]:
    """``(text, tag, closing, attributes, place)``: the text before each tag and the tag; last the text after all tags, without a tag.

    Comments, declarations and the contents of unread elements are skipped. What is not closed (a tag, a quote, a
    comment) is searched for once only, so the time is linear in the page.
    """
    at, done, size = 0, 0, len(page)
    gone: dict[str, int] = {}

    def find(what: str, start: int) -> int:
        if start >= gone.get(what, size + 1):
            return -1
        found = page.find(what, start)
        if found < 0:
            gone[what] = min(start, gone.get(what, start))
        return found

    def tag_end(start: int) -> int:
        while m := _TAG_END.search(page, start):
            if m[0] == ">":
                return m.end()
            # a quote that is never closed is a character like others
            close = find(m[0], m.end())
            start = close + 1 if close >= 0 else m.end()
        return -1

    while (lt := page.find("<", at)) >= 0:
        text, skip = page[done:lt], None
        if page.startswith(("<!--", "<![CDATA["), lt):
            close = "-->" if page[lt + 2] == "-" else "]]>"
            end = find(close, lt + 4)
            at = done = end + len(close) if end >= 0 else size
            yield text, None, False, "", lt
            continue
        if page.startswith(("<!", "<?"), lt):
            end = find(">", lt)
            if end >= 0:
                at = done = end + 1
                yield text, None, False, "", lt
            else:
                at = lt + 1
            continue
        m = _NAME.match(page, lt + 1)
        end = -1
        if m and lt < gone.get("tag", size + 1):
            end = tag_end(m.end())
            if end < 0:
                gone["tag"] = lt  # no tag ends after this place
        if end < 0:
            at = lt + 1
            continue
        tag, closing, attributes = m[2].lower(), bool(m[1]), page[m.end() : end - 1]
        at = done = end
        if tag in _UNREAD and not closing:
            if not attributes.rstrip().endswith("/"):
                skip = tag
            tag = None
        yield text, tag, closing, attributes, lt
        if skip and at < gone.get(f"</{skip}", size + 1):
            m = re.compile(f"</{skip}", re.I).search(page, at)
            if m:
                end = find(">", m.end())
                at = done = end + 1 if end >= 0 else size
            else:
                gone[f"</{skip}"] = at
        if skip and at >= gone.get(f"</{skip}", size + 1) and skip in _RAW:
            at = done = size
    yield page[done:], None, False, "", size


def blocks(page: str | None) -> list[Block]:
    """Flat blocks of a page in its order; null and empty pages have none.

    Character references are decoded and white space inside a block becomes one space. Scripts, styles, comments and
    unseen elements are skipped. Unclosed and stray tags are borne: a closing tag closes up to its opening one, if any.
    """
    found: list[Block] = []
    if not page:
        return found
    state = _State()
    made: list[_Element] = []
    stands: list[_Element | None] = []

    def close(at: int) -> None:
        text = html.unescape("".join(t for t, _ in state.parts))
        words = len(_WORD.findall(text))
        if words:
            linked = sum(len(_WORD.findall(html.unescape(t))) for t, a in state.parts if a)
            inner = state.open[-1] if state.open else None
            if inner is None or not inner.unseen:
                found.append(Block(" ".join(text.split()), words, min(linked, words), False, inner is not None and inner.article, inner is not None and inner.heading, at))
                stands.append(inner)
        state.parts.clear()

    for text, tag, closing, attributes, at in _tokens(page):
        if text:
            state.parts.append((text, state.links > 0))
        if tag is None:
            continue
        if tag in _BLOCK:
            close(at)
        elif tag == "br":
            state.parts.append((" ", False))
        if tag in _VOID:
            continue
        if not closing:
            if tag == "p" or tag in ("li", "tr", "td", "th", "dt", "dd", "option"):
                _end_implied(state, tag)
            own = _Element(tag, _kind(tag, attributes), state.open[-1] if state.open else None, tag == "form" or tag not in _FURNITURE)
            # a comment that is an article of its own does not make its list the article
            own.holds = tag in _ARTICLE and not _AGAINST.search(attributes.lower())
            made.append(own)
            state.open.append(own)
            state.count[tag] += 1
            state.links += tag == "a"
        elif state.count[tag]:
            i = next(i for i in range(len(state.open) - 1, -1, -1) if state.open[i].tag == tag)
            state.end(i)
    close(len(page))
    _find_furniture(found, stands, made)
    return found


def _find_furniture(found: list[Block], stands: list[_Element | None], made: list[_Element]) -> None:
    """Mark the blocks that stand in furniture of the page.

    A name makes no furniture of ``html``, ``body`` and of an element that holds the article. On pages without an
    article outside furniture the same goes for an element with most of the words.
    """
    for b, e in zip(found, stands):
        if e is not None:
            e.words += b.words
    for e in reversed(made):
        if e.around is not None:
            e.around.words += e.words
    # of several, the largest article and the largest main count: teasers of other articles spare no list of them
    largest = {tag: max((e for e in made if e.holds and e.tag == tag), key=lambda e: e.words, default=None) for tag in _ARTICLE}
    for e in made:
        e.holds = e is largest.get(e.tag)
    for e in reversed(made):
        if e.around is not None:
            e.around.holds |= e.holds
    total = sum(b.words for b in found)
    for most in (False, True):
        for e in made:
            spared = e.by_name and (e.tag in ("html", "body") or e.holds or (most and 2 * e.words > total))
            e.out = (e.kind == _OUT and not spared) or (e.around is not None and e.around.out)
        for b, e in zip(found, stands):
            b.furniture = e is not None and e.out
        if any(b.article and not b.furniture for b in found):
            break


def _end_implied(state: _State, tag: str) -> None:
    """A new paragraph, item or cell ends an open one of its kind, unless another block was opened in between."""
    for i in range(len(state.open) - 1, -1, -1):
        name = state.open[i].tag
        if name == tag:
            state.end(i)
            return
        if name in _BLOCK:
            return


FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "heading", "furniture", "article", "article_page", "named_page")
_NAMED = [FEATURES.index(x) for x in ("furniture", "article", "article_page", "named_page")]


def features(found: list[Block]) -> np.ndarray:
    """One row for each block, columns FEATURES; beyond the ends of the page stand empty blocks."""
    own = np.array([(b.words, b.linked / b.words) for b in found], float).reshape(-1, 2)
    edge = np.zeros((1, 2))
    whole = any(b.article and not b.furniture for b in found), any(b.article or b.furniture for b in found)
    flags = np.array([(b.heading, b.furniture, b.article, *whole) for b in found], float).reshape(-1, 5)
    return np.hstack((own, np.vstack((edge, own[:-1])), np.vstack((own[1:], edge)), flags)) if found else np.zeros((0, len(FEATURES)))


@dataclass
class Node:
    """A leaf (``feature`` -1) with its answer, or a split: left where the feature is at most the threshold."""

    feature: int
    threshold: float
    answer: bool
    left: "Node | None" = None
    right: "Node | None" = None


def grow(x: np.ndarray, y: np.ndarray, depth: int = 7, least: int = 2) -> Node:
    """A binary tree by Gini impurity; ties of splits go to the earlier feature and lower threshold."""
    answer = bool(y.mean() > 0.5) if len(y) else False
    if depth == 0 or len(y) < 2 * least or y.min() == y.max():
        return Node(-1, 0.0, answer)
    best = None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        for i in np.flatnonzero(v[1:] > v[:-1]) + 1:
            if least <= i <= len(y) - least:
                p, q = ones[i - 1] / i, (ones[-1] - ones[i - 1]) / (len(y) - i)
                score = i * p * (1 - p) + (len(y) - i) * q * (1 - q)
                if best is None or score < best[0] - 1e-9:
                    best = score, f, (v[i] + v[i - 1]) / 2
    if best is None or best[0] >= len(y) * y.mean() * (1 - y.mean()) - 1e-9:
        return Node(-1, 0.0, answer)
    _, f, t = best
    low = x[:, f] <= t
    return Node(f, t, answer, grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least))


def classify(node: Node, x: np.ndarray) -> np.ndarray:
    """Answers for rows of features."""
    if node.feature < 0:
        return np.full(len(x), node.answer)
    low = x[:, node.feature] <= node.threshold
    out = np.empty(len(x), bool)
    out[low], out[~low] = classify(node.left, x[low]), classify(node.right, x[~low])
    return out


def labelled() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of the labelled pages. A block has the label of the entry it begins in.

    Each page counts three times: as it is, without what element and class names say for an article, and without any of
    their names, so that on pages that name nothing words, links and neighbours decide. There, prose outside the article
    (a comment, a notice) is left out: only names tell it from article text, so it would teach the wrong thing.
    """
    xs, ys = [], []
    for page in PAGES:
        text, marks = "", []
        for label, part in page:
            marks.append((len(text), label))
            text += part
        found = blocks(text)
        # a block ends where the next block element starts; its words lie before that
        labels = []
        for b in found:
            labels.append(next((label for start, label in reversed(marks) if label and start < b.raw_at), "-") == "+")
        x = features(found)
        for lost in ((), _NAMED[1:3], _NAMED):
            part = x.copy()
            part[:, list(lost)] = 0
            told = np.array([lost != _NAMED or mark or b.words < 8 or 5 * b.linked > b.words for b, mark in zip(found, labels)])
            xs.append(part[told])
            ys.append(np.array(labels)[told])
    return np.vstack(xs), np.concatenate(ys).astype(float)


def tree() -> Node:
    """The classifier, grown anew from the labelled table."""
    return grow(*labelled())


def main_text(page: str | None, node: Node) -> str:
    """Text of the article's blocks, joined by two line feeds; empty if there is none."""
    found = blocks(page)
    keep = classify(node, features(found))
    return "\n\n".join(b.text for b, k in zip(found, keep) if k)


def extract(pages: DataFrame, node: Node | None = None) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of each row of ``pages(page_id, url, html)``; null pages give empty text."""
    node = node or tree()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                texts = [main_text(x.as_py(), node) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(apply, "page_id long, url string, text string, n_chars long")


def op7_page_text(spark, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
