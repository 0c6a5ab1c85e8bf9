"""Main text of web pages by tag-path ratios.

A page is read once, tag by tag, into text nodes, each with the path of the elements that it stands in. Nodes
are pooled by path: text per node and punctuation per node are a path's two ratios. Each is smoothed over the
page, in the order in which nodes stand, by a Gaussian; their product, again averaged by path, is a path's
score. Paths whose score reaches a part of the page's best are content, and with them what their article, or
else their nearest sectioning ancestor, holds, so that headings and short paragraphs stay with long ones.

Menus, footers, adverts and comments take part in the ratios like any text. Names only help: the score of a
path through an element whose tag, or a whole class, id or role of which, names such a thing is scaled down
by a constant, and its text doesn't stay for its section's sake. A name on an element that holds an article
says nothing, unless an article came before it: what stands under such a name then is another article's card or
a comment. Beside the article of the best path a path has to reach half of its score.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_batch

#: Elements without an end tag (fixed values of the HTML standard).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup.
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
#: Elements that are part of a line; all others begin and end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements whose text isn't shown as such.
UNSEEN = RAW | frozenset("head svg math canvas object audio video template datalist".split())
#: Elements that seldom hold content; a form may hold a whole page.
DOUBTFUL = frozenset("nav header footer aside button select option optgroup fieldset dialog menu".split())
_MARK = r"(?:ads?|advert\w*|advertisement|banner|sponsor\w*|promo\w*|menu|nav|navbar|navigation|breadcrumbs?|header|footer|masthead|sidebar|aside|widget|related|share|social|cookies?|consent|notice|popup|modal|newsletter|subscribe|comments?|commentlist|disqus|replies|reply|respond|toolbar|pagination|pager|complementary|contentinfo|search|legal|copyright|colophon|disclaimer)"
_BEFORE = r"(?:left|right|top|bottom|main|site|page|global|primary|secondary|user|reader)[_-]+"
_AFTER = r"(?:[_-]+(?:list|box|block|bar|area|section|wrapper|container|item|body|inner|unit|slot|form|links?|thread|posts?|articles?|stories|\d+))"
#: A class, id or role that marks an element as no content: of such words alone, so that has-sidebar or with-comments doesn't.
MARKS = re.compile(rf"(?<!\S)(?:{_BEFORE})*{_MARK}(?:[_-]+{_MARK}|{_AFTER})*(?!\S)", re.I)
#: Elements that marks don't concern, since they hold the page or its content; the last two hold an article.
PAGE, HOLDERS = frozenset(["html", "body"]), frozenset(["article", "main"])
#: Elements of a head; any other one, or text, ends it (fixed values of the HTML standard).
IN_HEAD = frozenset("base basefont bgsound link meta title script style noscript noframes template head html".split())
#: Elements that an opening tag of the second kind ends, if they're open (fixed values of the HTML standard).
P_ENDERS = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ENDS = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
SECTIONS = frozenset("article main section body html div td blockquote".split())

_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_UNSEEN = re.compile(r"display\s*:\s*none", re.I)
_BLANK = re.compile(r"\s+")
_PUNCTUATION = regex.compile(r"\p{P}")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for name in RAW}


def attributes(rest: str) -> tuple[str, bool]:
    """The classes, id and role of a tag, by what follows its name, and whether it's hidden."""
    marks, hidden = [], False
    for name, a, b, c in _ATTRIBUTE.findall(rest):
        name, value = name.lower(), a or b or c
        if name in ("class", "id", "role"):
            marks.append(value)
        elif name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true" or name == "style" and _UNSEEN.search(value):
            hidden = True
    return " ".join(marks), hidden


class Node:
    """A run of text within one block, with the path of its block's element.

    ``section`` and ``holder`` are the nearest sectioning element and the nearest article (0: none); ``doubts``
    are the elements on the path that a tag or a name makes doubtful. Elements are numbered in page order.
    """

    __slots__ = ("doubts", "holder", "path", "section", "text")

    def __init__(self, path: str, section: int, holder: int, doubts: tuple[int, ...], text: str) -> None:
        self.path, self.section, self.holder, self.doubts, self.text = path, section, holder, doubts, text


class Open:
    """An open element."""

    __slots__ = ("doubts", "holder", "label", "name", "section", "unseen")

    def __init__(self, name: str, label: str, unseen: bool, section: int, holder: int, doubts: tuple[int, ...]) -> None:
        self.name, self.label, self.unseen, self.section, self.holder, self.doubts = name, label, unseen, section, holder, doubts


def nodes(page: str) -> tuple[list[Node], dict[int, bool]]:
    """Blocks of a page in page order, and its doubtful elements, each with whether its tag alone makes it so.

    A block's path has the names and classes of the open elements that aren't part of a line. Missing end
    tags end with their parent; an end tag without a start is ignored. Elements that are marked by a name but
    hold the first article aren't doubtful; later articles that are marked, or in what is, are.
    """
    out: list[Node] = []
    stack = [Open("", "", False, 0, 0, ())]
    text: list[str] = []
    doubtful: dict[int, bool] = {}
    count, held = 0, False

    def flush() -> None:
        if text:
            whole = _BLANK.sub(" ", "".join(text)).strip()
            text.clear()
            if whole:
                at = stack[-1]
                out.append(Node("/".join(x.label for x in stack if x.label), at.section, at.holder, at.doubts, whole))

    def close(depth: int) -> None:
        if any(x.name not in INLINE for x in stack[depth:]):
            flush()
        del stack[depth:]

    at = 0
    while at < len(page):
        found = _TOKEN.search(page, at)
        stop = found.start() if found else len(page)
        if stop > at and stack[-1].name == "head" and not page[at:stop].isspace():
            close(len(stack) - 1)
        if stop > at and not stack[-1].unseen:
            text.append(html.unescape(page[at:stop]))
        if not found:
            break
        at, (end, start, rest) = found.end(), found.groups()
        name = (end or start or "").lower()
        if name == "br":
            if not stack[-1].unseen:
                text.append(" ")
        elif end:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].name == name:
                    close(depth)
                    break
                if name in INLINE and stack[depth].name not in INLINE:
                    break
        elif start:
            if stack[-1].name == "head" and name not in IN_HEAD:
                close(len(stack) - 1)
            block = name not in INLINE
            if block and (name in P_ENDERS or name in ENDS):
                wanted = ENDS.get(name) or frozenset(["p"])
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].name in wanted:
                        close(depth)
                        break
                    if stack[depth].name not in INLINE and (name not in ENDS or stack[depth].name in ("ul", "ol", "dl", "table", "select")):
                        break
            if block and (name == "hr" or name not in VOID):
                flush()
            if name in VOID:
                continue
            if name in RAW:
                close_tag = _RAW_END[name].search(page, at)
                at = close_tag.end() if close_tag else len(page)
                continue
            if rest.rstrip().endswith("/") and name in ("svg", "math"):
                continue
            count += 1
            above = stack[-1]
            marks, hidden = attributes(rest) if rest else ("", False)
            doubts, holder = above.doubts, above.holder
            marked = bool(marks) and name not in PAGE and MARKS.search(marks) is not None
            if name in HOLDERS and not (held and (marked or any(x in doubtful for x in doubts))):
                holder = count
                for x in doubts:
                    if not doubtful.get(x, True):
                        del doubtful[x]
                held = held or not any(x in doubtful for x in doubts)
            elif name in DOUBTFUL or name == "form" or marked:
                doubts += (count,)
                doubtful[count] = name in DOUBTFUL
            label = "" if not block else name + ("." + ".".join(marks.split()) if marks else "")
            stack.append(Open(name, label, above.unseen or name in UNSEEN or hidden, count if name in SECTIONS else above.section, holder, doubts))
    flush()
    return out, doubtful


def _smooth(x: np.ndarray, width: float) -> np.ndarray:
    reach = int(np.ceil(3 * width))
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * width * width))
    return np.convolve(np.pad(x, reach, mode="edge"), kernel / kernel.sum(), mode="valid")


def path_scores(found: list[Node], width: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """The number of each node's path, and the score of each path."""
    _, index = np.unique([n.path for n in found], return_inverse=True)
    size = np.array([len(n.text) for n in found], np.float64)
    marks = np.array([len(_PUNCTUATION.findall(n.text)) for n in found], np.float64)
    count = np.bincount(index)
    by_text, by_marks = np.bincount(index, size) / count, np.bincount(index, marks) / count
    fused = _smooth(by_text[index], width) * _smooth(by_marks[index] + 1, width)
    return index, np.bincount(index, fused) / count


def content(found: list[Node], doubtful: dict[int, bool], part: float = 0.1, doubt: float = 1e-4, beside: float = 0.5) -> list[bool]:
    """Which nodes are content: those of paths that score ``part`` of the best, or ``beside`` outside of articles if the best is in one, doubtful ones scaled by ``doubt``, and what belongs to them."""
    if not found:
        return []
    index, score = path_scores(found)
    doubts = [[x for x in n.doubts if x in doubtful] for n in found]
    scaled = score[index] * np.where([bool(x) for x in doubts], doubt, 1.0)
    best = int(scaled.argmax())
    if any(doubtful[x] for x in doubts[best]):
        return [False] * len(found)
    bar = np.array([beside if found[best].holder and not n.holder else part for n in found])
    passed = scaled >= bar * scaled[best]
    roots = {n.holder or n.section for n, p in zip(found, passed) if p}

    def belongs(n: Node, doubted: list[int]) -> bool:
        return any(root in roots and not any(x >= root for x in doubted) for root in (n.holder, n.section) if root)

    return [bool(p) or belongs(n, x) for n, p, x in zip(found, passed, doubts)]


def main_text(page: str | None) -> str:
    """The content blocks of a page in page order, joined by a space."""
    found, doubtful = nodes(page or "")
    return " ".join(n.text for n, kept in zip(found, content(found, doubtful)) if kept)


TEXTS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``page_id, url, html``.

    A null or empty page, or one without content, has an empty text. Repeated rows give repeated results;
    nothing is shuffled. Other columns are ignored.
    """

    def run(batch: pa.RecordBatch) -> dict:
        texts = [main_text(p).encode("utf-8", "replace").decode() for p in batch["html"].to_pylist()]
        return {"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]}

    d = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return d.mapInArrow(per_batch(run, TEXTS), "page_id long, url string, text string, n_chars long")
