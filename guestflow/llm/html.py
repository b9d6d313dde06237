"""Main-text extraction: flat text blocks judged by a small decision tree."""
from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from guestflow.llm.common import text_slices

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(script|style|noscript|template|svg|iframe|object|canvas|head|textarea|select|button)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:/>|>.*?(?:</\1\s*>|\Z)|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S | re.I)
#: Elements that end a block of text, and those that hold other blocks.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure "
                   "footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td "
                   "tfoot th thead tr ul".split())
HOLDERS = frozenset("article aside blockquote body details dialog div dl fieldset figure footer form header main menu nav ol section "
                    "table ul li".split())
SIDE = frozenset("nav footer aside form menu dialog fieldset header".split())
_HINT = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner\w*|sponsor\w*|promo\w*|cookies?|consent|notices?|alerts?|popup|modal|newsletter|"
                   r"subscribe|side(?:bar)?|widgets?|menus?|nav\w*|breadcrumbs?|pag(?:er|ination)|footer|header|masthead|toolbar|shar(?:e|ing)|"
                   r"social|related|recommend\w*|tags?|comments?|disqus|repl(?:y|ies)|respond|login|search|skip)(?:$|[\s_-])", re.I)
_MAIN = re.compile(r"(?:^|[\s_-])(?:article(?:body)?|main|content|post|entry|story)(?:$|[\s_-])", re.I)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
FEATURES = ("words", "link_density", "words_before", "density_before", "words_after", "density_after", "in_main", "page_has_main", "in_side")
#: Share of the page's words from which a wrapper's side hint is not believed, and share
#: of its plain words (not linked, in no side part) that marked parts must hold to be the article.
MOST, MARKED = 0.5, 1 / 3
#: Words of a block count up to this many: beyond it a block is simply long.
LONG = 60
#: The labelled blocks the tree is trained on: FEATURES, then 1 for main text.
LABELLED = (
    # menus, headers and link lists
    (1, 1.0, 0, 0.0, 1, 1.0, 0, 1, 1, 0), (1, 1.0, 1, 1.0, 1, 1.0, 0, 1, 1, 0), (2, 1.0, 1, 1.0, 9, 0.0, 0, 1, 1, 0),
    (1, 1.0, 1, 1.0, 40, 0.0, 0, 0, 1, 0), (3, 1.0, 2, 1.0, 2, 1.0, 0, 0, 0, 0), (6, 0.9, 3, 1.0, 5, 0.8, 0, 0, 0, 0),
    (4, 0.0, 0, 0.0, 1, 1.0, 0, 0, 1, 0), (2, 0.5, 60, 0.0, 4, 1.0, 0, 0, 0, 0), (12, 0.7, 80, 0.0, 10, 0.8, 0, 0, 0, 0),
    # adverts, notices, sidebars, forms and footers, whatever their length
    (8, 0.0, 1, 1.0, 10, 0.0, 0, 1, 1, 0), (6, 0.0, 1, 1.0, 300, 0.0, 0, 1, 1, 0), (14, 0.0, 1, 1.0, 60, 0.0, 0, 1, 1, 0),
    (30, 0.0, 50, 0.0, 80, 0.0, 0, 0, 1, 0), (45, 0.1, 20, 0.0, 3, 1.0, 0, 0, 1, 0), (9, 0.0, 120, 0.0, 0, 0.0, 0, 1, 1, 0),
    (12, 0.2, 90, 0.0, 0, 0.0, 0, 0, 1, 0), (5, 0.0, 8, 0.0, 30, 0.0, 0, 0, 1, 0), (25, 0.0, 100, 0.0, 0, 0.0, 0, 1, 0, 0),
    (3, 0.0, 1, 1.0, 100, 0.0, 0, 1, 0, 0), (70, 0.0, 15, 0.0, 20, 0.0, 0, 1, 0, 0), (18, 0.4, 2, 1.0, 2, 1.0, 0, 1, 0, 0),
    (60, 0.0, 60, 0.0, 5, 0.0, 0, 1, 0, 0), (40, 0.0, 10, 0.0, 0, 0.0, 0, 1, 0, 0), (15, 0.0, 60, 0.0, 14, 0.0, 0, 1, 0, 0),
    (30, 0.0, 30, 0.0, 60, 0.0, 0, 1, 0, 0), (14, 0.0, 40, 0.0, 40, 0.0, 0, 1, 0, 0), (60, 0.1, 3, 1.0, 60, 0.0, 0, 1, 0, 0),
    # reader comments and adverts set inside the article
    (20, 0.0, 60, 0.0, 25, 0.0, 1, 1, 1, 0), (80, 0.0, 20, 0.0, 30, 0.0, 1, 1, 1, 0), (2, 1.0, 40, 0.0, 50, 0.0, 1, 1, 1, 0),
    (7, 0.0, 200, 0.0, 150, 0.0, 1, 1, 1, 0), (1, 0.0, 30, 0.0, 2, 0.0, 1, 1, 1, 0),
    # short lines of a page without a marked article, far from text
    (2, 0.0, 1, 1.0, 2, 1.0, 0, 0, 0, 0), (3, 0.0, 0, 0.0, 3, 0.5, 0, 0, 0, 0), (4, 0.0, 3, 0.0, 2, 0.0, 0, 0, 0, 0),
    # article text: headings, long and very short paragraphs, quotes with links
    (10, 0.0, 8, 0.0, 40, 0.0, 1, 1, 0, 1), (1, 0.0, 10, 0.0, 30, 0.0, 1, 1, 0, 1), (120, 0.0, 60, 0.0, 80, 0.0, 1, 1, 0, 1),
    (60, 0.05, 90, 0.0, 10, 0.0, 1, 1, 0, 1), (1, 0.0, 70, 0.0, 12, 0.0, 1, 1, 0, 1), (2, 0.0, 1, 0.0, 9, 0.0, 1, 1, 0, 1),
    (35, 0.3, 40, 0.0, 50, 0.0, 1, 1, 0, 1), (300, 0.0, 9, 0.0, 12, 0.0, 1, 1, 0, 1), (4, 0.0, 2, 1.0, 5, 0.0, 1, 1, 0, 1),
    (3, 1.0, 50, 0.0, 40, 0.0, 1, 1, 0, 1), (15, 0.6, 30, 0.0, 60, 0.0, 1, 1, 0, 1), (6, 0.0, 1, 1.0, 1, 0.0, 1, 1, 0, 1),
    (60, 0.0, 60, 0.0, 60, 0.0, 1, 1, 0, 1), (60, 0.0, 13, 0.0, 60, 0.0, 1, 1, 0, 1), (13, 0.0, 60, 0.0, 60, 0.0, 1, 1, 0, 1),
    (9, 0.0, 60, 0.0, 12, 0.2, 1, 1, 0, 1), (60, 0.0, 60, 0.0, 1, 1.0, 1, 1, 0, 1), (14, 0.0, 5, 0.0, 2, 1.0, 1, 1, 0, 1),
    (1, 0.0, 1, 0.0, 1, 0.0, 1, 1, 0, 1), (5, 0.0, 60, 0.0, 0, 0.0, 1, 1, 0, 1), (60, 0.1, 2, 1.0, 60, 0.0, 1, 1, 0, 1),
    (15, 0.0, 60, 0.3, 3, 0.0, 1, 1, 0, 1), (2, 0.0, 60, 0.0, 60, 1.0, 1, 1, 0, 1), (4, 1.0, 4, 1.0, 4, 1.0, 1, 1, 0, 1),
    # pages without a marked article: what is linked, and what stands among links, is no text; the same words among text are
    (20, 0.9, 30, 0.0, 40, 0.0, 0, 0, 0, 0), (20, 0.1, 30, 0.0, 40, 0.0, 0, 0, 0, 1), (40, 0.8, 40, 0.0, 40, 0.0, 0, 0, 0, 0),
    (12, 0.0, 12, 0.9, 14, 0.9, 0, 0, 0, 0), (12, 0.0, 12, 0.0, 14, 0.0, 0, 0, 0, 1), (12, 0.0, 12, 0.9, 14, 0.0, 0, 0, 0, 1),
    (12, 0.0, 12, 0.0, 14, 0.9, 0, 0, 0, 1), (7, 0.0, 30, 0.9, 30, 0.9, 0, 0, 0, 0), (7, 0.0, 30, 0.0, 30, 0.0, 0, 0, 0, 1),
    (7, 0.0, 3, 1.0, 35, 0.0, 0, 0, 0, 1), (5, 0.5, 20, 0.8, 25, 0.7, 0, 0, 0, 0), (8, 0.0, 20, 0.0, 20, 0.8, 0, 0, 0, 1),
    (3, 0.0, 0, 0.0, 15, 0.0, 0, 0, 0, 1), (3, 0.0, 1, 1.0, 16, 0.0, 0, 0, 0, 1), (5, 0.0, 0, 0.0, 40, 0.0, 0, 0, 0, 1),
    (2, 0.0, 6, 0.9, 25, 0.0, 0, 0, 0, 1), (8, 0.0, 2, 1.0, 30, 0.0, 0, 0, 0, 1), (3, 0.0, 4, 1.0, 4, 1.0, 0, 0, 0, 0),
    (60, 0.0, 20, 1.0, 20, 1.0, 0, 0, 0, 1), (35, 0.6, 10, 0.8, 10, 0.8, 0, 0, 0, 0), (35, 0.3, 10, 0.0, 10, 0.0, 0, 0, 0, 1),
    # text of a page without a marked article
    (50, 0.0, 12, 0.0, 60, 0.0, 0, 0, 0, 1), (25, 0.1, 40, 0.0, 30, 0.0, 0, 0, 0, 1), (90, 0.2, 3, 1.0, 20, 0.0, 0, 0, 0, 1),
    (16, 0.0, 1, 1.0, 45, 0.0, 0, 0, 0, 1), (6, 0.0, 45, 0.0, 60, 0.0, 0, 0, 0, 1), (3, 0.0, 30, 0.0, 80, 0.0, 0, 0, 0, 1),
    (14, 0.0, 60, 0.0, 3, 1.0, 0, 0, 0, 1), (30, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 1), (22, 0.25, 35, 0.1, 18, 0.0, 0, 0, 0, 1),
)


class DecisionTree:
    """Binary splits by Gini impurity, grown until the leaves are pure."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.split = None
        self.value = int(y.sum() * 2 > len(y))
        if y.min() == y.max():
            return
        best = None
        for f in range(x.shape[1]):
            v = np.unique(x[:, f])
            for cut in (v[:-1] + v[1:]) / 2:
                low = x[:, f] <= cut
                cost = sum(m.sum() * 2 * y[m].mean() * (1 - y[m].mean()) for m in (low, ~low))
                if best is None or cost < best[0] - 1e-12:
                    best = (cost, f, cut, low)
        if best is not None:
            _, f, cut, low = best
            self.split = (f, cut, DecisionTree(x[low], y[low]), DecisionTree(x[~low], y[~low]))

    def predict(self, row) -> int:
        node = self
        while node.split:
            f, cut, left, right = node.split
            node = left if row[f] <= cut else right
        return node.value


def trained_tree(table=LABELLED) -> DecisionTree:
    t = np.array(table, float)
    t[:, 0:6:2] = np.minimum(t[:, 0:6:2], LONG)
    return DecisionTree(t[:, :-1], t[:, -1])


class Part:
    """An open element that holds blocks: its name, what its mark and hint say, the words in it."""

    def __init__(self, name: str, main: bool, side: bool, hinted: bool):
        self.name, self.main, self.side, self.hinted, self.words = name, main, side, hinted, 0


def part(name: str, rest: str, inside: bool) -> Part:
    attrs = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(rest)}
    hidden = "hidden" in rest.lower().split() or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "")
    main = name in ("article", "main") or attrs.get("role") == "main" or bool(_MAIN.search(attrs.get("itemprop", "")))
    hint = name not in ("body", "html") and not main and bool(_HINT.search(" ".join(attrs.get(k, "") for k in ("class", "id", "role"))))
    return Part(name, main, hidden or (name in SIDE and not (name == "header" and inside)), hint)


def blocks(html: str) -> list[tuple[str, int, int, bool, bool]]:
    """Flat blocks in page order: text, words, linked words, inside the article's part, inside a side part.

    A side hint (class, id, role) of a wrapper that holds MOST of the page's words says
    nothing about them. Marked parts (article, main) are the article's if they hold at
    least MARKED of the page's plain words; else they are something small beside it, a
    teaser or a reader's comment, and count as side parts."""
    found: list[tuple[str, int, int, tuple[Part, ...]]] = []
    stack: list[Part] = []
    parts: list[str] = []
    linked: list[str] = []
    in_link = 0

    def flush():
        text = " ".join(unescape("".join(parts)).split())
        if text:
            words = len(text.split(" "))
            for p in stack:
                p.words += words
            found.append((text, words, min(words, len(unescape(" ".join(linked)).split())), tuple(stack)))
        parts.clear()
        linked.clear()

    def put(text: str):
        if text:
            parts.append(text)
            if in_link:
                linked.append(text)

    at = 0
    for m in _TOKEN.finditer(html):
        put(html[at:m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            if m[0][:9].upper() == "<![CDATA[":
                put(m[0][9:-3].replace("&", "&amp;"))
            continue
        if name == "a":
            in_link = 0 if m[2] else 1
        elif name == "br":
            put(" ")
        elif name in BLOCKS:
            flush()
            in_link = 0
            if name in HOLDERS:
                if m[2]:
                    k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k].name == name), None)
                    if k is not None:
                        del stack[k:]
                else:
                    stack.append(part(name, m[4], any(p.main for p in stack)))
    put(html[at:])
    flush()
    total = sum(words for _, words, _, _ in found)
    side = [any(p.side or (p.hinted and p.words < MOST * total) for p in within) for _, _, _, within in found]
    main = [any(p.main for p in within) for _, _, _, within in found]
    plain = [0 if out else words - links for (_, words, links, _), out in zip(found, side)]
    trusted = sum(n for n, m in zip(plain, main) if m) >= MARKED * sum(plain)
    return [(text, words, links, m and trusted, out or (m and not trusted)) for (text, words, links, _), m, out in zip(found, main, side)]


def main_text(html: str | None, tree: DecisionTree) -> str:
    found = blocks(html or "")
    has_main = any(b[3] for b in found)
    shape = [(0, 0.0), *((min(w, LONG), k / w) for _, w, k, _, _ in found), (0, 0.0)]
    return "\n\n".join(b[0] for i, b in enumerate(found, 1)
                       if tree.predict((*shape[i], *shape[i - 1], *shape[i + 1], b[3], has_main, b[4])))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every row: the main text of its whole html.

    Text is cut into blocks at block-level tags; scripts, styles, comments and
    markup go, character references are decoded, white space inside a block
    becomes one space. A decision tree trained on LABELLED judges each block by
    its words and link density, those of its neighbours, and the part of the
    page it stands in, as far as that part's share of the words bears it out
    (``blocks``). On pages without a marked article words and links alone decide. Null, empty and text-free html gives an empty string.
    Repeated rows give a row each, an empty table none; other columns are not
    read. Broken markup (open tags, open comments) is read to its end."""
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = trained_tree()
        for b in text_slices(batches, "html"):
            texts = [main_text(h, tree) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
