"""Article text of a page by the density of its blocks.

One pass over the tags builds blocks (elements that begin a line of their own) in the order in which they open, so the blocks
within a block are a run of numbers. Each block counts the characters of its own text and those within links. A block with
LEAST characters or more has a point, one for each comma and one for each hundred characters up to three; its points go to its
parent, and half of them to its parent's parent. The article is the block with most points, after the share of its characters
that are in links is taken off; of equal ones the first. Its text is that of its blocks in order, without blocks that are mostly
links. Navigation, headers, footers, asides and forms have no points and no text, heads, scripts and the like are skipped.

Tags may be unclosed: a start tag that can't stand within an open paragraph, item, cell, row or option closes it, an end tag
closes what is open within its element, and one that nothing is open for is left out. A link ends with its end tag, the next
link or the block in which it began. Blocks are nested DEPTH deep at most: a start tag there ends the innermost block first. So
the scan is linear in the page.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

LEAST, MOST_LINKS, DEPTH = 25, 0.5, 512
BLOCKS = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
ASIDE = frozenset("aside footer form header nav".split())
SKIPPED = frozenset("head iframe noscript script select style svg template textarea title".split())
#: What a start tag closes, up to the blocks that hold it in.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "tbody": ("td", "th", "tr", "tbody", "thead"), "tfoot": ("td", "th", "tr", "tbody", "thead")}
_HOLDS = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",)} | dict.fromkeys(("td", "th", "tr", "tbody", "tfoot"), ("table",))
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")


def tokens(page: str) -> Iterator[tuple[str, str]]:
    """("text", characters), ("open", tag) and ("close", tag) of a page, without comments and skipped elements. A tag that isn't ended ends the page."""
    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            yield "text", page[at:lt]
        if lt == n:
            return
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        close = page.startswith("</", lt)
        name = _NAME.match(page, lt + 1 + close)
        if not name and not close and page[lt + 1 : lt + 2] not in ("!", "?"):
            yield "text", "<"
            at = lt + 1
            continue
        end = page.find(">", lt)
        if end < 0:
            return
        at = end + 1
        if not name:
            continue
        tag = name[0].lower()
        if tag in SKIPPED and not close:
            if page[end - 1] != "/":
                over = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
                stop = page.find(">", over.start()) if over else -1
                at = n if stop < 0 else stop + 1
            continue
        yield ("close" if close else "open"), tag


class Blocks:
    """The blocks of a page: parent, tag, characters of their own and in links; and runs of text with their block."""

    def __init__(self, page: str) -> None:
        self.parent, self.tag, self.own, self.links, self.commas = [-1], [""], [0], [0], [0]
        self.runs: list[tuple[int, str]] = []
        self.last: list[int] = [0]
        stack, link = [0], 0
        for kind, what in tokens(page):
            if kind == "text":
                self._text(stack[-1], what, link > 0)
            elif what == "a":
                link = len(stack) if kind == "open" else 0
            elif kind == "open" and what == "br":
                self.runs.append((stack[-1], " "))
            elif what in BLOCKS and kind == "open":
                if self.tag[stack[-1]] == "p":  # nothing opens within a paragraph
                    self._end(stack, len(stack) - 1)
                if what in _CLOSES:
                    self._close(stack, _CLOSES[what], _HOLDS[what])
                if len(stack) > DEPTH:
                    self._end(stack, DEPTH)
                link = link if len(stack) >= link else 0
                self.parent.append(stack[-1])
                for x, v in ((self.tag, what), (self.own, 0), (self.links, 0), (self.commas, 0), (self.last, 0)):
                    x.append(v)
                self.runs.append((stack[-1], " "))
                stack.append(len(self.tag) - 1)
                self.runs.append((stack[-1], " "))
            elif what in BLOCKS:
                self._close(stack, (what,), ())
                link = link if len(stack) >= link else 0
        self._end(stack, 0)

    def _text(self, block: int, raw: str, linked: bool) -> None:
        text = html.unescape(raw)
        n = len("".join(text.split()))
        self.runs.append((block, text))
        self.own[block] += n
        self.links[block] += n * linked
        self.commas[block] += text.count(",")

    def _close(self, stack: list[int], tags: tuple[str, ...], held: tuple[str, ...]) -> None:
        """Closes the innermost open block of these tags, and all within it, unless a block that holds it in is nearer."""
        found = -1
        for k in range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[k]]
            if tag in held:
                break
            if tag in tags:
                found = k
                if len(tags) == 1:
                    break
        if found > 0:
            self._end(stack, found)

    def _end(self, stack: list[int], k: int) -> None:
        for block in stack[k:]:
            self.last[block] = len(self.tag) - 1
        self.runs += ((stack[k], " "), (stack[k - 1], " "))
        del stack[k:]


def article(page: str | None) -> str | None:
    """The article's text with runs of blanks as one, or None if no block has points."""
    if not page:
        return None
    b = Blocks(page)
    n = len(b.tag)
    aside = [False] * n
    points, own, links = [0.0] * n, b.own[:], b.links[:]
    for i in range(1, n):
        aside[i] = b.tag[i] in ASIDE or aside[b.parent[i]]
        if b.own[i] >= LEAST and not aside[i]:
            got = 1 + b.commas[i] + min(3, b.own[i] // 100)
            points[b.parent[i]] += got
            if b.parent[i] > 0:
                points[b.parent[b.parent[i]]] += got / 2
    for i in range(n - 1, 0, -1):
        own[b.parent[i]] += own[i]
        links[b.parent[i]] += links[i]
    scores = [p * (1 - x / max(1, o)) if not a else 0.0 for p, x, o, a in zip(points, links, own, aside, strict=True)]
    best = max(range(n), key=lambda i: (scores[i], -i))
    if scores[best] <= 0:
        return None
    keep = [best <= i <= b.last[best] and not aside[i] and b.links[i] <= MOST_LINKS * b.own[i] for i in range(n)]
    return " ".join("".join(t for i, t in b.runs if keep[i]).split()) or None


def article_of(page: Column) -> Column:
    return F.pandas_udf(lambda pages: pages.map(article), StringType())(page)
