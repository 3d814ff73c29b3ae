"""Article text against a tree of the page."""

import random
from html.parser import HTMLParser

from brindle.functions import article as A

LISTS = {"li": ({"li"}, {"ul", "ol"}), "td": ({"td", "th"}, {"table"}), "tr": ({"td", "th", "tr"}, {"table"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"})}


class Node:
    def __init__(self, tag, up):
        self.tag, self.up, self.kids = tag, up, []  # kids: nodes, or (text, whether in a link)

    def above(self):
        x = self
        while x:
            yield x
            x = x.up


class Tree(HTMLParser):
    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", None)
        self.link, self.skip = None, None
        self.feed(page)
        self.close()

    def leave(self, node):
        self.at = node.up
        if self.link and not any(x is self.link for x in self.at.above()):
            self.link = None

    def handle_starttag(self, tag, attrs):
        if self.skip:
            return
        if tag in A.SKIPPED:
            self.skip = tag
        elif tag == "a":
            self.link = self.at
        elif tag == "br":
            self.at.kids.append((" ", False))
        elif tag in A.BLOCKS:
            if self.at.tag == "p":
                self.leave(self.at)
            closes, holds = LISTS.get(tag, (set(), set()))
            last = None
            for x in self.at.above():
                if x.tag in holds:
                    break
                if x.tag in closes:
                    last = x
                    if tag == "li":
                        break
            if last:
                self.leave(last)
            self.at.kids.append(Node(tag, self.at))
            self.at = self.at.kids[-1]

    def handle_endtag(self, tag):
        if self.skip:
            if tag == self.skip:
                self.skip = None
        elif tag == "a":
            self.link = None
        elif tag in A.BLOCKS:
            open_ = next((x for x in self.at.above() if x.tag == tag), None)
            if open_:
                self.leave(open_)

    def handle_data(self, data):
        if not self.skip:
            self.at.kids.append((data, self.link is not None))


def solid(text):
    return len("".join(text.split()))


def own(node, linked=False):
    return sum(solid(k[0]) for k in node.kids if isinstance(k, tuple) and (k[1] or not linked))


def whole(node, linked=False):
    return own(node, linked) + sum(whole(k, linked) for k in node.kids if isinstance(k, Node))


def walk(node):
    yield node
    for k in node.kids:
        if isinstance(k, Node):
            yield from walk(k)


def plain(page):
    root = Tree(page).root
    aside = lambda x: any(y.tag in A.ASIDE for y in x.above())

    def points(x):
        return 1 + sum(k[0].count(",") for k in x.kids if isinstance(k, tuple)) + min(3, own(x) // 100) if x is not root and own(x) >= 25 and not aside(x) else 0

    def score(x):
        if aside(x):
            return 0
        below = [k for k in x.kids if isinstance(k, Node)]
        got = sum(points(k) for k in below) + sum(points(g) for k in below for g in k.kids if isinstance(g, Node)) / 2
        return got * (1 - whole(x, True) / max(1, whole(x)))

    best = max(walk(root), key=score)  # the first of equal ones
    if score(best) <= 0:
        return None

    def text(x):
        keep = not aside(x) and own(x, True) <= 0.5 * own(x)
        return "".join((k[0] if keep else "") if isinstance(k, tuple) else f" {text(k)} " for k in x.kids)

    return " ".join(text(best).split()) or None


def made(rng):
    """A page of nested, unclosed and link-heavy blocks."""
    out = []
    tags = ["div", "p", "ul", "ol", "li", "table", "tr", "td", "section", "article", "nav", "blockquote", "dl", "dt", "dd", "aside", "b", "span", "a", "h2", "footer"]
    for _ in range(rng.randrange(5, 120)):
        kind = rng.random()
        if kind < 0.35:
            out.append(f"<{rng.choice(tags)}{rng.choice(['', ' class=x', ' id=\"y\"'])}>")
        elif kind < 0.55:
            out.append(f"</{rng.choice(tags)}>")
        elif kind < 0.9:
            out.append(" ".join(rng.choice(["word", "comma,", "&amp;", "é", "some", "\n"]) for _ in range(rng.randrange(1, 60))))
        else:
            out.append(rng.choice(["<br>", "<!-- a <p> comment -->", "<script>if (a < b) '<p>'</script>", "<style>p{}</style>", "<a href=x>link text, long enough to count as one</a>"]))
    return "".join(out)


def test_articles_equal_those_of_a_tree():
    rng = random.Random(6)
    pages = [made(rng) for _ in range(1500)]
    got = [A.article(p) for p in pages]
    assert got == [plain(p) for p in pages] and sum(x is not None for x in got) > 800 and None in got


def test_articles_of_known_pages(spark, sf):
    para = "A sentence, with a comma, that is long enough to count as text of an article. " * 3
    page = f"<title>T</title><nav><p>{para}</nav><div id=menu><ul>" + "<li><a href=/x>A link of some length, again</a>" * 20 + f"</ul></div><div><h1>Head</h1><p>{para}<p>{para}<ul><li>{para}</ul></div><footer>{para}</footer>"
    assert A.article(page) == " ".join(("Head " + para * 3).split())
    assert A.article(None) is None and A.article("") is None and A.article("short") is None and A.article("a < b <p") is None
    assert A.article("<div>" * 200_000 + f"<p>{para}</p>" + "<td></td>" * 50_000 + "<a " * 100_000) == para.strip()
    rows = spark.read.parquet(f"{sf}/pages.parquet").select("html").collect()
    assert all(A.article(r.html) == plain(r.html) for r in rows) and sum(A.article(r.html) is not None for r in rows) > 0.9 * len(rows)
