"""Main text of web pages by composite text density.

A page is parsed into a tree of blocks in one scan. Every block gets its composite text density, the
link-adjusted characters per tag; the block whose children's densities sum up highest, the body-path threshold
(the least characters per tag on the path from the body down to it) and the blocks beside that path decide
what the article is: from the heaviest block the choice goes down while one child alone holds the text, and up
while blocks of text that reach the threshold stand beside it.

Names only weigh. Text of a block whose class or id names a menu, an advert, a notice, comments and so on
counts as link text, so it has no density and is left out of the chosen subtree; but not if the block holds
most of the page's text: four fifths where other paragraphs stand outside (of reader comments, 20 times as much
as there is other text). `article` and `main` have no say at all.
Elements that are never article (nav, header outside of an article, footer, aside, controls, hidden ones)
aren't text; a form is one unless it holds most of the text. Scripts, styles and markup go.

Defined results: null, empty and unparsable html give an empty text; unclosed and misnested elements end
where HTML says that they end, at the latest with their parent; repeated rows are treated one by one;
other columns are ignored. A page is handled alone, so memory is bounded by the largest page; time grows in
proportion to its length, whatever its markup (a tag without an end is text).
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import text_batches

#: Elements whose content is never text.
RAW = frozenset("script style noscript template svg math iframe object canvas audio video title textarea xmp noembed noframes".split())
#: Elements beside the article.
ASIDE = frozenset("nav header footer aside form menu dialog button select fieldset input label option datalist search".split())
#: Elements that begin a block of their own.
BLOCK = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "blockquote pre figure figcaption address hr details summary hgroup center nav header footer aside form menu dialog fieldset search".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Blocks that are text by what they are, other than div and its like.
TEXTUAL = HEADINGS | frozenset("p ul ol dl table blockquote pre figure details address".split())
#: A start tag of the key ends open elements of the values, up to the nearest of the stops.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
#: Words of a class or id that mark reader comments, and other things that stand beside an article.
COMMENTS = frozenset("comment comments commentlist disqus respond reply replies".split())
MARKS = COMMENTS | frozenset(
    "nav navbar navigation menu menus header masthead footer foot sidebar aside notice notices cookie cookies consent banner gdpr "
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion "
    "breadcrumb breadcrumbs pagination pager share sharing social related recommended newsletter subscribe signup login popup modal overlay toolbar widget alert".split()
)
#: Words beside which a mark says what a block stands next to, or that it is an article's own header.
BESIDE_MARK = frozenset("no not without has have having with".split())
OWN_HEADER = frozenset("article entry post story section chapter content".split())

# possessive: no scan is made again where a tag turns out to have no end
SIMPLE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>\"']*+)>")
NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
ATTR = re.compile(r"([^\s>/=]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'][^\s>]*)))?")
NEXT = re.compile(r"[>\"']")
WORDS = re.compile(r"[^a-z]+")
CAMEL = re.compile(r"([a-z])([A-Z])")
#: Numbers of character references that are no characters, and leading zeros, which int() counts as digits.
LONG_REF = re.compile(r"&#(?:[xX]0*+[1-9a-fA-F][0-9a-fA-F]{7,}|0*+[1-9][0-9]{7,});?")
ZEROS = re.compile(r"(&#[xX]?)0++(?=[0-9a-fA-F])")
NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)


def marked(value: str) -> str:
    """What a class or id says of a block: "comments", "other", or nothing. A word next to a negation or `with`
    (`no-sidebar`, `main-with-comments`) says nothing, nor does the header of an article (`entry-header`)."""
    said = ""
    for token in value.split():
        words = set(WORDS.split(CAMEL.sub(r"\1 \2", token).lower()))
        if MARKS.isdisjoint(words) or not BESIDE_MARK.isdisjoint(words):
            continue
        if not (found := words & MARKS) - {"header", "foot", "footer"} and not OWN_HEADER.isdisjoint(words):
            continue
        if not COMMENTS.isdisjoint(found):
            return "comments"
        said = "other"
    return said


def beside(name: str, attrs: str) -> str:
    """What says of an element that it doesn't belong to the article: "element" (name, role or state),
    "comments" or "other" (class or id); else nothing."""
    if name in ASIDE:
        return "element"
    if not attrs or attrs.isspace() or name in ("body", "html"):
        return ""
    own: dict[str, str] = {}
    for key, a, b, c in ATTR.findall(attrs):
        own.setdefault(key.lower(), a or b or c)  # of attributes of one name the first counts
    if "hidden" in own or own.get("aria-hidden", "").lower() == "true" or own.get("role", "").lower() in ROLES or NO_DISPLAY.search(own.get("style", "")):
        return "element"
    found = [w for key in ("class", "id") if (v := own.get(key)) and (w := marked(v))]
    return "comments" if "comments" in found else found[0] if found else ""


class Node:
    """A block. own: (place in the page, text) of the runs directly in it. The counts are of the whole subtree,
    without what is gone; `first` are those of the block's own text and inline elements."""

    __slots__ = ("name", "parent", "kids", "own", "why", "dead", "gone", "first", "chars", "tags", "link_chars", "link_tags", "texts", "density", "total")

    def __init__(self, name: str, parent: Node | None, why: str = ""):
        self.name, self.parent, self.why = name, parent, why
        self.kids: list[Node] = []
        self.own: list[tuple[int, list[str]]] = []
        self.dead = self.gone = False
        self.first = [0, 0, 0, 0]  # characters, tags, the same of links
        self.chars = self.tags = self.link_chars = self.link_tags = self.texts = 0
        self.density = self.total = 0.0

    @property
    def plain(self) -> int:
        return self.chars - self.link_chars

    @property
    def own_plain(self) -> int:
        return self.first[0] - self.first[2]


def unescape(raw: str) -> str:
    if "&" not in raw:
        return raw
    if "&#" in raw:
        raw = LONG_REF.sub("\ufffd", ZEROS.sub(r"\1", raw))
    return html.unescape(raw)


class Tags:
    """The markup of a page from a place on; every scan for an end is made once."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.ends: dict[str, tuple[int, int, int]] = {}  # of an element: searched from, found at, its end

    def next(self, pos: int) -> tuple[int, int, str, str, str] | None:
        """Begin, end, slash, name ('' for comments and declarations) and attributes of the next markup."""
        page = self.page
        while True:
            at = page.find("<", pos)
            if at < 0 or at > self.last and not page.startswith("<!--", at):
                return None
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                return at, len(page) if end < 0 else end + 3, "", "", ""
            if (m := SIMPLE.match(page, at)) is not None:
                return at, m.end(), m[1], m[2], m[3]
            if page[at + 1 : at + 2] in ("!", "?"):
                return at, page.find(">", at) + 1, "", "", ""
            if (m := NAME.match(page, at)) is not None:
                end = self.attributes_end(m.end())
                return at, end, m[1], m[2], page[m.end() : end - 1]
            pos = at + 1

    def attributes_end(self, pos: int) -> int:
        """Behind the tag's end: the first > outside of quotes; a quote that isn't closed is a character."""
        page = self.page
        while (m := NEXT.search(page, pos)) is not None:
            if m[0] == ">":
                return m.end()
            close = page.find(m[0], m.end())
            if close < 0 or close > self.last:
                return page.find(">", m.end()) + 1 or self.last + 1
            pos = close + 1
        return self.last + 1

    def raw_end(self, name: str, pos: int) -> int:
        """Behind the end tag of an element whose content isn't markup; -1 without one."""
        since, at, end = self.ends.get(name, (len(self.page), -1, -1))
        if pos < since or -1 < at < pos:
            m = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(self.page, pos)
            end = -1 if m is None else self.page.find(">", m.end()) + 1 or len(self.page)
            self.ends[name] = (pos, -1 if m is None else m.start(), end)
        return end


def parse(page: str) -> list[Node]:
    """The blocks of a page from the body down, parents before their children."""
    body = Node("body", None)
    nodes, node = [body], body
    tags, end = Tags(page), len(page)
    stack: list[tuple[str, Node, bool, bool]] = []  # open elements: name, the block around, whether they are a link, left out
    places: defaultdict[str, list[int]] = defaultdict(list)  # where in the stack the elements of a name are
    blocks: list[int] = []  # where in the stack the blocks are
    links = out = order = 0
    text: list[str] | None = None

    def add(raw: str) -> None:
        nonlocal text, order
        if out:
            return
        t = unescape(raw)
        if text is None:
            if not t.strip():
                return
            text = []
            order += 1
            node.own.append((order, text))
        text.append(t)
        n = len(t) - t.count(" ")
        node.first[0] += n
        if links:
            node.first[2] += n

    def close(depth: int) -> None:
        """Close open elements until `depth` are left."""
        nonlocal node, links, out, text
        while len(stack) > depth:
            name, around, link, left_out = stack.pop()
            places[name].pop()
            links -= link
            out -= left_out
            if name in BLOCK:
                blocks.pop()
                node, text = around, None

    def last(names) -> int:
        return max((places[n][-1] for n in names if places[n]), default=-1)

    pos = 0
    while pos < end:
        found = tags.next(pos)
        if found is None:
            add(page[pos:])
            break
        start, after, slash, name, attrs = found
        if start > pos:
            add(page[pos:start])
        pos = after
        if not name:
            continue
        name = name.lower()
        if name in RAW:
            if not slash and not attrs.endswith("/"):
                stop = tags.raw_end(name, pos)
                if stop >= 0:
                    pos = stop
                elif name not in ("noscript", "template"):
                    pos = end
            continue
        if name in ("html", "body", "head"):
            continue
        if slash:
            at = last((name,))
            if at >= 0 and (name in BLOCK or not blocks or blocks[-1] < at):
                close(at)
            continue
        if name == "br":
            if text is not None and not out:
                text.append(" ")
            node.first[1] += 1
            continue
        if name in VOID:
            if name == "hr":
                text = None
            node.first[1] += 1
            continue
        if name in ENDS:
            names, stops = ENDS[name]
            stop = last(stops)
            own = [places[n][i] for n in names if (i := bisect_right(places[n], stop)) < len(places[n])]
            if own:
                close(min(own))
        why = beside(name, attrs)
        if name in BLOCK:
            if blocks and stack[blocks[-1]][0] == "p":
                close(blocks[-1])
            if name == "header" and why == "element" and places["article"]:
                why = ""
            fresh = Node(name, node, why)
            node.kids.append(fresh)
            nodes.append(fresh)
            places[name].append(len(stack))
            blocks.append(len(stack))
            stack.append((name, node, False, False))
            node, text = fresh, None
        else:
            link = name == "a"
            if link and places["a"] and (not blocks or places["a"][-1] > blocks[-1]):
                close(places["a"][-1])
            left_out = why == "element" or bool(why) and not link
            places[name].append(len(stack))
            stack.append((name, node, link, left_out))
            links += link
            out += left_out
            node.first[1] += 1
            node.first[3] += link
    return nodes


def gather(nodes: list[Node]) -> None:
    """The counts of all subtrees; dead blocks count as link text, those that are gone not at all."""
    for n in nodes:
        n.chars, n.tags, n.link_chars, n.link_tags = n.first
        n.texts = 0
    for n in reversed(nodes):  # children come after their parent
        n.texts += n.plain > 0 and n.name in TEXTUAL
        if (p := n.parent) is None or n.gone:
            continue
        p.chars += n.chars
        p.tags += n.tags + 1
        p.link_chars += n.chars if n.dead else n.link_chars
        p.link_tags += n.tags + 1 if n.dead else n.link_tags
        p.texts += 0 if n.dead else n.texts


def weigh(nodes: list[Node]) -> None:
    """Which blocks are dead by their names, which don't decide over what holds most of the page's text."""
    for n in nodes:
        n.gone = n.why == "element" and n.name not in ("form", "fieldset")
    gather(nodes)
    if not any(n.why for n in nodes):
        return
    whole, rest, texts = nodes[0].plain, 0, 0
    for n in nodes:  # text outside of all that is named; `dead` is a flag for that for now
        n.dead = bool(n.why) or n.parent is not None and n.parent.dead
        rest += 0 if n.dead else n.own_plain
        texts += not n.dead and n.own_plain > 0 and n.name in TEXTUAL
    for n in nodes:
        most = 2 * n.plain > whole
        if n.why == "element":
            n.gone = n.gone or not (most and n.texts)
            dead = n.gone
        elif n.why == "comments":
            dead = not most or 20 * rest >= n.plain
        else:
            # it isn't the article where paragraphs stand outside and it has none, or less than four times their text
            dead = n.why == "other" and (not most or texts > 0 and (not n.texts or 4 * rest >= n.plain))
        n.dead = dead or n.parent is not None and n.parent.dead
    gather(nodes)


def score(nodes: list[Node]) -> None:
    """Composite text density of every block, and the sum over its children."""
    body = nodes[0]
    share = body.link_chars / max(body.chars, 1)
    for n in nodes:
        if not n.chars or n.dead:
            continue
        tags, plain = max(n.tags, 1), max(n.plain, 1)
        base = math.log(n.chars / plain * n.link_chars + share * n.chars + math.e)
        odds = n.chars / max(n.link_chars, 1) * tags / max(n.link_tags, 1)
        n.density = n.chars / tags * max(math.log(max(odds, 1.0)), 0.0) / max(math.log(base + math.e - 1), 1e-9)
    for n in reversed(nodes):
        if n.parent is not None:
            n.parent.total += n.density


def per_tag(n: Node) -> float:
    """Characters outside links for each tag."""
    return n.plain / max(n.tags, 1)


class Company:
    """What a block `k` holds, to judge the blocks beside it by."""

    def __init__(self, k: Node, threshold: float):
        self.k, self.threshold = k, threshold
        live = [x for x in k.kids if x.plain and not x.dead]
        self.parts = max(len(live), 1)
        #: whether its text stands in blocks without a meaning of their own
        self.plain_blocks = 2 * sum(x.name not in TEXTUAL and not x.texts for x in live) > len(live) or not live and k.name not in TEXTUAL
        self.titled = any(x.name == "h1" for x in live)

    def takes(self, s: Node) -> bool:
        """Whether a block beside it belongs to the same text."""
        if s.dead or not s.plain or 2 * s.link_chars > s.chars:
            return False
        if s.name in HEADINGS:
            return not (s.name == "h1" and self.titled)
        if per_tag(s) < self.threshold:
            return False
        return s.name in TEXTUAL or s.texts > 0 or self.plain_blocks and 4 * s.plain * self.parts >= self.k.plain


def article(nodes: list[Node]) -> tuple[Node, set[int]]:
    """The block that holds the article, and the ids of blocks in it that are left out."""
    body = best = nodes[0]
    for n in nodes:
        if n.total > best.total and not n.dead:
            best = n
    low = math.inf  # the body-path threshold
    n = best
    while n is not None:
        low = min(low, per_tag(n))
        n = n.parent

    # down, while one child alone holds much of the density, one of paragraphs sooner than another
    while True:
        kid = max((k for k in best.kids if k.density > 0 and k.name not in TEXTUAL), key=lambda k: (k.texts > 0, k.total, k.density), default=None)
        if kid is None or (10 if kid.texts else 2) * max(kid.total, kid.density) < best.total or 4 * best.own_plain >= kid.plain:
            break
        company = Company(kid, min(low, per_tag(kid)))
        if any(company.takes(k) for k in best.kids if k is not kid):
            break
        best, low = kid, company.threshold

    # up, while text stands beside
    company, top, left_out = Company(best, low), best, set()
    at, dropped, path_up = best, set(), {best}
    while at.parent is not None:
        p = at.parent
        beside_it = [k for k in p.kids if k is not at]
        joins = [k for k in beside_it if company.takes(k)]
        # text that joins by its element keeps what is short among it; the rest goes
        dropped |= {id(k) for k in beside_it if not k.dead and k not in joins and not (joins and k.name in TEXTUAL and 2 * k.link_chars <= k.chars)}
        if joins or 4 * p.own_plain >= best.plain > 0:
            top = p
            left_out |= dropped
            dropped = set()
        at = p
        path_up.add(p)
    if top is body:  # nothing wraps the article: lists of links beside its paragraphs are menus
        left_out |= {id(k) for k in body.kids if k not in path_up and k.name != "p" and 2 * k.link_chars > k.chars}
    return top, left_out


def extract_text(page: str | None) -> str:
    """The article's blocks, one after the other, with an empty line between them."""
    if not page:
        return ""
    nodes = parse(page)
    weigh(nodes)
    score(nodes)
    top, left_out = article(nodes)
    runs, todo = [], [top]
    while todo:
        n = todo.pop()
        if n.dead or id(n) in left_out:
            continue
        runs += n.own
        todo += n.kids
    runs.sort(key=lambda r: r[0])
    return "\n\n".join(t for _, parts in runs if (t := " ".join("".join(parts).split())))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract_text(v.as_py()) for v in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return text_batches(rows).mapInArrow(run, "page_id long, url string, text string, n_chars long")
