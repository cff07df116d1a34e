"""Main text of web pages by tree scoring.

A page becomes a tree of elements. What is no reading matter by its kind goes with all that it holds (scripts,
menus, footers, forms), and so does what names itself so by class, id or role (adverts, notices, comments). Each
block of text that is left passes points, for its length and its commas, to its ancestors: all to the first,
half to the second, less to further ones. An element's points count by the share of its text that isn't in links. The
best element, or the article that it is part of, gives the text, together with siblings that have a fair part
of its points or are headings of it.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from commitloom.llm.common import blocks, record

#: Elements without content, and ones whose content is no markup.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements that are no part of a line of text.
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend"
    " li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: What opening these ends, where it is open: an element of the second, up to one of the third.
_LISTS, _TABLE = frozenset("ul ol menu dir".split()), frozenset(["table"])
ENDS = {
    "li": (frozenset(["li"]), _LISTS), "dt": (frozenset("dt dd".split()), frozenset(["dl"])), "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
    "tr": (frozenset("tr td th".split()), _TABLE), "td": (frozenset("td th".split()), _TABLE), "th": (frozenset("td th".split()), _TABLE),
    "tbody": (frozenset("tbody thead tfoot tr td th".split()), _TABLE), "tfoot": (frozenset("tbody thead tfoot tr td th".split()), _TABLE), "thead": (frozenset("tbody thead tfoot tr td th".split()), _TABLE),
    "option": (frozenset(["option"]), frozenset(["select"])), "a": (frozenset(["a"]), frozenset("td th li table".split())), "body": (frozenset(["head"]), frozenset()),
}
#: Opening one of these ends an open paragraph of the same container.
ENDS_P = BLOCK - frozenset("br caption body head html legend option optgroup tbody td tfoot th thead tr dd dt li".split()) | frozenset("li dd dt".split())
#: Where only the nearest of those is looked for; parts of tables; where an open paragraph isn't looked for.
ENDS_FIRST = frozenset("li dt dd option a".split())
_PARTS_OF_TABLE = frozenset("table tbody td tfoot th thead tr".split())
_NO_PARAGRAPH = BLOCK - frozenset(["br", "p"])
#: An end tag doesn't reach beyond these, and neither does the end of a paragraph.
WALLS = frozenset("table td th caption".split())
#: Elements that go by their kind, and by their part in the page.
GONE = frozenset(
    "aside audio button canvas datalist dialog embed fieldset footer form frame head iframe input map menu meter nav noembed noframes noscript object optgroup option output progress script select"
    " style svg template textarea title video xmp".split()
)
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words of a class or id that tell what an element is.
AWAY = frozenset(
    "ad adbox ads adsense adslot adunit advert advertisement advertising adverts alert banner billboard breadcrumb breadcrumbs comment commentlist comments consent cookie cookies discussion disqus"
    " dropdown footer footnav gdpr header hidden infobar login masthead menu menubar menus modal nav navbar navi navigation newsletter notice notices notification outbrain pager pagination popup privacy"
    " promo promoted promotion promotions recommended related replies reply respond responses search share sharing shopping sidebar sidenav signup skip social sponsor sponsored sponsors subscribe"
    " subscription taboola toolbar topbar usercomments widget widgets".split()
)
#: Those that send an article away that nothing speaks for; those that don't count beside a word for an article, or inside one.
AWAY_ARTICLE = frozenset("ad ads advert advertisement comment comments promo promoted recommended related replies reply sponsored widget".split())
TITLES = frozenset("banner header masthead".split())
#: Words before (or after) which another one says nothing: a page with, or without, such a part.
WITH = frozenset("has is no open with without".split())
#: Elements that are gone by no other word, as they may hold the article; and words and kinds that speak for one.
STAY = frozenset("html body main article".split())
TOWARD = frozenset("article blog body content entry hentry main page post posting story text".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Points for what speaks for an element; the share of the best one's points that a sibling needs.
FAVOUR, SIBLING = 25, 0.2
#: A list or other container with this share of its text in links is a menu.
LINKS = 0.8
#: How many ancestors get points, and what counts as a comma.
LEVELS, COMMAS = 5, ",،，、"

_TAG = re.compile(r"<!--(?:>|->|.*?--!?>|.*)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)>|<[!?/][^>]*>|</?[a-zA-Z!?].*", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAMED = re.compile(r"class|id|role|hidden|style|aria|itemprop", re.I)
_RAW_END = {k: re.compile(rf"</{k}(?:\s[^>]*|/)?>|</{k}[^>]*$", re.I) for k in RAW}
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Element:
    __slots__ = ("kind", "parent", "of", "name", "points", "size", "links", "anchors", "gone", "parted", "in_article", "words")

    def __init__(self, kind: str, parent: Element | None, name: dict[str, str]):
        self.kind, self.parent, self.name = kind, parent, name
        self.of: list[Element | str] = []
        self.points = 0.0
        self.size = self.links = self.anchors = 0
        self.gone = self.parted = False
        self.in_article = parent is not None and (parent.in_article or parent.kind == "article")
        self.words = words_of(name.get("class", "")) | words_of(name.get("id", "")) if name else frozenset()

    def elements(self) -> list[Element]:
        return [y for y in self.of if isinstance(y, Element)]


def words_of(text: str) -> set[str]:
    """Lower-cased words of a class or id, also as they are written together in mixed case, without those after has, no and the like."""
    out = set()
    for name in text.split():
        words = [w.lower() for w in _PARTS.findall(name)]
        out |= {w for i, w in enumerate(words) if not (i and words[i - 1] in WITH or words[i + 1 : i + 2] == ["free"])}
    return out


def attributes(text: str) -> dict[str, str]:
    """Of a tag, those that tell what it is; the first of a name counts."""
    if not text or not _NAMED.search(text):
        return {}
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return out


def tree(page: str) -> Element:
    """The page's elements. End tags without an element are ignored; what is open at the end ends there."""
    open_, n_open = [Element("html", None, {})], Counter({"html": 1})

    def leave(at: int) -> None:
        for x in open_[at:]:
            n_open[x.kind] -= 1
        del open_[at:]

    def place(kinds: frozenset[str], walls: frozenset[str], first: bool = True) -> int | None:
        """Where in open_ the nearest of ``kinds`` is, or the farthest, before a wall."""
        if not any(n_open[k] for k in kinds):
            return None
        found = None
        for i in range(len(open_) - 1, 0, -1):
            kind = open_[i].kind
            if kind in kinds:
                found = i
                if first:
                    break
            elif kind in walls:
                break
        return found

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        if m is None or m.start() > at:
            open_[-1].of.append(html.unescape(page[at : m.start() if m else end]))
        if m is None:
            break
        at, kind = m.end(), (m[2] or "").lower()
        if not kind or kind == "html":
            continue
        if m[1]:
            found = place(frozenset([kind]), frozenset() if kind in _PARTS_OF_TABLE else WALLS)
            if kind == "br":
                open_[-1].of.append(Element("br", open_[-1], {}))
            elif found:
                leave(found)
            continue
        if kind in ENDS_P and (found := place(frozenset("p"), _NO_PARAGRAPH)):
            leave(found)
        if kind in ENDS and (found := place(*ENDS[kind], kind in ENDS_FIRST)):
            leave(found)
        made = Element(kind, open_[-1], attributes(m[3]))
        open_[-1].of.append(made)
        if kind in RAW:
            close = _RAW_END[kind].search(page, at)
            at = close.end() if close else end
        elif kind not in VOID:
            open_.append(made)
            n_open[kind] += 1
    return open_[0]


def is_away(x: Element) -> bool:
    """Whether an element is no reading matter, by kind or by name."""
    if x.kind in STAY:
        return "hidden" in x.name or x.kind == "article" and bool(x.words & AWAY_ARTICLE) and not x.words & TOWARD
    if x.kind in GONE or x.kind == "header" and not x.in_article:
        return True
    if not x.name:
        return False
    style = "".join(x.name.get("style", "").lower().split())
    if "hidden" in x.name or x.name.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style or x.name.get("role", "").lower() in ROLES:
        return True
    away = x.words & AWAY
    return bool(away - TITLES if x.in_article or x.words & TOWARD or x.kind in HEADING else away)


def inside(root: Element) -> list[Element]:
    """The elements that stay, parents before what they hold; those that go are marked.

    An element with a telling name stays if all articles of the page are in such elements and it holds one.
    """
    every, stack = [], [root]
    while stack:
        x = stack.pop()
        every.append(x)
        stack.extend(reversed(x.elements()))
    holds: set[int] = set()
    for x in reversed(every):
        x.gone = is_away(x)
        if id(x) in holds or x.kind in ("article", "main") and not x.gone:
            holds.add(id(x.parent))

    def left(wrappers: bool) -> list[Element]:
        out, stack = [], [root]
        while stack:
            x = stack.pop()
            if x.gone and not (wrappers and id(x) in holds and x.kind in ("div", "section", "td", "form")):
                continue
            x.gone = False
            out.append(x)
            stack.extend(reversed(x.elements()))
        return out

    out = left(False)
    return out if not holds or any(x.kind in ("article", "main") for x in out) else left(True)


def passed(text: str) -> float:
    """Points of a block of text."""
    return min(len(text) / 100, 3) + sum(map(text.count, COMMAS)) + (len(text) >= 25)


def score(elements: list[Element]) -> None:
    """Points, sizes of text and of text in links of all elements; blocks are runs of text that no block element parts."""
    for x in reversed(elements):
        # what an element holds has been looked at, as parents come first
        x.parted = any((y.kind in BLOCK or y.parted) and not y.gone for y in x.elements())
        block = x.kind in BLOCK or x.parted or x.parent is None
        # a paragraph's points go to its parent first; loose text of a container to that
        to = x if x.parted or x.parent is None or x.kind in STAY else x.parent
        own: list[str] = []
        for y in [*x.of, None]:
            if isinstance(y, str):
                x.size += len(y.strip())
                own.append(y)
            elif y is None or not y.gone and (y.kind in BLOCK or y.parted):
                if block and (text := " ".join("".join(own).split())):
                    points, z = passed(text), to
                    for level in range(LEVELS):
                        if z is not None:
                            z.points += points / (1, 2, 6, 9, 12)[level]
                            z = z.parent
                own = []
            elif not y.gone and block:
                own.extend(pieces(y))
            if isinstance(y, Element) and not y.gone:
                x.size += y.size
                x.links += y.size if y.kind == "a" else y.links
                x.anchors += y.anchors + (y.kind == "a" and y.size > 0)


def pieces(x: Element) -> list[str]:
    """Texts of an element that stay, white space where blocks part."""
    out, stack = [], [x]
    while stack:
        y = stack.pop()
        if isinstance(y, str):
            out.append(y)
        elif not y.gone:
            if y.kind in BLOCK:
                out.append(" ")
                stack.append(" ")
            stack.extend(reversed(y.of))
    return out


def density(x: Element) -> float:
    return x.links / x.size if x.size else 0.0


def value(x: Element) -> float:
    if not x.points:
        return 0.0
    named = x.words & TOWARD or "articlebody" in x.name.get("itemprop", "").lower() or x.name.get("role", "").lower() in ("main", "article")
    favour = FAVOUR * ((x.kind == "article") + 0.5 * (x.kind == "main") + 0.5 * bool(named))
    return (x.points + favour) * (1 - density(x))


def main_parts(root: Element) -> list[Element]:
    """The elements whose text is the page's main text, in page order."""
    elements = inside(root)
    score(elements)
    for x in elements:
        # menus and lists of links within what stays
        if x.anchors >= 2 and density(x) >= LINKS and x.kind in ("ul", "ol", "dl", "div", "section", "table"):
            x.gone = True
    containers = [x for x in elements if not x.gone and x.points > 0 and (x.kind in BLOCK or x.parent is None) and x.kind not in HEADING and x.kind not in ("p", "br", "hr")]
    if not containers:
        return []
    best = max(containers, key=value)
    x = best
    while x is not None and x.kind != "article":
        x = x.parent
    if x is None:
        x = best
        while x is not None and not (x.kind == "main" or x.name.get("role", "").lower() == "main"):
            x = x.parent
    best = x or best
    if best.parent is None or best.kind in ("body", "main"):
        return [best]
    least, before, out = SIBLING * value(best), True, []
    for y in best.parent.of:
        if y is best:
            before = False
            out.append(y)
        elif isinstance(y, Element) and not y.gone and y.size:
            heading = before and y.kind in HEADING
            paragraph = best.kind != "article" and y.kind == "p" and density(y) < 0.25
            alike = y.points > 0 and y.kind not in HEADING and y.kind != "p" and (y.kind == best.kind or best.kind != "article") and value(y) >= least and density(y) < 0.25
            if heading or paragraph or alike:
                out.append(y)
    return out


def main_text(page: str) -> str:
    """The main text of a page: blocks in page order, one space between words and between blocks."""
    return " ".join("".join(s for x in main_parts(tree(page)) for s in pieces(x)).split())


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every row of ``pages`` (page_id, url, html; other columns are ignored).

    Null and empty pages, and pages without any text that stays, give an empty text; of equally good elements
    the first in the page is taken. Repeated rows give repeated results, an empty table none. Pages are read
    whole; unclosed elements end with the page, and a tag that is cut off at its end is no text.
    """
    names = ["page_id", "url"]

    def run(batches):
        for batch in batches:
            for block in blocks(batch, "html"):
                found = [main_text(x) if x else "" for x in block.column("html").to_pylist()]
                yield record([("page_id", block.schema.field("page_id").type), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())], block.column("page_id"), block.column("url"), found, [len(x) for x in found])

    kept = pages.select(*names, "html")
    return kept.mapInArrow(run, kept.select(*names).schema.add("text", "string").add("n_chars", "long"))
