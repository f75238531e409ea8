"""Main text of web pages.

Standard-library parser events are gathered into lines, one per block element.
Each line's text-to-tag ratio is smoothed with a Gaussian along the page; the
smoothed ratios fall into two clusters at the threshold that parts them best,
and the lines of the upper one, menus of links apart, are the content regions.

The regions choose the element that is the article: all outermost articles,
main, or else the innermost element that holds nearly all of their text (of the
page itself, what lies between the first and the last region). Its lines are
given in page order, short ones too, without menus, forms, adverts, notices or
comments. Elements that only a class, an id or a role makes one of these are
weighed against the regions: what holds most of their text is the article
whatever it is called.

Time is linear in the page, but for one sort of its lines.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import column

SCHEMA = "page_id long, url string, text string, n_chars long"

#: elements whose content is never text of the page
SKIP = frozenset("script style noscript template svg iframe object canvas audio video head title button select option textarea datalist".split())
#: elements that never belong to the article, if they are closed; a menu left open would take the page with it
APART = frozenset("nav footer aside dialog menu".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: elements that stand on lines of their own
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html "
    "li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: what a start tag of the key closes when it is open and nothing of the second set has been opened since
CLOSES = {
    **dict.fromkeys(BLOCKS - {"html", "body"}, (("p",), ("button", "table", "article", "section", "div", "li"))),
    "li": (("li", "p"), ("ul", "ol")),
    "dt": (("dt", "dd", "p"), ("dl",)),
    "dd": (("dt", "dd", "p"), ("dl",)),
    "tr": (("tr", "td", "th", "p"), ("table",)),
    "td": (("td", "th", "p"), ("tr", "table")),
    "th": (("td", "th", "p"), ("tr", "table")),
}

_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
#: what a class or an id names if its last word, places and wrappings apart, is one of these
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner banners sponsor sponsors sponsored promo promos promotion cookie cookies consent gdpr notice notices "
    "alert alerts popup popups modal overlay newsletter subscribe subscription sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer "
    "masthead topbar toolbar share sharing social related recommended recommendations widget widgets pagination pager login signin signup search hidden copyright reviews".split()
)
_READERS = frozenset("comment comments commentlist respond replies disqus".split())
#: or if its first word is one of these
_FIRST = frozenset("ad ads advert advertisement cookie newsletter sponsored disqus".split())
_PLACES = frozenset(
    "left right top bottom main site page primary secondary wrapper wrap container box block section area list inner outer content holder slot unit item items bar panel form links thread 1 2 3".split()
)
#: first words after which the rest says what a box has or does, or whose part it is
_HAS = frozenset("has with without no is not show hide js overflow entry post article".split())
_MORE, _POSTS = frozenset("related recommended recent popular trending more latest".split()), frozenset("posts articles stories links news items".split())

PLAIN, SET_APART, NAMED, READERS = range(4)
#: characters of region text that make a piece by themselves, and how far a named element must outweigh an article
LEAST, OUTWEIGHS = 200, 20


def named(token: str, in_article: bool) -> int:
    """Whether a class or an id names a part that is no article: PLAIN, NAMED or READERS."""
    words = [w.lower() for w in _WORDS.findall(token)]
    if not words:
        return PLAIN
    core = list(words)
    while len(core) > 1 and core[-1] in _PLACES:
        core.pop()
    if core[-1] in _READERS or "".join(words) in _READERS:
        return READERS
    if len(core) > 1 and core[0] in _HAS:
        return NAMED if core[-1] == "footer" else PLAIN
    if core[-1] == "header":
        return PLAIN if in_article else NAMED
    few = len(words) > 1 and words[-1] in _POSTS and words[-2] in _MORE
    return NAMED if core[-1] in _NAMES or words[0] in _FIRST or few else PLAIN


class Line:
    __slots__ = ("parts", "tags", "linked", "heading", "node", "text")

    def __init__(self, node: int) -> None:
        self.parts: list[tuple[int, str]] = []  # node and text
        self.tags = self.linked = 0
        self.heading = False
        self.node = node
        self.text = ""


class Lines(HTMLParser):
    """Lines of a page, and its block and named elements as nodes: kind, parent, tag, whether an end tag closed it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.missing: set[str] = set()
        self.lines: list[Line] = []
        self.open: list[tuple[str, int]] = []  # element, its node or -1
        self.at: dict[str, list[int]] = {}  # places of the open elements of a tag
        self.kind, self.parent, self.tag, self.closed = [PLAIN], [-1], ["page"], [True]
        self.node = self.skipping = self.links = self.articles = 0
        self.line = Line(0)

    def updatepos(self, i, j):
        return j  # line numbers aren't asked for

    # The page is fed as one piece, so what isn't ended here never is. Tags and
    # declarations without an end go to the end of the page, as in browsers;
    # comments without one end at the next tag's end, so that they don't take
    # the page with them. What was once searched for in vain isn't again.

    def _find(self, what: str, i: int) -> int:
        at = -1 if what in self.missing else self.rawdata.find(what, i)
        if at < 0:
            self.missing.add(what)
        return at

    def _past(self, what: str, i: int) -> int:
        at = self._find(what, i)
        return len(self.rawdata) if at < 0 else at + len(what)

    def parse_comment(self, i, report=1):
        for empty in ("<!-->", "<!--->"):
            if self.rawdata.startswith(empty, i):
                return i + len(empty)
        return self._past("-->" if self._find("-->", i + 4) >= 0 else ">", i + 4)

    def parse_html_declaration(self, i):
        if self.rawdata.startswith("<![CDATA[", i) and self._find("]]>", i) >= 0:
            return self._past("]]>", i)
        return self._past(">", i + 2)

    def parse_bogus_comment(self, i, report=1):
        return self._past(">", i + 2)

    def parse_pi(self, i):
        return self._past(">", i + 2)

    def parse_starttag(self, i):
        return len(self.rawdata) if self._find(">", i) < 0 else super().parse_starttag(i)

    def parse_endtag(self, i):
        return len(self.rawdata) if self._find(">", i) < 0 else super().parse_endtag(i)

    def _break(self) -> None:
        if self.line.parts:
            self.lines.append(self.line)
            self.line = Line(self.node)
        else:
            self.line.node = self.node
            self.line.heading = False

    def _pop(self, closed: bool = False) -> None:
        tag, node = self.open.pop()
        self.at[tag].pop()
        self.skipping -= tag in SKIP
        self.links -= tag == "a"
        self.articles -= tag in ("article", "main")
        if tag in BLOCKS:
            self._break()
        if node >= 0:
            self.closed[node] = closed
            self.node = self.parent[node]
            if not self.line.parts:
                self.line.node = self.node

    def _last(self, tags: tuple[str, ...]) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def _kind(self, tag: str, attrs) -> int:
        if tag in APART:
            return SET_APART
        kind = NAMED if tag == "form" or tag == "header" and not self.articles else PLAIN
        if tag in ("html", "body"):
            return kind
        for name, value in attrs:
            if name in ("class", "id") and value:
                found = max((named(t, self.articles > 0) for t in value.split()), default=PLAIN)
                if found == READERS or found == NAMED and tag not in ("article", "main"):
                    kind = max(kind, found)
            elif tag in ("article", "main"):
                continue
            elif name == "role" and (value or "").lower() in _ROLES or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and value and _HIDDEN.search(value):
                kind = max(kind, NAMED)
        return kind

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES:
            ends, walls = CLOSES[tag]
            while (at := self._last(ends)) > self._last(walls):
                while len(self.open) > at:
                    self._pop()
        if tag in BLOCKS:
            self._break()
        self.line.tags += 1
        if tag in VOID:
            if tag in ("br", "hr") and self.line.parts:
                self.line.parts.append((self.node, " "))
            return
        kind = self._kind(tag, attrs)
        node = -1
        if kind or tag in BLOCKS:
            node = len(self.kind)
            self.kind.append(kind)
            self.parent.append(self.node)
            self.tag.append(tag)
            self.closed.append(False)
            self.node = node
            if not self.line.parts:
                self.line.node = node
        self.at.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, node))
        self.skipping += tag in SKIP
        self.links += tag == "a"
        self.articles += tag in ("article", "main")
        if tag in HEADINGS:
            self.line.heading = True

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open and self.open[-1][0] == tag:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.line.tags += 1
        if self.at.get(tag):
            at = self.at[tag][-1]
            while len(self.open) > at + 1:
                self._pop()
            self._pop(closed=True)
        elif tag in BLOCKS:
            self._break()

    def handle_data(self, data):
        if self.skipping:
            return
        if data.isspace():
            if self.line.parts:
                self.line.parts.append((self.node, " "))
            return
        if not self.line.parts:
            self.line.node = self.node
        self.line.parts.append((self.node, data))
        if self.links:
            self.line.linked += len(data)


def smooth(values: list[float], sigma: float = 1.5) -> list[float]:
    """Gaussian; at the ends the kernel is cut and scaled."""
    reach = math.ceil(3 * sigma)
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]
    whole, out = sum(kernel), []
    for i in range(len(values)):
        lo, hi = max(0, i - reach), min(len(values), i + reach + 1)
        weights = kernel if hi - lo == len(kernel) else kernel[lo - i + reach : hi - i + reach]
        out.append(sum(map(float.__mul__, weights, values[lo:hi])) / (whole if weights is kernel else sum(weights)))
    return out


def threshold(values: list[float], least: float = math.log(2.5)) -> float:
    """The value from which on the upper of two clusters begins: the cut with the
    greatest variance between them. Where their means are less than `least`
    apart there is one cluster only, and the threshold is minus infinity."""
    ordered = sorted(values)
    n, total = len(ordered), sum(ordered)
    best, cut, below = 0.0, -math.inf, 0.0
    for k in range(1, n):
        below += ordered[k - 1]
        if ordered[k] == ordered[k - 1]:
            continue
        apart = (total - below) / (n - k) - below / k
        between = k * (n - k) * apart * apart
        if between > best:
            best, cut = between, ordered[k] if apart >= least else -math.inf
    return cut


def _squeezed(parts) -> str:
    return " ".join("".join(parts).split())


class Page:
    """A parsed page with its regions, and what of it is left out."""

    def __init__(self, html: str | None) -> None:
        doc = Lines()
        doc.feed(html or "")
        doc.close()
        doc._break()
        self.doc = doc
        self.lines = []
        for line in doc.lines:
            line.text = _squeezed(t for _, t in line.parts)
            if line.text:
                self.lines.append(line)
        ratios = [math.log1p(max(0, len(x.text) - x.linked) / max(1, x.tags)) for x in self.lines]
        self.menu = [2 * x.linked > len(x.text) for x in self.lines]
        smoothed = smooth(ratios)
        self.cut = threshold(smoothed)
        self.own = [r >= self.cut and not m for r, m in zip(ratios, self.menu, strict=True)]
        self.content = [r >= self.cut and not m for r, m in zip(smoothed, self.menu, strict=True)]
        self.gone = self._gone()
        self.weight = self._weights()

    def _up(self, per_node: list[float]) -> list[float]:
        """Each node's figure with those of all nodes in it."""
        for node in range(len(per_node) - 1, 0, -1):
            per_node[self.doc.parent[node]] += per_node[node]
        return per_node

    def _gone(self) -> list[bool]:
        """Per node whether it is left out. A named element, outer ones first,
        stays if it holds a piece of region text (LEAST characters or two lines)
        and more of it than all that isn't named; OUTWEIGHS times more, if the
        page has an article or main that is neither around it nor in it.
        Readers' comments stay if there is no other text."""
        doc = self.doc
        n = len(doc.kind)
        inside = self._outermost(("article", "main"))
        nearest, around = [-1] * n, [False] * n  # the named element around; whether an article is in a node
        for node in range(n - 1, 0, -1):
            around[doc.parent[node]] |= around[node] or doc.tag[node] in ("article", "main")
        for node in range(1, n):
            nearest[node] = node if doc.kind[node] else nearest[doc.parent[node]]
        held, pieces, own, rest, marked = [0.0] * n, [0.0] * n, [0.0] * n, 0.0, False
        for line, good, menu in zip(self.lines, self.content, self.menu, strict=True):
            size = len(line.text) * (1.0 if good else 0.0 if menu else 0.25)
            held[line.node] += size if good else 0.0
            pieces[line.node] += good
            if nearest[line.node] < 0:
                rest += size
                marked |= inside[line.node]
            else:
                own[nearest[line.node]] += size
        self._up(held)
        self._up(pieces)
        gone = [False] * n
        for node in range(1, n):
            kind = doc.kind[node]
            factor = OUTWEIGHS if marked and not inside[node] and not around[node] else 1
            stays = (held[node] >= LEAST or pieces[node] > 1) and (held[node] > factor * rest if kind != READERS else not rest)
            gone[node] = gone[doc.parent[node]] or bool(kind) and (kind == SET_APART and doc.closed[node] or not stays)
            if kind and not gone[node]:
                rest += own[node]
        return gone

    def _weights(self) -> list[float]:
        """Region text of each node; other text breaks ties."""
        weights = [0.0] * len(self.doc.kind)
        for line, good in zip(self.lines, self.content, strict=True):
            if not self.gone[line.node]:
                weights[line.node] += len(line.text) * (1.0 if good else 0.001)
        return self._up(weights)

    def _outermost(self, kinds: tuple[str, ...]) -> list[bool]:
        """Per node whether it is an outermost element of the kinds, or in one."""
        tag, parent = self.doc.tag, self.doc.parent
        inside = [False] * len(tag)
        for node in range(1, len(tag)):
            inside[node] = inside[parent[node]] or tag[node] in kinds
        return inside

    def chosen(self) -> tuple[list[bool], bool]:
        """Per node whether it is in the article; whether that is the whole page."""
        doc, weight = self.doc, self.weight
        total = weight[0]
        for kinds in (("article",), ("main",), ("article", "main")):
            inside = self._outermost(kinds)
            tops = [n for n in range(1, len(inside)) if inside[n] and not inside[doc.parent[n]]]
            if tops and 2 * sum(weight[n] for n in tops) > total:
                return inside, False
        # down to the innermost element with nearly all of the regions' text
        top = 0
        for node in range(1, len(weight)):
            if doc.parent[node] == top and not self.gone[node] and 10 * weight[node] > 9 * total > 0 and doc.tag[node] not in ("p", "li", "td", *HEADINGS):
                top = node
        inside = [False] * len(weight)
        inside[top] = True
        for node in range(top + 1, len(weight)):
            inside[node] = inside[doc.parent[node]]
        return inside, doc.tag[top] in ("page", "html", "body")

    def text(self) -> str:
        inside, whole = self.chosen()
        at = [i for i, x in enumerate(self.lines) if inside[x.node] and not self.gone[x.node]]
        if whole:
            at = self._between(at)
        menus = self._menus(at)
        texts = (_squeezed(t for n, t in self.lines[i].parts if not self.gone[n]) for i in at if i not in menus)
        return "\n".join(t for t in texts if t)

    def _between(self, at: list[int]) -> list[int]:
        """From the first to the last region, with the lines beside them that
        are like them by themselves, and the headings that lead into them."""
        marked = [k for k, i in enumerate(at) if self.content[i] and not self.lines[i].heading] or [k for k, i in enumerate(at) if self.content[i]]
        if not marked:
            return []
        lo, hi = marked[0], marked[-1]
        while lo and (self.own[at[lo - 1]] or self.lines[at[lo - 1]].heading):
            lo -= 1
        while hi + 1 < len(at) and self.own[at[hi + 1]]:
            hi += 1
        return [i for k, i in enumerate(at[lo : hi + 1], lo) if not self.menu[i]]

    def _menus(self, at: list[int]) -> set[int]:
        """Lines of runs of three or more that are nothing but links and lie in no region."""
        out, run = set(), []
        for i in [*at, -1]:
            line = self.lines[i] if i >= 0 else None
            if line and not self.content[i] and not line.heading and 10 * line.linked >= 9 * len(line.text):
                run.append(i)
                continue
            if len(run) >= 3:
                out.update(run)
            run = []
        return out


def main_text(html: str | None) -> str:
    """The article's lines, white space within one turned into single spaces, joined by one newline."""
    return Page(html).text()


def _extract(batches):
    for batch in batches:
        texts = [main_text(h.as_py()) for h in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text, n_chars (code points).

    Null and empty pages, and pages without text, give the empty text. Markup
    may be broken in any way. Repeated rows give repeated results, an empty
    table an empty one; null ids and urls stay; other columns aren't carried.
    """
    few = pages.select(
        column(pages, id_col).cast("long").alias("page_id"), column(pages, url_col).cast("string").alias("url"), column(pages, html_col).cast("string").alias("html")
    )
    return few.mapInArrow(_extract, SCHEMA)
