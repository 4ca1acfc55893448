"""Main text of web pages by union-free wrapper inference.

A page is a stream of tokens: opening and closing block tags, and text. The streams of a host are
aligned one after another into one wrapper, a regular expression without unions. Equal tags match;
where the streams differ, tags of one side become optional, neighbours that come again (one element,
or several in a row) fold into a repeated group, and texts that differ become a slot. What stays
constant over different pages is template.

The wrapper decides what a page's text is. It knows how much text its slots hold over all pages of
the host and how much of that stands in links: the main region is where most of it is, and what lies
outside the region is left out. Inside it headings, paragraphs, lists, quotes and tables are never
template, however many pages have them, and links that follow text are no menu; what is left out there
are small parts whose whole name says what they are, menus before the text, and constant text in bare
containers, unless pages are so alike that most of the region is constant.

Partitions fold their pages into partial wrappers, which are merged per host, salted first, so a
host may hold any share of the pages. Alignment is over siblings told apart by their names and
occurrence, so it takes n log n steps, without recursion; a wrapper's width is bounded.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filewright.llm._shared import small_batches, stash

# Kinds of elements by what they mean for the text.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
NO_TEXT = frozenset("button datalist dialog form head iframe input label noscript object option select svg template textarea title video audio canvas".split())
AROUND = frozenset("aside fieldset footer header menu nav".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|textarea|iframe|svg|title|xmp|math"
NOISE = frozenset(
    "ad ads adbox advert advertisement adverts advertising alert alerts announcement aside author banner bio breadcrumb breadcrumbs byline comment commentlist comments consent cookie cookies copyright disclaimer discussion disqus donate dropdown footer form gdpr header legal login masthead menu message modal nav navbar navigation newsletter notice notification outbrain overlay pager pagination paywall popup privacy promo promoted promotion recommended recommendations related reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription taboola toolbar topbar warning widget widgets".split()
)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Names that make even an article element a reader's comment.
COMMENTS = frozenset("comment commentlist comments replies reply".split())
ARTICLES = frozenset("article content entry main post story".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
NONE: frozenset[str] = frozenset()

TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>"""
    r"|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z][^>]*+\Z|[^<]++|<",
    re.DOTALL | re.IGNORECASE,
)
NAMED = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style|itemprop)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
#: Slots longer than this are compared by their hash, so a wrapper stays small.
KEPT_CHARS = 100
#: Hosts that a partition holds before it passes their partial wrappers on, and salts of a host.
HELD_HOSTS, SALTS = 2000, 32
#: Wrappers are broadcast up to this size; beyond it pages are joined with them.
BROADCAST_BYTES = 8 << 20
#: Different pages of a host that must hold a text before it counts as template.
TEMPLATE_PAGES = 3
#: Siblings in a row that may come again as one group, and different siblings that a wrapper keeps
#: apart; beyond them names no longer count, only tags.
GROUP, WIDTH = 4, 200
#: A region goes on into the element that holds this share of its text; a list or container is a
#: menu when this share of its text stands in links; a name is believed of parts below this share.
INTO, MENU, BELIEVED = 0.6, 0.7, 0.5
#: Pages of which more than this share is constant are near copies, whose constant text says nothing.
ALIKE = 0.7
CONTAINERS = frozenset("details div dl fieldset li menu ol section table tbody td tr ul".split())
TEXTUAL = frozenset("blockquote caption dd dl dt figcaption h1 h2 h3 h4 h5 h6 hgroup legend li ol p pre summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 hgroup".split())
#: Elements that are text whatever their names say, and words that say nothing of what a name is for.
PLAIN = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre figcaption caption".split())
NEUTRAL = frozenset("area bar block bottom box col column container global group inner item items left links list main outer page panel posts primary right row secondary section site top unit wrap wrapper".split())


class Node:
    """An element of one page; ``children`` are texts, elements, and None for a line break."""

    __slots__ = ("children", "dropped", "key", "links", "main", "noise", "part", "tag")

    def __init__(self, tag: str, attributes: str):
        self.tag, self.children, self.links, self.part = tag, [], 0, None
        self.dropped, self.noise, self.main, self.key = tag in NO_TEXT, tag in AROUND, tag in ("article", "main"), tag
        if attributes.strip(" /"):
            self._read(attributes)

    def _read(self, attributes: str) -> None:
        names: list[list[str]] = []  # the words of each class and id
        for name, value in NAMED.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name in ("class", "id"):
                names += [found for x in (value.split() if name == "class" else [value]) if (found := [y for y in re.split(r"[^a-z0-9]+", x) if y])]
                self.key += "." + re.sub("[0-9]+", "0", value)
            elif name == "role":
                self.noise |= value in NOISE_ROLES
                self.main |= value == "main"
            elif name == "itemprop":
                self.main |= value == "articlebody"
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
                self.dropped = True
        if self.tag not in PLAIN and self.tag not in ("main", "body", "html"):
            words = COMMENTS if self.tag == "article" else NOISE
            self.noise |= any(any(y in words for y in x) and all(y in NOISE or y in NEUTRAL or y.isdigit() for y in x) for x in names)
        self.main |= any(y in ARTICLES for x in names for y in x) and self.tag in ("div", "section", "td")
        self.main &= not (self.noise or self.dropped)


def parse(page: str) -> Node:
    """The elements of a page's token stream; inline elements only leave their text, br a line break."""
    root = Node("#root", "")
    stack, link = [root], False
    opened: Counter[str] = Counter()
    for m in TOKEN.finditer(page):
        tag = m[3] or m[6]
        if tag is None:
            if m[1] is None and page[m.start()] != "<":
                stack[-1].children.append(m[0])
                if link:
                    stack[-1].links += len(m[0].strip())
            continue
        tag = tag.lower()
        if tag == "br":
            stack[-1].children.append(None)
            continue
        if tag not in BLOCKS and tag not in NO_TEXT:
            if tag == "a":
                link = not (m[2] or m[5])
            continue
        link = False
        if m[2] or m[5]:
            while opened[tag]:
                opened[stack[-1].tag] -= 1
                if stack.pop().tag == tag:
                    break
            continue
        closes = CLOSES.get(tag, NONE)
        while stack[-1].tag in closes or (tag in BLOCKS and stack[-1].tag == "p"):
            opened[stack.pop().tag] -= 1
        node = Node(tag, m[4] if m[3] else m[7] or "")
        stack[-1].children.append(node)
        if tag not in VOID:
            stack.append(node)
            opened[tag] += 1
    return root


class Part:
    """A part of a wrapper: an element or, with tag ``(``, a group of several in a row.

    text is "" where there is none and None for a slot; support holds the least TEMPLATE_PAGES
    hashes of different pages that have the text; chars and links sum the text of all pages.
    """

    __slots__ = ("chars", "dropped", "key", "kids", "links", "main", "mass", "members", "menu", "noise", "optional", "repeated", "shown", "support", "tag", "template", "text")

    def __init__(self, key: str, tag: str):
        self.key, self.tag, self.kids, self.members = key, tag, [], []
        self.repeated = self.optional = self.dropped = self.noise = self.main = self.template = self.menu = self.shown = False
        self.text, self.support, self.chars, self.links, self.mass = "", [], 0, 0, 0


def _group(kids: list[Part]) -> Part:
    out = Part("(" + " ".join(x.key for x in kids) + ")", "(")
    out.kids = kids
    return out


def _preorder(part, kids) -> list:
    out, stack = [], [part]
    while stack:
        out.append(stack.pop())
        stack += reversed(kids(out[-1]))
    return out


def _elements(node: Node) -> list[Node]:
    return [x for x in node.children if isinstance(x, Node)]


def _kids(part: Part) -> list[Part]:
    return part.kids


def hash_text(text: str) -> str:
    return f"{zlib.crc32(text.encode('utf-8', 'replace')):08x}{len(text)}"


# --- alignment ---


def common(a: list, b: list) -> list[tuple[int, int]]:
    """Places of a longest common subsequence of keys, the n-th of a kind only with the n-th.

    >>> common(["x", "p", "y", "p"], ["p", "x", "p", "y"])
    [(1, 0), (3, 2)]
    """

    def labels(keys: list) -> list[tuple]:
        seen: Counter = Counter()
        out = []
        for key in keys:
            out.append((key, seen[key]))
            seen[key] += 1
        return out

    at = {label: j for j, label in enumerate(labels(b))}
    ends, before, places = [], {}, {}
    for i, label in enumerate(labels(a)):  # the longest rising run of places in b
        j = at.get(label)
        if j is not None:
            n = bisect_left(ends, j)
            places[j], before[j] = i, ends[n - 1] if n else None
            if n == len(ends):
                ends.append(j)
            ends[n] = j
    out, j = [], ends[-1] if ends else None
    while j is not None:
        out.append((places[j], j))
        j = before[j]
    return out[::-1]


def _grouped(kids: list[Part], others: list[Part]) -> list[Part]:
    """``kids`` with runs that the other side has as a group made into that group."""
    have = {x.key for x in kids}
    for group in others:
        if group.tag == "(" and group.key not in have:
            keys, n, out, i = [x.key for x in group.kids], len(group.kids), [], 0
            while i < len(kids):
                if [x.key for x in kids[i : i + n]] == keys:
                    out.append(_group(kids[i : i + n]))
                    i += n
                else:
                    out.append(kids[i])
                    i += 1
            kids = out
    return kids


def _shape(part: Part) -> frozenset[str] | None:
    """The tags right inside a container; elements of text and groups are alike whatever they hold."""
    if part.tag in TEXTUAL or part.tag == "(":
        return None
    return frozenset(tag for x in part.kids for tag in ([k.tag for k in x.kids] if x.tag == "(" else [x.tag]))


def _alike(x: Part, y: Part) -> bool:
    """Whether two neighbours may be one repeated element."""
    if x.key != y.key:
        return False
    one, two = _shape(x), _shape(y)
    return one is None or two is None or 2 * len(one & two) >= len(one | two) > 0


def _matched(a: list[Part], b: list[Part]) -> tuple[list[Part], list[Part], list[tuple[int, int]]]:
    """Both sides, and the places that match: equal shapes first, then equal keys between those."""
    if [x.key for x in a] == [x.key for x in b]:
        return a, b, [(i, i) for i in range(len(a))]
    a, b = _grouped(a, b), _grouped(b, a)
    firm = common([(x.key, _shape(x)) for x in a], [(x.key, _shape(x)) for x in b])
    out, i, j = [], 0, 0
    for m, n in [*firm, (len(a), len(b))]:
        out += [(i + x, j + y) for x, y in common([x.key for x in a[i:m]], [x.key for x in b[j:n]])]
        out.append((m, n))
        i, j = m + 1, n + 1
    return a, b, out[:-1]


Pending = list[tuple[Part, Part, bool]]


#: Which side of an alignment a part without a counterpart is from; EITHER if that says nothing.
ONE, TWO, EITHER = range(3)


def _wide(part: Part) -> str:
    """The key of one of very many siblings; what is noise, dropped or main stays apart from the rest."""
    return f"{part.tag}.*{part.noise:d}{part.dropped:d}{part.main:d}" if ".*" not in part.key else part.key


def _folded(kids: list[Part], fresh: dict[int, int], pending: Pending) -> list[Part]:
    """Neighbours that come again, with a ``fresh`` one among them, as one repeated element or group.

    Several elements are a group only if one page has all of them again.
    """
    for size in range(1, GROUP + 1):
        out, i = [], 0
        while i < len(kids):
            first, end = kids[i : i + size], i + size
            while end + size <= len(kids) and all(map(_alike, first, kids[end : end + size])):
                end += size
            run = kids[i:end]
            sides = {fresh[id(x)] for x in run if id(x) in fresh}
            whole = len(sides) == 1 and EITHER not in sides and not any(x.optional and id(x) not in fresh for x in run)
            if end == i + size or not sides or (size > 1 and not whole):
                out.append(kids[i])
                i += 1
                continue
            pending += [(first[n % size], x, True) for n, x in enumerate(run) if n >= size]
            if size > 1:
                group = _group(first)
                group.optional = all(x.optional for x in run)
                for x in run:
                    x.optional = x.optional and id(x) not in fresh
                first = [group]
            first[0].repeated = True
            fresh[id(first[0])] = sides.pop() if len(sides) == 1 else EITHER
            out.append(first[0])
            i = end
        kids = out
    if len(kids) > WIDTH:  # by their tags and by what their names have said
        named: dict[str, Part] = {}
        for part in kids:
            part.key = _wide(part)
            if part.key in named:
                named[part.key].repeated = True
                pending.append((named[part.key], part, True))
            else:
                named[part.key] = part
        kids = list(named.values())
    return kids


def _run(pending: Pending) -> None:
    while pending:
        x, y, again = pending.pop()
        if x.text == y.text and x.text is not None:
            x.support = x.support if x.support == y.support else sorted({*x.support, *y.support})[:TEMPLATE_PAGES]
        else:
            x.text, x.support = None, []
        x.chars, x.links, x.repeated = x.chars + y.chars, x.links + y.links, x.repeated or y.repeated
        x.optional = (x.optional and y.optional) if again else (x.optional or y.optional)
        x.members += y.members
        if not x.kids and not y.kids:
            continue
        a, b, pairs = _matched(x.kids, y.kids)
        out, fresh, i, j = [], {}, 0, 0
        for m, n in [*pairs, (len(a), len(b))]:
            for side, some in ((ONE, a[i:m]), (TWO, b[j:n])):
                for part in some:
                    fresh[id(part)] = EITHER if part.optional else side
                    part.optional = True
                out += some
            if m < len(a):
                pending.append((a[m], b[n], False))
                out.append(a[m])
            i, j = m + 1, n + 1
        x.kids = _folded(out, fresh, pending) if fresh else out


def merge(one: Part, two: Part) -> Part:
    """Align ``two`` into ``one``, whose keys are equal: a wrapper of what both match.

    What has no counterpart becomes optional, or, next to its like, one more of a repeated group.
    """
    _run([(one, two, False)])
    return one


def infer(root: Node, page: str | None = None) -> Part:
    """The wrapper of one page; ``page`` stands for it in the support, by default a hash of its texts.

    Copies of a page so count as one.
    """
    nodes = _preorder(root, _elements)
    texts = [" ".join(" ".join(x for x in node.children if isinstance(x, str)).split()) for node in nodes]
    if page is None:
        page = hash_text("\n".join(texts))
    made: dict[int, Part] = {}
    for node, text in zip(reversed(nodes), reversed(texts), strict=True):
        part = made[id(node)] = Part(node.key, node.tag)
        part.dropped, part.noise, part.main = node.dropped, node.noise, node.main
        part.text = text if len(text) <= KEPT_CHARS else f"#{hash_text(text)}"
        part.support, part.chars, part.links, part.members = [page], len(text), min(node.links, len(text)), [node]
        kids = [made.pop(id(x)) for x in _elements(node)]
        if len(kids) > WIDTH:
            pending: Pending = []
            kids = _folded(kids, dict.fromkeys(map(id, kids), ONE), pending)
            _run(pending)
        part.kids = kids
    return made[id(root)]


_FLAGS = ("repeated", "optional", "dropped", "noise", "main")


def dumps(root: Part) -> str:
    """A wrapper as text: its parts in order, each with the number of its children."""
    return json.dumps([[x.key, x.tag, len(x.kids), sum(getattr(x, f) << n for n, f in enumerate(_FLAGS)), x.text, x.chars, x.links, x.support] for x in _preorder(root, _kids)], ensure_ascii=False)


def loads(made: str) -> Part:
    root, waiting = None, []
    for key, tag, kids, flags, text, chars, links, support in json.loads(made):
        part = Part(key, tag)
        for n, flag in enumerate(_FLAGS):
            setattr(part, flag, bool(flags >> n & 1))
        part.text, part.chars, part.links, part.support = text, chars, links, support
        if waiting:
            waiting[-1][0].kids.append(part)
            waiting[-1][1] -= 1
            while waiting and not waiting[-1][1]:
                waiting.pop()
        else:
            root = part
        if kids:
            waiting.append([part, kids])
    return root


# --- what a wrapper says ---


def weigh(root: Part) -> Part:
    """Set template, mass (text that is neither template nor in links) and what is left out.

    An element is dropped when it is no text by its tag, when it is a list or container whose text
    stands in links, or when its name says so and it holds less than half of all text.
    """
    order = _preorder(root, _kids)
    chars: dict[int, int] = {}
    links: dict[int, int] = {}

    def up() -> None:
        for x in reversed(order):
            own = 0 if x.template else x.chars
            chars[id(x)] = own + sum(chars[id(k)] for k in x.kids)
            links[id(x)] = min(own, x.links) + sum(links[id(k)] for k in x.kids)

    constant = [x for x in order if x.text and len(x.support) >= TEMPLATE_PAGES]
    if sum(x.chars for x in constant) <= ALIKE * sum(x.chars for x in order):
        for x in constant:
            x.template = True
    up()
    whole = chars[id(root)]
    for x in order[1:]:
        x.dropped |= x.noise and chars[id(x)] <= BELIEVED * whole
        x.menu = not x.dropped and x.tag in CONTAINERS and 0 < chars[id(x)] <= BELIEVED * whole and links[id(x)] >= MENU * chars[id(x)]
        x.dropped |= x.menu
    for x in reversed(order):
        own = 0 if x.template else max(0, x.chars - x.links)
        x.mass = 0 if x.dropped else own + sum(k.mass for k in x.kids)
    return root


def region(root: Part) -> Part:
    """The part with the main text: from the root on into whatever holds most of the mass.

    Of the elements on that way that hold half of it, one that is named as an article is taken; else
    the last, or an element around it that also holds a heading of the page.
    """
    way = [root]
    while True:
        best = max((x for x in way[-1].kids if not x.dropped), key=lambda x: x.mass, default=None)
        if best is None or best.repeated or best.tag == "(" or best.tag in TEXTUAL or not best.mass or best.mass < INTO * way[-1].mass:
            break
        way.append(best)
    for tags in (("article",), None):
        named = [x for x in way if x.main and (tags is None or x.tag in tags) and x.mass >= 0.5 * root.mass]
        if named:
            return named[-1]
    while len(way) > 1 and way[-1].tag not in ("body", "#root") and any(x.tag in HEADINGS and x.mass for x in way[-2].kids):
        way.pop()
    return way[-1]


def trace(root: Part, own: Part) -> None:
    """Tell every element of a page its part of the host's wrapper, by the alignment that made it."""
    stack = [(root, own)]
    while stack:
        x, y = stack.pop()
        for node in y.members:
            node.part = x
        if not y.kids:
            continue
        a, b, pairs = _matched(x.kids, y.kids)
        of = {n: a[m] for m, n in pairs}
        again = {k.key: k for k in a if k.repeated}
        near = None
        for n, kid in enumerate(b):  # one more of a repeated part: of the one before it, or of any
            found = of.get(n) or (near if near is not None and near.repeated and near.key == kid.key else again.get(kid.key) or again.get(_wide(kid)))
            if found is not None:
                stack.append((found, kid))
                near = found


def _left_out(node: Node) -> bool:
    return node.dropped or bool(node.part and node.part.dropped)


def _text_of(tops: list[Node]) -> str:
    """The text of elements, a line for each block; the cells of a row share one."""
    blocks: list[list[str]] = [[]]

    def edge(cell: bool) -> None:
        if cell:
            blocks[-1].append(" ")
        else:
            blocks.append([])

    for top in tops:
        blocks.append([])
        stack = [[top, 0, False]]
        while stack:
            node, n, cell = stack[-1]
            if n == len(node.children):
                stack.pop()
                edge(cell)
                continue
            stack[-1][1] += 1
            child = node.children[n]
            if child is None:
                edge(cell)
            elif isinstance(child, str):
                if not (node.part and node.part.template and not node.part.shown):
                    blocks[-1].append(child)
            else:
                inner = cell or child.tag in ("td", "th")
                edge(inner)
                if not _left_out(child):
                    stack.append([child, 0, inner])
    lines = (" ".join(unescape("".join(b)).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def reveal(chosen: Part) -> None:
    """Show what is article inside a region: elements of text though they are constant, and links after text."""
    stack, begun, constant, whole = [chosen], False, [], 0
    while stack:
        x = stack.pop()
        if x.menu and begun:
            x.menu = x.dropped = False
        if x.dropped:
            continue
        whole += x.chars
        x.shown = x.tag in TEXTUAL
        if x.template and not x.shown:
            constant.append(x)
        begun |= x.chars > x.links
        stack += reversed(x.kids)
    if sum(x.chars for x in constant) > BELIEVED * whole:
        for x in constant:
            x.shown = True


@lru_cache(maxsize=256)
def prepared(made: str) -> tuple[Part, Part]:
    """A host's wrapper, weighed, and its main region."""
    root = weigh(loads(made))
    chosen = region(root)
    reveal(chosen)
    return root, chosen


def main_text(page: str, made: str | None) -> str:
    """The main text of one page by its host's wrapper; without one, all of its text."""
    tree = parse(page)
    if made is None:
        return _text_of([tree])
    root, chosen = prepared(made)
    own = infer(tree, "")
    trace(root, own)
    order = _preorder(own, _kids)
    for x in order:
        of = x.members[0].part if x.members else None
        x.template, x.support = bool(of and of.template), []
        x.dropped |= bool(of and of.dropped)
    weigh(own)
    for x in order:  # what the host's wrapper does not know is judged by the page alone
        for node in x.members:
            node.part = node.part or x
    inside = [x for x in order if x.members and x.members[0].part is chosen]
    # a page without the region of its host, or with its text elsewhere, is read by its own masses
    if sum(x.mass for x in inside) < 0.3 * own.mass:
        inside = [region(own)]
        for node in (node for x in _preorder(inside[0], _kids) for node in x.members):
            if node.part is not None and node.part.tag in TEXTUAL and not node.part.dropped:
                node.part = None  # nothing that the host says of its template holds for this page's text
    tops = [node for x in inside for node in x.members] if inside and inside[0].tag != "(" else [tree]
    return _text_of(tops)


# --- the operator ---


def _host():
    return F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def wrapper(pages: list[str]) -> str:
    """The wrapper of some pages of a host, as text."""
    made = None
    for page in pages:
        own = infer(parse(page))
        made = own if made is None else merge(made, own)
    return dumps(made)


def wrappers(pages: DataFrame) -> DataFrame:
    """``(host, made)``: the wrapper of all pages of every host, as text."""

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, Part] = {}

        def passed_on() -> pd.DataFrame:
            out = pd.DataFrame({"host": list(held), "made": [dumps(x) for x in held.values()]}, dtype=object)
            held.clear()
            return out

        for frame in frames:
            for host, page in zip(frame.host, frame.html, strict=True):
                own = infer(parse(page or ""))
                for part in _preorder(own, _kids):
                    part.members = []
                held[host] = merge(held[host], own) if host in held else own
            if len(held) >= HELD_HOSTS:
                yield passed_on()
        if held:
            yield passed_on()

    def together(frame: pd.DataFrame) -> pd.DataFrame:
        made = None
        for part in sorted(frame.made):
            made = loads(part) if made is None else merge(made, loads(part))
        return pd.DataFrame({"host": [frame.host.iloc[0]], "made": [dumps(made)]}, dtype=object)

    parts = stash(pages.select("host", "html").mapInPandas(fold, "host string, made string"), "html-wrappers")
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("made"), F.lit(SALTS))).groupBy("host", "salt").applyInPandas(together, "host string, made string")
    return salted.groupBy("host").applyInPandas(together, "host string, made string")


def extract(pages: DataFrame) -> DataFrame:
    """``pages(url, html, ...)`` with text: the main text of every whole ``html``; empty if there is none.

    A null html is empty; a null url or one without a host shares the wrapper of its kind; repeated
    rows stay; an empty table gives no rows. Other columns are kept whatever their names; one named
    text is replaced.
    """
    spark = pages.sparkSession
    small_batches(spark)
    others = [F.col(f"`{c}`") for c in pages.columns if c != "text"]
    own = pages.select(F.struct(*others).alias("row"), F.col("html").alias("html"), _host().alias("host"))
    made = stash(wrappers(own.select("host", "html")), "html-hosts")
    size = made.agg(F.sum(F.octet_length("made"))).first()[0] or 0
    kept = [F.col(f"row.`{c}`") for c in pages.columns if c != "text"]

    if size <= BROADCAST_BYTES:
        known = spark.sparkContext.broadcast({r.host: r.made for r in made.collect()})

        @F.pandas_udf("string")
        def text_of(hosts: pd.Series, html: pd.Series) -> pd.Series:
            return pd.Series([main_text(page or "", known.value.get(host)) for host, page in zip(hosts, html, strict=True)], dtype=object)

        return own.select(*kept, text_of("host", "html").alias("text"))

    @F.pandas_udf("string")
    def text_with(made: pd.Series, html: pd.Series) -> pd.Series:
        return pd.Series([main_text(page or "", wrapper) for wrapper, page in zip(made, html, strict=True)], dtype=object)

    return own.join(made, "host", "left").select(*kept, text_with("made", "html").alias("text"))
