"""HTML extraction: the text blocks of a page, labelled content or boilerplate by a minimum cut.

A page becomes a row of blocks, the runs of text between block-level tags. A linear classifier over a block's
elements, their class and id word by word, its length and its links gives the cost of either label (a form or a
named element that wraps the whole page does not count); these costs
are the capacities from the source and to the sink. Neighbouring blocks, and consecutive blocks of one parent, are
joined by smoothness edges that weigh less the farther apart they are in the element tree. The maximum flow
separates content from boilerplate at the least total cost.

The given tables have no labelled blocks, so the classifier's weights are parameters, stated below.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .rows import added

#: Elements whose content is no text.
SKIPPED = frozenset("script style noscript template head title textarea select svg math iframe object video audio canvas".split())
#: Of these, the ones that hold no markup: only their own end tag ends them.
RAW = frozenset("script style title textarea iframe noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br button cite code data del dfn em font i img input ins kbd label mark meter output "
    "progress q s samp small span strike strong sub sup time tt u var wbr".split()
)
#: What an opening tag closes, if it is open and no list or table has begun since.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table select article section div body".split())
BOILERPLATE_TAGS = frozenset("nav header footer aside form menu dialog button fieldset".split())
#: Of these, the ones that can also wrap a whole page.
WRAPPER_TAGS = frozenset("form fieldset".split())
CONTENT_TAGS = frozenset("article main".split())
#: A name (of a class, id or role) is that of boilerplate if its last word is one of these, words that name no thing left out,
NOUNS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising banner sponsor sponsors sponsored promo promos promotion promotions cookie "
    "cookies consent gdpr notice notices alert alerts popup modal newsletter newsletters subscribe subscription signup login share sharing social "
    "related recommended recommendations sidebar sidebars widget widgets menu menus nav navs navbar navigation breadcrumb breadcrumbs masthead "
    "topbar footer copyright comment comments respond reply replies disqus pagination pager skip contentinfo complementary".split()
)
#: or if its first word is one of these;
ADJECTIVES = frozenset(
    "related recommended recommendation sponsored cookie cookies gdpr newsletter social sidebar comment comments disqus breadcrumb breadcrumbs advert "
    "advertisement footer site-header page-header".split()
)
NO_THINGS = frozenset(
    "wrap wrapper container inner outer box bar list lists area section block group items item link links button buttons slot unit panel top bottom left right "
    "main primary secondary mobile desktop fixed sticky small large open closed to content form text icon icons".split()
)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
CONTENT_WORDS = re.compile(r"(?:^|[\s_-])(?:(?:main-?)?content|article(?:-?body)?|post(?:-?body)?|entry|story|main|prose)(?=$|[\s_-])", re.IGNORECASE)

WEIGHTS = {"bias": -1.5, "words": 0.12, "links": -3.0, "sentence": 0.7, "boilerplate": -9.0, "content": 4.5, "outside": -2.5, "nowhere": 1.0, "heading": 0.3}
MOST_WORDS = 40  # beyond these, length says no more
SMOOTHNESS = 1.0
UNIT = 1000  # capacities are whole numbers

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""",
    re.DOTALL,
)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)


@lru_cache(maxsize=1 << 14)
def names_boilerplate(name: str) -> bool:
    """Whether a single class, id or role names boilerplate: ``cookie-notice`` and ``shareButtons`` do, ``navy-blue``,
    ``share-price`` and ``notice-board`` do not."""
    words = [word.lower() for word in _WORD.findall(name)]
    if "side" in words and words[-1] == "bar":
        return True
    if not words or words[0] in ("has", "with", "no"):  # of the layout
        return False
    if words[0] in ADJECTIVES or "-".join(words[:2]) in ADJECTIVES:
        return True
    while len(words) > 1 and words[-1] in NO_THINGS:
        words.pop()
    return words[-1] in NOUNS


class Element:
    __slots__ = ("tag", "parent", "depth", "boilerplate", "mark", "wrapper", "content", "article", "main", "link")

    def __init__(self, tag: str, attributes: str, parent: Element | None):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        named = ""
        if attributes and tag not in ("html", "body"):
            named = " ".join(a or b or c for a, b, c in _NAMED.findall(attributes))
        own = tag in BOILERPLATE_TAGS and tag not in WRAPPER_TAGS
        mark = tag in WRAPPER_TAGS
        if named and not own and not mark:
            mark = any(map(names_boilerplate, named.split()))
        self.boilerplate = own or (parent is not None and parent.boilerplate)
        self.mark = self if mark else parent.mark if parent else None  # the nearest form or element with such a name
        self.wrapper = False  # whether it turned out to hold the page
        self.article = self if tag in CONTENT_TAGS else parent.article if parent else None
        self.main = self if tag == "main" else parent.main if parent else None
        self.content = tag in CONTENT_TAGS or (named and CONTENT_WORDS.search(named) is not None) or (parent is not None and parent.content)
        self.link = tag == "a" or (parent is not None and parent.link)


class Block:
    __slots__ = ("text", "words", "links", "element")

    def __init__(self, text: str, words: int, links: float, element: Element):
        self.text, self.words, self.links, self.element = text, words, links, element


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order, without empty ones."""
    out: list[Block] = []
    parts: list[str] = []
    linked = 0
    top = Element("#", "", None)
    holder = top  # the block-level element that the text gathered so far stands in
    open_ = top
    at, n = 0, len(page)

    def text(piece: str) -> None:
        nonlocal linked
        parts.append(piece)
        if open_.link:
            linked += len(piece)

    def flush() -> None:
        nonlocal linked
        if parts:
            whole = "".join(parts)
            found = (html.unescape(whole) if "&" in whole else whole).split()
            if found:
                out.append(Block(" ".join(found), len(found), min(1.0, linked / len(whole)), holder))
            parts.clear()
        linked = 0

    def block_level() -> Element:
        element = open_
        while element.parent is not None and element.tag in INLINE:
            element = element.parent
        return element

    match = _TOKEN.search(page)
    while match:
        start, end = match.span()
        if start > at:
            text(page[at:start])
        at = end
        tag = match[2]
        if tag is None:
            if match[0].startswith("<![CDATA["):
                text(html.escape(match[0][9:].removesuffix("]]>")))
            match = _TOKEN.search(page, at)
            continue
        tag = tag.lower()
        if match[1]:
            if tag not in VOID:
                element = open_
                while element.parent is not None and element.tag != tag:
                    if tag in INLINE and element.tag not in INLINE:
                        element = top
                        break
                    element = element.parent
                if element.parent is not None:
                    if tag not in INLINE:
                        flush()
                    open_ = element.parent
                    holder = block_level()
        elif tag in SKIPPED:
            if tag not in INLINE:
                flush()
            if not match[3].endswith("/") or tag in RAW:
                # Only raw elements may hold anything; the others are passed over with what they nest.
                depth, close = 1, re.compile(rf"<(/?){tag}(?=[\s/>])[^>]*>", re.IGNORECASE)
                while depth and (found := close.search(page, at)):
                    at = found.end()
                    depth += -1 if found[1] else tag not in RAW
                if depth:
                    at = at if tag == "head" else n
        elif tag in VOID:
            if tag == "br":
                text(" ")
            elif tag == "hr":
                flush()
        else:
            if tag not in INLINE:
                flush()
                closed = CLOSES.get(tag, set()) | {"p"}
                element = open_
                while element.parent is not None and element.tag not in SCOPES:
                    if element.tag in closed:
                        open_ = element.parent
                    element = element.parent
            if tag == "a" and open_.link:  # links do not nest
                element = open_
                while element.parent is not None and element.tag != "a" and element.tag in INLINE:
                    element = element.parent
                if element.tag == "a":
                    open_ = element.parent
            open_ = Element(tag, match[3], open_)
            if tag not in INLINE:
                holder = open_
        match = _TOKEN.search(page, at)
    if at < n:
        text(page[at:])
    flush()
    return out


def _marked(element: Element, alone: bool) -> bool:
    """Whether an element is boilerplate, by itself or by what it stands in. A main element inside a form or an element
    with a listed name is not, nor is an article if it is ``alone``: if the page has no content elsewhere."""
    mark = element.mark
    while mark is not None and mark.wrapper:
        mark = mark.parent.mark
    if element.boilerplate or mark is None:
        return element.boilerplate
    inside = element.article if alone else element.main
    return inside is None or inside.depth <= mark.depth


def _boilerplate(found: list[Block]) -> list[bool]:
    """Whether each block stands in boilerplate.

    A form or an element with a listed name that holds most of the page's words outside links is no boilerplate, but the
    wrapper of the page, if it holds more than a few words and no more than a few words of content stand outside all such elements. One that stands in
    content, as the comments in an article do, never is.
    """
    words = [block.words * (1 - block.links) for block in found]
    held: dict[Element, float] = {}
    for block, n in zip(found, words, strict=True):
        mark = block.element.mark
        while mark is not None and not block.element.boilerplate:
            held[mark] = held.get(mark, 0) + n
            mark = mark.parent.mark

    content = [(block.element, n) for block, n in zip(found, words, strict=True) if block.element.content]

    def little() -> bool:
        return sum(n for element, n in content if not _marked(element, False)) < MOST_WORDS

    around = (m for m, n in held.items() if n >= MOST_WORDS and 2 * n > sum(words) and not m.parent.content)
    for mark in sorted(around, key=lambda m: m.depth):
        if not little():
            break
        mark.wrapper = True
    alone = little()
    return [_marked(block.element, alone) for block in found]


def _score(block: Block, boilerplate: bool, has_content: bool) -> float:
    """Log odds that a block is content."""
    element, w = block.element, WEIGHTS
    z = w["bias"] + w["words"] * min(block.words, MOST_WORDS) + w["links"] * block.links
    if block.text[-1] in ".!?…:;\"'”»)":
        z += w["sentence"]
    if boilerplate:
        z += w["boilerplate"]
    if element.content:
        z += w["content"]
    else:
        z += w["outside" if has_content else "nowhere"]
    if element.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
        z += w["heading"]
    return z


def _distance(a: Element, b: Element) -> int:
    """Steps between two elements in the tree."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def min_cut(source: list[int], sink: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes are on the source's side of a minimum cut; of several, the one with the fewest nodes there.

    ``source[i]`` and ``sink[i]`` are capacities of node i's terminal edges, ``edges`` are (i, j, capacity) either way.
    Flow goes straight through each node first, then along shortest paths from nodes with capacity left from the source to
    nodes with capacity left to the sink.
    """
    left = [a - b for a, b in zip(source, sink, strict=True)]
    near: list[dict[int, int]] = [{} for _ in left]
    for i, j, capacity in edges:
        near[i][j] = near[i].get(j, 0) + capacity
        near[j][i] = near[j].get(i, 0) + capacity
    for start, excess in enumerate(left):
        while excess > 0:
            came = {start: -1}
            queue, found = deque([start]), -1
            while queue and found < 0:
                i = queue.popleft()
                for j, capacity in near[i].items():
                    if capacity > 0 and j not in came:
                        came[j] = i
                        if left[j] < 0:
                            found = j
                            break
                        queue.append(j)
            if found < 0:
                break
            flow, j = min(excess, -left[found]), found
            while came[j] >= 0:
                flow, j = min(flow, near[came[j]][j]), came[j]
            j = found
            while came[j] >= 0:
                i = came[j]
                near[i][j] -= flow
                near[j][i] += flow
                j = i
            left[found] += flow
            excess -= flow
        left[start] = excess
    side = [x > 0 for x in left]
    queue = deque(i for i, own in enumerate(side) if own)
    while queue:
        i = queue.popleft()
        for j, capacity in near[i].items():
            if capacity > 0 and not side[j]:
                side[j] = True
                queue.append(j)
    return side


def main_text(page: str) -> str:
    """The content blocks of a page, a line each."""
    found = blocks(page)
    if not found:
        return ""
    boilerplate = _boilerplate(found)
    has_content = any(b.element.content and not own for b, own in zip(found, boilerplate, strict=True))
    source, sink, edges = [], [], []
    last: dict[int, int] = {}
    for i, block in enumerate(found):
        z = _score(block, boilerplate[i], has_content)
        # The costs of the wrong labels under the logistic model.
        source.append(round(UNIT * math.log1p(math.exp(z))))
        sink.append(round(UNIT * math.log1p(math.exp(-z))))
        if i:
            edges.append((i - 1, i, round(UNIT * SMOOTHNESS / (1 + _distance(found[i - 1].element, block.element)))))
        parent = id(block.element.parent)
        if last.get(parent, i) < i - 1:
            edges.append((last[parent], i, round(UNIT * SMOOTHNESS / 3)))
        last[parent] = i
    side = min_cut(source, sink, edges)
    # What is left of a page without its boilerplate is its main text, however short: without links, if there is such text.
    for most in (0.5, 1.0):
        if not any(side):
            side = [not own and block.links <= most for block, own in zip(found, boilerplate, strict=True)]
    return "\n".join(b.text for b, content in zip(found, side, strict=True) if content)


def extract(pages: DataFrame, page: str = "html", text: str = "text") -> DataFrame:
    """``pages`` with the main text of the whole page. Null and empty pages, and pages without content, give an empty
    text. Rows stay, repeated ones too; a column already named like the new one is replaced."""
    return added(pages, page, {text: (T.StringType(), pa.string())}, lambda values: [(main_text(v or ""),) for v in values])
