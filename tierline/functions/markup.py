"""HTML as a table: pages are cut into tags and text, and folded with a stack of open elements.

``elements`` gives the elements of a page that a selector names, in the order in which they open, so that links,
label pairs and lists are column expressions or joins on what it returns. Loose markup has these results:

* comments, and the contents of script and style, hold no elements and no text;
* attribute values may have any quotes or none; the first of two like-named attributes counts;
* an element without an end tag ends with its parent, and where HTML implies it: a link at the next link, a list item
  at the next item of the same list, p at the next block;
* an end tag that nothing opened is skipped; one of a formatting element (a, b, i ...) closes only that element;
* a tag or comment that the text's end cuts off is dropped; a null page has no elements.

The fold is one pass over the text, and every element is opened and closed once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values ---------------------------------------------------------
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
FORMATTING = set("a b big code em font i nobr s small strike strong tt u".split())
BLOCKS = set(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol"
    " p pre section table ul".split()
)
#: Elements that a start tag closes, and the elements beyond which it does not look for them.
IMPLIED = {
    "a": ({"a"}, {"td", "th", "caption"}),
    "li": ({"li"}, {"ul", "ol", "menu", "td", "th"}),
    "dt": ({"dt", "dd"}, {"dl", "td", "th"}),
    "dd": ({"dt", "dd"}, {"dl", "td", "th"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
    **{name: ({"p"}, {"td", "th", "caption", "button"}) for name in BLOCKS},
}
#: An end tag does not reach out of these, unless it ends one of them or what holds them.
CELLS = {"td", "th", "caption"}
TABLE_PARTS = {"table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption", "body", "html"}
# ---------------------------------------------------------------------------

#: Selects the page itself.
PAGE = ":page"
#: Elements, or characters of their texts, that a worker holds before it hands them on (one page at least).
HELD_ELEMENTS, HELD_CHARS = 10_000, 4_000_000
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)")
_ATTRIBUTE = re.compile(r"""[\s/]*+(?:(>)|([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|(?!["'>])([^\s>]++)))?)""")
_NAMED = re.compile(r"&#?[0-9A-Za-z]+;")
_RAW = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in ("script", "style", "textarea", "title")}
_FIELDS = "at int, last int, parent int, `group` int, up_class string, inner boolean, name string, class string, id string, href string, text string"
_TYPE = pa.list_(
    pa.struct(
        [(f, pa.int32()) for f in ("at", "last", "parent", "group")]
        + [("up_class", pa.string()), ("inner", pa.bool_())]
        + [(f, pa.string()) for f in ("name", "class", "id", "href", "text")]
    )
)


def tokens(page: str) -> Iterator[tuple[str, str, dict[str, str] | None]]:
    """("open", name, attributes), ("close", name, None) and ("text", text, None) in page order."""
    at, size = 0, len(page)
    while at < size:
        lt = page.find("<", at)
        if lt != at:
            yield "text", unescape(page[at : lt if lt >= 0 else size]), None
            if lt < 0:
                return
        tag = _TAG.match(page, lt)
        if not tag:
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 2)
                at = end + 3
            elif page[lt + 1 : lt + 2] in ("!", "?", "/") and page[lt + 1 : lt + 2]:
                end = page.find(">", lt)
                at = end + 1
            else:
                yield "text", "<", None
                end, at = 0, lt + 1
            if end < 0:
                return
            continue
        name, attributes, at = tag[2].lower(), {}, tag.end()
        while (part := _ATTRIBUTE.match(page, at)) and not part[1]:
            value = next((v for v in part.groups()[2:] if v is not None), "")
            attributes.setdefault(part[2].lower(), _NAMED.sub(lambda m: unescape(m[0]), value))
            at = part.end()
        if not part:
            return
        at = part.end()
        if tag[1]:
            yield "close", name, None
            continue
        yield "open", name, attributes
        if name in _RAW:
            end = _RAW[name].search(page, at)
            stop = end.start() if end else size
            if name in ("textarea", "title"):
                yield "text", unescape(page[at:stop]), None
            at = stop


class Element:
    __slots__ = ("at", "last", "parent", "group", "up", "name", "attributes", "start", "stop", "inner", "taken", "open")

    def __init__(self, at: int, parent: int | None, name: str, attributes: dict[str, str], start: int):
        self.at, self.parent, self.name, self.attributes, self.start = at, parent, name, attributes, start
        self.last = self.stop = self.group = self.up = None
        self.inner, self.taken, self.open = False, False, True

    def fits(self, selectors: frozenset[str]) -> bool:
        return self.name in selectors or any(f".{c}" in selectors for c in self.attributes.get("class", "").split())


def fold(page: str, wanted: frozenset[str], groups: frozenset[str]) -> Iterator[dict]:
    """The wanted elements of a page, see :func:`elements`."""
    stack: list[Element] = []  # may hold closed formatting elements below others
    by_name: dict[str, list[Element]] = {}  # open elements of each name, innermost last
    taken_stack: list[Element] = []  # open wanted elements
    group_stack: list[Element] = []
    around: Counter[str] = Counter()  # open wanted elements by name
    taken: list[Element] = []
    pieces: list[str] = []
    count = length = 0

    def innermost(names: Iterable[str]) -> Element | None:
        tops = [by_name[n][-1] for n in names if by_name.get(n)]
        return max(tops, key=lambda e: e.at, default=None)

    def end(e: Element) -> None:
        e.open, e.stop, e.last = False, length, count - 1
        # the innermost open element of its name, so its list's last
        by_name[e.name].pop()
        around[e.name] -= e.taken
        for held in (taken_stack, group_stack):
            while held and not held[-1].open:
                held.pop()

    def close(e: Element) -> None:
        """End an element, and with it what is open inside, unless it is a formatting element."""
        if e.name in FORMATTING:
            end(e)
        else:
            while stack[-1] is not e:
                if stack[-1].open:
                    end(stack[-1])
                stack.pop()
            end(e)
        while stack and not stack[-1].open:
            stack.pop()

    for kind, value, attributes in tokens(page):
        if kind == "text":
            pieces.append(value)
            length += len(value)
        elif kind == "open":
            closes, barrier = IMPLIED.get(value, ((), ()))
            while closes and (e := innermost(closes)):
                wall = innermost(barrier)
                if wall and wall.at > e.at:
                    break
                close(e)
            e = Element(count, stack[-1].at if stack else None, value, attributes, length)
            count += 1
            e.group, e.up = (group_stack[-1].at if group_stack else None), (taken_stack[-1] if taken_stack else None)
            if e.fits(wanted):
                e.taken, e.inner = True, around[value] > 0
                taken.append(e)
            if value in VOID:
                e.last, e.stop, e.open = e.at, length, False
                continue
            stack.append(e)
            by_name.setdefault(value, []).append(e)
            if e.taken:
                taken_stack.append(e)
                around[value] += 1
            if e.fits(groups):
                group_stack.append(e)
        elif by_name.get(value):
            e = by_name[value][-1]
            wall = None if value in TABLE_PARTS else innermost(CELLS)
            if not wall or wall.at < e.at:
                close(e)
    text = "".join(pieces)
    if PAGE in wanted:
        root = Element(-1, None, PAGE, {}, 0)
        taken.insert(0, root)
    for e in taken:
        a = e.attributes
        yield {
            "at": e.at,
            "last": count - 1 if e.last is None else e.last,
            "parent": e.parent,
            "group": e.group,
            "up_class": e.up.attributes.get("class") if e.up else None,
            "inner": e.inner,
            "name": e.name,
            "class": a.get("class"),
            "id": a.get("id"),
            "href": a.get("href"),
            "text": text[e.start : length if e.stop is None else e.stop],
        }


def folded(batches: Iterable[pa.Array], wanted: frozenset[str], groups: frozenset[str]) -> Iterator[pa.Array]:
    """The elements of all pages in order, in batches of their own: a few pages' elements are held, however many pages
    come at once."""
    for html in batches:
        held, count, chars = [], 0, 0
        for p in html:
            found = list(fold(p.as_py(), wanted, groups)) if p.is_valid else None
            held.append(found)
            count += 1 + len(found or ())
            chars += sum(len(e["text"]) for e in found or ())
            if count >= HELD_ELEMENTS or chars >= HELD_CHARS:
                yield pa.array(held, _TYPE)
                held, count, chars = [], 0, 0
        if held:
            yield pa.array(held, _TYPE)


def elements(html: Column, wanted: Iterable[str], groups: Iterable[str] = ()) -> Column:
    """array<struct> of the elements that ``wanted`` names (``a``, ``.title``), in page order.

    ``at`` numbers all elements of the page as they open; those inside an
    element have numbers up to its ``last``, and the next sibling of an
    element, if any, has the number after it. ``parent`` is the element around
    it, ``group`` the innermost one around it that ``groups`` names,
    ``up_class`` the class of the innermost wanted one around it, and ``inner``
    tells that a wanted one of its own name is around it. ``text`` is all text
    inside, entities decoded, blanks as they stand; a wanted element inside
    another repeats its part of the text, so ask for outer ones sparingly.
    ``PAGE`` stands for the whole page, before all others.
    """
    chosen, grouped = frozenset(wanted), frozenset(groups)

    def pages(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return folded(batches, chosen, grouped)

    # one pass per page, however many expressions read the result
    return F.arrow_udf(pages, f"array<struct<{', '.join(f.replace(' ', ': ', 1) for f in _FIELDS.split(', '))}>>")(html)


def has_class(element: Column, name: str) -> Column:
    return F.array_contains(F.split(F.coalesce(element["class"], F.lit("")), r"\s+"), name)
