"""A small, forgiving HTML parser: block elements and runs of text as one tree.

Inline elements are part of the text around them; a run of text ends where a
block element begins or ends. Elements whose inside HTML does not read as markup, or
does not show, and comments are left out. A block's start closes an open paragraph,
an item closes an open item of its kind, an end tag without a start is ignored, and
what is still open at the end of the page is closed there. Open elements are found by
their names, so the work is in proportion to the page, however deep it is nested.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

#: Elements by their part in a page.
RAW = frozenset("script style title textarea iframe noembed noframes".split())
#: Left out as well, if their end is found.
UNSEEN = frozenset("template select datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr output q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr picture source map area object param canvas audio video svg g text tspan math mi mo mn ms mtext mrow mfrac msup msub msubsup msqrt mroot mover munder munderover mtable mtr mtd mstyle semantics annotation".split()
)
CLOSES = {
    "li": ("li",),
    "dt": ("dt", "dd"),
    "dd": ("dt", "dd"),
    "tr": ("tr", "td", "th"),
    "td": ("td", "th"),
    "th": ("td", "th"),
    "option": ("option",),
    "thead": ("tr", "td", "th", "tbody"),
    "tbody": ("tr", "td", "th", "thead"),
    "tfoot": ("tr", "td", "th", "tbody"),
}
SCOPES = frozenset("ul ol dl table div section article nav".split())

_markup = re.compile(r"""<(?:!--(?:.*?--!?>|.*\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:"[^"]*+"|'[^']*+'|[^'">])*+)>|(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|[!?/][^>]*+(?:>|\Z)|/?[a-zA-Z][^>]*+\Z)""", re.S)
_named = re.compile(r"""(?:^|\s)(?:class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_hidden = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)


@dataclass(slots=True)
class Node:
    parent: int
    tag: str  # "" for a run of text
    names: str = ""  # of an element: its class, id and role
    text: str = ""  # of a run: decoded, white space collapsed
    linked: int = 0  # of a run: characters inside links
    at: int = 0  # where it begins in the page
    hidden: bool = False


def parse(page: str) -> list[Node]:
    """The nodes in page order, a parent before its children; the first is the page."""
    nodes = [Node(-1, "#page")]
    stack = [0]
    places: dict[str, list[int]] = {"#page": [0]}  # by name: where in the stack such elements are open
    endless: set[str] = set()  # names without an end tag in the rest of the page
    run: list[str] = []
    run_at, linked, in_link, place, end = 0, 0, 0, 0, len(page)

    def close_run() -> None:
        nonlocal run, linked
        if run:
            text = " ".join("".join(run).split())
            if text:
                nodes.append(Node(stack[-1], "", text=text, linked=linked, at=run_at))
            run, linked = [], 0

    def last(tag: str) -> int:
        found = places.get(tag)
        return found[-1] if found else -1

    def cut(d: int) -> None:
        """Closes what is open from place d of the stack on."""
        while len(stack) > d:
            places[nodes[stack.pop()].tag].pop()

    def add(text: str, at: int) -> None:
        nonlocal run_at, linked
        if text:
            if "&" in text:
                text = html.unescape(text)
            if not run:
                run_at = at
            run.append(text)
            if in_link:
                linked += len(text)

    while place < end:
        m = _markup.search(page, place)
        if m is None:
            add(page[place:], place)
            break
        add(page[place : m.start()], place)
        place = m.end()
        closing, name, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        tag = name.lower()
        if closing:
            if tag == "a":
                in_link = 0
            elif tag == "br" or tag == "p" and last("p") < 0:
                close_run()
            elif tag not in INLINE and last(tag) > 0:
                close_run()
                cut(last(tag))
            continue
        if tag in RAW or tag in UNSEEN and tag not in endless:
            found = re.compile(f"</{tag}(?=[\\s/>])[^>]*>?", re.I).search(page, place)
            if found:
                place = found.end()
                continue
            if tag in RAW:
                break
            endless.add(tag)
        if tag == "a":
            in_link = 1
        if tag in INLINE:
            continue
        close_run()
        in_link = 0 if tag in CLOSES else in_link
        if tag in VOID:
            continue
        if nodes[stack[-1]].tag == "p":
            cut(len(stack) - 1)
        if tag in CLOSES:
            d = max(last(t) for t in CLOSES[tag])
            if d > max(last(t) for t in SCOPES):
                cut(d)
            if tag in ("tr", "tbody", "thead", "tfoot"):
                while nodes[stack[-1]].tag in ("td", "th", "tr"):
                    cut(len(stack) - 1)
        if tag == "body":
            while nodes[stack[-1]].tag == "head":
                cut(len(stack) - 1)
        names = " ".join(a or b or c for a, b, c in _named.findall(rest)) if "=" in rest else ""
        nodes.append(Node(stack[-1], tag, names=names.lower(), at=m.start(), hidden=bool(rest) and _hidden.search(rest) is not None))
        if not rest.endswith("/") or tag not in ("hr",):
            places.setdefault(tag, []).append(len(stack))
            stack.append(len(nodes) - 1)
    close_run()
    return nodes
