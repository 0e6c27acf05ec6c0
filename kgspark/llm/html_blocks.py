"""Leaf blocks of HTML pages: their text and the path of tags, classes and ids above them."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

#: Elements without text of their own for a reader, those that hold plain text up to their end tag and those
#: that hold elements; elements inside a line, elements without an end.
RAW = frozenset("script style noscript iframe title textarea".split())
SILENT = frozenset("template svg object select canvas video audio".split())
INLINE = frozenset("annotation math mrow mi mn mo ms mtext mspace mfrac msqrt mroot msub msup msubsup munder mover munderover mtable mtr mtd semantics a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Open elements that the start of another one ends.
CLOSED_BY = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
#: Elements that such an end does not reach out of.
SCOPES = frozenset("ul ol dl table".split())
#: Silent elements in which HTML goes on as outside; those that an outer element's end tag does not reach out of.
PLAIN, CLOSED_IN = frozenset("canvas video audio".split()), frozenset(["template"])
#: Elements with rules of their own, elements in which HTML's rules hold again, and elements whose start ends the former.
FOREIGN = frozenset(["svg"])
WITHIN = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
BREAKOUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
#: Elements whose start ends an open paragraph.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li listing main menu nav ol p pre search section summary table ul".split()
)

#: Open elements beyond this depth are not followed, and a block's path holds its outermost and innermost ones.
DEPTH, PATH_ENDS = 512, 24

# every part is possessive or consumes what it has read, so that reading takes time in proportion to the page
_START = re.compile(r"<(?=[A-Za-z!?]|/[^>])")
_TAG = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(?:[!?]|/[^A-Za-z])[^>]*+>|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|["'=])*+)>""", re.S)
_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for name in RAW}
_NAMED = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PIECE = re.compile(r"[A-Za-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    linked: float


def _marks(name: str, attributes: str) -> tuple[str, ...]:
    """An element's marks: its name, and the words of its classes, id and role."""
    found = [name]
    if attributes and "=" in attributes:
        for m in _NAMED.finditer(attributes):
            value = m[2] or m[3] or m[4] or ""
            found += ["." + w.lower() for w in _PIECE.findall(_CAMEL.sub(" ", value))]
    return tuple(found)


def _foreign(stack: list[tuple[str, tuple[str, ...]]], hidden: int) -> int:
    """The place of the svg or math element whose rules hold at the end of the stack, or -1."""
    for k in range(len(stack) - 1, hidden - 1, -1):
        if stack[k][0] in FOREIGN:
            return k
        if stack[k][0] in WITHIN:
            break
    return -1


def _left(stack: list[tuple[str, tuple[str, ...]]], hidden: int, name: str, end: bool) -> int:
    """How much of the stack, whose end is silent from ``hidden`` on, stays open at a tag."""
    if end:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == name:
                return k
            if stack[k][0] in CLOSED_IN:
                break
        return len(stack)
    size = len(stack)
    while (k := _foreign(stack[:size], hidden)) >= 0 and name in BREAKOUT:
        size = k
    if k >= 0:
        return size
    for k in range(size - 1, -1, -1):
        above = stack[k][0]
        if above in SCOPES or above in SILENT - PLAIN:
            break
        if above in CLOSED_BY.get(name, ()) or (above == "p" and name in ENDS_P):
            return k
    return size


def blocks(page: str | None) -> list[Block]:
    """Blocks with text, in page order; character references decoded, white space made single spaces."""
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    hidden: int | None = None  # the place of the outermost silent element on the stack
    text: list[str] = []
    links: list[str] = []
    in_link = 0

    def flush() -> None:
        if text:
            said = " ".join(html.unescape("".join(text)).split())
            if said:
                linked = len(" ".join(html.unescape("".join(links)).split()))
                near = stack if len(stack) <= 2 * PATH_ENDS else stack[:PATH_ENDS] + stack[-PATH_ENDS:]
                out.append(Block(tuple(m for _, marks in near for m in marks), said, min(1.0, linked / len(said))))
            text.clear()
            links.clear()

    at, seek = 0, 0
    while start := _START.search(page, seek):
        if start.start() > at and hidden is None:
            piece = page[at : start.start()]
            text.append(piece)
            if in_link:
                links.append(piece)
        m = _TAG.match(page, start.start())
        if not m:  # a tag that is cut off
            at = len(page)
            break
        at = seek = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        empty = name in VOID or m[3].rstrip().endswith("/")
        if hidden is not None:
            size = _left(stack, hidden, name, bool(m[1]))
            if size < hidden:
                flush()
                in_link = 0
            del stack[size:]
            if size <= hidden:
                hidden = None
            if m[1]:
                continue
        if name in RAW and not m[1] and (hidden is None or _foreign(stack, hidden) < 0):
            end = _END[name].search(page, at)
            at = seek = end.end() if end else len(page)
            continue
        if hidden is not None:
            if not empty and name not in INLINE and len(stack) < DEPTH:
                stack.append((name, ()))
            continue
        if name in SILENT and not m[1]:
            if not empty:
                hidden = len(stack)
                stack.append((name, ()))
            continue
        if name in INLINE:
            if name == "a":
                in_link = 0 if m[1] else 1
            continue
        if name == "br":
            text.append("\n")
            continue
        flush()
        if name == "head":  # it has no text of its own, and its end tag may be left out
            continue
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            in_link = 0
            continue
        if stack and stack[-1][0] == "p":
            stack.pop()
        if name in CLOSED_BY:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in SCOPES:
                    break
                if stack[k][0] in CLOSED_BY[name]:
                    del stack[k:]
                    break
        if not empty and len(stack) < DEPTH:
            stack.append((name, _marks(name, m[3])))
    if hidden is None:
        text.append(page[at:])
    flush()
    return out
