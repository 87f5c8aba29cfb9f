"""A lenient HTML tree: block elements as inner nodes, runs of text as leaves."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

from casekit.functions.workers import ship_with_tasks

ship_with_tasks(__name__)

# Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong "
    "sub sup time tt u var ruby rt rp wbr".split())
RAW = frozenset("script style textarea title noscript template iframe object svg math canvas xmp noembed noframes".split())
CLOSES = {  # a start tag ends these open elements, up to the nearest of the others
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "tr": (frozenset(("tr", "td", "th")), frozenset(("table", "tbody", "thead", "tfoot"))),
    "td": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "th": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "option": (frozenset(("option",)), frozenset(("select",))),
}
TEXT = "#text"

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_END = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_CUES = re.compile(r"\b(?:class|id|role|itemprop|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_WHITE = re.compile(r"\s+")


@dataclass
class Tree:
    """Nodes in page order; node 0 is the root."""

    parent: list[int] = field(default_factory=lambda: [-1])
    tag: list[str] = field(default_factory=lambda: ["html"])
    cue: list[str] = field(default_factory=lambda: [""])
    text: list[str] = field(default_factory=lambda: [""])
    linked: list[int] = field(default_factory=lambda: [0])  # characters inside links

    def add(self, parent: int, tag: str, cue: str = "", text: str = "", linked: int = 0) -> int:
        for column, value in ((self.parent, parent), (self.tag, tag), (self.cue, cue), (self.text, text),
                              (self.linked, linked)):
            column.append(value)
        return len(self.parent) - 1


def parse(page: str) -> Tree:
    """The tree of a page, however broken its markup; linear in its length.

    White space inside a text becomes one space, character references are
    decoded, comments and the contents of scripts and the like are left out.
    """
    tree, stack = Tree(), [0]
    run: list[str] = []
    links, open_links = 0, 0
    at, size, quotes = 0, len(page), True
    no_end: set[str] = set()  # raw elements without an end tag further on

    def flush() -> None:
        nonlocal run, links
        if run:
            text = _WHITE.sub(" ", "".join(run)).strip()
            if text:
                tree.add(stack[-1], TEXT, "", text, min(links, len(text)))
            run, links = [], 0

    def put(raw: str) -> None:
        nonlocal links
        text = html.unescape(raw) if "&" in raw else raw
        run.append(text)
        if open_links:
            links += len(text)

    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            put(page[at:])
            break
        if lt > at:
            put(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = size if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            at = size if end < 0 else end + 1
            continue
        name = _NAME.match(page, lt)
        if not name:
            put("<")
            at = lt + 1
            continue
        end = _END.match(page, name.end()) if quotes else None
        if end is None:  # a quote that never ends: from here on tags end at the next bracket
            quotes = False
            close = page.find(">", name.end())
            stop = size if close < 0 else close + 1
        else:
            stop = end.end()
        tag, closing = name[1].lower(), page[lt + 1] == "/"
        attrs = page[name.end():stop - 1]
        at = stop
        if tag in RAW and not closing:
            if not attrs.endswith("/"):
                hit = None if tag in no_end else re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
                if hit:
                    at = hit.end()
                elif tag in ("script", "style", "textarea", "title"):
                    at = size
                else:
                    no_end.add(tag)
            continue
        if tag == "br":
            run.append(" ")
        elif tag in INLINE:
            if tag == "a":
                open_links = max(0, open_links - 1) if closing else 1
        elif tag in VOID:
            if tag == "hr":
                flush()
        elif closing:
            flush()
            for k in range(len(stack) - 1, 0, -1):
                if tree.tag[stack[k]] == tag:
                    del stack[k:]
                    open_links = 0
                    break
        else:
            flush()
            if tree.tag[stack[-1]] == "p":  # every block ends a paragraph
                stack.pop()
            ends, until = CLOSES.get(tag, (frozenset(), frozenset()))
            if ends:
                k = len(stack) - 1
                while k > 0 and tree.tag[stack[k]] not in until:
                    if tree.tag[stack[k]] in ends:
                        del stack[k:]
                        break
                    k -= 1
            open_links = 0
            if tag not in ("html", "body"):
                cue = " ".join(m[1].strip("\"'") for m in _CUES.finditer(attrs)).lower()
                stack.append(tree.add(stack[-1], tag, cue))
                if attrs.endswith("/") and tag not in ("p", "div"):
                    stack.pop()
    flush()
    return tree
