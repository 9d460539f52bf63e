"""HTML pages as a sequence of leaf blocks.

A block is the text between two boundaries of block elements. It carries the tags
that are open around it and words from their class, id and role. Malformed
markup is read leniently: an end tag closes up to its nearest open start and is
ignored without one; a paragraph, list item or cell ends where the next begins.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Container
from html import unescape
from typing import NamedTuple

#: A value in quotes follows an equals sign; a quote anywhere else is an ordinary sign. The third
#: kind of tag is one whose only ends are within quotes.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<more>(?>[^>=]+|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<more2>[^>]*)>"
    r"|<[!?][^>]*>|</[^>]*>",
    re.S,
)
#: The same without regard for quotes.
PLAIN = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<more>[^>]*)>|<[!?][^>]*>|</[^>]*>", re.S)
#: Elements whose content isn't text of the page, with their ends.
DROPPED = {t: re.compile(rf"</{t}\s*>", re.I) for t in "script style noscript template svg iframe annotation select textarea title".split()}
#: Of these, those that go on to the end of the page where no end tag follows, and those that may be closed at once.
TO_END, CLOSED = frozenset(["script", "style"]), frozenset(["svg", "iframe"])
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
SPACE = re.compile(r"\s+")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr object".split())
#: Formulas stand within a line.
INLINE |= frozenset("math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle mpadded mphantom menclose merror msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd semantics".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag that ends an open element of the same set.
SIBLINGS = {t: s for s in (frozenset(["p"]), frozenset(["li"]), frozenset(["dt", "dd"]), frozenset(["td", "th"]), frozenset(["tr"]), frozenset(["option"])) for t in s}
#: Elements that an implied end doesn't reach across.
HOLDERS = frozenset("ul ol dl table tbody thead div article section main aside nav header footer body form blockquote td th li figure".split())
#: Block elements that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


#: Elements that a block is told to be in; others, as there may be any number, are not kept.
KNOWN = INLINE | EMPTY | HOLDERS | ENDS_P | frozenset(SIBLINGS) | frozenset("html head body dialog search hgroup menu summary details button label legend caption tfoot optgroup center figcaption picture video audio canvas".split())


class Block(NamedTuple):
    text: str
    #: The innermost element, and all that are open around the text (of ``KNOWN``).
    parent: str
    tags: frozenset[str]
    words: frozenset[str]
    linked: int


class Open(NamedTuple):
    """An open element, and what holds for all that it contains."""

    tag: str
    tags: frozenset[str]
    words: frozenset[str]


def named_words(attributes: str) -> frozenset[str]:
    if "=" not in attributes:
        return frozenset()
    found = (m[1] or m[2] or m[3] or "" for m in NAMED.finditer(attributes))
    return frozenset(p.lower() for value in found for p in PART.findall(value))


def blocks(html: str | None, names: Container[str] | None = None) -> list[Block]:
    """The page's blocks in order; blocks of white space alone are left out.

    ``names`` are the words of classes, ids and roles that are kept. An element
    refers to what its parent has, so that time follows the page's length however
    deep its elements lie. A tag that doesn't end before the page does is text.
    """
    out: list[Block] = []
    stack: list[Open] = []
    opened: Counter[str] = Counter()
    text: list[str] = []
    linked, links = 0, 0
    root = Open("none", frozenset(), frozenset())

    def flush() -> None:
        nonlocal linked
        if text:
            line = SPACE.sub(" ", unescape("".join(text))).strip()
            if line:
                out.append(Block(line, *(stack[-1] if stack else root), linked))
            text.clear()
        linked = 0

    def close(names: frozenset[str], stops: frozenset[str] = frozenset()) -> None:
        if not any(opened[t] for t in names):
            return
        for k in range(len(stack) - 1, -1, -1):
            if stack[k].tag in names:
                for one in stack[k:]:
                    opened[one.tag] -= 1
                del stack[k:]
                return
            if stack[k].tag in stops:
                return

    def enter(tag: str, attributes: str) -> None:
        above = stack[-1] if stack else root
        words = named_words(attributes)
        if names is not None:
            words = frozenset(w for w in words if w in names)
        tags = above.tags if tag in above.tags or tag not in KNOWN else above.tags | {tag}
        stack.append(Open(tag, tags, above.words if words <= above.words else above.words | words))
        opened[tag] += 1

    page, at = html or "", 0
    last, pattern = page.rfind(">") + 1, TOKEN
    endless: set[str] = set()
    while at < last and (m := pattern.search(page, at, last)):
        if m.start() > at:
            run = page[at : m.start()]
            text.append(run)
            linked += len(run) if links else 0
        at = m.end()
        tag, end, more = m["tag"], m["end"], m["more"]
        if not tag and pattern is TOKEN and m["tag2"]:
            # every end ahead is within quotes that don't match up: they are not looked at any more
            tag, end, more, pattern = m["tag2"], m["end2"], m["more2"], PLAIN
        if not tag:
            if m[0].startswith("<!--") and not m[0].endswith("-->"):
                at = len(page)
            continue
        tag = tag.lower()
        if tag in DROPPED:
            if not end and tag not in endless and not (tag in CLOSED and more.endswith("/")):
                if found := DROPPED[tag].search(page, at):
                    at = found.end()
                elif tag in TO_END:
                    at = len(page)
                else:
                    endless.add(tag)
            continue
        if tag == "a":
            links = max(0, links - 1) if end else links + 1
        if tag == "br":
            text.append(" ")
            continue
        if tag not in INLINE:
            flush()
            links = 0
            if not end:
                if tag in SIBLINGS:
                    close(SIBLINGS[tag], HOLDERS - SIBLINGS[tag])
                if tag in ENDS_P:
                    close(SIBLINGS["p"], HOLDERS)
                if tag not in EMPTY:
                    enter(tag, more)
            else:
                close(frozenset([tag]))
    if at < len(page):
        text.append(page[at:])
    flush()
    return out
