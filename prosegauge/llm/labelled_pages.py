"""Labelled pages to train the block model on.

No table has labels for blocks, so pages are made from layouts that are common on
the web, with words that mean nothing: what is learnt is structure and shape, not
language. Every piece is marked as wanted or not when it is made. Class names are
chosen from several in use, and are often missing or say nothing.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

Piece = tuple[str, list[tuple[str, int]]]

MENU = ["nav", "menu", "navbar", "main-menu", "site-nav", "breadcrumb", "breadcrumbs", "topbar"]
AD = ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad", "adsbox"]
SIDE = ["sidebar", "side", "widget", "related", "related-posts", "popular", "trending", "rail"]
NOTICE = ["cookie", "cookie-notice", "notice", "consent", "alert", "gdpr", "banner", "popup", "modal"]
FOOT = ["footer", "site-footer", "copyright", "bottom", "legal"]
HEAD = ["header", "masthead", "site-header", "logo", "branding", "top"]
TALK = ["comments", "comment", "comment-list", "replies", "discussion", "responses", "reader-comments"]
FORM = ["newsletter", "subscribe", "search", "login", "signup", "contact-form"]
SHARE = ["share", "social", "tags", "byline-share", "pagination"]
BODY = ["content", "post", "entry", "article", "article-body", "post-content", "main-content", "story", "text", "entry-content"]
BLANK = ["", "", "x1", "row", "col", "wrap", "container", "inner", "box"]


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        r = self.r
        return "".join(r.choice("bcdfghklmnprstvw") + r.choice(["a", "e", "i", "o", "u", "ä", "é"]) for _ in range(r.randint(1, 4)))

    def words(self, a: int, b: int) -> str:
        line = [self.word() for _ in range(self.r.randint(a, b))]
        return " ".join(line).capitalize()

    def sentences(self, a: int, b: int) -> str:
        return " ".join(self.words(1, 18) + self.r.choice([".", ".", ".", "?", "!"]) for _ in range(self.r.randint(a, b)))

    def name(self, *pools: list[str]) -> str:
        r = self.r
        value = r.choice(r.choice(pools))
        return f' {r.choice(["class", "class", "id"])}="{value}"' if value else ""

    def tag(self, tag: str, attributes: str, inner: list[Piece]) -> Piece:
        return f"<{tag}{attributes}>" + "".join(p[0] for p in inner) + f"</{tag}>", [b for p in inner for b in p[1]]

    def leaf(self, tag: str, text: str, wanted: int, attributes: str = "", link: bool = False) -> Piece:
        inner = f'<a href="/{self.word()}">{text}</a>' if link else text
        return f"<{tag}{attributes}>{inner}</{tag}>", [(text, wanted)]

    def menu(self) -> Piece:
        items = [self.leaf("li", self.words(1, 3), 0, link=True) for _ in range(self.r.randint(2, 9))]
        if self.r.random() < 0.7:
            return self.tag("nav", self.name(MENU, BLANK), [self.tag("ul", "", items)])
        return self.tag("div", self.name(MENU), [self.tag("ul", self.name(BLANK), items)])

    def ad(self) -> Piece:
        tag = self.r.choice(["div", "div", "section", "aside"])
        inner = [self.leaf(self.r.choice(["p", "span", "div"]), self.sentences(1, 4), 0, link=self.r.random() < 0.4) for _ in range(self.r.randint(1, 2))]
        if self.r.random() < 0.5:
            text = self.sentences(1, 6)
            return f"<{tag}{self.name(AD)}>{text}</{tag}>", [(text, 0)]
        inner = [p if not p[0].startswith("<span") else self.tag("div", "", [p]) for p in inner]
        return self.tag(tag, self.name(AD), inner)

    def side(self) -> Piece:
        items = [self.leaf("li", self.words(2, 9), 0, link=self.r.random() < 0.8) for _ in range(self.r.randint(1, 6))]
        head = self.leaf(self.r.choice(["h2", "h3", "h4"]), self.words(1, 3), 0)
        para = [self.leaf("p", self.sentences(1, 3), 0) for _ in range(self.r.randint(0, 2))]
        return self.tag("aside" if self.r.random() < 0.6 else "div", self.name(SIDE), [head, *para, self.tag("ul", "", items)])

    def notice(self) -> Piece:
        text = self.leaf(self.r.choice(["p", "div"]), self.sentences(1, 3), 0)
        return self.tag("div", self.name(NOTICE), [text, self.leaf("button", self.words(1, 2), 0)])

    def form(self) -> Piece:
        label = self.leaf(self.r.choice(["p", "h3", "div"]), self.words(2, 9), 0)
        return self.tag("form", self.name(FORM, BLANK), [label, ('<input type="text" name="q">', []), self.leaf("button", self.words(1, 2), 0)])

    def head(self) -> Piece:
        inner = [self.leaf(self.r.choice(["div", "p", "h2"]), self.words(1, 4), 0, link=self.r.random() < 0.6)]
        if self.r.random() < 0.5:
            inner.append(self.menu())
        if self.r.random() < 0.3:
            inner.append(self.form())
        return self.tag("header" if self.r.random() < 0.6 else "div", self.name(HEAD), inner)

    def foot(self) -> Piece:
        tag = "footer" if self.r.random() < 0.7 else "div"
        attributes = self.name(FOOT) if tag == "div" else self.name(FOOT, BLANK)
        text = f"&copy; {self.word()}.example {self.r.choice(['&middot; ', '| ', ''])}{self.sentences(1, 2) if self.r.random() < 0.6 else self.words(2, 6)}"
        if self.r.random() < 0.5:
            return f"<{tag}{attributes}>{text}</{tag}>", [(text, 0)]
        return self.tag(tag, attributes, [self.leaf("p", text, 0), *([self.menu()] if self.r.random() < 0.4 else [])])

    def talk(self) -> Piece:
        one = lambda: self.tag(self.r.choice(["div", "li", "article"]), self.name(TALK, BLANK), [self.leaf(self.r.choice(["p", "div", "h4"]), self.words(1, 2), 0), *[self.leaf("p", self.sentences(1, 4), 0) for _ in range(self.r.randint(1, 2))]])
        head = [self.leaf("h3", self.words(1, 2), 0)] if self.r.random() < 0.6 else []
        said = [one() for _ in range(self.r.randint(1, 5))]
        return self.tag(self.r.choice(["section", "div", "ol"]), self.name(TALK), [*head, *said])

    def share(self) -> Piece:
        items = [self.leaf("li", self.words(1, 2), 0, link=True) for _ in range(self.r.randint(1, 5))]
        return self.tag("div", self.name(SHARE), [self.tag("ul", "", items)])

    def paragraph(self) -> Piece:
        r, x = self.r, self.r.random()
        if x < 0.08:
            text = self.words(1, 2) + "."
            return self.leaf("p", text, 1)
        if x < 0.16:
            return self.tag(r.choice(["ul", "ol"]), "", [self.leaf("li", self.sentences(1, 2) if r.random() < 0.5 else self.words(2, 9), 1, link=r.random() < 0.1) for _ in range(r.randint(2, 6))])
        if x < 0.22:
            return self.tag("blockquote", "", [self.leaf("p", self.sentences(1, 3), 1)])
        if x < 0.26:
            return self.leaf("pre", self.words(5, 30), 1)
        if x < 0.31:
            rows = [self.tag("tr", "", [self.leaf(r.choice(["td", "td", "th"]), self.words(1, 4), 1) for _ in range(2)]) for _ in range(r.randint(1, 3))]
            return self.tag("table", "", rows)
        if x < 0.36:
            text = self.words(4, 12)
            return f"<p><b>{text}<br>", [(text, 1)]
        text = self.sentences(1, 12)
        return self.leaf("p" if x < 0.93 else "div", text, 1)

    def article(self) -> Piece:
        r = self.r
        inner = [self.leaf(r.choice(["h1", "h1", "h2"]), self.words(2, 12) + r.choice(["", "", ".", "&amp;"]), 1)] if r.random() < 0.85 else []
        for _ in range(r.randint(1, 14)):
            if r.random() < 0.1:
                inner.append(self.leaf(r.choice(["h2", "h3"]), self.words(1, 6), 1))
            inner.append(self.paragraph())
            if r.random() < 0.07:
                inner.append(r.choice([self.ad, self.side, self.form, self.notice, self.share])())
        if r.random() < 0.25:
            inner.append(r.choice([self.talk, self.share, self.side])())
        x = r.random()
        if x < 0.4:
            return self.tag("article", self.name(BODY, BLANK), inner)
        if x < 0.6:
            return self.tag("main", self.name(BODY, BLANK), inner if r.random() < 0.5 else [self.tag("article", "", inner)])
        if x < 0.9:
            return self.tag("div", self.name(BODY), inner if r.random() < 0.6 else [self.tag("div", self.name(BLANK), inner)])
        return self.tag("div", self.name(BLANK), inner)

    def page(self) -> Piece:
        r = self.r
        chance = lambda p, f: [f()] if r.random() < p else []
        before = [*chance(0.3, self.notice), *chance(0.5, self.head), *chance(0.6, self.menu), *chance(0.35, self.ad), *chance(0.15, self.side), *chance(0.15, self.form)]
        after = [*chance(0.3, self.talk), *chance(0.35, self.side), *chance(0.25, self.ad), *chance(0.2, self.form), *chance(0.2, self.share), *chance(0.75, self.foot), *chance(0.15, self.notice)]
        body = [*before, self.article(), *after] if r.random() < 0.97 else [*before, *after]
        if r.random() < 0.25:
            body = [self.tag("div", self.name(BLANK), body)]
        return self.tag("body", "", body)


def labelled(n: int, seed: int = 7) -> Iterator[Piece]:
    """``n`` pages as (html, [(text, wanted), ...]), blocks in page order."""
    for k in range(n):
        html, parts = Maker(seed * 1_000_003 + k).page()
        yield f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head>{html}</html>", parts
