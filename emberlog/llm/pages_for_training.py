"""Labelled pages for the HTML classifier: generated, bounded in number, same for a seed.

Elements carry data-y: 1 for main content and what encloses it, 0 for the rest.
"""

from __future__ import annotations

import html
import random

SYLLABLES = "ta re lo mi en sha dor per ine ul ka st ver ath on qu es il or bre ñu é ch ze wo".split()
MENUS = ("nav", "menu", "navbar", "topnav", "breadcrumb", "nav-links", "site-menu")
HEADS = ("header", "masthead", "site-header", "top-bar", "branding")
FEET = ("footer", "site-footer", "copyright", "colophon", "bottom")
SIDES = ("sidebar", "side", "related", "widget", "recommended", "aside", "popular-posts")
ADS = ("ad", "ads", "advert", "sponsor", "promo", "banner", "ad-slot", "advertisement")
NOTICES = ("cookie", "notice", "consent", "cookie-banner", "alert", "gdpr", "popup")
TALK = ("comments", "comment-list", "replies", "discussion", "reader-comments")
SHARES = ("share", "social", "share-buttons", "follow")
MAIN = ("content", "post", "entry", "article-body", "story", "main", "post-content", "text")
PLAIN = ("wrap", "container", "row", "col", "box", "inner", "page", "layout", "c1", "block")


class Maker:
    """Writes one page."""

    def __init__(self, rnd: random.Random):
        self.r = rnd

    def words(self, low: int, high: int) -> str:
        r = self.r
        n = r.randint(low, high)
        ws = ["".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(n)]
        style = r.random()
        if style < 0.08:
            ws = [w.upper() + "!!" for w in ws]
        elif style < 0.16:
            ws = [w + r.choice(("***", "%%%", "&&&", " |")) for w in ws]
        return html.escape(" ".join(w + ("," if r.random() < 0.08 else "") for w in ws).capitalize() + ".")

    def el(self, tag: str, y: int, inner: str, name: str = "") -> str:
        r = self.r
        at = ""
        if name and r.random() < 0.85:
            at = f' {r.choice(("class", "class", "id"))}="{name}"'
        return f'<{tag}{at} data-y="{y}">{inner}</{tag}>'

    def links(self, n: int) -> str:
        return "".join(self.el("li", 0, self.el("a", 0, self.words(1, 2))) for _ in range(n))

    def boilerplate(self) -> str:
        r = self.r
        kind = r.randrange(9)
        say = lambda low, high: self.words(low, high)
        if kind == 0:
            name = r.choice(MENUS)
            return self.el(r.choice(("nav", "nav", "div")), 0, self.el("ul", 0, self.links(r.randint(2, 8))), name)
        if kind == 1:
            return self.el(r.choice(("header", "div")), 0, self.el(r.choice(("h1", "div", "span")), 0, say(1, 5)), r.choice(HEADS))
        if kind == 2:
            return self.el(r.choice(("footer", "footer", "div")), 0, "&copy; " + say(1, 12) + r.choice(("", self.el("p", 0, say(2, 20)))), r.choice(FEET))
        if kind == 3:
            inner = self.el("h3", 0, say(1, 4)) + r.choice((self.el("ul", 0, self.links(4)), "".join(self.el("p", 0, say(3, 30)) for _ in range(r.randint(1, 4)))))
            return self.el(r.choice(("aside", "div", "section")), 0, inner, r.choice(SIDES))
        if kind == 4:
            return self.el(r.choice(("div", "div", "section", "p")), 0, say(2, 40), r.choice(ADS))
        if kind == 5:
            return self.el("div", 0, r.choice((say(3, 30), self.el("p", 0, say(3, 30)))) + self.el("button", 0, say(1, 2)), r.choice(NOTICES))
        if kind == 6:
            inner = self.el("label", 0, say(1, 3)) + '<input type="text" data-y="0">' + self.el("button", 0, say(1, 2))
            return self.el("form", 0, inner + r.choice(("", self.el("p", 0, say(3, 15)))), r.choice(("search", "login", "newsletter", "")))
        if kind == 7:
            each = lambda: self.el("div", 0, self.el("span", 0, say(1, 2)) + self.el("p", 0, say(2, 50)), r.choice(("comment", "reply", "")))
            return self.el(r.choice(("div", "section", "ul")), 0, "".join(each() for _ in range(r.randint(1, 6))), r.choice(TALK))
        return self.el("div", 0, "".join(self.el("a", 0, say(1, 1)) for _ in range(r.randint(2, 5))), r.choice(SHARES))

    def block(self) -> str:
        r = self.r
        kind = r.random()
        if kind < 0.7:
            text = self.words(1, r.choice((4, 20, 60, 120)))
            extra = r.random()
            if extra < 0.1:
                return f'<p data-y="1"><b data-y="1">{text}<br>'  # left open
            if extra < 0.2:
                text += " " + self.el(r.choice(("b", "em", "a", "span", "code")), 1, self.words(1, 4)) + " " + self.words(1, 9)
            return self.el("p", 1, text)
        if kind < 0.8:
            return self.el(r.choice(("h2", "h3")), 1, self.words(1, 7))
        if kind < 0.87:
            return self.el(r.choice(("ul", "ol")), 1, "".join(self.el("li", 1, self.words(2, 14)) for _ in range(r.randint(2, 6))))
        if kind < 0.92:
            return self.el("blockquote", 1, self.el("p", 1, self.words(5, 40)))
        if kind < 0.95:
            row = lambda: self.el("tr", 1, "".join(self.el("td", 1, self.words(1, 4)) for _ in range(3)))
            return self.el("table", 1, "".join(row() for _ in range(r.randint(2, 5))))
        return self.el(r.choice(("div", "section", "pre")), 1, self.words(5, 60))

    def page(self) -> str:
        r = self.r
        inside = [self.block() for _ in range(r.choice((0, 1, 1, 2, 4, 8, 16)))]
        if r.random() < 0.7 or not inside:
            inside.insert(0, self.el("h1", 1, self.words(1, 9)))
        for _ in range(r.choice((0, 0, 0, 1, 2))):
            inside.insert(r.randint(0, len(inside)), self.boilerplate())
        tag = r.choice(("article", "article", "article", "main", "div", "div", "section"))
        name = r.choice(MAIN) if tag in ("div", "section") or r.random() < 0.3 else ""
        body = self.el(tag, 1, "".join(inside), name).replace(f"<{tag} data", f'<{tag} class="{name}" data', 1 if tag in ("div", "section") else 0)
        if r.random() < 0.3:
            body = self.el(r.choice(("div", "main")), 1, body, r.choice(PLAIN))
        before = [self.boilerplate() for _ in range(r.choice((0, 1, 2, 3)))]
        after = [self.boilerplate() for _ in range(r.choice((0, 1, 2, 3)))]
        all_ = "".join(before) + body + "".join(after)
        if r.random() < 0.3:
            all_ = self.el("div", 1, all_, r.choice(PLAIN))
        head = f'<head data-y="0"><title data-y="0">{self.words(1, 9)}</title><script>var a = "<p>";</script></head>'
        end = "</body></html>" if r.random() < 0.9 else ""
        return f'<!DOCTYPE html><html data-y="1">{head}<body data-y="1">{all_}{end}'


def pages(n: int, seed: int) -> list[str]:
    return [Maker(random.Random(seed * 1_000_003 + i)).page() for i in range(n)]
