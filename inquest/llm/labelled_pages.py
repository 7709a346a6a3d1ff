"""Labelled pages to learn extraction from: page layouts with blocks that are known to be main text or not.

Pages are made from a seed. Layouts vary in the elements and in the class and id names that they use, in the order of
their parts and in the words of any block, so that what separates main text from the rest is the structure around a
block and its shape, not single words.
"""

from __future__ import annotations

import random

_SYLLABLES = "an ber chi do el fa gen hu in jo ka lor mi ne or pa que ra sti tion un ver wi xo yet zu the and de la".split()


def _word(r: random.Random) -> str:
    return "".join(r.choice(_SYLLABLES) for _ in range(r.choice((1, 1, 2, 2, 3, 4))))


def _text(r: random.Random, low: int, high: int, stop: float = 0.9) -> str:
    words = [_word(r) for _ in range(r.randint(low, high))]
    mark = r.choice(("", "", "", "!!", "###", "%%%", "&amp;"))
    for i in range(len(words)):
        words[i] += r.choice(("", "", "", "", "", "", ",", ".")) + mark
    out = " ".join(words)
    return out[:1].upper() + out[1:] + ("." if r.random() < stop else "")


class _Page:
    """Builds html; text that is put in by ``main`` or ``rest`` is labelled."""

    def __init__(self, r: random.Random):
        self.r, self.html, self.marks = r, [], 0
        self.labels: dict[str, int] = {}

    def _block(self, tag: str, body: str, label: int) -> None:
        self.marks += 1
        mark = f"@{self.marks}@"
        self.labels[mark] = label
        close = "" if tag in ("p", "li") and self.r.random() < 0.15 else f"</{tag}>"
        self.html.append(f"<{tag}>{mark} {body}{close}")

    def main(self, tag: str, low: int, high: int) -> None:
        body = _text(self.r, low, high)
        if self.r.random() < 0.2:
            body += f' <a href="/x">{_text(self.r, 1, 3, 0)}</a> {_text(self.r, 1, 6)}'
        if self.r.random() < 0.15:
            body = f"<b>{body}</b>" if self.r.random() < 0.5 else f"<b>{body}<br>"
        self._block(tag, body, 1)

    def rest(self, tag: str, low: int, high: int, link: bool = False, lead: str = "") -> None:
        body = lead + _text(self.r, low, high, 0.6)
        self._block(tag, f'<a href="/y">{body}</a>' if link else body, 0)

    def open(self, tag: str, *names: str) -> None:
        name = self.r.choice(names) if names else ""
        kind = self.r.choice(("class", "id")) if name else ""
        self.html.append(f'<{tag} {kind}="{name}">' if name else f"<{tag}>")

    def close(self, tag: str) -> None:
        self.html.append(f"</{tag}>")


def _menu(p: _Page) -> None:
    outer = p.r.choice(("nav", "nav", "div"))
    p.open(outer, *(("menu", "nav", "navbar", "main-nav", "navigation", "breadcrumb") if outer == "div" else ("", "menu", "top")))
    p.open("ul")
    for _ in range(p.r.randint(2, 8)):
        p.rest("li", 1, 3, link=True)
    p.close("ul")
    p.close(outer)


def _head(p: _Page) -> None:
    outer = p.r.choice(("header", "div"))
    p.open(outer, *(("header", "site-header", "masthead", "top-bar") if outer == "div" else ("", "site")))
    p.rest(p.r.choice(("h1", "h2", "div", "p")), 1, 6, link=p.r.random() < 0.5)
    if p.r.random() < 0.5:
        p.rest("p", 2, 9)
    p.close(outer)


def _foot(p: _Page) -> None:
    outer = p.r.choice(("footer", "footer", "div"))
    p.open(outer, *(("footer", "site-footer", "copyright", "bottom") if outer == "div" else ("", "footer")))
    for _ in range(p.r.randint(1, 3)):
        p.rest(p.r.choice(("p", "div", "span")), 2, 25, lead=p.r.choice(("", "&copy; ", "&middot; ")))
    p.close(outer)


def _side(p: _Page) -> None:
    outer = p.r.choice(("aside", "div"))
    p.open(outer, *(("sidebar", "widget", "side", "related", "recommended", "popular") if outer == "div" else ("", "sidebar", "related")))
    p.rest("h3", 1, 4)
    for _ in range(p.r.randint(1, 5)):
        p.rest(p.r.choice(("li", "p")), 2, 14, link=p.r.random() < 0.6)
    p.close(outer)


def _advert(p: _Page) -> None:
    p.open(p.r.choice(("div", "section", "aside")), "ad", "ads", "advert", "advertisement", "banner", "sponsor", "sponsored", "promo")
    tag = p.html[-1][1:].split()[0]
    p.rest(p.r.choice(("div", "p", "span")), 1, 18, link=p.r.random() < 0.3)
    p.close(tag)


def _notice(p: _Page) -> None:
    p.open("div", "cookie", "cookie-notice", "consent", "notice", "alert", "popup", "newsletter", "subscribe", "gdpr", "modal")
    p.rest("p", 4, 25)
    if p.r.random() < 0.5:
        p.rest("button", 1, 2)
    p.close("div")


def _form(p: _Page) -> None:
    p.open("form", "", "search", "login", "signup", "contact")
    for _ in range(p.r.randint(1, 3)):
        p.rest(p.r.choice(("label", "p", "div")), 1, 12)
    p.html.append('<input name="q">')
    p.rest("button", 1, 2)
    p.close("form")


def _comments(p: _Page) -> None:
    outer = p.r.choice(("div", "section", "ol"))
    p.open(outer, "comments", "comment-list", "responses", "discussion", "reader-comments", "disqus", "replies")
    for _ in range(p.r.randint(1, 4)):
        p.open("div", "comment", "reply", "comment-body", "response")
        if p.r.random() < 0.5:
            p.rest("span", 1, 3)
        p.rest("p", 3, 60)
        p.close("div")
    p.close(outer)


def _share(p: _Page) -> None:
    p.open("div", "share", "social", "share-buttons", "tags", "meta", "byline")
    for _ in range(p.r.randint(1, 4)):
        p.rest("span", 1, 2, link=True)
    p.close("div")


def _article(p: _Page, inside) -> None:
    outer = p.r.choice((("article", "", "post", "entry", "article"), ("main", "", "content"), ("div", "content", "article", "post", "entry-content", "article-body", "story", "main-content", "post-body", "text"), ("section", "content", "article", "story")))
    p.open(*outer)
    if p.r.random() < 0.8:
        p.main(p.r.choice(("h1", "h1", "h2")), 1, 12)
    for _ in range(p.r.choice((1, 2, 3, 5, 9, 14))):
        kind = p.r.random()
        if kind < 0.75:
            p.main("p", *p.r.choice(((1, 4), (5, 30), (20, 120))))
        elif kind < 0.82:
            p.main(p.r.choice(("h2", "h3")), 1, 7)
        elif kind < 0.88:
            p.open(p.r.choice(("ul", "ol")))
            tag = p.html[-1][1:3]
            for _ in range(p.r.randint(2, 5)):
                p.main("li", 1, 25)
            p.close(tag)
        elif kind < 0.92:
            p.main(p.r.choice(("blockquote", "pre", "figcaption", "div")), 3, 40)
        elif kind < 0.95:
            p.html.append("<table><tr>")
            p.main("td", 1, 8)
            p.main("td", 1, 8)
            p.html.append("</tr></table>")
        elif inside:
            p.r.choice(inside)(p)
    p.close(outer[0])


def labelled_pages(count: int = 600, seed: int = 11) -> list[tuple[str, dict[str, int]]]:
    """(html, label by marker) pairs; the marker ``@i@`` begins the text of block i."""
    pages = []
    for i in range(count):
        r = random.Random(f"{seed}-{i}")
        p = _Page(r)
        p.html.append(f"<!DOCTYPE html><html><head><title>{_text(r, 2, 8)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>")
        if r.random() < 0.3:
            p.open("div", "page", "wrapper", "container", "site")
        before = [x for x in (_head, _menu, _notice, _advert, _form, _side) if r.random() < 0.45]
        after = [x for x in (_comments, _side, _advert, _form, _share, _menu, _notice) if r.random() < 0.4]
        r.shuffle(before)
        r.shuffle(after)
        for x in before:
            x(p)
        _article(p, (_advert, _share, _comments, _notice, _form, _side))
        for x in after:
            x(p)
        if r.random() < 0.85:
            _foot(p)
        if r.random() < 0.9:
            p.html.append("</body></html>")
        pages.append(("".join(p.html), p.labels))
    return pages
