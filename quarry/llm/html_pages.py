"""Labelled web pages, composed from common layouts, for fitting the tree model."""

from __future__ import annotations

import random
from dataclasses import dataclass, field


@dataclass
class Part:
    """An element; content holds strings and elements. Its label is 1 if it has main text in it."""

    tag: str
    names: str = ""
    content: list = field(default_factory=list)
    main: bool = False

    @property
    def label(self) -> int:
        return int(self.main or any(isinstance(c, Part) and c.label for c in self.content))


class Composer:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    # ---- words

    def words(self, low: int, high: int) -> str:
        return " ".join("".join(self.r.choice("abcdefghiklmnoprstuvwé") for _ in range(self.r.randint(1, 11))) for _ in range(self.r.randint(low, high)))

    def sentence(self) -> str:
        return self.words(3, 18).capitalize() + self.r.choice(("." * 6) + "?!")

    def prose(self, low: int = 1, high: int = 7) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(low, high)))

    def marked(self, text: str) -> str:
        """Some inline markup in a text."""
        if self.r.random() < 0.3 and " " in text:
            a, b = text.split(" ", 1)
            tag = self.r.choice(("b", "i", "em", "strong", "a href='/x'", "span"))
            text = f"<{tag}>{a}</{tag.split()[0]}> {b}"
        if self.r.random() < 0.1:
            text = text.replace(". ", ".<br>", 1)
        return text

    def link(self, low: int = 1, high: int = 5) -> str:
        return f"<a href='/{self.r.randint(1, 999)}'>{self.words(low, high)}</a>"

    def named(self, *choices: str) -> str:
        """A class or id of one of these words, with or without more around it."""
        word = self.r.choice(choices)
        word = self.r.choice((word, word, f"{word}-{self.r.choice(('box', 'wrap', 'area', 'inner', 'block'))}", f"{self.r.choice(('site', 'page', 'main', 'c', 'js'))}-{word}" if word not in ("main", "content") else word))
        return f' {self.r.choice(("class", "class", "id"))}="{word}"'

    # ---- parts that aren't main text

    def links(self, low: int = 3, high: int = 10) -> Part:
        n = self.r.randint(low, high)
        if self.r.random() < 0.7:
            return Part(self.r.choice(("ul", "ul", "ol")), "", [Part("li", "", [self.link()]) for _ in range(n)])
        return Part("div", "", [" | ".join(self.link(1, 2) for _ in range(n))])

    def menu(self) -> Part:
        return self.r.choice(
            (
                lambda: Part("nav", self.r.choice(("", self.named("nav", "menu", "breadcrumb"))), [self.links()]),
                lambda: Part("div", self.named("nav", "menu", "navbar", "breadcrumbs", "navigation"), [self.links()]),
                lambda: Part("ul", self.named("menu", "nav", "tabs", "pagination"), [Part("li", "", [self.link(1, 3)]) for _ in range(self.r.randint(3, 9))]),
            )
        )()

    def head(self) -> Part:
        inside = [Part(self.r.choice(("div", "p", "h2", "h1")), self.r.choice(("", self.named("logo", "branding"))), [self.words(1, 5)])]
        if self.r.random() < 0.6:
            inside.append(self.menu())
        if self.r.random() < 0.4:
            inside.append(Part("p", "", [self.prose(1, 2)]))
        return Part("header", self.r.choice(("", self.named("header", "masthead"))), inside) if self.r.random() < 0.6 else Part("div", self.named("header", "masthead", "topbar", "banner"), inside)

    def foot(self) -> Part:
        inside = self.r.choice(([f"&copy; {self.words(1, 4)} &middot; {self.prose(1, 2)}"], [Part("p", "", [f"&copy; {self.words(2, 9)}"]), self.links(2, 5)], [Part("p", "", [self.prose(1, 4)])]))
        return Part("footer", self.r.choice(("", self.named("footer"))), inside) if self.r.random() < 0.65 else Part("div", self.named("footer", "copyright", "legal", "colophon"), inside)

    def texts(self) -> list:
        """Anything that could be said outside the article, short or long."""
        return self.r.choice(
            (
                [self.prose(1, 3)],
                [Part("p", "", [self.marked(self.prose(1, 5))])],
                [Part("h3", "", [self.words(1, 6)]), Part("p", "", [self.prose(1, 4)])],
                [Part("h3", "", [self.words(1, 4)]), self.links(2, 7)],
                [Part("p", "", [self.prose(1, 3)]), Part("p", "", [self.prose(1, 3)])],
                [Part("div", "", [self.prose(1, 2)])],
            )
        )

    def advert(self) -> Part:
        tag = self.r.choice(("div", "div", "aside", "section", "p"))
        return Part(tag, self.named("ad", "ads", "advert", "advertisement", "sponsored", "promo", "sponsor", "banner"), [self.prose(1, 4)] if tag == "p" or self.r.random() < 0.5 else self.texts())

    def side(self) -> Part:
        inside = [x for _ in range(self.r.randint(1, 3)) for x in self.texts()]
        return Part("aside", self.r.choice(("", self.named("sidebar", "related"))), inside) if self.r.random() < 0.5 else Part(self.r.choice(("div", "section")), self.named("sidebar", "related", "recommended", "widget", "trending", "rail", "popular"), inside)

    def notice(self) -> Part:
        inside = [*self.texts()]
        if self.r.random() < 0.4:
            inside.append(Part("button", "", [self.words(1, 2)]))
        tag = self.r.choice(("div", "div", "section", "aside", "p", "dialog"))
        return Part(tag, self.named("cookie", "notice", "consent", "gdpr", "newsletter", "subscribe", "modal", "popup", "alert", "cookies"), inside if tag != "p" and self.r.random() < 0.8 else [self.prose(1, 3)])

    def form(self) -> Part:
        inside = [Part("label", "", [self.words(1, 4)]), "<input name='q'>"] if self.r.random() < 0.5 else [Part("p", "", [self.prose(1, 2)]), "<input name='q'>"]
        inside = [x for x in inside if not (isinstance(x, Part) and x.tag == "label")] + ([f"<label>{self.words(1, 3)}</label>"] if self.r.random() < 0.6 else [])
        if self.r.random() < 0.5:
            inside.append(Part("select", "", [Part("option", "", [self.words(1, 3)])]))
        if self.r.random() < 0.6:
            inside.append(Part("button", "", [self.words(1, 2)]))
        return Part("form", self.r.choice(("", self.named("search", "login", "form", "contact"))), inside)

    def comments(self) -> Part:
        def one() -> Part:
            who = self.r.choice(([], [Part("div", self.named("author", "meta"), [self.words(1, 3)])], [f"<b>{self.words(1, 2)}</b> "]))
            return Part(self.r.choice(("li", "div", "article")), self.r.choice(("", self.named("comment", "reply"))), [*who, Part("p", "", [self.prose(1, 5)])])

        n = self.r.randint(1, 6)
        items = [one() for _ in range(n)]
        if all(i.tag == "li" for i in items):
            items = [Part("ol", "", items)]
        else:
            for i in items:
                i.tag = "div" if i.tag == "li" else i.tag
        top = [Part("h3", "", [self.words(1, 3)])] if self.r.random() < 0.6 else []
        return Part(self.r.choice(("section", "div", "div")), self.named("comments", "discussion", "responses comments", "comment-list", "disqus"), [*top, *items, *([self.form()] if self.r.random() < 0.3 else [])])

    def share(self) -> Part:
        return Part(self.r.choice(("div", "ul")), self.named("share", "social", "sharing"), [self.link(1, 2)]) if self.r.random() < 0.5 else Part("div", self.named("tags", "social", "share"), [" ".join(self.link(1, 1) for _ in range(3))])

    def raw(self) -> Part:
        return Part(self.r.choice(("script", "style")), "", [f"var x{self.r.randint(1, 99)} = '<p>{self.words(1, 9)}</p>';"])

    # ---- main text

    def block(self) -> Part:
        kind = self.r.random()
        if kind < 0.7:
            return Part("p", "", [self.marked(self.prose(1, 7))], True)
        if kind < 0.78:
            return Part(self.r.choice(("h2", "h3")), "", [self.words(1, 8)], True)
        if kind < 0.86:
            return Part(self.r.choice(("ul", "ol")), "", [Part("li", "", [self.marked(self.prose(1, 2)) if self.r.random() < 0.7 else self.words(1, 6)], True) for _ in range(self.r.randint(2, 6))], True)
        if kind < 0.91:
            return Part("blockquote", "", [self.prose(1, 3)] if self.r.random() < 0.5 else [Part("p", "", [self.prose(1, 3)], True)], True)
        if kind < 0.94:
            return Part("div", "", [self.prose(1, 4)], True)
        if kind < 0.97:
            return Part("figure", "", ["<img src='x'>", Part("figcaption", "", [self.prose(1, 1)], True)], True)
        rows = [Part("tr", "", [Part("td", "", [self.words(1, 4)], True) for _ in range(3)], True) for _ in range(self.r.randint(1, 4))]
        return Part("table", "", [Part("tbody", "", rows, True)], True)

    def article(self) -> Part:
        inside: list = []
        title = Part("h1", "", [self.words(1, 10) if self.r.random() < 0.6 else self.sentence()], True) if self.r.random() < 0.85 else None
        if title:
            inside.append(title)
        inside += [self.block() for _ in range(self.r.choice((1, 1, 2, 3, 5, 8, 14, 25)))]
        for part in (self.advert, self.side, self.share, self.form, self.notice, self.raw, self.menu):
            if self.r.random() < 0.12:
                inside.insert(self.r.randint(1, len(inside)), part())
        if self.r.random() < 0.15:
            inside.append(self.comments())
        tag, names = self.r.choice(
            (
                ("article", ""),
                ("article", ""),
                ("article", self.named("post", "entry", "story")),
                ("main", ""),
                ("main", self.named("content")),
                ("div", self.named("content", "article", "post", "entry", "story", "main", "article-body", "post-content", "text")),
                ("section", self.named("content", "article", "story")),
                ("div", ""),
            )
        )
        if title and tag == "article" and self.r.random() < 0.25:
            inside[inside.index(title)] = Part("header", "", [title], True)
        out = Part(tag, names, inside, True)
        if self.r.random() < 0.3:
            out = Part(self.r.choice(("main", "div", "section")), self.r.choice(("", self.named("content", "main", "container", "wrapper"))), [out, *(f() for f in (self.comments, self.side, self.form, self.share) if self.r.random() < 0.2)], True)
        return out

    def page(self) -> tuple[str, list[int]]:
        before = [f() for f in (self.head, self.menu, self.notice, self.advert, self.form, self.raw) if self.r.random() < 0.4]
        after = [f() for f in (self.foot, self.side, self.comments, self.advert, self.notice, self.form, self.raw, self.menu) if self.r.random() < 0.4]
        self.r.shuffle(before)
        self.r.shuffle(after)
        body: list = [*before, self.article(), *after]
        if self.r.random() < 0.25:
            body = [Part("div", self.r.choice(("", self.named("wrapper", "container", "page", "layout"))), body)]
        top = Part("head", "", ["<meta charset='utf-8'>", Part("title", "", [self.words(1, 8)]), *([self.raw()] if self.r.random() < 0.5 else [])])
        page = Part("html", "", [top, Part("body", "", body)])
        labels = [page.label]
        gap = self.r.choice(("", "", "\n", "\n  "))

        def write(part) -> str:
            if isinstance(part, str):
                return part
            labels.append(part.label)
            inner = gap.join(write(c) for c in part.content)
            end = "" if part.tag in ("p", "li") and self.r.random() < 0.03 and not any(isinstance(c, Part) for c in part.content) else f"</{part.tag}>"
            return f"<{part.tag}{part.names}>{inner}{end}"

        return "<!DOCTYPE html>" + write(page), labels
