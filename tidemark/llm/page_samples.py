"""Labelled sample pages for training: made-up words in varied page layouts.

Each page comes with the spans of its markup that are the article. Layouts vary
in elements, class names, order and carelessness (closing tags left out, pages cut
short), so that no single cue is enough.
"""

from __future__ import annotations

import random

_SYLLABLES = "ba de fi go lu ma ne po ri su ta vo ker lan mon per sol tin ver wen".split()


class _Maker:
    def __init__(self, rng: random.Random):
        self.rng = rng
        self.parts: list[str] = []
        self.spans: list[tuple[int, int]] = []
        self.size = 0
        self.careless = rng.random() < 0.4
        self.bare = rng.random() < 0.08  # no element around the article

    def put(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)

    def word(self) -> str:
        return "".join(self.rng.choices(_SYLLABLES, k=self.rng.choice((1, 1, 2, 2, 3))))

    def words(self, n: int) -> str:
        return " ".join(self.word() for _ in range(n))

    def sentence(self, low: int = 5, high: int = 18) -> str:
        return self.words(self.rng.randint(low, high)).capitalize() + self.rng.choice("...?!")

    def prose(self, n: int) -> str:
        out = []
        for _ in range(n):
            s = self.sentence()
            r = self.rng.random()
            if r < 0.08:
                s = f'{s} <a href="/{self.word()}">{self.words(2)}</a>'
            elif r < 0.14:
                s = f"<b>{self.words(2)}</b> {s}"
            elif r < 0.17:
                s = f"{s} &amp; <em>{self.word()}</em>"
            out.append(s)
        return " ".join(out)

    def element(self, tag: str, names: str, inside) -> None:
        self.put(f'<{tag} class="{names}">' if names else f"<{tag}>")
        inside()
        self.put(f"</{tag}>")

    def paragraph(self, n: int) -> None:
        self.put(f"<p>{self.prose(n)}" + ("" if self.careless and self.rng.random() < 0.4 else "</p>"))

    def links(self, n: int) -> None:
        close = "" if self.careless else "</li>"
        self.put("<ul>" + "".join(f'<li><a href="/{self.word()}">{self.words(self.rng.randint(1, 5))}</a>{close}' for _ in range(n)) + "</ul>")

    # Boilerplate of every kind.
    def menu(self) -> None:
        r = self.rng
        self.element(*r.choice((("nav", ""), ("nav", "menu"), ("div", "nav-bar"), ("div", "menu"), ("ul", "topnav"))), lambda: self.links(r.randint(3, 9)))

    def header(self) -> None:
        def inside() -> None:
            self.put(f'<a href="/">{self.words(2)}</a>')
            if self.rng.random() < 0.5:
                self.put(f"<p>{self.sentence(3, 8)}</p>")
            if self.rng.random() < 0.4:
                self.menu()

        self.element(*self.rng.choice((("header", ""), ("header", "site-header"), ("div", "header"), ("div", "masthead"))), inside)

    def footer(self) -> None:
        def inside() -> None:
            self.put(f"&copy; {self.word()}.example &middot; {self.sentence()}")
            if self.rng.random() < 0.5:
                self.links(self.rng.randint(2, 5))
            if self.rng.random() < 0.4:
                self.put(f"<p>{self.sentence(6, 14)}</p>")

        self.element(*self.rng.choice((("footer", ""), ("footer", "site-footer"), ("div", "footer"))), inside)

    def sidebar(self) -> None:
        def inside() -> None:
            self.put(f"<h3>{self.words(2)}</h3>")
            if self.rng.random() < 0.7:
                self.links(self.rng.randint(2, 6))
            if self.rng.random() < 0.6:
                self.put(f"<p>{self.prose(self.rng.randint(1, 3))}</p>")

        self.element(*self.rng.choice((("aside", ""), ("aside", "sidebar"), ("div", "sidebar"), ("div", "widget"), ("div", "related"))), inside)

    def advert(self) -> None:
        text = self.prose(self.rng.randint(1, 3))
        self.element(*self.rng.choice((("div", "ad"), ("div", "advert banner"), ("div", "sponsored"), ("section", "promo"), ("aside", "ads"))), lambda: self.put(self.rng.choice((text, f"<p>{text}</p>"))))

    def notice(self) -> None:
        def inside() -> None:
            self.put(f"<p>{self.prose(self.rng.randint(1, 2))}</p>")
            if self.rng.random() < 0.5:
                self.put(f"<button>{self.word()}</button>")

        self.element(*self.rng.choice((("div", "cookie-notice"), ("div", "notice"), ("div", "consent"), ("div", "alert"), ("section", "banner notice"), ("div", "popup"))), inside)

    def form(self) -> None:
        def inside() -> None:
            self.put(f"<p>{self.sentence()}</p><label>{self.words(2)}</label><input name='x'><button>{self.word()}</button>")

        self.element(*self.rng.choice((("form", ""), ("form", "search"), ("form", "newsletter"))), inside)

    def comments(self) -> None:
        def inside() -> None:
            self.put(f"<h3>{self.words(2)}</h3>")
            for _ in range(self.rng.randint(1, 5)):
                self.element(*self.rng.choice((("div", "comment"), ("li", "comment"), ("article", "comment"))), lambda: self.put(f"<p>{self.prose(self.rng.randint(1, 3))}</p>"))

        self.element(*self.rng.choice((("div", "comments"), ("section", "comments"), ("ol", "comment-list"), ("section", "discussion responses"))), inside)

    # The article.
    def article(self) -> None:
        r = self.rng

        def body() -> None:
            if r.random() < 0.85:
                heading = self.words(r.randint(1, 9)).capitalize()
                self.put(f"<header><h1>{heading}</h1></header>" if r.random() < 0.2 else f"<h1>{heading}</h1>")
            for _ in range(r.choice((0, 1, 1, 2, 3, 4, 6, 9, 14))):
                k = r.random()
                if k < 0.72:
                    self.paragraph(r.randint(1, 7))
                elif k < 0.8:
                    self.put(f"<h2>{self.words(r.randint(1, 5))}</h2>")
                elif k < 0.86:
                    self.put("<ul>" + "".join(f"<li>{self.sentence(2, 10)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
                elif k < 0.9:
                    self.put(f"<blockquote><p>{self.prose(2)}</p></blockquote>")
                elif k < 0.93:
                    self.put(f"<table><tr><td>{self.words(2)}</td><td>{self.words(3)}</td></tr></table>")
                elif k < 0.96:
                    self.put(f"<pre>{self.words(8)}</pre>")
                else:
                    self.element(r.choice(("div", "section")), "", lambda: self.paragraph(r.randint(1, 4)))
                if r.random() < 0.04:
                    self.spans[-1] = (self.spans[-1][0], self.size)
                    r.choice((self.advert, self.sidebar))()
                    self.spans.append((self.size, 0))
            if self.careless and r.random() < 0.5:
                self.put(f"<p><b>{self.prose(1)}<br>")

        self.spans.append((self.size, 0))
        if self.bare:
            body()
            self.spans[-1] = (self.spans[-1][0], self.size)
            return
        self.element(*r.choice((("article", ""), ("article", ""), ("article", "post"), ("main", ""), ("div", "content"), ("div", "entry-content"), ("section", "article-body"), ("div", "post"), ("div", "story"), ("div", "x1"))), body)
        self.spans[-1] = (self.spans[-1][0], self.size)

    def page(self) -> tuple[str, list[tuple[int, int]]]:
        r = self.rng
        self.put(f'<!DOCTYPE html><html><head><title>{self.words(4)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>')
        before = [f for f, p in ((self.notice, 0.25), (self.header, 0.5), (self.menu, 0.7), (self.advert, 0.6), (self.form, 0.2), (self.sidebar, 0.2)) if r.random() < p]
        if r.random() < 0.3:
            r.shuffle(before)
        for f in before:
            f()
        wrapped = r.random() < 0.35 and not self.bare
        if wrapped:
            self.put(r.choice(('<div class="wrapper">', '<div id="page">', "<div>", "<main>")))
        self.article()
        for f, p in ((self.advert, 0.3), (self.form, 0.2), (self.comments, 0.4), (self.sidebar, 0.4)):
            if r.random() < p:
                f()
        if wrapped:
            self.put("</div>")
        for f, p in ((self.notice, 0.2), (self.footer, 0.9)):
            if r.random() < p:
                f()
        self.put("</body></html>")
        page = "".join(self.parts)
        if r.random() < 0.1:
            page = page[: r.randint(len(page) * 2 // 3, len(page))]
        return page, self.spans


def sample_pages(n: int, seed: int) -> list[tuple[str, list[tuple[int, int]]]]:
    """n pages with the article's spans of each."""
    return [_Maker(random.Random(f"{seed}-{i}")).page() for i in range(n)]
