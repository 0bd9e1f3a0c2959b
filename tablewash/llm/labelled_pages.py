"""Labelled pages: made from layouts whose parts are known, with invented words."""

from __future__ import annotations

import random

_SYLLABLES = "an re tion la is ou ei ver sch en que ar mo li ta ker str über éa ñor qui do sen pa".split()


class _Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.blocks: list[str] = []
        self.vocabulary = ["".join(self.r.choices(_SYLLABLES, k=self.r.randint(1, 4))) for _ in range(600)]

    def words(self, low: int, high: int) -> str:
        r = self.r
        some = r.choices(self.vocabulary, k=r.randint(low, high))
        style = r.random()
        if style < 0.06:
            some = [w + r.choice(("***", "###", "%%%", "$$$")) for w in some]
        elif style < 0.1:
            some = [w.upper() + "!!" for w in some]
        elif style < 0.14:
            some = " | ".join(some).split(" ")
        else:
            some = [w + r.choice(("", "", "", "", "", ",", ".")) for w in some]
            some[-1] = some[-1].rstrip(",.") + "."
        some[0] = some[0].capitalize()
        return " ".join(some)

    def short(self) -> str:
        return " ".join(self.r.choices(self.vocabulary, k=self.r.randint(1, 5)))

    def named(self, tag: str, names: str, inner: str) -> str:
        """``inner`` in an element that may be named by one of ``names``."""
        r, name = self.r, ""
        if names and r.random() < 0.85:
            name = f' {r.choice(("class", "class", "id"))}="{r.choice(names.split())}{r.choice(("", "", "-1", " box"))}"'
        return f"<{tag}{name}>{inner}</{tag}>"

    def links(self, low: int = 2, high: int = 9) -> str:
        items = [f'<a href="/{i}">{self.short()}</a>' for i in range(self.r.randint(low, high))]
        return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>" if self.r.random() < 0.7 else " ".join(items)

    def paragraph(self, keep: bool, low: int = 1, high: int = 160) -> str:
        text = self.words(low, self.r.choice((8, 40, high)))
        if keep:
            self.blocks.append(" ".join(text.split()))
        first, _, rest = text.partition(" ")
        style = self.r.random()
        if rest and style < 0.15:
            return f'<p><a href="#">{first}</a> {rest}</p>'
        if rest and style < 0.25:
            return f"<p><em>{first}</em>\n  {rest}</p>"
        if style < 0.4:
            return f"<p><b>{text}<br>"
        return f"<p>{text}</p>" if style < 0.95 else f"<p>{text}"

    def content(self) -> str:
        r, out = self.r, []
        title = self.words(1, 12)
        if r.random() < 0.85:
            self.blocks.append(title)
            out.append(f"<h1>{title}</h1>")
        for _ in range(r.choice((1, 2, 4, 8, 15))):
            kind = r.random()
            if kind < 0.78:
                out.append(self.paragraph(True))
            elif kind < 0.84:
                text = self.words(1, 6)
                self.blocks.append(text)
                out.append(f"<h2>{text}</h2>")
            elif kind < 0.89:
                items = [self.words(2, 20) for _ in range(r.randint(2, 5))]
                self.blocks += items
                out.append("<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>")
            elif kind < 0.92:
                text = self.words(5, 40)
                self.blocks.append(text)
                out.append(f"<blockquote>{text}</blockquote>")
            elif kind < 0.94:
                cells = [self.words(1, 4) for _ in range(4)]
                self.blocks += cells
                out.append("<table><tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr></table>")
            elif kind < 0.97:
                out.append(self.named("div", "ad ads advert sponsored promo", self.words(3, 20)))
            else:
                out.append(self.named(r.choice(("aside", "div")), "related share social newsletter more", self.links(2, 4)))
        return "".join(out)

    def comments(self) -> str:
        one = lambda: self.named("div", "comment reply", f"<p>{self.words(3, 60)}</p>")
        inner = f"<h3>{self.short()}</h3>" + "".join(one() for _ in range(self.r.randint(1, 5)))
        return f'<{(t := self.r.choice(("section", "div")))} {self.r.choice(("id", "class"))}="{self.r.choice(("comments", "comment-list", "discussion", "replies"))}">{inner}</{t}>'

    def page(self) -> tuple[str, list[str]]:
        r = self.r
        parts = []
        if r.random() < 0.4:
            parts.append(self.named(r.choice(("header", "header", "div")), "header masthead topbar", f"<p>{self.short()}</p>" + self.links(1, 3)))
        if r.random() < 0.85:
            parts.append(self.named(r.choice(("nav", "nav", "div")), "nav menu navbar breadcrumb", self.links()))
        if r.random() < 0.3:
            parts.append(self.named("div", "cookie-notice consent notice alert gdpr", f"<p>{self.words(4, 30)}</p>" if r.random() < 0.5 else self.words(4, 30)))
        if r.random() < 0.6:
            parts.append(f'<!-- ad --><div class="{r.choice(("ad", "ads", "banner", "advert", "sponsor"))}">{self.words(3, 30)}</div>')
        kind = r.random()
        inner = self.content()
        if r.random() < 0.3:
            inner = self.named("div", "content entry body", inner)
        if r.random() < 0.15:
            inner += self.comments()
        if kind < 0.6:
            main = f"<article>{inner}</article>"
        elif kind < 0.75:
            main = f"<main>{inner}</main>"
        else:
            main = f'<div {r.choice(("class", "id"))}="{r.choice(("content", "post", "article-body", "entry-content", "main", "story"))}">{inner}</div>'
        parts.append(main)
        if r.random() < 0.3:
            parts.append(self.comments())
        if r.random() < 0.3:
            parts.append(self.named(r.choice(("aside", "div")), "sidebar widget related side", f"<h3>{self.short()}</h3>" + self.links() + (f"<p>{self.words(3, 40)}</p>" if r.random() < 0.5 else "")))
        if r.random() < 0.25:
            parts.append(self.named("form", "search login contact newsletter", f"<p>{self.words(2, 12)}</p><input name=q><label>{self.short()}</label>"))
        if r.random() < 0.9:
            parts.append(self.named(r.choice(("footer", "footer", "div")), "footer copyright legal", r.choice(("&copy; ", "")) + self.words(2, 20)))
        head = f"<!DOCTYPE html><html><head><title>{self.short()}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>"
        return head + "".join(parts) + "</body></html>", self.blocks


def labelled_pages(n: int, seed: int = 0) -> list[tuple[str, list[str]]]:
    """``n`` pages, each with the blocks of its main text. The same for the same ``n`` and ``seed``."""
    return [_Maker(seed * 1_000_003 + i).page() for i in range(n)]
