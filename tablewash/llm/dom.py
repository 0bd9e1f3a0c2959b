"""Pages as trees of block elements and runs of text, with features of every node."""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

BLOCKS = frozenset(
    "html body div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption section article main "
    "aside nav header footer form fieldset figure figcaption blockquote pre address details summary center dialog menu".split())
#: Elements whose text is never read: code, the head, and fields of forms.
SILENT = frozenset("script style template head title select option textarea button".split())
FIELDS = frozenset("select option textarea button".split())
IN_HEAD = frozenset("title meta link base style script noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: A start tag ends open elements of these kinds, up to the element after the bar.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
TAGS = ("#text", "html", "body", "div", "section", "article", "main", "p", "h", "list", "li", "table", "cell", "nav",
        "header", "footer", "aside", "form", "quote", "other")
KIND = {
    **{f"h{i}": "h" for i in range(1, 7)}, **dict.fromkeys(("ul", "ol", "dl", "menu"), "list"),
    **dict.fromkeys(("li", "dt", "dd"), "li"), **dict.fromkeys(("table", "thead", "tbody", "tfoot", "tr", "caption"), "table"),
    **dict.fromkeys(("td", "th"), "cell"), **dict.fromkeys(("form", "fieldset", "dialog"), "form"),
    **dict.fromkeys(("blockquote", "pre", "figure", "figcaption"), "quote"),
}
#: Words in class, id and role that tell what a part of a page is for.
HINTS = {
    "content": "article content post entry main story text body prose",
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion banner",
    "menu": "nav navbar menu breadcrumb breadcrumbs navigation pagination pager toc tabs",
    "head": "header masthead topbar logo brand",
    "foot": "footer copyright colophon legal",
    "side": "sidebar side aside widget related recommended more",
    "notice": "cookie cookies consent notice alert gdpr privacy popup modal overlay toast",
    "comment": "comment comments reply replies respond disqus discussion",
    "share": "share social follow newsletter subscribe signup tags meta byline",
    "form": "form login search contact register",
}
_HINT = {word: i for i, words in enumerate(HINTS.values()) for word in words.split()}
_TAG = {t: i for i, t in enumerate(TAGS)}
N_TAGS, N_HINTS = len(TAGS), len(HINTS)
FEATURES = 1 + 2 * N_TAGS + 2 * N_HINTS + 8


class Page(HTMLParser):
    """The nodes of a page in order: kind, parent, hints, and for runs of text the text."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.kind, self.parent, self.hints, self.text = [], [], [], []
        self.linked, self.depth = [], []
        self.open: list[tuple[str, int]] = []  # block elements: tag, node
        self.silent: list[str] = []
        self.inner: list[str] = []  # block elements inside a silent one
        self.links, self.run, self.run_linked = 0, [], 0
        self._add("other", -1, ())
        self.feed(html)
        self.close()
        self._flush()

    def _add(self, kind: str, parent: int, hints: tuple, text: str = "", linked: int = 0) -> int:
        self.kind.append(_TAG[kind])
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.hints.append(hints)
        self.text.append(text)
        self.linked.append(linked)
        return len(self.kind) - 1

    def _top(self) -> int:
        return self.open[-1][1] if self.open else 0

    def _flush(self) -> None:
        if self.run:
            text = " ".join("".join(self.run).split())
            if text:
                self._add("#text", self._top(), (), text, min(self.run_linked, len(text)))
            self.run, self.run_linked = [], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.silent:
            if self.silent[-1] == "head" and tag not in IN_HEAD or self.silent[0] in FIELDS and tag in BLOCKS:
                # What cannot be inside ends what was not closed.
                self.silent, self.inner = [], []
            else:
                if tag in BLOCKS:
                    self.inner.append(tag)
                if tag in SILENT and tag not in VOID:
                    self.silent.append(tag)
                return
        if tag in SILENT:
            self.silent.append(tag)
        elif tag == "br":
            self.run.append(" ")
        elif tag == "hr":
            self._flush()
        elif tag == "a":
            self.links = 1
        elif tag in BLOCKS:
            self._flush()
            if tag in ("html", "body") and any(t == tag for t, _ in self.open):
                return
            self._implied(tag)
            words = [w for k, v in attrs if v and k in ("class", "id", "role") for w in re.split(r"[^a-z]+", v.lower())]
            hints = tuple({_HINT[w] for w in words if w in _HINT})
            kind = KIND.get(tag, tag if tag in _TAG else "other")
            self.open.append((tag, self._add(kind, self._top(), hints)))

    def _implied(self, tag: str) -> None:
        """End what a start tag ends: an open paragraph, or the list item, row or cell before it."""
        if self.open and self.open[-1][0] == "p":
            self.open.pop()
        ends, within = ENDS.get(tag, ((), ()))
        for k in range(len(self.open) - 1, -1, -1):
            if not ends or self.open[k][0] in within:
                return
            if self.open[k][0] in ends:
                del self.open[k:]
                if tag != "tr":
                    return

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag in SILENT and self.silent and self.silent[-1] == tag:
            self.silent.pop()

    def handle_endtag(self, tag: str) -> None:
        if tag in SILENT:
            if tag in self.silent:
                del self.silent[len(self.silent) - 1 - self.silent[::-1].index(tag) :]
                self.inner = self.inner if self.silent else []
            return
        if self.silent:
            if tag in self.inner:
                del self.inner[len(self.inner) - 1 - self.inner[::-1].index(tag) :]
                return
            if not any(t == tag for t, _ in self.open):
                return
            # The end of an element around it ends what was not closed.
            self.silent, self.inner = [], []
        if tag == "a":
            self.links = 0
        elif tag in BLOCKS:
            self._flush()
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][0] == tag:
                    del self.open[k:]
                    break

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.run.append(data)
            if self.links:
                self.run_linked += len(data.strip())

    def features(self) -> list[list[float]]:
        """One row per node: its kind, its parent's kind, its hints, those of any ancestor, and
        figures on the text below it: amount, share in links, signs that end or part sentences."""
        n = len(self.kind)
        chars, linked, signs, runs = [0] * n, [0] * n, [0] * n, [0] * n
        for i in range(n - 1, -1, -1):
            t = self.text[i]
            if t:
                chars[i], linked[i], runs[i] = len(t), self.linked[i], 1
                signs[i] = t.count(".") + t.count(",")
            p = self.parent[i]
            if p >= 0:
                chars[p] += chars[i]
                linked[p] += linked[i]
                signs[p] += signs[i]
                runs[p] += runs[i]
        total = max(1, chars[0])
        above: list[frozenset] = []
        out = []
        for i in range(n):
            row = [0.0] * FEATURES
            row[0] = 1.0
            row[1 + self.kind[i]] = 1.0
            p = self.parent[i]
            row[1 + N_TAGS + (self.kind[p] if p >= 0 else 0)] = 1.0
            for h in self.hints[i]:
                row[1 + 2 * N_TAGS + h] = 1.0
            inherited = above[p] | frozenset(self.hints[p]) if p >= 0 else frozenset()
            above.append(inherited)
            for h in inherited:
                row[1 + 2 * N_TAGS + N_HINTS + h] = 1.0
            size = chars[i]
            row[-8:] = (
                math.log1p(size) / 8, linked[i] / size if size else 0.0, min(1.0, 20 * signs[i] / size) if size else 0.0,
                size / total, 1.0 if size == 0 else 0.0, 1.0 if 0 < size < 40 else 0.0, min(1.0, runs[i] / 20),
                math.log1p(size / max(1, runs[i])) / 8)
            out.append(row)
        return out
