"""Labelled pages for training: made from templates, with random words, so the labels are known block by block.

The vocabularies below are names that web authors give to parts of a page; they are the training data's lexicon, a free choice, and not
rules.
"""

from __future__ import annotations

import random

#: Class and id names of parts that are not the article.
CHROME = {
    "nav": "nav navbar menu mainmenu navigation breadcrumb breadcrumbs toc topnav submenu pager pagination tabs links sitemap".split(),
    "header": "header masthead top topbar banner logo branding site tagline hero".split(),
    "footer": "footer foot bottom copyright legal colophon imprint credits disclaimer".split(),
    "side": "sidebar aside side widget related recommended trending popular latest more tags categories archive teaser rail blogroll author bio".split(),
    "notice": "cookie cookies consent gdpr notice alert privacy popup modal overlay message paywall subscribe warning announcement toast dialog".split(),
    "ad": "ad ads advert adverts advertisement advertising sponsored sponsor promo promotion banner adsense adbox commercial affiliate partner dfp".split(),
    "form": "form login signup newsletter search register contact subscription poll feedback".split(),
    "comments": "comment comments commentlist discussion replies reply respond disqus thread reactions responses reviews".split(),
    "social": "share social sharing follow buttons toolbar tools print rating likes meta date byline".split(),
}
#: Class and id names of the article and what stands around it.
ARTICLE = "article content post entry story text body main maincontent articlebody postbody entrycontent page prose column copy".split()
_TAGS = {
    "nav": ["nav", "ul", "div", "header", "menu"],
    "header": ["header", "div", "section"],
    "footer": ["footer", "div", "section"],
    "side": ["aside", "div", "section"],
    "notice": ["div", "section", "aside", "dialog"],
    "ad": ["div", "aside", "section", "ins"],
    "form": ["form", "div", "section"],
    "comments": ["section", "div", "ol", "aside"],
    "social": ["div", "ul", "p", "section"],
}


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        r = self.r
        self.syllables = ["".join(r.choice("bcdfghklmnprstvwz") for _ in range(r.randint(0, 2))) + r.choice(["a", "e", "i", "o", "u", "é", "ü"]) + r.choice(["", "n", "r", "s", "t"]) for _ in range(60)]
        self.out: list[str] = []
        self.labels: list[int] = []
        self.plain = r.random() < 0.15  # no class names at all
        self.junk = r.random() < 0.3

    def words(self, low: int, high: int) -> str:
        r = self.r
        w = ["".join(r.choice(self.syllables) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high))]
        if self.junk:
            style = r.randint(0, 3)
            w = [x.upper() + "!!" for x in w] if style == 0 else [x + r.choice(["***", "&amp;&amp;", "$$$", "%%%"]) for x in w] if style == 1 else [x + " |" for x in w] if style == 2 else w
        w[0] = w[0].capitalize()
        return " ".join(w)

    def sentences(self, low: int, high: int) -> str:
        return " ".join(self.words(3, 14) + self.r.choice([".", ".", ".", "?", "!"]) for _ in range(self.r.randint(low, high)))

    def names(self, kind: str) -> str:
        r = self.r
        if self.plain:
            return ""
        pool = ARTICLE if kind == "article" else CHROME[kind]
        name = r.choice(pool) + (r.choice(["", "", "-" + r.choice(["box", "wrap", "inner", "container", "list", "item", "area", "block", "1"])]))
        return r.choice([f' class="{name}"', f' id="{name}"', f' class="{name} c{r.randint(1, 9)}"', f" class={name.split()[0]}"])

    def put(self, tag: str, text: str, label: int, attrs: str = "", close: bool = True) -> None:
        self.out.append(f"<{tag}{attrs}>{text}" + (f"</{tag}>" if close else ""))
        self.labels.append(label)

    def inline(self, text: str) -> str:
        r = self.r
        if r.random() < 0.25:
            w = text.split(" ")
            i = r.randrange(len(w))
            t = r.choice(["b", "i", "em", "a href='/x'", "span", "strong", "code"])
            w[i] = f"<{t}>{w[i]}</{t.split()[0]}>"
            text = " ".join(w)
        return text

    def chrome(self, kind: str) -> None:
        r = self.r
        tag = r.choice(_TAGS[kind])
        semantic = tag in ("nav", "header", "footer", "aside", "form", "dialog")
        if self.plain and not semantic:
            tag = _TAGS[kind][0]
        names = self.names(kind) if not (semantic and r.random() < 0.5) else ""
        if self.plain and tag in ("div", "section", "ins", "ul", "ol", "p", "menu"):
            tag = {"ad": "aside", "notice": "dialog", "social": "nav", "comments": "aside"}.get(kind, tag)
        if kind in ("nav", "social", "side") and r.random() < 0.75:
            inner = "li" if tag in ("ul", "menu") or r.random() < 0.7 else "a"
            wrap = tag not in ("ul", "menu") and inner == "li"
            self.out.append(f"<{tag}{names}>" + ("<ul>" if wrap else ""))
            if kind == "side" and r.random() < 0.6:
                self.put(r.choice(["h2", "h3", "h4"]), self.words(1, 3), 0)
            if inner == "li":
                for _ in range(r.randint(2, 8)):
                    self.put("li", f'<a href="/{r.randint(1, 99)}">{self.words(1, 6 if kind == "side" else 2)}</a>', 0, close=r.random() < 0.8)
            else:
                self.out.append(" ".join(f'<a href="/">{self.words(1, 2)}</a>' for _ in range(r.randint(2, 6))))
                self.labels.append(0)
            self.out.append(("</ul>" if wrap else "") + f"</{tag}>")
            return
        if tag in ("ul", "ol", "menu"):
            self.out.append(f"<{tag}{names}>")
            for _ in range(r.randint(1, 4)):
                self.put("li", self.sentences(1, 3), 0)
            self.out.append(f"</{tag}>")
            return
        if kind == "form":
            self.out.append(f"<{tag}{names}>" + ("" if tag == "form" else "<form action='/s'>"))
            self.put("label", self.words(1, 3) + ' <input type="text">', 0, close=False) if r.random() < 0.5 else self.put("p", self.words(2, 8), 0)
            self.out.append(f"<button>{self.words(1, 2)}</button>" + ("" if tag == "form" else "</form>"))
            self.labels.append(0)
            self.out.append(f"</{tag}>")
            return
        if kind == "comments":
            self.out.append(f"<{tag}{names}>")
            if r.random() < 0.6:
                self.put(r.choice(["h2", "h3"]), self.words(1, 3), 0)
            for _ in range(r.randint(1, 4)):
                inner = r.choice(["div", "article", "li"]) if not self.plain else "div"
                self.out.append(f"<{inner}" + ("" if self.plain else f' class="{r.choice(CHROME["comments"])}"') + ">")
                for _ in range(r.randint(1, 2)):
                    self.put("p", self.inline(self.sentences(1, 4)), 0)
                self.out.append(f"</{inner}>")
            self.out.append(f"</{tag}>")
            return
        n = r.randint(1, 2)
        if n == 1 and r.random() < 0.6:
            text = self.sentences(1, 2)
            if kind == "footer":
                text = r.choice(["&copy; ", "Copyright ", ""]) + f"{r.randint(1999, 2025)} {text}"
            self.put(tag, text, 0, names)
            return
        self.out.append(f"<{tag}{names}>")
        for _ in range(n):
            text = self.inline(self.sentences(1, 2))
            if kind == "footer" and r.random() < 0.5:
                text = r.choice(["&copy; ", "Copyright "]) + text
            self.put(r.choice(["p", "div", "p", "h2" if kind in ("header", "side") else "p"]), text, 0)
        self.out.append(f"</{tag}>")

    def article(self) -> None:
        r = self.r
        tag = r.choice(["article", "article", "article", "main", "div", "div", "section", "td"])
        names = self.names("article") if r.random() < 0.5 or tag not in ("article", "main") else ""
        outer = r.choice(["", "", "main", "div", "section"])
        before, after = ("<table><tr>", "</tr></table>") if tag == "td" else ("", "")
        self.out.append((f"<{outer}>" if outer else "") + before + f"<{tag}{names}>")
        if r.random() < 0.8:
            self.put(r.choice(["h1", "h1", "h2"]), self.words(2, 9), 1)
        if r.random() < 0.1:
            self.chrome("social")
        for _ in range(r.randint(1, 14) if r.random() < 0.9 else r.randint(1, 2)):
            x = r.random()
            if x < 0.70:
                text = self.inline(self.words(1, 2) + "." if r.random() < 0.12 else self.sentences(1, 7))
                if r.random() < 0.1:
                    text = f"<b>{text}<br>"
                self.put("p", text, 1, close=r.random() < 0.85)
            elif x < 0.77:
                self.put(r.choice(["h2", "h3", "h4"]), self.words(1, 6), 1)
            elif x < 0.84:
                self.out.append("<ul>")
                for _ in range(r.randint(2, 4)):
                    self.put("li", self.inline(self.words(2, 12)), 1)
                self.out.append("</ul>")
            elif x < 0.88:
                self.put("blockquote", self.sentences(1, 3), 1)
            elif x < 0.91:
                self.out.append("<table><tr>")
                for _ in range(r.randint(2, 4)):
                    self.put("td", self.words(1, 3), 1)
                self.out.append("</tr></table>")
            elif x < 0.93:
                self.put("pre", self.words(4, 15), 1)
            elif x < 0.97:
                self.chrome("ad")
            else:
                self.chrome(r.choice(["side", "notice", "form", "social"]))
        if r.random() < 0.12:
            self.chrome(r.choice(["comments", "social", "side"]))
        self.out.append(f"</{tag}>" + after + (f"</{outer}>" if outer else ""))

    def page(self) -> tuple[str, list[int]]:
        r = self.r
        self.out.append("<!DOCTYPE html><html><head><title>" + self.words(2, 6) + "</title><style>p{}</style></head><body>")
        if r.random() < 0.02:
            self.out.append(self.sentences(2, 6))
            self.labels.append(1)
            return "".join(self.out) + "</body></html>", self.labels
        if r.random() < 0.12:
            self.out.append(f"<noscript>{self.sentences(1, 2)}</noscript>")
            self.labels.append(0)
            self.out.append("<div>")
        for kind, chance in (("notice", 0.3), ("header", 0.5), ("nav", 0.8), ("ad", 0.5), ("form", 0.2), ("side", 0.25)):
            if r.random() < chance:
                self.chrome(kind)
        self.article()
        for kind, chance in (("social", 0.2), ("ad", 0.3), ("comments", 0.4), ("side", 0.4), ("form", 0.2), ("nav", 0.15), ("notice", 0.15), ("footer", 0.8)):
            if r.random() < chance:
                self.chrome(kind)
        return "".join(self.out) + "<script>var x='<p>no</p>';</script></body></html>", self.labels


def labelled_pages(n: int = 700, seed: int = 1) -> list[tuple[str, list[int]]]:
    """``n`` pages, each with the label of its leaf blocks in order: 1 for the article's."""
    return [Maker(seed * 1_000_003 + i).page() for i in range(n)]
