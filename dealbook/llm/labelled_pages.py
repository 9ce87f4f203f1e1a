"""Labelled training pages for the block classifier.

Pages are put together from many layouts of the kinds of sections that sites
have; every section says whether its blocks are main text. The words are
invented, so a model can only learn from structure and from the shape of text.
"""

from __future__ import annotations

import random

#: A control character may not stand in an attribute's name, so no page of the web has this one.
LABEL_ATTRIBUTE = "\x01main"

_SYLLABLES = ("ba ko ri ten mo sul ka ver no lin da per to mi gra chu el on ur as ent tion ing").split()
# Containers and the class or id names that sites give them; '' is a bare element.
_MAIN = [("article", ""), ("article", "class=post"), ("main", ""), ("main", "id=main"), ("div", "id=content"),
         ("div", "class=content"), ("div", "class=post-body"), ("div", "class=entry-content"), ("div", "class=article-body"),
         ("div", "class=story"), ("section", "class=article"), ("div", "itemprop=articleBody"), ("td", "class=text"),
         ("div", "class=page-content"), ("div", "")]
_MENU = [("nav", ""), ("nav", "class=navbar"), ("div", "class=menu"), ("div", "id=nav"), ("ul", "class=nav"),
         ("div", "class=breadcrumbs"), ("div", "class=navigation"), ("div", "class=toc"), ("div", "class=pagination"),
         ("div", "role=navigation"), ("div", "class=tabs"), ("div", "class=skip-link")]
_HEADER = [("header", ""), ("header", "class=site-header"), ("div", "id=header"), ("div", "class=masthead"),
           ("div", "class=topbar"), ("div", "class=logo"), ("div", "role=banner")]
_SIDE = [("aside", ""), ("aside", "class=sidebar"), ("div", "class=sidebar"), ("div", "id=sidebar"), ("div", "class=widget"),
         ("div", "class=related"), ("div", "class=related-posts"), ("div", "class=recommended"), ("div", "class=trending"),
         ("section", "class=more-stories"), ("div", "class=author-box"), ("div", "class=share"), ("div", "class=social"),
         ("div", "class=tags"), ("div", "role=complementary")]
_ADVERT = [("div", "class=ad"), ("div", "class=ads"), ("div", "class=advert"), ("div", "class=advertisement"),
           ("aside", "class=ad"), ("div", "class=sponsored"), ("div", "class=sponsor"), ("div", "class=promo"),
           ("div", "class=promotion"), ("div", "class=banner"), ("div", "id=ad-top"), ("section", "class=ad-slot"),
           ("p", "class=ad"), ("div", "class=adsbygoogle")]
_NOTICE = [("div", "class=notice"), ("div", "class=cookie"), ("div", "class=cookie-banner"), ("div", "id=cookies"),
           ("div", "class=consent"), ("div", "class=gdpr"), ("div", "class=alert"), ("div", "class=popup"),
           ("div", "class=modal"), ("div", "class=newsletter"), ("div", "class=subscribe"), ("div", "class=paywall"),
           ("p", "class=notice"), ("section", "class=disclaimer"), ("div", "class=warning"), ("div", "role=alert"),
           ("div", "class=announcement"), ("dialog", "")]
_FORM = [("form", ""), ("form", "class=search"), ("div", "class=search-form"), ("form", "class=login"),
         ("form", "class=signup"), ("fieldset", "")]
_COMMENTS = [("section", "class=comments"), ("section", "id=comments"), ("div", "class=comments"), ("div", "id=comments"),
             ("div", "class=comment-list"), ("ol", "class=comment-list"), ("div", "class=responses"), ("div", "id=disqus"),
             ("div", "class=discussion"), ("div", "class=replies"), ("div", "class=reader-comments"),
             ("ul", "class=comments")]
_FOOTER = [("footer", ""), ("footer", "class=site-footer"), ("div", "id=footer"), ("div", "class=footer"),
           ("div", "class=copyright"), ("div", "class=legal"), ("div", "role=contentinfo")]


class _Writer:
    def __init__(self, rng: random.Random):
        self.r = rng

    def word(self) -> str:
        return "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def prose(self, low: int = 1, high: int = 6) -> str:
        out = []
        for _ in range(self.r.randint(low, high)):
            s = self.words(2, 18).capitalize()
            if self.r.random() < 0.4:
                s = s.replace(" ", ", ", 1)
            out.append(s + self.r.choice("....!?"))
        text = " ".join(out)
        return text.upper() if self.r.random() < 0.05 else text

    def title(self) -> str:
        return self.words(2, 9).capitalize() + self.r.choice(["", "", ".", "!", "?"])

    def tag(self, kind: tuple[str, str], inner: str, label: int) -> str:
        name, attr = kind
        if attr:
            key, value = attr.split("=")
            if self.r.random() < 0.3:
                value += self.r.choice([" wide", " box", " col", "-1", "_main1" if label else "_x"])
            attr = f' {key}="{value}"'
        return f'<{name}{attr} {LABEL_ATTRIBUTE}="{label}">{inner}</{name}>'

    def links(self, low: int, high: int) -> list[str]:
        return [f'<a href="/{self.word()}">{self.words(1, 3)}</a>' for _ in range(self.r.randint(low, high))]

    def menu(self) -> str:
        links = self.links(2, 8)
        inner = "".join(f"<li>{x}</li>" for x in links)
        return self.tag(self.r.choice(_MENU), self.r.choice([f"<ul>{inner}</ul>", " ".join(links), " | ".join(links)]), 0)

    def header(self) -> str:
        inner = self.r.choice([f"<h1>{self.words(1, 4)}</h1>", f'<a href="/">{self.words(1, 3)}</a>', f"<div>{self.words(1, 4)}</div>"])
        inner += self.r.choice(["", f"<p>{self.words(3, 8)}</p>", f"<p>{self.prose(1, 2)}</p>"])
        return self.tag(self.r.choice(_HEADER), inner, 0)

    def side(self) -> str:
        inner = self.r.choice(["", f"<h3>{self.words(1, 3)}</h3>", f"<h2>{self.words(1, 4)}</h2>"])
        inner += self.r.choice(["<ul>" + "".join(f"<li>{x}</li>" for x in self.links(2, 6)) + "</ul>",
                                f"<p>{self.prose(1, 3)}</p>", " ".join(self.links(2, 5)), self.prose(1, 2)])
        return self.tag(self.r.choice(_SIDE), inner, 0)

    def short(self, kinds) -> str:
        inner = self.r.choice([self.prose(1, 1), self.prose(1, 3), f"<p>{self.prose(1, 2)}</p>", self.words(1, 6),
                               f"{self.prose(1, 1)} <a href='#'>{self.word()}</a>", f"<p>{self.prose(1, 1)}</p><button>{self.word()}</button>"])
        return self.tag(self.r.choice(kinds), inner, 0)

    def form(self) -> str:
        inner = self.r.choice(["", f"<h3>{self.words(1, 4)}</h3>", f"<p>{self.prose(1, 2)}</p>", f"<legend>{self.words(1, 3)}</legend>"])
        inner += "".join(f"<label>{self.words(1, 3)}</label><input name='x'>" for _ in range(self.r.randint(0, 3)))
        return self.tag(self.r.choice(_FORM), inner + f"<button>{self.words(1, 2)}</button>", 0)

    def comments(self) -> str:
        kind = self.r.choice(_COMMENTS)
        one = self.r.choice(["div", "li", "article", "p"])
        items = []
        for _ in range(self.r.randint(1, 5)):
            body = self.prose(1, 4) if one == "p" or self.r.random() < 0.3 else f"<p>{self.prose(1, 4)}</p>"
            who = self.r.choice(["", f"<b>{self.word()}</b> ", f"<span class='author'>{self.word()}</span>: "])
            items.append(f"<{one}{self.r.choice(['', ' class=comment', ' class=reply'])}>{who}{body}</{one}>")
        head = self.r.choice(["", f"<h2>{self.words(1, 3)}</h2>", f"<h3>{self.r.randint(1, 90)} {self.word()}</h3>"])
        return self.tag(kind, head + "".join(items), 0)

    def footer(self) -> str:
        inner = self.r.choice([f"&copy; {self.words(1, 3)} &middot; {self.prose(1, 1)}", f"&copy; 2020 {self.words(1, 4)}",
                               f"<p>{self.prose(1, 2)}</p>", " ".join(self.links(2, 6)), f"<p>&copy; {self.words(2, 6)}</p>",
                               self.prose(1, 2)])
        return self.tag(self.r.choice(_FOOTER), inner, 0)

    def main_blocks(self) -> list[str]:
        r, out = self.r, []
        if r.random() < 0.85:
            out.append(f"<h1>{self.title()}</h1>")
        for _ in range(r.choice([1, 1, 2, 3, 4, 6, 9, 14])):
            x = r.random()
            if x < 0.72:
                p = self.prose(1, r.choice([1, 2, 6]))
                if r.random() < 0.15:
                    p = p.replace(" ", f' <a href="/x">{self.word()}</a> ', 1)
                if r.random() < 0.06:
                    p = self.words(1, 4)
                if r.random() < 0.1:
                    out.append(f"<p><b>{p}<br>")
                else:
                    out.append(r.choice([f"<p>{p}</p>", f"<p>{p}</p>", f"<p>{p}", f"<div>{p}</div>"]))
            elif x < 0.80:
                level = r.randint(2, 4)
                out.append(f"<h{level}>{self.title()}</h{level}>")
            elif x < 0.87:
                kind = r.choice(["ul", "ol"])
                out.append(f"<{kind}>" + "".join(f"<li>{self.r.choice([self.prose(1, 1), self.words(1, 8)])}</li>"
                                                 for _ in range(r.randint(2, 5))) + f"</{kind}>")
            elif x < 0.91:
                out.append(f"<blockquote>{r.choice([self.prose(1, 2), '<p>' + self.prose(1, 2) + '</p>'])}</blockquote>")
            elif x < 0.94:
                out.append(f"<pre>{self.words(3, 20)}</pre>")
            elif x < 0.97:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{self.words(1, 4)}</td>" for _ in range(3)) + "</tr>"
                                               for _ in range(r.randint(1, 3))) + "</table>")
            else:
                out.append(f"<figure><img src=x><figcaption>{self.prose(1, 1)}</figcaption></figure>")
        return out

    def page(self) -> str:
        r = self.r
        blocks = self.main_blocks()
        # Other sections may also stand inside the main container.
        for make, chance in ((lambda: self.short(_ADVERT), 0.25), (lambda: self.short(_NOTICE), 0.12), (self.side, 0.15),
                             (self.form, 0.1)):
            if r.random() < chance:
                blocks.insert(r.randint(1, len(blocks)), make())
        if r.random() < 0.15:
            blocks.append(self.comments())
        bare = r.random() < 0.1  # main blocks straight in the body
        main = "".join(blocks) if bare else self.tag(r.choice(_MAIN), "".join(blocks), 1)
        if bare:
            pass
        elif main.startswith("<td"):
            main = f"<table><tr>{main}</tr></table>"
        elif r.random() < 0.25:
            main = r.choice([f"<div class='wrapper'>{main}</div>", f"<main>{main}</main>", f"<div id='page'><div class='container'>{main}</div></div>"])
        before = [make() for make, chance in (
            (self.header, 0.6), (self.menu, 0.85), (lambda: self.short(_NOTICE), 0.35), (lambda: self.short(_ADVERT), 0.55),
            (self.form, 0.2), (self.side, 0.2)) if r.random() < chance]
        r.shuffle(before)
        after = [make() for make, chance in (
            (self.comments, 0.45), (self.side, 0.45), (lambda: self.short(_ADVERT), 0.3), (self.form, 0.25),
            (lambda: self.short(_NOTICE), 0.25)) if r.random() < chance]
        r.shuffle(after)
        if r.random() < 0.9:
            after.append(self.footer())
        return (f"<!DOCTYPE html><html><head><title>x</title><style>p{{}}</style></head><body {LABEL_ATTRIBUTE}={int(bare)}>"
                + "".join(before) + main + "".join(after) + "</body></html>")


def labelled_pages(n: int, seed: int) -> list[str]:
    """``n`` pages whose elements carry LABEL_ATTRIBUTE: 1 for main text, 0 for the rest."""
    return [_Writer(random.Random(seed * 1_000_003 + i)).page() for i in range(n)]
