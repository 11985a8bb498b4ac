"""Main text of web pages: boosted trees over the nodes of the block tree, and a hierarchical choice of nodes.

No page comes with its main text marked, so the trees are fitted on pages composed for the purpose:
layouts with and without semantic elements, telling attributes and clean markup, in which it is
known what belongs to the article. Words play no part, only structure does.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finsearch.llm.boosting import Trees, fit
from finsearch.llm.common import text_of
from finsearch.llm.dom import Tree, decoded, features, parse

TRAINING_PAGES = 2000  # the bound of the labelled sample
OWN = ""  # stands in front of every text of the article while the labels are read


class Composer:
    """Pages of many layouts; texts of the article start with ``OWN``."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def word(self) -> str:
        return "".join(self.rng.choice("abcdefghijklmnopqrstuvwxyzéüñ") for _ in range(self.rng.choice((1, 2, 2, 3, 3, 4, 5, 6, 7, 9, 12))))

    def sentence(self, low: int = 1, high: int = 18) -> str:
        words = [self.word() + ("," if self.rng.random() < 0.1 else "") for _ in range(self.rng.randint(low, high))]
        return " ".join(words).capitalize().rstrip(",") + "."

    def text(self, most: int = 7) -> str:
        return " ".join(self.sentence() for _ in range(self.rng.randint(1, most)))

    def label(self) -> str:
        rng = self.rng
        text = " ".join(self.word() + rng.choice(("", "", "", "", ",")) for _ in range(rng.choice((1, 1, 1, 2, 2, 3, 4))))
        return (text if rng.random() < 0.3 else text.capitalize()) + rng.choice(("", "", "", "."))

    def named(self, tag: str, tokens: str, semantic: float = 0.75) -> str:
        """An opening tag, mostly with one of the tokens as class or id."""
        rng = self.rng
        if rng.random() > semantic:
            return f"<{tag}>" if rng.random() < 0.5 else f'<{tag} class="{self.word()}-{rng.randint(1, 40)}">'
        token = rng.choice(tokens.split())
        name = rng.choice((token, token, f"{token}-{self.word()}", f"{self.word()}_{token}", f"{token}-wrapper", f"site-{token}", token.capitalize() + "Box"))
        extra = f' id="{self.word()}"' if rng.random() < 0.1 else ""
        return f'<{tag} {rng.choice(("class", "class", "id"))}="{name}"{extra}>'

    def links(self, low: int = 2, high: int = 9) -> str:
        items = [f'<a href="/{self.word()}">{self.label()}</a>' for _ in range(self.rng.randint(low, high))]
        shape = self.rng.randrange(4)
        if shape < 2:
            return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"
        return (" | " if shape == 2 else " ").join(items)

    def teaser(self) -> str:
        rng = self.rng
        heading = f"<h{rng.randint(3, 4)}>{self.label()}</h3>" if rng.random() < 0.5 else ""
        return f'<div>{heading}<a href="/{self.word()}">{self.label()}</a><p>{self.sentence()}</p></div>'

    def menu(self) -> str:
        if self.rng.random() < 0.6:
            return f"<nav>{self.links()}</nav>"
        return self.named("div", "nav navbar menu navigation breadcrumb topnav pagination") + self.links() + "</div>"

    def header(self) -> str:
        tag = self.rng.choice(("header", "div"))
        inner = self.rng.choice((self.label(), f"<h1>{self.label()}</h1>", f"<p>{self.sentence()}</p>", f'<a href="/">{self.label()}</a>'))
        more = self.menu() if self.rng.random() < 0.4 else ""
        return self.named(tag, "header masthead site-header top branding", 0.8 if tag == "div" else 0.4) + inner + more + f"</{tag}>"

    def footer(self) -> str:
        tag = self.rng.choice(("footer", "footer", "div"))
        inner = self.rng.choice((f"&copy; {self.label()} &middot; {self.sentence()}", f"<p>{self.text(2)}</p>", self.links() + f"<p>&copy; {self.label()}</p>"))
        return self.named(tag, "footer bottom copyright legal colophon", 0.9 if tag == "div" else 0.3) + inner + f"</{tag}>"

    def advert(self) -> str:
        inner = self.rng.choice((self.sentence(), self.text(2), f"<p>{self.text(2)}</p>", f'<a href="/x">{self.label()}</a>', f'<img src="a.png"><span>{self.label()}</span>'))
        tag = self.rng.choice(("div", "div", "div", "aside", "section"))
        return self.named(tag, "ad ads advert advertisement sponsored promo banner sponsor", 0.97) + inner + f"</{tag}>"

    def notice(self) -> str:
        button = "<button>" + self.label() + "</button>" if self.rng.random() < 0.5 else ""
        tag = self.rng.choice(("div", "div", "section", "dialog", "aside"))
        text = self.rng.choice((f"<p>{self.text(3)}</p>", self.text(2)))
        return self.named(tag, "cookie consent notice alert gdpr popup modal cookie-banner message", 0.97) + text + button + f"</{tag}>"

    def aside(self) -> str:
        tag = self.rng.choice(("aside", "aside", "div"))
        inner = self.rng.choice((self.links(), "".join(self.teaser() for _ in range(self.rng.randint(1, 4))), f"<h3>{self.label()}</h3><p>{self.text(3)}</p>", self.sentence()))
        return self.named(tag, "sidebar related widget recommended popular side", 0.95 if tag == "div" else 0.4) + inner + f"</{tag}>"

    def form(self) -> str:
        fields = "".join(f"<label>{self.label()}</label><input name={self.word()}>" for _ in range(self.rng.randint(1, 4)))
        said = self.rng.choice(("", f"<p>{self.text(2)}</p>", f"<h3>{self.label()}</h3>", self.sentence()))
        form = f"<form action=/{self.word()}>{said}{fields}<button>{self.label()}</button></form>"
        return form if self.rng.random() < 0.5 else self.named("div", "newsletter subscribe signup search login contact", 0.9) + said + form + "</div>"

    def comments(self) -> str:
        rng = self.rng
        each = []
        for _ in range(rng.randint(1, 6)):
            who = rng.choice((f"<b>{self.label()}</b>", f"<span class=author>{self.label()}</span>", f"<h4>{self.label()}</h4>", ""))
            tag = rng.choice(("div", "li", "article"))
            each.append(self.named(tag, "comment reply comment-body", 0.7) + who + f"<p>{self.text(4)}</p></{tag}>")
        tag = rng.choice(("div", "section", "ol", "div"))
        title = f"<h3>{self.label()}</h3>" if rng.random() < 0.6 else ""
        return self.named(tag, "comments commentlist responses discussion replies disqus", 0.97) + title + "".join(each) + (self.form() if rng.random() < 0.3 else "") + f"</{tag}>"

    def social(self) -> str:
        return self.named("div", "share social tags follow meta", 0.95) + self.links(2, 5) + "</div>"

    def own_block(self) -> str:
        rng = self.rng
        inline = lambda t: t if rng.random() < 0.7 else t.replace(" ", rng.choice((" <a href='/q'>", " <em>", " <b>", "<br>", " <span>")), 1)
        shape = rng.random()
        text = OWN + inline(self.text(rng.choice((1, 2, 5, 9))))
        if shape < 0.74:
            return f"<p>{text}" + ("</p>" if rng.random() < 0.75 else "")
        if shape < 0.82:
            level = rng.randint(2, 4)
            return f"<h{level}>{OWN}{self.label()}</h{level}>"
        if shape < 0.87:
            tag = rng.choice(("ul", "ol"))
            return f"<{tag}>" + "".join(f"<li>{OWN}{inline(self.sentence())}</li>" for _ in range(rng.randint(2, 6))) + f"</{tag}>"
        if shape < 0.9:
            return f"<blockquote><p>{text}</p></blockquote>" if rng.random() < 0.5 else f"<blockquote>{text}</blockquote>"
        if shape < 0.92:
            return f"<pre>{text}</pre>"
        if shape < 0.94:
            return f"<figure><img src=x.jpg><figcaption>{OWN}{self.sentence()}</figcaption></figure>"
        if shape < 0.96:
            rows = "".join(f"<tr><td>{OWN}{self.label()}</td><td>{OWN}{self.label()}</td></tr>" for _ in range(rng.randint(1, 4)))
            return f"<table>{rows}</table>"
        return f"<div>{text}</div>"

    def article(self) -> str:
        rng = self.rng
        blocks = [self.own_block() for _ in range(rng.choice((1, 2, 3, 4, 6, 8, 12, 20)))]
        if rng.random() < 0.85:
            title = f"{OWN}{self.sentence(1, 12)}" if rng.random() < 0.5 else OWN + self.label()
            blocks.insert(0, f"<h1>{title}</h1>" if rng.random() < 0.85 else f"<header><h1>{title}</h1></header>")
        for part, chance in ((self.advert, 0.25), (self.social, 0.15), (self.aside, 0.1), (self.notice, 0.06), (self.form, 0.06)):
            if rng.random() < chance:
                blocks.insert(rng.randint(1, len(blocks)), part())
        inner = "".join(blocks)
        if rng.random() < 0.06:  # no markup of its own: lines and line breaks
            inner = "<br><br>".join(OWN * (i == 0) + self.text() for i in range(rng.randint(1, 4)))
        shape = rng.random()
        if shape < 0.45:
            return f"<article>{inner}</article>" if rng.random() < 0.5 else self.named("article", "post entry article story", 0.8) + inner + "</article>"
        if shape < 0.6:
            return f"<main>{inner}</main>"
        if shape < 0.9:
            tag = rng.choice(("div", "div", "section"))
            body = self.named(tag, "content article post entry story main text body post-content article-body", 0.85) + inner + f"</{tag}>"
            return f"<div>{body}</div>" if rng.random() < 0.3 else body
        return inner

    def page(self) -> str:
        rng = self.rng
        if rng.random() < 0.05:  # a fragment or bare text
            return rng.choice((self.article(), OWN + self.text(), f"<p>{OWN}{self.text()}</p>", f"<body>{OWN}{self.text()}</body>"))
        before = [part() for part, chance in ((self.notice, 0.25), (self.header, 0.5), (self.menu, 0.8), (self.form, 0.1), (self.advert, 0.4), (self.aside, 0.1)) if rng.random() < chance]
        after = [part() for part, chance in ((self.social, 0.2), (self.comments, 0.4), (self.aside, 0.4), (self.form, 0.2), (self.advert, 0.25), (self.menu, 0.15), (self.footer, 0.85), (self.notice, 0.2)) if rng.random() < chance]
        middle = self.article()
        if rng.random() < 0.3:  # the article shares a container with what stands around it
            cut = rng.randint(0, len(before)), rng.randint(0, len(after))
            tag = rng.choice(("div", "section", "div"))
            middle = self.named(tag, "container wrapper page main content", 0.6) + "".join(before[cut[0] :]) + middle + "".join(after[: cut[1]]) + f"</{tag}>"
            before, after = before[: cut[0]], after[cut[1] :]
        head = f"<!DOCTYPE html><html><head><title>{self.label()}</title><style>p{{}}</style></head>" if rng.random() < 0.8 else ""
        return head + "<body>" + "".join(before) + middle + "".join(after) + "</body></html>"


def labelled(html: str) -> tuple[Tree, np.ndarray]:
    """The tree of a composed page and, for every node, whether it holds text of the article."""
    tree = parse(html)
    own = np.array([OWN in t for t in tree.texts])
    tree.texts = [t.replace(OWN, "") for t in tree.texts]
    for i in range(len(own) - 1, 0, -1):
        own[tree.parents[i]] |= own[i]
    return tree, own


@cache
def fitted(pages: int = TRAINING_PAGES, seed: int = 7) -> Trees:
    """Trees from ``pages`` composed pages."""
    composer = Composer(seed)
    found = [labelled(composer.page()) for _ in range(pages)]
    rows = np.concatenate([features(tree) for tree, _ in found])
    labels = np.concatenate([own for _, own in found]).astype(float)
    return fit(rows, labels)


def main_texts(pages: list[str], trees: Trees) -> list[str]:
    """The main text of every page: its kept runs of text in page order, joined by empty lines."""
    parsed = [parse(html) for html in pages]
    rows = [features(tree) for tree in parsed]
    odds = trees.score(np.concatenate(rows)) if rows else np.empty(0)
    ends = np.cumsum([len(r) for r in rows])
    out = []
    for tree, end, own in zip(parsed, ends, rows):
        kept = decoded(tree, odds[end - len(own) : end])
        out.append("\n\n".join(text for text, keep in zip(tree.texts, kept) if keep and text))
    return out


def extracted(pages: DataFrame, trees: Trees | None = None, html_col: str = "html", batch: int = 64) -> DataFrame:
    """``pages`` without the html, with ``text`` and ``n_chars``: the main text of the whole html and its code points.

    Null and empty html, and pages without an article, give an empty text. White space inside a block is
    one space, blocks are joined by an empty line in page order, character references are
    decoded. Other columns stay, but columns named ``text`` or ``n_chars`` are replaced.
    """
    rest = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    own = trees or fitted()
    # plain arrays: a broadcast object would need its class on the workers
    shipped = pages.sparkSession.sparkContext.broadcast((own.feature, own.threshold, own.value, own.start))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Trees(*shipped.value)
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                part = rows.slice(at, batch)
                texts = main_texts(part.column(len(rest)).to_pylist(), own)
                made = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(rest)], *made], names=[*rest, "text", "n_chars"])

    source = pages.select(*[F.col(f"`{c}`") for c in rest], text_of(html_col).alias("_html"))
    kinds = [f"`{c}` {source.schema[c].dataType.simpleString()}" for c in rest]
    return source.mapInArrow(run, ", ".join([*kinds, "text string", "n_chars long"]))
