"""Block trees of web pages: elements that lay out blocks, the runs of text in them, and features of both."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape
from math import log1p

import numpy as np

# Element names of HTML.
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section select summary table tbody td tfoot th thead tr ul".split()
)
RAW = set("script style textarea title template iframe noembed noframes svg".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY = {  # an open element of these names ends where one of the key's name starts, inside the nearest boundary
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
}
KINDS = ["article", "main", "section", "div", "p", "heading", "list", "li", "table", "cell", "nav", "header", "footer", "aside", "form", "quote", "pre", "figure", "body", "run"]
KIND_OF = (
    {f"h{i}": "heading" for i in range(1, 7)}
    | {"ul": "list", "ol": "list", "dl": "list", "menu": "nav", "dir": "list", "dt": "li", "dd": "li", "tr": "table", "tbody": "table", "thead": "table"}
    | {"tfoot": "table", "td": "cell", "th": "cell", "fieldset": "form", "select": "form", "legend": "form", "blockquote": "quote"}
    | {"figcaption": "figure", "html": "body", "#run": "run", "#root": "body", "caption": "figure", "dialog": "aside"}
)
# Tokens of class, id, role and the like, by what they usually mark.
MARKS = {
    "content": "article content story post entry text body main page single markdown prose news blogpost articlebody hentry maincontent copy richtext",
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager tabs toc toolbar topnav sitemap skip links dropdown",
    "frame": "header masthead banner footer bottom top site branding logo copyright legal colophon foot imprint disclaimer credits",
    "side": "sidebar side aside related recommended recommendations popular trending widget teaser teasers more rail archive latest",
    "advert": "ad ads adv advert advertisement advertising sponsor sponsored promo promotion adsense adslot banner300 commercial affiliate dfp",
    "notice": "cookie cookies consent gdpr notice alert message popup modal overlay warning toast privacy paywall announcement banner-notice",
    "form": "form newsletter subscribe subscription login signup register search searchbox contact input field submit poll survey",
    "comment": "comment comments commentlist reply replies respond discussion disqus thread reader readers feedback reviews guestbook",
    "social": "share sharing social follow facebook twitter tags tag author byline meta date timestamp",
}
MARK_OF = {token: i for i, tokens in enumerate(MARKS.values()) for token in tokens.split()}
HINTS = ("class", "id", "role", "itemprop", "aria-label", "data-component", "data-testid", "name")
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
REST = re.compile(r"""[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+>""")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
WHITE = re.compile(r"\s+")
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


@dataclass
class Tree:
    """Nodes in page order; the first is the root. A ``#run`` is a leaf: text between block borders."""

    tags: list[str] = field(default_factory=lambda: ["#root"])
    parents: list[int] = field(default_factory=lambda: [-1])
    marks: list[int] = field(default_factory=lambda: [0])  # bit set over MARKS, and one bit more for hidden
    texts: list[str] = field(default_factory=lambda: [""])
    links: list[int] = field(default_factory=lambda: [0])  # code points inside links
    inline: list[int] = field(default_factory=lambda: [0])  # inline elements
    inputs: list[int] = field(default_factory=lambda: [0])

    def add(self, tag: str, parent: int, marks: int = 0, text: str = "", links: int = 0, inline: int = 0, inputs: int = 0) -> int:
        for column, value in zip((self.tags, self.parents, self.marks, self.texts, self.links, self.inline, self.inputs), (tag, parent, marks, text, links, inline, inputs)):
            column.append(value)
        return len(self.tags) - 1


HIDDEN = 1 << len(MARKS)


def marks_of(attributes: str) -> int:
    found = 0
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in HINTS:
            for token in TOKEN.findall(value):
                mark = MARK_OF.get(token.lower())
                if mark is not None:
                    found |= 1 << mark
        elif name == "hidden" or (name == "style" and "display:none" in value.replace(" ", "").lower()):
            found |= HIDDEN
    return found


def parse(html: str) -> Tree:
    """The block tree of a page. Broken markup is read as browsers do in the common cases: missing end tags are implied, unknown ones ignored."""
    tree, stack = Tree(), [0]
    parts: list[str] = []
    state = {"link": False, "linked": 0, "inline": 0, "inputs": 0}

    def flush() -> None:
        text = WHITE.sub(" ", "".join(parts)).strip()
        if text:
            tree.add("#run", stack[-1], 0, text, min(state["linked"], len(text)), state["inline"], state["inputs"])
        parts.clear()
        state.update(linked=0, inline=0, inputs=0)

    def close(names: set[str], within: set[str]) -> None:
        for at in range(len(stack) - 1, 0, -1):
            tag = tree.tags[stack[at]]
            if tag in names:
                flush()
                del stack[at:]
            elif tag in within:
                return

    def words(text: str) -> None:
        if text:
            text = unescape(text)
            parts.append(text)
            if state["link"]:
                state["linked"] += len(text)

    at, size = 0, len(html)
    while at < size:
        start = html.find("<", at)
        if start < 0:
            words(html[at:])
            break
        words(html[at:start])
        if html.startswith("<!--", start):
            end = html.find("-->", start + 4)
            at = size if end < 0 else end + 3
            continue
        closing = html.startswith("/", start + 1)
        name_at = NAME.match(html, start + 1 + closing)
        if not name_at:
            if html[start + 1 : start + 2] in ("!", "?", "/"):
                end = html.find(">", start)
                at = size if end < 0 else end + 1
            else:
                words("<")
                at = start + 1
            continue
        tag = name_at[0].lower()
        rest = REST.match(html, name_at.end())
        if rest:
            attributes, at = rest[0][:-1], rest.end()
        else:  # an open quote: the first bracket ends the tag
            end = html.find(">", name_at.end())
            attributes, at = (html[name_at.end() :], size) if end < 0 else (html[name_at.end() : end], end + 1)
        if tag in RAW:
            if not closing and not attributes.endswith("/"):
                state["inputs"] += tag == "textarea"
                end_tag = RAW_END[tag].search(html, at)
                at = size if not end_tag else (html.find(">", end_tag.end()) + 1 or size)
            continue
        if tag == "head":
            flush()
        elif tag in BLOCKS:
            state["link"] = False
            if closing:
                open_at = next((i for i in range(len(stack) - 1, 0, -1) if tree.tags[stack[i]] == tag), 0)
                flush()
                if open_at:
                    del stack[open_at:]
                continue
            flush()
            close({"p"}, {"td", "th", "li", "div", "table", "article", "section", "main", "aside", "body"})
            if tag in CLOSED_BY:
                close(*CLOSED_BY[tag])
            if tag[0] == "h" and tag[1:].isdigit() and tree.tags[stack[-1]] in ("h1", "h2", "h3", "h4", "h5", "h6"):
                stack.pop()
            if tag not in VOID:
                stack.append(tree.add(tag, stack[-1], marks_of(attributes) if attributes else 0))
        elif tag == "br":
            parts.append("\n")
        elif tag == "a":
            state["link"] = not closing
            state["inline"] += not closing
        elif not closing:
            state["inline"] += 1
            state["inputs"] += tag in ("input", "button", "label", "option")
    flush()
    return tree


N_FEATURES = len(KINDS) + 2 * len(MARKS) + 26


def features(tree: Tree) -> np.ndarray:
    """A row for every node: its kind, attribute tokens, depth, the density of its subtree, its place among its siblings and in the page."""
    n = len(tree.tags)
    length, linked, runs, tags, stops, inputs, long_runs = ([0] * n for _ in range(7))
    depth, above, kinds, place, index, children = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n, [[] for _ in range(n)]
    seen = 0
    for i in range(n):
        tag, parent, text = tree.tags[i], tree.parents[i], tree.texts[i]
        kinds[i] = KINDS.index(KIND_OF.get(tag, tag if tag in KINDS else "div"))
        if i:
            depth[i] = depth[parent] + 1
            above[i] = above[parent] | tree.marks[parent] | (1 << (20 + kinds[parent]))
            index[i] = len(children[parent])
            children[parent].append(i)
        place[i] = seen
        if text:
            length[i], linked[i], runs[i], inputs[i] = len(text), tree.links[i], 1, tree.inputs[i]
            stops[i] = text.count(",") + text.count(".")
            long_runs[i] = len(text) > 80
            seen += len(text)
        tags[i] = 1 + tree.inline[i]
    for i in range(n - 1, 0, -1):
        parent = tree.parents[i]
        for column in (length, linked, runs, tags, stops, inputs, long_runs):
            column[parent] += column[i]
    whole = max(length[0], 1)
    out = np.zeros((n, N_FEATURES), dtype=np.float32)
    base = len(KINDS)
    inside = {k: 20 + KINDS.index(k) for k in ("article", "main", "nav", "header", "footer", "aside", "form", "list", "table")}
    for i in range(n):
        parent = max(tree.parents[i], 0)
        siblings = children[parent] if i else [0]
        others = max(len(siblings) - 1, 1)
        row = out[i]
        row[kinds[i]] = 1
        own, up = tree.marks[i], above[i]
        for m in range(len(MARKS)):
            row[base + m] = own >> m & 1
            row[base + len(MARKS) + m] = up >> m & 1
        around = (length[parent] - length[i]) if i else 0
        at = index[i]
        before = siblings[at - 1] if at else -1
        after = siblings[at + 1] if at + 1 < len(siblings) else -1
        size = max(length[i], 1)
        row[base + 2 * len(MARKS) :] = (
            depth[i],
            log1p(length[i]),
            length[i] / whole,
            linked[i] / size,
            length[i] / tags[i],
            stops[i] / size * 100,
            runs[i],
            long_runs[i] / max(runs[i], 1),
            inputs[i],
            place[i] / whole,
            (place[i] + length[i]) / whole,
            len(siblings),
            at / others,
            log1p(around / others),
            length[i] / max(length[parent], 1),
            linked[parent] / max(length[parent], 1),
            log1p(length[before]) if before >= 0 else -1,
            log1p(length[after]) if after >= 0 else -1,
            (own | up) & HIDDEN > 0,
            *[up >> inside[k] & 1 for k in ("article", "main", "nav", "header", "footer")],
            up >> inside["aside"] & 1 | up >> inside["form"] & 1,
            long_runs[parent],
        )
    return out


def decoded(tree: Tree, odds: np.ndarray) -> list[bool]:
    """The most likely choice of nodes in which no node stays without its parent.

    A node that goes takes its whole subtree along: its score is the sum of the log chances of that,
    against that of staying with the best choice below each child.
    """
    n = len(tree.tags)
    keep_own = -np.logaddexp(0, -odds)
    drop_own = -np.logaddexp(0, odds)
    stay, gone = keep_own.tolist(), drop_own.tolist()
    for i in range(n - 1, 0, -1):
        parent = tree.parents[i]
        gone[parent] += gone[i]
        stay[parent] += max(stay[i], gone[i])
    kept = [True] * n
    for i in range(1, n):
        kept[i] = kept[tree.parents[i]] and stay[i] > gone[i]
    return kept
