"""HTML extraction by a tree-structured graphical model over the DOM.

Nodes are the block elements of a page and the runs of text between them; every
node is content or not. Unary potentials come from the tag, words of class and
id, text length, link share and punctuation of a node; parent-child potentials
couple a node with its parent, by the kind of edge. Sum-product messages go from
the leaves up and from the root down, and give each node's marginal exactly.
Weights are fitted on labelled pages by the gradient of the likelihood (observed
less expected counts); ``labelled_pages`` writes a bounded, seeded set of them in
many layouts, and ``fit`` takes any others.

The main text is every run whose marginal of being content is over one half:
character references decoded, white space inside a block one space, trimmed,
blocks joined by two line breaks in page order. Nothing is cut or capped.
Script, style and the like are never text.

Null and empty html give empty text; text outside any tag is a block; a tag that
isn't closed at the end of the page is markup. Pages of any length are parsed
whole in one pass. Repeated rows give repeated rows; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import random
import re
import uuid
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"""<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)|[^<]+|<""", re.S)
NAMES = re.compile(r"""(?<![^\s"'/])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

# Elements of HTML by how they are laid out.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe svg math select option datalist object audio video canvas head".split())
TO_THE_END = {"script", "style"}  # what isn't closed reaches to the end of the page; of the others only the tag is markup
TO_THE_END = {"script", "style"}  # what isn't closed reaches to the end of the page; of the others only the tag is markup
BLOCK = set(
    "html body div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption section article main aside nav header footer form fieldset "
    "blockquote pre figure figcaption address details summary center hr dialog menu hgroup search".split()
)
CLOSES_P = BLOCK - {"html", "body"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}

# Words of class, id and role, by what they tell. A name tells it wherever such a word stands in it.
HINTS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toc pager pagination topbar",
    "head": "masthead",
    "foot": "footer colophon contentinfo",
    "side": "sidebar complementary trending",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion adsense",
    "note": "cookie cookies consent popup modal gdpr newsletter subscribe subscription share sharing social toolbar",
    "talk": "comment comments disqus respond",
    "form": "form search login signup register",
    "main": "article content main post entry prose",
}
# Words that tell the same, but only in names made of nothing else than such and plain words.
LOOSE_HINTS = {
    "menu": "tabs links skip",
    "head": "header logo",
    "foot": "bottom copyright",
    "side": "side aside rail widget recommended popular",
    "ad": "commercial",
    "note": "notice notices alert overlay",
    "talk": "reply replies reviews feedback",
    "main": "story body text page",
    "maybe": "warning message discussion banner related more top highlight",
}
# Words of a name that tell nothing.
NEUTRAL = set(
    "box list container wrapper wrap area section block site inner outer item items thread left right col column row panel group holder module unit zone slot global "
    "primary secondary sticky fixed js label title bar meta info small large inline full up posts articles news the my in and".split()
)
HINT_OF: dict[str, set[str]] = {}
LOOSE_OF: dict[str, set[str]] = {}
for _table, _of in ((HINTS, HINT_OF), (LOOSE_HINTS, LOOSE_OF)):
    for _kind, _words in _table.items():
        for _w in _words.split():
            _of.setdefault(_w, set()).add(_kind)

WEIGHTS = 1 << 12
EDGES = 6


def hints(attributes: str) -> tuple[str, ...]:
    found: set[str] = set()
    for _, value in NAMES.findall(attributes):
        for name in value.strip("\"'").split():
            parts = [w.lower() for w in PART.findall(name)]
            for w in parts:
                found |= HINT_OF.get(w, set())
            if all(w in HINT_OF or w in LOOSE_OF or w in NEUTRAL or w.isdigit() for w in parts):
                for w in parts:
                    found |= LOOSE_OF.get(w, set())
    return tuple(sorted(found - {"maybe"} or found))


class Page:
    """Nodes of one page in page order; runs carry text."""

    def __init__(self, source: str | None):
        self.parent: list[int] = [-1]
        self.tag: list[str] = ["html"]
        self.hint: list[tuple[str, ...]] = [()]
        self.text: list[str | None] = [None]
        self.size: list[int] = [0]
        self.linked: list[int] = [0]
        self.label: list[int] = [0]
        self.prose: list[bool] = [False]  # holds a sentence
        self._read(source or "")

    def _node(self, parent: int, tag: str, hint: tuple[str, ...], label: int, text: str | None = None, linked: int = 0) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.hint.append(hint)
        self.text.append(text)
        self.size.append(len(text) if text else 0)
        self.linked.append(linked)
        self.label.append(label)
        self.prose.append(bool(text) and len(text) >= 40 and any(c in text for c in ".,;:!?"))
        return len(self.parent) - 1

    def _read(self, source: str) -> None:
        stack: list[tuple[str, int]] = [("html", 0)]  # open elements with the block node they are in
        run: list[str] = []
        in_link, linked = 0, 0
        pos, end = 0, len(source)

        def flush() -> None:
            nonlocal linked
            if run:
                text = " ".join("".join(run).split())
                run.clear()
                if text:
                    at = stack[-1][1]
                    self._node(at, "#text", (), self.label[at], text, min(linked, len(text)))
                linked = 0

        while pos < end:
            m = TOKEN.match(source, pos)
            pos = m.end()
            name = m[2] or m[5]
            if name is None:
                if source[m.start()] != "<" or pos - m.start() == 1:
                    text = html_lib.unescape(m[0])
                    run.append(text)
                    if in_link:
                        linked += len(text)
                continue
            name = name.lower()
            if m[1] or m[4]:  # an end tag
                if name == "a":
                    in_link = max(0, in_link - 1)
                if name in BLOCK:
                    if name == "p" and not any(t == "p" for t, _ in stack):
                        flush()
                        continue
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i][0] == name:
                            flush()
                            del stack[i:]
                            in_link = 0
                            break
                elif name == "br":
                    run.append(" ")
                continue
            given = m[3] or m[6] or ""
            if name in RAW:
                if name == "head":
                    # what stands in the head isn't shown; it ends at its end tag or where the body begins
                    stop = re.compile(r"</head\s*>|(?=<body\b)", re.I).search(source, pos)
                    pos = stop.end() if stop else pos
                elif not given.rstrip().endswith("/"):
                    stop = re.compile(rf"</{name}\b[^>]*(?:>|$)", re.I).search(source, pos)
                    pos = stop.end() if stop else end if name in TO_THE_END else pos
                run.append(" ")
                continue
            if name in VOID:
                if name == "hr":
                    flush()
                else:
                    run.append(" ")
                continue
            if name not in BLOCK:
                if name == "a":
                    in_link += 1
                continue
            flush()
            if name in ("html", "body"):
                if given:
                    self.hint[0] = tuple(sorted({*self.hint[0], *hints(given)} - {"main", "menu", "head", "foot", "side", "ad", "note", "talk", "form"}))
                continue
            in_link = 0
            if name in CLOSES_P:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == "p":
                        del stack[i:]
                        break
            if name in SAME:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in SCOPE.get(name, ()):
                        break
                    if stack[i][0] in SAME[name]:
                        del stack[i:]
                        break
            at = stack[-1][1]
            label = 1 if 'data-label="1"' in given else 0 if 'data-label="0"' in given else self.label[at]
            stack.append((name, self._node(at, name, hints(given) if given else (), label)))
        flush()
        for i in range(len(self.parent) - 1, 0, -1):
            self.size[self.parent[i]] += self.size[i]
            self.linked[self.parent[i]] += self.linked[i]
            self.prose[self.parent[i]] |= self.prose[i]

    def keys(self) -> list[tuple]:
        """What the unary potential of each node depends on."""
        out = []
        for i, tag in enumerate(self.tag):
            n, text, parent = self.size[i], self.text[i], self.parent[i]
            share = 0 if not n else min(4, 5 * self.linked[i] // n)
            points = int(any(c in text for c in ".,;:!?")) if text is not None else -1
            legal = text is not None and bool(LEGAL.search(text)) and (parent <= 0 or self.parent[parent] == 0)
            out.append((tag, self.hint[i], min(10, n.bit_length()), share, points, self.tag[parent] if text is not None and parent >= 0 else "", parent == 0, self.prose[i], legal))
        return out

    def edges(self) -> list[int]:
        """Kind of the edge to the parent: text or element, and whether the child tells its part itself."""
        out = []
        for i, tag in enumerate(self.tag):
            told = bool(self.hint[i]) or tag in TOLD
            out.append(0 if self.text[i] is not None else 1 + told + 2 * (self.parent[i] == 0))
        return out


TOLD = {"nav", "header", "footer", "aside", "form", "article", "main"}


PLAIN = set("#text p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table thead tbody tfoot tr td th caption blockquote pre".split())


def features(key: tuple) -> list[int]:
    """Plain blocks speak by their share of linked text and their hints only, so that
    what an article says of itself isn't outvoted by the look of its many blocks."""
    tag, hint, size, share, points, above, top, prose, legal = key
    names = [f"link{share}{prose}", f"link{tag}{share}{prose}", f"short{above}{share}{min(size, 6)}"] if share else []
    names += ["legal"] if legal else []
    if "maybe" in hint:  # such a name is outweighed by what stands under it
        return [crc32(n.encode()) % WEIGHTS for n in [*names, f"maybe{top}{share}{prose}", f"maybe{tag}{top}"]]
    if tag not in PLAIN:
        names += [f"tag{tag}", f"part{tag}:{'+'.join(hint)}", f"top{tag}:{top}:{bool(hint)}"]
        if not hint and tag in ("div", "section"):
            names += [f"size{size}", f"point{points}"]
    names += ["hint" + h for h in hint] + ([f"hint{'+'.join(hint)}"] if len(hint) > 1 else [])
    return [crc32(n.encode()) % WEIGHTS for n in names] or [0]


#: What a page says of its rights, right in the body or one block below it.
LEGAL = re.compile(r"^(?:©|\(c\) ?[0-9]|copyright\b)|all rights reserved", re.I)


class Forest:
    """Nodes of many pages, laid out for messages by depth."""

    def __init__(self, pages: list[Page]):
        keys: dict[tuple, int] = {}
        key_of, parent, edge, at = [], [], [], 0
        for p in pages:
            key_of += [keys.setdefault(k, len(keys)) for k in p.keys()]
            parent += [x + at if x >= 0 else -1 for x in p.parent]
            edge += p.edges()
            at += len(p.parent)
        self.keys, self.key_of = list(keys), np.array(key_of, np.int64)
        self.parent, self.edge = np.array(parent, np.int64), np.array(edge, np.int64)
        depth = np.zeros(at, np.int64)
        for i, x in enumerate(parent):
            if x >= 0:
                depth[i] = depth[x] + 1
        self.levels = [np.flatnonzero(depth == d) for d in range(int(depth.max(initial=0)) + 1)] if at else []

    def sum_product(self, score: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of content, and of (parent, child) labels; ``score`` is the log potential of content."""
        n = len(self.parent)
        up = np.zeros((n, 2))
        up[:, 1] = score
        sent = np.zeros((n, 2))
        for level in reversed(self.levels[1:]):  # to the parents
            sent[level] = np.logaddexp.reduce(pair[self.edge[level]] + up[level][:, None, :], axis=2)
            np.add.at(up, self.parent[level], sent[level])
        both = up.copy()
        joint = np.zeros((n, 2, 2))
        for level in self.levels[1:]:  # to the children
            rest = both[self.parent[level]] - sent[level]
            table = pair[self.edge[level]] + rest[:, :, None]
            both[level] += np.logaddexp.reduce(table, axis=1)
            joint[level] = table + up[level][:, None, :]
        joint -= joint.max((1, 2), keepdims=True)
        joint = np.exp(joint)
        joint /= joint.sum((1, 2), keepdims=True)
        return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -700, 700))), joint


class Model:
    def __init__(self, weights: np.ndarray, pair: np.ndarray):
        self.weights, self.pair = weights, pair
        self.scores: dict[tuple, float] = {}

    def extract(self, sources: list[str | None]) -> list[str]:
        pages = [Page(s) for s in sources]
        forest = Forest(pages)
        if len(self.scores) > 200_000:
            self.scores.clear()
        for k in forest.keys:
            if k not in self.scores:
                self.scores[k] = float(self.weights[features(k)].sum())
        score = np.array([self.scores[k] for k in forest.keys])[forest.key_of] if pages else np.zeros(0)
        content, _ = forest.sum_product(score, self.pair)
        out, at = [], 0
        for p in pages:
            out.append("\n\n".join(t for i, t in enumerate(p.text) if t is not None and content[at + i] > 0.5))
            at += len(p.parent)
        return out


def fit(sources: list[str], rounds: int = 200, rate: float = 0.15, decay: float = 1e-4) -> Model:
    """Fit on pages whose content elements carry ``data-label="1"``."""
    pages = [Page(s) for s in sources]
    for p in pages:  # what holds content is content
        for i in range(len(p.parent) - 1, 0, -1):
            if p.label[i]:
                p.label[p.parent[i]] = 1
    forest = Forest(pages)
    gold = np.array([y for p in pages for y in p.label])
    feats = [features(k) for k in forest.keys]
    flat, of = np.array([f for fs in feats for f in fs]), np.repeat(np.arange(len(feats)), [len(fs) for fs in feats])
    inner = forest.parent >= 0
    seen = np.zeros((EDGES, 2, 2))
    np.add.at(seen, (forest.edge[inner], gold[forest.parent[inner]], gold[inner]), 1)
    weights, pair = np.zeros(WEIGHTS), np.zeros((EDGES, 2, 2))
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (weights, pair)]
    for step in range(1, rounds + 1):
        score = np.bincount(of, weights[flat], len(feats))[forest.key_of]
        content, joint = forest.sum_product(score, pair)
        by_key = np.bincount(forest.key_of, gold - content, len(feats))
        grad_w = np.bincount(flat, by_key[of], WEIGHTS) / len(pages) - decay * weights
        expected = np.zeros_like(seen)
        np.add.at(expected, forest.edge[inner], joint[inner])
        grad_p = (seen - expected) / len(pages) - 10 * decay * pair
        for x, g, (a, b) in zip((weights, pair), (grad_w, grad_p), state):
            a *= 0.9
            a += 0.1 * g
            b *= 0.99
            b += 0.01 * g * g
            x += rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)
    return Model(weights, pair)


def labelled_pages(count: int = 480, seed: int = 5) -> list[str]:
    """Seeded labelled pages: content elements carry ``data-label="1"``."""
    rnd = random.Random(seed)
    parts = "an be co de en fa gi ho in ka le mo na or pe ra si ta un ve".split()
    word = lambda: "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(rnd.randint(a, b)))
    one = rnd.choice
    style = 0

    def sentences(a: int, b: int) -> str:
        """Plain sentences, or by the page's style shouted, marked up, repeated or laid out with bars."""
        found = [words(1 if style else 3, 14).capitalize() + one([".", ".", ".", "!", "?"]) for _ in range(rnd.randint(a, b))]
        if style == 1:
            return " ".join(found).upper().replace(" ", one(["!! ", " "]))
        if style == 2:
            return " ".join(w + one(["###", "***", "&amp;&amp;", "%%", ""]) for w in " ".join(found).split())
        if style == 3:
            return " ".join([word().capitalize() + one(["", ","])] * rnd.randint(2, 30))
        return (" | " if style == 4 else " ").join(found)

    def prose() -> str:
        kind = rnd.random()
        if kind < 0.2:
            return words(2, 9)
        text = sentences(1, 1) if kind < 0.4 else sentences(2, 9)
        if rnd.random() < 0.05:
            return f'<a href="/{word()}">{text}</a>'
        return text.replace(" ", f' <a href="/x">{word()}</a> ', 1) if rnd.random() < 0.15 else text

    def box(tags: list[str], attributes: str, inner: str) -> str:
        tag = one(tags)
        return f"<{tag}{attributes}>{inner}</{tag}>"

    def named(kinds: list[str]) -> str:
        return f' {one(["class", "id"])}="{one(kinds)}"'

    def links(tag: str = "li") -> str:
        return "".join(f'<{tag}><a href="/{word()}">{words(1, 3)}</a></{tag}>' for _ in range(rnd.randint(2, 8)))

    def references() -> str:
        """What an article cites: whole sentences, linked."""
        items = "".join(f'<li><a href="/{word()}">{words(6, 14).capitalize()}, {words(1, 3)}. {rnd.randint(1950, 2024)}.</a></li>' for _ in range(rnd.randint(2, 6)))
        return one(["", "<h2>References</h2>"]) + box(["ul", "ol"], "", items)

    def named_part() -> str:
        """A part of an article whose name could be that of something around one."""
        name = one(["discussion", "warning", "message", "related-work", "side-by-side", "banner", "highlight-box", "comparison-header", "read-more-text", "top-story-text"])
        inner = f"<p>{sentences(1, 3)}</p>" if style == 0 else f"<p>{words(9, 20).capitalize()}, {words(2, 5)}.</p>"
        return box(["div", "section", "figure"], f' {one(["class", "id", "class", "data-id"])}="{name}"', one(["", f"<h2>{words(1, 3)}</h2>"]) + inner * rnd.randint(1, 2))

    def article() -> str:
        out = [f"<h1>{one([words(1, 10), sentences(1, 1)])}</h1>"] if rnd.random() < 0.8 else []
        if out and rnd.random() < 0.15:
            out = [f"<header>{out[0]}</header>"]
        for _ in range(one([0, 1, 2, 4, 8, 14, 25])):
            k = rnd.random()
            if k < 0.06:
                out.append(named_part())
            elif k < 0.68:
                attributes = f' class="{one(["message", "related-work", "lead", "highlight"])}"' if rnd.random() < 0.04 else ""
                out.append(f"<p{attributes}>{sentences(1, 4) if attributes else prose()}</p>")
            elif k < 0.74:
                out.append(f"<p><b>{prose()}<br>")
            elif k < 0.8:
                out.append(box(["h2", "h3"], "", words(1, 7)))
            elif k < 0.85:
                out.append("<ul>" + "".join(f"<li>{prose()}</li>" for _ in range(rnd.randint(2, 5))) + "</ul>")
            elif k < 0.89:
                out.append(f"<blockquote>{sentences(1, 3)}</blockquote>")
            elif k < 0.92:
                out.append("<table>" + "".join(f"<tr><td>{words(1, 3)}</td><td>{words(1, 6)}</td></tr>" for _ in range(rnd.randint(1, 4))) + "</table>")
            elif k < 0.94:
                out.append(f"<div>{prose()}</div>")
            elif k < 0.95:
                out.append(references())
            elif k < 0.97:
                out.append(f"<figure><img src=x><figcaption>{words(2, 8)}</figcaption></figure>")
            else:
                out.append(f"<pre>{words(3, 20)}</pre>")
        return "".join(out)

    def some() -> str:
        return one([words(1, 9), sentences(1, 3), f"<p>{sentences(1, 2)}</p>", f"<h3>{words(1, 3)}</h3><p>{sentences(1, 2)}</p>"])

    def form() -> str:
        return f"<form{one(['', ' action=/s'])}><p>{words(1, 6)}</p><label>{words(1, 4)}</label><input><button>{word()}</button></form>"

    ads = ["ad", "ads", "advert", "advertisement", "sponsored", "promo-box", "ad-banner"]
    notes = ["cookie-notice", "consent", "notice", "alert", "newsletter-signup", "popup", "share", "subscribe", "social-links", "site-message"]
    sides = ["sidebar", "side", "related", "widget box", "right-rail", "recommended"]
    talks = ["comments", "comment-list", "replies", "discussion", "comments-area", "disqus_thread"]

    def talk(mark: str = "") -> str:
        if rnd.random() < 0.3:
            return box(["ol", "ul"], mark + ' class="commentlist"', "".join(f'<li class="comment">{some()}</li>' for _ in range(rnd.randint(1, 5))))
        inner = one(["", "<h2>Comments</h2>"]) + "".join(box(["div", "article", "p"], one(["", " class=comment"]), sentences(1, 4)) for _ in range(rnd.randint(1, 5)))
        return box(["div", "section"], mark + named(talks), inner)

    def junk(mark: str = "") -> str:
        """What isn't of the article, in or around it."""
        return one(
            [
                lambda: f"<nav{mark}><ul>{links()}</ul></nav>",
                lambda: box(["div", "nav", "ul"], mark + named(["menu", "nav-links", "breadcrumb", "pagination", "toc"]), links(one(["li", "span"]))),
                lambda: f"<aside{mark}>{some()}{one(['', f'<ul>{links()}</ul>'])}</aside>",
                lambda: box(["div", "section", "aside"], mark + named(sides), some()),
                lambda: box(["div", "section", "aside"], mark + named(ads), some()),
                lambda: box(["div", "section"], mark + named(notes), some() + one(["", "", form()])),
                lambda: box(["form"], mark, f"<p>{words(1, 6)}</p><label>{words(1, 4)}</label><input>"),
            ]
        )()

    def around() -> str:
        return one(
            [
                junk,
                junk,
                lambda: f"<ul>{links()}</ul>",
                lambda: f"<table><tr>{links('td')}</tr></table>",
                lambda: box(["div", "section"], named(["related", "banner", "message", "more", "top", "related-posts"]), one([some(), words(2, 8), f"<ul>{links()}</ul>"])),
                lambda: f"<header>{box(['h1', 'h2', 'div', 'p'], '', words(1, 5))}{one(['', f'<p>{sentences(1, 2)}</p>'])}</header>",
                lambda: box(["div"], named(["header", "masthead", "site-header", "topbar"]), some()),
                lambda: box(["div"], f' role="{one(["banner", "navigation", "complementary", "search"])}"', some()),
            ]
        )()

    def foot(mark: str = "") -> str:
        text = one([f"&copy; {word()}.example.com &middot; {sentences(1, 2)}", words(2, 12), sentences(1, 2), f"<p>{sentences(1, 2)}</p>"])
        legal = one([f"&copy; {rnd.randint(1990, 2024)} {words(1, 3)}", f"Copyright {words(1, 2)}. All rights reserved.", f"Copyright &copy; {word()}"])
        return one([f"<footer{mark}>{text}</footer>", f"<footer{mark}>{text}</footer>", box(["div"], mark + named(["footer", "site-footer", "bottom"]), text), box(["div", "p"], mark, legal), ""])

    out = []
    for _ in range(count):
        style = rnd.choice((0, 0, 0, 0, 1, 2, 3, 4))
        shell = one(
            [
                ("<article{}>", "</article>"),
                ("<article{}>", "</article>"),
                ("<main{}>", "</main>"),
                ("<main><article{}>", "</article></main>"),
                ('<div class="content"{}>', "</div>"),
                ('<div id="main"{}>', "</div>"),
                ('<div class="post-body"{}>', "</div>"),
                ("<section{}>", "</section>"),
                ("<div{}>", "</div>"),
                ('<div class="wrap"><div class="entry"{}>', "</div></div>"),
                ("", ""),
            ]
        )
        inner = article()
        if not shell[0]:  # blocks right in the body
            inner = re.sub(r"<(p|h\d|ul|ol|blockquote|div|section|table|pre|header|figure)\b", r'<\1 data-label="1"', inner)
        elif rnd.random() < 0.5:
            off = ' data-label="0"'
            for _ in range(rnd.randint(1, 3)):
                other = one([junk, junk, talk, foot])(off)
                inner = one([other + inner, inner + other, inner.replace("</p>", "</p>" + other, 1)])
        body = "".join(around() for _ in range(rnd.randint(0, 3))) + shell[0].format(' data-label="1"') + inner + shell[1] + one([str, talk, junk])() + foot()
        out.append(f"<!DOCTYPE html><html><head><title>{words(1, 6)}</title></head><body>{body}</body></html>")
    return out


def default_model() -> Model:
    return fit(labelled_pages())


_LIVE: dict[str, Model] = {}


def extract(pages: DataFrame, model: Model | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for every page. No shuffle; the model (fixed size) is broadcast."""
    model = model or default_model()
    spark = pages.sparkSession
    held = spark.sparkContext.broadcast((uuid.uuid4().hex, model.weights, model.pair))
    kinds = [pages.select(F.col(c)).schema[0].dataType.simpleString() for c in (id_col, url_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, weights, pair = held.value
        if key not in _LIVE:
            _LIVE.clear()
            _LIVE[key] = Model(weights, pair)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                text = _LIVE[key].extract(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["a", "b", "text", "n_chars"])

    slim = pages.select(F.col(id_col).alias("a"), F.col(url_col).alias("b"), F.col(html_col).cast("string").alias("h"))
    return slim.mapInArrow(run, f"a {kinds[0]}, b {kinds[1]}, text string, n_chars long").withColumnsRenamed({"a": id_col, "b": url_col})
