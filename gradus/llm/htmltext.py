"""Main text of web pages: gradient-boosted trees over features of DOM nodes, decoded along the tree.

A page becomes a tree of block elements and runs of inline text. Trees score each node from its tag,
its ancestors, the tokens of its attributes and its ancestors', densities of text and links in its
subtree, depth, and statistics of its siblings and its parent. Decoding takes the best of keeping a
subtree whole, dropping it whole, or deciding child by child, so that no kept node lies under a
dropped one. The trees are trained here, in numpy, on pages made up by make_page with known labels.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of
from .tokens import arrow_type

# Fixed values of HTML: elements that start a block, have no content, hold raw text, or are never read.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNREAD = frozenset("head script style textarea title xmp iframe noembed noframes noscript template svg select option button object canvas audio video datalist".split())
#: What may stand in a head; anything else ends it, as its tags are optional.
IN_HEAD = frozenset("head base basefont bgsound link meta noframes noscript script style template title".split())
#: An element of the key ends when one of the others starts, unless one of the last is in between.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"})}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>|<[/!?a-zA-Z][^<]*\Z|[^<]+|<""", re.S)
_ATTR = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


class Node:
    """A block element, or a run of inline text ('#') with text and the share of it in links."""

    __slots__ = ("tag", "parent", "children", "tokens", "text", "links", "label", "depth", "seen", "chars", "link_chars", "words", "tags", "stops", "blocks", "paras", "at")

    def __init__(self, tag: str, parent: Node | None, tokens: tuple[str, ...] = (), label: int | None = None):
        self.tag, self.parent, self.children, self.tokens, self.label = tag, parent, [], tokens, label
        self.depth = parent.depth + 1 if parent else 0
        self.text, self.links = "", 0
        if parent is not None:
            parent.children.append(self)


def attribute_tokens(attributes: str) -> tuple[str, ...]:
    """The lower-case parts of class, id, role and aria-label."""
    out: list[str] = []
    for name, a, b, c in _ATTR.findall(attributes):
        name = name.lower()
        if name in ("class", "id", "role", "aria-label", "data-main"):
            out += [f"={a or b or c}"] if name == "data-main" else [p.lower() for p in _PART.findall(a or b or c)]
    return tuple(dict.fromkeys(out))


def parse(page: str) -> Node:
    """The tree of a page, however broken. White space in runs is one space."""
    root = Node("html", None)
    stack: list[tuple[str, Node]] = [("html", root)]  # every open element, with the block it is in
    parts: list[str] = []
    linked = unread = anchors = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            run = Node("#", stack[-1][1], label=stack[-1][1].label)
            run.text, run.links = text, min(linked, len(text))
        parts.clear()
        linked = 0

    def close(depth: int) -> None:
        nonlocal unread, anchors
        while len(stack) > depth:
            tag, _ = stack[-1]
            if tag in BLOCKS:
                flush()
            unread -= tag in UNREAD
            anchors -= tag == "a"
            stack.pop()

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            if m[0][0] != "<" or m[0] == "<":
                if stack[-1][0] == "head" and not m[0].isspace():
                    close(len(stack) - 1)
                if not unread:
                    text = html.unescape(m[0]) if "&" in m[0] else m[0]
                    parts.append(text)
                    if anchors:
                        linked += len(text.strip())
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
            continue
        attributes = m[3] if m[2] else m[6]
        if stack[-1][0] == "head" and tag not in IN_HEAD:
            close(len(stack) - 1)
        if tag in ("html", "body"):
            flush()
            if tag == "body":
                close(1)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCKS:
            for k in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph
                if stack[k][0] == "p":
                    close(k)
                    break
                if stack[k][0] in BLOCKS:
                    break
            if tag in ENDS:
                ended, walls = ENDS[tag]
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in walls:
                        break
                    if stack[k][0] in ended:
                        close(k)
                        break
            flush()
        if tag in VOID:
            continue
        block = stack[-1][1]
        if tag in BLOCKS and not unread:
            tokens = attribute_tokens(attributes) if attributes.strip() else ()
            label = next((int(t == "=1") for t in tokens if t[0] == "="), block.label)
            block = Node(tag, block, tuple(t for t in tokens if t[0] != "="), label)
        unread += tag in UNREAD
        anchors += tag == "a"
        stack.append((tag, block))
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            close(len(stack) - 1)
    close(1)
    flush()
    return root


def runs(node: Node) -> Iterator[Node]:
    """In page order, without recursion: pages may nest deeply."""
    stack = [node]
    while stack:
        x = stack.pop()
        if x.tag == "#":
            yield x
        stack += reversed(x.children)


def nodes_of(root: Node) -> list[Node]:
    """All nodes with text below them, parents first; fills in the sums of their subtrees."""
    order, stack = [], [root]
    while stack:
        x = stack.pop()
        order.append(x)
        stack += reversed(x.children)
    place = 0
    for x in order:
        x.at = place
        place += x.tag == "#"
    for x in reversed(order):
        if x.tag == "#":
            x.chars, x.link_chars, x.words, x.tags, x.blocks = len(x.text), x.links, x.text.count(" ") + 1, 0, 1
            x.stops = sum(map(x.text.count, ".,;:!?"))
            x.paras = 0
        else:
            x.chars = x.link_chars = x.words = x.stops = x.blocks = 0
            x.tags, x.paras = 1, int(x.tag == "p")
            for c in x.children:
                x.chars += c.chars
                x.link_chars += c.link_chars
                x.words += c.words
                x.stops += c.stops
                x.tags += c.tags
                x.blocks += c.blocks
                x.paras += c.paras
    return [x for x in order if x.chars]


TAGS = "# p div section article main nav header footer aside form ul ol li table td h1 h2 h3 blockquote figure pre dl body".split()
ABOVE = "article main nav header footer aside form ul ol table figure blockquote dialog".split()
#: Words that sites use in the names of classes, ids and roles; the trees learn what they mean.
NAMES = "ad ads advert advertisement promo sponsored banner nav navbar menu navigation breadcrumb header masthead footer copyright sidebar side widget related recommended share social comment comments reply discussion cookie consent notice alert popup modal newsletter subscribe form login search article content post entry main body text story title byline author meta tag tags pager pagination disqus respond contentinfo complementary".split()
NUMBERS = 20
WIDTH = len(TAGS) + len(ABOVE) + 2 * len(NAMES)
_TAG, _ABOVE, _NAME = ({x: i for i, x in enumerate(xs)} for xs in (TAGS, ABOVE, NAMES))


def features(order: list[Node]) -> tuple[np.ndarray, np.ndarray]:
    """Of nodes as nodes_of gives them: flags (bool) and numbers, a row each."""
    flags, numbers = np.zeros((len(order), WIDTH), bool), np.zeros((len(order), NUMBERS), np.float32)
    above: dict[int, tuple[frozenset, frozenset]] = {}
    total, n_blocks = max(order[0].chars, 1) if order else 1, max(order[0].blocks, 1) if order else 1
    for i, x in enumerate(order):
        up = x.parent
        tags, names = above[id(up)] if up is not None else (frozenset(), frozenset())
        own = frozenset(k for t in x.tokens if (k := _NAME.get(t)) is not None) if x.tokens else frozenset()
        if x.tag in _TAG:
            flags[i, _TAG[x.tag]] = True
        at = len(TAGS)
        for k in tags:
            flags[i, at + k] = True
        at += len(ABOVE)
        for k in own:
            flags[i, at + k] = True
        at += len(NAMES)
        for k in names:
            flags[i, at + k] = True
        above[id(x)] = (tags | {_ABOVE[x.tag]} if x.tag in _ABOVE else tags, names | own if own else names)
        p = up or x
        siblings = p.children
        numbers[i] = (
            x.chars, x.link_chars / x.chars, x.chars / (x.tags + 1), x.words, x.chars / x.words, x.stops / x.words, x.depth, x.blocks, x.words / x.blocks, x.paras,
            x.chars / total, x.at / n_blocks, x.chars / max(p.chars, 1), p.chars, p.link_chars / max(p.chars, 1), p.paras, len(siblings), p.words / max(p.blocks, 1), p.stops / max(p.words, 1), p.chars / total,
        )
    return flags, numbers


class Boosted:
    """Gradient-boosted trees on flags and on numbers cut at quantiles, with logistic loss."""

    def __init__(self, flags: np.ndarray, numbers: np.ndarray, y: np.ndarray, trees: int = 70, rate: float = 0.25, depth: int = 4, cuts: int = 10, weight: np.ndarray | None = None):
        quantiles = np.linspace(0, 1, cuts + 2)[1:-1]
        self.cuts = [np.unique(np.quantile(numbers[:, j], quantiles)) for j in range(numbers.shape[1])]
        b = self.binary(flags, numbers)
        bf = b.astype(np.float32)
        weight = np.ones(len(y)) if weight is None else weight
        self.trees: list[list[tuple[int, float]]] = []
        f = np.zeros(len(y))
        for _ in range(trees):
            p = 1 / (1 + np.exp(-f))
            g, h = (weight * (y - p)).astype(np.float32), (weight * p * (1 - p)).astype(np.float32)
            tree = [(-1, 0.0)] * (2 ** (depth + 1) - 1)
            where = np.zeros(len(y), np.int64)
            for level in range(depth):
                ks = range(2**level - 1, 2 ** (level + 1) - 1)
                sums = np.stack([v * (where == k) for k in ks for v in (g, h)]) @ bf  # of each node of the level at once
                for i, k in enumerate(ks):
                    rows = np.flatnonzero(where == k)
                    if len(rows) < 20:
                        continue
                    g1, h1, gk, hk = sums[2 * i], sums[2 * i + 1], g[rows].sum(), h[rows].sum()
                    gain = np.where((h1 > 0.5) & (hk - h1 > 0.5), g1**2 / (h1 + 1) + (gk - g1) ** 2 / (hk - h1 + 1), -1.0) - gk**2 / (hk + 1)
                    best = int(gain.argmax())
                    if gain[best] > 1e-3:
                        tree[k] = (best, 0.0)
                        where[rows] = 2 * k + 1 + b[rows, best]
            for k in np.unique(where):
                rows = where == k
                tree[k] = (-1, float(rate * g[rows].sum() / (h[rows].sum() + 1)))
                f[rows] += tree[k][1]
            self.trees.append(tree)
        used = sorted({j for t in self.trees for j, _ in t if j >= 0})
        place = {j: k for k, j in enumerate(used)}
        self.used = used
        self.split = np.array([[place.get(j, -1) for j, _ in t] for t in self.trees])
        self.value = np.array([[v for _, v in t] for t in self.trees])
        self.depth = depth

    def binary(self, flags: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        return np.concatenate([flags, *(numbers[:, j : j + 1] > c for j, c in enumerate(self.cuts))], axis=1)

    def logits(self, flags: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        b = self.binary(flags, numbers)[:, self.used]
        out = np.zeros(len(b))
        rows = np.arange(len(b))
        for split, value in zip(self.split, self.value, strict=True):
            at = np.zeros(len(b), np.int64)
            for _ in range(self.depth):
                j = split[at]
                at = np.where(j >= 0, 2 * at + 1 + b[rows, np.maximum(j, 0)], at)
            out += value[at]
        return out


def decode(order: list[Node], logits: np.ndarray, mixed: float = -0.7) -> list[Node]:
    """The kept runs, in page order: the best of keeping or dropping each subtree whole, or child by child."""
    z = np.clip(logits, -12, 12)
    keep, drop = -np.logaddexp(0, -z), -np.logaddexp(0, z)
    index = {id(x): i for i, x in enumerate(order)}
    kept, dropped, best, choice = keep.tolist(), drop.tolist(), [0.0] * len(order), [0] * len(order)
    for i in range(len(order) - 1, -1, -1):
        x = order[i]
        below = [j for c in x.children if (j := index.get(id(c))) is not None]
        each = mixed + sum(best[j] for j in below) if below else -math.inf
        kept[i] += sum(kept[j] for j in below)
        dropped[i] += sum(dropped[j] for j in below)
        options = (dropped[i], kept[i], each)
        choice[i] = max(range(3), key=options.__getitem__)
        best[i] = options[choice[i]]
    out, stack = [], [(order[0], 2)] if order else []
    while stack:
        x, state = stack.pop()
        if state == 2:
            state = choice[index[id(x)]]
        if state and x.tag == "#":
            out.append(x)
        if state:
            stack += [(c, state) for c in reversed(x.children) if c.chars]
    return out


def _words(rng: random.Random, n: int) -> str:
    """A made-up sentence or several, with stops and capitals, as its own language."""
    syllables = rng.choice((["ka", "lo", "mi", "ter", "un", "de", "ra"], ["é", "ç", "ou", "le", "tion", "eau"], ["sch", "ver", "ung", "ä", "en", "ge"], ["的", "了", "是", "在", "有"], ["по", "на", "ста", "не", "то"]))
    out, start = [], True
    for _ in range(n):
        w = "".join(rng.choices(syllables, k=rng.randint(1, 4)))
        if rng.random() < 0.04:
            w += rng.choice(["***", "%%%", "###", "$$$", " |"])
        out.append(w.capitalize() if start else w)
        start = rng.random() < 0.1
        if start:
            out[-1] += rng.choice(".....!?")
        elif rng.random() < 0.08:
            out[-1] += ","
    return html.escape(" ".join(out)) + ("." if rng.random() < 0.8 else "")


def make_page(rng: random.Random) -> str:
    """A page whose blocks carry data-main 1 (article) or 0."""
    w = lambda a, b: _words(rng, rng.randint(a, b))
    attr = lambda *names: rng.choice([f' class="{rng.choice(names)}"', f' id="{rng.choice(names)}"', f' class="{rng.choice(names)} {rng.choice("abcxyz")}{rng.randint(1, 99)}"'])
    plain = lambda s: s if rng.random() < 0.6 else ""

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{w(1, 3)}</a></li>' for i in range(n)) + "</ul>"

    def boiler(kind: str) -> str:
        d = ' data-main="0"'
        if kind == "nav":
            return rng.choice([f"<nav{d}{plain(attr('nav', 'main-menu', 'navbar'))}>{links(rng.randint(2, 9))}</nav>", f"<div{d}{attr('nav', 'menu', 'navigation', 'breadcrumb', 'navbar')}>{links(rng.randint(2, 9))}</div>", f"<nav{d}>" + " | ".join(f'<a href="/{i}">{w(1, 2)}</a>' for i in range(5)) + "</nav>"])
        if kind == "header":
            return rng.choice([f"<header{d}{plain(attr('header', 'site-header'))}><h1>{w(1, 4)}</h1><p>{w(2, 9)}</p></header>", f"<div{d}{attr('header', 'masthead', 'banner')}><div>{w(1, 5)}</div><p>{w(1, 8)}</p></div>"])
        if kind == "footer":
            return rng.choice([f"<footer{d}{plain(attr('footer', 'contentinfo'))}>&copy; {w(2, 30)}</footer>", f"<div{d}{attr('footer', 'copyright', 'site-footer')}><p>&copy; {w(3, 20)}</p>{links(3)}</div>"])
        if kind == "ad":
            return f"<{(t := rng.choice(['div', 'section', 'aside', 'p']))}{d}{attr('ad', 'ads', 'advert', 'promo', 'sponsored', 'banner', 'advertisement')}>{rng.choice([w(2, 20), f'<p>{w(3, 30)}</p>'] if t != 'p' else [w(2, 20)])}</{t}>"
        if kind == "side":
            return rng.choice([f"<aside{d}{plain(attr('sidebar', 'widget'))}><h3>{w(1, 3)}</h3>{rng.choice([links(5), f'<p>{w(5, 40)}</p>'])}</aside>", f"<div{d}{attr('sidebar', 'side', 'widget', 'related', 'recommended')}><h3>{w(1, 4)}</h3>{rng.choice([links(4), f'<p>{w(4, 30)}</p>'])}</div>"])
        if kind == "notice":
            return f"<{(t := rng.choice(['div', 'section', 'dialog']))}{d}{attr('cookie', 'cookie-notice', 'consent', 'alert', 'popup', 'modal', 'notice', 'newsletter')}><p>{w(4, 30)}</p></{t}>"
        if kind == "form":
            return f"<form{d}{plain(attr('search', 'login', 'newsletter', 'subscribe-form'))}><label>{w(1, 4)}</label><input name=q><p>{w(1, 12)}</p><button>{w(1, 2)}</button></form>"
        if kind == "share":
            return f"<div{d}{attr('share', 'social', 'tags', 'pagination', 'byline', 'meta')}>" + " ".join(f'<a href="#">{w(1, 2)}</a>' for _ in range(4)) + "</div>"
        rows = "".join(rng.choice([f"<div class=\"comment\"><p>{w(3, 40)}</p></div>", f"<li class=\"comment\"><b>{w(1, 2)}</b><p>{w(3, 40)}</p></li>", f"<article class=\"comment\"><p>{w(3, 40)}</p></article>"]) for _ in range(rng.randint(1, 6)))
        return f"<{(t := rng.choice(['div', 'section', 'ol']))}{d}{attr('comments', 'comment-list', 'discussion', 'disqus')}><h3>{w(1, 3)}</h3>{rows}</{t}>"

    def article() -> str:
        parts = [f"<h1{plain(attr('title', 'entry-title'))}>{w(1, 12)}</h1>"] if rng.random() < 0.85 else []
        for _ in range(rng.choice([0, 1, 2, 3, 5, 8, 13, 20])):
            kind = rng.random()
            size = rng.choice([1, 2, 5, 12, 30, 60, 120])
            if kind < 0.75:
                parts.append(rng.choice([f"<p>{w(1, size)}</p>", f"<p>{w(1, size)}</p>", f"<p><b>{w(1, size)}<br>", f"<p>{w(1, size)} <a href='/x'>{w(1, 3)}</a> {w(1, size)}</p>", f"<div>{w(1, size)}</div>"]))
            elif kind < 0.82:
                parts.append(f"<h2>{w(1, 6)}</h2>")
            elif kind < 0.88:
                parts.append("<ul>" + "".join(f"<li>{w(2, 15)}</li>" for _ in range(rng.randint(2, 6))) + "</ul>")
            elif kind < 0.92:
                parts.append(f"<blockquote><p>{w(4, 40)}</p></blockquote>")
            elif kind < 0.96:
                parts.append("<table>" + "".join(f"<tr><td>{w(1, 4)}</td><td>{w(1, 4)}</td></tr>" for _ in range(3)) + "</table>")
            else:
                parts.append(rng.choice([f"<pre>{w(3, 20)}</pre>", f"<figure><figcaption>{w(3, 12)}</figcaption></figure>"]))
        if not parts:
            parts = [f"<p>{w(1, 200)}</p>"]
        for _ in range(rng.choice([0, 0, 1, 2])):
            parts.insert(rng.randint(1, len(parts)), boiler(rng.choice(["ad", "share", "side", "form", "notice"])))
        if rng.random() < 0.15:
            parts.append(boiler("comments"))
        body = "".join(parts)
        return rng.choice([f'<article data-main="1">{body}</article>', f'<article data-main="1"{attr("post", "article", "entry")}>{body}</article>', f'<main><article data-main="1">{body}</article></main>', f'<main data-main="1">{body}</main>', f'<div data-main="1"{attr("content", "post", "entry-content", "article-body", "story", "text", "main")}>{body}</div>', f'<div><div data-main="1"{attr("content", "post-body", "article", "main-content")}><div>{body}</div></div></div>'])

    before = [boiler(rng.choice(["nav", "header", "ad", "notice", "form", "nav", "side"])) for _ in range(rng.randint(0, 4))]
    after = [boiler(rng.choice(["side", "ad", "comments", "share", "form", "nav", "notice"])) for _ in range(rng.randint(0, 3))]
    if rng.random() < 0.8:
        after.append(boiler("footer"))
    if rng.random() < 0.1:
        return "<html><body>" + "".join(before + after) + "</body></html>"
    inner = "".join([*before, article(), *after])
    return f"<html><head><title>{w(1, 5)}</title></head><body>" + rng.choice([inner, inner, f'<div class="wrapper">{inner}</div>', f'<div id="page"><div class="row">{inner}</div></div>']) + "</body></html>"


def labelled(pages: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features and labels of the nodes whose text is all of one kind."""
    flags, numbers, y = [], [], []
    for page in pages:
        order = nodes_of(parse(page))
        if not order:
            continue
        kinds: dict[int, set] = {}
        for x in reversed(order):
            kinds.setdefault(id(x), set())
            if x.tag == "#":
                kinds[id(x)].add(x.label or 0)
            if x.parent is not None:
                kinds.setdefault(id(x.parent), set()).update(kinds[id(x)])
        pure = [i for i, x in enumerate(order) if len(kinds[id(x)]) == 1]
        f, v = features(order)
        flags.append(f[pure])
        numbers.append(v[pure])
        y += [next(iter(kinds[id(order[i])])) for i in pure]
    return np.concatenate(flags), np.concatenate(numbers), np.array(y, float)


@lru_cache(maxsize=2)
def train(n_pages: int = 800, seed: int = 11) -> Boosted:
    rng = random.Random(seed)
    return Boosted(*labelled([make_page(rng) for _ in range(n_pages)]))


def extract(pages: list[str], model: Boosted) -> list[str]:
    """The main text of each page: kept runs, two newlines between them."""
    orders = [nodes_of(parse(p)) for p in pages]
    parts = [features(o) for o in orders]
    logits = model.logits(np.concatenate([f for f, _ in parts]), np.concatenate([v for _, v in parts])) if parts else np.empty(0)
    out, at = [], 0
    for o in orders:
        out.append("\n\n".join(x.text for x in decode(o, logits[at : at + len(o)])))
        at += len(o)
    return out


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: id_col, url_col, text, n_chars.

    A null or empty page, and one without an article, has the empty text. Broken markup is read as
    far as it goes; repeated rows are read each; whole pages are read.
    """
    shared = pages.sparkSession.sparkContext.broadcast(train())
    got = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    id_type = arrow_type(got, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, urls, sources in rows_of(batches, "id", "url", "html", step=32):
            texts = extract([(s or b"").decode("utf-8", "replace") for s in sources], shared.value)
            yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(urls, pa.binary()).cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    return got.mapInArrow(run, f"id {got.schema['id'].dataType.simpleString()}, url string, text string, n_chars long").select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
