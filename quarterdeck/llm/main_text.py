"""Main text of web pages by a tree-structured graphical model of their elements.

A page becomes a tree of block elements with runs of text as leaves. Every node is content or
not. Its own features (tag, words of class and id, role, length, share of link text) give a
potential; each edge gives a potential for the labels of parent and child. Messages passed from
the leaves up and from the root down (sum-product, exact on a tree) give every node's marginal;
runs of text above one half are the main text. Weights are fitted by gradient ascent on the
likelihood of labelled pages, which the same messages provide. The labelled pages are drawn from
a small page grammar with varied markup for articles and for what surrounds them.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MARK = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    # A quote counts after "=" only; what has been read is not read another way.
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=\"'/>]+)")
_WORD = re.compile(r"[a-z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is raw text that is never shown as running text.
SILENT = frozenset("script style template iframe textarea title".split())
#: Elements that do not cut running text; fallback content, formulas and drawings count as text of their surroundings.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr picture noscript object audio video canvas "
    "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover "
    "munderover mmultiscripts mtable mtr mtd maction semantics annotation "
    "svg g path text tspan textpath circle ellipse rect line polyline polygon defs use symbol stop lineargradient "
    "radialgradient clippath mask pattern marker desc".split()
)
#: An open element of the first kind ends when one of the second begins.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"},
         "option": {"option"}, "head": {"body"}}
#: Words of class and id, by what they speak for.
_HINTS = {
    "advert": "ad ads advert advertisement adsense sponsor sponsored promo promotion banner commercial".split(),
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toolbar tabs toc skip".split(),
    "frame": "header masthead footer copyright colophon topbar bottom site".split(),
    "side": "sidebar side aside widget related recommended popular trending more rail tags categories".split(),
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay banner message disclaimer subscribe newsletter signup".split(),
    "reader": "comment comments commentlist reply replies respond disqus discussion feedback reader".split(),
    "social": "share sharing social follow like tweet buttons".split(),
    "form": "form search login register input".split(),
    "body": "article content post entry story main body text page prose blog news".split(),
}
_HINT_OF = {w: k for k, words in _HINTS.items() for w in words}
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


@dataclass
class Page:
    """Nodes of a page in page order; the parent of the first is -1."""

    parent: list[int] = field(default_factory=list)
    features: list[list[str]] = field(default_factory=list)
    text: list[str | None] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    label: list[int] = field(default_factory=list)


def _attributes(source: str) -> dict[str, str]:
    return {
        (m[1] or m[5]).lower(): next((v for v in m.group(2, 3, 4) if v is not None), "") for m in _ATTRIBUTE.finditer(source)
    }


def _element_features(tag: str, source: str) -> tuple[list[str], str]:
    """Features of an element, and its mark in labelled pages."""
    out, mark = ["tag " + tag], ""
    if source.strip(" /"):
        given = _attributes(source)
        words = _WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", f"{given.get('class', '')} {given.get('id', '')}").lower())
        out += ["hint " + k for k in sorted({_HINT_OF[w] for w in words if w in _HINT_OF})]
        if "role" in given:
            out.append("role " + given["role"].lower())
        if "hidden" in given or given.get("aria-hidden") == "true" or _HIDDEN.search(given.get("style", "")):
            out.append("hidden")
        mark = given.get("data-main", "")
    return out, mark


def _text_features(text: str, linked: int, tag: str) -> list[str]:
    size = len(text)
    share = linked / size
    return [
        "text in " + tag, f"length {min(8, int(log2(size + 1)))}",
        "links none" if linked == 0 else "links some" if share < 0.4 else "links most",
        "stop" if text[-1] in ".!?…。:\"”»" else "no stop",
        "copyright" if "©" in text else "no copyright",
    ]


def parse(source: str) -> Page:
    """Tree of a page's block elements and runs of text."""
    page = Page()
    stack: list[tuple[str, int, str]] = []
    pieces: list[str] = []
    links, linked = 0, 0
    opened: Counter[str] = Counter()

    def node(features: list[str], text: str | None) -> int:
        page.parent.append(stack[-1][1] if stack else -1)
        page.depth.append(len(stack))
        page.features.append(features)
        page.text.append(text)
        page.label.append(int(bool(stack) and stack[-1][2] == "yes"))
        return len(page.parent) - 1

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(pieces).split())
        pieces.clear()
        if text:
            node(_text_features(text, min(linked, len(text)), stack[-1][0] if stack else "none"), text)
        linked = 0

    def leave() -> str:
        tag = stack.pop()[0]
        opened[tag] -= 1
        return tag

    # A root that is always there.
    stack.append(("root", node(["tag root"], None), ""))
    at, end = 0, len(source)
    while at < end:
        m = _MARK.search(source, at)
        if m is None:
            piece = html.unescape(source[at:])
            pieces.append(piece)
            linked += len(piece) if links else 0
            break
        if m.start() > at:
            piece = html.unescape(source[at : m.start()])
            pieces.append(piece)
            linked += len(piece) if links else 0
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        tag, closing, rest = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag in SILENT:
            if not closing and not rest.endswith("/"):
                # Raw text up to the closing tag, or to the end.
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*>?", re.IGNORECASE).search(source, at)
                at = close.end() if close else end
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag in INLINE:
            if tag == "a":
                links = 0 if closing else 1
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if closing:
            if opened[tag]:
                flush()
                while leave() != tag:
                    pass
            continue
        flush()
        links = 0
        if stack[-1][0] == "p":
            leave()
        while len(stack) > 1 and tag in _ENDS.get(stack[-1][0], ()):
            leave()
        features, mark = _element_features(tag, rest)
        stack.append((tag, node(features, None), mark or stack[-1][2]))
        opened[tag] += 1
        page.label[-1] = int(stack[-1][2] == "yes")
    flush()
    return page


class Forest:
    """Nodes of several pages, grouped by depth for message passing."""

    def __init__(self, pages: list[Page], names: dict[str, int]):
        sizes = np.array([len(p.parent) for p in pages], np.int64)
        base = np.cumsum(sizes) - sizes
        self.bounds = np.append(base, sizes.sum())
        parent = np.concatenate([np.array(p.parent, np.int64) for p in pages]) if pages else np.zeros(0, np.int64)
        self.parent = np.where(parent >= 0, parent + np.repeat(base, sizes), -1)
        depth = np.concatenate([np.array(p.depth, np.int64) for p in pages]) if pages else np.zeros(0, np.int64)
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.searchsorted(depth[order], np.arange(1, depth.max() + 1))) if len(depth) else []
        self.leaf = np.array([t is not None for p in pages for t in p.text], bool)
        self.row, self.column = [], []
        for i, features in enumerate(f for p in pages for f in p.features):
            for name in features:
                if name in names:
                    self.row.append(i)
                    self.column.append(names[name])
        self.row, self.column = np.array(self.row, np.int64), np.array(self.column, np.int64)

    def marginals(self, weights: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(content) per node and the joint of parent and child per node (node x parent label x own label).

        ``edges`` holds the log potentials by kind of child (element, text) and the two labels.
        """
        n = len(self.parent)
        own = np.zeros((n, 2))
        if len(self.row):
            own[:, 1] = np.bincount(self.row, weights=weights[self.column], minlength=n)
        pair = edges[self.leaf.astype(int)]
        inward, message = own.copy(), np.zeros((n, 2))
        for level in reversed(self.levels[1:]):
            sent = np.logaddexp(pair[level, :, 0] + inward[level, None, 0], pair[level, :, 1] + inward[level, None, 1])
            message[level] = sent
            np.add.at(inward, self.parent[level], sent)
        outward = np.zeros((n, 2))
        for level in self.levels[1:]:
            up = self.parent[level]
            rest = inward[up] + outward[up] - message[level]
            outward[level] = np.logaddexp(pair[level, 0, :] + rest[:, 0, None], pair[level, 1, :] + rest[:, 1, None])
        belief = inward + outward
        p = 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -60, 60)))
        joint = np.zeros((n, 2, 2))
        child = np.flatnonzero(self.parent >= 0)
        up = self.parent[child]
        rest = inward[up] + outward[up] - message[child]
        log_joint = pair[child] + rest[:, :, None] + inward[child][:, None, :]
        log_joint -= log_joint.max(axis=(1, 2), keepdims=True)
        joint[child] = np.exp(log_joint)
        joint[child] /= joint[child].sum(axis=(1, 2), keepdims=True)
        return p, joint


@dataclass(frozen=True)
class TreeModel:
    names: dict[str, int]
    weights: np.ndarray
    edges: np.ndarray

    def main_texts(self, pages: list[str]) -> list[str]:
        trees = [parse(p or "") for p in pages]
        forest = Forest(trees, self.names)
        p, _ = forest.marginals(self.weights, self.edges)
        out = []
        for tree, base in zip(trees, forest.bounds, strict=False):
            out.append("\n\n".join(t for i, t in enumerate(tree.text) if t is not None and p[base + i] >= 0.5))
        return out


def fit(pages: list[str], steps: int = 300, penalty: float = 0.02, rate: float = 0.3) -> TreeModel:
    """Fit weights to labelled pages: text below an element marked data-main="yes" is content, "no" is not.

    An element is content if it holds content.
    """
    trees = [parse(p) for p in pages]
    for tree in trees:
        held = [0] * len(tree.parent)
        for i in reversed(range(len(tree.parent))):
            held[i] = max(held[i], tree.label[i] if tree.text[i] is not None else 0)
            if tree.parent[i] >= 0:
                held[tree.parent[i]] = max(held[tree.parent[i]], held[i])
        tree.label = held
    names = {name: i for i, name in enumerate(sorted({f for t in trees for own in t.features for f in own}))}
    forest = Forest(trees, names)
    y = np.array([v for t in trees for v in t.label], float)
    child = np.flatnonzero(forest.parent >= 0)
    seen = np.zeros((2, 2, 2))
    np.add.at(seen, (forest.leaf[child].astype(int), y[forest.parent[child]].astype(int), y[child].astype(int)), 1.0)
    weights, edges = np.zeros(len(names)), np.zeros((2, 2, 2))
    size_w, size_e = np.full(len(names), 1e-6), np.full((2, 2, 2), 1e-6)
    for _ in range(steps):
        p, joint = forest.marginals(weights, edges)
        slope = np.bincount(forest.column, weights=(y - p)[forest.row], minlength=len(names)) - penalty * len(trees) * weights / 10
        expected = np.stack([joint[child[~forest.leaf[child]]].sum(axis=0), joint[child[forest.leaf[child]]].sum(axis=0)])
        slope_e = seen - expected - penalty * len(trees) * edges / 10
        size_w += slope**2
        size_e += slope_e**2
        weights += rate * slope / np.sqrt(size_w)
        edges += rate * slope_e / np.sqrt(size_e)
    return TreeModel(names, weights, edges)


def labelled_pages(count: int = 500, seed: int = 5) -> list[str]:
    """Pages of a small grammar, with data-main marks on what is content and what is not."""
    draw = random.Random(seed)
    pick = draw.choice

    def words(low: int, high: int) -> str:
        return " ".join("".join(draw.choices("abcdefghijklmnopqrstuvwxyzäéñß", k=draw.randint(1, 9))) for _ in range(draw.randint(low, high)))

    def sentence(low: int = 3, high: int = 25) -> str:
        return words(low, high).capitalize() + pick([".", ".", ".", "!", "?", ""])

    def prose() -> str:
        if draw.random() < 0.1:
            return words(1, 2).capitalize() + pick([".", ""])
        if draw.random() < 0.1:
            return " | ".join(words(1, 1) for _ in range(draw.randint(3, 30)))
        return " ".join(sentence() for _ in range(draw.randint(1, 7)))

    def link(low: int = 1, high: int = 3) -> str:
        return f'<a href="/{words(1, 1)}">{words(low, high)}</a>'

    def no(tag: str, inner: str, *classes: str, keep: bool = False) -> str:
        """An element that is no content; a plain tag may go without telling class."""
        name = pick(classes) if classes and (keep or draw.random() < 0.85) else ""
        if tag == "p":
            inner = re.sub(r"</?(p|div|button)[^>]*>", " ", inner)
        given = f' {pick(["class", "class", "id"])}="{name}"' if name else ""
        return f'<{tag}{given} data-main="no">{inner}</{tag}>'

    def links(n: int) -> str:
        return "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(n)) + "</ul>"

    def menu() -> str:
        return pick([
            lambda: no("nav", links(draw.randint(3, 9)), "menu", "main-nav", "top"),
            lambda: no("div", links(draw.randint(3, 9)), "nav", "navbar", "menu", "breadcrumbs", keep=True),
            lambda: no("nav", " ".join(link() for _ in range(6)), "pagination", "breadcrumb"),
            lambda: no("ul", "".join(f"<li>{link()}" for _ in range(6)), "menu", "navigation", keep=True),
        ])()

    def head() -> str:
        inner = pick([lambda: f"<h1>{words(1, 4)}</h1>", lambda: link(), lambda: f"<p>{sentence()}</p>", lambda: words(1, 5)])()
        return no(pick(["header", "header", "div"]), inner + (menu() if draw.random() < 0.4 else ""), "header", "site-header", "masthead", keep=True)

    def foot() -> str:
        inner = pick([
            lambda: f"&copy; {words(1, 2)} &middot; {sentence()}", lambda: f"<p>&copy; {words(1, 4)}</p>" + links(3),
            lambda: f"<p>{sentence()}</p>", lambda: prose(), lambda: f"<div>{prose()}</div>",
        ])()
        return no(pick(["footer", "footer", "footer", "div"]), inner, "footer", "site-footer", "copyright", keep=True)

    def advert() -> str:
        inner = pick([lambda: prose(), lambda: f"<p>{prose()}</p>", lambda: link(3, 8), lambda: f"<a href=x>{sentence()}</a>"])()
        return no(pick(["div", "div", "aside", "section", "p"]), inner, "ad", "ads", "advert", "sponsored", "promo", "ad-banner", "advertisement", keep=True)

    def side() -> str:
        inner = pick([
            lambda: f"<h3>{words(1, 3)}</h3>" + links(4), lambda: f"<p>{prose()}</p>", lambda: f"<h2>{words(1, 2)}</h2><p>{sentence()}</p>",
            lambda: prose(),
        ])()
        tag = pick(["aside", "aside", "div", "section"])
        return no(tag, inner, "sidebar", "widget", "related", "side", "popular", keep=tag != "aside")

    def notice() -> str:
        inner = pick([lambda: sentence(), lambda: f"<p>{sentence()}</p><button>{words(1, 2)}</button>", lambda: prose()])()
        given = pick(['class="cookie-notice"', 'id="cookie"', 'class="notice"', 'class="consent banner"', 'role="alert"', 'role="dialog" class="popup"', 'class="newsletter"', 'class="modal"'])
        tag = pick(["div", "section", "p", "aside"])
        if tag == "p":
            inner = sentence()
        return f'<{tag} {given} data-main="no">{inner}</{tag}>'

    def form() -> str:
        inner = pick([
            lambda: f"<label>{words(1, 3)}</label><input name=q><button>{words(1, 2)}</button>",
            lambda: f"<p>{sentence()}</p><input type=email><button>{words(1, 1)}</button>",
            lambda: f"<fieldset><legend>{words(1, 3)}</legend><p>{words(2, 6)}</p><textarea>{words(2, 4)}</textarea></fieldset>",
        ])()
        return no("form", inner, "search", "signup", "login", "newsletter")

    def reader() -> str:
        one = lambda: pick([
            lambda: f'<li class="comment"><p>{prose()}</p></li>', lambda: f'<div class="comment"><b>{words(1, 2)}</b><p>{prose()}</p></div>',
            lambda: f"<p>{prose()}</p>", lambda: f'<article class="comment"><p>{prose()}</p></article>',
        ])()
        body = f"<h2>{words(1, 2)}</h2>" * (draw.random() < 0.6) + "".join(one() for _ in range(draw.randint(1, 5)))
        return no(pick(["section", "div", "div", "ol"]), body, "comments", "comment-list", "reader-comments", "replies", "discussion", keep=True)

    def share() -> str:
        return no("div", " ".join(link(1, 1) for _ in range(4)), "share", "social-links", "tags", keep=True)

    def block() -> str:
        return pick([
            *[lambda: f"<p>{prose()}</p>"] * 6, lambda: f"<p>{prose()} {link()} {prose()}</p>", lambda: f"<h2>{words(1, 8)}</h2><p>{prose()}</p>",
            lambda: f"<blockquote><p>{prose()}</p></blockquote>", lambda: f"<ul><li>{sentence()}<li>{prose()}</ul>",
            lambda: f"<ol><li>{prose()}</li><li>{sentence()}</li></ol>", lambda: f"<pre>{words(3, 20)}</pre>",
            lambda: f"<table><tr><td>{words(1, 3)}<td>{words(1, 3)}</tr></table>", lambda: f"<div>{prose()}</div>",
            lambda: f"<p><b>{prose()}<br><p>{prose()}</p>", lambda: f"<figure><img src=x><figcaption>{sentence()}</figcaption></figure>",
            lambda: f"{prose()}<br>{prose()}", lambda: f"<section><h3>{words(1, 5)}</h3><p>{prose()}</p></section>",
        ])()

    def content() -> str:
        title = pick([lambda: f"<h1>{words(1, 12)}</h1>", lambda: f"<header><h1>{words(1, 12)}</h1></header>", lambda: f"<h1>{sentence()}</h1>"])()
        inside = [title]
        for _ in range(draw.choice([0, 1, 1, 2, 3, 5, 8, 15])):
            inside.append(block())
            if draw.random() < 0.06:
                inside.append(pick([advert, form, share, side, notice])())
        body = "".join(inside)
        tag, name = pick([
            ("article", ""), ("article", ""), ("article", ' class="post"'), ("main", ""), ("div", ' class="content"'), ("div", ' id="main"'),
            ("div", ' class="article-body"'), ("section", ' class="entry"'), ("div", ' role="main"'), ("div", ' class="post-content"'),
        ])
        out = f'<{tag}{name} data-main="yes">{body}</{tag}>'
        if draw.random() < 0.25:
            out = f"<main>{out}</main>" if tag != "main" else f"<div>{out}</div>"
        if draw.random() < 0.2:
            out = f'<div class="{pick(["container", "wrapper", "page", "site"])}">{out}{side() if draw.random() < 0.4 else ""}</div>'
        return out

    pages = []
    for _ in range(count):
        before = "".join(pick([menu, head, advert, notice, form, side])() for _ in range(draw.randint(0, 4)))
        after = "".join(pick([side, advert, reader, foot, share, form, notice, menu])() for _ in range(draw.randint(0, 4)))
        rest = foot() if draw.random() < 0.8 else ""
        page = f"<!DOCTYPE html><html><head><title>{words(1, 6)}</title><style>p{{}}</style></head><body>{before}{content()}{after}{rest}"
        pages.append(page + ("</body></html>" if draw.random() < 0.85 else ""))
    return pages


@lru_cache(maxsize=1)
def trained() -> TreeModel:
    return fit(labelled_pages())


def extract_main_text(pages: DataFrame, html_column: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns, ``text`` and ``n_chars`` (code points) per row of ``pages``.

    Blocks come in page order, joined by two line breaks; white space inside a block is one
    space and character references are decoded. Null and empty pages, and pages without main
    text, give the empty text. Repeated rows keep a row each; other columns are not read.
    """
    shared = pages.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources = batch.column("_html")
            for low in range(0, batch.num_rows, 100):
                part = batch.slice(low, 100)
                texts = shared.value.main_texts(sources.slice(low, 100).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in keep], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    [*keep, "text", "n_chars"],
                )

    source = pages.select(*keep, F.col(html_column).cast("string").alias("_html"))
    kinds = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep)
    return source.mapInArrow(run, f"{kinds}, text string, n_chars long")
