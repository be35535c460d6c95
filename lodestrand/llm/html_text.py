"""Main text of web pages by gradient-boosted trees over DOM nodes.

Each element gets features of its subtree (text, tags and link density), of its attribute
tokens, of its depth and of its place among its siblings. Boosted trees give it log-odds of
holding main text. Decoding is hierarchical: over each page the set of kept elements is the
one of the greatest total that is closed upwards, so nothing is kept inside what is
dropped. The trees are trained here, on pages that a seeded generator composes with known
parts; no column of the input is read for it.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.llm import boost, wordcore
from lodestrand.llm.dom import INLINE, SKIPPED, Node, parse
from lodestrand.runtime import ship

# What attribute tokens and element names commonly mean on web pages.
TOKENS = {
    "navigation": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs toolbar skip",
    "frame": "header footer masthead topbar bottom copyright legal banner logo contentinfo site-header site-footer colophon",
    "side": "sidebar aside side rail widget related recommended more popular trending tags meta author-box complementary",
    "advert": "ad ads advert advertisement sponsor sponsored promo promoted promotion commercial adsense dfp outbrain taboola",
    "notice": "cookie consent notice alert gdpr popup modal overlay subscribe newsletter signup paywall toast hint",
    "social": "share sharing social follow like twitter facebook buttons",
    "comment": "comment comments reply replies discussion disqus respond commentlist feedback reviews",
    "form": "form search login contact input field submit",
    "main": "article content main post entry story body text page-content article-body post-content entry-content maincontent prose hentry blog markdown",
}
_KIND = {t: i for i, ts in enumerate(TOKENS.values()) for t in ts.split()}
TAGS = ["article", "main", "section", "div", "p", "h1", "h2", "h3", "ul", "ol", "li", "a", "span", "b", "i", "blockquote", "pre", "table", "tr", "td", "figure", "figcaption", "nav", "header", "footer", "aside", "form", "button", "dl", "details", "body", "html"]
_TAG = {t: i + 1 for i, t in enumerate(TAGS)}
_TAG_KIND = {"nav": 0, "header": 1, "footer": 1, "aside": 2, "form": 7, "button": 7, "article": 8, "main": 8}
_N_KINDS = len(TOKENS)


def _kinds(node: Node) -> int:
    """Bits of the token families in a node's attributes and name."""
    bits = 0
    if (k := _TAG_KIND.get(node.tag)) is not None:
        bits |= 1 << k
    if node.attributes:
        for token in node.attributes.split():
            if token in _KIND:
                bits |= 1 << _KIND[token]
            else:
                for part in token.replace("_", "-").split("-"):
                    if part in _KIND:
                        bits |= 1 << _KIND[part]
    return bits


def features(nodes: list[Node]) -> np.ndarray:
    """A row of features for each node of a page."""
    n = len(nodes)
    text, link, tags, stops, kids, words = ([0] * n for _ in range(6))
    own = [0] * n
    bits, above = [0] * n, [0] * n
    linked = [False] * n
    skipped = [False] * n
    for i, x in enumerate(nodes):
        bits[i] = _kinds(x)
        if x.parent is not None:
            p = x.parent.index
            above[i] = above[p] | bits[p]
            linked[i] = linked[p] or x.tag == "a"
            skipped[i] = skipped[p] or x.tag in SKIPPED
        if skipped[i]:
            continue
        for part in x.parts:
            if type(part) is str:
                c = len(part) - part.count(" ") - part.count("\n")
                own[i] += c
                words[i] += part.count(" ") + 1 if c else 0
                stops[i] += part.count(".") + part.count(",")
            else:
                kids[i] += 1
    for i in range(n):
        text[i] = own[i]
        link[i] = own[i] if linked[i] else 0
        tags[i] = 1
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent.index
        text[p] += text[i]
        link[p] += link[i]
        tags[p] += tags[i]
        stops[p] += stops[i]
        words[p] += words[i]
    before = 0
    total = max(text[0], 1)
    rows = np.zeros((n, 17 + 3 * _N_KINDS))
    place = [0] * n
    same = [0] * n
    nearby = [0] * n
    for x in nodes:
        children = [c for c in x.parts if type(c) is not str]
        by: dict[str, int] = {}
        for c in children:
            by[c.tag] = by.get(c.tag, 0) + 1
        for k, c in enumerate(children):
            place[c.index], same[c.index] = k, by[c.tag]
            nearby[c.index] = text[x.index] - text[c.index]
    for i, x in enumerate(nodes):
        p = x.parent.index if x.parent is not None else 0
        r = rows[i]
        r[:17] = (
            _TAG.get(x.tag, 0), x.depth, kids[i], place[i], same[i], text[i], own[i], text[i] / total, link[i] / (text[i] + 1), text[i] / tags[i], stops[i] / (words[i] + 1),
            before / total, kids[p], nearby[i], text[p] / tags[p], own[i] / (text[i] + 1), words[i] / tags[i],
        )
        b, a = bits[i], above[i]
        pb = bits[p]
        for k in range(_N_KINDS):
            if b >> k & 1:
                r[17 + k] = 1
            if a >> k & 1:
                r[17 + _N_KINDS + k] = 1
            if pb >> k & 1:
                r[17 + 2 * _N_KINDS + k] = 1
        before += own[i]
    return rows


def decode(nodes: list[Node], margin: np.ndarray) -> list[bool]:
    """The upward-closed set of kept nodes of the greatest total log-odds."""
    gain = margin.tolist()
    for i in range(len(nodes) - 1, 0, -1):
        if nodes[i].tag in SKIPPED:
            gain[i] = -1.0
        elif gain[i] > 0:
            gain[nodes[i].parent.index] += gain[i]
    keep = [False] * len(nodes)
    keep[0] = True
    for i in range(1, len(nodes)):
        keep[i] = keep[nodes[i].parent.index] and gain[i] > 0
    return keep


def render(nodes: list[Node], keep: list[bool]) -> str:
    """Texts of kept elements: white space in a block is one space, blocks are joined by one space."""
    out: list[str] = []
    stack: list = [iter(nodes[0].parts)]
    tags = ["#root"]
    while stack:
        part = next(stack[-1], None)
        if part is None:
            stack.pop()
            if tags.pop() not in INLINE:
                out.append(" ")
        elif type(part) is str:
            out.append(part)
        elif keep[part.index]:
            if part.tag not in INLINE:
                out.append(" ")
            stack.append(iter(part.parts))
            tags.append(part.tag)
        elif part.tag not in INLINE:
            out.append(" ")
    return " ".join("".join(out).split())


# ---- training pages ----

_SYLLABLES = "ka lo mi ren sta vor tu ne pra el dis om quin da fer hu sol ter ny ash bri cor".split()


class _Composer:
    """Pages of random layout whose parts are known: 1 main, 0 anything else."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, n: int) -> str:
        r = self.r
        out = []
        for i in range(n):
            w = "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 3)))
            out.append(w + (r.choice([".", ",", ". ", ""]) if r.random() < 0.15 else ""))
        return " ".join(out).capitalize() + r.choice([".", ".", ""])

    def attributes(self, family: str, chance: float = 0.7) -> str:
        r = self.r
        if r.random() > chance:
            return r.choice(["", f' class="{r.choice("abcxyz")}{r.randint(1, 99)}"', ' class="row"', ' class="col wrapper"'])
        token = r.choice(TOKENS[family].split())
        if r.random() < 0.3:
            token = f"{r.choice(['js', 'x', 'the', 'site', 'block'])}-{token}"
        return f' {r.choice(["class", "class", "id"])}="{token}"'

    def links(self, n: int) -> str:
        return "".join(f'<li><a href="/{i}">{self.words(self.r.randint(1, 4))}</a></li>' for i in range(n))

    def boiler(self) -> str:
        r = self.r
        kind = r.choice(["nav", "nav", "menu", "header", "footer", "side", "advert", "advert", "notice", "share", "form", "related"])
        if kind == "nav":
            return f"<nav>{'<ul>' + self.links(r.randint(2, 9)) + '</ul>' if r.random() < 0.7 else ' '.join(f'<a href=x>{self.words(1)}</a>' for _ in range(r.randint(2, 7)))}</nav>"
        if kind == "menu":
            return f"<div{self.attributes('navigation', 0.9)}><ul>{self.links(r.randint(3, 12))}</ul></div>"
        if kind == "header":
            return f"<header>{r.choice(['<h1>', '<h2>', '<div>'])}{self.words(r.randint(1, 6))}</header>" if r.random() < 0.6 else f"<div{self.attributes('frame', 1)}><a href=/>{self.words(2)}</a> {self.words(r.randint(2, 12))}</div>"
        if kind == "footer":
            body = f"&copy; {self.words(r.randint(2, 30))}" + (f"<p>{self.words(r.randint(4, 25))}</p>" if r.random() < 0.3 else "")
            return f"<footer>{body}</footer>" if r.random() < 0.7 else f"<div{self.attributes('frame', 1)}>{body}</div>"
        if kind == "side":
            body = f"<h3>{self.words(2)}</h3>" + (f"<ul>{self.links(r.randint(2, 8))}</ul>" if r.random() < 0.6 else f"<p>{self.words(r.randint(5, 40))}</p>")
            return f"<aside>{body}</aside>" if r.random() < 0.5 else f"<div{self.attributes('side', 1)}>{body}</div>"
        if kind == "advert":
            body = self.words(r.randint(3, 40))
            body = f"<p>{body}</p>" if r.random() < 0.4 else f"<a href=y>{body}</a>" if r.random() < 0.3 else body
            return f"<{(t := r.choice(['div', 'div', 'section', 'aside', 'p', 'span']))}{self.attributes('advert', 1)}>{body}</{t}>"
        if kind == "notice":
            return f"<div{self.attributes('notice', 1)}><p>{self.words(r.randint(5, 40))}</p>{'<button>' + self.words(1) + '</button>' if r.random() < 0.6 else ''}</div>"
        if kind == "share":
            return f"<div{self.attributes('social', 1)}>{' '.join(f'<a href=z>{self.words(1)}</a>' for _ in range(r.randint(2, 5)))}</div>"
        if kind == "form":
            return f"<form{self.attributes('form', 0.3)}><label>{self.words(r.randint(1, 12))}</label><input><button>{self.words(1)}</button></form>"
        return f"<{(t := r.choice(['div', 'section', 'ul']))}{self.attributes('side', 1)}>{self.links(r.randint(2, 6))}</{t}>"

    def comments(self) -> str:
        r = self.r
        one = lambda: f"<{(t := r.choice(['div', 'li', 'article', 'p']))}{self.attributes('comment', 0.6)}>{'<b>' + self.words(1) + '</b>' if r.random() < 0.5 else ''}<p>{self.words(r.randint(4, 60))}</p></{t}>"
        inner = "".join(one() for _ in range(r.randint(1, 6)))
        return f"<{(t := r.choice(['section', 'div', 'ol', 'aside']))}{self.attributes('comment', 1)}>{'<h2>' + self.words(2) + '</h2>' if r.random() < 0.6 else ''}{inner}</{t}>"

    def main_block(self) -> str:
        r = self.r
        k = r.random()
        if k < 0.68:
            words = self.words(r.choice([r.randint(1, 12), r.randint(10, 60), r.randint(40, 200)]))
            if r.random() < 0.3:
                words += f" <b>{self.words(2)}</b> {self.words(6)} <a href=q>{self.words(2)}</a> {self.words(5)}"
            if r.random() < 0.15:
                return f"<p><b>{words}<br>"
            return f"<p>{words}" + ("</p>" if r.random() < 0.9 else "")
        if k < 0.78:
            return f"<h{(n := r.randint(1, 4))}>{self.words(r.randint(1, 9))}</h{n}>"
        if k < 0.85:
            return f"<ul>{''.join('<li>' + self.words(r.randint(3, 25)) + '</li>' for _ in range(r.randint(2, 6)))}</ul>"
        if k < 0.90:
            return f"<blockquote><p>{self.words(r.randint(8, 50))}</p></blockquote>"
        if k < 0.94:
            return f"<table>{''.join(f'<tr><td>{self.words(2)}</td><td>{self.words(3)}</td></tr>' for _ in range(r.randint(2, 5)))}</table>"
        if k < 0.97:
            return f"<pre>{self.words(r.randint(5, 40))}</pre>"
        return f"<figure><img src=a><figcaption>{self.words(r.randint(4, 15))}</figcaption></figure>"

    def page(self) -> str:
        """The main parts are inside <x-main>; the tag itself is not part of the page that is learned from."""
        r = self.r
        mark = lambda s: f"<x-main>{s}</x-main>"
        blocks = [mark(f"<h1>{self.words(r.randint(2, 10))}</h1>")] if r.random() < 0.8 else []
        for _ in range(r.choice([1, 2, r.randint(2, 12), r.randint(6, 25)])):
            blocks.append(mark(self.main_block()))
            if r.random() < 0.08:
                blocks.append(self.boiler())
        if r.random() < 0.12:
            blocks.append(self.comments())
        body = "".join(blocks)
        k = r.random()
        if k < 0.45:
            body = f"<article{self.attributes('main', 0.2)}>{body}</article>"
        elif k < 0.6:
            body = f"<main>{body}</main>"
        else:
            body = f"<div{self.attributes('main', 0.75)}>{body}</div>"
        for _ in range(r.choice([0, 0, 1, 2])):
            body = f"<{(t := r.choice(['div', 'section', 'main', 'div']))}{self.attributes('main', 0.3)}>{self.boiler() if r.random() < 0.25 else ''}{body}{self.boiler() if r.random() < 0.25 else ''}</{t}>"
        head = "".join(self.boiler() for _ in range(r.randint(0, 4)))
        tail = (self.comments() if r.random() < 0.25 else "") + "".join(self.boiler() for _ in range(r.randint(0, 3)))
        return f"<html><head><title>{self.words(4)}</title><style>p{{}}</style></head><body>{head}{body}{tail}</body></html>"


def _labelled(html: str) -> tuple[list[Node], list[int]]:
    """Nodes without the marks, and 1 where a node holds main text or is above one that does."""
    nodes = parse(html)
    main = [False] * len(nodes)
    for i, x in enumerate(nodes):
        if x.parent is not None:
            main[i] = x.tag == "x-main" or main[x.parent.index]
    label = [int(m) for m in main]
    for i in range(len(nodes) - 1, 0, -1):
        if label[i]:
            label[nodes[i].parent.index] = 1
    out, labels = [], []
    for i, x in enumerate(nodes):
        if x.tag == "x-main":
            p = x.parent
            at = p.parts.index(x)
            p.parts[at : at + 1] = x.parts
            for c in x.parts:
                if type(c) is not str:
                    c.parent = p
        else:
            out.append(x)
            labels.append(label[i])
    for i, x in enumerate(out):
        x.index, x.depth = i, 0 if x.parent is None else x.parent.depth + 1
    return out, labels


@lru_cache(maxsize=2)
def trained(pages: int = 450, seed: int = 5) -> boost.Trees:
    """The trees, fitted on composed pages; the same for the same arguments."""
    composer = _Composer(seed)
    xs, ys = [], []
    for _ in range(pages):
        nodes, labels = _labelled(composer.page())
        keep = [i for i, x in enumerate(nodes) if x.tag not in SKIPPED and i]
        xs.append(features(nodes)[keep])
        ys += [labels[i] for i in keep]
    return boost.fit(np.concatenate(xs), np.array(ys, float), trees=40)


def extract(pages: list[str], trees: boost.Trees) -> list[str]:
    """Main text of each page."""
    trees_of = [parse(p) for p in pages]
    rows = [features(t) for t in trees_of]
    margin = trees.margin(np.concatenate(rows)) if rows else np.zeros(0)
    out, at = [], 0
    for nodes in trees_of:
        out.append(render(nodes, decode(nodes, margin[at : at + len(nodes)])))
        at += len(nodes)
    return out


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for each row; n_chars counts code points.

    Null html is empty and gives an empty text, as does a page without main text. Repeated
    rows give repeated rows, an empty table none; other columns are not read.
    """
    spark = pages.sparkSession
    ship(spark)
    value = spark.sparkContext.broadcast(trained())
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = value.value
        for b in batches:
            html = wordcore.binary(b.column(2))
            _, offs = wordcore.raw(html)
            for lo, hi in wordcore.pieces(offs, 1 << 19):
                texts = extract([x.as_py().decode() for x in html.slice(lo, hi - lo)], trees)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[lo:hi], b.column(1)[lo:hi].cast(pa.string()), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], schema=schema
                )

    slim = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return slim.mapInArrow(wordcore.tidy(run), "page_id bigint, url string, text string, n_chars bigint")
