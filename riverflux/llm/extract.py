"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks (runs of text between block-level tags). A classifier gives each block a cost
for either label: a logistic model of its length, link density, sentences and element, and the evidence of the
elements it stands in. The costs are the capacities of its edges from the source (content) and to the sink
(boilerplate). Neighbouring blocks are joined by smoothness edges, the stronger the nearer they are in the DOM, as
are successive blocks of one container. The minimum cut is the cheapest labelling, and the blocks on
the source's side are the page's main text. Pages are independent: a map without a shuffle.

The logistic model is fitted on a sample of about SAMPLE pages. Its labels are the landmarks that many pages have:
blocks of an article or main element are content, those of navigation, footers, forms and the like boilerplate,
all others are unlabelled. So what is learned is how the text of either kind looks, which then decides
where there are no landmarks.
"""

from __future__ import annotations

import html as entities
import math
import re
import sys
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riverflux.llm.toxicity import logistic

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A comment, a declaration, or what begins a tag.
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)", re.S)
#: The attributes of a tag up to its end: quoted values may hold >, if their quotes are closed as they should be.
STRICT = re.compile(r"((?:[^>\"']++|\"[^\"]*+\"(?=[\s/>])|'[^']*+'(?=[\s/>]))*+)>")
LENIENT = re.compile(r"([^>]*)(?:>|\Z)")
ATTRIBUTE = re.compile(r"(class|id|role|itemprop|aria-label|hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page, and those whose content is text without markup.
RAW = frozenset("script style noscript template textarea title iframe noembed noframes".split())
PLAIN = frozenset("xmp plaintext listing".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark math mfrac mi mn mo mrow msqrt msub msup mtext object q rp rt ruby s samp small span strike strong sub sup svg text time tspan tt u var wbr".split())
#: Elements that end an open element of the same or a related kind.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
ENDS |= {b: {"p"} for b in "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol pre section table ul".split()}
BAD_TAGS = frozenset("nav footer aside form menu button select dialog head fieldset".split())
GOOD_TAGS = frozenset("article main".split())
#: Words of names (class, id, role) that speak for boilerplate; a name is cut at everything but letters and digits.
BAD_NAMES = frozenset(
    "nav navbar navigation menu submenu foot footer sidebar breadcrumb breadcrumbs crumb crumbs share sharing social related recommended recommendations promo promotion sponsor sponsored advert adverts advertisement advertising ad ads adsense adbox banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login search searchbox comment comments disqus reply replies respond widget widgets toolbar pagination pager copyright legal disclaimer masthead topbar teaser tags byline skip skiplink complementary contentinfo rating ratings reviews".split()
)
GOOD_NAMES = frozenset("article post entry story content main body text articlebody prose markdown reader".split())
#: A name that begins so tells what a page has or lacks, not what the element is.
ABOUT = frozenset("has have with without no is js".split())
SPACE = re.compile(r"\s+")
SENTENCE = re.compile(r"[.!?:,;。，](?:\s|$)")
COPYRIGHT = re.compile(r"(?:©|\(c\)\s|copyright\b|all rights reserved)", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SCALE = 100
#: Pages that the classifier is fitted on, at about; its weights where they have no blocks of either kind.
SAMPLE = 2000
DEFAULT = (-0.5, 0.35, -3.0, 0.4, 0.3, -0.3, -0.2)
#: Most that the fitted model's log odds count for, either way.
MOST_ODDS = 4.0


@dataclass
class Node:
    tag: str
    parent: Node | None
    depth: int
    bad: float = 0.0
    good: float = 0.0


@dataclass
class Block:
    node: Node
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def evidence(tag: str, attributes: str, parent: Node | None) -> tuple[float, float]:
    """How strongly an element and those around it speak for boilerplate and for content."""
    bad, good = (parent.bad, parent.good) if parent else (0.0, 0.0)
    if tag in BAD_TAGS:
        bad += 4
    elif tag in GOOD_TAGS:
        good, bad = good + 3, bad * 0.5
    elif tag == "header":
        bad += 1 if good else 4
    if not attributes.strip(" /"):
        return bad, good
    judged = [0.0, 0.0]
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            bad += 8
        elif name not in ("style", "hidden") and tag not in ("html", "body"):
            for word in value.split():
                kind = kind_of_name(word)
                judged = [max(judged[0], 4.0 * (kind < 0)), max(judged[1], 1.5 * (kind > 0))]
    # a name that speaks for boilerplate outweighs others, but not on an element that is itself a landmark of content
    if judged[0] and tag not in GOOD_TAGS:
        bad += judged[0]
    else:
        good += judged[1]
    return bad, good


@lru_cache(1 << 16)
def kind_of_name(name: str) -> int:
    """-1 if one of a name's words (or two that stand together, as in side-bar) speaks for boilerplate, 1 if its last speaks for content."""
    words = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name[:200]).lower())
    if not words or words[0] in ABOUT:
        return 0
    if BAD_NAMES.intersection(words) or BAD_NAMES.intersection(a + b for a, b in zip(words, words[1:])):
        return -1
    return 1 if words[-1] in GOOD_NAMES else 0


def blocks_of(page: str) -> list[Block]:
    """The page's non-empty blocks in order, with white space and character references resolved."""
    root = Node("", None, 0)
    node, block, out, at = root, Block(root), [], 0
    links = 0

    def close() -> None:
        nonlocal block
        block.text = SPACE.sub(" ", entities.unescape("".join(block.parts))).strip()
        if block.text:
            out.append(block)
        block = Block(node)

    def take(raw: str) -> None:
        if raw:
            block.parts.append(raw)
            if links:
                block.linked += len(raw.strip())

    while at < len(page):
        m = MARKUP.search(page, at)
        if not m:
            take(page[at:])
            break
        take(page[at : m.start()])
        at = m.end()
        if not m.group(2):
            continue
        tag = m.group(2).lower()
        rest = STRICT.match(page, at) or LENIENT.match(page, at)
        at = rest.end()
        if m.group(1):  # an end tag closes all that is open within it; one that closes nothing is skipped
            if tag in ("p", "br"):
                close()
            up = node
            while up.parent and up.tag != tag:
                up = up.parent
            if not up.parent:
                continue
            inner, node = node, up.parent
            while inner is not node:
                links -= inner.tag == "a"
                inner = inner.parent
            if tag not in INLINE:
                close()
            continue
        if tag in RAW or tag in PLAIN:  # a slash at the end does not close these
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            if tag in PLAIN:
                close()
                take(page[at : end.start() if end else len(page)].replace("&", "&amp;"))
                close()
            at = end.end() if end else len(page)
            continue
        if tag == "br":
            take(" ")
            continue
        if tag in VOID:
            if tag not in INLINE:
                close()
            continue
        for kind in ENDS.get(tag, ()):
            up = node
            while up.parent and up.tag != kind and up.tag not in ("table", "ul", "ol", "dl", "article", "section", "div", "body", "td", "blockquote", "nav", "aside", "main"):
                up = up.parent
            if up.parent and up.tag == kind:
                inner, node = node, up.parent
                while inner is not node:
                    links -= inner.tag == "a"
                    inner = inner.parent
        node = Node(tag, node, node.depth + 1, *evidence(tag, rest.group(1), node))
        links += tag == "a"
        if tag not in INLINE:
            close()
            block.node = node
        elif not any(p.strip() for p in block.parts):
            block.node = node
    close()
    return out


def features(b: Block) -> tuple[int, ...]:
    """Words (their bits), quarters of the text that are links, sentence ends, whether a heading, a list item, or neither these nor a paragraph."""
    tag = b.node.tag
    node = b.node
    while node.parent and node.tag in INLINE:
        node, tag = node.parent, node.parent.tag
    return (
        min(8, (b.text.count(" ") + 1).bit_length()), round(4 * min(1.0, b.linked / len(b.text))), min(3, len(SENTENCE.findall(b.text))),
        int(tag in HEADINGS), int(tag in ("li", "dt", "dd", "td", "th")), int(tag not in HEADINGS and tag not in ("p", "li", "dt", "dd", "td", "th")),
    )


def vector(f: tuple[int, ...]) -> tuple[float, ...]:
    return (1.0, float(f[0]), f[1] / 4, float(f[2]), *map(float, f[3:]))


def landmark(node: Node) -> int:
    """1 in an article or main element, 0 in a landmark of boilerplate, -1 elsewhere: the labels of the classifier."""
    good = False
    while node is not None:
        if node.tag in BAD_TAGS:
            return 0
        good = good or node.tag in GOOD_TAGS
        node = node.parent
    return 1 if good else -1


def costs(b: Block, weights: tuple[float, ...]) -> tuple[int, int]:
    """Cost of calling a block boilerplate (its evidence for content), and of calling it content: the model's
    log probabilities, and what the elements around it say."""
    z = max(-MOST_ODDS, min(MOST_ODDS, sum(w * x for w, x in zip(weights, vector(features(b))))))
    boiler = 3.0 if COPYRIGHT.match(b.text) else 0.0
    return round(SCALE * (math.log1p(math.exp(z)) + 1.5 * b.node.good)), round(SCALE * (math.log1p(math.exp(-z)) + 1.6 * b.node.bad + boiler))


def container(node: Node) -> Node:
    """The nearest block-level element around a block's own."""
    while node.parent and (node.tag in INLINE or node.tag in ("p", "li") or node.tag in HEADINGS):
        node = node.parent
    return node


def apart(a: Node, b: Node) -> int:
    """Steps between two nodes of the DOM."""
    n = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        n += 1
    return n


def source_side(n: int, arcs: list[tuple[int, int, int, int]], source: int, sink: int) -> list[bool]:
    """Which nodes a minimum cut leaves with the source: shortest augmenting paths in level graphs.

    arcs: (from, to, capacity, capacity back)."""
    to, room, out = [], [], [[] for _ in range(n)]
    for a, b, there, back in arcs:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to += [b, a]
        room += [there, back]
    while True:
        level = [-1] * n
        level[source], queue = 0, deque([source])
        while queue:
            v = queue.popleft()
            for e in out[v]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level]
        turn, path, v = [0] * n, [], source
        while True:
            if v == sink:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                first = next(i for i, e in enumerate(path) if not room[e])
                v = to[path[first] ^ 1]
                del path[first:]
            elif turn[v] < len(out[v]):
                e = out[v][turn[v]]
                if room[e] and level[to[e]] == level[v] + 1:
                    path.append(e)
                    v = to[e]
                else:
                    turn[v] += 1
            elif v == source:
                break
            else:
                level[v] = -1
                v = to[path.pop() ^ 1]


def main_text(page: str | None, weights: tuple[float, ...] = DEFAULT) -> str:
    blocks = blocks_of(page or "")
    n = len(blocks)
    arcs: list[tuple[int, int, int, int]] = []
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        content, boiler = costs(b, weights)
        arcs += [(n, i, content, 0), (i, n + 1, boiler, 0)]
        home = container(b.node)
        if i:
            weight = SCALE // max(1, apart(container(blocks[i - 1].node), home) + 1)
            arcs.append((i - 1, i, weight, weight))
        if id(home) in last and last[id(home)] != i - 1:
            arcs.append((last[id(home)], i, SCALE // 2, SCALE // 2))
        last[id(home)] = i
    side = source_side(n + 2, arcs, n, n + 1)
    return "\n".join(b.text for i, b in enumerate(blocks) if side[i])


def count_features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """label, f (array of features), n: labelled blocks by their features, of which there are some thousand."""
    counts: Counter = Counter()
    for batch in batches:
        for page in batch["html"]:
            for b in blocks_of(page or ""):
                label = landmark(b.node)
                if label >= 0:
                    counts[label, features(b)] += 1
    yield pd.DataFrame([(label, list(f), n) for (label, f), n in counts.items()], columns=["label", "f", "n"])


def fit_costs(pages: DataFrame, html_col: str = "html", sample: int = SAMPLE) -> tuple[float, ...]:
    """The classifier's weights from the landmarks of about sample pages, chosen by a hash of their html. Either
    kind of blocks counts as much as the other. Pages without landmarks of both kinds give DEFAULT."""
    n = pages.count()
    some = pages.where(F.pmod(F.xxhash64(F.col(html_col), F.lit(17)), F.lit(1_000_003)) < F.lit(1_000_003.0 * min(1.0, sample / max(1, n))))
    counts = some.select(F.col(html_col).alias("html")).mapInPandas(count_features, "label int, f array<int>, n long")
    rows = counts.groupBy("label", "f").agg(F.sum("n").alias("n")).collect()  # as many as there are combinations of features
    total = Counter()
    for r in rows:
        total[r.label] += r.n
    if len(total) < 2:
        return DEFAULT
    rows.sort(key=lambda r: (r.label, r.f))
    x = np.array([vector(tuple(r.f))[1:] for r in rows])
    w = logistic(x, np.array([float(r.label) for r in rows]), np.array([r.n / total[r.label] for r in rows]) * 1000, ridge=100.0)
    return (float(w[-1]), *map(float, w[:-1]))


def extract_main_text(pages: DataFrame, html_col: str = "html", text_col: str = "text", weights: tuple[float, ...] = DEFAULT) -> DataFrame:
    """pages with text_col added or replaced: the blocks of the main text, joined by line feeds.

    Null and empty pages, and pages without text outside of boilerplate, give an empty text. Broken
    markup is read leniently: elements that are never closed end with the page, and a quote that is not closed ends
    with its tag. Repeated rows are repeated, and columns of other names are kept as they are."""

    @F.pandas_udf(T.StringType())
    def extracted(htmls: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in htmls:
            yield pd.Series([main_text(page, weights) for page in batch], dtype=object)

    return pages.withColumn(text_col, extracted(F.col(html_col)))


def op6_min_cut(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    out = extract_main_text(pages, weights=fit_costs(pages))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
