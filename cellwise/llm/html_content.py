"""Main text of pages by a tree-structured graphical model over the DOM.

Every block-level element and text block has a hidden label: content or not. Unary potentials are log-linear in what the
node looks like; parent-child potentials, by kind of parent, say how labels pass down. Sum-product messages go
up and down the tree once and give each block's marginal. Both potentials are learned together from labelled pages.
"""

from __future__ import annotations

import re
from functools import lru_cache
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellwise.llm.common import map_rows, texts_of
from cellwise.llm.dom import Dom, parse
from cellwise.llm.html_training import labelled_page

TAGS = {t: i for i, t in enumerate(" html body article main section div nav header footer aside form p h1 h2 h3 h4 h5 h6 ul ol li dl dd table tr td blockquote pre figure figcaption button address fieldset select details dialog".split(" "))}
#: Parts of names that pages give to their regions.
GROUPS = [re.compile(p) for p in (
    r"nav|menu|breadcrumb|pagination|pager|\btoc\b", r"foot|copyright|legal|imprint", r"header|masthead|\btop\b|logo|\bhead\b", r"side-?bar|\bside\b|widget|\brail\b",
    r"comment|repl(y|ies)|discuss|disqus|respond", r"\bads?\b|advert|sponsor|promo|banner|\bad[-_]|[-_]ad\b|skyscraper", r"cookie|consent|notice|alert|gdpr|popup|modal|newsletter|subscri|paywall|signup|login|toast",
    r"share|social|follow|\btags?\b", r"related|recommend|popular|more-|read-more|trending", r"content|article|post|entry|story|\btext\b|\bbody\b|\bmain\b", r"wrap|container|page|layout|\brow\b|column",
)]
_NAMES = len(TAGS) + 1
_SHAPE = _NAMES + len(GROUPS) + 1
FEATURES = _SHAPE + 30
KINDS = 4


@lru_cache(1 << 14)
def _named(tag: str, names: str) -> tuple[int, ...]:
    out = [0, 1 + TAGS.get(tag, len(TAGS) - 1) if tag in TAGS else _NAMES - 1]
    out += [_NAMES + i for i, g in enumerate(GROUPS) if names and g.search(names)]
    return tuple(out)


@lru_cache(1 << 12)
def _shape(words: int, link: int, ends: bool, leaf: bool) -> tuple[int, ...]:
    return _SHAPE + min(9, words), _SHAPE + 10 + link, _SHAPE + 16 + ends, _SHAPE + 18 + leaf, _SHAPE + 20 + 5 * ends + min(4, words // 2)


def features(dom: Dom) -> list[tuple[int, ...]]:
    """Numbers of the active features of every node."""
    n = len(dom.tag)
    chars, linked, ends = [len(t) for t in dom.text], list(dom.linked), [t[-1:] in ".!?…\"”" and bool(t) for t in dom.text]
    for i in range(n - 1, 0, -1):
        p = dom.parent[i]
        chars[p] += chars[i]
        linked[p] += linked[i]
        ends[p] |= ends[i]
    out = []
    for i in range(n):
        share = linked[i] / chars[i] if chars[i] else 0.0
        link = 0 if share == 0 else 1 if share < 0.2 else 2 if share < 0.5 else 3 if share < 0.9 else 4
        out.append(_named(dom.tag[i], dom.names[i]) + _shape((chars[i] // 6).bit_length(), link if chars[i] else 5, ends[i], not dom.tag[i]))
    return out


def kind_of(tag: str) -> int:
    """Kind of a parent: the page, a neutral container, an article, or another element with a meaning."""
    return 0 if tag in ("html", "body") else 1 if tag in ("div", "section") else 2 if tag in ("article", "main") else 3


class Model:
    """weights: of the features. tables[kind][parent label][child label]: potentials."""

    def __init__(self, weights: np.ndarray, tables: np.ndarray) -> None:
        self.weights = weights.tolist()
        self.tables = [(t[0][0], t[0][1], t[1][0], t[1][1]) for t in tables.tolist()]

    def marginals(self, dom: Dom) -> list[float]:
        """Probability of content of every node by sum-product, in log odds: children's messages up, then parents' down."""
        w, parent, n = self.weights, dom.parent, len(dom.tag)
        belief = [max(-12.0, min(12.0, sum([w[k] for k in f]))) for f in features(dom)]
        kinds = [self.tables[kind_of(t)] for t in dom.tag]
        up = [0.0] * n
        for i in range(n - 1, 0, -1):
            t00, t01, t10, t11 = kinds[parent[i]]
            e = exp(min(40.0, belief[i]))
            up[i] = log((t11 * e + t10) / (t01 * e + t00))
            belief[parent[i]] += up[i]
        for i in range(1, n):
            t00, t01, t10, t11 = kinds[parent[i]]
            e = exp(max(-40.0, min(40.0, belief[parent[i]] - up[i])))
            belief[i] += log((t11 * e + t01) / (t10 * e + t00))
        return [1 / (1 + exp(-max(-40.0, min(40.0, b)))) for b in belief]

    def text(self, html: str) -> str:
        """Blocks that are likelier content than not, in page order, with an empty line between them."""
        dom = parse(html)
        return "\n\n".join(t for t, p in zip(dom.text, self.marginals(dom)) if t and p > 0.5)


def labelled_nodes(html: str, kept: list[str]) -> tuple[Dom, np.ndarray]:
    """Labels of a page's nodes: a block is content if it is next in the list of the article's blocks, an element if most of its text is."""
    dom = parse(html)
    n, at = len(dom.tag), 0
    label, chars, good = np.zeros(n), np.array([len(t) for t in dom.text], float), np.zeros(n)
    for i, t in enumerate(dom.text):
        if t and at < len(kept) and t == kept[at]:
            good[i], at = len(t), at + 1
    for i in range(n - 1, 0, -1):
        good[dom.parent[i]] += good[i]
        chars[dom.parent[i]] += chars[i]
    label[(chars > 0) & (2 * good > chars)] = 1
    return dom, label


class _Forest:
    """The nodes of many pages side by side, for messages by depth."""

    def __init__(self, doms: list[Dom]) -> None:
        parent, kind, depth, rows = [], [], [], []
        for dom in doms:
            base = len(parent)
            for i, q in enumerate(dom.parent):
                parent.append(base + q if q >= 0 else -1)
                depth.append(depth[base + q] + 1 if q >= 0 else 0)
                kind.append(kind_of(dom.tag[q]) if q >= 0 else 0)
            rows += features(dom)
        self.parent, self.kind = np.array(parent), np.array(kind)
        depth = np.array(depth)
        self.levels = [np.flatnonzero(depth == d) for d in range(1, depth.max() + 1)]
        self.edges = np.flatnonzero(self.parent >= 0)
        self.at = np.repeat(np.arange(len(rows)), [len(f) for f in rows])
        self.on = np.concatenate([np.array(f) for f in rows])

    def expected(self, w: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of the nodes, and for each edge of both labels (parent, child)."""
        n = len(self.parent)
        belief = np.bincount(self.at, w[self.on], n)
        up, psi = np.zeros(n), np.exp(theta)[self.kind]
        bound = lambda v: np.exp(np.clip(v, -40, 40))
        for nodes in reversed(self.levels):
            e, t = bound(belief[nodes]), psi[nodes]
            up[nodes] = np.log((t[:, 1, 1] * e + t[:, 1, 0]) / (t[:, 0, 1] * e + t[:, 0, 0]))
            belief += np.bincount(self.parent[nodes], up[nodes], n)
        below, above = belief.copy(), np.zeros(n)
        for nodes in self.levels:
            above[nodes] = belief[self.parent[nodes]] - up[nodes]
            e, t = bound(above[nodes]), psi[nodes]
            belief[nodes] += np.log((t[:, 1, 1] * e + t[:, 0, 1]) / (t[:, 1, 0] * e + t[:, 0, 0]))
        i = self.edges
        pair = psi[i] * np.stack([np.ones(len(i)), bound(above[i])], 1)[:, :, None] * np.stack([np.ones(len(i)), bound(below[i])], 1)[:, None, :]
        return 1 / (1 + bound(-belief)), pair / pair.sum((1, 2), keepdims=True)


@lru_cache(2)
def trained(pages: int = 1000, seed: int = 11, steps: int = 250, ridge: float = 2e-4, rate: float = 0.08) -> Model:
    """Learn from `pages` labelled pages: the likelihood of all labels, whose slope is seen less expected counts, climbed in adaptive steps."""
    both = [labelled_nodes(*labelled_page(seed * 100_003 + k)) for k in range(pages)]
    forest, y = _Forest([d for d, _ in both]), np.concatenate([v for _, v in both]).astype(int)
    w, theta = np.zeros(FEATURES), np.zeros((KINDS, 2, 2))
    seen = np.bincount(forest.on, y[forest.at], FEATURES)
    i = forest.edges
    seen_pairs = np.zeros((KINDS, 2, 2))
    np.add.at(seen_pairs, (forest.kind[i], y[forest.parent[i]], y[i]), 1)
    first, second = [np.zeros_like(v) for v in (w, theta)], [np.zeros_like(v) for v in (w, theta)]
    for step in range(1, steps + 1):
        marginal, pair = forest.expected(w, theta)
        slopes = [(seen - np.bincount(forest.on, marginal[forest.at], FEATURES)) / len(y) - ridge * w]
        slopes.append((seen_pairs - np.stack([pair[forest.kind[i] == k].sum(0) for k in range(KINDS)])) / len(y) - ridge * theta)
        for values, slope, m, v in zip((w, theta), slopes, first, second):
            m += 0.1 * (slope - m)
            v += 0.001 * (slope * slope - v)
            values += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(w, np.exp(theta))


def extract_content(pages: DataFrame, id_column: str = "page_id", html_column: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """One row per page: its id, the columns in `keep`, text (empty if none) and n_chars (code points).

    A null or empty html gives an empty text. Repeated rows give repeated results, an empty table an empty one; ids and kept
    columns may be null; other columns are not looked at; the names text and n_chars can't be kept (ValueError). Pages of any length
    are taken whole, in time that grows with their length.
    """
    if clash := {"text", "n_chars", "_html"} & {id_column, *keep}:
        raise ValueError(f"columns {sorted(clash)} can't be kept")
    source = pages.select(id_column, *keep, F.col(html_column).cast("string").alias("_html"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    model = trained()

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [model.text(h.decode("utf-8", "replace")) for h in texts_of(batch.column("_html"))]
            return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

        return one

    return map_rows(source, make, schema, "_html")
