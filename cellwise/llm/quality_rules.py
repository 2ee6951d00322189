"""Quality rules: base rules, and gradient-boosted trees flattened into numpy node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cellwise.llm.common import add_columns
from cellwise.llm.text_stats import FEATURES, describe
from cellwise.llm.training import labelled_sample

#: Features that can only lower the score as they grow, others that can only raise it.
MONOTONE = {"symbols_per_word": -1, "pipes_per_word": -1, "marks_per_word": -1, "brackets_per_word": -1, "dup_line_share": -1, "repeat_share": -1, "distinct_share": 1}


@dataclass
class FlatTrees:
    """All trees in one set of node arrays; a leaf points to itself, so every row takes `depth` steps."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row."""
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 48, least: float = 4.0, ridge: float = 1.0, monotone: dict[str, int] = MONOTONE) -> FlatTrees:
    """Logistic boosting over histograms. A split on a constrained feature keeps its sides in order, and their midpoint bounds both subtrees.

    Without rows, or with one label only, the trees are empty and the score is the (smoothed) share of label 1.
    """
    share = (y.sum() + 0.5) / (len(y) + 1)
    start = float(np.log(share / (1 - share)))
    signs = np.array([monotone.get(f, 0) for f in FEATURES])
    nodes: list[list[float]] = []
    roots: list[int] = []
    if len(y) and 0 < y.sum() < len(y):
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1)
        total = np.full(len(y), start)

        def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
            g, h = gradient[rows], hessian[rows]
            weight = lambda a, b: np.clip(a / (b + ridge), low, high)
            gain_of = lambda a, b, w: a * w - 0.5 * (b + ridge) * w * w
            here = weight(g.sum(), h.sum())
            best: tuple = (1e-6, -1, -1, 0.0, 0.0)
            for f in range(x.shape[1]) if level < depth else ():
                gl, hl = (np.cumsum(np.bincount(binned[rows, f], v, len(cuts[f]) + 1))[:-1] for v in (g, h))
                gr, hr = g.sum() - gl, h.sum() - hl
                wl, wr = weight(gl, hl), weight(gr, hr)
                gain = gain_of(gl, hl, wl) + gain_of(gr, hr, wr) - gain_of(g.sum(), h.sum(), here)
                gain[(hl < least / 4) | (hr < least / 4) | (signs[f] * (wr - wl) < 0)] = 0
                if len(gain) and gain.max() > best[0]:
                    k = int(gain.argmax())
                    best = (gain[k], f, k, wl[k], wr[k])
            at = len(nodes)
            nodes.append([0, 0.0, at, at, rate * here])
            if best[1] >= 0:
                _, f, k, wl, wr = best
                middle = (wl + wr) / 2
                bound = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[int(signs[f])]
                inside = binned[rows, f] <= k
                nodes[at] = [f, cuts[f][k], grow(rows[inside], level + 1, *bound[0]), grow(rows[~inside], level + 1, *bound[1]), 0.0]
            else:
                total[rows] += rate * here
            return at

        for _ in range(trees):
            p = 1 / (1 + np.exp(-total))
            gradient, hessian = y - p, p * (1 - p)
            roots.append(grow(np.arange(len(y)), 0, -6.0, 6.0))
    columns = list(zip(*nodes)) if nodes else [()] * 5
    return FlatTrees(*(np.array(c, t) for c, t in zip(columns, (np.int64, float, np.int64, np.int64, float))), np.array(roots, np.int64), depth, start)


def quality_rules(docs: DataFrame, labels: DataFrame, most_labels: int = 8192, keep_at: float = 0.5, prefix: str = "") -> DataFrame:
    """All columns of `docs`, the base counts, `base_failed`, `rule_score` (probability of good quality) and `kept`.

    base_failed: fewer than 50 words, or 100 * n_repeat_words > 50 * n_words. kept: not base_failed and
    rule_score >= keep_at. The trees learn from at most `most_labels` labelled documents of `docs`; that
    bound is what goes through the driver. A null or empty text has zero counts and fails the base rules. Repeated
    rows are judged one by one; an empty table gives an empty result; other columns pass through
    (`prefix` keeps new names apart from them). Without labels the base rules decide alone.
    """
    x, y = labelled_sample(docs, labels, most_labels)
    model = fit_trees(x, y) if len(y) else None
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def make():
        def one(texts: list[bytes]) -> dict[str, list]:
            base, features = describe(texts)
            failed = (base["n_words"] < 50) | (100 * base["n_repeat_words"] > 50 * base["n_words"])
            score = model.score(features) if model else np.ones(len(texts))
            return {prefix + k: v for k, v in (base | {"base_failed": failed, "rule_score": score, "kept": ~failed & (score >= keep_at)}).items()}

        return one

    fields = [T.StructField(prefix + n, T.LongType()) for n in names] + [T.StructField(prefix + "base_failed", T.BooleanType()), T.StructField(prefix + "rule_score", T.DoubleType()), T.StructField(prefix + "kept", T.BooleanType())]
    return add_columns(docs, "text", make, fields)
