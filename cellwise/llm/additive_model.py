"""Quality classifier: a generalised additive model with pairwise interactions, learned by cyclic boosting of shallow trees."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellwise.llm.common import add_columns
from cellwise.llm.text_stats import describe
from cellwise.llm.training import labelled_sample


@dataclass
class AdditiveModel:
    """A lookup table for each feature's bins and for each chosen pair of features; a score is a sum of lookups."""

    cuts: list[np.ndarray]
    start: float
    tables: list[np.ndarray]
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def logit(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for f, table in enumerate(self.tables):
            total += table[np.searchsorted(self.cuts[f], x[:, f], side="left")]
        if self.pairs:
            coarse = [np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(self.pair_cuts)]
            for (a, b), table in self.pairs.items():
                total += table[coarse[a], coarse[b]]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logit(x)))


def _best_cut(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """Gain and place of the best cut of a histogram (after bin k); gain 0 where there is none."""
    if len(g) < 2:
        return 0.0, -1
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = gl**2 / (hl + ridge) + (g.sum() - gl) ** 2 / (h.sum() - hl + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    k = int(gain.argmax())
    return float(gain[k]), k


def _leaves(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    """A tree of at most three leaves over ordered bins, as a value for each bin."""
    edges = [0, len(g)]
    for _ in range(2):
        options = [(*_best_cut(g[a:b], h[a:b], ridge), a) for a, b in zip(edges, edges[1:])]
        gain, k, a = max(options)
        if gain <= 1e-9:
            break
        edges = sorted([*edges, a + k + 1])
    out = np.empty(len(g))
    for a, b in zip(edges, edges[1:]):
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + ridge)
    return out


def _grid_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """A cut on the first feature and, on each side, one on the second: gain and a value for each cell."""
    best, out = 0.0, np.zeros_like(g)
    base = g.sum() ** 2 / (h.sum() + ridge)
    for k in range(g.shape[0] - 1):
        gain, value = -base, np.zeros_like(g)
        for rows in (slice(0, k + 1), slice(k + 1, None)):
            a, b = g[rows].sum(0), h[rows].sum(0)
            more, m = _best_cut(a, b, ridge)
            gain += a.sum() ** 2 / (b.sum() + ridge) + more
            for columns in (slice(0, m + 1), slice(m + 1, None)) if m >= 0 else (slice(None),):
                value[rows, columns] = a[columns].sum() / (b[columns].sum() + ridge)
        if gain > best:
            best, out = gain, value
    return best, out


def fit_additive(x: np.ndarray, y: np.ndarray, rounds: int = 60, pair_rounds: int = 30, pairs: int = 6, rate: float = 0.1, bins: int = 32, pair_bins: int = 8, ridge: float = 2.0) -> AdditiveModel:
    """Visit the features in turn, each time adding a shrunken three-leaf tree to that feature's table; then the same for the pairs whose residual gain is largest.

    With one label only (or no rows) the tables are empty and the score is the smoothed share of label 1.
    """
    share = (y.sum() + 0.5) / (len(y) + 1)
    start = float(np.log(share / (1 - share)))
    if not len(y) or not 0 < y.sum() < len(y):
        return AdditiveModel([], start, [])
    quantiles = lambda n: [np.unique(np.quantile(c, np.linspace(0, 1, n + 1)[1:-1])) for c in x.T]
    cuts, coarse_cuts = quantiles(bins), quantiles(pair_bins)
    binned = [np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)]
    coarse = [np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(coarse_cuts)]
    model = AdditiveModel(cuts, start, [np.zeros(len(c) + 1) for c in cuts], coarse_cuts)
    total = np.full(len(y), start)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f, b in enumerate(binned):
            g, h = slopes()
            n = len(cuts[f]) + 1
            step = rate * _leaves(np.bincount(b, g, n), np.bincount(b, h, n), ridge)
            model.tables[f] += step
            total += step[b]

    def grid(a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        g, h = slopes()
        shape = (len(coarse_cuts[a]) + 1, len(coarse_cuts[b]) + 1)
        cell = coarse[a] * shape[1] + coarse[b]
        return cell, *(np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (g, h))

    gains = {p: _grid_tree(*grid(*p)[1:], ridge)[0] for p in combinations(range(x.shape[1]), 2)}
    for p in sorted(gains, key=lambda p: (-gains[p], p))[:pairs]:
        model.pairs[p] = np.zeros((len(coarse_cuts[p[0]]) + 1, len(coarse_cuts[p[1]]) + 1))
    for _ in range(pair_rounds):
        for p in model.pairs:
            cell, g, h = grid(*p)
            step = rate * _grid_tree(g, h, ridge)[1]
            model.pairs[p] += step
            total += step.ravel()[cell]
    return model


def quality_classifier(docs: DataFrame, labels: DataFrame, most_labels: int = 12288, cutoff: float = 0.3, prefix: str = "") -> DataFrame:
    """All columns of `docs` with `held_out`, `score` (0 to 1, higher: good quality likelier) and `predicted` (1 if score >= cutoff).

    held_out: crc32 of doc_id as text, mod 5, is 0; such rows (and those with a null doc_id) teach nothing. The model
    learns from at most `most_labels` of the other labelled rows and sees statistics of the text
    only. A null text counts as empty and is scored; repeated rows get equal scores; an empty table gives an
    empty result; other columns pass through. Without labels every score is 0.5. held_out of a null doc_id is false.
    """
    if prefix + "held_out" in docs.columns:
        raise ValueError(f"column {prefix}held_out is there already; choose another prefix")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    x, y = labelled_sample(docs, labels, most_labels, only=fold != 0)
    model = fit_additive(x, y)

    def make():
        def one(texts: list[bytes]) -> dict[str, list]:
            score = model.score(describe(texts)[1])
            return {prefix + "score": score, prefix + "predicted": (score >= cutoff).astype(np.int32)}

        return one

    fields = [T.StructField(prefix + "score", T.DoubleType()), T.StructField(prefix + "predicted", T.IntegerType())]
    return add_columns(docs, "text", make, fields).withColumn(prefix + "held_out", F.coalesce(fold == 0, F.lit(False)))
