"""Operators of relations against brute force on small fixtures."""

from itertools import combinations
from math import exp, sqrt

import pytest
from pyspark.sql import functions as F

from cellwise.operators import relations as ops


def cosine(p, q):
    return sum(p.get(k, 0) * q.get(k, 0) for k in p) / sqrt(sum(v * v for v in p.values()) * sum(v * v for v in q.values()))


def test_grid_summary(spark):
    cells = {("a", 0, 0): {1: 1.0, 2: 2.0}, ("a", 1, 0): {1: 2.0}, ("a", 0, 1): {3: 4.0}, ("a", 5, 5): {1: 1.0, 3: 1.0}, ("b", 0, 0): {1: 1.0}, ("c", 0, 0): {1: 0.0}}
    rows = [(*c, i, v) for c, p in cells.items() for i, v in p.items()]
    found = {r.g: r for r in ops.grid_summary(spark.createDataFrame(rows, "g string, x long, y long, i long, v double"), "g", "x", "y", "i", "v").collect()}
    assert found.keys() == {"a", "b"}
    a = [(c[1:], p) for c, p in cells.items() if c[0] == "a"]
    assert found["a"].homogeneity == pytest.approx(sum(cosine(p, q) for (_, p), (_, q) in combinations(a, 2)) / 6)
    near = [cosine(p, q) for (c, p), (e, q) in combinations(a, 2) if abs(c[0] - e[0]) + abs(c[1] - e[1]) == 1]
    assert (found["a"].cells, found["a"].edges, found["a"].continuity) == (4, len(near), pytest.approx(sum(near) / len(near)))
    assert (found["b"].cells, found["b"].edges, found["b"].homogeneity, found["b"].continuity) == (1, 0, None, None)


def test_support_screen_knows_items_without_support_and_crowded_ones(spark):
    positives = [(1, r, 3, 3) for r in range(30)] + [(2, r, r % 28, r % 28) for r in range(1, 60, 2)] + [(3, 0, 1, 1)]
    found = ops.support_screen(spark.createDataFrame(positives, "item long, r long, y long, x long"), spark.range(1, 5).toDF("item"), "item", F.col("r") % 2 == 0, F.col("y"), F.col("x"), least=15)
    assert sorted(tuple(r) for r in found.collect()) == [
        (1, 15, "fixed_validation", "reviewable", True), (2, 30, "expanded_posthoc", "reviewable", False),
        (3, 1, "fixed_validation", "insufficient_support", False), (4, 0, "expanded_posthoc", "no_positive_activation", False),
    ]


def test_local_scaled_graph(spark):
    s = {("a", "b"): 0.9, ("a", "c"): 0.5, ("b", "c"): 0.6, ("a", "d"): 0.1, ("b", "d"): 0.2, ("c", "d"): 0.3}
    found = {(r.a, r.b): r.weight for r in ops.local_scaled_graph(spark.createDataFrame([(*k, v) for k, v in s.items()], "a string, b string, similarity double"), 1).collect()}
    d = {frozenset(k): 1 - v for k, v in s.items()}
    near = {x: min((d[frozenset((x, y))], y) for y in "abcd" if y != x) for x in "abcd"}
    edges = {tuple(sorted((x, y))) for x, (_, y) in near.items()}
    raw = {e: exp(-(d[frozenset(e)] ** 2) / (near[e[0]][0] * near[e[1]][0] + 1e-9)) for e in edges}
    mean = sum(raw.values()) / len(raw)
    assert found == {e: pytest.approx(w / mean) for e, w in raw.items()}


def test_higher_quantile_counts_missing_rows_as_zero(spark):
    counts = spark.createDataFrame([("x", float(v)) for v in (1, 2, 2, 3, 9)] + [("y", 5.0)], "item string, v double")
    found = {r.item: r.threshold for r in ops.higher_quantile_marks(counts, "item", "v", 11, 0.8).collect()}
    assert found == {"x": 2.0, "y": 1.0}


def test_evidence_flags_take_null_as_not_held(spark):
    flags, status = ops.evidence_flags([("big", F.col("v") > 5), ("odd", F.col("v") % 2 == 1)], "clean")
    found = spark.createDataFrame([(7,), (3,), (2,), (None,)], "v int").select("v", flags, status).collect()
    assert [tuple(r) for r in found] == [(7, "big,odd", "big"), (3, "odd", "odd"), (2, "", "clean"), (None, "", "clean")]
