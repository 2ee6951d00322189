"""Small fixtures with known answers."""

import pytest
from pyspark.sql import functions as F

from cellwise.functions.geometry import block_of, circular_distance, utm_xy
from cellwise.operators import aggregates, association, graph, inference, joins, mining, ranking, sampling


def test_stable_top_ten_is_the_same_in_any_order(spark):
    ids = [f"p{i}" for i in range(25)]
    one = spark.createDataFrame([("a", i) for i in ids + ids[:3]], "cell string, id string")
    two = spark.createDataFrame([("a", i) for i in reversed(ids)], "cell string, id string").repartition(3)
    pick = lambda d: sorted(r.id for r in sampling.top_by_hash(d, ["cell"], "id", 10).collect())
    assert pick(one) == pick(two) and len(pick(one)) == 10


def test_cell_weights(spark):
    rows = spark.createDataFrame([("A", 1, i) for i in range(10)] + [("A", 2, 10), ("B", 1, 11)], "city string, cell int, id int")
    w = {r.id: r.weight for r in sampling.cell_weights(rows, "city", ["cell"]).collect()}
    assert w[0] == pytest.approx(0.05) and w[10] == 0.5 and w[11] == 1


def test_shares_have_all_items_in_the_denominator(spark):
    acts = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (0, 2, 3.0), (0, 9, 14.0), (1, 0, 0.0)], "row int, item int, v double")
    dims = spark.createDataFrame([(0, "building"), (2, "building"), (1, "tree")], "item int, family string")
    got = {(r.row, r.family): r.share for r in aggregates.shares(acts, dims, "row", "item", "v", "family").collect()}
    assert got == {(0, "building"): 0.2, (0, "tree"): 0.1, (1, "building"): 0.0}


def test_weighted_quantile_of_nothing_is_the_default(spark):
    d = spark.createDataFrame([("a", 0.0, 1.0), ("b", 0.01, 1.0), ("b", 0.02, 1.0), ("b", 0.03, 0.5)], "g string, x double, w double")
    assert {r.g: r.threshold for r in aggregates.weighted_quantile(d, ["g"], "x", "w", 0.6).collect()} == {"a": 1.0, "b": 0.02}


def test_benjamini_hochberg(spark):
    p = [0.01, 0.04, 0.03, 1.0]
    got = {r.p: r.q for r in association.benjamini_hochberg(spark.createDataFrame([(x,) for x in p], "p double"), "p").collect()}
    assert [got[x] for x in p] == pytest.approx([0.04, 0.16 / 3, 0.16 / 3, 1.0])
    assert association.benjamini_hochberg(spark.createDataFrame([], "p double"), "p").count() == 0


def test_greedy_cover(spark):
    sets = lambda *s: spark.createDataFrame([(i, x) for i, v in enumerate(s) for x in v], "c int, x int")
    assert [c for c, _ in sampling.greedy_cover(sets({0, 1, 2}, {1, 2}, {3, 4, 5}, {4, 5}), "c", "x", 2)] == [0, 2]
    assert [c for c, _ in sampling.greedy_cover(sets({0, 1}, {2, 3}, {0, 1, 2, 3}), "c", "x", 3)] == [2]


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3)], "u long, v long")
    got = {r.node: r.component for r in graph.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert graph.components(edges.limit(0)).count() == 0


def test_segments_and_diffusion(spark):
    edges = spark.createDataFrame([(1, 2, 0.1), (2, 3, 9.0), (3, 4, 0.1), (4, 5, 0.2)], "u long, v long, d double")
    assert {r.node: r.component for r in graph.boundary_segments(edges, "d", 0.9).collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 3}
    both = edges.select("u", "v").union(edges.select("v", "u"))
    got = {r.n: r.x for r in graph.diffuse(both, spark.createDataFrame([(1, 0.0), (5, 4.0)], "n long, x double"), "n", "x", 60).collect()}
    assert [got[i] for i in range(1, 6)] == pytest.approx([0, 1, 2, 3, 4], abs=0.05)


def test_frequent_sets_have_one_item_of_a_family(spark):
    rows = [(i, x, f) for i in range(10) for x, f in (("a", "p"), ("b", "q"), ("c", "q"))]
    got = {tuple(r["items"]): r.support for r in mining.frequent_sets(spark.createDataFrame(rows, "row int, item string, family string"), "row", "item", 5, 3, family="family").collect()}
    assert got == {("a",): 10, ("b",): 10, ("c",): 10, ("a", "b"): 10, ("a", "c"): 10}


def test_pairs_within_agree_with_all_pairs(spark):
    points = [(i, 48 + (i * 37 % 50) / 1000, 16 + (i * 91 % 70) / 1000) for i in range(80)]
    d = spark.createDataFrame(points, "id int, lat double, lon double")
    from cellwise.functions.geometry import haversine_m

    every = d.select(F.col("id").alias("a"), F.col("lat").alias("x"), F.col("lon").alias("y")).crossJoin(d.select(F.col("id").alias("b"), F.col("lat").alias("p"), F.col("lon").alias("q"))).where("a < b")
    wanted = {(r.a, r.b) for r in every.where(haversine_m(F.col("x"), F.col("y"), F.col("p"), F.col("q")) <= 900).collect()}
    assert {(r.a, r.b) for r in joins.pairs_within(d, "id", "lat", "lon", 900.0).collect()} == wanted and wanted


def test_shuffle_keeps_strata_and_depends_on_the_seed_only(spark):
    d = spark.createDataFrame([(i, "a" if i < 6 else "b", i * 10) for i in range(12)], "k int, s string, x int")
    got = inference.shuffled_within(d, ["s"], "k", "x", 3).collect()
    for rep in range(3):
        for s, wanted in (("a", range(0, 60, 10)), ("b", range(60, 120, 10))):
            assert sorted(r.x for r in got if r.rep == rep and r.s == s) == list(wanted)
    assert sorted(map(tuple, got)) == sorted(map(tuple, inference.shuffled_within(d.repartition(5), ["s"], "k", "x", 3).select(*inference.shuffled_within(d, ["s"], "k", "x", 3).columns).collect()))


def test_hypergeometric_tail_and_normal_tail(spark):
    d = spark.createDataFrame([(4, 2, 2, 2), (4, 0, 2, 0)], "t int, a int, b int, x int")
    assert [r.p for r in d.select(inference.hypergeometric_tail("t", "a", "b", "x").alias("p")).collect()] == pytest.approx([1 / 6, 1.0])
    assert spark.range(1).select(inference.p_from_z(F.lit(1.959963985)).alias("p")).first().p == pytest.approx(0.025, abs=1e-6)


def test_expressions(spark):
    r = spark.range(1).select(block_of(F.lit(-1)).alias("b"), circular_distance(F.lit(350.0), F.lit(20.0)).alias("c"), *(x.alias(n) for x, n in zip(utm_xy(F.lit(48.2082), F.lit(16.3738), F.lit(33)), "en"))).first()
    assert r.b == -1 and r.c == 30
    assert (r.e, r.n) == pytest.approx((601_934, 5_340_486), abs=400)


def test_batch_top_k_counts_rows_not_cells(spark):
    acts = spark.createDataFrame([("b", 1, i, float(i)) for i in range(6)] + [("b", 2, 0, 0.5)], "batch string, row int, item int, v double")
    assert [r.v for r in ranking.batch_top_k(acts, "batch", "row", "item", "v", 2).orderBy("v").collect()] == [2.0, 3.0, 4.0, 5.0]
