"""Registered queries without SQL against brute force over the whole of the smallest tables."""

import os
from itertools import combinations
from math import comb, sqrt

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from oracle import TABLES, database, rows_of

from cellwise.plans.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def db():
    return database()


def test_harmonic_diffusion_makes_sixty_steps(spark, db):
    events = db.sql("SELECT event_id, value, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events").fetchall()
    at = {e: i for i, (e, _, _) in enumerate(events)}
    near = [[] for _ in at]
    for e, _, after in events:
        if after is not None:
            near[at[e]].append(at[after])
            near[at[after]].append(at[e])
    anchors = {at[e]: v for e, v, _ in events if e % 10 == 0}
    x = np.array([anchors.get(i, 0.0) for i in range(len(at))])
    for _ in range(60):
        x = np.array([anchors[i] if i in anchors else x[n].mean() if n else 0.0 for i, n in enumerate(near)])
    got = {r.event_id: r.value for r in QUERIES["harmonic_diffusion"](spark, TABLES).collect()}
    assert got.keys() == at.keys()
    assert [got[e] for e in at] == pytest.approx(list(x), abs=1e-9)


def test_greedy_cover_covers_all_rows(spark, db):
    left = {}
    for unit, row in db.sql("SELECT DISTINCT p_brand, l_orderkey FROM lineitem JOIN part ON p_partkey = l_partkey").fetchall():
        left.setdefault(unit, set()).add(row)
    wanted = []
    while len(wanted) < 10:
        best = min(left, key=lambda u: (-len(left[u]), u))
        if not left[best]:
            break
        gain = set(left[best])
        wanted.append((best, len(gain)))
        left = {u: rows - gain for u, rows in left.items()}
    assert sorted(map(tuple, QUERIES["greedy_cover"](spark, TABLES).collect())) == sorted(wanted)


def test_permutation_overlap_tests_all_pairs(spark, db):
    city = dict(db.sql("SELECT o_orderkey, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey").fetchall())
    held = {}
    for unit, row in db.sql("SELECT DISTINCT p_brand, l_orderkey FROM lineitem JOIN part ON p_partkey = l_partkey").fetchall():
        held.setdefault(unit, set()).add(row)
    by = {}
    for row, c in city.items():
        by.setdefault(c, set()).add(row)
    got = {(r.a, r.b): r for r in QUERIES["permutation_overlap"](spark, TABLES).collect()}
    assert got.keys() == set(combinations(sorted(held), 2))
    for (a, b), r in got.items():
        exact, expected = np.ones(1), 0.0
        for rows in by.values():
            n, k, m = len(rows), len(rows & held[a]), len(rows & held[b])
            exact = np.convolve(exact, [comb(k, x) * comb(n - k, m - x) / comb(n, m) for x in range(min(k, m) + 1)])
            expected += k * m / n
        tail = min(1.0, exact[r.n :].sum())
        assert r.n == len(held[a] & held[b] & city.keys())
        assert r.expected == pytest.approx(expected, abs=1e-9)
        assert r.p == pytest.approx(tail, abs=5 * sqrt(tail * (1 - tail) / 9999) + 5e-4)
    assert min(r.p for r in got.values()) < 1 / 40


def test_overlap_p_counts_empty_draws(spark):
    from pyspark.sql import functions as F

    from cellwise.operators import inference

    d = spark.createDataFrame([("rare", [1000], [1], [1], 1), ("never", [], [], [], 0)], "k string, n array<long>, a array<long>, b array<long>, x long")
    p = {r.k: r.p for r in d.select("k", inference.overlap_p(9_999)(*(F.col(c) for c in ("k", "n", "a", "b", "x"))).alias("p")).collect()}
    assert p["never"] == 1 and p["rare"] == pytest.approx(0.001, abs=0.002)


def test_graph_queries_use_all_rows(spark, db):
    ids = {x for (x,) in db.sql("SELECT vec_id FROM embeddings").fetchall()}
    assert ids <= {r.node for r in QUERIES["embedding_components"](spark, TABLES).collect()}
    held = {}
    for row, item, v in db.sql("SELECT l_orderkey, l_partkey, sum(l_quantity) FROM lineitem GROUP BY ALL").fetchall():
        held.setdefault(row, []).append((item, v))
    less = lambda x, y: x[0] < y[0] and x[1] < y[1]
    wanted = {(f"{row}/{x[0]}", f"{row}/{y[0]}") for row, xs in held.items() for x in xs for y in xs if less(x, y) and not any(less(x, z) and less(z, y) for z in xs)}
    got = QUERIES["dominance_reduction"](spark, TABLES).collect()
    assert len(got) == len(wanted) and {(r.u, r.v) for r in got} == wanted


def test_transitive_reduction_of_a_long_path_with_shortcuts(spark):
    from cellwise.operators import graph

    edges = [(i, i + 1) for i in range(20)] + [(0, 20), (3, 9), (5, 7), (2, 100)]
    got = graph.transitive_reduction(spark.createDataFrame(edges, "u int, v int")).collect()
    assert {(r.u, r.v) for r in got} == {*edges[:20], (2, 100)}


def test_grid_projections_of_many_cells(spark, tmp_path):
    cells = [(gx, gy) for gx in (0, 17, 30, 39) for gy in (0, 17, 37, 38, 39, 60, 375, 1400, 22_499)]
    db = duckdb.connect()
    tables = {
        "customer": pd.DataFrame({"c_custkey": [40 * gy + gx for gx, gy in cells], "c_nationkey": 1}),
        "orders": pd.DataFrame({"o_orderkey": range(len(cells)), "o_custkey": [40 * gy + gx for gx, gy in cells], "o_totalprice": 1.0, "o_orderdate": pd.Timestamp("2020-01-01")}),
        "nation": pd.DataFrame({"n_nationkey": [1], "n_name": ["A"]}),
        "lineitem": pd.DataFrame({"l_orderkey": [0], "l_partkey": [0], "l_quantity": [1.0]}),
        "part": pd.DataFrame({"p_partkey": [0], "p_type": ["a"], "p_brand": ["b"], "p_name": ["c"]}),
    }
    for name, table in tables.items():
        db.register("table_", table)
        db.sql(f"COPY table_ TO '{tmp_path}/{name}.parquet'")
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    found = QUERIES["grid_projections"](spark, str(tmp_path))
    wanted = db.sql(ORACLES["grid_projections"]).df()
    assert found.where("my IS NULL").count() == 0 and wanted.my.isna().any()
    assert rows_of(found.toPandas()) == rows_of(wanted)


@pytest.fixture(scope="module")
def odd_vectors(tmp_path_factory):
    """Embeddings with copies, multiples, opposites, zero, null and infinite vectors, missing labels, repeated ids, a label of one."""
    random = np.random.default_rng(3)
    x = random.standard_normal((300, 64)).astype(np.float32)
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)]
    rows += [(1000 + i, x[7].tolist(), 1) for i in range(40)] + [(1100 + i, (x[10] * (1 + i)).tolist(), 1) for i in range(30)] + [(1200 + i, (-x[i]).tolist(), i % 3) for i in range(20)]
    rows += [(1300 + i, [0.0] * 64, 2) for i in range(4)] + [(1310, [float("inf")] + [1.0] * 63, 2), (1311, [0.0] * 32 + x[5, 32:].tolist(), 2), (1312, None, 2), (1313, None, 5), (1314, x[3].tolist(), 5), (1315, x[4].tolist(), 5)]
    rows += [(1320, x[0].tolist(), None), (None, x[0].tolist(), 0), (1330, x[0].tolist(), 6), (3, x[30].tolist(), 0), (3, x[3].tolist(), 0), (-5, x[1].tolist(), 1), (-6, x[1].tolist(), 1)]
    table = pa.table({"vec_id": pa.array([r[0] for r in rows], pa.int64()), "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float32())), "label": pa.array([r[2] for r in rows], pa.int32())})
    folder = tmp_path_factory.mktemp("vectors")
    for name in os.listdir(TABLES):
        if name != "embeddings.parquet":
            os.symlink(f"{TABLES}/{name}", folder / name)
    pq.write_table(table, folder / "embeddings.parquet")
    return str(folder)


@pytest.mark.parametrize("chunk", [8192, 50])
@pytest.mark.parametrize("name", ["cosine_knn", "mutual_best_match", "rank_fusion"])
def test_nearest_of_odd_vectors(spark, odd_vectors, monkeypatch, name, chunk):
    from cellwise.operators import joins

    monkeypatch.setattr(joins, "CHUNK", chunk)
    monkeypatch.setattr(joins, "LEAST", chunk // 8)
    db = duckdb.connect()
    for table in os.listdir(odd_vectors):
        db.sql(f"CREATE VIEW {table[:-8]} AS SELECT * FROM '{odd_vectors}/{table}'")
    found, wanted = QUERIES[name](spark, odd_vectors).toPandas(), db.sql(ORACLES[name]).df()
    assert rows_of(found) == rows_of(wanted) and len(found) > 50
