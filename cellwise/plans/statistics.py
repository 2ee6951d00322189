"""Queries over association, diversity, inference, mining and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellwise.functions.arrays import centred_log_ratio, participation_ratio, unit
from cellwise.operators import aggregates, association, graph, inference, joins, mining, ranking, sampling
from cellwise.plans.bindings import SQL, acts, dims, rows, unit_presence
from cellwise.plans.core import city_units, family_shares, r6
from cellwise.session import read_table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None, base: bool = True):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = (SQL + sql) if base else sql
        return f

    return add


_UP = ", up AS (SELECT DISTINCT row_id, unit FROM acts JOIN dims USING (item))"
_PAIRS = _UP + """, s AS (SELECT unit, count(*) AS k FROM up GROUP BY 1), t AS (SELECT count(*) AS total FROM rows_),
pr AS (SELECT x.unit AS a, y.unit AS b, count(*) AS n FROM up x JOIN up y ON x.row_id = y.row_id AND x.unit < y.unit GROUP BY ALL),
pt AS (SELECT a, b, n, sa.k AS n_a, sb.k AS n_b, total FROM pr JOIN s sa ON sa.unit = a JOIN s sb ON sb.unit = b, t)
"""


def pairs(spark, d) -> DataFrame:
    return association.pair_table(unit_presence(spark, d), "row_id", "unit", rows(spark, d))


@query(_UP + " SELECT x.unit AS a, y.unit AS b, count(*) AS n, round(sum(price), 2) AS weight FROM up x JOIN up y ON x.row_id = y.row_id AND x.unit < y.unit JOIN rows_ r ON r.row_id = x.row_id GROUP BY ALL")
def cooccurrence_matrix(spark, d):
    with_price = unit_presence(spark, d).join(rows(spark, d).select("row_id", "price"), "row_id")
    return association.cooccurrence(with_price, "row_id", "unit", F.col("price")).select("a", "b", "n", F.round("weight", 2).alias("weight"))


@query(_PAIRS + "SELECT a, b, round(n / (n_a + n_b - n), 6) AS jaccard, round(CASE WHEN n >= 5 THEN greatest(log2((n / total + 1e-12) / ((n_a / total) * (n_b / total) + 1e-12)), 0) ELSE 0 END, 6) AS ppmi FROM pt")
def pair_jaccard_ppmi(spark, d):
    return association.jaccard_ppmi(pairs(spark, d), 5).select("a", "b", r6("jaccard").alias("jaccard"), r6("ppmi").alias("ppmi"))


@query(_PAIRS + ", e AS (SELECT *, n_a * n_b / total AS e FROM pt) SELECT a, b, round(e, 6) AS expected, round((n - e) / sqrt(e), 6) AS pearson, round((n - e) / sqrt(e * (1 - n_a / total) * (1 - n_b / total)), 6) AS adjusted, round(ln((n + 0.5) / (e + 0.5)), 6) AS log_lift FROM e")
def pearson_residual(spark, d):
    return association.residuals(pairs(spark, d)).select("a", "b", *(r6(c).alias(c) for c in ("expected", "pearson", "adjusted", "log_lift")))


@query(_UP + """, z AS (SELECT city, count(*) AS size FROM rows_ GROUP BY 1), c AS (SELECT city, unit, count(*) AS n FROM up JOIN rows_ USING (row_id) GROUP BY ALL),
x AS (SELECT c.city, unit, n, size, sum(n) OVER (PARTITION BY unit) AS m, (SELECT sum(size) FROM z) AS t FROM c JOIN z USING (city)),
y AS (SELECT *, n + 0.5 AS p, size - n + 0.5 AS q, m - n + 0.5 AS r, t - size - (m - n) + 0.5 AS s FROM x)
SELECT city, unit, round(ln(p * s / (q * r)), 6) AS log_odds, round(ln(p * s / (q * r)) / sqrt(1 / p + 1 / q + 1 / r + 1 / s), 6) AS z FROM y""")
def city_vs_rest_logodds(spark, d):
    placed = rows(spark, d).select("row_id", "city")
    counts = unit_presence(spark, d).join(placed, "row_id").groupBy("city", "unit").agg(F.count("*").alias("n"))
    counts = counts.join(F.broadcast(placed.groupBy("city").agg(F.count("*").alias("size"))), "city")
    return association.group_versus_rest(counts, "city", "unit").select("city", "unit", r6("log_odds").alias("log_odds"), r6("z").alias("z"))


@query(_UP + """, z AS (SELECT city, count(*) AS size FROM rows_ GROUP BY 1), pu AS (SELECT city, row_id, unit FROM up JOIN rows_ USING (row_id)), k AS (SELECT city, unit, count(*) AS k FROM pu GROUP BY ALL),
o AS (SELECT x.city, x.unit AS a, y.unit AS b, count(*) AS n FROM pu x JOIN pu y ON x.row_id = y.row_id AND x.unit < y.unit GROUP BY ALL),
e AS (SELECT x.city, x.unit AS a, y.unit AS b, coalesce(n, 0) AS n, x.k * y.k / size AS e FROM k x JOIN k y ON x.city = y.city AND x.unit < y.unit JOIN z ON z.city = x.city LEFT JOIN o ON o.city = x.city AND o.a = x.unit AND o.b = y.unit)
SELECT a, b, CAST(sum(n) AS BIGINT) AS observed, round(sum(e), 6) AS expected, count_if(e >= 5 AND n > e) AS above, count_if(e >= 5 AND n < e) AS below, count_if(e >= 5) AS groups, round(ln((sum(n) + 0.5) / (sum(e) + 0.5)), 6) AS log_lift FROM e GROUP BY ALL""")
def city_conditioned_expected(spark, d):
    placed = rows(spark, d).select("row_id", "city")
    out = association.conditioned_expectation(unit_presence(spark, d).join(placed, "row_id"), "city", "row_id", "unit", placed)
    return out.select("a", "b", "observed", r6("expected").alias("expected"), "above", "below", "groups", r6("log_lift").alias("log_lift"))


@query(""", p AS (SELECT city, (1 + (('0x' || substr(sha256(city), 1, 4))::BIGINT)) / 65537.0 AS p FROM (SELECT DISTINCT city FROM rows_)),
r AS (SELECT *, row_number() OVER (ORDER BY p) AS r, count(*) OVER () AS n FROM p) SELECT city, round(least(1, min(p * n / r) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 9) AS q FROM r""")
def bh_qvalues(spark, d):
    from cellwise.functions.hashing import hex_prefix_number

    p = rows(spark, d).select("city").distinct().withColumn("p", (1 + hex_prefix_number(F.col("city"), 4)) / 65537.0)
    return association.benjamini_hochberg(p, "p").select("city", F.round("q", 9).alias("q"))


_CU = ", cu AS (SELECT city, unit, sum(v) AS v FROM acts JOIN rows_ USING (row_id) JOIN dims USING (item) GROUP BY ALL), cs AS (SELECT city, unit, v / sum(v) OVER (PARTITION BY city) AS p FROM cu)"


@query(_CU + " SELECT city, round(-sum(p * log2(p)), 6) AS entropy, count(*) AS richness, round(pow(2, -sum(p * log2(p))), 5) AS effective, round(-sum(p * log2(p)) / log2(count(*)), 6) AS evenness FROM cs GROUP BY 1")
def diversity_entropy(spark, d):
    e = association.entropy(city_units(spark, d), ["city"], "v")
    return e.select("city", r6("entropy").alias("entropy"), "richness", F.round("effective", 5).alias("effective"), r6("evenness").alias("evenness"))


@query(_CU + """, g AS (SELECT c.city, u.unit, coalesce(p, 0) AS p FROM (SELECT DISTINCT city FROM cs) c CROSS JOIN (SELECT DISTINCT unit FROM cs) u LEFT JOIN cs ON cs.city = c.city AND cs.unit = u.unit)
SELECT x.city AS a, y.city AS b, round(sqrt(sum(CASE WHEN x.p > 0 THEN x.p * log2(x.p / ((x.p + y.p) / 2)) ELSE 0 END + CASE WHEN y.p > 0 THEN y.p * log2(y.p / ((x.p + y.p) / 2)) ELSE 0 END) / 2), 6) AS distance FROM g x JOIN g y ON x.unit = y.unit AND x.city < y.city GROUP BY ALL""")
def js_distance(spark, d):
    return association.jensen_shannon(city_units(spark, d), "city", "unit", "v").select("a", "b", r6("distance").alias("distance"))


@query(", s AS (SELECT item, count(DISTINCT city) AS g FROM acts JOIN rows_ USING (row_id) GROUP BY 1) SELECT g AS groups, count(*) AS items, CASE WHEN g >= 12 THEN 'core' WHEN g >= 9 THEN 'near-core' WHEN g >= 6 THEN 'accessory' WHEN g >= 3 THEN 'regional' WHEN g >= 2 THEN 'pair' ELSE 'unique' END AS class FROM s GROUP BY ALL")
def prevalence_spectrum(spark, d):
    has = acts(spark, d).join(rows(spark, d).select("row_id", "city"), "row_id")
    return association.prevalence_spectrum(has, "city", "item", [(1, "unique"), (2, "pair"), (3, "regional"), (6, "accessory"), (9, "near-core"), (12, "core")])


@query(_CU + ", m AS (SELECT unit, sum(p) / (SELECT count(DISTINCT city) FROM cs) AS m FROM cs GROUP BY 1), l AS (SELECT city, unit, p / m AS lift FROM cs JOIN m USING (unit)) SELECT city, unit, round(lift, 6) AS lift FROM l QUALIFY row_number() OVER (PARTITION BY city ORDER BY lift DESC, unit) <= 5")
def marker_lift(spark, d):
    return association.marker_lift(city_units(spark, d), "city", "unit", "share").select("city", "unit", r6("lift").alias("lift"))


_STEPS = "WITH s AS (SELECT user_id, event_id, event_type AS a, lead(event_type) OVER w AS b, lead(event_id) OVER w AS next, value AS x, lead(value) OVER w AS y FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"


@query(_STEPS + ", c AS (SELECT a, b, count(*) AS n FROM s WHERE b IS NOT NULL GROUP BY ALL) SELECT a, b, n, round(n / sum(n) OVER (PARTITION BY a), 6) AS share FROM c", base=False)
def transition_matrix(spark, d):
    return association.transitions(steps(spark, d), "a", "b").select("a", "b", "n", r6("share").alias("share"))


def steps(spark, d) -> DataFrame:
    """Consecutive events of a user, as edges."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read_table(spark, d, "events").select("user_id", F.col("event_id").alias("u"), F.lead("event_id").over(w).alias("v"), F.col("event_type").alias("a"), F.lead("event_type").over(w).alias("b"), F.col("value").alias("x"), F.lead("value").over(w).alias("y"))
    return e.where("v IS NOT NULL")


@query(_STEPS + ", m AS (SELECT avg(value) AS m, var_pop(value) AS v, count(*) AS n FROM events) SELECT n AS nodes, 2 * count(*) AS edges, round(sum((x - m) * (y - m)) / count(*) / any_value(v), 6) AS morans_i, round(-1 / (n - 1), 9) AS expected FROM s, m WHERE next IS NOT NULL GROUP BY n", base=False)
def morans_i(spark, d):
    e = steps(spark, d).select("u", "v")
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    out = association.morans_i(read_table(spark, d, "events").select("event_id", "value"), both, "event_id", "value")
    return out.select("nodes", "edges", r6("morans_i").alias("morans_i"), F.round("expected", 9).alias("expected"))


@query(_STEPS + " SELECT user_id, round(avg(abs(x - y)), 6) AS smoothness, count(*) AS edges FROM s WHERE next IS NOT NULL GROUP BY 1", base=False)
def edge_smoothness(spark, d):
    return steps(spark, d).groupBy("user_id").agg(r6(F.avg(F.abs(F.col("x") - F.col("y")))).alias("smoothness"), F.count("*").alias("edges"))


@query("""WITH RECURSIVE e AS (SELECT vec_id AS u, vec_id + 1 + vec_id % 5 AS v FROM embeddings WHERE vec_id % 3 <> 0), b AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
r(n, m) AS (SELECT u, u FROM b UNION SELECT b.v, r.m FROM r JOIN b ON b.u = r.n) SELECT n AS node, min(m) AS component FROM r GROUP BY 1""", base=False)
def connected_components(spark, d):
    e = read_table(spark, d, "embeddings").where("vec_id % 3 <> 0").select(F.col("vec_id").alias("u"), (F.col("vec_id") + 1 + F.col("vec_id") % 5).alias("v"))
    return graph.components(e)


@query(_STEPS + """, e AS (SELECT user_id, event_id AS u, next AS v, abs(x - y) AS w FROM s WHERE next IS NOT NULL), q AS (SELECT quantile_cont(w, 0.9) AS q FROM e WHERE w > 0),
o AS (SELECT user_id, event_id, sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seg FROM (SELECT ev.*, coalesce(w > q, TRUE) AS cut FROM events ev LEFT JOIN e ON e.v = ev.event_id, q))
SELECT event_id AS node, min(event_id) OVER (PARTITION BY user_id, seg) AS component FROM o""", base=False)
def boundary_segments(spark, d):
    e = steps(spark, d).select("u", "v", F.abs(F.col("x") - F.col("y")).alias("w"))
    return graph.boundary_segments(e, "w", 0.9)


@query("""WITH e(u, v) AS (VALUES (1, 2), (2, 3), (1, 3), (3, 4), (1, 4), (5, 4)) SELECT u, v FROM e WHERE (u, v) NOT IN (VALUES (1, 3), (1, 4))""", base=False)
def transitive_reduction(spark, d):
    return graph.transitive_reduction(spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4), (1, 4), (5, 4)], "u int, v int"))


@query("""WITH RECURSIVE e AS (SELECT vec_id AS u, vec_id + 1 + vec_id % 5 AS v FROM embeddings), b AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
r(n, m) AS (SELECT u, u FROM b UNION SELECT b.v, r.m FROM r JOIN b ON b.u = r.n) SELECT n AS node, min(m) AS component FROM r GROUP BY 1""", base=False)
def embedding_components(spark, d):
    """Components of the graph of all embeddings; connected_components, whose SQL stays as it is, leaves a third out."""
    return graph.components(read_table(spark, d, "embeddings").select(F.col("vec_id").alias("u"), (F.col("vec_id") + 1 + F.col("vec_id") % 5).alias("v")))


@query(", e AS (SELECT x.row_id, x.item AS u, y.item AS v FROM acts x JOIN acts y ON x.row_id = y.row_id AND x.item < y.item AND x.v < y.v) SELECT row_id || '/' || u AS u, row_id || '/' || v AS v FROM e WHERE NOT EXISTS (SELECT 1 FROM e f JOIN e g ON f.row_id = g.row_id AND f.v = g.u WHERE f.row_id = e.row_id AND f.u = e.u AND g.v = e.v)")
def dominance_reduction(spark, d):
    """In each row an item leads to all of larger number and larger value: the edges that none in between replaces."""
    has = acts(spark, d)
    of = lambda x: has.select("row_id", F.concat_ws("/", F.col("row_id").cast("string"), F.col("item").cast("string")).alias(x), F.col("item").alias(f"_i{x}"), F.col("v").alias(f"_v{x}"))
    edges = of("u").join(of("v"), "row_id").where("_iu < _iv AND _vu < _vv").select("u", "v")
    return graph.transitive_reduction(edges)


@query(""", v AS (SELECT label, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
s AS (SELECT 0 AS view, a.label, a.vec_id AS l, b.vec_id AS r, list_cosine_similarity(a.e[1:32], b.e[1:32]) AS s FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id UNION ALL SELECT 1, a.label, a.vec_id, b.vec_id, list_cosine_similarity(a.e[33:64], b.e[33:64]) FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id),
k AS (SELECT view, l, r, 1 - (row_number() OVER (PARTITION BY view, l ORDER BY s DESC, r) - 1) / 5 AS sc, row_number() OVER (PARTITION BY view, l ORDER BY s DESC, r) AS rk FROM s)
SELECT least(l, r) AS a, greatest(l, r) AS b, round(sum(sc) / 2 / 2, 6) AS score FROM k WHERE rk <= 5 GROUP BY ALL""")
def rank_fusion(spark, d):
    """Two views of the embeddings (their halves) within labels, fused by rank."""
    v = read_table(spark, d, "embeddings")
    half = lambda i: joins.nearest_vectors(v.select("label", "vec_id", F.slice("embedding", 32 * i + 1, 32).alias("e")), "vec_id", "e", 5, ["label"])
    views = half(0).withColumn("view", F.lit(0)).union(half(1).withColumn("view", F.lit(1)))
    return ranking.rank_fusion(views, "view", "vec_id", "other", "similarity", 5, 2).select("a", "b", r6("score").alias("score"))


_MINE = _UP + """, n AS (SELECT count(*) AS n FROM up), f1 AS (SELECT unit FROM up GROUP BY 1 HAVING count(*) >= 20), u1 AS (SELECT row_id, unit FROM up JOIN f1 USING (unit))"""


@query(_MINE + """, c2 AS (SELECT [x.unit, y.unit] AS items, count(*) AS support FROM u1 x JOIN u1 y ON x.row_id = y.row_id AND x.unit < y.unit GROUP BY ALL HAVING count(*) >= 20),
c3 AS (SELECT [x.unit, y.unit, z.unit] AS items, count(*) AS support FROM u1 x JOIN u1 y ON x.row_id = y.row_id AND x.unit < y.unit JOIN u1 z ON x.row_id = z.row_id AND y.unit < z.unit GROUP BY ALL HAVING count(*) >= 20)
SELECT array_to_string(items, '+') AS pattern, CAST(1 AS INTEGER) AS size, support FROM (SELECT [unit] AS items, count(*) AS support FROM u1 GROUP BY ALL) UNION ALL SELECT array_to_string(items, '+'), 2, support FROM c2 UNION ALL SELECT array_to_string(items, '+'), 3, support FROM c3""")
def apriori_triples(spark, d):
    sets = mining.frequent_sets(unit_presence(spark, d), "row_id", "unit", 20, 3)
    return sets.select(F.array_join("items", "+").alias("pattern"), "size", "support")


@query(_UP + """, pu AS (SELECT row_id, city, gx, gy, unit FROM up JOIN rows_ USING (row_id)),
c2 AS (SELECT x.unit || '+' || y.unit AS pattern, count(*) AS support FROM pu x JOIN pu y ON x.row_id = y.row_id AND x.unit < y.unit GROUP BY ALL HAVING count(*) >= 30 AND count(DISTINCT x.city) >= 3) SELECT pattern, support FROM c2""")
def apriori_pairs(spark, d):
    """Pairs with minimum rows and cities."""
    placed = unit_presence(spark, d).join(rows(spark, d).select("row_id", "city"), "row_id")
    sets = mining.frequent_sets(placed, "row_id", "unit", 30, 2, [("city", 3)])
    return sets.where("size = 2").select(F.array_join("items", "+").alias("pattern"), "support")


@query(""", fam AS (SELECT a.row_id, d.family, sum(a.v) AS fv FROM acts a JOIN dims d USING (item) GROUP BY ALL), tot AS (SELECT row_id, sum(v) AS t FROM acts GROUP BY 1), sh AS (SELECT row_id, family, fv / t AS share FROM fam JOIN tot USING (row_id)),
w AS (SELECT family, share, count(*) AS w FROM sh JOIN rows_ USING (row_id) WHERE CAST(('0x' || substr(sha256(city), 1, 8)) AS BIGINT) % 3 <> 0 GROUP BY ALL), c AS (SELECT family, share, sum(w) OVER (PARTITION BY family ORDER BY share) AS c, sum(w) OVER (PARTITION BY family) AS t FROM w),
th AS (SELECT family, greatest(min(share), 0.005) AS threshold FROM c WHERE c >= 0.6 * t - 1e-12 GROUP BY 1), ra AS (SELECT row_id, family, share / threshold AS ratio FROM sh JOIN th USING (family))
SELECT row_id, min(family) AS family, round(any_value(m), 6) AS ratio FROM (SELECT *, max(ratio) OVER (PARTITION BY row_id) AS m FROM ra) WHERE ratio = m AND m >= 1 GROUP BY 1""")
def unit_assignment(spark, d):
    """Winner-take-all families: thresholds from the discovery cities only."""
    placed = sampling.split_groups(rows(spark, d), "city").select("row_id", "discovery", F.lit(1.0).alias("one"))
    scores = family_shares(spark, d)
    thresholds = mining.calibrate(scores.join(placed, "row_id"), "discovery", "family", "share", "one", 0.6, 0.005)
    return mining.assign(scores, thresholds, "row_id", "family", "share").select("row_id", "family", r6("ratio").alias("ratio"))


@query(_UP + """, pu AS (SELECT row_id, city, CAST(('0x' || substr(sha256(city), 1, 8)) AS BIGINT) % 3 <> 0 AS dis, gx * 1000 + gy AS cell, unit FROM up JOIN rows_ USING (row_id))
SELECT x.unit AS a, y.unit AS b, count_if(x.dis) AS discovery_rows, count_if(NOT x.dis) AS evaluation_rows, count(DISTINCT x.city) FILTER (x.dis) AS discovery_cities, count(DISTINCT x.cell) FILTER (x.dis) AS discovery_cells FROM pu x JOIN pu y ON x.row_id = y.row_id AND x.unit < y.unit GROUP BY ALL""")
def pattern_split_support(spark, d):
    placed = sampling.split_groups(rows(spark, d), "city").select("row_id", "city", "discovery", (F.col("gx") * 1000 + F.col("gy")).alias("cell"))
    has = unit_presence(spark, d)
    both = has.select("row_id", F.col("unit").alias("a")).join(has.select("row_id", F.col("unit").alias("b")), "row_id").where("a < b").join(placed, "row_id")
    on = F.col("discovery")
    return both.groupBy("a", "b").agg(F.count_if(on).alias("discovery_rows"), F.count_if(~on).alias("evaluation_rows"), F.countDistinct(F.when(on, F.col("city"))).alias("discovery_cities"), F.countDistinct(F.when(on, F.col("cell"))).alias("discovery_cells"))


@query(_MINE + """, c AS (SELECT [unit] AS items, count(*) AS support FROM u1 GROUP BY ALL UNION ALL SELECT [x.unit, y.unit], count(*) FROM u1 x JOIN u1 y ON x.row_id = y.row_id AND x.unit < y.unit GROUP BY ALL HAVING count(*) >= 20)
SELECT array_to_string(items, '+') AS pattern, support FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE len(b.items) > len(a.items) AND list_has_all(b.items, a.items) AND b.support >= 0.12 * a.support)""")
def near_closed_prune(spark, d):
    sets = mining.frequent_sets(unit_presence(spark, d), "row_id", "unit", 20, 2)
    return mining.prune_near_closed(sets, 0.12).select(F.array_join("items", "+").alias("pattern"), "support")


@query(_UP + """, z AS (SELECT city, gx // 5 * 100 + gy // 5 AS block, count(*) AS n FROM rows_ GROUP BY ALL), pu AS (SELECT city || '/' || (gx // 5 * 100 + gy // 5) AS block, row_id, unit FROM up JOIN rows_ USING (row_id)), k AS (SELECT block, unit, count(*) AS k FROM pu GROUP BY ALL),
o AS (SELECT x.unit AS a, y.unit AS b, count(*) AS n FROM pu x JOIN pu y ON x.row_id = y.row_id AND x.unit < y.unit GROUP BY ALL), e AS (SELECT x.unit AS a, y.unit AS b, sum(x.k * y.k / n) AS e FROM k x JOIN k y ON x.block = y.block AND x.unit < y.unit JOIN z ON z.city || '/' || z.block = x.block GROUP BY ALL)
SELECT e.a, e.b, coalesce(n, 0) AS observed, round(e, 6) AS expected, round(coalesce(n, 0) / e, 6) AS lift FROM e LEFT JOIN o ON o.a = e.a AND o.b = e.b""")
def block_expected_lift(spark, d):
    placed = rows(spark, d).select("row_id", F.concat_ws("/", "city", (F.floor(F.col("gx") / 5) * 100 + F.floor(F.col("gy") / 5)).cast("string")).alias("block"))
    out = association.covered_expectation(unit_presence(spark, d).join(placed, "row_id"), "block", "row_id", "unit", placed)
    return out.select("a", "b", "observed", r6("expected").alias("expected"), r6("lift").alias("lift"))


@query(_UP + """, n AS (SELECT city, gx, gy, count(*) AS n FROM rows_ GROUP BY ALL), k AS (SELECT city, count(*) AS k FROM n GROUP BY 1), c AS (SELECT city, gx, gy, unit, count(*) AS c FROM up JOIN rows_ USING (row_id) GROUP BY ALL)
SELECT city, unit, round(sum(c / n) / any_value(k), 6) AS cell_rate, CAST(sum(c) AS BIGINT) AS positive_rows, count(*) AS positive_cells, any_value(k) AS observed_cells FROM c JOIN n USING (city, gx, gy) JOIN k USING (city) GROUP BY ALL""")
def city_pattern_rates(spark, d):
    placed = rows(spark, d)
    cells = placed.groupBy("city", "gx", "gy").agg(F.count("*").alias("n"))
    found = unit_presence(spark, d).join(placed, "row_id").groupBy("city", "gx", "gy", "unit").agg(F.count("*").alias("c")).join(cells, ["city", "gx", "gy"])
    out = found.groupBy("city", "unit").agg(F.sum(F.col("c") / F.col("n")).alias("s"), F.sum("c").alias("positive_rows"), F.count("*").alias("positive_cells"))
    return out.join(F.broadcast(cells.groupBy("city").agg(F.count("*").alias("observed_cells"))), "city").select("city", "unit", r6(F.col("s") / F.col("observed_cells")).alias("cell_rate"), "positive_rows", "positive_cells", "observed_cells")


@query(_PAIRS + ", e AS (SELECT *, n_a * n_b / total AS e FROM pt) SELECT a, b, n, round(n / e, 6) AS lift, round((n - e) / sqrt(e), 6) AS z FROM e WHERE n >= 10 AND n / e >= 1.02")
def pair_lift_mining(spark, d):
    out = mining.rule_lift(unit_presence(spark, d), "row_id", "unit", rows(spark, d), 10, 1.02)
    return out.select("a", "b", "n", r6("lift").alias("lift"), r6("z").alias("z"))


@query("SELECT vec_id, round(sqrt(list_dot_product(e, e)), 6) AS length, round(pow(list_sum(a), 2) / list_sum(list_transform(a, lambda x: x * x)), 6) AS effective FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, list_transform(CAST(embedding AS DOUBLE[]), lambda x: abs(x)) AS a FROM embeddings)", base=False)
def vector_norms(spark, d):
    from cellwise.functions.arrays import norm

    v = read_table(spark, d, "embeddings").withColumn("a", F.transform("embedding", lambda x: F.abs(x.cast("double"))))
    return v.select("vec_id", r6(norm(F.col("embedding"))).alias("length"), r6(participation_ratio(F.col("a"))).alias("effective"))


@query(_CU + ", l AS (SELECT city, unit, ln(p + 1e-3) AS l FROM cs) SELECT city, unit, round(l - avg(l) OVER (PARTITION BY city), 6) AS clr FROM l")
def composition_log_ratio(spark, d):
    lists = city_units(spark, d).groupBy("city").agg(F.array_sort(F.collect_list(F.struct("unit", "share"))).alias("x"))
    clr = lists.select("city", F.explode(F.arrays_zip(F.col("x.unit").alias("unit"), centred_log_ratio(F.col("x.share")).alias("clr"))).alias("y"))
    return clr.select("city", "y.unit", r6("y.clr").alias("clr"))


@query(None)
def permutation_overlap(spark, d):
    """How often two units share a row if one's rows are shuffled within cities: expected count, and p of 9,999 draws, of all pairs of units."""
    placed = rows(spark, d).select("row_id", "city")
    has = unit_presence(spark, d).join(placed, "row_id")
    strata = has.groupBy("city", "unit").agg(F.count("*").alias("k")).join(F.broadcast(placed.groupBy("city").agg(F.count("*").alias("size"))), "city")
    of = lambda x: strata.select("city", F.col("unit").alias(x), F.col("k").alias(f"k{x}"))
    by = of("a").join(of("b").join(strata.select("city", "size").distinct(), "city"), "city").where("a < b").groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct("city", "size", "ka", "kb"))).alias("s"))
    units = has.select("unit").distinct()
    every = units.withColumnRenamed("unit", "a").join(units.withColumnRenamed("unit", "b"), F.col("a") < F.col("b")).join(by, ["a", "b"], "left")
    every = every.join(association.cooccurrence(has, "row_id", "unit").select("a", "b", "n"), ["a", "b"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    # Dealt by a number of its own: AQE would join so few rows into one task, and the draws are what takes time.
    every = every.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "a", "b")
    values = lambda x: F.coalesce(F.transform("s", lambda y: y[x]), F.array().cast("array<bigint>"))
    expected = F.coalesce(F.aggregate("s", F.lit(0.0), lambda e, y: e + y["ka"] * y["kb"] / y["size"]), F.lit(0.0))
    return every.select("a", "b", "n", expected.alias("expected"), inference.overlap_p(9_999)(F.concat_ws("/", "a", "b"), values("size"), values("ka"), values("kb"), F.col("n")).alias("p"))


@query(None)
def block_bootstrap(spark, d):
    """Share of rows above a price, with its interval over resampled blocks."""
    b = rows(spark, d).groupBy(F.concat_ws("/", "city", F.floor(F.col("gx") / 5).cast("string"), F.floor(F.col("gy") / 5).cast("string")).alias("block")).agg(F.sum((F.col("price") > 250_000).cast("double")).alias("top"), F.count("*").cast("double").alias("bottom"))
    return inference.bootstrap_ratio(b, "block", "top", "bottom", 199)


@query(None)
def hypergeometric_tails(spark, d):
    """Exact upper tails of the shared rows of all pairs of units."""
    return pairs(spark, d).select("a", "b", inference.hypergeometric_tail(F.col("total"), F.col("n_a"), F.col("n_b"), F.col("n")).alias("p"))


@query(None)
def harmonic_diffusion(spark, d):
    """Values of every tenth event spread along the users' chains."""
    e = steps(spark, d).select("u", "v")
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return graph.diffuse(both, read_table(spark, d, "events").where("event_id % 10 = 0").select("event_id", "value"), "event_id", "value", 60)
