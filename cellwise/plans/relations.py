"""Queries over typed relations, matches of clusterings, screens, strongest examples and neighbour graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellwise.functions.geometry import local_cell
from cellwise.operators import association, graph, ranking
from cellwise.operators import relations as ops
from cellwise.operators.profiles import cosine_pairs
from cellwise.plans.bindings import SQL, acts, dims, rows, unit_presence
from cellwise.plans.core import r6
from cellwise.session import read_table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str, base: bool = True):
    """Register the function under its name, with the SQL that must give the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = (SQL + sql) if base else sql
        return f

    return add


def unit_mass(spark, d) -> DataFrame:
    """row_id, unit, v (double)."""
    return acts(spark, d).join(dims(spark, d).select("item", "unit"), "item").groupBy("row_id", "unit").agg(F.sum("v").cast("double").alias("v"))


_MASS = ", um AS (SELECT row_id, unit, CAST(sum(v) AS DOUBLE) AS v FROM acts JOIN dims USING (item) GROUP BY ALL)\n"


@query(_MASS + """, c AS (SELECT city, gx, gy, unit, sum(v) AS v FROM um JOIN rows_ USING (row_id) GROUP BY ALL), n AS (SELECT city, gx, gy, sqrt(sum(v * v)) AS norm FROM c GROUP BY ALL),
u AS (SELECT city, gx, gy, unit, v / norm AS u FROM c JOIN n USING (city, gx, gy)),
p AS (SELECT a.city, a.gx AS ax, a.gy AS ay, b.gx AS bx, b.gy AS b_y, sum(a.u * b.u) AS s FROM u a JOIN u b ON a.city = b.city AND a.unit = b.unit AND (a.gx, a.gy) < (b.gx, b.gy) GROUP BY ALL),
h AS (SELECT city, count(*) AS cells FROM n GROUP BY 1), hp AS (SELECT city, sum(s) AS s FROM p GROUP BY 1),
e AS (SELECT a.city, a.gx AS ax, a.gy AS ay, b.gx AS bx, b.gy AS b_y FROM n a JOIN n b ON a.city = b.city AND ((a.gx + 1 = b.gx AND a.gy = b.gy) OR (a.gx = b.gx AND a.gy + 1 = b.gy))),
l AS (SELECT e.city, count(*) AS edges, avg(coalesce(s, 0)) AS s FROM e LEFT JOIN p ON p.city = e.city AND p.ax = e.ax AND p.ay = e.ay AND p.bx = e.bx AND p.b_y = e.b_y GROUP BY 1)
SELECT h.city, cells, coalesce(edges, 0) AS edges, CASE WHEN cells > 1 THEN round(coalesce(hp.s, 0) / (cells * (cells - 1) / 2), 6) END AS homogeneity, round(l.s, 6) AS continuity FROM h LEFT JOIN hp USING (city) LEFT JOIN l USING (city)""")
def grid_similarity(spark, d):
    """Likeness of all cells of a city and of neighbouring ones."""
    cells = unit_mass(spark, d).join(rows(spark, d), "row_id").groupBy("city", "gx", "gy", "unit").agg(F.sum("v").alias("v"))
    found = ops.grid_summary(cells, "city", "gx", "gy", "unit", "v")
    return found.select("city", "cells", "edges", r6("homogeneity").alias("homogeneity"), r6("continuity").alias("continuity"))


_PRESENT = ", pr AS (SELECT DISTINCT row_id, unit FROM acts JOIN dims USING (item))\n"


@query(_MASS + """, sh AS (SELECT row_id, unit, v / sum(v) OVER (PARTITION BY row_id) AS share FROM um), n AS (SELECT unit, count(*) AS n FROM um GROUP BY 1), t AS (SELECT count(*) AS t FROM rows_),
q AS (SELECT x.unit AS a, y.unit AS b, count(*) AS o FROM um x JOIN um y ON x.row_id = y.row_id AND x.unit < y.unit GROUP BY ALL),
g AS (SELECT a, b, ln((o + 0.5) / (na.n * nb.n / t + 0.5)) AS score FROM q JOIN n na ON na.unit = a JOIN n nb ON nb.unit = b, t),
k AS (SELECT x.row_id, a, b, least(x.share, y.share) * score AS s FROM sh x JOIN sh y ON x.row_id = y.row_id AND x.unit < y.unit JOIN g ON a = x.unit AND b = y.unit WHERE score > 0 AND least(x.share, y.share) >= 0.05),
r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY s DESC, a, b) AS i FROM k)
SELECT row_id, round(max(s), 6) AS highest, round(sum(s) FILTER (WHERE i <= 3) / 3, 6) AS top3_mean FROM r GROUP BY 1""")
def row_atypicality(spark, d):
    """Orders by pairs of units that occur together more than by chance."""
    mass, n = unit_mass(spark, d), rows(spark, d).agg(F.count("*").alias("t"))
    shares = mass.join(mass.groupBy("row_id").agg(F.sum("v").alias("t")), "row_id").select("row_id", "unit", (F.col("v") / F.col("t")).alias("share"))
    counts = association.supports(unit_presence(spark, d), "unit").toDF("unit", "n")
    pairs = association.cooccurrence(unit_presence(spark, d), "row_id", "unit").select("a", "b", F.col("n").alias("o"))
    both = pairs.join(counts.toDF("a", "na"), "a").join(counts.toDF("b", "nb"), "b").crossJoin(F.broadcast(n))
    score = F.log((F.col("o") + 0.5) / (F.col("na") * F.col("nb") / F.col("t") + 0.5))
    found = ops.row_atypicality(shares, both.select("a", "b", score.alias("score")).where("score > 0"), "row_id", "unit", "share", 0.05)
    return found.select("row_id", r6("highest").alias("highest"), r6("top3_mean").alias("top3_mean"))


@query(_MASS + """, th AS (SELECT unit, avg(v) AS threshold FROM um GROUP BY 1), pt(pattern, unit) AS (VALUES ('one', 'Brand#11'), ('two', 'Brand#21'), ('two', 'Brand#5')),
z AS (SELECT pattern, count(*) AS size FROM pt GROUP BY 1), h AS (SELECT pattern, row_id, min(v / threshold) AS strength FROM um JOIN th USING (unit) JOIN pt USING (unit) JOIN z USING (pattern) WHERE v / threshold >= 1 GROUP BY pattern, row_id, size HAVING count(*) = size),
b AS (SELECT *, row_number() OVER (PARTITION BY pattern, city, gx // 5, gy // 5 ORDER BY strength DESC, row_id) AS k FROM h JOIN rows_ USING (row_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY pattern, city ORDER BY strength DESC, row_id) AS place FROM b WHERE k = 1)
SELECT pattern, city, row_id, CAST(place AS INTEGER) AS place, round(strength, 6) AS strength FROM r WHERE place <= 3""")
def block_examples(spark, d):
    """The three strongest orders of each pattern and city, one a block of 5 x 5 cells."""
    mass = unit_mass(spark, d)
    marks = mass.groupBy("unit").agg(F.avg("v").alias("threshold"))
    patterns = spark.createDataFrame([("one", "Brand#11"), ("two", "Brand#21"), ("two", "Brand#5")], "pattern string, unit string")
    placed = rows(spark, d).select("row_id", "city", "gx", "gy")
    block = [F.expr("gx div 5"), F.expr("gy div 5")]
    found = ops.strongest_examples(mass, marks, patterns, placed, "row_id", "unit", "v", "city", block, 3)
    return found.select("pattern", "city", "row_id", "place", r6("strength").alias("strength"))


@query(""", x AS (SELECT item, row_id % 2 = 0 AS fixed, least(gy % 28 // 7, 3) AS py, least(gx % 28 // 7, 3) AS px FROM acts JOIN rows_ USING (row_id) WHERE v > 0),
b AS (SELECT item, max(n) AS top FROM (SELECT item, py, px, count(*) AS n FROM x GROUP BY ALL) GROUP BY 1), s AS (SELECT item, count(*) AS n, count(*) FILTER (WHERE fixed) AS f FROM x GROUP BY 1),
a AS (SELECT dims.item, coalesce(n, 0) AS n, coalesce(f, 0) AS f, coalesce(top, 0) AS top FROM dims LEFT JOIN s USING (item) LEFT JOIN b USING (item)), t AS (SELECT *, CASE WHEN f > 0 THEN f ELSE n END AS support FROM a)
SELECT item, support, CASE WHEN f > 0 THEN 'fixed_validation' ELSE 'expanded_posthoc' END AS scope, CASE WHEN support = 0 THEN 'no_positive_activation' WHEN support < 20 THEN 'insufficient_support' ELSE 'reviewable' END AS status, n >= 20 AND top >= 0.7 * n AS position_review FROM t""")
def support_screen(spark, d):
    positive = acts(spark, d).where("v > 0").join(rows(spark, d).select("row_id", "gx", "gy"), "row_id")
    return ops.support_screen(positive, dims(spark, d), "item", F.col("row_id") % 2 == 0, F.col("gy") % 28, F.col("gx") % 28)


_COSINE = _MASS + """, uc AS (SELECT unit, city, sum(v) AS v FROM um JOIN rows_ USING (row_id) GROUP BY ALL), un AS (SELECT unit, sqrt(sum(v * v)) AS norm FROM uc GROUP BY 1),
cs AS (SELECT x.unit AS a, y.unit AS b, sum(x.v * y.v) / any_value(nx.norm * ny.norm) AS similarity FROM uc x JOIN uc y ON x.city = y.city AND x.unit < y.unit JOIN un nx ON nx.unit = x.unit JOIN un ny ON ny.unit = y.unit GROUP BY ALL)
"""


def profile_cosines(spark, d, by: str = "city") -> DataFrame:
    """Pairs a < b of units and the cosine of their masses over cities (or another column of rows)."""
    mass = unit_mass(spark, d).join(rows(spark, d).select("row_id", by), "row_id").groupBy("unit", by).agg(F.sum("v").alias("v"))
    return cosine_pairs(mass, "unit", by, "v").toDF("a", "b", "similarity")


@query(_COSINE + """, w AS (SELECT a, b, 1 - similarity AS d FROM cs UNION ALL SELECT b, a, 1 - similarity FROM cs), k AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY a ORDER BY d, b) <= 4),
s AS (SELECT a, max(d) AS s FROM k GROUP BY 1), e AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM k), g AS (SELECT e.a, e.b, exp(-w.d * w.d / (x.s * y.s + 1e-9)) AS w FROM e JOIN w ON w.a = e.a AND w.b = e.b JOIN s x ON x.a = e.a JOIN s y ON y.a = e.b)
SELECT a, b, round(w / (SELECT avg(w) FROM g WHERE w > 0), 6) AS weight FROM g""")
def local_scaled_graph(spark, d):
    """The four nearest of each unit by city profiles; a dictionary's items are few, its rows are summed first."""
    return ops.local_scaled_graph(profile_cosines(spark, d), 4).select("a", "b", r6("weight").alias("weight"))


@query(_COSINE + """, t AS (SELECT count(*) AS n, count(*) - CAST(ceil(0.9 * (count(*) - 1)) AS BIGINT) AS place FROM rows_),
o AS (SELECT unit, v, row_number() OVER (PARTITION BY unit ORDER BY v DESC) AS i FROM um), h AS (SELECT unit, greatest(coalesce(max(v) FILTER (WHERE i = place), 0), 1) AS threshold FROM o, t GROUP BY 1),
p AS (SELECT row_id, unit FROM um JOIN h USING (unit) WHERE v >= threshold), f AS (SELECT unit, count(*) AS c FROM p GROUP BY 1 HAVING count(*) BETWEEN 0.025 * (SELECT n FROM t) AND 0.2 * (SELECT n FROM t)),
q AS (SELECT x.unit AS a, y.unit AS b, count(*) AS overlap FROM p x JOIN p y ON x.row_id = y.row_id AND x.unit < y.unit GROUP BY ALL)
SELECT a, b, overlap, round(overlap - fa.c * fb.c / n, 6) AS excess FROM q JOIN f fa ON fa.unit = a JOIN f fb ON fb.unit = b JOIN cs USING (a, b), t WHERE overlap >= 3 AND overlap - fa.c * fb.c / n >= 0.25 AND similarity < 0.999 ORDER BY overlap - fa.c * fb.c / n DESC, a, b LIMIT 100""")
def pair_candidates(spark, d):
    """Pairs of units that are strong together more often than by chance and differ in profile: the 100 of largest excess (the limit is the feature)."""
    mass, n = unit_mass(spark, d), rows(spark, d).count()
    strong = mass.join(ops.higher_quantile_marks(mass, "unit", "v", n), "unit").where("v >= threshold").select("row_id", "unit")
    counts = association.supports(strong, "unit").toDF("unit", "n").where(F.col("n").between(0.025 * n, 0.2 * n))
    pairs = association.cooccurrence(strong, "row_id", "unit").select("a", "b", F.col("n").alias("overlap"))
    joined = pairs.join(counts.toDF("a", "na"), "a").join(counts.toDF("b", "nb"), "b").join(profile_cosines(spark, d), ["a", "b"])
    excess = F.col("overlap") - F.col("na") * F.col("nb") / F.lit(n)
    kept = joined.withColumn("excess", excess).where("overlap >= 3 AND excess >= 0.25 AND similarity < 0.999")
    return kept.orderBy(F.desc("excess"), "a", "b").limit(100).select("a", "b", "overlap", r6("excess").alias("excess"))


_GX = _COSINE + """, ux AS (SELECT unit, gx, sum(v) AS v FROM um JOIN rows_ USING (row_id) GROUP BY ALL), uxn AS (SELECT unit, sqrt(sum(v * v)) AS norm FROM ux GROUP BY 1),
xs AS (SELECT x.unit AS a, y.unit AS b, sum(x.v * y.v) / any_value(nx.norm * ny.norm) AS position FROM ux x JOIN ux y ON x.gx = y.gx AND x.unit < y.unit JOIN uxn nx ON nx.unit = x.unit JOIN uxn ny ON ny.unit = y.unit GROUP BY ALL)
"""


@query(_GX + """, pc AS (SELECT city, row_id, unit FROM um JOIN rows_ USING (row_id)), nc AS (SELECT city, unit, count(*) AS n FROM pc GROUP BY ALL), tc AS (SELECT city, count(*) AS t FROM rows_ GROUP BY 1),
ob AS (SELECT x.city, x.unit AS a, y.unit AS b, count(*) AS o FROM pc x JOIN pc y ON x.row_id = y.row_id AND x.unit < y.unit GROUP BY ALL),
ex AS (SELECT x.city, x.unit AS a, y.unit AS b, x.n * y.n / t AS e FROM nc x JOIN nc y ON x.city = y.city AND x.unit < y.unit JOIN tc ON tc.city = x.city),
ag AS (SELECT a, b, sum(coalesce(o, 0)) AS o, sum(e) AS e, count(*) FILTER (WHERE coalesce(o, 0) > e) / count(*) AS cp, count(*) FILTER (WHERE coalesce(o, 0) < e) / count(*) AS cn FROM ex LEFT JOIN ob USING (city, a, b) GROUP BY ALL),
pa AS (SELECT a, b, ln((o + 0.5) / (e + 0.5)) AS ll, (o - e) / sqrt(e) AS res, similarity AS role, position, cp, cn, 1 - exp(-e / 100) AS rel, e FROM ag JOIN cs USING (a, b) JOIN xs USING (a, b)),
rf AS (SELECT quantile_cont(role, 0.75) AS rf FROM pa), sc AS (SELECT *, greatest(ll, 0) * cp * rel AS s_and, greatest(-ll, 0) * role * sqrt(least(greatest(position, 0), 1)) * cn * rel AS s_or,
  ll > 0 AND res > 0.5 AND cp >= 0.4 AND e >= 3 AS c_and, ll < 0 AND res < -0.5 AND cn >= 0.4 AND role >= rf AND position >= 0.5 AND e >= 3 AS c_or FROM pa, rf),
fl AS (SELECT quantile_cont(s_and, 0.95) FILTER (WHERE c_and) AS fa, quantile_cont(s_or, 0.75) FILTER (WHERE c_or) AS fo FROM sc)
SELECT a, b, CASE WHEN c_and AND s_and >= fa THEN 'AND' WHEN c_or AND s_or >= fo THEN 'OR' ELSE 'UNRESOLVED' END AS relation, round(s_and, 6) AS and_score, round(s_or, 6) AS or_score FROM sc, fl""")
def relation_typing(spark, d):
    """AND and OR relations of units: occurrence against what each city's rates expect, role by city profile, position by column profile."""
    placed = unit_presence(spark, d).join(rows(spark, d).select("row_id", "city"), "row_id")
    n, t = placed.groupBy("city", "unit").agg(F.count("*").alias("n")), rows(spark, d).groupBy("city").agg(F.count("*").alias("t"))
    sets = placed.groupBy("city", "row_id").agg(F.array_sort(F.collect_list("unit")).alias("u"))
    first = sets.select("city", "u", F.posexplode("u").alias("i", "a"))
    observed = first.select("city", "a", F.explode(F.expr("slice(u, i + 2, size(u))")).alias("b")).groupBy("city", "a", "b").agg(F.count("*").alias("o"))
    expected = n.toDF("city", "a", "na").join(n.toDF("city", "b", "nb"), "city").where("a < b").join(t, "city").withColumn("e", F.col("na") * F.col("nb") / F.col("t"))
    joined = expected.join(observed, ["city", "a", "b"], "left").withColumn("o", F.coalesce("o", F.lit(0)))
    sums = joined.groupBy("a", "b").agg(F.sum("o").alias("o"), F.sum("e").alias("expected"), (F.count_if(F.col("o") > F.col("e")) / F.count("*")).alias("city_positive"), (F.count_if(F.col("o") < F.col("e")) / F.count("*")).alias("city_negative"))
    pairs = sums.withColumns({"log_lift": F.log((F.col("o") + 0.5) / (F.col("expected") + 0.5)), "residual": (F.col("o") - F.col("expected")) / F.sqrt("expected")})
    pairs = pairs.join(profile_cosines(spark, d).withColumnRenamed("similarity", "role"), ["a", "b"]).join(profile_cosines(spark, d, "gx").withColumnRenamed("similarity", "position"), ["a", "b"])
    found = ops.type_relations(pairs, least=3.0, residual=0.5, cities=0.4, position=0.5)
    return found.select("a", "b", "relation", r6("and_score").alias("and_score"), r6("or_score").alias("or_score"))


_CLUSTERS = ", cl AS (SELECT item, unit AS x, family AS y FROM dims), ct AS (SELECT x, y, count(*) AS n FROM cl GROUP BY ALL), nx AS (SELECT x, sum(n) AS nx FROM ct GROUP BY 1), ny AS (SELECT y, sum(n) AS ny FROM ct GROUP BY 1)\n"


@query(_CLUSTERS + "SELECT item, round(n / (nx + ny - n), 6) AS jaccard FROM cl JOIN ct USING (x, y) JOIN nx USING (x) JOIN ny USING (y)")
def cluster_jaccard(spark, d):
    """Parts: how far their two clusters (brand and type) agree."""
    return ops.cluster_jaccard(dims(spark, d), "item", "unit", "family").select("item", r6("jaccard").alias("jaccard"))


@query(_CLUSTERS + "SELECT y AS family, x AS unit, round(n / (nx + ny - n), 6) AS jaccard, round(n / ny, 6) AS purity, CAST(n AS BIGINT) AS shared, CAST(ny AS BIGINT) AS size FROM ct JOIN nx USING (x) JOIN ny USING (y) QUALIFY row_number() OVER (PARTITION BY y ORDER BY n / (nx + ny - n) DESC, n / ny DESC, x DESC) = 1")
def best_coarse(spark, d):
    return ops.best_coarse(dims(spark, d), "family", "unit").select("family", "unit", r6("jaccard").alias("jaccard"), r6("purity").alias("purity"), "shared", "size")


_NODES = """, nd AS (SELECT city, gx, row_id % 4 AS heading, unit, row_id, CAST(v AS DOUBLE) AS strength, 1 + row_id % 7 AS area FROM um JOIN rows_ USING (row_id))
"""


@query(_MASS + _NODES + """, a AS (SELECT * FROM nd QUALIFY row_number() OVER (PARTITION BY city, gx, heading, unit ORDER BY strength DESC, row_id) <= 2), b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY city, gx, unit ORDER BY strength / sqrt(area) DESC, row_id) <= 3),
c AS (SELECT *, row_number() OVER (PARTITION BY city, gx ORDER BY strength / sqrt(area) DESC, row_id, unit) AS k FROM b) SELECT city, gx, unit, row_id, CAST(k AS INTEGER) AS place_rank FROM c WHERE k <= 12""")
def capped_selection(spark, d):
    """Twelve nodes a column of cells, two a unit and heading, three a unit."""
    nodes = unit_mass(spark, d).join(rows(spark, d).select("row_id", "city", "gx"), "row_id").withColumns({"heading": F.col("row_id") % 4, "area": 1 + F.col("row_id") % 7, "key": F.struct("row_id", "unit")})
    found = ops.capped_selection(nodes, ["city", "gx"], "heading", "unit", "key", "v", "area")
    return found.select("city", "gx", "unit", "row_id", "place_rank")


@query("SELECT row_id, city, gx, CAST(k AS INTEGER) AS rank FROM (SELECT row_id, city, gx, row_number() OVER (PARTITION BY city, gx ORDER BY price DESC, row_id) AS k FROM rows_) WHERE k <= 50")
def scoped_topk(spark, d):
    """A budget of 50 activations for each panorama (here a column of cells), not for the batch."""
    return ranking.top_k(rows(spark, d), ["city", "gx"], [F.desc("price"), F.col("row_id")], 50).select("row_id", "city", "gx", "rank")


@query(""", w AS (SELECT city, item, CAST(sum(v) AS DOUBLE) AS w FROM acts JOIN rows_ USING (row_id) GROUP BY ALL), e AS (SELECT city, sum(w) * sum(w) / sum(w * w) AS effective FROM w GROUP BY 1),
s AS (SELECT city, unit AS label, sum(w * p_size) AS s FROM w JOIN dims USING (item) JOIN part ON p_partkey = item GROUP BY ALL) SELECT city, label, round(s / sum(s) OVER (PARTITION BY city), 6) AS share, round(effective, 4) AS effective FROM s JOIN e USING (city)""")
def weighted_profile(spark, d):
    weights = acts(spark, d).join(rows(spark, d).select("row_id", "city"), "row_id").groupBy("city", "item").agg(F.sum("v").cast("double").alias("w"))
    semantics = read_table(spark, d, "part").select(F.col("p_partkey").alias("item"), F.col("p_brand").alias("label"), F.col("p_size").alias("s"))
    return ops.weighted_profile(weights, semantics, "city", "item", "w", "label", "s").select("city", "label", r6("share").alias("share"), F.round("effective", 4).alias("effective"))


@query(_PRESENT + """, q AS (SELECT x.row_id, x.unit AS a, y.unit AS b FROM pr x JOIN pr y ON x.row_id = y.row_id AND x.unit < y.unit), f AS (SELECT a, b FROM q GROUP BY ALL ORDER BY count(*) DESC, a, b LIMIT 20),
m AS (SELECT DISTINCT row_id FROM q JOIN f USING (a, b)) SELECT city, count(*) AS n_rows, count(m.row_id) AS matched FROM rows_ LEFT JOIN m USING (row_id) GROUP BY 1""")
def union_coverage(spark, d):
    """Rows that hold any of the 20 most frequent pairs of units (the 20 are the pattern set, all rows are judged)."""
    present = unit_presence(spark, d)
    sets = present.groupBy("row_id").agg(F.array_sort(F.collect_list("unit")).alias("u")).select("row_id", "u", F.posexplode("u").alias("i", "a"))
    pairs = sets.select("row_id", "a", F.explode(F.expr("slice(u, i + 2, size(u))")).alias("b"))
    patterns = pairs.groupBy("a", "b").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "a", "b").limit(20)
    matched = pairs.join(F.broadcast(patterns), ["a", "b"], "left_semi").select("row_id").distinct().withColumn("hit", F.lit(1))
    return rows(spark, d).join(matched, "row_id", "left").groupBy("city").agg(F.count("*").alias("n_rows"), F.count("hit").alias("matched"))


@query("SELECT p_partkey AS item, concat_ws(',', CASE WHEN p_size > 40 THEN 'oversize' END, CASE WHEN p_type LIKE 'S%' THEN 'weak_family' END, CASE WHEN p_retailprice < 910 THEN 'low_value' END) AS flags, CASE WHEN p_size > 40 THEN 'oversize' WHEN p_type LIKE 'S%' THEN 'weak_family' WHEN p_retailprice < 910 THEN 'low_value' ELSE 'clean' END AS status FROM part", base=False)
def evidence_flags(spark, d):
    flags, status = ops.evidence_flags([("oversize", F.col("p_size") > 40), ("weak_family", F.col("p_type").startswith("S")), ("low_value", F.col("p_retailprice") < 910)], "clean")
    return read_table(spark, d, "part").select(F.col("p_partkey").alias("item"), flags.alias("flags"), status.alias("status"))


@query(", x AS (SELECT row_id, city, c_custkey, sha256('5:' || row_id) AS h FROM rows_ JOIN orders ON o_orderkey = row_id JOIN customer ON c_custkey = o_custkey), o AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY h, row_id) = 1) SELECT city, row_id FROM o QUALIFY row_number() OVER (PARTITION BY city ORDER BY h, row_id) <= 20")
def one_view_each(spark, d):
    """Twenty rows a city, one of each customer, in hash order (a sampling operator). A customer's first row is a partial aggregate, no sort."""
    owner = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), "o_custkey")
    keyed = rows(spark, d).select("row_id", "city").join(owner, "row_id").withColumn("h", F.sha2(F.concat(F.lit("5:"), F.col("row_id").cast("string")), 256))
    first = keyed.groupBy("city", "o_custkey").agg(F.min(F.struct("h", "row_id")).alias("m")).select("city", "m.*")
    return ranking.top_k(first, ["city"], [F.col("h"), F.col("row_id")], 20).select("city", "row_id")


@query(", c AS (SELECT DISTINCT city FROM rows_), r AS (SELECT city, row_number() OVER (ORDER BY sha256('11:' || city), city) AS k, count(*) OVER () AS n FROM c) SELECT city, CASE WHEN k <= round(0.65 * n) THEN 'discovery' ELSE 'validation' END AS split FROM r")
def city_share_split(spark, d):
    """Cities in hash order: the first 65 % for discovery. One row a city reaches the window."""
    cities = rows(spark, d).select("city").distinct().withColumn("h", F.sha2(F.concat(F.lit("11:"), F.col("city")), 256))
    ranked = cities.withColumns({"k": F.row_number().over(Window.orderBy("h", "city")), "n": F.count("*").over(Window.partitionBy())})
    return ranked.select("city", F.when(F.col("k") <= F.round(0.65 * F.col("n")), "discovery").otherwise("validation").alias("split"))


@query(_COSINE + """, cut AS (SELECT quantile_cont(similarity, 0.97) AS q FROM cs), l AS (SELECT a, b FROM cs, cut WHERE similarity >= q UNION SELECT b, a FROM cs, cut WHERE similarity >= q), st AS (SELECT unit, count(*) AS support FROM um GROUP BY 1),
r1 AS (SELECT unit AS n, unit AS m FROM st UNION SELECT a, b FROM l), r2 AS (SELECT DISTINCT x.n, y.m FROM r1 x JOIN r1 y ON x.m = y.n), r3 AS (SELECT DISTINCT x.n, y.m FROM r2 x JOIN r2 y ON x.m = y.n), r4 AS (SELECT DISTINCT x.n, y.m FROM r3 x JOIN r3 y ON x.m = y.n), r5 AS (SELECT DISTINCT x.n, y.m FROM r4 x JOIN r4 y ON x.m = y.n),
g AS (SELECT n AS unit, min(m) AS grp FROM r5 GROUP BY 1) SELECT unit, grp AS group_id, first_value(unit) OVER (PARTITION BY grp ORDER BY support DESC, unit) AS canonical FROM g JOIN st USING (unit)""")
def equivalence_groups(spark, d):
    """Units of nearly equal profile as groups, each with its canonical unit: most rows, then the smaller name."""
    pairs = profile_cosines(spark, d)
    cut = pairs.agg(F.percentile("similarity", F.lit(0.97)).alias("q"))
    ids = association.supports(unit_presence(spark, d), "unit").toDF("unit", "support")
    edges = pairs.crossJoin(F.broadcast(cut)).where("similarity >= q").select(F.col("a").alias("u"), F.col("b").alias("v"))
    groups = graph.components(edges)
    labelled = ids.join(groups.toDF("unit", "group_id"), "unit", "left").withColumn("group_id", F.coalesce("group_id", "unit"))
    canonical = labelled.groupBy("group_id").agg(F.min(F.struct(-F.col("support"), F.col("unit").alias("unit"))).alias("m")).select("group_id", F.col("m.unit").alias("canonical"))
    return labelled.join(canonical, "group_id").select("unit", "group_id", "canonical")


@query(""", p AS (SELECT city, gy * 0.0137 + 40.0031 AS lat, gx * 0.0171 - 0.3029 AS lon FROM rows_), m AS (SELECT city, greatest(cos(radians(median(lat))), 0.01) AS c FROM p GROUP BY 1)
SELECT city, CAST(floor(radians(lon) * 6371000.0 * c / 1000) AS BIGINT) AS east, CAST(floor(radians(lat) * 6371000.0 / 1000) AS BIGINT) AS north, count(*) AS n FROM p JOIN m USING (city) GROUP BY ALL""")
def local_cells(spark, d):
    """Rows by cell of a local grid of one kilometre, scaled at each city's median latitude (exact, from its distinct latitudes)."""
    places = rows(spark, d).select("city", (F.col("gy") * F.lit(0.0137) + F.lit(40.0031)).alias("lat"), (F.col("gx") * F.lit(0.0171) - F.lit(0.3029)).alias("lon"))
    middle = places.groupBy("city").agg(F.percentile("lat", F.lit(0.5)).alias("middle"))
    east, north = local_cell(F.col("lat"), F.col("lon"), F.col("middle"))
    return places.join(middle, "city").groupBy("city", east.alias("east"), north.alias("north")).agg(F.count("*").alias("n"))


@query(""", f(family, whole) AS (VALUES ('PROMO', 'passing family')), l(family, unit, single) AS (VALUES ('SMALL', 'Brand#3', 'movable'), ('SMALL', 'Brand#7', 'movable'), ('PROMO', 'Brand#3', 'movable'), ('LARGE', 'Brand#12', 'temporary'))
SELECT item, family, unit AS label, coalesce(whole, single) AS reason FROM dims LEFT JOIN f USING (family) LEFT JOIN l USING (family, unit)""")
def exclusion_reason(spark, d):
    """Parts with the reason that takes them out of the landscape, by type or by type and brand; null for those that stay."""
    families = spark.createDataFrame([("PROMO", "passing family")], "family string, reason string")
    labels = spark.createDataFrame([("SMALL", "Brand#3", "movable"), ("SMALL", "Brand#7", "movable"), ("PROMO", "Brand#3", "movable"), ("LARGE", "Brand#12", "temporary")], "family string, label string, reason string")
    parts = dims(spark, d).select("item", "family", F.col("unit").alias("label"))
    return ops.exclusion_reason(parts, families, labels).select("item", "family", "label", "reason")
