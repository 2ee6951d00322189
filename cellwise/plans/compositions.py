"""Queries over compositions, best members, presence, bitmaps and status across cities."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cellwise.operators import compositions as ops
from cellwise.plans.bindings import SQL, acts, dims, rows, unit_presence
from cellwise.plans.core import family_shares, r6
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


_FAMILY = """, fam AS (SELECT row_id, family, sum(v) AS fv FROM acts JOIN dims USING (item) GROUP BY ALL),
sh AS (SELECT row_id, family, fv / sum(fv) OVER (PARTITION BY row_id) AS share FROM fam)
"""


@query("SELECT c_nationkey AS nation, count(*) AS n, count(*) FILTER (WHERE c_acctbal / 100 BETWEEN -5 AND 90 AND c_custkey % 400 - 200 BETWEEN -180 AND 180) AS valid FROM customer GROUP BY 1", base=False)
def valid_locations(spark, d):
    """Customers whose balance / 100 and key, read as latitude (from 5 degrees south) and longitude, are valid; the others are counted too."""
    places = read_table(spark, d, "customer").select("c_nationkey", (F.col("c_acctbal") / 100).cast("double").alias("lat"), (F.col("c_custkey") % 400 - 200).cast("double").alias("lon"))
    valid = ops.valid_location(F.col("lat"), F.col("lon")) & (F.col("lat") >= -5)
    return places.groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n"), F.count_if(valid).alias("valid"))


@query(", x AS (SELECT row_id, unit, item, v, row_number() OVER (PARTITION BY row_id, unit ORDER BY v DESC, item) AS k FROM acts JOIN dims USING (item) WHERE v > 0) SELECT row_id, unit, item, v FROM x WHERE k = 1")
def group_best_member(spark, d):
    return ops.best_members(acts(spark, d), dims(spark, d), "row_id", "item", "v", "unit").select("row_id", "unit", "item", "v")


@query(", n AS (SELECT row_id, family, sum(v) AS n FROM acts JOIN dims USING (item) GROUP BY ALL) SELECT row_id, count(*) FILTER (WHERE n >= 1) AS richness_1, count(*) FILTER (WHERE n >= 10) AS richness_10, count(*) FILTER (WHERE n >= 25) AS richness_25, count(*) FILTER (WHERE n >= 40) AS richness_40 FROM n GROUP BY 1")
def threshold_richness(spark, d):
    counts = acts(spark, d).join(dims(spark, d), "item").groupBy("row_id", "family").agg(F.sum("v").alias("n"))
    return ops.threshold_richness(counts, "row_id", "n", [1, 10, 25, 40])


@query(_FAMILY + ", t AS (SELECT row_id, abs(sum(share) - 1) <= 1e-6 AS holds FROM sh GROUP BY 1) SELECT city, count(*) AS n_rows, count(*) FILTER (WHERE NOT holds) AS broken FROM t JOIN rows_ USING (row_id) GROUP BY 1")
def partition_conservation(spark, d):
    """Rows by city whose family shares do not add up to one."""
    held = ops.conserved(family_shares(spark, d), "row_id", "share")
    return held.join(rows(spark, d), "row_id").groupBy("city").agg(F.count("*").alias("n_rows"), F.count_if(~F.col("holds")).alias("broken"))


@query(_FAMILY + """, r AS (SELECT row_id, sum(share) FILTER (WHERE family LIKE 'S%') AS s, sum(share) FILTER (WHERE family LIKE 'P%') AS p FROM sh GROUP BY 1)
SELECT city, gx, gy, count(*) AS n_rows, round(avg(coalesce(s, 0)), 6) AS s_share, round(avg(coalesce(p, 0)), 6) AS p_share, round(greatest(0, 1 - avg(coalesce(s, 0)) - avg(coalesce(p, 0))), 6) AS unclassified FROM r JOIN rows_ USING (row_id) GROUP BY ALL""")
def cell_composition(spark, d):
    """Mean shares of two classes of families in each cell, and what is left for no class."""
    classes = family_shares(spark, d).groupBy("row_id").agg(*(F.sum(F.when(F.col("family").startswith(c), F.col("share")).otherwise(0.0)).alias(c) for c in "SP"))
    cells = classes.join(rows(spark, d), "row_id").groupBy("city", "gx", "gy").agg(F.count("*").alias("n_rows"), F.avg("S").alias("s"), F.avg("P").alias("p"))
    return cells.select("city", "gx", "gy", "n_rows", r6("s").alias("s_share"), r6("p").alias("p_share"), r6(F.greatest(F.lit(0.0), 1 - F.col("s") - F.col("p"))).alias("unclassified"))


@query(""", pk AS (SELECT row_id, unit, max(v) AS peak FROM acts JOIN dims USING (item) GROUP BY ALL),
m AS (SELECT unit, quantile_cont(peak, 0.8) AS threshold FROM pk WHERE row_id % 3 <> 0 AND peak > 0 GROUP BY 1 HAVING count(*) >= 20)
SELECT unit, threshold, count(*) AS present FROM pk JOIN m USING (unit) WHERE peak > 0 AND peak >= threshold GROUP BY ALL""")
def presence_by_quantile(spark, d):
    """Presence of units over the 80 % quantile of the discovery rows' positive peaks; two thirds of the rows are discovery, all are judged."""
    peaks = acts(spark, d).join(dims(spark, d), "item").groupBy("row_id", "unit").agg(F.max("v").cast("double").alias("peak"))
    found = ops.positive_quantile_presence(peaks, F.col("row_id") % 3 != 0, "unit", "peak")
    return found.groupBy("unit", "threshold").agg(F.count("*").alias("present"))


_PRESENT = ", pr AS (SELECT DISTINCT row_id, unit FROM acts JOIN dims USING (item))\n"


@query(_PRESENT + "SELECT x.unit AS a, y.unit AS b, count(*) AS support FROM pr x JOIN pr y ON x.row_id = y.row_id AND x.unit < y.unit GROUP BY ALL")
def bitmap_support(spark, d):
    return ops.bitmap_supports(unit_presence(spark, d), "row_id", "unit")


_CITY_PAIRS = _PRESENT + """, c AS (SELECT city, row_id, row_id % 2 = 0 AS held, unit FROM pr JOIN rows_ USING (row_id)),
q AS (SELECT x.city, x.unit AS a, y.unit AS b, count(*) FILTER (WHERE NOT x.held) AS discovery, count(*) FILTER (WHERE x.held) AS holdout FROM c x JOIN c y ON x.row_id = y.row_id AND x.unit < y.unit GROUP BY ALL)
"""


def _city_pairs(spark, d):
    placed = unit_presence(spark, d).join(rows(spark, d).select("row_id", "city"), "row_id")
    sets = placed.groupBy("city", "row_id").agg(F.array_sort(F.collect_list("unit")).alias("u"))
    pairs = sets.select("city", (F.col("row_id") % 2 == 0).alias("held"), F.posexplode("u").alias("i", "a"), "u").select("city", "held", "a", F.explode(F.expr("slice(u, i + 2, size(u))")).alias("b"))
    return pairs.groupBy("city", "a", "b").agg(F.count_if(~F.col("held")).alias("discovery"), F.count_if("held").alias("holdout"))


@query(_CITY_PAIRS + """, s AS (SELECT *, holdout >= 2 AS replicated FROM q WHERE discovery >= 2), n AS (SELECT a, b, count(*) FILTER (WHERE replicated) AS cities_replicated FROM s GROUP BY ALL)
SELECT s.*, cities_replicated, CASE WHEN NOT replicated THEN 'unreplicated' WHEN cities_replicated = 1 THEN 'single_city_detected' ELSE 'shared' END AS cross_city_status FROM s JOIN n USING (a, b)""")
def cross_city_status(spark, d):
    """Pairs of units that a city's discovery rows hold twice: whether its held-out rows do, and in how many cities they do."""
    found = _city_pairs(spark, d).where("discovery >= 2").withColumn("replicated", F.col("holdout") >= 2)
    return ops.cross_city_status(found, ["a", "b"], "city", "replicated")


@query(_CITY_PAIRS + """, n AS (SELECT city, count(*) AS n FROM rows_ GROUP BY 1), k AS (SELECT count(*) AS k FROM n)
SELECT a, b, sum(discovery + holdout) AS support, count(*) AS cities, round(sum((discovery + holdout) / n.n) / any_value(k), 6) AS balanced_prevalence FROM q JOIN n USING (city), k GROUP BY ALL""")
def combination_prevalence(spark, d):
    """Pairs of units with their support and their rate averaged over all cities, each city counting alike."""
    sizes = rows(spark, d).groupBy("city").agg(F.count("*").alias("n"))
    both = F.col("discovery") + F.col("holdout")
    rates = _city_pairs(spark, d).join(sizes, "city").groupBy("a", "b").agg(F.sum(both).alias("support"), F.count("*").alias("cities"), F.sum(both / F.col("n")).alias("s"))
    return rates.crossJoin(sizes.agg(F.count("*").alias("k"))).select("a", "b", "support", "cities", r6(F.col("s") / F.col("k")).alias("balanced_prevalence"))


@query(""", m AS (SELECT label, unit, sum(v) AS mass FROM acts JOIN (SELECT item, unit, family AS label FROM dims) USING (item) GROUP BY ALL),
g AS (SELECT unit, sum(mass) / (SELECT sum(mass) FROM m) AS general FROM m GROUP BY 1), s AS (SELECT *, mass / sum(mass) OVER (PARTITION BY label) AS share FROM m JOIN g USING (unit)),
l AS (SELECT *, (share + 1e-6) / (general + 1e-6) AS lift FROM s), c AS (SELECT *, CASE WHEN share < 0.01 THEN -1 ELSE share * sqrt(greatest(lift, 1)) END AS score FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, unit) AS k, max(score) OVER (PARTITION BY label) AS top FROM c)
SELECT label, unit, CASE WHEN k = 1 THEN 'primary' ELSE 'secondary' END AS membership, round(share, 6) AS share, round(lift, 6) AS lift, round(score, 6) AS score FROM r WHERE k = 1 OR (share >= 0.12 AND score >= 0.65 * top)""")
def semantic_parents(spark, d):
    """Units as parents of families by share and lift."""
    parts = dims(spark, d).select("item", "unit", F.col("family").alias("label"))
    mass = acts(spark, d).join(parts, "item").groupBy("label", "unit").agg(F.sum("v").cast("double").alias("mass"))
    found = ops.parents_by_lift(mass, "label", "unit", "mass")
    return found.select("label", "unit", "membership", *(r6(c).alias(c) for c in ("share", "lift", "score")))


@query(", x AS (SELECT row_id, city, row_number() OVER (PARTITION BY city ORDER BY sha256('7:' || row_id), row_id) AS rn FROM rows_) SELECT row_id, city, CAST(rn AS INTEGER) AS rn FROM x ORDER BY x.rn, city LIMIT 120")
def round_robin_pilot(spark, d):
    """A pilot of 120 rows, one of each city in turn, in hash order. The limit is the feature; each city sends at most 120 rows on."""
    by_city = Window.partitionBy("city").orderBy(F.sha2(F.concat(F.lit("7:"), F.col("row_id").cast("string")), 256), "row_id")
    first = rows(spark, d).select("row_id", "city").withColumn("rn", F.row_number().over(by_city)).where("rn <= 120")
    return first.orderBy("rn", "city").limit(120)
