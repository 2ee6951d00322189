"""Report-level queries: grids, profiles, similarities, ladders and contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellwise.functions.geometry import web_mercator
from cellwise.operators import contracts, profiles, ranking, sampling
from cellwise.plans.bindings import SQL, acts, dims, rows, unit_presence
from cellwise.plans.core import city_units, family_shares, r6
from cellwise.plans.statistics import pairs
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
_CU = ", cu AS (SELECT city, unit, sum(v) AS v FROM acts JOIN rows_ USING (row_id) JOIN dims USING (item) GROUP BY ALL), cs AS (SELECT city, unit, v / sum(v) OVER (PARTITION BY city) AS p FROM cu)"
_FP = ", fp AS (SELECT DISTINCT row_id, family FROM acts JOIN dims USING (item))"


def family_presence(spark, d) -> DataFrame:
    return acts(spark, d).join(dims(spark, d).select("item", "family"), "item").select("row_id", "family").distinct()


@query(_FP + ", g AS (SELECT city, CAST(floor((gx + 0.5) / 3) AS BIGINT) AS x, CAST(floor((gy + 0.5) / 3) AS BIGINT) AS y, family, count(*) AS n, count(DISTINCT gx * 1000 + gy) AS cells FROM fp JOIN rows_ USING (row_id) GROUP BY ALL) SELECT city, x, y, family, n, cells, round(n / sum(n) OVER (PARTITION BY city, x, y), 6) AS grid_share, round(n / sum(n) OVER (PARTITION BY city), 6) AS city_share FROM g")
def grid_reaggregation(spark, d):
    """Presence on a coarser grid, with shares of the grid cell and of the city."""
    placed = family_presence(spark, d).join(rows(spark, d), "row_id")
    g = placed.groupBy("city", *(F.floor((F.col(c) + 0.5) / 3).alias(n) for c, n in (("gx", "x"), ("gy", "y"))), "family").agg(F.count("*").alias("n"), F.countDistinct(F.col("gx") * 1000 + F.col("gy")).alias("cells"))
    share = lambda *by: r6(F.col("n") / F.sum("n").over(Window.partitionBy(*by)))
    return g.select("city", "x", "y", "family", "n", "cells", share("city", "x", "y").alias("grid_share"), share("city").alias("city_share"))


@query(", m AS (SELECT city, min(gx) AS a, max(gx) AS b, min(gy) AS c, max(gy) AS d FROM rows_ GROUP BY 1) SELECT city, CAST(least(floor((gx - a) / greatest(b - a, 1) * 8), 7) AS BIGINT) AS x, CAST(least(floor((gy - c) / greatest(d - c, 1) * 8), 7) AS BIGINT) AS y, count(*) AS n FROM rows_ JOIN m USING (city) GROUP BY ALL")
def normalized_grid(spark, d):
    """A fixed 8 by 8 grid between each city's outermost positions."""
    r = rows(spark, d)
    m = r.groupBy("city").agg(F.min("gx").alias("a"), F.max("gx").alias("b"), F.min("gy").alias("c"), F.max("gy").alias("d"))
    bin_of = lambda v, lo, hi: F.least(F.floor((F.col(v) - F.col(lo)) / F.greatest(F.col(hi) - F.col(lo), F.lit(1)) * 8), F.lit(7)).cast("long")
    return r.join(F.broadcast(m), "city").groupBy("city", bin_of("gx", "a", "b").alias("x"), bin_of("gy", "c", "d").alias("y")).agg(F.count("*").alias("n"))


@query(_CU + ", s AS (SELECT unit, city, p / sum(p) OVER (PARTITION BY unit) AS s FROM cs) SELECT unit, round(1 / sum(s * s), 6) AS effective_cities, count(*) AS positive_cities, max_by(city, (s, city)) AS top_city, round(max(s), 6) AS top_share FROM s GROUP BY 1")
def feature_breadth(spark, d):
    return profiles.breadth(city_units(spark, d), "unit", "city", "share").select("unit", r6("effective").alias("effective_cities"), F.col("positive").alias("positive_cities"), F.col("top").alias("top_city"), r6("top_share").alias("top_share"))


@query(_CU + ", n AS (SELECT city, sqrt(sum(p * p)) AS n FROM cs GROUP BY 1) SELECT x.city AS a, y.city AS b, round(sum(x.p * y.p) / any_value(m.n) / any_value(k.n), 6) AS similarity FROM cs x JOIN cs y ON x.unit = y.unit AND x.city < y.city JOIN n m ON m.city = x.city JOIN n k ON k.city = y.city GROUP BY ALL")
def city_similarity(spark, d):
    return profiles.cosine_pairs(city_units(spark, d), "city", "unit", "share").select("a", "b", r6("similarity").alias("similarity"))


@query(_CU + ", m AS (SELECT unit, sum(v) / (SELECT sum(v) FROM cu) AS q FROM cu GROUP BY 1) SELECT city, round((sum(p * log2(p / ((p + q) / 2))) + sum(q * log2(q / ((p + q) / 2))) + 1 - sum(q)) / 2, 6) AS divergence FROM cs JOIN m USING (unit) GROUP BY 1")
def profile_divergence(spark, d):
    """Jensen-Shannon divergence of each city from the profile of all."""
    u = city_units(spark, d)
    return profiles.divergence_from_all(u, "city", "unit", "v").select("city", r6("divergence").alias("divergence"))


@query(_FP + " SELECT row_id, bool_or(family = 'ECONOMY') AS a, count(*) AS richness FROM fp GROUP BY 1 HAVING count(*) >= 2")
def row_family_matrix(spark, d):
    return family_presence(spark, d).groupBy("row_id").agg(F.bool_or(F.col("family") == "ECONOMY").alias("a"), F.count("*").alias("richness")).where("richness >= 2")


@query(", t AS (SELECT row_id, sum(v) AS t FROM acts GROUP BY 1) SELECT row_id, item FROM acts JOIN t USING (row_id) WHERE v >= 0.4 * t")
def share_occurrence(spark, d):
    """Items with at least 40 % of their row."""
    total = F.sum("v").over(Window.partitionBy("row_id"))
    return acts(spark, d).withColumn("t", total).where("v >= 0.4 * t").select("row_id", "item")


@query(", p AS (SELECT row_id, gy * 0.1 + 40 AS lat, gx * 0.1 AS lon FROM rows_) SELECT CAST(floor(radians(lon) * 6378137.0 / 50000) AS BIGINT) AS x, CAST(floor(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137.0 / 50000) AS BIGINT) AS y, count(*) AS n FROM p GROUP BY ALL HAVING count(*) >= 30")
def mercator_grid(spark, d):
    x, y = web_mercator(F.col("gy") * 0.1 + 40, F.col("gx") * 0.1)
    return rows(spark, d).groupBy(F.floor(x / 50_000).alias("x"), F.floor(y / 50_000).alias("y")).agg(F.count("*").alias("n")).where("n >= 30")


@query(_UP + """, s AS (SELECT unit, count(*) AS k FROM up GROUP BY 1), pr AS (SELECT x.unit AS a, y.unit AS b, count(*) AS n FROM up x JOIN up y ON x.row_id = y.row_id AND x.unit < y.unit GROUP BY ALL),
e AS (SELECT a, b, n / (sa.k + sb.k - n) AS w FROM pr JOIN s sa ON sa.unit = a JOIN s sb ON sb.unit = b), l AS (SELECT a AS u, a, b, w FROM e UNION ALL SELECT b, a, b, w FROM e)
SELECT DISTINCT a, b, round(w, 6) AS weight FROM (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY u ORDER BY w DESC, a, b) <= 3)""")
def top_edges(spark, d):
    """The union of every unit's three strongest edges."""
    e = pairs(spark, d).select("a", "b", (F.col("n") / (F.col("n_a") + F.col("n_b") - F.col("n"))).alias("w"))
    ends = e.withColumn("u", F.explode(F.array("a", "b")))
    return ranking.top_k(ends, ["u"], [F.desc("w"), F.col("a"), F.col("b")], 3).select("a", "b", r6("w").alias("weight")).distinct()


@query(_CU + ", x AS (SELECT unit, CAST(('0x' || substr(sha256(city), 1, 8)) AS BIGINT) % 2 AS half, avg(p) AS p FROM cs GROUP BY ALL) SELECT count(*) AS units, round(corr(a.p, b.p), 6) AS correlation FROM x a JOIN x b ON a.unit = b.unit AND a.half = 0 AND b.half = 1")
def half_correlation(spark, d):
    """Correlation of the mean profiles of two halves of the cities."""
    u = sampling.split_groups(city_units(spark, d), "city", 2)
    both = u.groupBy("unit").agg(F.avg(F.when(~F.col("discovery"), F.col("share"))).alias("x"), F.avg(F.when(F.col("discovery"), F.col("share"))).alias("y"))
    return both.where("x IS NOT NULL AND y IS NOT NULL").agg(F.count("*").alias("units"), r6(F.corr("x", "y")).alias("correlation"))


@query("SELECT label, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, label) - 1 AS INTEGER) AS new_label FROM embeddings GROUP BY 1", base=False)
def relabel_by_size(spark, d):
    return profiles.relabel(read_table(spark, d, "embeddings"), "label").select("label", "n", "new_label")


@query("WITH s AS (SELECT CAST(date_trunc('day', ts) AS DATE) AS day, sum(value) AS v FROM events GROUP BY 1), f AS (SELECT *, v >= (SELECT avg(v) FROM s) AS ok FROM s), g AS (SELECT *, row_number() OVER (ORDER BY day) - row_number() OVER (PARTITION BY ok ORDER BY day) AS g FROM f) SELECT CAST(min(day) AS VARCHAR) AS first_day, CAST(max(day) AS VARCHAR) AS last_day, count(*) AS days FROM g WHERE ok GROUP BY g HAVING count(*) >= 2", base=False)
def plateaus(spark, d):
    """Runs of at least two days with more than the mean."""
    day = read_table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.sum("value").alias("v"))
    mean = day.agg(F.avg("v").alias("m"))
    return profiles.runs(day.join(F.broadcast(mean)).withColumn("ok", F.col("v") >= F.col("m")), "day", "ok", 2).select(F.col("first").cast("string").alias("first_day"), F.col("last").cast("string").alias("last_day"), F.col("n").alias("days"))


@query(", g AS (SELECT item, count(DISTINCT city) AS n FROM acts JOIN rows_ USING (row_id) GROUP BY 1), k AS (SELECT unnest(range(1, 26)) AS cities) SELECT cities, count(item) AS items FROM k LEFT JOIN g ON n = cities GROUP BY 1")
def shared_by_cities(spark, d):
    """How many items occur in exactly so many cities, zeros included."""
    g = acts(spark, d).join(rows(spark, d).select("row_id", "city"), "row_id").groupBy("item").agg(F.countDistinct("city").alias("cities"))
    return spark.range(1, 26).withColumnRenamed("id", "cities").join(g.groupBy("cities").agg(F.count("*").alias("items")), "cities", "left").na.fill(0)


@query(", x AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), u AS (SELECT label, list_transform(e, lambda z: z / sqrt(list_dot_product(e, e))) AS e FROM x), p AS (SELECT label, unnest(e) AS z, unnest(range(len(e))) AS i FROM u), s AS (SELECT label, i, sum(z) AS s FROM p GROUP BY ALL), n AS (SELECT label, count(*) AS n FROM u GROUP BY 1) SELECT label, round((sum(s * s) - any_value(n)) / (any_value(n) * (any_value(n) - 1)), 6) AS agreement FROM s JOIN n USING (label) GROUP BY 1")
def pair_agreement(spark, d):
    """Mean cosine of all pairs of a label, from the sum vector."""
    return profiles.mean_pair_cosine(read_table(spark, d, "embeddings"), "label", "embedding").select("label", r6("agreement").alias("agreement"))


@query("WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1), t AS (SELECT sum(n) AS t, count(*) AS k FROM c) SELECT round(sum((n - t / k) * (n - t / k) / (t / k)), 6) AS chi_square, round(sqrt(sum((n - t / k) * (n - t / k) / (t / k)) / any_value(t) / (any_value(k) - 1)), 6) AS effect FROM c, t", base=False)
def chi_square_effect(spark, d):
    counts = read_table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return profiles.uniform_effect(counts, "n").select(r6("chi_square").alias("chi_square"), r6("effect").alias("effect"))


@query(", x AS (SELECT city, price - avg(price) OVER (PARTITION BY city) AS y, gx - avg(gx) OVER (PARTITION BY city) AS x FROM rows_) SELECT round(sum(x * y) / sum(x * x), 4) AS slope, round(pow(sum(x * y), 2) / sum(x * x) / sum(y * y), 8) AS r2 FROM x")
def demeaned_regression(spark, d):
    return profiles.within_regression(rows(spark, d), "city", "gx", "price").select(F.round("slope", 4).alias("slope"), F.round("r2", 8).alias("r2"))


@query(_CU + " SELECT city, CASE WHEN max(p) >= 0.06 THEN 'dominant' WHEN count_if(p >= 0.03) >= 2 THEN 'combination' ELSE 'dead' END AS role FROM cs GROUP BY 1")
def basis_roles(spark, d):
    u = city_units(spark, d).groupBy("city").agg(F.max("share").alias("m"), F.count_if(F.col("share") >= 0.03).alias("n"))
    return u.select("city", F.when(F.col("m") >= 0.06, "dominant").when(F.col("n") >= 2, "combination").otherwise("dead").alias("role"))


@query("WITH c AS (SELECT o_orderpriority AS source, o_orderstatus AS target, count(*) AS n FROM orders GROUP BY ALL) SELECT *, CAST(sum(n) OVER (PARTITION BY source) AS BIGINT) AS of_source FROM c", base=False)
def flow_counts(spark, d):
    """Flows between two labellings; the flows of a source add up to it."""
    flows = read_table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("source"), F.col("o_orderstatus").alias("target")).agg(F.count("*").alias("n"))
    return flows.withColumn("of_source", F.sum("n").over(Window.partitionBy("source")))


@query("SELECT p_type AS family, p_brand AS unit, count(*) AS items, min(p_partkey) AS first_item, array_to_string(list_sort(list_distinct(list(CAST(p_size AS VARCHAR)))), ',') AS labels FROM part GROUP BY ALL", base=False)
def category_graph(spark, d):
    return read_table(spark, d, "part").groupBy(F.col("p_type").alias("family"), F.col("p_brand").alias("unit")).agg(F.count("*").alias("items"), F.min("p_partkey").alias("first_item"), F.array_join(F.array_sort(F.collect_set(F.col("p_size").cast("string"))), ",").alias("labels"))


@query("SELECT user_id, event_id, lead(event_id) OVER w AS next_id, round(date_diff('millisecond', ts, lead(ts) OVER w) / 1000.0, 3) AS seconds FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)", base=False)
def chain_steps(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    step = (F.lead(at).over(w) - at) / 1000
    return read_table(spark, d, "events").select("user_id", "event_id", F.lead("event_id").over(w).alias("next_id"), F.round(step, 3).alias("seconds"))


@query(", r AS (SELECT city, row_id, row_number() OVER (PARTITION BY city ORDER BY row_id) - 1 AS i FROM rows_), c AS (SELECT city, dense_rank() OVER (ORDER BY city) - 1 AS k FROM (SELECT DISTINCT city FROM rows_)) SELECT row_id, row_number() OVER (ORDER BY i // 64, k, i) - 1 AS position FROM r JOIN c USING (city)")
def stripe_interleave(spark, d):
    """Cities dealt out in stripes of 64 rows: positions from counts per stripe, so that no window holds all rows."""
    return sampling.interleave(rows(spark, d), "city", "row_id", 64).select("row_id", "position")


@query(", k AS (SELECT row_id, row_number() OVER (PARTITION BY city ORDER BY row_id) - 1 AS source_position, price >= 20000 AS kept, city FROM rows_) SELECT row_id, source_position, row_number() OVER (PARTITION BY city ORDER BY row_id) - 1 AS position FROM k WHERE kept")
def filtered_positions(spark, d):
    """Positions before and after a filter."""
    w = Window.partitionBy("city").orderBy("row_id")
    both = rows(spark, d).select("row_id", "city", "price", (F.row_number().over(w) - 1).cast("long").alias("source_position")).where("price >= 20000")
    return both.select("row_id", "source_position", (F.row_number().over(w) - 1).cast("long").alias("position"))


@query("SELECT s_suppkey, regexp_replace(lower(s_name), '[^a-z0-9]', '', 'g') AS name, regexp_replace('pano' || s_suppkey || '_' || (s_suppkey % 4) * 90, '_(0|90|180|270)$', '') AS key_ FROM supplier", base=False)
def name_normalisation(spark, d):
    s = read_table(spark, d, "supplier")
    path = F.concat(F.lit("pano"), "s_suppkey", F.lit("_"), (F.col("s_suppkey") % 4) * 90)
    return s.select("s_suppkey", F.regexp_replace(F.lower("s_name"), "[^a-z0-9]", "").alias("name"), F.regexp_replace(path, "_(0|90|180|270)$", "").alias("key_"))


@query("SELECT event_id, CAST(event_id % 512 AS BIGINT) AS dim, CAST(event_id // 512 AS BIGINT) AS patch, CAST(event_id // (512 * 7) AS BIGINT) AS heading FROM events", base=False)
def flat_index_decode(spark, d):
    e = F.col("event_id")
    return read_table(spark, d, "events").select("event_id", F.pmod(e, F.lit(512)).alias("dim"), F.expr("event_id div 512").alias("patch"), F.expr("event_id div 3584").alias("heading"))


@query("SELECT count(*) AS n, count_if(k > 1) AS repeated, count_if(o_orderkey IS NULL) AS orphans FROM (SELECT l_orderkey, l_linenumber, count(*) AS k FROM lineitem GROUP BY ALL) LEFT JOIN orders ON l_orderkey = o_orderkey", base=False)
def key_contract(spark, d):
    """Keys, keys that repeat, and keys without a parent."""
    return contracts.key_report(read_table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], read_table(spark, d, "orders").withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey")


@query(_FP + ", j AS (SELECT family, city, row_id FROM fp JOIN rows_ USING (row_id)) SELECT family, city, row_id FROM j QUALIFY row_number() OVER (PARTITION BY family, city ORDER BY sha256('3:' || row_id)) <= 2")
def quota_per_stratum(spark, d):
    from cellwise.functions.hashing import hash_order

    placed = family_presence(spark, d).join(rows(spark, d).select("row_id", "city"), "row_id")
    return ranking.top_k(placed, ["family", "city"], [hash_order(3, F.col("row_id"))], 2).select("family", "city", "row_id")


@query(None)
def weighted_sample(spark, d):
    """Twenty rows of each city, likelier with a higher price."""
    return sampling.weighted_without_replacement(rows(spark, d), ["city"], "row_id", "price", 20).select("city", "row_id", "rank")


@query(None)
def greedy_cover(spark, d):
    """Up to ten units that cover the most rows."""
    return spark.createDataFrame(sampling.greedy_cover(unit_presence(spark, d), "unit", "row_id", 10), "unit string, new_rows long")
