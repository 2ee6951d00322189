"""Co-occurrence and association statistics over long tables (row, item)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def benjamini_hochberg(df: DataFrame, p: str, family: list[str] | None = None) -> DataFrame:
    """`q`: of p * n / rank the smallest from here upwards, 1 at most; ties share the largest rank's value."""
    family = family or []
    w = Window.partitionBy(*family)
    ranked = df.withColumns({"_r": F.row_number().over(w.orderBy(p)), "_n": F.count(p).over(w)})
    running = F.min(F.col(p) * F.col("_n") / F.col("_r")).over(w.orderBy("_r").rowsBetween(0, Window.unboundedFollowing))
    return ranked.withColumn("_q", F.least(running, F.lit(1.0))).withColumn("q", F.min("_q").over(Window.partitionBy(*family, p))).drop("_r", "_n", "_q")


def cooccurrence(presence: DataFrame, row: str, item: str, weight: Column | None = None) -> DataFrame:
    """Pairs a < b of items that share a row: n rows, and their weight. The table is joined with itself on the row, so rows are
    expected to hold few items each; (row, item) must be distinct."""
    weight = F.lit(1.0) if weight is None else weight
    left = presence.select(row, F.col(item).alias("a"), weight.alias("_w"))
    right = presence.select(row, F.col(item).alias("b"))
    return left.join(right, row).where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), F.sum("_w").alias("weight"))


def supports(presence: DataFrame, item: str) -> DataFrame:
    return presence.groupBy(item).agg(F.count("*").alias("support"))


def pair_table(presence: DataFrame, row: str, item: str, rows: DataFrame) -> DataFrame:
    """Co-occurrence with supports of both items (n_a, n_b) and the number of rows (total)."""
    s = supports(presence, item)
    total = rows.agg(F.count("*").alias("total"))
    pairs = cooccurrence(presence, row, item).drop("weight")
    pairs = pairs.join(s.select(F.col(item).alias("a"), F.col("support").alias("n_a")), "a").join(s.select(F.col(item).alias("b"), F.col("support").alias("n_b")), "b")
    return pairs.join(F.broadcast(total))


def jaccard_ppmi(pairs: DataFrame, least: int = 1) -> DataFrame:
    """`jaccard` and `ppmi` (log2, 0 below `least` shared rows or for a negative value)."""
    n, a, b, t = (F.col(c).cast("double") for c in ("n", "n_a", "n_b", "total"))
    pmi = F.log2((n / t + 1e-12) / (a / t * b / t + 1e-12))
    return pairs.withColumns({"jaccard": n / (a + b - n), "ppmi": F.when(F.col("n") >= least, F.greatest(pmi, F.lit(0.0))).otherwise(0.0)})


def residuals(pairs: DataFrame) -> DataFrame:
    """expected, Pearson residual, adjusted residual and smoothed log lift of each pair."""
    n, a, b, t = (F.col(c).cast("double") for c in ("n", "n_a", "n_b", "total"))
    e = a * b / t
    return pairs.withColumns({"expected": e, "pearson": (n - e) / F.sqrt(e), "adjusted": (n - e) / F.nullif(F.sqrt(e * (1 - a / t) * (1 - b / t)), F.lit(0.0)), "log_lift": F.log((n + 0.5) / (e + 0.5))})


def group_versus_rest(counts: DataFrame, group: str, item: str) -> DataFrame:
    """Log odds of an item in a group against all others (+.5 in each cell), its error and z. counts: group, item, n (rows with it), size (rows of the group)."""
    sizes = counts.select(group, "size").distinct().agg(F.sum("size").alias("all"))
    total = Window.partitionBy(item)
    rows = counts.withColumn("of_item", F.sum("n").over(total)).join(F.broadcast(sizes))
    a, b = F.col("n") + 0.5, F.col("size") - F.col("n") + 0.5
    c = F.col("of_item") - F.col("n") + 0.5
    d = F.col("all") - F.col("size") - (F.col("of_item") - F.col("n")) + 0.5
    return rows.withColumns({"log_odds": F.log(a * d / (b * c)), "error": F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)}).withColumn("z", F.col("log_odds") / F.col("error"))


def conditioned_expectation(presence: DataFrame, group: str, row: str, item: str, rows: DataFrame, least: float = 5.0) -> DataFrame:
    """Pairs with observed rows, expected ones if items were independent within each group, the log lift, and how often groups expecting `least` lie above and below."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("size"))
    s = presence.groupBy(group, item).agg(F.count("*").alias("k"))
    seen = presence.select(group, row, F.col(item).alias("a")).join(presence.select(group, row, F.col(item).alias("b")), [group, row]).where("a < b").groupBy(group, "a", "b").agg(F.count("*").alias("n"))
    a, b = s.select(group, F.col(item).alias("a"), F.col("k").alias("ka")), s.select(group, F.col(item).alias("b"), F.col("k").alias("kb"))
    each = a.join(b, group).where("a < b").join(sizes, group).join(seen, [group, "a", "b"], "left").withColumns({"n": F.coalesce("n", F.lit(0)), "e": F.col("ka") * F.col("kb") / F.col("size")})
    sound = F.col("e") >= least
    out = each.groupBy("a", "b").agg(F.sum("n").alias("observed"), F.sum("e").alias("expected"), F.sum((sound & (F.col("n") > F.col("e"))).cast("long")).alias("above"), F.sum((sound & (F.col("n") < F.col("e"))).cast("long")).alias("below"), F.sum(sound.cast("long")).alias("groups"))
    return out.withColumn("log_lift", F.log((F.col("observed") + 0.5) / (F.col("expected") + 0.5)))


def entropy(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Entropy in bits of the normalised values of each group, effective number 2^H, richness, and entropy over its largest possible value."""
    p = F.col(value) / F.sum(value).over(Window.partitionBy(*groups))
    h = df.where(F.col(value) > 0).withColumn("_p", p).groupBy(*groups).agg((-F.sum(F.col("_p") * F.log2("_p"))).alias("entropy"), F.count("*").alias("richness"))
    return h.withColumns({"effective": F.pow(F.lit(2.0), "entropy"), "evenness": F.when(F.col("richness") > 1, F.col("entropy") / F.log2(F.col("richness").cast("double"))).otherwise(0.0)})


def jensen_shannon(profiles: DataFrame, group: str, item: str, value: str) -> DataFrame:
    """Jensen-Shannon distance (root of bits) of all pairs a < b of groups; groups are few, items many: one join on the item, and the
    part of items that only one of both has follows from the shares that they don't share."""
    p = profiles.withColumn("_p", F.col(value) / F.sum(value).over(Window.partitionBy(group))).where("_p > 0")
    left, right = p.select(F.col(group).alias("a"), item, F.col("_p").alias("x")), p.select(F.col(group).alias("b"), item, F.col("_p").alias("y"))
    m = (F.col("x") + F.col("y")) / 2
    both = left.join(right, item).where("a < b").groupBy("a", "b").agg(F.sum(F.col("x") * F.log2(F.col("x") / m) + F.col("y") * F.log2(F.col("y") / m)).alias("k"), F.sum(F.col("x") + F.col("y")).alias("s"))
    names = p.select(group).distinct()
    pairs = names.select(F.col(group).alias("a")).join(names.select(F.col(group).alias("b")), F.col("a") < F.col("b"))
    d = (F.coalesce("k", F.lit(0.0)) + 2 - F.coalesce("s", F.lit(0.0))) / 2
    return pairs.join(both, ["a", "b"], "left").select("a", "b", F.sqrt(F.greatest(d, F.lit(0.0))).alias("distance"))


def transitions(edges: DataFrame, source: str, target: str) -> DataFrame:
    """Row-normalised transition shares of a list of steps."""
    counts = edges.groupBy(source, target).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(source)))


def morans_i(values: DataFrame, edges: DataFrame, node: str, value: str) -> DataFrame:
    """Moran's I over a list of directed edges (u, v) of weight 1, with the number of nodes and its expectation."""
    stats = F.broadcast(values.agg(F.avg(value).alias("_m"), F.count("*").alias("nodes"), F.var_pop(value).alias("_v")))
    z = values.join(stats).select(node, (F.col(value) - F.col("_m")).alias("_z"))
    pairs = edges.join(z.select(F.col(node).alias("u"), F.col("_z").alias("zu")), "u").join(z.select(F.col(node).alias("v"), F.col("_z").alias("zv")), "v")
    s = pairs.agg(F.sum(F.col("zu") * F.col("zv")).alias("c"), F.count("*").alias("edges"))
    return s.join(stats).select("nodes", "edges", (F.col("c") / F.col("edges") / F.col("_v")).alias("morans_i"), (-1 / (F.col("nodes") - 1)).alias("expected"))


def prevalence_spectrum(presence: DataFrame, group: str, item: str, classes: list[tuple[int, str]]) -> DataFrame:
    """How many items occur in how many groups, with the class of that number (lower bound, name), ascending bounds."""
    spread = presence.select(group, item).distinct().groupBy(item).agg(F.count("*").alias("groups"))
    name = F.lit(classes[0][1])
    for bound, label in classes[1:]:
        name = F.when(F.col("groups") >= bound, label).otherwise(name)
    return spread.groupBy("groups").agg(F.count("*").alias("items")).withColumn("class", name)


def marker_lift(profiles: DataFrame, group: str, item: str, share: str, n: int = 5) -> DataFrame:
    """The n items of each group whose share most exceeds, as a ratio, the mean share over all groups; absent ones count as 0."""
    groups = F.broadcast(profiles.select(group).distinct().agg(F.count("*").alias("_g")))
    mean = profiles.groupBy(item).agg(F.sum(share).alias("_t")).join(groups).select(item, (F.col("_t") / F.col("_g")).alias("_m"))
    lifted = profiles.join(mean, item).withColumn("lift", F.col(share) / F.col("_m"))
    return lifted.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("lift"), item))).where(F.col("rank") <= n).drop("_m")


def covered_expectation(counts: DataFrame, block: str, row: str, unit: str, rows: DataFrame) -> DataFrame:
    """Pairs a < b of units: rows expected to have both if units were independent within blocks, and those observed."""
    return conditioned_expectation(counts, block, row, unit, rows, 0.0).select("a", "b", "observed", "expected", (F.col("observed") / F.col("expected")).alias("lift"))
