"""Typed relations of pairs, matches of clusterings, support screens, strongest examples and scaled neighbour graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grid_summary(profiles: DataFrame, group: str, x: str, y: str, item: str, value: str) -> DataFrame:
    """For each group of grid cells: cells, adjacent pairs, homogeneity (mean cosine of all pairs) and continuity (of adjacent ones).

    All pairs come from sums of unit vectors, (|sum u|^2 - n) / (n (n - 1)), so none is listed; a cell meets its right and upper
    neighbour by equi-joins. `profiles` has one row a cell and item; cells without mass have no row. Null where a group has no pair.
    """
    cell = [group, x, y]
    norms = profiles.groupBy(*cell).agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("_norm")).where("_norm > 0")
    units = profiles.join(norms, cell).select(*cell, item, (F.col(value) / F.col("_norm")).alias("_u"))
    n = norms.groupBy(group).agg(F.count("*").alias("cells"))
    square = units.groupBy(group, item).agg(F.sum("_u").alias("_s")).groupBy(group).agg(F.sum(F.col("_s") * F.col("_s")).alias("_square"))
    steps = F.explode(F.array(*(F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in ((1, 0), (0, 1)))))
    ahead = norms.select(*cell, steps.alias("_step")).select(group, (F.col(x) + F.col("_step.dx")).alias(x), (F.col(y) + F.col("_step.dy")).alias(y))
    edges = ahead.join(norms, cell).groupBy(group).agg(F.count("*").alias("edges"))
    moved = units.withColumn("_step", steps).select(group, (F.col(x) + F.col("_step.dx")).alias(x), (F.col(y) + F.col("_step.dy")).alias(y), item, F.col("_u").alias("_v"))
    local = moved.join(units, [*cell, item]).groupBy(group).agg(F.sum(F.col("_u") * F.col("_v")).alias("_local"))
    joined = n.join(square, group).join(edges, group, "left").join(local, group, "left")
    pairs = F.col("cells") * (F.col("cells") - 1)
    return joined.select(
        group, "cells", F.coalesce("edges", F.lit(0)).alias("edges"),
        F.when(pairs > 0, (F.col("_square") - F.col("cells")) / pairs).alias("homogeneity"),
        F.when(F.col("edges") > 0, F.coalesce("_local", F.lit(0.0)) / F.col("edges")).alias("continuity"),
    )


def row_atypicality(shares: DataFrame, scores: DataFrame, row: str, item: str, share: str, least: float) -> DataFrame:
    """Rows by their unlikely pairs: min of two shares (at least `least`) times the pair's score; best pair, maximum and mean of the top three.

    `scores` has a < b and a positive score. Pairs are made inside a row, at most the square of its items; missing ones count as 0 in
    the mean of three, and rows without a scored pair have no row.
    """
    kept = shares.where(F.col(share) >= least).groupBy(row).agg(F.array_sort(F.collect_list(F.struct(F.col(item).alias("i"), F.col(share).alias("s")))).alias("m"))
    first = kept.select(row, "m", F.posexplode("m").alias("k", "p"))
    pairs = first.select(row, F.col("p").alias("p"), F.explode(F.expr("slice(m, k + 2, size(m))")).alias("q"))
    joint = pairs.select(row, F.col("p.i").alias("a"), F.col("q.i").alias("b"), F.least("p.s", "q.s").alias("joint"))
    found = joint.join(scores, ["a", "b"]).select(row, "a", "b", (F.col("joint") * F.col("score")).alias("score"))
    ranked = found.withColumn("_k", F.row_number().over(Window.partitionBy(row).orderBy(F.desc("score"), "a", "b"))).where("_k <= 3")
    best = [F.max(F.when(F.col("_k") == 1, F.col(c))).alias(c) for c in ("a", "b")]
    return ranked.groupBy(row).agg(*best, F.max("score").alias("highest"), (F.sum("score") / 3).alias("top3_mean"))


def strongest_examples(scores: DataFrame, thresholds: DataFrame, patterns: DataFrame, rows: DataFrame, row: str, unit: str, score: str, group: str, block: list[Column], n: int) -> DataFrame:
    """For each pattern and group its n strongest rows, one a block; strength = min over the pattern's units of score / threshold.

    `patterns` has pattern and unit; a row needs every unit, each at its threshold or over. Ties: the smaller row.
    """
    sizes = patterns.groupBy("pattern").agg(F.count("*").alias("_size"))
    ratio = F.col(score) / F.col("threshold")
    hits = scores.join(thresholds, unit).where(ratio >= 1).join(patterns, unit).groupBy("pattern", row).agg(F.min(ratio).alias("strength"), F.count("*").alias("_n"))
    whole = hits.join(sizes, "pattern").where("_n = _size").select("pattern", row, "strength").join(rows, row)
    placed = whole.withColumn("_block", F.struct(*(b.alias(f"b{i}") for i, b in enumerate(block))))
    order = F.struct(F.col("strength"), -F.col(row))
    picks = placed.groupBy("pattern", group, "_block").agg(F.max_by(F.struct(row, "strength"), order).alias("_p")).select("pattern", group, "_p.*")
    ranked = picks.withColumn("place", F.row_number().over(Window.partitionBy("pattern", group).orderBy(F.desc("strength"), row)))
    return ranked.where(F.col("place") <= n)


def support_screen(positives: DataFrame, items: DataFrame, item: str, fixed: Column, y: Column, x: Column, least: int = 20, most: float = 0.7) -> DataFrame:
    """Screen of items by support: in the fixed rows where there is any, else in all; and whether the peaks crowd in one bin of 4 x 4.

    `positives`: one row a positive (row, item); y and x are 0 to 27 (7 positions a bin, further ones in the last).
    """
    bins = positives.groupBy(item, F.least(F.floor(y / 7), F.lit(3)).alias("_by"), F.least(F.floor(x / 7), F.lit(3)).alias("_bx")).agg(F.count("*").alias("_n"), F.count_if(fixed).alias("_f"))
    sums = bins.groupBy(item).agg(F.sum("_n").alias("_all"), F.sum("_f").alias("_fixed"), F.max("_n").alias("_top"))
    found = items.select(item).distinct().join(sums, item, "left").fillna(0, ["_all", "_fixed", "_top"])
    support = F.when(F.col("_fixed") > 0, F.col("_fixed")).otherwise(F.col("_all"))
    status = F.when(support == 0, "no_positive_activation").when(support < least, "insufficient_support").otherwise("reviewable")
    crowded = (F.col("_all") >= least) & (F.col("_top") / F.col("_all") >= most)
    scope = F.when(F.col("_fixed") > 0, "fixed_validation").otherwise("expanded_posthoc")
    return found.select(item, support.alias("support"), scope.alias("scope"), status.alias("status"), crowded.alias("position_review"))


def local_scaled_graph(similarities: DataFrame, k: int, epsilon: float = 1e-9) -> DataFrame:
    """Edges a < b of a symmetric k-nearest graph: exp(-d^2 / (s_a s_b + epsilon)) with d = 1 - similarity and s the distance to the
    k-th neighbour, divided by the mean of all positive weights. `similarities` has one row a pair a < b of a dictionary's items."""
    both = similarities.select("a", "b", (1 - F.col("similarity")).alias("d"))
    both = both.union(both.select("b", "a", "d"))
    near = both.withColumn("_k", F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))).where(F.col("_k") <= k)
    sigma = near.groupBy("a").agg(F.max("d").alias("s"))
    edges = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "d").groupBy("a", "b").agg(F.first("d").alias("d"))
    scaled = edges.join(sigma.withColumnRenamed("s", "sa"), "a").join(sigma.select(F.col("a").alias("b"), F.col("s").alias("sb")), "b")
    weights = scaled.select("a", "b", F.exp(-F.col("d") * F.col("d") / (F.col("sa") * F.col("sb") + epsilon)).alias("w"))
    mean = weights.where("w > 0").agg(F.avg("w").alias("_mean"))
    return weights.crossJoin(F.broadcast(mean)).select("a", "b", (F.col("w") / F.col("_mean")).alias("weight"))


def higher_quantile_marks(counts: DataFrame, item: str, value: str, rows: int, q: float = 0.9, floor: float = 1.0) -> DataFrame:
    """Each item's 'higher' quantile over `rows` rows, where rows that are not in `counts` are 0; at least `floor`.

    Works on the histogram of an item's distinct values, so no item's rows meet in one task.
    """
    place = rows - int(-(-q * (rows - 1) // 1))
    histogram = counts.groupBy(item, value).agg(F.count("*").alias("_n"))
    above = F.sum("_n").over(Window.partitionBy(item).orderBy(F.desc(value)))
    reached = histogram.withColumn("_above", above).groupBy(item).agg(F.max(F.when(F.col("_above") >= place, F.col(value))).alias("_v"))
    return reached.select(item, F.greatest(F.coalesce("_v", F.lit(0.0)), F.lit(floor)).alias("threshold"))


def type_relations(pairs: DataFrame, least: float = 25.0, residual: float = 5.0, cities: float = 0.6, position: float = 0.75, role_q: float = 0.75, and_q: float = 0.95, or_q: float = 0.75) -> DataFrame:
    """AND, OR or UNRESOLVED for each pair of `pairs`: a, b, log_lift, residual, role, position, city_positive, city_negative, expected.

    AND pairs occur together more than expected, OR pairs stand in for one another; each kind keeps its best scores from a quantile on.
    One row a pair of a dictionary's items; the floors are exact linear quantiles.
    """
    reliable = 1 - F.exp(-F.col("expected") / 100.0)
    and_score = F.greatest("log_lift", F.lit(0.0)) * F.col("city_positive") * reliable
    clipped = F.sqrt(F.least(F.greatest("position", F.lit(0.0)), F.lit(1.0)))
    or_score = F.greatest(-F.col("log_lift"), F.lit(0.0)) * F.col("role") * clipped * F.col("city_negative") * reliable
    floor = pairs.agg(F.percentile("role", F.lit(role_q)).alias("_role"))
    enough = F.col("expected") >= least
    as_and = (F.col("log_lift") > 0) & (F.col("residual") > residual) & (F.col("city_positive") >= cities) & enough
    as_or = (F.col("log_lift") < 0) & (F.col("residual") < -residual) & (F.col("city_negative") >= cities) & (F.col("role") >= F.col("_role")) & (F.col("position") >= position) & enough
    scored = pairs.crossJoin(F.broadcast(floor)).withColumns({"and_score": and_score, "or_score": or_score, "_and": as_and, "_or": as_or})
    floors = scored.agg(F.percentile(F.when(F.col("_and"), F.col("and_score")), F.lit(and_q)).alias("_af"), F.percentile(F.when(F.col("_or"), F.col("or_score")), F.lit(or_q)).alias("_of"))
    relation = F.when(F.col("_and") & (F.col("and_score") >= F.col("_af")), "AND").when(F.col("_or") & (F.col("or_score") >= F.col("_of")), "OR").otherwise("UNRESOLVED")
    return scored.crossJoin(F.broadcast(floors)).select("a", "b", relation.alias("relation"), "and_score", "or_score")


def _contingency(df: DataFrame, left: str, right: str) -> DataFrame:
    both = df.groupBy(F.col(left).alias("left"), F.col(right).alias("right")).agg(F.count("*").alias("both"))
    n_left, n_right = both.groupBy("left").agg(F.sum("both").alias("n_left")), both.groupBy("right").agg(F.sum("both").alias("n_right"))
    joined = both.join(n_left, "left").join(n_right, "right")
    return joined.withColumn("jaccard", F.col("both") / (F.col("n_left") + F.col("n_right") - F.col("both")))


def cluster_jaccard(df: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """For each item the Jaccard index of its two clusters, from the contingency table: no pair of items is made."""
    table = _contingency(df, left, right).select(F.col("left").alias(left), F.col("right").alias(right), "jaccard")
    return df.select(key, left, right).join(table, [left, right]).select(key, "jaccard")


def best_coarse(df: DataFrame, fine: str, coarse: str) -> DataFrame:
    """For each fine cluster the coarse one of highest (Jaccard, purity, name), with its size and what they share."""
    table = _contingency(df, fine, coarse).withColumn("purity", F.col("both") / F.col("n_left"))
    best = table.groupBy("left").agg(F.max(F.struct("jaccard", "purity", F.col("right").alias("c"), "both", F.col("n_left").alias("n"))).alias("m"))
    return best.select(F.col("left").alias(fine), F.col("m.c").alias(coarse), "m.jaccard", "m.purity", F.col("m.both").alias("shared"), F.col("m.n").alias("size"))


def capped_selection(nodes: DataFrame, place: list[str], view: str, family: str, key: str, strength: str, area: str, per_view: int = 2, per_family: int = 3, n: int = 12) -> DataFrame:
    """At most `per_view` strongest nodes a family and view, then by strength / sqrt(area) at most `per_family` a family and n a place."""
    density = F.col(strength) / F.sqrt(area)
    first = nodes.withColumn("_k", F.row_number().over(Window.partitionBy(*place, view, family).orderBy(F.desc(strength), key))).where(F.col("_k") <= per_view)
    second = first.withColumn("_k", F.row_number().over(Window.partitionBy(*place, family).orderBy(F.desc(density), key))).where(F.col("_k") <= per_family)
    return second.withColumn("place_rank", F.row_number().over(Window.partitionBy(*place).orderBy(F.desc(density), key))).where(F.col("place_rank") <= n).drop("_k")


def weighted_profile(weights: DataFrame, semantics: DataFrame, group: str, item: str, weight: str, label: str, value: str) -> DataFrame:
    """Each group's profile over labels, sum(w s) / sum(w) brought to sum 1, and the effective number of items (sum w)^2 / sum w^2."""
    totals = weights.groupBy(group).agg((F.sum(weight) * F.sum(weight) / F.sum(F.col(weight) * F.col(weight))).alias("effective"))
    sums = weights.join(semantics, item).groupBy(group, label).agg(F.sum(F.col(weight) * F.col(value)).alias("_s"))
    return sums.withColumn("share", F.col("_s") / F.sum("_s").over(Window.partitionBy(group))).drop("_s").join(totals, group)


def evidence_flags(rules: list[tuple[str, Column]], otherwise: str) -> tuple[Column, Column]:
    """The names of all rules that hold, in order, joined by commas, and the first of them as the status; a null condition does not hold."""
    held = F.array_compact(F.array(*(F.when(condition, F.lit(name)) for name, condition in rules)))
    return F.array_join(held, ","), F.coalesce(*(F.when(condition, F.lit(name)) for name, condition in rules), F.lit(otherwise))


def exclusion_reason(df: DataFrame, families: DataFrame, labels: DataFrame) -> DataFrame:
    """`df` with `reason`: that of its family in `families` (family, reason), else of its family and label in `labels` (family, label,
    reason), else null (kept). Each key stands once in a rule table."""
    whole, single = families.withColumnRenamed("reason", "_whole"), labels.withColumnRenamed("reason", "_single")
    joined = df.join(whole, "family", "left").join(single, ["family", "label"], "left")
    return joined.withColumn("reason", F.coalesce("_whole", "_single")).drop("_whole", "_single")
