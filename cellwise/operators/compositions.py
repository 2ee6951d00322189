"""Compositions of rows and cells, best members of groups, presence by thresholds, supports by bitmaps, and status across cities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits used of each BIGINT word of a bitmap; the sign stays free.
WORD_BITS = 62


def valid_location(lat: Column, lon: Column) -> Column:
    """True where both are numbers on the globe; false for nulls, NaN and infinities."""
    on_globe = lat.between(-90, 90) & lon.between(-180, 180) & ~F.isnan(lat) & ~F.isnan(lon)
    return F.coalesce(on_globe, F.lit(False))


def best_members(acts: DataFrame, groups: DataFrame, row: str, item: str, value: str, group: str) -> DataFrame:
    """The item of highest positive value of each (row, group); of equal ones the smallest. One partial aggregate, no sort."""
    best = F.max_by(item, F.struct(F.col(value), -F.col(item))).alias(item)
    return acts.where(F.col(value) > 0).join(groups.select(item, group), item).groupBy(row, group).agg(best, F.max(value).alias(value))


def threshold_richness(counts: DataFrame, row: str, n: str, thresholds: list[int]) -> DataFrame:
    """For each row the number of groups whose count `n` reaches each threshold (columns richness_<t>)."""
    return counts.groupBy(row).agg(*(F.count_if(F.col(n) >= t).alias(f"richness_{t}") for t in thresholds))


def conserved(shares: DataFrame, row: str, share: str, tolerance: float = 1e-6) -> DataFrame:
    """Each row's sum of shares, and whether it is 1 within the tolerance."""
    return shares.groupBy(row).agg(F.sum(share).alias("total")).withColumn("holds", F.abs(F.col("total") - 1) <= tolerance)


def positive_quantile_presence(peaks: DataFrame, discovery: Column, group: str, value: str, q: float = 0.8, least: int = 20) -> DataFrame:
    """Rows of `peaks` at or over their group's linear quantile of positive discovery values; groups with fewer than `least` have none.

    The exact percentile keeps one counter for each distinct value of a group, merged on the map side.
    """
    train = peaks.where(discovery & (F.col(value) > 0))
    marks = train.groupBy(group).agg(F.percentile(value, F.lit(q)).alias("threshold"), F.count("*").alias("_n")).where(F.col("_n") >= least).drop("_n")
    return peaks.join(marks, group).where((F.col(value) > 0) & (F.col(value) >= F.col("threshold")))


def bitmap_supports(presence: DataFrame, row: str, group: str) -> DataFrame:
    """Rows that hold both groups, for all pairs a < b: words of 62 rows as bits, pairs within a word, AND and popcount.

    `row` is a non-negative integer. A word meets at most the square of its groups, never of its rows.
    """
    words = presence.groupBy(F.expr(f"{row} div {WORD_BITS}").alias("word"), group).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST({row} % {WORD_BITS} AS INT))")).alias("bits"))
    left, right = words.select("word", F.col(group).alias("a"), F.col("bits").alias("x")), words.select("word", F.col(group).alias("b"), F.col("bits").alias("y"))
    hits = left.join(right, "word").where("a < b").select("a", "b", F.bit_count(F.col("x").bitwiseAND(F.col("y"))).cast("long").alias("n"))
    return hits.groupBy("a", "b").agg(F.sum("n").alias("support")).where("support > 0")


def cross_city_status(patterns: DataFrame, pattern: list[str], city: str, replicated: str) -> DataFrame:
    """`patterns` (one row a city and pattern) with cities_replicated and cross_city_status: unreplicated, single_city_detected or shared."""
    counts = patterns.groupBy(*pattern).agg(F.count_if(replicated).alias("cities_replicated"))
    status = F.when(~F.col(replicated), "unreplicated").when(F.col("cities_replicated") == 1, "single_city_detected").otherwise("shared")
    return patterns.join(counts, pattern).withColumn("cross_city_status", status)


def parents_by_lift(profiles: DataFrame, child: str, parent: str, mass: str, power: float = 0.5, least: float = 0.01, secondary: float = 0.12, near: float = 0.65) -> DataFrame:
    """Primary and secondary parents of each child: score = share * max(lift, 1) ** power.

    A share below `least` scores -1; secondary parents have a share of `secondary` and `near` times the primary's score. Ties: the
    smaller name is primary. `profiles` has one row a child and parent; a pair without mass is no candidate.
    """
    by_child, all_mass = Window.partitionBy(child), profiles.agg(F.sum(mass).alias("_all"))
    general = profiles.groupBy(parent).agg(F.sum(mass).alias("_mass")).crossJoin(all_mass).select(parent, (F.col("_mass") / F.col("_all")).alias("_general"))
    shares = profiles.withColumn("share", F.col(mass) / F.sum(mass).over(by_child)).join(general, parent)
    lifted = shares.withColumn("lift", (F.col("share") + 1e-6) / (F.col("_general") + 1e-6))
    scored = lifted.withColumn("score", F.when(F.col("share") < least, -1.0).otherwise(F.col("share") * F.pow(F.greatest("lift", F.lit(1.0)), power)))
    first = F.row_number().over(by_child.orderBy(F.desc("score"), parent)) == 1
    ranked = scored.withColumns({"_first": first, "_top": F.max("score").over(by_child)})
    kept = ranked.where(F.col("_first") | ((F.col("share") >= secondary) & (F.col("score") >= near * F.col("_top"))))
    return kept.select(child, parent, F.when(F.col("_first"), "primary").otherwise("secondary").alias("membership"), "share", "lift", "score")
