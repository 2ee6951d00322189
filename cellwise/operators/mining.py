"""Frequent combinations: thresholds, unit assignment, level-wise search and pruning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwise.operators.aggregates import weighted_quantile
from cellwise.session import stored


def calibrate(scores: DataFrame, discovery: str, unit: str, score: str, weight: str, q: float, floor: float) -> DataFrame:
    """A threshold for each unit from the discovery rows only: the weighted quantile of positive scores, `floor` at least."""
    found = weighted_quantile(scores.where(F.col(discovery)), [unit], score, weight, q)
    return found.withColumn("threshold", F.greatest("threshold", F.lit(floor)))


def assign(scores: DataFrame, thresholds: DataFrame, row: str, unit: str, score: str) -> DataFrame:
    """The unit of each row with the largest score over threshold (ties: smallest unit); rows where no ratio reaches 1 are left out."""
    ratio = scores.join(F.broadcast(thresholds), unit).withColumn("ratio", F.col(score) / F.col("threshold"))
    best = ratio.groupBy(row).agg(F.max("ratio").alias("ratio"))
    return ratio.join(best, [row, "ratio"]).where("ratio >= 1").groupBy(row).agg(F.min(unit).alias(unit), F.max("ratio").alias("ratio"))


def frequent_sets(presence: DataFrame, row: str, item: str, least: int, most_items: int, groups: list[tuple[str, int]] | None = None, family: str | None = None) -> DataFrame:
    """Item sets (`items`, ascending; size; support) with at least `least` rows and, for each (column, n) in groups, n distinct values of it.

    Level by level: sets that share all but the last item are joined, sets with an infrequent subset are dropped by semi-joins,
    support is counted by extending the rows of the smaller sets, which are kept in the shared folder. With `family`,
    a set has one item of a family at most. presence: distinct (row, item) with the columns of groups and family.
    """
    groups = groups or []
    extra = [g for g, _ in groups]
    counts = [F.count("*").alias("support"), *(F.countDistinct(g).alias(f"_{g}") for g in extra)]
    passes = reduce(lambda x, y: x & y, [F.col("support") >= least, *(F.col(f"_{g}") >= n for g, n in groups)])
    base = presence.select(row, item, *extra, *([family] if family else [])).distinct()
    kind = (lambda d: F.array(F.col(family))) if family else (lambda d: F.array().cast("array<string>"))
    rows = base.select(row, *extra, F.array(item).alias("items"), kind(base).alias("kinds"))
    levels: list[DataFrame] = []
    single = stored(rows.groupBy("items").agg(*counts).where(passes), "sets")
    levels.append(single)
    good = single.select(F.element_at("items", 1).alias(item))
    base = stored(base.join(good, item, "left_semi"), "presence")
    rows = base.select(row, *extra, F.array(item).alias("items"), kind(base).alias("kinds"))
    for size in range(2, most_items + 1):
        before = levels[-1].select("items")
        prefix = lambda d, last: d.select(F.slice("items", 1, size - 2).alias("p"), F.element_at("items", -1).alias(last))
        grown = prefix(before, "x").join(prefix(before, "y"), "p").where("x < y").select(F.concat("p", F.array("x", "y")).alias("items"))
        for out in range(1, size - 1):
            part = F.concat(F.slice("items", 1, out - 1), F.slice("items", out + 1, size - out))
            grown = grown.withColumn("part", part).join(before.withColumnRenamed("items", "part"), "part", "left_semi").drop("part")
        more = base.select(row, F.col(item).alias("_next"), *([F.col(family).alias("_kind")] if family else []))
        wide = rows.join(more, row).where(F.col("_next") > F.element_at("items", -1))
        if family:
            wide = wide.where(~F.array_contains("kinds", F.col("_kind")))
        wide = wide.select(row, *extra, F.concat("items", F.array("_next")).alias("items"), (F.concat("kinds", F.array("_kind")) if family else F.col("kinds")).alias("kinds"))
        rows = stored(wide.join(grown, "items", "left_semi"), "rows")
        level = stored(rows.groupBy("items").agg(*counts).where(passes), "sets")
        if level.isEmpty():
            break
        levels.append(level)
    return reduce(DataFrame.union, levels).select("items", F.size("items").alias("size"), "support")


def prune_near_closed(sets: DataFrame, keep: float = 0.9) -> DataFrame:
    """Sets without a strict superset that has at least `keep` of their support."""
    subset = sets.select(F.col("items").alias("small"), F.col("support").alias("n"), F.explode("items").alias("x"))
    large = sets.select(F.col("items").alias("large"), F.col("support").alias("m"), F.explode("items").alias("x"))
    pairs = subset.join(large, "x").where("size(large) > size(small) AND m >= n * {}".format(keep)).groupBy("small", "large").agg(F.count("*").alias("common"))
    redundant = pairs.where("common = size(small)").select(F.col("small").alias("items")).distinct()
    return sets.join(redundant, "items", "left_anti")


def rule_lift(presence: DataFrame, row: str, item: str, rows: DataFrame, joint: int, lift: float) -> DataFrame:
    """Pairs with at least `joint` rows and that lift, with their z = (observed - expected) / sqrt(expected)."""
    from cellwise.operators.association import pair_table

    e = F.col("n_a") * F.col("n_b") / F.col("total")
    pairs = pair_table(presence, row, item, rows).withColumns({"lift": F.col("n") / e, "z": (F.col("n") - e) / F.sqrt(e)})
    return pairs.where((F.col("n") >= joint) & (F.col("lift") >= lift))
