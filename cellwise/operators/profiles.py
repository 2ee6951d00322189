"""Profiles of groups over items, and small statistics on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellwise.functions.arrays import unit


def breadth(df: DataFrame, item: str, group: str, value: str) -> DataFrame:
    """Of each item's shares over groups: effective number 1 / sum s^2, positive groups, the top group and its share."""
    s = df.where(F.col(value) > 0).withColumn("_s", F.col(value) / F.sum(value).over(Window.partitionBy(item)))
    return s.groupBy(item).agg((1 / F.sum(F.col("_s") * F.col("_s"))).alias("effective"), F.count("*").alias("positive"), F.max_by(group, F.struct("_s", group)).alias("top"), F.max("_s").alias("top_share"))


def cosine_pairs(df: DataFrame, group: str, item: str, value: str) -> DataFrame:
    """Cosine of all pairs a < b of groups that share an item; groups are few."""
    length = df.groupBy(group).agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("_n"))
    u = df.join(F.broadcast(length), group).select(group, item, (F.col(value) / F.col("_n")).alias("_u"))
    both = u.select(F.col(group).alias("a"), item, F.col("_u").alias("x")).join(u.select(F.col(group).alias("b"), item, F.col("_u").alias("y")), item).where("a < b")
    return both.groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("similarity"))


def divergence_from_all(df: DataFrame, group: str, item: str, value: str) -> DataFrame:
    """Jensen-Shannon divergence in bits of each group's profile from that of all groups together."""
    total = df.groupBy(item).agg(F.sum(value).alias("_t"))
    q = total.select(item, (F.col("_t") / F.sum("_t").over(Window.partitionBy())).alias("q"))
    p = df.withColumn("p", F.col(value) / F.sum(value).over(Window.partitionBy(group))).where("p > 0").join(q, item)
    m = (F.col("p") + F.col("q")) / 2
    s = p.groupBy(group).agg(F.sum(F.col("p") * F.log2(F.col("p") / m) + F.col("q") * F.log2(F.col("q") / m)).alias("k"), F.sum("q").alias("s"))
    return s.select(group, ((F.col("k") + 1 - F.col("s")) / 2).alias("divergence"))


def relabel(df: DataFrame, label: str) -> DataFrame:
    """Labels renumbered from 0 by size; ties by label."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    return counts.withColumn("new_label", F.row_number().over(Window.orderBy(F.desc("n"), label)) - 1)


def runs(df: DataFrame, order: str, flag: str, least: int) -> DataFrame:
    """Runs of at least `least` consecutive rows with a true flag: first, last, n."""
    w = Window.orderBy(order)
    island = F.row_number().over(w) - F.row_number().over(Window.partitionBy(flag).orderBy(order))
    return df.withColumn("_i", island).where(F.col(flag)).groupBy("_i").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).where(F.col("n") >= least).drop("_i")


def mean_pair_cosine(df: DataFrame, group: str, vector: str) -> DataFrame:
    """Mean cosine of all pairs of a group: (|sum of unit vectors|^2 - n) / (n (n - 1)), without pairs; null below two vectors."""
    parts = df.select(group, F.posexplode(unit(F.col(vector))).alias("_i", "_x")).groupBy(group, "_i").agg(F.sum("_x").alias("_s"), F.count("*").alias("_n"))
    n = F.max("_n")
    return parts.groupBy(group).agg(((F.sum(F.col("_s") * F.col("_s")) - n) / F.nullif(n * (n - 1), F.lit(0))).alias("agreement"))


def uniform_effect(counts: DataFrame, n: str) -> DataFrame:
    """Chi-square of counts against equal ones, and Cramer's V."""
    s = counts.agg(F.sum(n).alias("t"), F.count("*").alias("k"), F.sum(F.col(n).cast("double") * F.col(n)).alias("q"))
    chi = F.col("q") * F.col("k") / F.col("t") - F.col("t")
    return s.select(chi.alias("chi_square"), F.sqrt(chi / F.col("t") / F.nullif(F.col("k") - 1, F.lit(0))).alias("effect"))


def within_regression(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """Slope and R^2 of y on x after both lose their group's mean."""
    means = df.groupBy(group).agg(F.avg(x).alias("_mx"), F.avg(y).alias("_my"))
    c = df.join(means, group).select((F.col(x) - F.col("_mx")).alias("a"), (F.col(y) - F.col("_my")).alias("b"))
    s = c.agg(F.sum(F.col("a") * F.col("b")).alias("ab"), F.sum(F.col("a") * F.col("a")).alias("aa"), F.sum(F.col("b") * F.col("b")).alias("bb"))
    return s.select((F.col("ab") / F.col("aa")).alias("slope"), (F.col("ab") * F.col("ab") / F.col("aa") / F.col("bb")).alias("r2"))
