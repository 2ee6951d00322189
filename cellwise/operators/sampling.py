"""Deterministic samples, splits and weights: every draw is an order by hash, so results do not depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellwise.functions.hashing import hash_fraction, hash_modulo, hash_order
from cellwise.session import forget, stored


def top_by_hash(df: DataFrame, groups: list[str], key: str, n: int, seed: int = 42) -> DataFrame:
    """Of each group the n distinct keys with the lowest hash; of equal hashes the larger key first. The rank filter runs before the shuffle too."""
    order = Window.partitionBy(*groups).orderBy(hash_order(seed, F.col(key)), F.desc(key))
    return df.dropDuplicates([*groups, key]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def split_groups(df: DataFrame, group: str, n: int = 3) -> DataFrame:
    """`discovery`: false for the groups whose hash is divisible by n."""
    return df.withColumn("discovery", hash_modulo(F.col(group), n) != 0)


def split_blocks(df: DataFrame, key: Column, seed: int = 42, fraction: float = 0.2) -> DataFrame:
    """`validation`: blocks whose hash fraction is below `fraction`."""
    return df.withColumn("validation", hash_fraction(F.concat_ws("/", F.lit(str(seed)), key)) < fraction)


def three_way_blocks(df: DataFrame, group: str, block: str, seed: int = 42) -> DataFrame:
    """`split` by hash-sorted blocks of each group: 70 % train, 15 % dev (one block at least), the rest test."""
    blocks = df.select(group, block).distinct()
    w = Window.partitionBy(group)
    blocks = blocks.withColumns({"r": F.row_number().over(w.orderBy(hash_order(seed, F.col(group), F.col(block)))), "n": F.count("*").over(w)})
    train, dev = F.floor(F.col("n") * 0.7), F.greatest(F.lit(1), F.floor(F.col("n") * 0.15))
    label = F.when(F.col("r") <= train, "train").when(F.col("r") <= train + dev, "dev").otherwise("test")
    return df.join(blocks.select(group, block, label.alias("split")), [group, block])


def folds(df: DataFrame, group: str, n: int, seed: int = 42) -> DataFrame:
    """`fold`: groups in hash order, dealt round."""
    groups = df.select(group).distinct().withColumn("fold", F.pmod(F.row_number().over(Window.orderBy(hash_order(seed, F.col(group)))) - 1, F.lit(n)))
    return df.join(groups, group)


def cell_weights(df: DataFrame, group: str, cell: list[str]) -> DataFrame:
    """`weight`: equal for the cells of a group, and for the rows of a cell; a group's weights add up to 1."""
    per_cell = df.groupBy(group, *cell).agg(F.count("*").alias("_n"))
    cells = per_cell.groupBy(group).agg(F.count("*").alias("_cells"))
    return df.join(per_cell.join(cells, group), [group, *cell]).withColumn("weight", 1 / (F.col("_n") * F.col("_cells"))).drop("_n", "_cells")


def group_weights(df: DataFrame, group: str) -> DataFrame:
    """`weight` = N / (groups * rows of the group), so that groups weigh the same and the mean weight is 1."""
    counts = df.groupBy(group).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"), F.count("*").alias("_groups"))
    return df.join(counts, group).join(F.broadcast(total)).withColumn("weight", F.col("_all") / (F.col("_groups") * F.col("_n"))).drop("_n", "_all", "_groups")


def weighted_without_replacement(df: DataFrame, groups: list[str], key: str, weight: str, n: int, seed: int = 42) -> DataFrame:
    """n rows of each group, likelier with larger weight: order by -ln(u) / weight with u from the key's hash."""
    u = F.greatest(hash_fraction(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), F.lit(1e-300))
    order = Window.partitionBy(*groups).orderBy(-F.log(u) / F.col(weight), F.col(key))
    return df.where(F.col(weight) > 0).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def rank_bands(df: DataFrame, group: str, city: str, value: str, key: str, edges: list[int], each: int) -> DataFrame:
    """Up to `each` rows of every rank band (1..edges[0], ...) of a group, going round its cities."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(value), key))).where(F.col("rank") <= edges[-1])
    band = F.lit(len(edges))
    for i in reversed(range(len(edges))):
        band = F.when(F.col("rank") <= edges[i], i).otherwise(band)
    ranked = ranked.withColumn("band", band)
    ranked = ranked.withColumn("turn", F.row_number().over(Window.partitionBy(group, "band", city).orderBy("rank")))
    pick = Window.partitionBy(group, "band").orderBy("turn", "rank")
    return ranked.withColumn("pick", F.row_number().over(pick)).where(F.col("pick") <= each)


def spread_picks(df: DataFrame, group: str, city: str, cell: list[str], order: list[Column], per_city: int, n: int) -> DataFrame:
    """Up to n rows of a group in the given order: one of a cell, and `per_city` of a city at most."""
    one = df.withColumn("_r", F.row_number().over(Window.partitionBy(group, city, *cell).orderBy(*order))).where("_r = 1")
    few = one.withColumn("_r", F.row_number().over(Window.partitionBy(group, city).orderBy(*order))).where(F.col("_r") <= per_city)
    return few.withColumn("pick", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("pick") <= n).drop("_r")


def greedy_cover(sets: DataFrame, candidate: str, item: str, budget: int) -> list[tuple[object, int]]:
    """Greedy maximum coverage: (candidate, new items) until the budget or no gain; ties take the smallest candidate.

    A step is one aggregation and one anti-join, written to the shared folder; only the winner comes to the driver.
    """
    left, picked = stored(sets.select(candidate, item).distinct(), "cover"), []
    while len(picked) < budget and (best := left.groupBy(candidate).agg(F.count("*").alias("n")).orderBy(F.desc("n"), candidate).first()):
        picked.append((best[0], best[1]))
        rest = stored(left.join(left.where(F.col(candidate) == F.lit(best[0])).select(item), item, "left_anti"), "cover")
        forget(left)
        left = rest
    return picked


def interleave(df: DataFrame, group: str, key: str, stripe: int) -> DataFrame:
    """`position`: groups dealt out in stripes of rows, each stripe number in order of groups. Offsets come from the counts of (stripe, group), so only these pass through one task."""
    r = df.withColumn("_i", F.row_number().over(Window.partitionBy(group).orderBy(key)) - 1).withColumn("_s", F.floor(F.col("_i") / stripe))
    counts = r.groupBy("_s", group).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_s", group).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return r.join(counts.select("_s", group, before.alias("_o")), ["_s", group]).withColumn("position", F.col("_o") + F.col("_i") - F.col("_s") * stripe).drop("_i", "_s", "_o")
