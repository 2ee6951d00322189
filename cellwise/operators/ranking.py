"""Top-k selections, peaks and rank statistics. Ties always end at a unique key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, groups: list[str], order: list[Column], k: int | Column, name: str = "rank") -> DataFrame:
    """The first k rows of each group; a constant k filters before the shuffle as well."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col(name) <= k)


def batch_top_k(acts: DataFrame, batch: str, row: str, item: str, value: str, k: int) -> DataFrame:
    """Of each batch the k * rows largest positive activations, wherever they lie; ties by row and item."""
    rows = acts.groupBy(batch).agg(F.countDistinct(row).alias("_rows"))
    order = Window.partitionBy(batch).orderBy(F.desc(value), row, item)
    ranked = acts.where(F.col(value) > 0).join(rows, batch).withColumn("_r", F.row_number().over(order))
    return ranked.where(F.col("_r") <= k * F.col("_rows")).drop("_r", "_rows")


def peaks(acts: DataFrame, keys: list[str], place: str, value: str) -> DataFrame:
    """Largest value by keys, and its smallest place."""
    best = F.max(F.struct(F.col(value).alias("v"), (-F.col(place)).alias("p")))
    return acts.groupBy(*keys).agg(best.alias("_b")).select(*keys, F.col("_b.v").alias("peak"), (-F.col("_b.p")).alias("place"))


def distinct_city_examples(df: DataFrame, group: str, city: str, value: str, key: str, n: int) -> DataFrame:
    """Of each group the best row of every city, and of these the n best."""
    best = top_k(df, [group, city], [F.desc(value), F.col(key)], 1, "_c")
    return top_k(best.drop("_c"), [group], [F.desc(value), F.col(key)], n)


def diverse(df: DataFrame, group: str, city: str, value: str, key: str, n: int, per_city: int = 2) -> DataFrame:
    """n rows of each group: first those within the cap of their city, then the rest, each by value."""
    ranked = df.withColumn("_c", F.row_number().over(Window.partitionBy(group, city).orderBy(F.desc(value), key)))
    return top_k(ranked, [group], [(F.col("_c") > per_city).cast("int"), F.desc(value), F.col(key)], n).drop("_c")


def percentile_scale(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """`scaled`: (average rank of ties - 1) / (n - 1); 0 for a single row."""
    w = Window.partitionBy(*groups)
    ranked = df.withColumns({"_r": F.row_number().over(w.orderBy(value)), "_n": F.count("*").over(w)})
    mean = F.avg("_r").over(Window.partitionBy(*groups, value))
    return ranked.withColumn("scaled", F.when(F.col("_n") > 1, (mean - 1) / (F.col("_n") - 1)).otherwise(0.0)).drop("_r", "_n")


def equal_strata(df: DataFrame, group: str, value: str, key: str, n: int = 4) -> DataFrame:
    return df.withColumn("stratum", F.ntile(n).over(Window.partitionBy(group).orderBy(value, key)))


def effective_vocabulary(df: DataFrame, group: str, item: str, share: str, reach: float = 0.9) -> DataFrame:
    """How many of a group's items, largest shares first, it takes to reach the total share."""
    running = F.sum(share).over(Window.partitionBy(group).orderBy(F.desc(share), item).rowsBetween(Window.unboundedPreceding, 0))
    ranked = df.withColumns({"_c": running, "_r": F.row_number().over(Window.partitionBy(group).orderBy(F.desc(share), item))})
    return ranked.where(F.col("_c") >= reach - 1e-12).groupBy(group).agg(F.min("_r").alias("items"))


def collapse_runs(df: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the one before in their group."""
    before = F.lag(value).over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("_b", before).where(~F.col("_b").eqNullSafe(F.col(value))).drop("_b")


def rank_fusion(views: DataFrame, view: str, left: str, right: str, similarity: str, k: int, count: int | None = None) -> DataFrame:
    """Fuse similarity views: 1 - (rank - 1) / k for the k nearest in each view, averaged over the views (`count` of them; counted if None) and made symmetric."""
    of = views.select(view).distinct().agg(F.count("*").alias("_views")) if count is None else None
    near = top_k(views.where(F.col(left) != F.col(right)), [view, left], [F.desc(similarity), F.col(right)], k)
    score = near.withColumn("_s", 1 - (F.col("rank") - 1) / k).select(F.least(left, right).alias("a"), F.greatest(left, right).alias("b"), "_s")
    fused = score.groupBy("a", "b").agg((F.sum("_s") / 2).alias("_s"))
    fused = fused.withColumn("_views", F.lit(count)) if of is None else fused.join(F.broadcast(of))
    return fused.select("a", "b", (F.col("_s") / F.col("_views")).alias("score"))
