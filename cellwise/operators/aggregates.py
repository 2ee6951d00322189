"""Aggregations of sparse activations (row, item, v)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shares(acts: DataFrame, dims: DataFrame, row: str, item: str, value: str, level: str) -> DataFrame:
    """Share of each `level` in its row. The denominator has all items of the row, also those without a level; 0 if it is 0.

    Items are summed to (row, level) once; the total comes from these sums by a window on the row.
    """
    by = acts.join(dims.select(item, level), item, "left").groupBy(row, level).agg(F.sum(value).alias("_v"))
    total = F.sum("_v").over(Window.partitionBy(row))
    return by.withColumn("share", F.when(total > 0, F.col("_v") / total).otherwise(0.0)).where(F.col(level).isNotNull()).drop("_v")


def cell_balanced_mean(df: DataFrame, group: str, cell: list[str], by: list[str], value: Column) -> DataFrame:
    """Mean over cells of the mean over a cell's rows, by group and `by`."""
    cells = df.groupBy(group, *cell, *by).agg(F.avg(value).alias("_m"))
    return cells.groupBy(group, *by).agg(F.avg("_m").alias("mean"))


def weighted_quantile(df: DataFrame, groups: list[str], value: str, weight: str, q: float, default: float = 1.0) -> DataFrame:
    """Of the positive finite values, the smallest x whose weights up to it reach q of all; `default` where there is none."""
    sound = df.where((F.col(value) > 0) & (F.col(value) < float("inf")))
    ties = sound.groupBy(*groups, value).agg(F.sum(weight).alias("_w"))
    w = Window.partitionBy(*groups)
    reached = ties.withColumns({"_c": F.sum("_w").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)), "_t": F.sum("_w").over(w)})
    found = reached.where(F.col("_c") >= q * F.col("_t") - 1e-12).groupBy(*groups).agg(F.min(value).alias("threshold"))
    return df.select(*groups).distinct().join(found, groups, "left").withColumn("threshold", F.coalesce("threshold", F.lit(default)))


def quantile_higher(df: DataFrame, groups: list[str], value: str, q: float) -> DataFrame:
    """The smallest value at or above position q * (n - 1) of the sorted values."""
    w = Window.partitionBy(*groups)
    ranked = df.where(F.col(value).isNotNull()).withColumns({"_r": F.row_number().over(w.orderBy(value)) - 1, "_n": F.count("*").over(w)})
    return ranked.where(F.col("_r") == F.ceil(q * (F.col("_n") - 1))).select(*groups, F.col(value).alias("quantile"))


def root_mean_square(acts: DataFrame, item: str, value: str, floor: float = 1e-6) -> DataFrame:
    return acts.groupBy(item).agg(F.count("*").alias("n"), F.greatest(F.sqrt(F.sum(F.col(value) * F.col(value)) / F.count("*")), F.lit(floor)).alias("rms"))


def item_statistics(acts: DataFrame, item: str, value: str, rows: DataFrame) -> DataFrame:
    """Frequency, mean, deviation and maximum of each item over all rows; rows without the item count as zeros."""
    n = F.broadcast(rows.agg(F.count("*").alias("_n")))
    s = acts.groupBy(item).agg(F.sum((F.col(value) > 0).cast("long")).alias("positive"), F.sum(value).alias("_s"), F.sum(F.col(value) * F.col(value)).alias("_q"), F.max(value).alias("peak")).join(n)
    mean = F.col("_s") / F.col("_n")
    return s.select(item, (F.col("positive") / F.col("_n")).alias("frequency"), mean.alias("mean"), F.sqrt(F.greatest(F.col("_q") / F.col("_n") - mean * mean, F.lit(0.0))).alias("deviation"), "peak")


def median_mad(df: DataFrame, groups: list[str], value: str, floor: float = 1e-4) -> DataFrame:
    """Median, and 1.4826 times the median distance from it (`floor` at least)."""
    centre = df.groupBy(*groups).agg(F.median(value).alias("centre"))
    off = df.join(centre, groups).groupBy(*groups).agg(F.first("centre").alias("centre"), F.median(F.abs(F.col(value) - F.col("centre"))).alias("_d"))
    return off.withColumn("spread", F.greatest(F.col("_d") * 1.4826, F.lit(floor))).drop("_d")


def crosstab_shares(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Share of each column value in a row, wide; 0 where it does not occur. Values outside the list count in no denominator."""
    wide = df.groupBy(row).pivot(column, values).count().na.fill(0)
    total = sum((F.col(f"`{v}`") for v in values), F.lit(0))
    return wide.select(row, *(F.when(total > 0, F.col(f"`{v}`") / total).otherwise(0.0).alias(str(v)) for v in values))


def threshold_curve(df: DataFrame, row: str, score: str, thresholds: list[float]) -> DataFrame:
    """For each threshold: share of entries, of rows with all entries, and of rows with any entry that reach it."""
    rows = df.groupBy(row).agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"), F.count("*").alias("_n"), *(F.sum((F.col(score) >= t).cast("long")).alias(f"_{i}") for i, t in enumerate(thresholds)))
    one = rows.agg(F.count("*").alias("rows"), F.sum("_n").alias("n"), *(x for i, t in enumerate(thresholds) for x in (F.sum(f"_{i}").alias(f"e{i}"), F.sum((F.col("_lo") >= t).cast("long")).alias(f"a{i}"), F.sum((F.col("_hi") >= t).cast("long")).alias(f"o{i}"))))
    return one.select(F.inline(F.array(*(F.struct(F.lit(t).alias("threshold"), (F.col(f"e{i}") / F.col("n")).alias("entries"), (F.col(f"a{i}") / F.col("rows")).alias("rows_all"), (F.col(f"o{i}") / F.col("rows")).alias("rows_any")) for i, t in enumerate(thresholds)))))
