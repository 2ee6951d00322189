"""Incremental forms of the batch operators on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cellwise.operators.ranking import top_k


def running_moments(stream: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, mean, deviation and maximum of each key so far (update or complete mode). Sums combine, so late rows change nothing."""
    v = F.col(value).cast("double")
    return stream.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("deviation"), F.max(v).alias("peak"))


def windowed_counts(stream: DataFrame, time: str, keys: list[str], width: str, late: str) -> DataFrame:
    """Counts in tumbling windows; rows later than the watermark are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def newest(stream: DataFrame, time: str, keys: list[str], late: str) -> DataFrame:
    """The first row that arrives of each key, within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def keep_top(stream: DataFrame, folder: str, groups: list[str], value: str, key: str, n: int, checkpoint: str) -> StreamingQuery:
    """Keep the n best rows of each group in Parquet below `folder`; the result does not depend on how rows fall into batches.

    Batch b writes version b from version b - 1 and its own rows, so a batch that is run again writes the same. The newest
    version is that of the largest number.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if number:
            rows = spark.read.parquet(f"{folder}/version={number - 1}").unionByName(batch)
        best = top_k(rows.dropDuplicates([*groups, key]), groups, [F.desc(value), F.col(key)], n, "_rank").drop("_rank")
        best.write.mode("overwrite").parquet(f"{folder}/version={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
