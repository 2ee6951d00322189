"""Sources and sinks of stage tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def locations(spark: SparkSession, path: str, flags: tuple[str, ...] = ("exists", "download", "marker")) -> DataFrame:
    """Rows of a Parquet table with `available` from the first flag column that it has (true where it has none)."""
    df = spark.read.parquet(path)
    flag = next((c for c in flags if c in df.columns), None)
    return df.withColumn("available", F.coalesce(F.col(flag).cast("boolean"), F.lit(False)) if flag else F.lit(True))


def csv_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV table with a header; a byte order mark does not become part of the first name."""
    df = spark.read.option("header", True).csv(path)
    return df.toDF(*(c.lstrip("﻿") for c in df.columns))


def json_lines(spark: SparkSession, path: str, document: bool = False) -> DataFrame:
    return spark.read.option("multiLine", document).json(path)


def complete_rows(files: DataFrame, path: str = "path") -> DataFrame:
    """From file names `<row>_<heading>.<ext>`: rows that have all of the headings 0, 90, 180 and 270, by a bit for each."""
    name = F.regexp_extract(path, r"([^/]+)_(0|90|180|270)\.[^./]+$", 1)
    heading = F.regexp_extract(path, r"_(0|90|180|270)\.[^./]+$", 1)
    bits = files.where(name != "").select(name.alias("row"), F.pow(F.lit(2), heading.cast("int") / 90).cast("int").alias("bit"))
    return bits.groupBy("row").agg(F.bit_or("bit").alias("mask")).where("mask = 15").select("row")


def shard(df: DataFrame, key: str, index: int, count: int) -> DataFrame:
    """The rows of one of `count` shards, by a hash of the key."""
    return df.where(F.pmod(F.xxhash64(key), F.lit(count)) == index)


def write_partitioned(df: DataFrame, path: str, by: str) -> None:
    """Parquet with a folder for each value of `by`; rows are dealt so that a value has few files, and large values several."""
    df.hint("rebalance", by).write.mode("overwrite").option("compression", "zstd").partitionBy(by).parquet(path)


def sparse_slice(spark: SparkSession, path: str, rows: DataFrame, row: str, headings: list[int]) -> DataFrame:
    """Activations (row, heading, patch, item, v) of some rows and headings; headings reach the scan as a filter, rows by a semi-join."""
    return spark.read.parquet(path).where(F.col("heading").isin(headings)).join(rows.select(row), row, "left_semi")
