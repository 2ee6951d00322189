"""Data contracts and resumable stages."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ContractError(AssertionError):
    pass


def identity(**inputs: object) -> str:
    """sha256 of inputs and parameters as sorted JSON: equal runs have equal names."""
    return hashlib.sha256(json.dumps(inputs, sort_keys=True, default=str).encode()).hexdigest()


def key_report(df: DataFrame, key: list[str], parents: DataFrame, parent_key: str) -> DataFrame:
    """Number of keys, of repeated ones, and of those without a parent. parents: unique keys."""
    counts = df.groupBy(*key).agg(F.count("*").alias("_k"))
    joined = counts.join(parents.select(parent_key, F.lit(True).alias("_p")), parent_key, "left")
    return joined.agg(F.count("*").alias("n"), F.count_if(F.col("_k") > 1).alias("repeated"), F.count_if(F.col("_p").isNull()).alias("orphans"))


def require(df: DataFrame, **rules: str) -> DataFrame:
    """Raise if a row breaks one of the named SQL rules (a null counts as broken); returns `df`."""
    broken = df.agg(*(F.count_if(~F.coalesce(F.expr(rule), F.lit(False))).alias(name) for name, rule in rules.items())).first()
    if bad := {name: broken[name] for name in rules if broken[name]}:
        raise ContractError(f"rows that break a rule: {bad}")
    return df


def same_rows(a: DataFrame, b: DataFrame, key: list[str]) -> int:
    """Rows of either side without an equal row on the other."""
    columns = [c for c in a.columns if c not in key]
    left, right = a.select(*key, F.struct(*columns).alias("_a")), b.select(*key, F.struct(*columns).alias("_b"))
    return left.join(right, key, "full").where(~F.col("_a").eqNullSafe(F.col("_b"))).count()


def stage(spark: SparkSession, folder: str, name: str, run: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The stage's table if one of this run identity is complete, else made now. The table's folder carries the identity, and Spark's committer its completion mark."""
    path = f"{folder}/{name}-{run[:16]}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    mark = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not mark.getFileSystem(conf).exists(mark):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
