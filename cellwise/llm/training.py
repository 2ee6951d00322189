"""A bounded sample of labelled documents with their statistics, for the models that are fitted on the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellwise.llm.common import map_rows, texts_of
from cellwise.llm.text_stats import FEATURES, describe


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int, only: Column | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Features and 0/1 labels of at most `most` labelled documents, the same ones in every run.

    The sample has the `most` label rows with the smallest hash of doc_id, so what is broadcast and
    collected is bounded by that parameter. Of repeated label rows of a document the smaller label counts, of repeated
    rows of a document the smallest text, so that no more rows than labels are collected.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
    if only is not None:
        rows = rows.where(only)
    chosen = rows.select("doc_id", "quality", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id", "quality").limit(most)
    chosen = chosen.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("text").alias("text"))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("features", T.ArrayType(T.DoubleType(), False))])

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            _, x = describe(texts_of(batch.column("text")))
            return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("quality").cast(pa.int32()), pa.array(list(x), pa.list_(pa.float64()))], names=schema.names)

        return one

    got = sorted(map_rows(texts, make, schema, "text").collect(), key=lambda r: (r.doc_id, r.features))
    x = np.array([r.features for r in got], float).reshape(len(got), len(FEATURES))
    return x, np.array([r.quality for r in got], float)
