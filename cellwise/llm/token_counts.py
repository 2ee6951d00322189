"""Token counts: an exact histogram of encoded lengths, and suffix sums that answer every context limit."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellwise.llm.common import map_rows, texts_of
from cellwise.llm.word_tokens import word_encoder
from cellwise.session import stored

#: Lengths are summed in blocks of this many, so that no window holds more than a block or the list of blocks.
BLOCK = 1024


def token_lengths(docs: DataFrame, tokenizer: str, text_column: str = "text") -> DataFrame:
    """The encoded length (`n_tokens`) of every text, whole: one row per row, repeated rows too.

    A null or empty text has 0; an empty table gives an empty result; other columns are not looked at.
    """
    source = docs.select(F.col(text_column).cast("string").alias("text"))
    schema = T.StructType([T.StructField("n_tokens", T.LongType())])

    def make():
        encoder = word_encoder(tokenizer)
        return lambda batch: pa.RecordBatch.from_arrays([pa.array(np.diff(encoder.encode_flat(texts_of(batch.column("text")))[1]), pa.int64())], names=["n_tokens"])

    return map_rows(source, make, schema, "text")


def length_histogram(lengths: DataFrame, column: str = "n_tokens") -> DataFrame:
    """One row per length that occurs: n_docs of it, docs_from and tokens_from (documents of at least that length and their
    tokens), truncated_tokens (all tokens if documents are cut there) and share_to (share of documents of at most that length).

    The histogram is written to the shared folder, so texts are read and encoded once. Null lengths are left out; an empty table gives an empty result. Counts combine before the shuffle, so a
    length that a third of the documents have is no hot spot.
    """
    h = lengths.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("long").alias("n_tokens")).agg(F.count("*").alias("n_docs"))
    h = stored(h, "histogram").withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    blocks = blocks.select(
        "block", F.coalesce(F.sum("d").over(after), F.lit(0)).alias("docs_after"), F.coalesce(F.sum("t").over(after), F.lit(0)).alias("tokens_after"),
        F.sum("d").over(everything).alias("all_docs"), F.sum("t").over(everything).alias("all_tokens"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    out = h.join(blocks, "block").withColumns({
        "docs_from": F.sum("n_docs").over(inside) + F.col("docs_after"),
        "tokens_from": F.sum(F.col("n_docs") * F.col("n_tokens")).over(inside) + F.col("tokens_after"),
    })
    return out.select(
        "n_tokens", "n_docs", "docs_from", "tokens_from", (F.col("all_tokens") - F.col("tokens_from") + F.col("n_tokens") * F.col("docs_from")).alias("truncated_tokens"),
        ((F.col("all_docs") - F.col("docs_from") + F.col("n_docs")) / F.col("all_docs")).alias("share_to"),
    )


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit: documents that reach it, all tokens, and tokens left after truncation there."""
    h = histogram.select("n_tokens", "n_docs")
    sums = []
    for i, limit in enumerate(limits):
        sums += [
            F.coalesce(F.sum(F.when(F.col("n_tokens") >= limit, F.col("n_docs"))), F.lit(0)).alias(f"d{i}"),
            F.coalesce(F.sum(F.least("n_tokens", F.lit(limit)) * F.col("n_docs")), F.lit(0)).alias(f"t{i}"),
        ]
    rows = F.array(*(F.struct(F.lit(x).cast("long").alias("context_limit"), F.col(f"d{i}").alias("docs_from"), F.col("total").alias("tokens"), F.col(f"t{i}").alias("truncated_tokens")) for i, x in enumerate(limits)))
    one = h.agg(F.coalesce(F.sum(F.col("n_tokens") * F.col("n_docs")), F.lit(0)).alias("total"), *sums)
    return one.select(F.inline(rows))


def length_quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """For each share: the smallest length that at least this share of the documents do not exceed (null for no documents)."""
    found = histogram.agg(*(F.min(F.when(F.col("share_to") >= q, F.col("n_tokens"))).alias(f"q{i}") for i, q in enumerate(shares)))
    return found.select(F.inline(F.array(*(F.struct(F.lit(float(q)).alias("share"), F.col(f"q{i}").alias("n_tokens")) for i, q in enumerate(shares)))))
