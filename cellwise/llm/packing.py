"""Packing by powers of two: every document is cut into pieces of binary lengths, and pieces of equal length share a bucket."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellwise.llm.common import map_rows, texts_of
from cellwise.llm.word_tokens import word_encoder


def binary_lengths(total: int, longest: int) -> list[int]:
    """`longest` as often as it fits, then the powers of two of the rest, descending. `longest` is a power of two."""
    rest = total % longest
    return [longest] * (total // longest) + [1 << b for b in range(longest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack_documents(docs: DataFrame, tokenizer: str, longest: int = 2048, end_id: int = 1, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and `ids`, little-endian uint32, on request).

    A piece of a power-of-two length is a sequence of its own, so no sequence crosses documents and none needs
    padding; batches are drawn from the sequences of one length. A null or empty text is the end id alone.
    Repeated rows, also of one id, are packed each for itself; an empty table gives an empty result; a null id stays
    null; other columns are not looked at. Sequence ids are unique in a result, not dense.
    """
    if longest & (longest - 1) or longest < 1:
        raise ValueError("longest must be a power of two")
    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType
    names = ["start", "length", "ids_crc32", "doc_tokens"]
    schema = T.StructType([T.StructField("doc_id", kind), *(T.StructField(n, T.LongType()) for n in names)] + [T.StructField("ids", T.BinaryType())] * with_ids)
    end = np.array([end_id], "<u4").tobytes()

    def make():
        encoder = word_encoder(tokenizer)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            row, start, length, crc, tokens, pieces = [], [], [], [], [], []
            ids, ends = encoder.encode_flat(texts_of(batch.column("text")))
            raw = ids.data.cast("B") if len(ids) else memoryview(b"")
            for i, (a, b) in enumerate(zip(ends.tolist(), ends[1:].tolist())):
                at, total = 0, b - a + 1
                for n in binary_lengths(total, longest):
                    piece = raw[4 * (a + at) : 4 * min(a + at + n, b)]
                    check = zlib.crc32(piece)
                    row.append(i), start.append(at), length.append(n), tokens.append(total)
                    at += n
                    crc.append(zlib.crc32(end, check) if at == total else check)
                    if with_ids:
                        pieces.append(bytes(piece) + end * (at == total))
            columns = [batch.column("doc_id").take(pa.array(row, pa.int64())), *(pa.array(v, pa.int64()) for v in (start, length, crc, tokens))]
            return pa.RecordBatch.from_arrays(columns + [pa.array(pieces, pa.binary())] * with_ids, names=schema.names)

        return one

    return map_rows(source, make, schema, "text").withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
