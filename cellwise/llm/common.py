"""Arrow helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes of text that a Python worker takes apart at once, whatever the size of the Arrow batch.
SLICE_BYTES = 2 << 20


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each value; null is the empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts have at most `limit` bytes (one row at least)."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column).cast(pa.binary())), 0).to_pylist()
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > limit:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield batch.slice(begin)


def map_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: T.StructType, text: str) -> DataFrame:
    """Apply a batch function, built once per task by `make`, to slices of bounded size."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for batch in batches:
            for part in slices(batch, text):
                out = apply(part)
                if out.num_rows:
                    yield out.cast(arrow) if out.schema != arrow else out

    return df.mapInArrow(run, schema)


def add_columns(df: DataFrame, text: str, make: Callable[[], Callable[[list[bytes]], dict[str, list]]], fields: list[T.StructField]) -> DataFrame:
    """All columns of `df` and those that `make()(texts)` returns; new names must not clash."""
    names = [f.name for f in fields]
    if clash := set(names) & set(df.columns):
        raise ValueError(f"columns {sorted(clash)} are there already; choose another prefix")
    schema = T.StructType([*df.schema.fields, *fields])
    types = [f.type for f in to_arrow_schema(T.StructType(fields))]
    old = to_arrow_schema(df.schema)

    def build() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        apply = make()

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            made = apply(texts_of(batch.column(text)))
            columns = [c.cast(f.type) if c.type != f.type else c for c, f in zip(batch.columns, old)]
            return pa.RecordBatch.from_arrays([*columns, *(pa.array(made[n], t) for n, t in zip(names, types))], names=[*df_columns, *names])

        return one

    df_columns = list(df.columns)
    return map_rows(df, build, schema, text)
