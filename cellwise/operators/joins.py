"""Distance, nearest-neighbour and mutual-best joins."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cellwise.functions.geometry import EARTH_M, haversine_m

#: Vectors of a chunk, about, of which a task compares two; blocks of more than LEAST vectors are dealt out in up to SPREAD chunks in any case.
CHUNK, LEAST, SPREAD = 8192, 1024, 4
#: Rows of a matrix of similarities, and columns of which only the largest is looked at first.
TILE, RUN = 512, 16


def pairs_within(points: DataFrame, key: str, lat: str, lon: str, metres: float, groups: list[str] | None = None) -> DataFrame:
    """Pairs a < b of points at most `metres` apart (within groups): an equi-join on latitude and longitude bands of that width, with the neighbours of one side.

    Longitude bands are as wide as the distance at the largest latitude of the band row, so no pair is missed; points may not lie at the poles or on both sides of the date line.
    """
    groups = groups or []
    step = math.degrees(metres / EARTH_M)
    row = F.floor(F.col(lat) / step).cast("long")

    def column(r):  # bands of one row are equally wide
        widest = F.least(F.greatest(F.abs(r), F.abs(r + 1)) * step + step, F.lit(89.9))
        return F.floor(F.col(lon) / (step / F.cos(F.radians(widest)))).cast("long")

    base = points.select(*groups, F.col(key).alias("k"), F.col(lat).alias("la"), F.col(lon).alias("lo"), lat, lon)
    left = base.withColumn("_r", row).withColumn("_c", column(F.col("_r"))).select(*groups, "_r", "_c", F.col("k").alias("a"), F.col("la").alias("la_a"), F.col("lo").alias("lo_a"))
    near = base.withColumn("_r", F.explode(F.transform(F.array(*(F.lit(i) for i in (-1, 0, 1))), lambda i: row + i)))
    near = near.withColumn("_c", F.explode(F.transform(F.array(*(F.lit(i) for i in (-1, 0, 1))), lambda i: column(F.col("_r")) + i)))
    near = near.select(*groups, "_r", "_c", F.col("k").alias("b"), F.col("la").alias("la_b"), F.col("lo").alias("lo_b"))
    pairs = left.join(near, [*groups, "_r", "_c"]).where("a < b").withColumn("metres", haversine_m(F.col("la_a"), F.col("lo_a"), F.col("la_b"), F.col("lo_b")))
    return pairs.where(F.col("metres") <= metres).select(*groups, "a", "b", "metres")


def _by_length(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows and matrix of the vectors of each length; null and empty vectors, and those that hold nulls, are in none."""
    lists, out = pa.concat_arrays(column.chunks), {}
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    for d in np.unique(n[n > 0]).tolist():
        at = np.flatnonzero(n == d)
        values = pc.list_flatten(lists.take(pa.array(at)))
        whole = ~pc.is_null(values).to_numpy(zero_copy_only=False).reshape(-1, d).any(1)
        out[d] = at[whole], values.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, d)[whole]
    return out


def _directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors are finite and not zero; and these, over powers of two, so that no square leaves the range of doubles."""
    most = np.abs(x).max(1)
    sound = np.isfinite(most) & (most > 0)
    return sound, np.ldexp(x[sound], -np.frexp(most[sound])[1][:, None])


def _spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run, `count` numbers."""
    return np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum())


def _dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed from the first to the last coordinate."""
    return np.cumsum(x * y, axis=1)[:, -1]


def _close(x: np.ndarray, y: np.ndarray, mine: np.ndarray, owner: np.ndarray, k: int):
    """Tile by tile its rows of x, and the pairs (row of x, row of y, cosine) that can be among the k largest of a row of x, without rows of y whose owner is the row's own.

    A product of matrices finds them with a margin for its rounding; their cosines are then summed coordinate by coordinate, so equal ones come out equal.
    """
    d, margin = x.shape[1], 16 * (x.shape[1] + 8) * np.finfo(float).eps
    xx, yy = _dots(x, x), _dots(y, y)
    width = -(-len(y) // RUN)
    across = np.zeros((d, RUN * width))
    across[:, : len(y)] = (y / np.sqrt(yy)[:, None]).T
    by_owner = np.argsort(owner, kind="stable")
    for begin in range(0, len(x), TILE):
        here = slice(begin, begin + TILE)
        s = (x[here] / np.sqrt(xx[here])[:, None]) @ across
        s[:, len(y) :] = -2
        low, high = (np.searchsorted(owner[by_owner], mine[here], side) for side in ("left", "right"))
        s[np.repeat(np.arange(len(s)), high - low), by_owner[_spread(low, high - low)]] = -2
        s = s.reshape(len(s), RUN, width)
        best = s.max(1)
        limit = np.partition(best, width - k, axis=1)[:, width - k] - margin if width >= k else np.full(len(s), -2.0)
        i, j = np.nonzero(best >= limit[:, None])
        found = s[i, :, j]
        at, run = np.nonzero((found >= limit[i, None]) & (found > -1.5))
        i, j, cosine = begin + i[at], run * width + j[at], np.empty(len(at))
        for a in range(0, len(i), 1 << 15):
            u, v = i[a : a + (1 << 15)], j[a : a + (1 << 15)]
            cosine[a : a + (1 << 15)] = np.clip(_dots(x[u], y[v]) / np.sqrt(xx[u] * yy[v]), -1, 1)
        yield np.arange(begin, begin + len(s)), i, j, cosine


def _nearest(ids: np.ndarray, vectors: pa.ChunkedArray, other_ids: np.ndarray, others: pa.ChunkedArray, k: int) -> tuple[np.ndarray, ...]:
    """Row, row of `others` (which lie by id) and cosine of each row's k nearest of another id; the last array tells which cosines are null.

    As in SQL, a cosine with a zero vector or one that is not finite is NaN and counts as the largest, one with a null vector is null and comes last.
    """
    out: list[tuple[np.ndarray, ...]] = []
    enough = k + int(np.unique(other_ids, return_counts=True)[1].max())

    def add(*parts: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]) -> None:
        row, other, cosine, null = (np.concatenate(c) for c in zip(*parts))
        on = ids[row] != other_ids[other]
        row, other, cosine, null = row[on], other[on], cosine[on], null[on]
        order = np.lexsort((other, np.where(null, np.inf, np.where(np.isnan(cosine), -np.inf, -cosine)), row))
        row = row[order]
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else order
        on = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)])) < k
        out.append((row[on], other[order][on], cosine[order][on], null[order][on]))

    def every(rows: np.ndarray, some: np.ndarray, null: bool) -> tuple[np.ndarray, ...]:
        some = some[:enough]
        n = len(rows) * len(some)
        return np.repeat(rows, len(some)), np.tile(some, len(rows)), np.full(n, np.nan), np.full(n, null)

    of_others, seen = _by_length(others), np.zeros(len(ids), bool)
    for d, (rows, x) in _by_length(vectors).items():
        seen[rows] = True
        at, y = of_others.get(d, (np.empty(0, np.int64), np.empty((0, d))))
        null = np.setdiff1d(np.arange(len(other_ids)), at)
        sound, x = _directions(x)
        fine, y = _directions(y)
        add(every(rows[~sound], at, False), every(rows[~sound], null, True))
        rest = [(at[~fine], False), (null, True)]
        rows, at = rows[sound], at[fine]
        if not len(y):
            add(*(every(rows, *r) for r in rest))
            continue
        # Equal vectors are compared once; of each class the smallest ids are enough.
        _, first, of_class = np.unique(np.ascontiguousarray(y).view(np.dtype((np.void, 8 * d))).ravel(), return_index=True, return_inverse=True)
        members, sizes = at[np.argsort(of_class, kind="stable")], np.bincount(of_class)
        begin = np.cumsum(sizes) - sizes
        low, high = other_ids[members[begin]], other_ids[members[begin + sizes - 1]]
        for tile, i, j, cosine in _close(x, y[first], ids[rows], np.where(low == high, low, -1), k):
            n = np.minimum(sizes[j], enough)
            add((rows[np.repeat(i, n)], members[_spread(begin[j], n)], np.repeat(cosine, n), np.zeros(n.sum(), bool)), *(every(rows[tile], *r) for r in rest))
    add(every(np.flatnonzero(~seen), np.arange(len(other_ids)), True))
    return tuple(np.concatenate(c) for c in zip(*out))


def nearest_vectors(vectors: DataFrame, key: str, vector: str, k: int, blocks: list[str], others: DataFrame | None = None) -> DataFrame:
    """The k other vectors (of `others`, with the same columns, if given) of the same block with the largest cosine; ties by key.

    All pairs of a block are compared, in chunks of bounded size: each chunk meets every chunk of the other side by products of matrices, and only its nearest go on.
    """
    pick = lambda df, asks: df.select(*blocks, key, vector).dropna(subset=[*blocks, key]).withColumn("_asks", F.lit(asks))
    left, right = pick(vectors, True), pick(vectors if others is None else others, False)
    sized = lambda df, name: df.groupBy(*blocks).agg(F.count("*").alias("_n")).where(F.col("_n") > LEAST).select(*blocks, F.greatest(F.ceil(F.col("_n") / CHUNK), F.least(F.ceil(F.col("_n") / LEAST), F.lit(SPREAD))).cast("int").alias(name))
    n, m = (F.broadcast(sized(df, name)) for df, name in ((left, "_n"), (right, "_m")))  # a row for each LEAST vectors at most

    def dealt(df: DataFrame, own: str, other: str, columns: tuple[str, str]) -> DataFrame:
        rows = df.join(n, blocks, "left").join(m, blocks, "left").na.fill(1, ["_n", "_m"])
        rows = rows.withColumns({columns[0]: F.pmod(F.xxhash64(key), F.col(own)).cast("int"), columns[1]: F.explode(F.sequence(F.lit(0), F.col(other) - 1))})
        return rows.select(*blocks, "_left", "_right", "_asks", key, vector)

    both = dealt(left, "_n", "_m", ("_left", "_right")).union(dealt(right, "_m", "_n", ("_right", "_left")))
    fields = left.schema
    schema = T.StructType([*(fields[b] for b in blocks), fields[key], T.StructField("other", right.schema[key].dataType), T.StructField("similarity", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def meet(table: pa.Table) -> pa.Table:
        asks = table.column("_asks").combine_chunks()
        here, there = table.filter(asks), table.filter(pc.invert(asks))
        if not len(here) or not len(there):
            return arrow.empty_table()
        _, code = np.unique(np.concatenate([t.column(key).to_numpy() for t in (here, there)]), return_inverse=True)
        code, other = code[: len(here)], code[len(here) :]
        order = np.argsort(other, kind="stable")
        there = there.take(pa.array(order))
        row, near, cosine, null = _nearest(code, here.column(vector), other[order], there.column(vector), k)
        columns = [*here.select([*blocks, key]).take(pa.array(row)).columns, there.column(key).take(pa.array(near)), pa.array(cosine, pa.float64(), mask=null, from_pandas=False)]
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    found = both.groupBy(*blocks, "_left", "_right").applyInArrow(meet, schema)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("similarity"), "other"))).where(F.col("rank") <= k)


def mutual_nearest(left: DataFrame, right: DataFrame, key: str, vector: str, blocks: list[str]) -> DataFrame:
    """Pairs (left, right, similarity) of the same block that are each other's nearest; ties go to the smaller partner."""
    of = lambda a, b, x, y: nearest_vectors(a, key, vector, 1, blocks, b).select(F.col(key).alias(x), F.col("other").alias(y), "similarity")
    return of(left, right, "left", "right").join(of(right, left, "right", "left").select("left", "right"), ["left", "right"])
