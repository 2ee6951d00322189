"""Embedding near-dedup by spherical-cap filters.

Filter directions are a random product code: a direction is one codeword from each block of coordinates. A vector is
list-decoded to all directions whose inner product exceeds a threshold, without looking at all directions; vectors meet
under a shared direction and are verified there in double precision. The threshold makes a filter hold about
`bucket` of the vectors, and the code has as many directions as give a pair at
the similarity `shared` common filters on average.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cellwise.operators.graph import components
from cellwise.session import stored

#: Members of a filter that are compared in one task at most (against as many); larger filters are dealt out in blocks.
BLOCK = 1024


def _tail(d: int) -> tuple[np.ndarray, np.ndarray]:
    """A grid u and P(<x, c> > u) for x uniform on the unit sphere of d dimensions."""
    u = np.linspace(-1, 1, 20001)
    density = np.maximum(1 - u * u, 0) ** max(0.0, (d - 3) / 2)
    mass = np.cumsum(density[::-1])[::-1]
    return u, mass / mass[0]


@lru_cache(256)
def plan_filters(n: int, d: int, cosine: float, bucket: int = 64, shared: float = 12.0) -> tuple[float, int]:
    """Threshold and number of directions for n vectors of d dimensions."""
    u, above = _tail(d)
    share = min(0.02, bucket / max(1, n))
    at = int(np.searchsorted(-above, -share))
    threshold = float(u[min(at, len(u) - 2)])
    weight = -np.diff(above)[at:]
    v, rest = _tail(max(2, d - 1))
    x = u[at:-1]
    both = np.interp((threshold - cosine * x) / np.sqrt(np.maximum((1 - cosine**2) * (1 - x * x), 1e-12)), v, rest, left=1, right=0)
    together = float((weight * both).sum())
    return threshold, max(8, int(np.ceil(shared / max(together, 1e-12))))


@lru_cache(4)
def codebook(d: int, directions: int, seed: int = 7) -> list[tuple[slice, np.ndarray]]:
    """Blocks of coordinates with unit codewords; the product has `directions` directions at least."""
    blocks = 3 if d >= 12 else 1
    words = int(np.ceil(directions ** (1 / blocks) - 1e-9))
    random = np.random.default_rng([seed, d, words])
    edges = np.linspace(0, d, blocks + 1).astype(int)
    out = []
    for a, b in zip(edges, edges[1:]):
        c = random.standard_normal((words, b - a))
        out.append((slice(a, b), c / np.linalg.norm(c, axis=1, keepdims=True)))
    return out


def decode(x: np.ndarray, threshold: float, directions: int, least: int = 32) -> list[np.ndarray]:
    """Numbers of all directions that exceed the threshold for each unit vector (a row of x).

    Where fewer than `least` do, the threshold is lowered for that vector until as many exceed it: such a vector's neighbours
    have few as well, and would miss it.
    """
    code = codebook(x.shape[1], directions)
    words, need = len(code[0][1]), threshold * np.sqrt(len(code))
    products = [x[:, at] @ c.T for at, c in code]
    least = min(least, words ** len(code))
    out = []
    for i in range(len(x)):
        limit, hit = need, np.empty(0, np.int64)
        if len(code) == 1:
            p = products[0][i]
            hit = np.flatnonzero(p >= min(limit, np.sort(p)[-least]))
        else:
            a, b, c = (p[i] for p in products)
            limit = min(limit, a.max() + b.max() + c.max())
            order = np.argsort(-c)
            while len(hit) < least:
                ra, rb = np.nonzero(a[:, None] + b[None, :] >= limit - c[order[0]])
                n = np.searchsorted(-c[order], -(limit - a[ra] - b[rb]), side="right")
                first = np.repeat((ra * words + rb) * words, n)
                hit = first + order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                limit -= 0.03
        out.append(np.sort(hit))
    return out


MET = T.StructType([T.StructField("id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("low", T.LongType())])


def _meet(cosine: float):
    arrow = to_arrow_schema(MET)

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        """Links of the members of one filter (or of two blocks of it). A pair counts here only if it shares no smaller filter; `low` is the smallest id reached here."""
        me, left, right = (k.as_py() for k in key)
        ids, sizes, salt = (table.column(c).to_numpy() for c in ("id", "size", "salt"))
        order = np.argsort(ids, kind="stable")
        x = np.array(table.column("vector").to_pylist(), float)[order]
        ids, sizes, salt = ids[order], sizes[order], salt[order]
        filters = [f for i, f in enumerate(table.column("filters").to_pylist())]
        filters = [filters[i] for i in order]
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        linked = x @ x.T >= cosine
        np.fill_diagonal(linked, False)
        if left != right:
            linked &= salt[:, None] != salt[None, :]
        on = np.flatnonzero(linked.any(1))
        if not len(on):
            return arrow.empty_table()
        linked, ids, sizes = linked[np.ix_(on, on)], ids[on], sizes[on]
        low = ids.copy()
        while True:
            new = np.minimum(low, np.where(linked, low[None, :], np.iinfo(np.int64).max).min(1))
            if (new == low).all():
                break
            low = new
        rows, columns = [], []
        for r, i in enumerate(on):
            smaller = [f for f in filters[i] if f < me]
            rows += [r] * len(smaller)
            columns += smaller
        if columns:
            names, at = np.unique(columns, return_inverse=True)
            has = np.zeros((len(on), len(names)), np.float32)
            has[rows, at] = 1
            has = has[:, has.sum(0) > 1]
            linked &= ~(has @ has.T > 0)
        return pa.table([pa.array(v, pa.int64()) for v in (ids, linked @ sizes, low)], schema=arrow)

    return meet


def embedding_near_dedup(vectors: DataFrame, cosine: float = 0.95, id_column: str = "vec_id", vector_column: str = "embedding", bucket: int = 64, shared: float = 12.0) -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors with at least that cosine), component_id (smallest id reachable), kept (it is its own component's).

    Nulls, zero vectors and vectors with null or non-finite components are linked with nothing. Vectors are compared with those of
    their own length. Equal vectors are one class, compared once, and link with each other, repeated rows too; a row with a null id
    is linked with nothing and not kept. An empty table gives an empty result; other columns are not looked at.
    """
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).alias("vector"))
    sound = F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & F.coalesce(
        F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vector", lambda v: v != 0), F.lit(False))
    rows = rows.withColumn("sound", sound)
    classes = rows.where("sound").groupBy("vector").agg(F.min("vec_id").alias("id"), F.count("*").alias("size"))
    classes = stored(classes, "vectors")
    counts = classes.groupBy(F.size("vector").alias("_d")).agg(F.count("*").alias("_n"))
    counted = classes.join(counts, F.size("vector") == F.col("_d")).select("vector", "id", "size", "_n")

    schema = T.StructType([*classes.schema.fields, T.StructField("filters", T.ArrayType(T.LongType()))])
    arrow = to_arrow_schema(schema)

    def code(batches):
        for batch in batches:
            lists, population = batch.column("vector").to_pylist(), batch.column("_n").to_pylist()
            out: list = [None] * len(lists)
            for d in {len(v) for v in lists}:
                at = [i for i, v in enumerate(lists) if len(v) == d]
                x = np.array([lists[i] for i in at], float)
                x /= np.abs(x).max(1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                for i, hit in zip(at, decode(x, *plan_filters(population[at[0]], d, cosine, bucket, shared))):
                    out[i] = hit + (d << 40)  # filters of each length have numbers of their own
            yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(batch.columns[:3], arrow)), pa.array(out, arrow.field("filters").type)], schema=arrow)

    coded = stored(counted.mapInArrow(code, schema), "coded")
    members = coded.withColumn("filter", F.explode("filters"))
    large = members.groupBy("filter").count().where(F.col("count") > BLOCK).select("filter", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    dealt = members.join(large, "filter", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("salt", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("id", "size", "vector", "filters", "salt", "filter", F.least("salt", "other").alias("left"), F.greatest("salt", "other").alias("right"))
    met = stored(dealt.groupBy("filter", "left", "right").applyInArrow(_meet(cosine), MET), "met")
    links = met.groupBy("id").agg(F.sum("n").alias("n"))
    reached = components(met.select(F.col("id").alias("u"), F.col("low").alias("v")))
    of_class = coded.select("vector", "id", "size").join(links, "id", "left").join(reached.withColumnRenamed("node", "id"), "id", "left")
    of_class = of_class.select("vector", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    found = rows.where("sound").join(of_class, "vector").select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
