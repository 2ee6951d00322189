"""Graph operators over edge lists (u, v)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cellwise.session import forget, stored

#: Edge lists up to this many rows are finished by one task (two numbers a row); larger ones go on in rounds.
ONE_TASK = 1_000_000


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _finish(edges: DataFrame) -> DataFrame:
    """Components of an edge list whose size has been checked, in one task: hooking and pointer jumping."""
    kind = edges.schema["u"].dataType
    schema = T.StructType([T.StructField("node", kind), T.StructField("component", kind)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), to_arrow_schema(edges_schema))
        if not table.num_rows:
            return
        ends = [table.column(c).to_numpy() for c in ("u", "v")]
        nodes, at = np.unique(np.concatenate(ends), return_inverse=True)
        u, v = at[: len(ends[0])], at[len(ends[0]) :]
        root = np.arange(len(nodes))
        while True:
            low, high = np.minimum(root[u], root[v]), np.maximum(root[u], root[v])
            on = low != high
            if not on.any():
                break
            np.minimum.at(root, high[on], low[on])
            while (root[root] != root).any():
                root = root[root]
        yield pa.RecordBatch.from_arrays([pa.array(x, arrow.field(0).type) for x in (nodes, nodes[root])], schema=arrow)

    edges_schema = edges.select("u", "v").schema
    return edges.select("u", "v").coalesce(1).mapInArrow(run, schema)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (u, v): component is the smallest node that it reaches.

    Edges with a null end or equal ends are left out. Minima combine before each shuffle; each round is written
    to the shared folder; rounds grow with the logarithm of the longest path, and end early where at most ONE_TASK edges
    are left. An empty list gives an empty result.
    """
    edges = stored(edges.select("u", "v").where("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct(), "edges")
    mark, left = None, edges.count()
    while left > ONE_TASK:
        new = stored(_small_star(_large_star(edges)), "edges")
        now = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        forget(edges)
        edges, left = new, now[0]
        if now == mark:
            stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return stars.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        mark = now
    return _finish(edges)


def diffuse(edges: DataFrame, anchors: DataFrame, node: str, value: str, steps: int) -> DataFrame:
    """Harmonic diffusion: anchors keep their value, every other node takes, `steps` times, the mean of its neighbours (0 at first).

    edges are directed both ways. Each step is one join and one aggregation; every tenth is written to the shared folder.
    """
    nodes = edges.select(F.col("u").alias(node)).union(edges.select(F.col("v").alias(node))).union(anchors.select(node)).distinct()
    nodes = stored(nodes.join(anchors.select(node, F.col(value).cast("double").alias("_a")), node, "left"), "nodes")
    edges = stored(edges.select("u", "v"), "edges")
    now = nodes.select(node, F.coalesce("_a", F.lit(0.0)).alias("x"))
    for step in range(1, steps + 1):
        mean = edges.join(now.select(F.col(node).alias("v"), "x"), "v").groupBy(F.col("u").alias(node)).agg(F.avg("x").alias("m"))
        now = nodes.join(mean, node, "left").select(node, F.coalesce("_a", "m", F.lit(0.0)).alias("x"))
        if step % 10 == 0:
            now = stored(now, "values")
    return now.select(node, F.col("x").alias(value))


def boundary_segments(edges: DataFrame, distance: str, quantile: float = 0.9) -> DataFrame:
    """Components of what is left after cutting the edges whose distance is above the quantile of the positive distances: (node, component)."""
    limit = edges.where(F.col(distance) > 0).agg(F.percentile(distance, F.lit(quantile)).alias("_limit"))
    kept = edges.join(F.broadcast(limit)).where(F.col(distance) <= F.coalesce("_limit", F.lit(float("inf"))))
    nodes = edges.select(F.col("u").alias("node")).union(edges.select(F.col("v").alias("node"))).distinct()
    return nodes.join(components(kept.select("u", "v")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def closure(edges: DataFrame, most: int = 64) -> DataFrame:
    """All (u, v) with a path from u to v, by doubling path lengths up to 2**most."""
    reach = stored(edges.select("u", "v").distinct(), "reach")
    n = reach.count()
    for _ in range(most):
        further = reach.select("u", F.col("v").alias("_m")).join(reach.select(F.col("u").alias("_m"), "v"), "_m").select("u", "v")
        reach = stored(reach.union(further).distinct(), "reach")
        if (m := reach.count()) == n:
            break
        n = m
    return reach


def transitive_reduction(edges: DataFrame) -> DataFrame:
    """Edges of an acyclic graph that no longer path replaces."""
    reach = closure(edges)
    longer = edges.select("u", F.col("v").alias("_m")).join(reach.select(F.col("u").alias("_m"), "v"), "_m").select("u", "v").distinct()
    return edges.select("u", "v").distinct().join(longer, ["u", "v"], "left_anti")
