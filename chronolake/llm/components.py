"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fence


def _large_star(edges: DataFrame) -> DataFrame:
    """Join every larger neighbour of a node to the smallest node around it."""
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = fence(both.groupBy("u").agg(F.min("v").alias("m")))
    return (
        both.where("v > u")
        .join(least, "u")
        .select(F.col("v").alias("hi"), F.least("u", "m").alias("lo"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Join a node and its smaller neighbours to the smallest of them."""
    least = fence(edges.groupBy("hi").agg(F.min("lo").alias("m")))
    moved = edges.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return least.select("hi", F.col("m").alias("lo")).unionByName(moved).distinct()


def _in_one_task(edges: DataFrame) -> DataFrame:
    """(node, root) of all ``edges``, by union-find."""

    def of(batches):
        up = {}

        def top(x):
            while (y := up.get(x, x)) != x:
                up[x] = x = up.get(y, y)
            return x

        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = sorted((top(x), top(y)))
                if x != y:
                    up[y] = x
        found = [(x, top(x)) for x in up]
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], batch.schema.types[k]) for k in (0, 1)], names=["node", "root"])

    kind = edges.schema["hi"].dataType.simpleString()
    return fence(edges.coalesce(1).mapInArrow(of, f"node {kind}, root {kind}"))


def connected_components(links: DataFrame, a: str = "a", b: str = "b", few: int = 0) -> DataFrame:
    """Return (node, root) for every node that has a link to another node.

    ``root`` is the smallest node reachable, so root < node; roots themselves
    and unlinked nodes have no row. Null ends and self-links are dropped,
    repeated links count once. Every step is a partial aggregation, or a join of
    rows that are dealt anew on both sides, so that adaptive execution can split
    a node with very many links. Lineage is cut by checkpoints in each round;
    only two numbers a round reach the driver. As soon as at most ``few`` links
    are left, one task settles them all: a round has the tasks and files of a
    large table however few its links are.
    """
    edges = (
        links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
        .distinct()
    )
    edges, before = fence(edges), None
    while True:
        mark = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)")).alias("h")).first()
        if mark["n"] == 0 or mark == before:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        if mark["n"] <= few:
            return _in_one_task(edges)
        before = mark
        edges = fence(_small_star(fence(_large_star(edges))))
