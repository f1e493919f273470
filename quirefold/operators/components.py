"""Connected components of a graph given by its edges, in few jobs.

Edges are range-partitioned by where they lie, so that neighbours meet, and every task
unites its own ones; what it hands on is one row per vertex, whatever the number of edges.
Vertices that several tasks have seen tie the roots of those tasks together. Only these
ties go round: each round hangs every root under its smallest neighbour, first looking up
and then down, which settles in a number of rounds that follows the logarithm of how often
a component crosses from task to task, not its length.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.session import materialize


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the edges of one task: each vertex with the smallest one it is joined to."""
    above: dict[str, str] = {}

    def root(v: str) -> str:
        top = v
        while above[top] != top:
            top = above[top]
        while above[v] != top:
            above[v], v = top, above[v]
        return top

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(above.setdefault(u, u) and u), root(above.setdefault(v, v) and v)
            if a != b:
                above[max(a, b)] = min(a, b)
    names = list(above)
    for at in range(0, len(names), 10_000):
        some = names[at : at + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array(list(map(root, some)), pa.string())], ["vertex", "root"])


def _hung(edges: DataFrame) -> DataFrame:
    """One round over ``a, b``: larger neighbours go to the smallest one, then each vertex's smaller neighbours do."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    up = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    down = up.where("b < a")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(least, "a")
    return joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _settled(ties: DataFrame) -> DataFrame:
    """``root, component``: rounds until every root hangs under the smallest of its component."""
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    edges = materialize(ties)
    before, now = None, mark(edges)
    while now != before and now[0]:
        edges = materialize(_hung(edges))
        before, now = now, mark(edges)
    return edges.select(F.col("a").alias("root"), F.col("b").alias("component"))


def components(edges: DataFrame, u: str, v: str, near: Sequence[Column]) -> DataFrame:
    """``vertex, component`` of every vertex of ``edges``; names are strings, a component is named by its smallest.

    ``near`` orders the edges so that those of neighbouring vertices lie close together.
    """
    slices = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = edges.repartitionByRange(slices, *near).select(u, v)
    forest = materialize(placed.mapInArrow(_united, "vertex string, root string"))
    seen = forest.groupBy("vertex").agg(F.min("root").alias("first"), F.max("root").alias("last"))
    shared = seen.where("first <> last").select("vertex", "first")
    ties = forest.join(shared, "vertex").where("root <> first").select(F.col("root").alias("a"), F.col("first").alias("b")).distinct()
    named = forest.join(_settled(ties), "root", "left")
    return named.groupBy("vertex").agg(F.min(F.coalesce("component", "root")).alias("component"))
