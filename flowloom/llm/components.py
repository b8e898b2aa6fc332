"""Connected components of a distributed edge list by alternating stars.

Each round rewrites the edges so that every node points at a smaller node of its
neighbourhood (large star), then so that small neighbours point at the smallest
(small star). The edges end as stars around the smallest node of a component.
Only minima are gathered per node, so hot nodes combine before the shuffle. The
edges of each round are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    if large:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(least, "a")
    if large:
        moved = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
    return moved.filter(F.col("a") != F.col("b")).distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, root) for every node that has an edge; the root is the smallest node.

    Edges with a null end and loops are left out; edges may repeat and may be
    given in either direction.
    """
    now = edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
    now = now.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    now = stored(now.distinct(), "edges")
    before = _mark(now)
    while before[0]:
        now = stored(_star(_star(now, large=True), large=False), "edges")
        after = _mark(now)
        if after == before:
            break
        before = after
    leaves = now.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))
    roots = leaves.select(F.col("root").alias("node"), F.col("root")).distinct()
    return leaves.unionByName(roots)
