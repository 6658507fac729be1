"""Connected components of an edge table, by alternating star contractions.

Large-star and small-star steps (Kiveris et al., 2014) replace the edges by
fewer and shorter ones until every node hangs on the smallest node of its
component. Each step is one aggregation with map-side combine and one join in
which the edges of a node are dealt to parts, so a hub with a third of all
edges is no single task's work. Every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut

MAX_ROUNDS = 60
#: Parts that the edges of one node are dealt to where they meet its smallest neighbour.
PARTS = 16


def _least(ends: DataFrame) -> DataFrame:
    """(n, m): each node's smallest neighbour; combined before it is shuffled."""
    return ends.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")


def _meet(edges: DataFrame, low: DataFrame) -> DataFrame:
    """``edges`` (a, b) with ``low`` (n, m) of their a, a node's edges in ``PARTS`` parts."""
    left = edges.withColumn("k", F.pmod(F.xxhash64("b"), F.lit(PARTS)).cast("int"))
    right = low.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return left.join(right, (left["a"] == right["n"]) & (left["k"] == right["k"])).select("a", "b", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = _least(both).withColumn("m", F.least("n", "m"))
    return _meet(both.filter("b > a"), low).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = _least(down)
    return _meet(down, low).filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("n").alias("a"), F.col("m").alias("b")))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node that has an edge; root is the smallest node.

    Edges need not be unique or oriented; self-edges and nulls are ignored.
    """
    now = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null and a != b")
    now = cut(now.distinct(), "edges")
    mark = None
    for _ in range(MAX_ROUNDS):
        after = cut(_small_star(_large_star(now)).filter("a != b").distinct(), "star")
        drop_cut(now)
        now = after
        stars = now.select(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(stars) == mark:
            break
        mark = tuple(stars)
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
