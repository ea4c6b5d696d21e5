"""Connected components of an edge table by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetmetrics.llm.common import drop_written, spread, written


def _lows(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node, and the node, to the smallest of the node and its neighbours; edges have u > v. Rows may repeat, twice the edges at most."""
    both = edges.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
    low = _lows(both).select("u", F.least("u", "m").alias("m"))
    # the row of the smallest neighbour carries the node's own link
    return both.join(spread(low), "u").where("v > u or v = m").select(F.greatest("u", "v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    own = F.col("v") == F.col("m")
    return edges.join(_lows(edges), "u").select(F.when(own, F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node is linked to one smaller node only, or is such a node and has none."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))))
    return ends.groupBy("node").agg(F.sum("up").alias("n"), F.min("up").alias("low")).where("n > 1 or (n = 1 and low = 0)").isEmpty()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node on an edge (a, b); component is the smallest node that can be reached.

    Loops and repeated edges do no harm; an empty table gives an empty one. A star is made of partial minima and
    one join a round, so a node with very many edges is aggregated before it is shuffled.
    """
    now = written(
        edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    for _ in range(rounds):
        nxt = written(_small_star(_star(now)))
        drop_written(now)
        now = nxt
        if _settled(now):
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    raise RuntimeError(f"components did not settle in {rounds} rounds")
