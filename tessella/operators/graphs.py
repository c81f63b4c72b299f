"""Connected components and level-by-level walks over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.runtime import materialize


def first_seen(rows: DataFrame, value: str, order: str) -> DataFrame:
    """(value, order): each value once, with the least place at which it stands; sort by that for the first order."""
    return rows.filter(F.col(value).isNotNull()).groupBy(value).agg(F.min(order).alias(order))


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root) for every node of the (a, b) edges; the root is the least node of the component.

    Large-star and small-star steps in turn; each round is written to the shared folder, and the loop ends when a
    round leaves the edges as they were.  A hub is never gathered: its neighbours are only told the least of them.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi <> lo").distinct(), "edges")
    seen = None
    for _ in range(rounds):
        around = now.select(F.col("hi").alias("n"), F.col("lo").alias("m")).unionByName(now.select(F.col("lo").alias("n"), F.col("hi").alias("m")))
        least = around.groupBy("n").agg(F.min("m").alias("low")).select("n", F.least("n", "low").alias("low"))
        star = around.join(least, "n").filter("m > n").select(F.col("m").alias("hi"), F.col("low").alias("lo")).filter("hi <> lo").distinct()
        lower = star.groupBy("hi").agg(F.min("lo").alias("low"))
        moved = star.join(lower, "hi").select(F.explode(F.array(F.struct(F.col("lo").alias("hi"), F.col("low").alias("lo")), F.struct(F.col("hi"), F.col("low").alias("lo")))).alias("e"))
        now = materialize(moved.select("e.hi", "e.lo").filter("hi <> lo").distinct(), "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if state == seen:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
        seen = state
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def walk(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(node, level): nodes reached from `starts`(node) over (parent, child) edges, at the least level, to `depth`."""
    reached = materialize(starts.select("node").distinct().withColumn("level", F.lit(0)), "reached")
    frontier = reached
    for level in range(1, depth + 1):
        step = frontier.join(edges, frontier["node"] == edges["parent"]).select(edges["child"].alias("node")).distinct()
        frontier = materialize(step.join(reached.select("node"), "node", "left_anti").withColumn("level", F.lit(level)), "frontier")
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached
