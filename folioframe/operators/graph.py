"""Graphs as edge tables: components and reachability."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import Scratch


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the undirected edges (a, b); component is the smallest node reachable.

    Alternating large-star and small-star steps over written tables; each round aggregates with partial sums,
    so a node of very many edges isn't gathered in one task. The rounds end when one changes no edge, after about the
    logarithm of the longest chain. Nothing but the number and a checksum of the edges reaches the driver.
    Tasks are of a size, and the more the more edges.
    """
    e = scratch.write(edges.where("a <> b").selectExpr("greatest(a, b) a", "least(a, b) b").distinct(), wide=True)
    before = None
    while True:
        # large star: each neighbour above u is linked to the least neighbour of u
        both = e.select("a", "b").unionAll(e.selectExpr("b a", "a b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a u", "least(a, m) m")
        large = both.join(least, both.a == least.u).where("b > a").selectExpr("b a", "m b").where("a <> b").distinct()
        # small star: the lower neighbours of u are linked to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        small = large.join(low, large.a == low.u).selectExpr("b a", "m b").where("a <> b").unionAll(low.selectExpr("u a", "m b")).distinct()
        nxt = scratch.write(small, wide=True)
        now = nxt.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(e)
        e = nxt
        if tuple(now) == before:
            break
        before = tuple(now)
    return scratch.write(e.selectExpr("a node", "b component").unionAll(e.selectExpr("b node", "b component").distinct()), wide=True)


def reachable(scratch: Scratch, seeds: DataFrame, edges: DataFrame, merge_every: int = 16) -> DataFrame:
    """(node) that the seeds (node) reach over the edges (src, dst) in either direction, the seeds included.

    A frontier join a round, until a round finds nothing new. A round's new nodes are written, and whether there are any
    alone reaches the driver; every so many rounds the nodes seen become one table, so that a long chain's plan stays
    short."""
    both = scratch.write(edges.selectExpr("src a", "dst b").unionAll(edges.selectExpr("dst a", "src b")).distinct(), wide=True)
    frontier = scratch.write(seeds.select("node").distinct(), wide=True)
    seen, parts = frontier, [frontier]
    while True:
        step = both.join(frontier, both.a == frontier.node, "left_semi").selectExpr("b node").distinct()
        frontier = scratch.write(step.join(seen, "node", "left_anti"), wide=True)
        if frontier.isEmpty():
            return seen
        parts.append(frontier)
        if len(parts) > merge_every:
            parts = [scratch.write(seen.unionAll(frontier), wide=True)]
        seen = parts[0]
        for p in parts[1:]:
            seen = seen.unionAll(p)
