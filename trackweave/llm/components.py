"""Connected components of an edge table by alternating large and small stars; all of it joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.llm.common import discard, gathered, in_files, materialize


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.min("b").alias("m"))


def _large_star(edges: DataFrame, count: int) -> tuple[DataFrame, DataFrame]:
    """Every neighbour above a node is joined to the least of the node and its neighbours. Also gives the written table that this reads."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # Written, so that both sides of the join are shuffled for it and a hub's edges can be split between tasks.
    least = materialize(in_files(_least(both).select("a", F.least("a", "m").alias("m")), 2 * count), "cc-least")
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), least


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its lower neighbours are joined to the least of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = _least(down)
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of the edges (a, b): comp is the least node that can be reached. A table without edges gives none.

    Stars alternate until a round changes nothing; there is no other end. Every written table is removed but the last round's, which the result reads; the caller
    finds it as the result's attribute `reads` and can remove it in its turn, and a bound of the result's rows as `size`."""
    now = materialize(gathered(edges.where("a <> b").select("a", "b").distinct()), "cc")
    count, sign = now.count(), None
    while True:
        stars, least = _large_star(now, count)
        before, now = now, materialize(in_files(_small_star(stars), count), "cc")
        discard(before)
        discard(least)
        count, total = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (count, total) == sign:
            break
        sign = count, total
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()
    out = now.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(roots)
    out.reads, out.size = now, 2 * count
    return out
