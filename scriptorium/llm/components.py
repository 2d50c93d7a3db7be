"""Connected components of a graph of links, by alternating stars.

Each round hangs a node's larger neighbours (or its smaller ones) on the least
node it knows; the rounds end when nothing changes, after some log(n) of them.
Least neighbours are aggregated before the shuffle, joins may split hot nodes,
and every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.shared import Workspace


def components(links: DataFrame, space: Workspace, name: str = "components", most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of links (a, b) but components' own least ones; component is the least node reachable."""

    def both(e: DataFrame) -> DataFrame:
        return e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def star(e: DataFrame, larger: bool) -> DataFrame:
        """larger: v > u of all neighbours get u's least; else v <= u and u itself."""
        near = both(e) if larger else e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        hung = near.join(least, "u")
        hung = hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if larger else hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        return hung.where("u <> v").distinct()

    def sign(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())

    edges = space.write(links.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v").distinct(), f"{name}-0")
    before = sign(edges)
    for k in range(1, most_rounds + 1):
        old, edges = edges, space.write(star(star(edges, True), False), f"{name}-{k}")
        now = sign(edges)
        if k > 1:
            space.drop(f"{name}-{k - 1}")
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"no end after {most_rounds} rounds")
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
