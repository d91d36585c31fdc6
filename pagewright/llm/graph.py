"""Connected components by rounds of contraction, on stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import drop, small, stored


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(node, root) for every node of edges (a, b); nodes of one component have one root.

    Each round points every node at its smallest neighbour, follows the pointer once more, and replaces the ends of all
    edges by what they point at, until no edge is left.  A round at least halves the nodes that still have edges.  Minima
    are partial aggregates, and pointers are joined as stored tables, by broadcast where they are few, so that a root with
    very many nodes is no single task.
    """
    spark = edges.sparkSession
    labels, k, before = None, 0, []
    edges = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{folder}/edges-0")
    while labels is None or not edges.isEmpty():
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select("b", "a"))
        near = stored(both.groupBy("u").agg(F.min("v").alias("p")).select("u", F.least("u", "p").alias("p")), f"{folder}/near-{k}")
        again = near.select(F.col("u").alias("p"), F.col("p").alias("q"))
        to = stored(near.join(again, "p", "left").select("u", F.coalesce("q", "p").alias("p")), f"{folder}/to-{k}")
        if labels is None:
            labels = to.select(F.col("u").alias("node"), F.col("p").alias("root"))
        else:
            moved = labels.join(small(to.select(F.col("u").alias("root"), "p")), "root", "left")
            labels = stored(moved.select("node", F.coalesce("p", "root").alias("root")), f"{folder}/labels-{k}")
        ends = edges.join(to.select(F.col("u").alias("a"), F.col("p").alias("x")), "a").join(to.select(F.col("u").alias("b"), F.col("p").alias("y")), "b")
        k += 1
        edges = stored(ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), f"{folder}/edges-{k}")
        drop(spark, *before)
        before = [f"{folder}/near-{k - 1}", f"{folder}/edges-{k - 1}"]
    return labels


def relabelled(labels: DataFrame | None, edges: DataFrame, folder: str) -> DataFrame:
    """labels after more edges; nodes that labels lacks are their own roots."""
    if labels is None:
        return components(edges, folder)
    for c in ("a", "b"):
        edges = edges.join(labels.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")), c, "left").withColumn(c, F.coalesce(f"r{c}", c)).drop(f"r{c}")
    new = components(edges, folder).select(F.col("node").alias("old"), F.col("root").alias("new"))
    moved = labels.join(small(new), labels["root"] == new["old"], "left").select("node", F.coalesce("new", "root").alias("root"))
    own = new.join(labels.select("node"), F.col("old") == F.col("node"), "left_anti").select(F.col("old").alias("node"), F.col("new").alias("root"))
    return stored(moved.unionAll(own), f"{folder}/merged")
