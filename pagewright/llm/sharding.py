"""Sharding by a hierarchical weighted hash tree.

A row descends from the root through a region and a rack to a shard.  At each level every child draws ln(u) / weight, u
being a hash of the row's key and the child's name, and the largest draw wins, so a child gets rows in proportion to its
weight, which is the sum of its shards' weights.  A changed weight alters only the draws of that child and its ancestors,
so rows move only into or out of subtrees whose weights change.  ``grown`` adds a shard as a region of its own: no older
weight changes, and rows move only into it.

The law is ``key``: the key and the tree alone decide.  A null key is a key like any other.  Equal keys share a shard,
repeated rows get slots of their own.  Null text has no bytes.  Slots count from 0 in the order of the key, nulls first.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.common import drop, scratch, stored


@dataclass(frozen=True)
class Node:
    """A region, rack or shard; shards have a number and no children."""

    name: str
    weight: float
    children: tuple[Node, ...] = ()
    shard: int | None = None


def above(name: str, children: list[Node]) -> Node:
    return Node(name, sum(c.weight for c in children), tuple(children))


def tree(shards: int = 16, racks: int = 4, per_rack: int = 4, weights: list[float] | None = None) -> Node:
    """Shards in order, ``per_rack`` to a rack and two racks to a region or more if there are over ``racks`` racks."""
    leaves = [Node(f"shard-{i}", weights[i] if weights else 1.0, (), i) for i in range(shards)]
    rack_nodes = [above(f"rack-{k}", leaves[at : at + per_rack]) for k, at in enumerate(range(0, shards, per_rack))]
    per_region = max(1, math.ceil(min(racks, len(rack_nodes)) / 2))
    return above("root", [above(f"region-{k}", rack_nodes[at : at + per_region]) for k, at in enumerate(range(0, len(rack_nodes), per_region))])


def leaves(node: Node) -> list[Node]:
    return [node] if node.shard is not None else [x for c in node.children for x in leaves(c)]


def grown(root: Node, weight: float = 1.0) -> Node:
    """One more shard, as a region of its own."""
    n = 1 + max(x.shard for x in leaves(root))
    leaf = Node(f"shard-{n}", weight, (), n)
    return above(root.name, [*root.children, above(f"region-of-{n}", [above(f"rack-of-{n}", [leaf])])])


def draw(key: Column, node: Node) -> Column:
    """ln(u) / weight, u in (0, 1) from the 53 high bits of a hash of key and name."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(node.name), key), 11).cast("double") + 0.5) / float(1 << 53)
    return F.log(u) / F.lit(float(node.weight))


def descend(key: Column, node: Node) -> Column:
    """The shard that the key reaches below node."""
    if node.shard is not None:
        return F.lit(node.shard)
    if len(node.children) == 1:
        return descend(key, node.children[0])
    best = F.array_max(F.array(*[F.struct(draw(key, c).alias("draw"), F.lit(i).alias("child")) for i, c in enumerate(node.children)]))["child"]
    if all(c.shard is not None for c in node.children):
        return F.element_at(F.array(*[F.lit(c.shard) for c in node.children]), best + 1)
    out = None
    for i, c in enumerate(node.children[:-1]):
        out = F.when(best == i, descend(key, c)) if out is None else out.when(best == i, descend(key, c))
    return out.otherwise(descend(key, node.children[-1]))


def placed(docs: DataFrame, root: Node, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, shard and grown_shard of every row."""
    data = F.coalesce(F.col(f"`{text}`").cast("string").cast("binary"), F.lit(b""))
    k = F.col(f"`{key}`")
    return docs.select(k, (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), descend(k, root).cast("int").alias("shard"), descend(k, grown(root)).cast("int").alias("grown_shard"))


def with_slots(rows: DataFrame, key: str) -> DataFrame:
    """rows with ``slot``, 0, 1, 2 ... in every shard.

    The rows are range-partitioned by shard and key and stored with the number of their partition; counts by shard and
    partition give the first slot of each piece, so no task holds a whole shard.
    """
    spark = rows.sparkSession
    top = scratch(spark, "shards")
    fixed = stored(rows.withColumn("row", F.monotonically_increasing_id()), f"{top}/rows")
    ordered = stored(fixed.repartitionByRange("shard", key, "row").withColumn("piece", F.spark_partition_id()), f"{top}/pieces")
    drop(spark, f"{top}/rows")
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    counts = ordered.groupBy("shard", "piece").count().withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    inside = F.row_number().over(Window.partitionBy("shard", "piece").orderBy(key, "row"))
    return ordered.withColumn("inside", inside).join(counts, ["shard", "piece"]).withColumn("slot", (F.col("base") + F.col("inside") - 1).cast("long")).drop("piece", "row", "base", "inside")


def shard(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row."""
    out = with_slots(placed(docs, tree(shards), key, text), key)
    return out.select(key, "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
