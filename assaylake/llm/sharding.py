"""Sharding by a hierarchical weighted hash tree.

A row descends the tree region -> rack -> shard.  At an inner node every child draws ``-ln(u) / weight`` with ``u``
hashed from the row's key and the child's path; the smallest draw wins.  A draw depends on nothing but key, path and
weight, so a changed weight moves rows only into or out of that child, and a subtree whose weights stay keeps its rows
in place.

Growing by one shard adds a new region that holds it: all other draws stay, hence rows only move into the new shard.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaylake.session import materialise

#: Draws use the first 12 hex digits of an MD5, 48 bits, which a double holds exactly.
DRAW_RANGE = float(1 << 48)


@dataclass(frozen=True)
class Node:
    """A leaf has a shard number, an inner node children; the weight of an inner node is the sum of theirs."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int | None = None
    leaf_weight: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.leaf_weight


def uniform_tree(regions: int, racks: int, shards: int) -> Node:
    """Equal weights; shard numbers run through racks and regions in order."""
    return Node("root", tuple(
        Node(f"g{g}", tuple(
            Node(f"r{r}", tuple(Node(f"s{s}", shard=(g * racks + r) * shards + s) for s in range(shards)))
            for r in range(racks)
        ))
        for g in range(regions)
    ))


def grown(tree: Node, weight: float = 1.0) -> Node:
    """The tree with one more shard, alone in a rack of a region of its own."""
    number = 1 + max(_shards(tree))
    name = f"g{len(tree.children)}"
    return Node(tree.name, (*tree.children, Node(name, (Node("r0", (Node("s0", shard=number, leaf_weight=weight),)),))))


def _shards(node: Node) -> list[int]:
    return [node.shard] if node.shard is not None else [s for c in node.children for s in _shards(c)]


def shard_of(key: Column, tree: Node) -> Column:
    """The shard of a key; a null key is hashed as the empty text."""
    text = F.coalesce(key.cast("string"), F.lit(""))

    def place(node: Node, path: str) -> Column:
        if node.shard is not None:
            return F.lit(node.shard)
        paths = [f"{path}/{c.name}" for c in node.children]
        if len(paths) == 1:
            return place(node.children[0], paths[0])
        won = F.array_min(F.array(*[
            F.struct((-F.log(_uniform(text, p)) / F.lit(c.weight)).alias("draw"), F.lit(i).alias("child"))
            for i, (c, p) in enumerate(zip(node.children, paths))
        ]))["child"]
        below = [place(c, p) for c, p in zip(node.children, paths)]
        return F.element_at(F.array(*below), won + 1) if all(c.shard is not None for c in node.children) else _pick(won, below)

    return place(tree, "").cast("int")


def _pick(won: Column, options: list[Column]) -> Column:
    """CASE evaluates only the branch taken, so a row draws only along its own path."""
    out = F.when(won == 0, options[0])
    for i, option in enumerate(options[1:], 1):
        out = out.when(won == i, option)
    return out


def _uniform(text: Column, path: str) -> Column:
    digits = F.substring(F.md5(F.concat(text, F.lit(path))), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(DRAW_RANGE)


def shard(docs: DataFrame, tree: Node, grown_tree: Node | None = None) -> DataFrame:
    """Place every row of ``docs`` (``doc_id`` of any type with an order, ``text``) and number a shard's rows without gaps.

    Returns doc_id, size (UTF-8 bytes plus 1), text_crc32, shard, slot, grown_shard.  Slots follow doc_id, null first;
    repeated ids take consecutive slots in order of checksum and size.  A null text counts as empty, a very long one is read
    by its task alone.  Other columns of ``docs`` are not read.  An empty table gives no rows.

    A shard is never one task, nor is a repeated id: one range shuffle sorts rows by shard and id (rows alike are told apart
    by a number, so that they can be cut), and its partitions are written with each row's place.  A slot is that place,
    less where the shard begins in the partition, plus what earlier partitions hold of the shard.  Only that table of begins,
    one row per partition and shard met in it, goes through windows and the broadcast.
    """
    key = F.col("doc_id")
    body = F.coalesce(F.col("text"), F.lit(""))
    placed = docs.select(
        key, (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"),
        shard_of(key, tree).alias("shard"),
        (shard_of(key, grown_tree) if grown_tree else F.lit(None).cast("int")).alias("grown_shard"),
        F.monotonically_increasing_id().alias("tie"),
    )
    order = ["shard", "doc_id", "text_crc32", "size", "tie"]
    ranges = placed.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")
    # The number holds the partition in its upper bits and the place below.
    number = ranges.withColumn("at", F.monotonically_increasing_id())
    rows = materialise(number.withColumn("part", F.shiftright("at", 33)), "shards")
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first")).select(
        "shard", "part", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift")
    )
    return rows.join(F.broadcast(begins), ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("at") + F.col("shift")).alias("slot"), "grown_shard"
    )
