"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard. At each level every child draws
``-ln(u) / weight`` with u hashed from (level, child, key); the least draw wins, so a child is
chosen with a chance proportional to its weight. A draw depends on the child alone, so when one
child's weight rises, keys move to that child only: movement stays inside the subtrees whose
weights change. A shard that is added in a region of its own takes rows only into itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_text

#: Slots are counted in so many hash buckets for each shard, so no task holds a whole shard.
SLOT_BUCKETS = 4096


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def uniform_tree(shards: int, shards_per_rack: int = 2, racks_per_region: int = 2) -> list[Leaf]:
    return [Leaf(s // (shards_per_rack * racks_per_region), s // shards_per_rack, s) for s in range(shards)]


def grow(tree: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """One more shard, in a new region and rack: no other subtree's weight changes."""
    return [*tree, Leaf(max(x.region for x in tree) + 1, max(x.rack for x in tree) + 1, max(x.shard for x in tree) + 1, weight)]


def _draw(key: Column, level: str, child: Column, weight: Column) -> Column:
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{level}:"), child.cast("string"), F.lit(":"), key)), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / float(2**52)) / weight


def _choose(key: Column, level: str, children: Column) -> Column:
    """The child with the least draw, of an array of (child, weight)."""
    draws = F.transform(children, lambda x: F.struct(_draw(key, level, x["child"], x["weight"]).alias("draw"), x["child"].alias("child")))
    return F.array_min(draws)["child"]


def _children(leaves: list[Leaf], level: str) -> Column:
    weights: dict[int, float] = {}
    for x in leaves:
        weights[getattr(x, level)] = weights.get(getattr(x, level), 0.0) + x.weight
    return F.array(*[F.struct(F.lit(c).alias("child"), F.lit(float(w)).alias("weight")) for c, w in sorted(weights.items())])


def place(key: Column, tree: list[Leaf]) -> Column:
    """The shard of a key, as one expression: a draw at each of the three levels."""
    tree = [x for x in tree if x.weight > 0]

    def under(level: str, below: str) -> Column:
        nodes = sorted({getattr(x, level) for x in tree})
        return F.create_map(*[y for n in nodes for y in (F.lit(n), _children([x for x in tree if getattr(x, level) == n], below))])

    region = _choose(key, "region", _children(tree, "region"))
    rack = _choose(key, "rack", F.element_at(under("region", "rack"), region))
    return _choose(key, "shard", F.element_at(under("rack", "shard"), rack))


def shard_documents(docs: DataFrame, tree: list[Leaf], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row with its shard, its slot in it, and its shard once one more shard is there.

    Null keys count as the text 'null' and null texts have size 1 and crc 0. Repeated keys share a
    shard and get slots of their own; ties in (bucket, key, crc, size) are equal rows, whose slots
    may be exchanged. An empty table gives an empty result. Other columns are not read.
    Slots: the rows of each (shard, bucket) are counted first, which gives each bucket's first
    slot; then rows are numbered inside their bucket.
    """
    k = id_text(key)
    grown = grow(tree)
    base = docs.select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        place(k, tree).alias("shard"),
        place(k, grown).alias("grown_shard"),
    )
    bucket = F.conv(F.substring(F.md5(F.concat(F.lit("slot:"), id_text("doc_id"), F.lit(":"), F.col("text_crc32").cast("string"))), 1, 3), 16, 10).cast("int")
    base = base.withColumn("bucket", F.pmod(bucket, F.lit(SLOT_BUCKETS)))
    counts = base.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    first = counts.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("first"))
    inside = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size"))
    return base.join(first, ["shard", "bucket"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + inside - 1).cast("long").alias("slot"), "grown_shard")
