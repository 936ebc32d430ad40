"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .common import discard, written


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for each node that has a link.

    links has long columns u and v; nulls and loops are left out. Every round is a few grouped
    joins, written to the shared folder; only its row count and a checksum reach the driver.
    """

    def joined(edges: DataFrame) -> DataFrame:
        """edges with m, the least node next to u or u itself."""
        least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return edges.join(least, "u")

    def pairs(*of: tuple[str, str]) -> Column:
        return F.explode(F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in of])).alias("edge")

    def round_of(edges: DataFrame) -> DataFrame:
        """A large-star and a small-star step. In edges u > v, also between the two steps."""
        large = joined(edges.select(pairs(("u", "v"), ("v", "u"))).select("edge.*")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = joined(large).select(pairs(("v", "m"), ("u", "m"))).select("edge.*")
        return small.filter("u <> v").distinct()

    edges = written(links.filter("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark = None
    for _ in range(most_rounds):
        seen = Observation()  # counted while the round is written; a task run twice only makes a round more
        new = written(round_of(edges).observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), "links")
        discard(edges)
        edges, found = new, seen.get
        if found == mark or not found["n"]:
            break
        mark = found
    else:
        raise RuntimeError("components did not settle")
    # settled: every edge joins a node to the least of its component
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
