"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

Every step is a partial aggregation to a minimum and an equi-join; a hub with a third of all links is
neither gathered in one task nor on the driver. Minima are cut by a checkpoint before they are joined: both
sides of the join are then dealt out anew, and Spark splits the rows of a hub over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Steps are about the square of the logarithm of the nodes at most: 2,500 for 2**50; real links take under ten.
MOST_STEPS = 2500
SALTS = 16


def _digest(edges: DataFrame) -> tuple:
    """A fingerprint of a set of edges: how many there are and two order-free sums of hashes."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.pmod(h, F.lit(2**31 - 1))), F.bit_xor(h)).first())


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(u, v)``; the root is the component's smallest node.

    Loops and repeated edges are harmless. No edges give no rows.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = cut(e)
    before, steps = _digest(e), 0
    while before[0]:
        if (steps := steps + 1) > MOST_STEPS:
            raise RuntimeError(f"components not stable after {MOST_STEPS} steps")
        # Large star: a node's larger neighbours move to the smallest node next to it.
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        e = cut(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # Small star: a node and its smaller neighbours move to the smallest of them.
        least = cut(e.groupBy("u").agg(F.min("v").alias("m")))
        moved = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(moved.union(least.select("u", F.col("m").alias("v"))).distinct())
        after = _digest(e)
        if after == before:
            break
        before = after
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    # In two steps, else the task of a hot root reads a row from every partition.
    own = e.select("v", F.pmod("u", F.lit(SALTS)).alias("salt")).distinct().select("v").distinct()
    return roots.union(own.select(F.col("v").alias("node"), F.col("v").alias("root")))
