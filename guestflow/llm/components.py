"""Connected components of a link table by alternating star contraction."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guestflow.llm.common import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``; root is the smallest node reachable.

    Large-star and small-star steps in turn (Kiveris et al. 2014): both only
    group by node and take minima, so a node with very many links costs map-side
    minima and a join that AQE can split, never one collected group. Each round
    is written to the shared checkpoint folder; the number of rounds grows with
    the logarithm of the longest path. Rows with a null end and self-links are
    no links. An empty table gives an empty result."""
    e = stored(edges.where("a is not null and b is not null and a <> b")
               .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    seen = _state(e)
    while seen[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        e = stored(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                   .unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = _state(e)
        if now == seen:
            break
        seen = now
    return (e.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))


def _state(e: DataFrame) -> tuple:
    """Row count and an order-free checksum: equal twice running means nothing moved."""
    r = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"),
              F.sum(F.xxhash64("v", "u").bitwiseAND((1 << 31) - 1)).alias("s")).first()
    return r["n"], r["x"], r["s"]
