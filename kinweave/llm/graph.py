"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import cut, discard


def connected_components(links: DataFrame) -> DataFrame:
    """(node, label) for each node of links (a, b: long); label is the smallest node of its component.

    Each step joins links to the least neighbour of their node and writes the result, so lineage stays short and no
    component ever meets in one task; a node with very many links is one aggregate and a join that Spark can split.
    """
    ends = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    ends, seen = cut(ends, "links"), None
    while True:
        now = ends.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen:
            break
        seen = now
        both = ends.unionByName(ends.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, ends = ends, cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        discard(last)
    return ends.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(ends.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
