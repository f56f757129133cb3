"""Connected components of an edge table by alternating large and small stars.

Every half round is a minimum per node, aggregated before it is shuffled, and a join back; what a
half round made is written and read again, so lost executors cost one half round. A node with very
many edges is many rows of a join that adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedgate.sources.scratch import save


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b: long); root is the smallest node of its component.

    Loops and null ends are ignored, repeated edges count once; no edges give no rows.
    """
    high, low = F.greatest("a", "b"), F.least("a", "b")
    pairs = edges.where("a <> b").select(high.alias("a"), low.alias("b")).distinct()
    pairs = save(pairs, "edges")
    before = None
    while True:
        pairs = save(_star(_both(pairs), larger=True), "large-star")
        pairs = save(_star(pairs, larger=False), "small-star")
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = pairs.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _both(pairs: DataFrame) -> DataFrame:
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(pairs: DataFrame, *, larger: bool) -> DataFrame:
    """Hangs the larger (or, where pairs point down, all) neighbours of each node on its smallest one."""
    least = save(pairs.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m")), "least")
    hung = pairs.where("b > a") if larger else pairs
    joined = hung.join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not larger:
        joined = joined.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return joined.where("a <> b").distinct()
