"""Connected components by alternating large-star and small-star steps.

Kiveris et al., "Connected Components in MapReduce and Beyond" (SoCC 2014):
edges move towards the smallest known node, in a number of rounds that grows
with the logarithm of the component size.  Each step is two aggregations and a
join whose key is spread over chunks, so a hub is never one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ranks import attach_group_values

SPREAD = 64


def _with_minimum(pairs: DataFrame) -> DataFrame:
    """Add to each (u, v) the smallest of u and its neighbours."""
    chunked = pairs.withColumn("_chunk", F.pmod(F.xxhash64("v"), F.lit(SPREAD)))
    least = chunked.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return attach_group_values(chunked, least, ["u"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (
        _with_minimum(both)
        .filter(F.col("v") > F.col("u"))
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .filter("u <> v")
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    known = _with_minimum(down)
    return (
        known.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(known.select("u", F.col("m").alias("v")))
        .filter("u <> v")
        .distinct()
    )


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return tuple(row)


def connected_components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for ``nodes(node)`` and ``edges(u, v)``; the label is the smallest node."""
    current = cut_lineage(
        edges.select("u", "v").filter("u <> v").distinct()
    )
    before = None
    for _ in range(max_rounds):
        current = cut_lineage(_small_star(_large_star(current)))
        after = _state(current)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    labels = current.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("_label"))
    return (
        nodes.select("node")
        .distinct()
        .join(labels, "node", "left")
        .select("node", F.coalesce("_label", "node").alias("component"))
    )
