"""Connected components by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rookery.llm.storage import cut, drop_cut


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first())


def connected_components(edges: DataFrame, src: str, dst: str, max_steps: int = 60) -> DataFrame:
    """(node, component) for every node of the undirected edges; component is the smallest node reachable.

    Loops, repeated edges and edges with a null end are allowed; the last give nothing. Each step joins every
    edge to the smallest neighbour of its end, which is aggregated on the map side first, so that a node with
    very many edges meets one row only. The number of steps grows with the logarithm of the longest path.
    """
    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
    e = e.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col("u") != F.col("v"))).distinct()
    e = cut(e, "edges")
    nodes = e.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    first, before = e, _state(e)
    for _ in range(max_steps):
        if not before[0]:
            break
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # what is left of u itself: its edge to the smallest neighbour
        large = large.union(low.where("u <> m").select("u", F.col("m").alias("v"))).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        step = cut(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        if e is not first:
            drop_cut(e)
        e, now = step, _state(step)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"no fixed point after {max_steps} steps")
    return nodes.join(e.withColumnRenamed("u", "node"), "node", "left").select("node", F.coalesce("v", "node").alias("component"))
