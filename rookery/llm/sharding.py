"""Contiguous shards of equal bytes from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rookery.llm.storage import cut, join_dictionary


def byte_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot): rows in order of id cut into `shards` runs of near-equal bytes.

    size is the UTF-8 length plus 1. Rows are dealt into ranges of the id; the ranges' totals, one row each,
    give every range its offset, and a running sum inside the range gives each row its global byte position.
    The shard is decided by the position of the row's middle byte, so a shard differs from the equal share by
    less than one row at each end. slot numbers the rows of a shard from 0.

    Null ids come first. Null texts have size 1 and the crc of no bytes. Rows with equal ids are ordered by
    crc and size, and a range may end between them. An empty table gives an empty result; other columns are left out.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("crc"),
        F.monotonically_increasing_id().alias("row"),
    )
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(rows.repartitionByRange(n, "id", "crc", "size", "row").withColumn("part", F.spark_partition_id()), "ranges")
    order = ("id", "crc", "size", "row")
    # the shard a row is in, from its byte position; and how many rows each (range, shard) holds
    totals = dealt.groupBy("part").agg(F.sum("size").alias("bytes"))
    by_part = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("bytes").over(by_part), F.lit(0)).alias("before"), F.sum("bytes").over(W.partitionBy()).alias("all"))
    offsets = cut(offsets, "offsets")
    running = W.partitionBy("part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    placed = join_dictionary(dealt, offsets, "part").withColumn("end", F.col("before") + F.sum("size").over(running))
    middle = (F.col("end") - F.col("size") / 2) * shards / F.col("all")
    placed = placed.withColumn("shard", F.least(F.floor(middle).cast("int"), F.lit(shards - 1)))
    counts = placed.groupBy("part", "shard").agg(F.count(F.lit(1)).alias("n"))
    so_far = W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    firsts = cut(counts.select(F.struct("part", "shard").alias("cell"), F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("first")), "cells")
    inside = W.partitionBy("part", "shard").orderBy(*order)
    placed = placed.withColumn("k", F.row_number().over(inside) - 1).withColumn("cell", F.struct("part", "shard"))
    out = join_dictionary(placed, firsts, "cell")
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("first") + F.col("k")).alias("slot"))
