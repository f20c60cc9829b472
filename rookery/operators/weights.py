"""Tables of network weights: merging, mapping, clipping, averaging, comparing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PLANES = 768
#: Piece worth in the initial piece-square table, and score units per unit of output.
START_VALUES = (126, 781, 825, 1276, 2538)
TO_SCORE = 600.0


def merge_virtual_weights(weights: DataFrame, virtual: DataFrame, period: int = PLANES, key: str = "in_idx") -> DataFrame:
    """Weights with the shared row (key modulo period) added: w + virtual."""
    shared = virtual.select(F.col(key).alias("__v"), "out_idx", F.col("w").alias("__w"))
    rows = weights.withColumn("__v", F.col(key) % period).join(shared, ["__v", "out_idx"], "left")
    return rows.withColumn("w", F.col("w") + F.coalesce("__w", F.lit(0.0))).select(*weights.columns)


def export_row_map(spark: SparkSession) -> DataFrame:
    """(dst, src): rows of the export layout with 11 piece planes from the 12-plane layout; 22 528 rows.

    The two king planes become one: of the own king's plane only the square of the bucket's own king is taken, the
    other squares come from the opposing king's plane.
    """
    rows = spark.range(32 * 11 * 64).select(F.col("id").cast("int").alias("dst"))
    bucket, plane, sq = F.floor(F.col("dst") / 704).cast("int"), F.floor(F.col("dst") / 64).cast("int") % 11, F.col("dst") % 64
    king = (7 - F.floor(bucket / 4)).cast("int") * 8 + (7 - bucket % 4)
    from_plane = F.when((plane == 10) & (sq != king), 11).otherwise(plane)
    return rows.select("dst", (bucket * PLANES + from_plane * 64 + sq).cast("int").alias("src"))


def remap_export_rows(weights: DataFrame, inverse: bool = False, key: str = "in_idx") -> DataFrame:
    """Weights renumbered from 12 to 11 piece planes, or back; the map has a fixed size and is broadcast. Rows without a place in the other layout are dropped."""
    names = ("dst", "src") if inverse else ("src", "dst")
    m = export_row_map(weights.sparkSession).select(F.col(names[0]).alias(key), F.col(names[1]).alias("__to"))
    return weights.join(F.broadcast(m), key).withColumn(key, F.col("__to")).select(*weights.columns)


def start_worth(in_idx: Column) -> Column:
    """What the piece of an input is worth at the start, negative for the other side's, the same on all squares; kings 0. Planes repeat every 768
    inputs, so an input of any number has its worth."""
    plane = F.pmod(F.floor(in_idx / 64), F.lit(12)).cast("int")
    worth = F.get(F.array(*map(F.lit, (*START_VALUES, 0))), F.floor(plane / 2).cast("int"))
    return F.when(plane % 2 == 0, worth).otherwise(-worth) / TO_SCORE


def initial_psqt(spark: SparkSession) -> DataFrame:
    """(in_idx, w), 24 576 rows: start_worth of the inputs of 32 king buckets."""
    return spark.range(32 * PLANES).select(F.col("id").cast("int").alias("in_idx")).select("in_idx", start_worth(F.col("in_idx")).alias("w"))


def weight_histogram(weights: DataFrame, bins: int, by: list[str], w: str = "w") -> DataFrame:
    """(by..., bin, n): counts in `bins` equal bins common to all, over the range of all weights widened by 0.001."""
    ends = weights.agg((F.min(w) - 0.001).alias("__lo"), (F.max(w) + 0.001).alias("__hi"))
    binned = weights.crossJoin(F.broadcast(ends)).withColumn("bin", F.floor((F.col(w) - F.col("__lo")) / ((F.col("__hi") - F.col("__lo")) / bins)).cast("int"))
    return binned.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))


def weight_extremes(weights: DataFrame, by: list[str], w: str = "w") -> DataFrame:
    """(by..., least, n_least, most, n_most)."""
    ends = weights.groupBy(*by).agg(F.min(w).alias("least"), F.max(w).alias("most"))
    return weights.join(ends, by).groupBy(*by, "least", "most").agg(F.count_if(F.col(w) == F.col("least")).alias("n_least"), F.count_if(F.col(w) == F.col("most")).alias("n_most"))


def quantization_overflow(weights: DataFrame, scale: float, bits: int, by: list[str], w: str = "w") -> DataFrame:
    """(by..., n, n_over, least, most): scaled, half-even rounded values beyond plus or minus the largest of the type."""
    most = 2 ** (bits - 1) - 1
    q = F.rint(F.col(w) * scale)
    rows = weights.withColumn("__q", q)
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs("__q") > most).alias("n_over"), F.min("__q").alias("least"), F.max("__q").alias("most"))


def clip_weights(weights: DataFrame, limit: float, virtual: DataFrame | None = None, period: int = PLANES, key: str = "in_idx") -> DataFrame:
    """Weights kept so that w, or w plus its shared row, lies within plus or minus limit."""
    clamp = lambda x, off: F.greatest(-F.lit(limit) - off, F.least(F.lit(limit) - off, x))
    if virtual is None:
        return weights.withColumn("w", clamp(F.col("w"), F.lit(0.0)))
    shared = virtual.select(F.col(key).alias("__v"), "out_idx", F.col("w").alias("__w"))
    rows = weights.withColumn("__v", F.col(key) % period).join(shared, ["__v", "out_idx"], "left")
    return rows.withColumn("w", clamp(F.col("w"), F.coalesce("__w", F.lit(0.0)))).select(*weights.columns)


def average_checkpoints(weights: DataFrame, start: int, key: list[str], epoch: str = "epoch", w: str = "w") -> DataFrame:
    """Mean of each parameter over epochs from start."""
    return weights.where(F.col(epoch) >= start).groupBy(*key).agg(F.avg(w).alias(w))


def weight_diff(net: DataFrame, ref: DataFrame, key: list[str], w: str = "w") -> DataFrame:
    """(key..., diff): net minus reference; a weight missing on one side counts 0."""
    both = net.select(*key, F.col(w).alias("__a")).join(ref.select(*key, F.col(w).alias("__b")), key, "full")
    return both.select(*key, (F.coalesce("__a", F.lit(0.0)) - F.coalesce("__b", F.lit(0.0))).alias("diff"))


def rank_neurons(weights: DataFrame, w: str = "w", out: str = "out_idx") -> DataFrame:
    """(out, norm, place) by descending sum of absolute weights, ties by number; one row per neuron of a layer is ranked in one task."""
    rows = weights.groupBy(out).agg(F.sum(F.abs(w)).alias("norm"))
    return rows.withColumn("place", F.row_number().over(W.orderBy(F.round("norm", 6).desc(), out)))

