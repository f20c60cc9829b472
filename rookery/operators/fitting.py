"""Fits whose sums Spark works out and whose few parameters the driver steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rookery.functions.evalmath import sigmoid

#: Fixed value: where the scale starts.
START = 1 / 361


#: Damping of the first step, and by what it grows and falls.
DAMPING, CHANGE = 1e-3, 10.0


def fit_sigmoid_scale(performance: DataFrame, start: float = START, steps: int = 60, tolerance: float = 1e-12) -> tuple[float, float]:
    """(k, 1/k) of sigmoid(k * bucket) fitted to means with sigma 1/n: a bucket weighs n squared.

    Gauss-Newton steps with damping: a step that doesn't lower the sum of squares is taken back, and the next is shorter, so
    the fit stands still at a minimum and doesn't run off. performance is score_bucket_performance's table, small and read
    once per step; it is cached while the fit runs. Without buckets k stays at `start`.
    """
    rows = performance.select(F.col("bucket").cast("double").alias("x"), "mean", F.col("n").cast("double").alias("n")).cache()

    def at(k: float) -> tuple[float, float, float]:
        s = sigmoid(F.col("x") * k)
        slope, off, n2 = F.col("x") * s * (1 - s), F.col("mean") - s, F.col("n") * F.col("n")
        return tuple(rows.agg(F.sum(n2 * off * off), F.sum(n2 * slope * off), F.sum(n2 * slope * slope)).first())

    k, damping = start, DAMPING
    try:
        cost, a, b = at(k)
        for _ in range(steps):
            if not b:
                break
            step = a / (b * (1 + damping))
            there = at(k + step)
            if there[0] < cost:
                k, (cost, a, b), damping = k + step, there, damping / CHANGE
            else:
                damping *= CHANGE
            if abs(step) < tolerance * abs(k):
                break
    finally:
        rows.unpersist()
    return k, 1 / k


def sigmoid_scale_steps(performance: DataFrame, steps: int = 3, start: float = START) -> DataFrame:
    """(step, k) of the first Gauss-Newton steps as one plan, each step a one-row table joined to the next."""
    k = performance.sparkSession.range(1).select(F.lit(0).alias("step"), F.lit(start).alias("k"))
    out = k
    for i in range(1, steps + 1):
        s = sigmoid(F.col("bucket").cast("double") * F.col("k"))
        slope = F.col("bucket") * s * (1 - s)
        n2 = F.col("n").cast("double") * F.col("n").cast("double")
        both = performance.crossJoin(F.broadcast(k.select("k")))  # one row
        moved = both.groupBy("k").agg((F.sum(n2 * slope * (F.col("mean") - s)) / F.sum(n2 * slope * slope)).alias("d"))
        k = moved.select(F.lit(i).alias("step"), (F.col("k") + F.col("d")).alias("k"))
        out = out.unionByName(k)
    return out
