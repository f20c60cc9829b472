"""What evaluations say about results, and how two evaluators or two nets differ."""

from __future__ import annotations

import math
import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rookery.functions.evalmath import LossParams, blend_target, expected_score, outcome, pointwise_loss, remap_mate_score

#: Offset and scaling with which evaluators are compared, the floor of relative errors, and the sigma shares.
COMPARE_OFFSET, COMPARE_SCALING, RELATIVE_FLOOR = 280.0, 353.0, 1 / 32
SIGMAS = (0.6827, 0.9545, 0.9973)


def score_bucket_performance(df: DataFrame, size: int = 16, score: str = "score", result: str = "result") -> DataFrame:
    """(bucket, total, n, mean, sigma): outcomes by score rounded half-even to multiples of size; sigma is 1/n."""
    bucket = (F.rint(F.col(score) / F.lit(float(size))) * size).cast("bigint")
    rows = df.groupBy(bucket.alias("bucket")).agg(F.sum(outcome(F.col(result))).alias("total"), F.count(F.lit(1)).alias("n"))
    return rows.select("bucket", "total", "n", (F.col("total") / F.col("n")).alias("mean"), (1 / F.col("n")).alias("sigma"))


def distribution(df: DataFrame, column: str, largest: int) -> DataFrame:
    """(value, n, share): values above `largest` are counted at largest + 1; values that don't occur have no row."""
    rows = df.where(F.col(column).isNotNull()).groupBy(F.least(F.col(column), F.lit(largest + 1)).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy()))


def join_evals(ref: DataFrame, cmp: DataFrame, key: str, ref_col: str = "score", cmp_col: str = "score") -> DataFrame:
    """(key, ref, cmp) of two evaluators' tables; an error if a key of one is missing from the other."""
    left = ref.select(key, F.col(ref_col).alias("ref"))
    right = cmp.select(key, F.col(cmp_col).alias("cmp"))
    lost = F.raise_error(F.lit("the evaluators don't cover the same keys")).cast("double")
    both = left.withColumn("__l", F.lit(True)).join(right.withColumn("__r", F.lit(True)), key, "full")
    whole = F.col("__l").isNotNull() & F.col("__r").isNotNull()
    return both.select(key, F.when(whole, F.col("ref").cast("double")).otherwise(lost).alias("ref"), F.when(whole, F.col("cmp").cast("double")).otherwise(lost).alias("cmp"))


def with_errors(pairs: DataFrame) -> DataFrame:
    """pairs (ref, cmp) with abs_err, rel_err, q_ref, q_cmp and q_err."""
    ref, cmp = F.col("ref").cast("double"), F.col("cmp").cast("double")
    out = pairs.withColumns({"abs_err": F.abs(cmp - ref), "q_ref": expected_score(ref, COMPARE_OFFSET, COMPARE_SCALING), "q_cmp": expected_score(cmp, COMPARE_OFFSET, COMPARE_SCALING)})
    return out.withColumns({"rel_err": F.col("abs_err") / F.greatest(F.abs(ref), F.lit(RELATIVE_FLOOR)), "q_err": F.abs(F.col("q_cmp") - F.col("q_ref"))})


def compare_evals(pairs: DataFrame) -> DataFrame:
    """One row: ranges, mean errors, and R squared of scores and of expected scores.

    The means come first, in a row of their own that is broadcast, so that sums of squares are taken about them.
    """
    e = with_errors(pairs)
    means = e.agg(F.avg("ref").alias("__m"), F.avg("q_ref").alias("__mq"))
    about = e.crossJoin(F.broadcast(means))
    square = lambda c: F.sum(c * c)
    r2 = lambda res, tot: F.when(tot != 0, 1 - res / tot).otherwise(0.0)
    rows = about.agg(
        F.count(F.lit(1)).alias("n"), F.min("ref").alias("ref_min"), F.max("ref").alias("ref_max"), F.avg(F.abs("ref")).alias("ref_abs"),
        F.min("cmp").alias("cmp_min"), F.max("cmp").alias("cmp_max"), F.avg(F.abs("cmp")).alias("cmp_abs"),
        F.avg("abs_err").alias("abs_err"), F.avg("rel_err").alias("rel_err"), F.avg("q_err").alias("q_err"),
        square(F.col("ref") - F.col("cmp")).alias("__res"), square(F.col("ref") - F.col("__m")).alias("__tot"),
        square(F.col("q_ref") - F.col("q_cmp")).alias("__resq"), square(F.col("q_ref") - F.col("__mq")).alias("__totq"),
    )
    return rows.select(*[c for c in rows.columns if c[:2] != "__"], r2(F.col("__res"), F.col("__tot")).alias("r2_score"), r2(F.col("__resq"), F.col("__totq")).alias("r2_q"))


def exact_quantiles(df: DataFrame, column: str, shares: tuple[float, ...], cells: int = 4096) -> list[float | None]:
    """Quantiles with linear interpolation between the two values about a share, as percentile gives them, in bounded memory.

    Each pass counts, for the ranges that still hold a wanted place, how many values fall into each of `cells` cells of the range, and
    keeps the cell that holds the place, with the least and largest value it really has; a range of one value is done. Only
    counts of cells come to the driver, at most `cells` for each wanted place and pass. Nulls and
    NaNs are left out; infinite values count as the largest finite ones."""
    most = sys.float_info.max
    values = df.select(F.col(column).cast("double").alias("x")).where("x IS NOT NULL AND NOT isnan(x)").select(F.greatest(F.lit(-most), F.least(F.lit(most), F.col("x"))).alias("x"))
    n, low, high = values.agg(F.count(F.lit(1)), F.min("x"), F.max("x")).first()
    if not n:
        return [None] * len(shares)
    places = [p * (n - 1) for p in shares]
    # wanted place -> (least value, largest value, values below) of the range it is in
    ranges = {k: (low, high, 0) for p in places for k in (math.floor(p), math.ceil(p))}
    while todo := sorted({r for r in ranges.values() if r[0] < r[1]}):
        unit = lambda lo, hi: 0.5 if math.isinf(hi - lo) else 1.0
        cell = lambda lo, hi: F.least(F.floor((F.col("x") * unit(lo, hi) - lo * unit(lo, hi)) / (hi * unit(lo, hi) - lo * unit(lo, hi)) * cells), F.lit(cells - 1))
        which = [F.when(F.col("x").between(lo, hi), F.struct(F.lit(i).alias("range"), cell(lo, hi).alias("cell"))) for i, (lo, hi, _) in enumerate(todo)]
        rows = values.select("x", F.explode(F.array_compact(F.array(*which))).alias("c"))
        counted = rows.groupBy("c.range", "c.cell").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("range", "cell").collect()
        for k, r in list(ranges.items()):
            if r in todo:
                below = r[2]
                for c in (c for c in counted if c["range"] == todo.index(r)):
                    if k < below + c.n:
                        ranges[k] = (c.lo, c.hi, below)
                        break
                    below += c.n
    at = {k: r[0] for k, r in ranges.items()}
    return [at[math.floor(p)] + (p - math.floor(p)) * (at[math.ceil(p)] - at[math.floor(p)]) for p in places]


def error_quantiles(pairs: DataFrame, shares: tuple[float, ...] = SIGMAS, exact: bool = False, accuracy: int = 10_000) -> DataFrame:
    """(share, abs_err, q_err): approximate quantiles in one mergeable pass of bounded memory, or (exact) with linear interpolation,
    by a few passes that narrow ranges (exact_quantiles)."""
    e = with_errors(pairs)
    if exact:
        found = [exact_quantiles(e, c, shares) for c in ("abs_err", "q_err")]
        return pairs.sparkSession.createDataFrame(list(zip(shares, *found, strict=True)), "share double, abs_err double, q_err double")
    row = e.agg(*[F.percentile_approx(c, F.lit(p), accuracy).alias(f"{c}_{i}") for i, p in enumerate(shares) for c in ("abs_err", "q_err")])
    per = [F.struct(F.lit(p).alias("share"), F.col(f"abs_err_{i}").alias("abs_err"), F.col(f"q_err_{i}").alias("q_err")) for i, p in enumerate(shares)]
    return row.select(F.explode(F.array(*per)).alias("x")).select("x.*")


def worst_offenders(pairs: DataFrame, metric: str, key: str, k: int = 5) -> DataFrame:
    return with_errors(pairs).orderBy(F.col(metric).desc(), key).limit(k)


def loss_columns(net: Column, score: Column, result_share: Column, p: LossParams = LossParams()) -> Column:
    """struct(loss, weight) of a net's value against a score and an outcome."""
    qf = expected_score(net, p.in_offset, p.in_scaling)
    pf = expected_score(remap_mate_score(score), p.out_offset, p.out_scaling)
    return pointwise_loss(qf, blend_target(pf, result_share, p.lam), pf, p)


def weighted_loss(df: DataFrame, net: str, score: str, result_share: Column, p: LossParams = LossParams(), by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., loss): sum of loss * weight over sum of weight."""
    x = loss_columns(F.col(net), F.col(score), result_share, p)
    return df.select(*by, x.alias("x")).groupBy(*by).agg((F.sum(F.col("x.loss") * F.col("x.weight")) / F.sum("x.weight")).alias("loss"))


def epoch_loss(df: DataFrame, run: str = "run_id", rank: str = "rank", epoch: str = "epoch", loss: str = "train_loss") -> DataFrame:
    """(run, epoch, loss): mean of batch losses per rank, then mean over ranks."""
    per_rank = df.groupBy(run, epoch, rank).agg(F.avg(loss).alias("l"))
    return per_rank.groupBy(run, epoch).agg(F.avg("l").alias("loss"))


def loss_curve(df: DataFrame, reach: float, run: str = "run_id", step: str = "step", loss: str = "val_loss", how: str = "min") -> DataFrame:
    """(run, step, loss): values below the run's least plus `reach`, then least, largest or mean per step."""
    lowest = df.groupBy(run).agg(F.min(loss).alias("__low"))
    near = df.join(lowest, run).where(F.col(loss) < F.col("__low") + reach)
    return near.groupBy(run, step).agg({"min": F.min, "max": F.max, "avg": F.avg}[how](loss).alias("loss"))
