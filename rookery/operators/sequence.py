"""Operators that need the order of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from rookery.functions.folders import shared_folder
from rookery.functions.hashing import stable_normal


#: Rows in a range, of which a task takes one.
RANGE_ROWS = 1_000_000


def in_ranges(df: DataFrame, keys: list[str], ranges: int | None = None) -> DataFrame:
    """df with __part, as a table: rows dealt into ranges of the keys' order, by default as many as keep one at about RANGE_ROWS. A key
    with very many rows goes over several ranges, one after the other."""
    n = ranges or max(1, -(-df.count() // RANGE_ROWS))
    path = shared_folder(df.sparkSession, "ranges")
    dealt = df.repartitionByRange(n, *keys).withColumn("__part", F.spark_partition_id())
    dealt.write.parquet(path)
    return df.sparkSession.read.schema(dealt.schema).parquet(path)


def with_carried(rows: DataFrame, key: str, found: DataFrame, carry: Callable[[Column, WindowSpec], Column], name: str) -> DataFrame:
    """rows of in_ranges with `name`: what `carry` makes, for the rows of a key in a range, of `found`, a row (key, __part, x) per key and
    range, over the key's ranges before. Only keys that go over several ranges have any, at most one a range, so these few rows
    are what is sent to all tasks."""
    before = W.partitionBy(key).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    told = found.select(F.col(key).alias("__key"), F.col("__part").alias("__at"), carry(F.col("x"), before).alias(name)).where(F.col(name).isNotNull())
    on = F.col(key).eqNullSafe(F.col("__key")) & (F.col("__part") == F.col("__at"))
    return rows.join(F.broadcast(told), on, "left").drop("__key", "__at")


def assign_game_id(df: DataFrame, partition: str, order: list[str], result: str = "result", ply: str = "ply", fen: str | None = None, next_fen: str | None = None, ranges: int | None = None) -> DataFrame:
    """df with game_no, numbered from 1 in each partition: a new game begins unless the result is the negative of the row
    before, the ply one higher, and (if both are given) the FEN the one that row leads to.

    A partition is no task: rows are dealt into ranges of (partition, order), each of which tells its last row and how many games
    begin in it, and these are carried over the ranges that follow. Rows that are equal in the whole order may come in any."""
    rows = in_ranges(df, [partition, *order], ranges)
    tail = F.struct(result, ply, *([next_fen] if fen and next_fen else []))
    last = rows.groupBy(partition, "__part").agg(F.max_by(tail, F.struct(*order)).alias("x"))
    rows = with_carried(rows, partition, last, lambda x, w: F.last(x).over(w), "__before")
    w = W.partitionBy(partition, "__part").orderBy(*order)
    before = F.coalesce(F.lag(tail).over(w), F.when(F.row_number().over(w) == 1, F.col("__before")))
    rows = rows.withColumn("__lag", before)
    goes_on = (F.col(result) == -F.col("__lag")[result]) & (F.col(ply) == F.col("__lag")[ply] + 1)
    if fen and next_fen:
        goes_on &= F.col(fen) == F.col("__lag")[next_fen]
    rows = rows.withColumn("__begins", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
    begun = rows.groupBy(partition, "__part").agg(F.sum("__begins").alias("x"))
    rows = with_carried(rows, partition, begun, lambda x, w: F.sum(x).over(w), "__games")
    number = F.sum("__begins").over(w.rowsBetween(W.unboundedPreceding, 0)) + F.coalesce("__games", F.lit(0))
    return rows.select(*df.columns, number.alias("game_no"))


def last_known(df: DataFrame, key: str, order: str, value: Column, name: str, ranges: int | None = None) -> DataFrame:
    """df with `name`: the last value that isn't null of the rows of the same key before, in order; carried over ranges as in assign_game_id."""
    rows = in_ranges(df.withColumn("__value", value), [key, order], ranges)
    found = rows.groupBy(key, "__part").agg(F.max_by("__value", F.when(F.col("__value").isNotNull(), F.col(order))).alias("x"))
    rows = with_carried(rows, key, found, lambda x, w: F.last(x, ignorenulls=True).over(w), "__carried")
    inside = F.last("__value", ignorenulls=True).over(W.partitionBy(key, "__part").orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    return rows.withColumn(name, F.coalesce(inside, "__carried")).drop("__value", "__carried", "__part")


def decayed_average(df: DataFrame, run: str, order: list[str], value: str, decay: float = 0.995, buckets: Column | None = None) -> DataFrame:
    """(run, n, average): values of each run weighted by decay ** (rows since), null values left out.

    `buckets`, which must not fall as the order rises, cuts each run into stretches, by default ranges of the order: their counts, one
    row each, tell how many rows come later, so that no task needs a whole run; sums are made on the map side first.
    """
    rows = df.where(F.col(value).isNotNull()).select(run, *order, F.col(value).cast("double").alias("__v"), *([] if buckets is None else [buckets.alias("__b")]))
    rows = in_ranges(rows, [run, *order]).withColumnRenamed("__part", "__b") if buckets is None else rows
    counts = rows.groupBy(run, "__b").agg(F.count(F.lit(1)).alias("__n"))
    later = F.sum("__n").over(W.partitionBy(run).orderBy(F.col("__b").desc()).rowsBetween(W.unboundedPreceding, 0))
    inside = F.row_number().over(W.partitionBy(run, "__b").orderBy(*order))
    aged = rows.withColumn("__k", inside).join(counts.withColumn("__later", later).drop("__n"), [run, "__b"])
    weight = F.pow(F.lit(decay), F.col("__later") - F.col("__k"))
    sums = aged.groupBy(run).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("__v") * weight).alias("__s"), F.sum(weight).alias("__w"))
    return sums.select(run, "n", (F.col("__s") / F.col("__w")).alias("average"))


def throughput(df: DataFrame, run: str = "run_id", step: str = "step", ts: str = "ts", total: str | None = None, every: int = 10) -> DataFrame:
    """(run, step, rate, eta_s): steps per second since the sample before, at every tenth step. A falling or equal step starts anew."""
    sampled = df.where(F.col(step) % every == 0)
    w = W.partitionBy(run).orderBy(ts, step)
    gone = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))
    steps = F.col(step) - F.lag(step).over(w)
    out = sampled.withColumns({"__s": steps, "__t": gone / 1e6})
    out = out.where("__s > 0 AND __t > 0").withColumn("rate", F.col("__s") / F.col("__t"))
    eta = (F.col(total) - F.col(step)) / F.col("rate") if total else F.lit(None).cast("double")
    return out.select(run, step, "rate", eta.alias("eta_s"))


def first_non_finite(df: DataFrame, run: str = "run_id", step: str = "step", phases: Iterable[str] = ("train_loss", "val_loss")) -> DataFrame:
    """(run, phase, step): the first step at which a loss was NaN or infinite. Missing losses don't count."""
    long = df.unpivot([run, step], list(phases), "phase", "loss")
    bad = F.isnan("loss") | (F.abs("loss") == float("inf"))
    return long.where(F.col("loss").isNotNull() & bad).groupBy(run, "phase").agg(F.min(step).alias("step"))


def run_status(df: DataFrame, epochs: int, run: str = "run_id", epoch: str = "epoch", step: str = "step", total: str = "steps_total") -> DataFrame:
    """(run, last_epoch, last_step, finished): finished if the last line is of the last epoch and 90 % through it."""
    last = df.groupBy(run).agg(F.max(F.struct(F.col(epoch).alias("e"), F.col(step).alias("s"), F.col(total).alias("t"))).alias("l"))
    done = (F.col("l.e") == epochs - 1) & (F.col("l.s") >= F.col("l.t") * 0.9)
    return last.select(run, F.col("l.e").alias("last_epoch"), F.col("l.s").alias("last_step"), done.alias("finished"))


#: Entries of a series that one fold takes.
FOLD = 256


def decayed_series(df: DataFrame, at: str, value: str, decay: float, out: str = "series") -> DataFrame:
    """(at, out) of a gapless series numbered from 0: out is value plus decay times the out before it.

    A fold runs over FOLD entries; what it ends with is carried to the next ones as a series of its own, with decay ** FOLD, so no task
    sees more than FOLD entries at a time, and the levels grow with the logarithm of the length. Powers are of decay only, never of
    its inverse, so nothing overflows."""
    rows = df.select(F.col(at).cast("long").alias("at"), F.col(value).cast("double").alias("x")).withColumn("run", F.floor(F.col("at") / FOLD))
    held = rows.groupBy("run").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("xs"))
    step = lambda acc, e: F.concat(acc, F.array(F.struct(e["at"].alias("at"), (F.coalesce(F.element_at(acc, -1)["s"], F.lit(0.0)) * decay + e["x"]).alias("s"))))
    first = lambda xs: F.array(F.struct(xs[0]["at"].alias("at"), xs[0]["x"].alias("s")))
    folded = held.select("run", F.aggregate(F.slice("xs", F.lit(2), F.lit(FOLD)), first(F.col("xs")), step).alias("ys"))
    inside = folded.select("run", F.inline("ys"))
    if (df.agg(F.max(at)).first()[0] or 0) < FOLD:
        return inside.select(F.col("at").alias(at), F.col("s").alias(out))
    ends = folded.select("run", F.element_at("ys", -1)["s"].alias("end"))
    carried = decayed_series(ends, "run", "end", decay**FOLD, "carry").select((F.col("run") + 1).alias("run"), "carry")
    power = F.pow(F.lit(decay), (F.col("at") - F.col("run") * FOLD + 1).cast("double"))
    both = inside.join(carried, "run", "left")
    return both.select(F.col("at").alias(at), (F.col("s") + F.coalesce(F.col("carry"), F.lit(0.0)) * power).alias(out))


def batch_jitter(batches: DataFrame, batch: str, sigma: float, decay: float, salt: str = "batch") -> DataFrame:
    """(batch, jitter) for batches numbered from 0 without gaps: noise carried from batch to batch, each time times decay plus a new
    draw by the batch's number, of deviation sigma * sqrt(1 - decay ** 2), so that in the long run its deviation is sigma."""
    drawn = batches.select(batch, (stable_normal(F.col(batch), salt) * sigma * (1 - decay**2) ** 0.5).alias("draw"))
    return decayed_series(drawn, batch, "draw", decay, "jitter")
