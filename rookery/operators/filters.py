"""Which records to train on: rules in a fixed order, an audit of them, and balance over piece counts."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rookery.functions.board import material_eval, parse_fen
from rookery.functions.evalmath import NO_SCORE, result_prob
from rookery.functions.hashing import stable_uniform
from rookery.operators.features import is_quiet
from rookery.operators.sequence import last_known

#: A piece count is thinned to no less than this share.
LEAST_SHARE = 0.025


@dataclass(frozen=True)
class SkipConfig:
    """Rules of the record filter. 0 or less turns thin_random, soft_early and least_material off, -1 turns early off."""

    quiet: bool = True
    by_result: bool = True
    thin_random: int = 0
    early: int = -1
    soft_early: int = 20
    least_material: int = -1
    piece_count_y: tuple[float, ...] = (0.0, 0.4, 1.0, 1.0, 0.75)
    soft_points: tuple[tuple[float, float], ...] = ((0.0, 0.1), (6.0, 0.15), (10.0, 0.25), (18.0, 0.75))
    balance: bool = True

    @property
    def off(self) -> bool:
        """With these five off nothing at all is filtered, not even records without a score."""
        return not self.quiet and not self.by_result and self.thin_random <= 0 and self.early < 0 and self.soft_early <= 0


def activation_sampling_config(cfg: SkipConfig, thin_random: int = 10) -> SkipConfig:
    """cfg for sampling activations: quiet positions only, and thinned at least by thin_random."""
    return replace(cfg, quiet=True, thin_random=max(cfg.thin_random, thin_random))


def drop_invalid_score(df: DataFrame, score: str = "score") -> DataFrame:
    return df.where(F.col(score) != NO_SCORE)


def _known(score: Column) -> Column:
    return F.when(~score.isin(0, NO_SCORE), score)


def _stands_for_none(score: Column, result: Column, last: Column) -> Column:
    return (score == 0) & (result != 0) & F.coalesce(F.abs(last) > 100, F.lit(False))


def is_placeholder_zero(score: Column, result: Column, game: Column, ply: Column) -> Column:
    """A score of 0 in a decisive game after a clear last known score: it stands for none. For games that fit a task."""
    last = F.last(_known(score), ignorenulls=True).over(W.partitionBy(game).orderBy(ply).rowsBetween(W.unboundedPreceding, -1))
    return _stands_for_none(score, result, last)


def drop_placeholder_zero(df: DataFrame, game: str = "game_id", ply: str = "ply", score: str = "score", result: str = "result", ranges: int | None = None) -> DataFrame:
    """df without placeholder zeros; a game of any length goes over ranges of its plies, see sequence.last_known."""
    told = last_known(df, game, ply, _known(F.col(score)), "__last", ranges)
    return told.where(~F.coalesce(_stands_for_none(F.col(score), F.col(result), F.col("__last")), F.lit(False))).select(*df.columns)


def drop_early(df: DataFrame, n: int, ply: str = "ply") -> DataFrame:
    return df.where(F.col(ply) > n)


def thin_random(df: DataFrame, n: int, key: str, salt: str = "random") -> DataFrame:
    """Keep one in n + 1."""
    return df.where(stable_uniform(key, salt) >= n / (n + 1)) if n > 0 else df


def thin_by_result_prob(df: DataFrame, key: str, score: str = "score", ply: str = "ply", result: str = "result", salt: str = "result") -> DataFrame:
    """Keep with the chance that the win model gives to the game's result."""
    return df.where(stable_uniform(key, salt) < result_prob(F.col(score), F.col(ply), F.col(result)))


def drop_balanced_material(df: DataFrame, material: Column, least: int) -> DataFrame:
    return df.where(F.abs(material) >= least) if least > 0 else df


def soft_early_rates(cfg: SkipConfig) -> list[float]:
    """Keep rate of each ply up to cfg.soft_early: linear between the points, constant before the first, 1 from soft_early on."""
    at, rate = (list(c) for c in zip(*cfg.soft_points, strict=True))
    if cfg.soft_early > at[-1]:
        at, rate = [*at, cfg.soft_early], [*rate, 1.0]
    rates = np.interp(np.arange(max(cfg.soft_early, 0)), at, rate)
    return [*np.clip(rates, 0.0, 1.0).tolist(), 1.0]


def thin_soft_early(df: DataFrame, key: str, cfg: SkipConfig = SkipConfig(), ply: str = "ply", salt: str = "soft") -> DataFrame:
    if cfg.soft_early <= 0:
        return df
    rate = F.get(F.array(*map(F.lit, soft_early_rates(cfg))), F.col(ply).cast("int"))
    return df.where((F.col(ply) >= cfg.soft_early) | (stable_uniform(key, salt) < rate))


def piece_count_weight(pc: Column, y: tuple[float, ...]) -> Column:
    """Cubic Hermite spline through y at 0, 8, 16, 24 and 32 pieces, at least 0. Slopes are half the difference of the
    neighbours, and the whole difference at the ends."""
    i = F.least(F.floor(pc / 8), F.lit(3)).cast("int")
    knots = F.array(*map(F.lit, y))
    slopes = F.array(F.lit(y[1] - y[0]), *(F.lit((y[k + 1] - y[k - 1]) / 2) for k in (1, 2, 3)), F.lit(y[4] - y[3]))
    t = pc.cast("double") / 8 - i
    value = (
        (2 * t * t * t - 3 * t * t + 1) * F.get(knots, i) + (t * t * t - 2 * t * t + t) * F.get(slopes, i)
        + (3 * t * t - 2 * t * t * t) * F.get(knots, i + 1) + (t * t * t - t * t) * F.get(slopes, i + 1)
    )
    return F.greatest(F.lit(0.0), F.when(pc <= 0, F.lit(y[0])).when(pc >= 32, F.lit(y[4])).otherwise(value))


def piece_count_targets(spark: SparkSession, y: tuple[float, ...] = SkipConfig.piece_count_y) -> DataFrame:
    """(piece_count, w, total), 33 rows; all weights are 1 where the spline gives none."""
    rows = spark.range(33).select(F.col("id").cast("int").alias("piece_count"))
    rows = rows.withColumn("w", piece_count_weight(F.col("piece_count"), y))
    total = F.sum("w").over(W.partitionBy())
    rows = rows.withColumn("total", total)
    none = F.col("total") <= 0
    return rows.select("piece_count", F.when(none, 1.0).otherwise(F.col("w")).alias("w"), F.when(none, 33.0).otherwise(F.col("total")).alias("total"))


def piece_count_rates(df: DataFrame, y: tuple[float, ...] = SkipConfig.piece_count_y, pc: str = "piece_count", floor: float = LEAST_SHARE) -> DataFrame:
    """(piece_count, keep_rate), at most 33 rows: the share to keep so that the counts follow the weights, with the scarcest
    wanted count thinned to `floor` at least."""
    hist = df.where(F.col(pc).between(0, 32)).groupBy(F.col(pc).cast("int").alias("piece_count")).agg(F.count(F.lit(1)).alias("n"))
    ratio = hist.join(F.broadcast(piece_count_targets(df.sparkSession, y)), "piece_count")
    ratio = ratio.withColumn("ratio", F.sum("n").over(W.partitionBy()) * F.col("w") / (F.col("total") * F.col("n")))
    low = F.min(F.when(F.col("ratio") > 0, F.col("ratio"))).over(W.partitionBy())
    rate = F.when(low.isNull(), F.col("ratio")).otherwise(floor / low * F.col("ratio"))
    return ratio.select("piece_count", F.greatest(F.lit(0.0), F.least(F.lit(1.0), rate)).alias("keep_rate"))


def rebalance_by_piece_count(df: DataFrame, key: str, y: tuple[float, ...] = SkipConfig.piece_count_y, pc: str = "piece_count", floor: float = LEAST_SHARE, salt: str = "pieces") -> DataFrame:
    """Thin each piece count to its rate. The rates have 33 rows at most, so they are broadcast: no shuffle of df's rows."""
    rates = piece_count_rates(df, y, pc, floor).withColumnRenamed("piece_count", "__pc")
    return df.join(F.broadcast(rates), F.col(pc) == F.col("__pc")).where(stable_uniform(key, salt) < F.col("keep_rate")).drop("__pc", "keep_rate")


def reject_reason(cfg: SkipConfig, key: str | Column, placeholder: Column | None, quiet: Column | None, material: Column | None) -> Column:
    """Name of the first rule that rejects a row, null if none does. Columns score, result and ply are read."""
    score, ply = F.col("score"), F.col("ply")
    out = F.when(score == NO_SCORE, "no_score")
    if placeholder is not None:
        out = out.when(placeholder, "placeholder_zero")
    if cfg.early >= 0:
        out = out.when(ply <= cfg.early, "early")
    if cfg.thin_random > 0:
        out = out.when(stable_uniform(key, "random") < cfg.thin_random / (cfg.thin_random + 1), "random")
    if cfg.quiet and quiet is not None:
        out = out.when(~quiet, "not_quiet")
    if cfg.by_result:
        out = out.when(stable_uniform(key, "result") >= result_prob(score, ply, F.col("result")), "result")
    if cfg.least_material > 0 and material is not None:
        out = out.when(F.abs(material) < cfg.least_material, "material")
    if cfg.soft_early > 0:
        rate = F.get(F.array(*map(F.lit, soft_early_rates(cfg))), F.least(ply, F.lit(cfg.soft_early)).cast("int"))
        out = out.when((ply < cfg.soft_early) & (stable_uniform(key, "soft") >= rate), "soft_early")
    return out


def _prepared(df: DataFrame, cfg: SkipConfig, quiet: Column | None, material: Column | None) -> tuple[DataFrame, Column | None, Column | None]:
    """(df with what the rules that are on need, quiet, material): worked out from board columns or the FEN where it isn't given."""
    asks = {"quiet": cfg.quiet and quiet is None, "material": cfg.least_material > 0 and material is None, "piece_count": cfg.balance and "piece_count" not in df.columns}
    if not any(asks.values()):
        return df, quiet, material
    parsed = {"board", "white_to_move", "wk", "bk", "piece_count"}
    if not parsed <= set(df.columns):
        if "fen" not in df.columns:
            raise ValueError(f"these rules are on, but there is neither a column for them nor a fen: {', '.join(k for k, v in asks.items() if v)}")
        given = {c: F.col(c) for c in ("piece_count",) if c in df.columns}
        df = parse_fen(df).withColumns({"__given_" + c: F.col(f"__row.{c}") for c in given})
        df = df.withColumns({c: F.col("__given_" + c) for c in given})
    if asks["quiet"]:
        if {"move_from", "move_to"} <= set(df.columns):
            ends = F.col("move_from"), F.col("move_to")
        elif "move" in df.columns:
            ends = F.col("move")["from"], F.col("move")["to"]
        else:
            raise ValueError("the rule of quiet positions needs a column quiet, or move_from and move_to, or move")
        quiet = is_quiet(*ends)
    if asks["material"]:
        material = material_eval(F.col("board"), F.col("white_to_move"))
    return df, quiet, material


def apply_skip_config(df: DataFrame, cfg: SkipConfig, key: str | list[str], game: str | None = "game_id", quiet: Column | None = None, material: Column | None = None, audit: bool = False) -> DataFrame:
    """df less the rows that the rules reject, or with reject_reason for all rows (audit).

    key names the column, or columns, that tell rows apart: draws depend on it. Rules in order: no score, placeholder zero
    (needs game), early, random, quiet, result, material, soft early, then the balance of piece counts over the rows left.
    quiet and material may be given as columns; otherwise they, and piece_count, come from the columns of parse_fen or
    from `fen`, and a rule that is on and can't be judged is an error. One pass decides the first eight; the balance adds
    a histogram of 33 counts.
    """
    if cfg.off:
        return df.withColumn("reject_reason", F.lit(None).cast("string")) if audit else df
    names = df.columns
    drawn = F.concat_ws("/", *key) if isinstance(key, list) else F.col(key)
    placeholder = is_placeholder_zero(F.col("score"), F.col("result"), F.col(game), F.col("ply")) if game else F.lit(False)
    # the row as it came is kept aside: what the rules need may have names of its own
    held = df.withColumn("__placeholder", placeholder).withColumn("__row", F.struct(*names))
    flagged, quiet, material = _prepared(held, cfg, quiet, material)
    flagged = flagged.withColumn("reject_reason", reject_reason(cfg, drawn, F.col("__placeholder"), quiet, material))
    if cfg.balance:
        rates = piece_count_rates(flagged.where("reject_reason IS NULL"), cfg.piece_count_y).withColumnRenamed("piece_count", "__pc")
        flagged = flagged.join(F.broadcast(rates), F.col("piece_count") == F.col("__pc"), "left")
        gone = F.coalesce(stable_uniform(drawn, "pieces") >= F.col("keep_rate"), F.lit(True))
        flagged = flagged.withColumn("reject_reason", F.coalesce("reject_reason", F.when(gone, "piece_count")))
    return flagged.select("__row.*", "reject_reason") if audit else flagged.where("reject_reason IS NULL").select("__row.*")


def skip_audit(df: DataFrame, cfg: SkipConfig, key: str | list[str], **columns) -> DataFrame:
    """Rows per reason, `kept` among them."""
    reasons = apply_skip_config(df, cfg, key, audit=True, **columns)
    return reasons.groupBy(F.coalesce("reject_reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
