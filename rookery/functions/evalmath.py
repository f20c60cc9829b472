"""Scores, outcomes, probabilities, losses and ratings as column arithmetic."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from rookery.functions.hashing import stable_normal

#: The score that stands for none, and where mate scores begin.
NO_SCORE = 32002
MATE_SCORE = 32000
MATE_BOUND = 31755
#: Cubic coefficients in m = min(ply, 240) / 64 of the win model's offset and spread.
WIN_OFFSET = (-3.68389304, 30.07065921, -60.52878723, 149.53378557)
WIN_SPREAD = (-2.0181857, 15.85685038, -29.83452023, 47.59078827)
PAWN_VALUE = 208.0


def as_double(x: Column) -> Column:
    return x.cast("double")


def sigmoid(x: Column) -> Column:
    """1 / (1 + exp(-x)) without overflow at either end."""
    small = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + small)).otherwise(small / (1 + small))


def outcome(result: Column) -> Column:
    """-1, 0, 1 to 0, 0.5, 1."""
    return (as_double(result) + 1) / 2


def piece_bucket(pieces: Column) -> Column:
    """0 to 7 by groups of four piece counts."""
    return F.floor((pieces - 1) / 4).cast("int")


def _cubic(c: tuple[float, ...], m: Column) -> Column:
    return ((c[0] * m + c[1]) * m + c[2]) * m + c[3]


def wdl_prob(score: Column, ply: Column) -> Column:
    """struct(w, d, l): chances of win, draw and loss for the side to move."""
    m = F.least(F.lit(240.0), as_double(ply)) / 64
    a, b = _cubic(WIN_OFFSET, m), _cubic(WIN_SPREAD, m) * 1.5
    x = F.greatest(F.lit(-2000.0), F.least(F.lit(2000.0), as_double(score) * 100 / PAWN_VALUE))
    w, loss = sigmoid((x - a) / b), sigmoid((-x - a) / b)
    return F.struct(w.alias("w"), (1 - w - loss).alias("d"), loss.alias("l"))


def result_prob(score: Column, ply: Column, result: Column) -> Column:
    """Chance that the model gave to what happened."""
    p = wdl_prob(score, ply)
    return F.when(result > 0, p["w"]).when(result < 0, p["l"]).otherwise(p["d"])


def remap_mate_score(score: Column, base: float = 4000.0, scale: float = 4000.0, decay: float = 0.85) -> Column:
    """Mate scores brought near the others, the sooner the mate the larger; others unchanged."""
    away = F.greatest(F.lit(0.0), MATE_SCORE - F.abs(as_double(score)))
    near = F.signum(as_double(score)) * (base + F.pow(F.lit(decay), away) * scale)
    return F.when(F.abs(score) >= MATE_BOUND, near).otherwise(as_double(score))


def expected_score(v: Column, offset: float, scaling: float) -> Column:
    """Expected score from a value, with the chance of a draw left between two sigmoids."""
    v = as_double(v)
    return 0.5 * (1 + sigmoid((v - offset) / scaling) - sigmoid((-v - offset) / scaling))


@dataclass(frozen=True)
class LossParams:
    in_offset: float = 270.0
    in_scaling: float = 340.0
    out_offset: float = 270.0
    out_scaling: float = 380.0
    power: float = 2.5
    asymmetry: float = 0.0
    w1: float = 0.0
    w2: float = 0.5
    lam: float = 1.0


def blend_target(pf: Column, result_share: Column, lam: Column | float) -> Column:
    lam = lam if isinstance(lam, Column) else F.lit(float(lam))
    return lam * pf + (1 - lam) * result_share


def pointwise_loss(qf: Column, pt: Column, pf: Column, p: LossParams) -> Column:
    """struct(loss, weight) of one row."""
    loss = F.pow(F.abs(pt - qf), F.lit(p.power))
    loss = F.when(qf > pt, loss * (1 + p.asymmetry)).otherwise(loss)
    spread = F.pow(F.greatest(F.lit(0.0), F.pow(pf - 0.5, F.lit(2.0)) * pf * (1 - pf)), F.lit(p.w2))
    return F.struct(loss.alias("loss"), (1 + (2.0**p.w1 - 1) * spread).alias("weight"))


@dataclass(frozen=True)
class LambdaSchedule:
    """schedule_steps None: the line alone runs, over max_steps."""

    start: float = 1.0
    end: float = 1.0
    max_steps: int = 1000
    schedule_steps: int | None = None
    warmup: float = 0.3
    delta: float = 0.0

    def __post_init__(self):
        if self.schedule_steps is not None and (self.schedule_steps <= 0 or not 0 <= self.warmup <= 1):
            raise ValueError("schedule_steps must be positive and warmup a share")


def cycle_at(step: Column, cfg: LambdaSchedule) -> Column:
    """0 to 1: a half cosine up during the warm-up share of the schedule and one down over the rest; after it 0, or 1 if all was warm-up."""
    if cfg.schedule_steps is None:
        return F.lit(0.0)
    s, total = as_double(step), float(cfg.schedule_steps)
    warm = cfg.warmup * total
    up = 0.5 * (1 - F.cos(math.pi * s / warm)) if warm > 0 else F.lit(1.0)
    down = 0.5 * (1 + F.cos(math.pi * (s - warm) / (total - warm))) if total > warm else F.lit(0.0)
    return F.when(s >= total, F.lit(1.0 if cfg.warmup == 1 else 0.0)).when(s < warm, up).otherwise(down)


def lambda_at(step: Column, cfg: LambdaSchedule) -> Column:
    """The line from start to end plus delta times the cycle, within 0 and 1."""
    total = float(cfg.schedule_steps or cfg.max_steps)
    share = F.least(F.lit(1.0), as_double(step) / total) if total > 0 else F.lit(1.0)
    value = cfg.start + (cfg.end - cfg.start) * share + cfg.delta * cycle_at(step, cfg)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def lambda_jitter(lam: Column, sigma: float, key: Column | str, salt: str = "lambda", scale: Column | None = None, batch: Column | None = None) -> Column:
    """lam with normal noise of deviation sigma drawn by the row's key, times scale if given, and with the jitter of the row's batch
    (operators.sequence.batch_jitter), times scale too; within 0 and 1. The same row has the same noise in any partitioning."""
    noise = stable_normal(key, salt) * sigma
    if batch is not None:
        noise = noise + batch
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), lam + (noise * scale if scale is not None else noise)))


def elo(score_rate: Column) -> Column:
    """Rating difference of a score rate, which is kept within 0.001 and 0.999."""
    x = F.greatest(F.lit(1e-3), F.least(F.lit(1 - 1e-3), as_double(score_rate)))
    return -400 * F.log10(1 / x - 1) + F.lit(0.0)


def elo_error(games: Column) -> Column:
    return F.when(games > 0, 400 / F.sqrt(as_double(games)))


def fake_quantize(x: Column, scale: float | tuple[int, int], mode: str) -> Column:
    """Values as they come out of integer inference: `activation` rounds down, `weight` to the nearest even, `output`
    divides integers and cuts towards 0."""
    if mode == "activation":
        return F.floor(x * scale + 1e-5) / scale
    if mode == "weight":
        return F.rint(x * scale) / scale
    if mode == "output":
        # scale is (multiplier, denominator): the value in 1/denominator is turned into 1/multiplier by integers
        multiplier, denominator = scale
        steps = F.rint(x * denominator).cast("bigint") * int(multiplier)
        return F.signum(steps) * F.floor(F.abs(steps) / F.lit(int(denominator))) / float(multiplier)
    raise ValueError(f"no such mode: {mode}")
