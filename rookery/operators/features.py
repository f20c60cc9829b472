"""Sparse input features of positions, long form (row_id, perspective, feature) and packed arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rookery.functions.board import is_capture, mover_in_check
from rookery.operators import board_kernel

HALFKA_INPUTS, THREAT_INPUTS, PAWN_PAIR_INPUTS = 24576, 59808, 4560


#: name -> (number of inputs, most active at once, kernel over a batch of boards or None, array<int> column by perspective or None).
REGISTRY: dict[str, tuple[int, int, Callable | None, Callable[[int], Column] | None]] = {}


def register_feature(name: str, inputs: int, max_active: int, array: Callable[[int], Column] | None = None, kernel: Callable | None = None) -> None:
    """Make a feature set known to compose_features: by array(perspective), array<int> from the columns of parse_fen, or by
    kernel(boards, perspective), the (row, feature) of a batch (board_kernel.Boards)."""
    if (array is None) == (kernel is None):
        raise ValueError("give a column or a kernel")
    REGISTRY[name] = (inputs, max_active, kernel, array)


register_feature("Full_Threats", THREAT_INPUTS, 128, kernel=board_kernel.threats)
register_feature("PP_3Wide", PAWN_PAIR_INPUTS, 128, kernel=board_kernel.pawn_pairs)
register_feature("HalfKAv2_hm", HALFKA_INPUTS, 32, kernel=board_kernel.half_king)
ALL_FEATURES = "Full_Threats+PP_3Wide+HalfKAv2_hm"


def feature_layout(name: str) -> list[tuple[str, int, int, int]]:
    """(name, offset, inputs, max active) of each part of `A+B+C`; an unknown name is an error."""
    out, at = [], 0
    for part in name.split("+"):
        if part not in REGISTRY:
            raise ValueError(f"no such feature set: {part}")
        out.append((part, at, *REGISTRY[part][:2]))
        at += REGISTRY[part][0]
    return out


def feature_arrays(positions: DataFrame, name: str = ALL_FEATURES, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of positions (all by default) with `white` and `black`: each side's active features of all parts, offsets added,
    in order. Batches of boards go through one kernel: one scan, no join, no shuffle. A row without a board, and a side without a king,
    has no features of the built-in sets."""
    keep = positions.columns if keep is None else keep
    parts, own = [], []
    for i, (part, offset, *_) in enumerate(feature_layout(name)):
        kernel, array = REGISTRY[part][2:]
        parts.append((offset, kernel or f"_own{i}"))
        if kernel is None:
            own += [array(p).cast("array<int>").alias(f"_own{i}_{p}") for p in (0, 1)]
    needs = [c for c in ("board", "wk", "bk") if c not in keep]
    schema = T.StructType([*positions.select(*keep).schema, *(T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("white", "black"))])
    return positions.select(*keep, *needs, *own).mapInArrow(board_kernel.active_features(parts, keep), schema)


def _both_sides(arrays: DataFrame, row_id: str) -> DataFrame:
    sides = F.array(*[F.struct(F.lit(p).alias("perspective"), F.col(c).alias("xs")) for p, c in enumerate(("white", "black"))])
    return arrays.select(F.col(row_id).alias("row_id"), F.explode(sides).alias("p")).select("row_id", "p.perspective", "p.xs")


def compose_features(positions: DataFrame, name: str = ALL_FEATURES, row_id: str = "row_id") -> DataFrame:
    """(row_id, perspective, feature), a row per active feature: one scan, no shuffle."""
    return _both_sides(feature_arrays(positions, name, [row_id]), row_id).select("row_id", "perspective", F.explode("xs").alias("feature"))


def halfka_features(positions: DataFrame, row_id: str = "row_id") -> DataFrame:
    return compose_features(positions, "HalfKAv2_hm", row_id)


def pawn_pair_features(positions: DataFrame, row_id: str = "row_id") -> DataFrame:
    return compose_features(positions, "PP_3Wide", row_id)


def threat_features(positions: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Attacker and target pairs seen from both sides."""
    return compose_features(positions, "Full_Threats", row_id)


def padded(xs: Column, max_active: int) -> Column:
    """xs, in order as feature_arrays gives them, filled up with -1 to max_active; more active ones are an error."""
    n = F.size(xs)
    full = F.concat(xs, F.array_repeat(F.lit(-1), F.greatest(F.lit(max_active) - n, F.lit(0))))
    return F.when(n <= max_active, full).otherwise(F.raise_error(F.lit("too many active features")).cast("array<int>"))


def pack_features(positions: DataFrame, name: str = ALL_FEATURES, row_id: str = "row_id") -> DataFrame:
    """(row_id, perspective, features, n_active): sorted, padded with -1 to the most that can be active. No shuffle."""
    most = sum(n for *_, n in feature_layout(name))
    return _both_sides(feature_arrays(positions, name, [row_id]), row_id).select("row_id", "perspective", padded(F.col("xs"), most).alias("features"), F.size("xs").alias("n_active"))


def in_check(positions: DataFrame, row_id: str = "row_id") -> DataFrame:
    """(row_id) of positions whose side to move is in check, told from each row's own board."""
    checked = mover_in_check(F.col("board"), F.col("white_to_move"), F.col("wk"), F.col("bk"))
    return positions.where(checked).select(F.col(row_id).alias("row_id"))


def is_quiet(move_from: Column, move_to: Column) -> Column:
    """No capture and no check, over the columns of parse_fen."""
    return ~is_capture(F.col("board"), move_from, move_to) & ~mover_in_check(F.col("board"), F.col("white_to_move"), F.col("wk"), F.col("bk"))


def keep_quiet(positions: DataFrame, move_from: str, move_to: str) -> DataFrame:
    """positions less those whose move captures and those in check: a filter of columns."""
    return positions.where(is_quiet(F.col(move_from), F.col(move_to)))
