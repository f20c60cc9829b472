"""Boards as 64-element arrays: index 0 is a1 and 63 is h8; -1 is empty, else type * 2 + colour with types pawn 0 to king 5."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rookery.functions.lambdas import let

#: Letters of the piece ids, and what a piece is worth.
LETTERS = "PpNnBbRrQqKk"
VALUES = (208, 781, 825, 1276, 2538, 0)
WHITE_KING, BLACK_KING = 10, 11


def squares() -> Column:
    return F.sequence(F.lit(0), F.lit(63))


def parse_board(fen: Column) -> Column:
    """array<int> from the board field of a FEN, whose first letter is on a8."""
    field = F.regexp_replace(F.substring_index(fen, " ", 1), "/", "")
    for n in range(8, 0, -1):
        field = F.replace(field, F.lit(str(n)), F.lit("." * n))
    piece = lambda f: lambda q: F.instr(F.lit(LETTERS), F.substring(f, q.bitwiseXOR(F.lit(56)) + 1, F.lit(1))) - 1
    return let(field, lambda f: F.transform(squares(), piece(f)))


def fen_field(fen: Column, n: int) -> Column:
    return F.get(F.split(fen, " "), F.lit(n))


def format_board(board: Column) -> Column:
    """The board field of a FEN."""
    letter = lambda p: F.when(p < 0, ".").otherwise(F.substring(F.lit(LETTERS), p + 1, F.lit(1)))
    rank = lambda b: lambda r: F.array_join(F.transform(F.slice(b, (7 - r) * 8 + 1, F.lit(8)), letter), "")
    text = let(board, lambda b: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), rank(b)), "/"))
    for n in range(8, 0, -1):
        text = F.replace(text, F.lit("." * n), F.lit(str(n)))
    return text


def format_fen(df: DataFrame, board: str = "board", white_to_move: str = "white_to_move", rest: str = "rest", out: str = "fen_out") -> DataFrame:
    """FEN from the board, the side to move and the other fields as text."""
    side = F.when(F.col(white_to_move), "w").otherwise("b")
    return df.withColumn(out, F.concat_ws(" ", format_board(F.col(board)), side, F.col(rest)))


def piece_count(board: Column) -> Column:
    return F.size(F.filter(board, lambda p: p >= 0))


def bitboard(board: Column, holds) -> Column:
    """bigint with bit q set where holds(piece on q); bit 63 makes it negative, so bitboards are never compared by size."""
    put = lambda b: lambda a, q: F.when(holds(F.get(b, q)), a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), q))).otherwise(a)
    return let(board, lambda b: F.aggregate(squares(), F.lit(0).cast("bigint"), put(b)))


def king_square(board: Column, king: int) -> Column:
    """Square of the king, -1 without one."""
    return (F.array_position(board, F.lit(king)) - 1).cast("int")


def us_them(white_to_move: Column) -> tuple[Column, Column]:
    us = white_to_move.cast("int").cast("double")
    return us, 1 - us


def material_eval(board: Column, white_to_move: Column) -> Column:
    """Material balance as the side to move sees it."""
    worth = F.array(*[F.lit(v if c == 0 else -v) for v in VALUES for c in (0, 1)])
    white = F.aggregate(board, F.lit(0), lambda a, p: a + F.when(p >= 0, F.get(worth, p)).otherwise(0))
    return F.when(white_to_move, white).otherwise(-white)


def is_capture(board: Column, move_from: Column, move_to: Column) -> Column:
    """A piece of the other colour stands on the target: castling onto the own rook and en passant aren't captures."""
    target, mover = F.get(board, move_to), F.get(board, move_from)
    return (target >= 0) & (target % 2 != mover % 2)


#: Steps (file, rank): four along files and ranks, then four along diagonals.
STEPS = ((1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (1, -1), (-1, 1), (-1, -1))
JUMPS = tuple((a, b) for a in (-2, -1, 1, 2) for b in (-2, -1, 1, 2) if abs(a) != abs(b))


def _beside(sq: int, step: tuple[int, int]) -> int | None:
    x, y = sq % 8 + step[0], sq // 8 + step[1]
    return y * 8 + x if 0 <= x < 8 and 0 <= y < 8 else None


def ray(sq: int, step: tuple[int, int]) -> list[int]:
    """Squares from sq on, nearest first."""
    out, at = [], _beside(sq, step)
    while at is not None:
        out.append(at)
        at = _beside(at, step)
    return out


def around(sq: int, steps: tuple[tuple[int, int], ...]) -> list[int]:
    return sorted(q for q in (_beside(sq, s) for s in steps) if q is not None)


def pawn_targets(colour: int, sq: int) -> list[int]:
    """Squares that a pawn attacks; pawns stand on ranks 2 to 7."""
    up = 1 - 2 * colour
    return around(sq, ((-1, up), (1, up))) if 0 < sq // 8 < 7 else []


def literal(values: list) -> Column:
    """Numbers, or lists of numbers, as one literal."""
    text = lambda v: f"array({','.join(map(text, v))})" if isinstance(v, list) else f"{v}L" if abs(v) >= 1 << 31 else str(v)
    return F.expr(text(values))


def rays() -> Column:
    """array<array<int>>: entry 8 * sq + d is the ray from sq in direction d."""
    return literal([ray(sq, d) for sq in range(64) for d in STEPS])


def knight_jumps() -> Column:
    return literal([around(sq, JUMPS) for sq in range(64)])


def first_on(board: Column, squares_of_ray: Column) -> Column:
    """The nearest occupied square of a ray, null without one."""
    return F.get(F.filter(squares_of_ray, lambda q: F.get(board, q) >= 0), F.lit(0))


def is_attacked(board: Column, square: Column, by: Column) -> Column:
    """Whether a piece of colour `by` attacks the square, pins aside; false where there is no square (-1)."""
    pawns = literal([[q for q in range(64) if sq in pawn_targets(c, q)] for c in (0, 1) for sq in range(64)])
    kings = literal([around(sq, STEPS) for sq in range(64)])

    def attacked(x: Column) -> Column:
        stands = lambda where, kind: F.exists(where, lambda q: F.get(x["board"], q) == kind * 2 + x["by"])

        def slides(d: Column) -> Column:
            piece = F.get(x["board"], first_on(x["board"], F.get(rays(), x["sq"] * 8 + d))) - x["by"]
            return F.coalesce((piece == 8) | (piece == F.when(d < 4, 6).otherwise(4)), F.lit(False))

        near = stands(F.get(knight_jumps(), x["sq"]), 1) | stands(F.get(kings, x["sq"]), 5) | stands(F.get(pawns, x["by"] * 64 + x["sq"]), 0)
        return F.when(x["sq"] < 0, False).otherwise(near | F.exists(F.sequence(F.lit(0), F.lit(7)), slides))

    return let(F.struct(board.alias("board"), square.cast("int").alias("sq"), by.cast("int").alias("by")), attacked)


def mover_in_check(df_board: Column, white_to_move: Column, white_king: Column, black_king: Column) -> Column:
    king = F.when(white_to_move, white_king).otherwise(black_king)
    return is_attacked(df_board, king, white_to_move.cast("int"))


def parse_fen(df: DataFrame, fen: str = "fen") -> DataFrame:
    """df with board, white_to_move, piece_count, occ, wk, bk and rest (the FEN's fields after the side to move).

    A null FEN gives nulls. Unknown letters are empty squares."""
    out = df.withColumn("board", parse_board(F.col(fen)))
    return out.withColumns({
        "white_to_move": fen_field(F.col(fen), 1) == "w",
        "piece_count": piece_count(F.col("board")),
        "occ": bitboard(F.col("board"), lambda p: p >= 0),
        "wk": king_square(F.col("board"), WHITE_KING),
        "bk": king_square(F.col("board"), BLACK_KING),
        "rest": F.array_join(F.slice(F.split(F.col(fen), " "), 3, 8), " "),
    })


def mirror_king_right(king: Column, perspective: int | Column) -> Column:
    """Xor that brings the king to files e-h, and to the first ranks for black: 7 if it stands on a-d, 56 for black."""
    persp = F.lit(perspective) if isinstance(perspective, int) else perspective
    return F.when(king % 8 < 4, 7).otherwise(0).bitwiseXOR(persp * 56)


def mirror_king_left(king: Column, perspective: int | Column) -> Column:
    """The other orientation: 7 if the king stands on e-h."""
    persp = F.lit(perspective) if isinstance(perspective, int) else perspective
    return F.when(king % 8 >= 4, 7).otherwise(0).bitwiseXOR(persp * 56)


def king_bucket(king: Column, perspective: int | Column) -> Column:
    """0 to 31 from the oriented king square."""
    k = king.bitwiseXOR(mirror_king_right(king, perspective))
    return (4 * (7 - F.floor(k / 8)) + (7 - k % 8)).cast("int")
