"""Features of many boards at once: a batch is a matrix of 64 columns, lines are walked for all pieces together, numbers come from tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from rookery.functions.board import JUMPS, STEPS, around, pawn_targets, ray

#: How many kinds of target each attacker type has, and their slots by (attacker, target) type; -1 is none.
TARGETS = (4, 10, 8, 8, 10, 0)
SLOTS = (
    (-1, 0, -1, 1, -1, -1),
    (0, 1, 2, 3, 4, -1),
    (0, 1, 2, 3, -1, -1),
    (0, 1, 2, 3, -1, -1),
    (0, 1, 2, 3, 4, -1),
    (-1, -1, -1, -1, -1, -1),
)
PAWN, KNIGHT, BISHOP, ROOK, QUEEN = range(5)
#: (row of the batch, feature) of all active features, rows in any order.
Active = tuple[np.ndarray, np.ndarray]


class Boards:
    """A batch: board (rows x 64; -1 is empty, else type * 2 + colour) and the kings' squares by colour, -1 without one. What several
    feature sets need is worked out once."""

    def __init__(self, board: np.ndarray, kings: tuple[np.ndarray, np.ndarray]):
        self.board = board
        self.kings = kings
        self.pieces = np.nonzero(board >= 0)

    def seen_from(self, perspective: int, left: bool) -> np.ndarray:
        """What squares are xored with: the side's king comes to files a-d (left) or e-h, and black's ranks are turned."""
        king = self.kings[perspective]
        return np.where((king % 8 >= 4) == left, 7, 0) ^ (56 * perspective)

    @property
    def hits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, from, to) of each piece but kings that attacks another piece but a king; sliders are followed to the first piece."""
        if not hasattr(self, "_hits"):
            self._hits = self._attacks()
        return self._hits

    def _attacks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, sq = self.pieces
        piece = self.board[row, sq]
        found = []
        jumps, lines = _jumps(), _lines()
        for table, of in ((jumps[0], piece == 0), (jumps[1], piece == 1), (jumps[2], piece // 2 == KNIGHT)):
            r, f = row[of], sq[of]
            for to in table.T:
                found.append((r, f, to[f]))
        kind = piece // 2
        for d in range(8):
            of = (kind == QUEEN) | (kind == (ROOK if d < 4 else BISHOP))
            r, f = row[of], sq[of]
            at = f
            for k in range(7):
                at = lines[d][f, k]
                on = at >= 0
                r, f, at = r[on], f[on], at[on]
                taken = self.board[r, at] >= 0
                found.append((r[taken], f[taken], at[taken]))
                r, f = r[~taken], f[~taken]
        row, sq, to = (np.concatenate(x) for x in zip(*found, strict=True))
        ok = to >= 0
        row, sq, to = row[ok], sq[ok], to[ok]
        target = self.board[row, to]
        ok = (target >= 0) & (target < 10)
        return row[ok], sq[ok], to[ok]


@cache
def _jumps() -> list[np.ndarray]:
    """Squares that white pawns, black pawns and knights attack from each square, -1 for none."""
    lists = [[pawn_targets(0, q) for q in range(64)], [pawn_targets(1, q) for q in range(64)], [around(q, JUMPS) for q in range(64)]]
    return [np.array([x + [-1] * (8 - len(x)) for x in of])[:, : max(map(len, of))] for of in lists]


@cache
def _lines() -> np.ndarray:
    """By direction and square, the squares of the ray from there, nearest first, filled up with -1."""
    return np.array([[(line := ray(q, d)) + [-1] * (7 - len(line)) for q in range(64)] for d in STEPS])


@cache
def _reached(kind: int, colour: int, sq: int) -> tuple[int, ...]:
    """Squares a piece attacks on an empty board, in order."""
    if kind == PAWN:
        return tuple(sorted(pawn_targets(colour, sq)))
    if kind == KNIGHT:
        return tuple(around(sq, JUMPS))
    steps = STEPS[:4] * (kind in (ROOK, QUEEN)) + STEPS[4:] * (kind in (BISHOP, QUEEN))
    return tuple(sorted(q for d in steps for q in ray(sq, d)))


@cache
def threat_numbers() -> np.ndarray:
    """Feature by (attacker, from, to, target) as one side sees them, -1 where there is none. Attackers follow each other, all of white
    first; one has a stretch for each colour and slot of targets, with a number for each (from, to) on an empty board. Of two pieces of
    one kind that attack each other, only one direction counts; so do pawns only if they are of different colours."""
    out = np.full((10, 64, 64, 10), -1, np.int32)
    start = 0
    for colour in (0, 1):
        for kind in range(5):
            attacker, number = kind * 2 + colour, 0
            reach = [_reached(kind, colour, sq) for sq in range(64)]
            stretch = sum(map(len, reach))
            for f, squares in enumerate(reach):
                for t in squares:
                    for target in range(10):
                        slot = SLOTS[kind][target // 2]
                        mutual = target // 2 == kind and (kind != PAWN or target != attacker)
                        if slot >= 0 and not (mutual and f < t):
                            out[attacker, f, t, target] = start + (target % 2 * (TARGETS[kind] // 2) + slot) * stretch + number
                    number += 1
            start += TARGETS[kind] * stretch
    return out


def half_king(b: Boards, perspective: int) -> Active:
    """One feature per piece: oriented square + 64 * (type * 2 + whether it's the other side's) + 768 * king bucket."""
    row, sq = b.pieces
    turn = b.seen_from(perspective, left=False)
    king = b.kings[perspective] ^ turn
    bucket = 4 * (7 - king // 8) + 7 - king % 8
    return row, (sq ^ turn[row]) + (b.board[row, sq] ^ perspective) * 64 + bucket[row] * 768


def pawn_pairs(b: Boards, perspective: int) -> Active:
    """Unordered pairs of pawns on the same or neighbouring files."""
    row, sq = b.pieces
    pawn = (b.board[row, sq] < 2) & (sq >= 8) & (sq < 56)
    row, sq = row[pawn], sq[pawn]
    number = 48 * (b.board[row, sq] ^ perspective) + (sq ^ b.seen_from(perspective, left=True)[row]) - 8
    most = int(np.bincount(row).max()) if len(row) else 0
    rows, features = [row[:0]], [number[:0]]
    for gap in range(1, most):  # each pawn with the one `gap` places on
        a = np.flatnonzero((row[gap:] == row[:-gap]) & (np.abs(sq[gap:] % 8 - sq[:-gap] % 8) <= 1))
        hi, lo = np.maximum(number[a], number[a + gap]), np.minimum(number[a], number[a + gap])
        rows.append(row[a])
        features.append(hi * (hi - 1) // 2 + lo)
    return np.concatenate(rows), np.concatenate(features)


def threats(b: Boards, perspective: int) -> Active:
    """Attacker and target pairs; see threat_numbers."""
    row, f, t = b.hits
    turn = b.seen_from(perspective, left=True)[row]
    feature = threat_numbers()[b.board[row, f] ^ perspective, f ^ turn, t ^ turn, b.board[row, t] ^ perspective]
    ok = feature >= 0
    return row[ok], feature[ok]


def _boards(batch: pa.RecordBatch) -> Boards:
    board = batch.column("board")
    n = len(board)
    sizes = np.asarray(pc.fill_null(pc.list_value_length(board), 0))
    if (bad := (sizes != 64) & (sizes != 0)).any():
        raise ValueError(f"a board has {sizes[bad][0]} squares")
    matrix = np.full((n, 64), -1, np.int64)
    matrix[sizes == 64] = np.asarray(pc.fill_null(board.flatten(), -1), np.int64).reshape(-1, 64)
    return Boards(matrix, tuple(np.asarray(pc.fill_null(batch.column(c), -1), np.int64) for c in ("wk", "bk")))


def _distinct(b: Boards) -> tuple[np.ndarray, pa.Array]:
    """The rows of the batch's different (board, kings), and for each row which of them it is."""
    keys = np.ascontiguousarray(np.column_stack([b.board, *b.kings]).astype(np.int8)).view("V66").reshape(-1)
    _, first, again = np.unique(keys, return_index=True, return_inverse=True)
    return first, pa.array(again.reshape(-1))


def _of_lists(column: pa.Array) -> Active:
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), 0))
    return np.repeat(np.arange(len(sizes)), sizes), np.asarray(column.flatten(), np.int64)


def active_features(parts: list[tuple[int, Callable | str]], keep: list[str]):
    """Function for mapInArrow: the columns `keep`, and `white` and `black`, each row's active features in order. parts are (offset, a
    function of (Boards, perspective), or the stem of two columns that hold the features by side)."""

    def side(b: Boards, n: int, batch: pa.RecordBatch, perspective: int) -> pa.Array:
        rows, features = [], []
        for offset, part in parts:
            r, x = _of_lists(batch.column(f"{part}_{perspective}")) if isinstance(part, str) else part(b, perspective)
            if not isinstance(part, str):  # without the side's king there is no perspective
                has = b.kings[perspective][r] >= 0
                r, x = r[has], x[has]
            rows.append(r)
            features.append(x + offset)
        both = np.sort((np.concatenate(rows).astype(np.int64) << 32) | np.concatenate(features), kind="stable")
        ends = np.searchsorted(both >> 32, np.arange(n + 1))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array((both & 0xFFFFFFFF).astype(np.int32)))

    own = any(isinstance(part, str) for _, part in parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, again = _boards(batch), None
            if not own and batch.num_rows:  # features follow from board and kings alone: equal ones are worked out once
                first, again = _distinct(b)
                b = Boards(b.board[first], (b.kings[0][first], b.kings[1][first]))
            sides = [side(b, len(b.board), batch, p) for p in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(s if again is None else s.take(again) for s in sides)], [*keep, "white", "black"])

    return run
